"""Isotonic fits of many curves at once, and look-ups in them, as Spark jobs.

Fit: points (one per distinct score of a curve, with their rows and hits) are
dealt by range of curve and score. Each slice pools adjacent violators of its
stretch; the lists of blocks that are left are merged with their neighbours,
eight slices at a time, then eight such groups, until a curve is one list.
Pooling is associative (the pooled means are those of the lower hull of the
cumulated points, however the points are cut) and works on whole numbers, so
the result depends on neither layout nor order. Blocks of n rows are
rising fractions with denominators that add up to n, so there are about
n ** (2/3) of them at most: that is what a merge holds, never points.

Look-up: the blocks become a table of segments by bucket, a monotone function
of the score. A row meets its segment by an equi-join on curve and bucket and a
range condition inside the bucket. The table is small where the blocks are few,
and then Spark broadcasts it by its size; otherwise both sides are shuffled,
and a bucket with very many rows is split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin

FAN_IN = 8
#: Buckets to a doubling of the odds, and the last bucket on each side.
_PER_DOUBLING, _LAST = 64, 2048
_FIELDS = "lo double, hi double, n long, hits long, block int, next_lo double, next_value double"
_NAMES = ["lo", "hi", "n", "hits", "block", "next_lo", "next_value"]


def pool(blocks: Iterable[tuple[float, float, int, int]]) -> list[tuple[float, float, int, int]]:
    """Blocks (lo, hi, n, hits) in order of score, pooled until the shares of hits rise strictly."""
    out: list[tuple[float, float, int, int]] = []
    for block in blocks:
        while out and out[-1][3] * block[2] >= block[3] * out[-1][2]:
            before = out.pop()
            block = (before[0], block[1], before[2] + block[2], before[3] + block[3])
        out.append(block)
    return out


def _rows(blocks: list[tuple], key: tuple, part: int) -> list[tuple]:
    after = [*blocks[1:], None]
    return [(part, *key, *b, i, None if a is None else a[0], None if a is None else a[3] / a[2]) for i, (b, a) in enumerate(zip(blocks, after, strict=True))]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def isotonic_blocks(points: DataFrame, keys: list[str]) -> DataFrame:
    """The isotonic fit of each curve: keys..., block (from 0), lo, hi, n, hits, next_lo, next_value.

    ``points`` has the key columns (whole numbers, NULL is a key too), ``score``,
    ``n`` and ``hits``, a row for each distinct score of a curve. Rows without
    a score are left out. Shares of hits rise strictly from block to block.
    """
    # Each key as a number and a flag, so that NULL sorts and groups like any other.
    own = [f"k{i}" for i in range(2 * len(keys))]
    named = [c.cast("long") for k in keys for c in (F.coalesce(k, F.lit(0)), F.col(k).isNull())]
    data = points.where(F.col("score").isNotNull() & ~F.isnan("score")).select(
        *[c.alias(name) for c, name in zip(named, own, strict=True)], F.col("score").cast("double").alias("lo"),
        F.col("n").cast("long").alias("n"), F.col("hits").cast("long").alias("hits"))
    schema = "part long, " + "".join(f"{k} long, " for k in own) + _FIELDS
    whole, real = pa.int64(), pa.float64()
    arrow = pa.schema([("part", whole), *[(k, whole) for k in own], ("lo", real), ("hi", real), ("n", whole), ("hits", whole),
                       ("block", pa.int32()), ("next_lo", real), ("next_value", real)])

    def pool_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, held = TaskContext.get().partitionId(), None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*own, "lo", "n", "hits")]
            for *now, lo, n, hits in zip(*columns, strict=True):
                if now != key and held:
                    yield from _table(_rows(held, key, part), arrow).to_batches()
                    held = []
                key = now
                block = (lo, lo, n, hits)
                while held and held[-1][3] * block[2] >= block[3] * held[-1][2]:
                    before = held.pop()
                    block = (before[0], block[1], before[2] + block[2], before[3] + block[3])
                held.append(block)
        if held:
            yield from _table(_rows(held, key, part), arrow).to_batches()

    def pool_group(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("lo").to_pylist()
        key, part = tuple(rows[0][k] for k in own), rows[0]["part"] // FAN_IN
        return _table(_rows(pool((r["lo"], r["hi"], r["n"], r["hits"]) for r in rows), key, part), arrow)

    slices = data.repartitionByRange(*own, "lo").sortWithinPartitions(*own, "lo")
    blocks = pin(slices.mapInArrow(pool_slice, schema))
    width = blocks.agg(F.max("part")).first()[0] or 0
    while True:
        blocks = pin(blocks.groupBy(*own, F.floor(F.col("part") / FAN_IN).alias("group")).applyInArrow(pool_group, schema))
        width //= FAN_IN
        if not width:
            break
    back = [F.when(F.col(own[2 * i + 1]) == 0, F.col(own[2 * i])).alias(k) for i, k in enumerate(keys)]
    return blocks.select(*back, "block", "lo", "hi", "n", "hits", "next_lo", "next_value")


def _bucket(score: Column) -> Column:
    """A number that never falls as the score grows; fine near 0 and near 1."""
    odds = F.floor(F.log2(score / (1 - score)) * _PER_DOUBLING)
    inside = F.least(F.greatest(odds, F.lit(-_LAST)), F.lit(_LAST))
    return F.when(score <= 0, -_LAST).when(score >= 1, _LAST).otherwise(inside).cast("int")


def segments(blocks: DataFrame) -> DataFrame:
    """The table that :func:`look_up` joins: a row for each block and bucket it reaches into, up to the next block."""
    first = F.when(F.col("block") == 0, F.lit(-_LAST)).otherwise(_bucket(F.col("lo")))
    last = F.when(F.col("next_lo").isNull(), F.lit(_LAST)).otherwise(_bucket(F.col("next_lo")))
    return blocks.withColumn("value", F.col("hits") / F.col("n")).withColumn("bucket", F.explode(F.sequence(first, last)))


def look_up(df: DataFrame, table: DataFrame, score: str, keys: dict[str, Column], out: str) -> DataFrame:
    """Adds ``out``: the fitted share at ``score``.

    Inside a block its share, between two blocks the straight line from one to
    the other, beyond the first and last theirs. ``keys`` maps the table's key
    columns to the row's values (NULL-safe). NULL where the score or curve is missing.
    """
    small = table.select(*[F.col(k).alias(f"__{k}") for k in keys],
                         *[F.col(c).alias(f"__{c}") for c in ("bucket", "block", "lo", "hi", "value", "next_lo", "next_value")])
    value = F.when(~F.isnan(F.col(score).cast("double")), F.col(score).cast("double"))
    # The score and its bucket are columns before the join, so that they are worked out once a row.
    rows = df.withColumn("__s", value).withColumn("__at", _bucket(F.col("__s")))
    s = F.col("__s")
    here = s.isNotNull() & (F.col("__bucket") == F.col("__at")) & ((F.col("__block") == 0) | (s >= F.col("__lo"))) & (F.col("__next_lo").isNull() | (s < F.col("__next_lo")))
    for k, value in keys.items():
        here = here & F.col(f"__{k}").eqNullSafe(value)
    line = F.col("__value") + (F.col("__next_value") - F.col("__value")) * ((s - F.col("__hi")) / (F.col("__next_lo") - F.col("__hi")))
    share = F.when((s <= F.col("__hi")) | F.col("__next_lo").isNull(), F.col("__value")).otherwise(line)
    return rows.join(small, here, "left").select(*[F.col(f"`{c}`") for c in df.columns], share.alias(out))
