"""Order statistics and quantiles, exact at any size, without a global sort.

``percentile`` keeps every distinct value of a group in one aggregation buffer,
and sorting all values moves them all. Here a wanted rank is closed in on: the
first pass counts coarse buckets of a monotone function of the value (64 to a
doubling), the second cuts each bucket that holds a wanted rank into fine ones,
the third looks at the distinct values of the fine buckets that are left. Each
pass combines counts map-side; only what the wanted ranks lie in goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin

_PER_DOUBLING, _FINE = 64, 65_536
#: More than any coarse bucket number of a double (64 * 1075), so that signs keep apart.
_SIGN_GAP = 100_000
_LARGEST = 1.7976931348623157e308


def _coarse(v: Column) -> Column:
    """A bucket number that never falls as the value grows."""
    size = F.floor(F.log2(F.least(F.abs(v), F.lit(_LARGEST))) * _PER_DOUBLING) + _SIGN_GAP
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("long")


def _fine(v: Column, lo: Column, hi: Column) -> Column:
    share = F.when(hi > lo, (v / _FINE - lo / _FINE) / (hi / _FINE - lo / _FINE)).otherwise(F.lit(0.0))
    return F.floor(F.least(share, F.lit(1.0)) * _FINE).cast("long")


def order_statistics(df: DataFrame, keys: list[str], value: str, wanted: Callable[[Column], Column],
                     weight: str | None = None, written: bool = False) -> DataFrame:
    """Values at given ranks: (keys..., id, v).

    ``wanted`` maps a group's size (of non-NULL values, each counted ``weight``
    times) to an array of struct(id, rank); ranks start at 0, and those outside
    the group give no row. It may use the key columns. Keys match NULL-safely.

    The narrow columns are written once and each pass reads them (with ``written`` each pass
    reads ``df`` as it is, which should come from a narrow written table). What a pass finds (the
    buckets that hold wanted ranks, a few for each group) is written too, with its
    ranks as data, so that plans stay small, and Spark sees its size when it joins it.
    """
    cols = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("__k0")]
    by = [f"__k{i}" for i in range(len(cols))]
    n = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    data = df.select(*cols, F.col(value).cast("double").alias("__v"), n.alias("__n")).where("__v is not null")
    data = (data if written else pin(data)).withColumn("__b", _coarse(F.col("__v")))

    def counted(rows: DataFrame, on: list[str]) -> DataFrame:
        return rows.groupBy(*on).agg(F.sum("__n").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))

    def holding(counts: DataFrame, within: list[str], order: str, before: Column, targets: Column) -> DataFrame:
        """A row for each wanted rank and the bucket it lies in, with the rows before that bucket."""
        past = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        out = counts.withColumn("__from", before + F.coalesce(F.sum("__n").over(past), F.lit(0)))
        return out.withColumn("__t", F.explode(targets)).where((F.col("__t.rank") >= F.col("__from")) & (F.col("__t.rank") < F.col("__from") + F.col("__n")))

    def buckets(found: DataFrame, on: list[str], keep: dict[str, str]) -> DataFrame:
        """One row for each bucket that is left, with its ranks."""
        return pin(found.groupBy(*on).agg(*[F.first(c).alias(name) for c, name in keep.items()], F.collect_list("__t").alias("__w")))

    def meet(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
        """Join on keys of which the group columns may be NULL."""
        small = small.select(*[F.col(c).alias(f"{c}__") for c in on], *[c for c in small.columns if c not in on])
        same = F.lit(True)
        for c in on:
            same = same & (rows[c].eqNullSafe(small[f"{c}__"]) if c in by else rows[c] == small[f"{c}__"])
        return rows.join(small, same).drop(*[f"{c}__" for c in on])

    named = {k: F.col(b) for k, b in zip(keys, by, strict=False)}
    size = F.sum("__n").over(Window.partitionBy(*by))
    coarse = counted(data, [*by, "__b"]).withColumns(named | {"__size": size})
    spot = [*by, "__b"]
    first = buckets(holding(coarse, by, "__b", F.lit(0), wanted(F.col("__size"))), spot, {"__lo": "__l", "__hi": "__h", "__from": "__f"})
    data = meet(data, first, spot).withColumn("__s", _fine(F.col("__v"), F.col("__l"), F.col("__h")))

    fine = counted(data, [*spot, "__s"])
    fine = meet(fine, first.select(*spot, "__f", "__w"), spot)
    spot = [*spot, "__s"]
    second = buckets(holding(fine, spot[:-1], "__s", F.col("__f"), F.col("__w")), spot, {"__from": "__f"})
    data = data.drop("__f", "__w", "__l", "__h")

    last = counted(meet(data, second.select(*spot), spot), [*spot, "__v"])
    found = holding(meet(last, second, spot), spot, "__v", F.col("__f"), F.col("__w"))
    return found.select(*[F.col(b).alias(k) for k, b in zip(keys, by, strict=False)], F.col("__t.id").alias("id"), F.col("__v").alias("v"))


def quantiles(df: DataFrame, group: list[str], value: str, probs: list[float],
              method: str = "exact", accuracy: int = 10_000,
              weight: str | None = None) -> DataFrame:
    """Long frame (group..., prob, value): numpy-style linear quantiles.

    NULL values are left out; a group without values gives no rows. ``weight``
    says how many times a row counts, for frames that are already reduced.
    ``method="approx"`` is one pass with ``percentile_approx`` (rank error at
    most n/accuracy, no interpolation) for when an estimate will do.
    """
    probs = [float(p) for p in probs]
    if method == "approx":
        if weight:
            raise ValueError("approximate quantiles take unweighted rows")
        arr = F.array(*[F.lit(p) for p in probs])
        return (df.where(F.col(value).isNotNull()).groupBy(*group)
                .agg(F.percentile_approx(
                    value, probs, accuracy).alias("__q"))
                .select(*group, F.explode(F.arrays_zip(arr.alias("prob"),
                                                       F.col("__q").alias("value"))).alias("z"))
                .select(*group, F.col("z.prob").alias("prob"),
                        F.col("z.value").cast("double").alias("value")))

    def ranks(n: Column) -> Column:
        """Position p * (n - 1) lies between ranks floor and floor + 1; the fraction travels in the id."""
        out = []
        for p in probs:
            h = F.lit(p) * (n - 1)
            lo = F.floor(h)
            for end, rank in ((0, lo), (1, F.least(lo + 1, n - 1))):
                out.append(F.struct(F.struct(F.lit(p).alias("prob"), F.lit(end).alias("end"), (h - lo).alias("frac")).alias("id"),
                                    rank.cast("long").alias("rank")))
        return F.array(*out)

    found = order_statistics(df, group, value, ranks, weight).groupBy(*group, F.col("id.prob").alias("prob")).agg(
        F.max(F.when(F.col("id.end") == 0, F.col("v"))).alias("__a"), F.max(F.when(F.col("id.end") == 1, F.col("v"))).alias("__b"),
        F.max("id.frac").alias("__f"))
    return found.select(*group, "prob", F.when(F.col("__f") == 0, F.col("__a"))
                        .otherwise(F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__f")).alias("value"))


def quantile_columns(df: DataFrame, group: list[str], value: str,
                     names: dict[str, float], method: str = "exact") -> DataFrame:
    """Wide form of :func:`quantiles`: one row per group, one column per name."""
    long = quantiles(df, group, value, sorted(set(names.values())), method)
    return long.groupBy(*group).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
          for n, p in names.items()])
