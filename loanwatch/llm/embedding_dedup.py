"""Embedding near-duplicates through a pivot-permutation index.

Method: reference vectors (pivots) are drawn from the data; each vector is
described by its ``NEAREST`` nearest pivots. Vectors of one label are candidates
if they share at least ``SHARED`` of them, or one that covers both; they are
found through inverted lists by (label, pivot) and verified by their cosine in
double precision. With the pivots of a vector in order of number, two that
share ``SHARED`` meet in a list of the first ``NEAREST - SHARED + 1``, so each
vector stands in so many lists and in those of the pivots that cover it; a
pair counts only in the list of its smallest shared pivot.

Dense groups: a pivot covers the vectors within twice the threshold's angle,
and no pivot is kept that a pivot before it covers, so a group of near copies
holds few pivots however many of its rows are drawn. If a vector lies within
the threshold's angle of one of its pivots, every partner of it is covered by
that pivot (triangle inequality), so its pairs are compared one and all, unless
NEAREST other pivots are nearer to the partner.

Fit and size: ``4 * sqrt(rows)`` different vectors, between 64 and
``PIVOTS_MOST``, are drawn by hash of the vector and thinned. Every vector is
indexed. Lists longer than ``TILE`` are
split in blocks and each pair of blocks is a cell of its own, so no task holds
a list, none is cut short, and cells are scored by one matrix product. Cells
hand on link counts and local roots, never pairs. Exact copies are one class
from the start and are counted by its size.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows without label or vec_id, link with nothing: n_links 0 and
their own component. Vectors of different lengths are never compared. vec_id
is a key: rows that repeat one are judged each by its vector, and share the
smallest component of their classes. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .common import components, partitions

THRESHOLD = 0.93
NEAREST, SHARED, PIVOTS_MOST = 8, 2, 16_384
TILE = 1024
#: Rows that a bucket of cells is meant to hold.
BUCKET_ROWS = 50_000


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column whose rows have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)       # so that squares neither overflow nor vanish
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _cover(threshold: float) -> float:
    """The cosine at twice the angle of ``threshold``."""
    return 2 * threshold * threshold - 1 if threshold > 0 else -1.0


def _thinned(unit: np.ndarray, cover: float) -> np.ndarray:
    """Pivots of which none is covered by one before it."""
    left, kept = np.arange(len(unit)), []
    while len(left):
        kept.append(left[0])
        left = left[1:]
        left = left[unit[left] @ unit[kept[-1]] < cover]
    return unit[kept]


def _describe(shared, cover: float):
    """Adds each vector's nearest pivots, in order of number, and those of them that cover it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("embedding")).to_numpy()
            near, covers = np.zeros((batch.num_rows, NEAREST), np.int32), np.zeros((batch.num_rows, NEAREST), bool)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                unit, pivots = _matrix(batch.column("embedding").take(pa.array(rows))), shared.value.get(int(dim))
                if pivots is None or len(pivots) < SHARED:      # too few pivots of this length were drawn: one list for all
                    continue
                k = min(NEAREST, len(pivots))
                for a in range(0, len(rows), 1024):
                    cosine = unit[a:a + 1024] @ pivots.T
                    close = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
                    close.sort(axis=1)
                    near[rows[a:a + 1024], :k] = close
                    covers[rows[a:a + 1024], :k] = np.take_along_axis(cosine, close, axis=1) >= cover
                    near[rows[a:a + 1024], k:] = -1 - np.arange(NEAREST - k)
            flat = pa.array(near.ravel())
            ends = pa.array(np.arange(len(near) + 1, dtype=np.int32) * NEAREST)
            bits = pa.array(covers @ (1 << np.arange(NEAREST)), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, flat), bits], [*batch.schema.names, "near", "covers"])
    return run


def _roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest place each of n places is linked to, over links i - j."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _cells(threshold: float):
    def cell(pivot: int, blocks: tuple, rep, n, near, covers, block, unit):
        a, b = (np.flatnonzero(block == x) for x in blocks)
        i, j = np.nonzero(unit[a] @ unit[b].T >= threshold)
        if blocks[0] == blocks[1]:
            i, j = i[i < j], j[i < j]
        i, j = a[i], b[j]
        covered = ((near == pivot) & (covers[:, None] >> np.arange(NEAREST) & 1 > 0)).any(axis=1)
        keep = np.empty(len(i), bool)
        for s in range(0, len(i), 200_000):
            x, y = near[i[s:s + 200_000]], near[j[s:s + 200_000]]
            both = (x[:, :, None] == y[:, None, :]).any(axis=2) & (x >= 0)
            # A pair counts once: in the list of the smallest pivot that both have.
            enough = (both.sum(axis=1) >= SHARED) | (covered[i[s:s + 200_000]] & covered[j[s:s + 200_000]])
            keep[s:s + 200_000] = enough & (np.where(both, x, np.iinfo(np.int32).max).min(axis=1) == pivot)
        i, j = i[keep], j[keep]
        links = np.bincount(i, n[j], len(rep)) + np.bincount(j, n[i], len(rep))
        order = np.argsort(rep, kind="stable")
        place = np.empty(len(rep), np.int64)
        place[order] = np.arange(len(rep))
        root = rep[order][_roots(place[i], place[j], len(rep))[place]]
        some = links > 0
        return rep[some], links[some].astype(np.int64), root[some]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("label", "dim", "pivot", "ti", "tj")]).combine_chunks()
        cols = {c: rows[c].to_numpy() for c in ("label", "dim", "pivot", "ti", "tj", "rep", "n", "covers", "block")}
        near = rows["near"].combine_chunks().flatten().to_numpy().reshape(-1, NEAREST)
        new = np.ones(rows.num_rows, bool)
        new[1:] = np.logical_or.reduce([cols[c][1:] != cols[c][:-1] for c in ("label", "dim", "pivot", "ti", "tj")])
        cut = np.append(np.flatnonzero(new), rows.num_rows)
        out = []
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if e - s > 1:
                unit = _matrix(rows["embedding"].slice(s, e - s).combine_chunks())
                out.append(cell(cols["pivot"][s], (cols["ti"][s], cols["tj"][s]), cols["rep"][s:e], cols["n"][s:e], near[s:e], cols["covers"][s:e], cols["block"][s:e], unit))
        parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        return pa.table([pa.array(p.astype(np.int64)) for p in parts], names=["rep", "links", "root"])
    return run


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Near-duplicate components of vectors with equal labels.

    Takes ``vec_id long, embedding array<float or double>, label int``. Returns
    a row for each row: vec_id, n_links (other vectors at ``threshold`` or
    above that the index found), component_id (smallest vec_id that links
    reach, its own included), kept (vec_id = component_id).
    """
    spark = vectors.sparkSession
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(whole & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long"), "label", "embedding").withColumn("fit", fit)
    rows = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    good = rows.where("fit")

    key = ["label", "h1", "h2"]
    classes = good.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    first = good.select("vec_id", *key, F.col("embedding").cast("array<double>").alias("embedding")).dropDuplicates(["vec_id", *key])
    reps = classes.join(first.withColumnRenamed("vec_id", "rep"), ["rep", *key])

    n_pivots = min(PIVOTS_MOST, max(64, math.ceil(4 * math.sqrt(good.count()))))
    drawn = (good.select("h1", "h2", F.col("embedding").cast("array<double>").alias("embedding")).dropDuplicates(["h1", "h2"])
             .orderBy("h2", "h1").limit(n_pivots).toArrow()["embedding"].combine_chunks())
    sizes, cover = pa.compute.list_value_length(drawn).to_numpy(), _cover(threshold)
    shared = spark.sparkContext.broadcast({int(d): _thinned(_matrix(drawn.filter(pa.array(sizes == d))), cover) for d in np.unique(sizes)})

    plain = reps.select("rep", F.col("label").cast("long").alias("label"), "n", F.size("embedding").alias("dim"), "embedding")
    index = pin(plain.mapInArrow(_describe(shared, cover), "rep long, label long, n long, dim int, embedding array<double>, near array<int>, covers int"))
    covering = F.filter("near", lambda p, k: F.expr("covers").bitwiseAND(F.element_at(F.array(*[F.lit(1 << x) for x in range(NEAREST)]), k + 1)) > 0)
    listed = F.array_union(F.slice("near", 1, NEAREST - SHARED + 1), covering)
    lists = index.withColumn("pivot", F.explode(listed)).where("pivot >= 0")
    longer = lists.groupBy("label", "dim", "pivot").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / TILE).cast("long")
    lists = (lists.join(longer, ["label", "dim", "pivot"]).withColumn("blocks", blocks)
             .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .withColumns({"ti": F.least("block", "other"), "tj": F.greatest("block", "other")}))
    total = longer.agg(F.sum(F.col("m") * blocks)).first()[0] or 0
    buckets = max(partitions(spark), -(-total // BUCKET_ROWS))
    found = pin(lists.withColumn("bucket", F.pmod(F.xxhash64("label", "dim", "pivot", "ti", "tj"), F.lit(buckets)))
                .select("bucket", "label", "dim", "pivot", "ti", "tj", "block", "rep", "n", "near", "covers", "embedding")
                .groupBy("bucket").applyInArrow(_cells(threshold), "rep long, links long, root long"))

    linked = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = (classes.join(links, "rep", "left").join(linked, classes["rep"] == linked["node"], "left")
             .select(*key, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = (good.select("vec_id", *key).join(known, key).select("vec_id", "n_links", "component_id")
           .unionByName(rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
