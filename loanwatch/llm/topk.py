"""Exact top-k search by inner product, in tiles.

Method: queries are packed into blocks and candidates into shards, each one
row with a matrix. Blocks are dealt to lanes and shards to slots; every lane meets
every slot in a cell of its own, so a block travels once for each slot and a shard once
for each lane. A cell takes its queries and candidates tile by tile: one matrix product scores
a tile, and only scores above a query's k-th best so far are looked at. A tree of
merges keeps the best ``k`` of ever more slots. What a cell and a tile hold is bounded;
more rows make more cells.

Components become floor(256 * x) with x as double, and travel as the narrowest numbers that
hold them. Scores are exact integers: products are taken in doubles while every sum stays
below 2**53, in Python integers otherwise.

Defined results: a vector that is null or holds null or non-finite components
takes no part; neither does a null id. A query is not scored against rows of
its own id, so repeated rows of an id are each a query and a candidate of
others. Vectors of another length than the query's are not its candidates.
Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MASK64

SCALE = 256
BLOCK_ROWS, SHARD_ROWS, MERGE = 2048, 4096, 32
#: Blocks of a lane and shards of a slot, of vectors of WIDTH components; fewer if they are longer. Cells that there should be at least, for as many tasks.
LANE_BLOCKS, SLOT_SHARDS, WIDTH, CELLS = 32, 32, 64, 256
#: Queries and candidates of a tile.
TILE = (512, 4096)


def _packed(dim: int, ids: list[np.ndarray], matrix: list[np.ndarray], name: int) -> pa.RecordBatch:
    whole = np.concatenate(matrix)
    most = np.abs(whole).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return pa.RecordBatch.from_arrays(
        [pa.array([name]), pa.array([dim], pa.int32()), pa.array([kind]), pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()),
         pa.array([whole.astype(kind).tobytes()], pa.binary())], ["name", "dim", "kind", "ids", "matrix"])


def _pack(rows_most: int):
    """Vectors of one length as one row for each ``rows_most`` of them: name, dim, kind (of the numbers), ids, matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        kept: dict[int, tuple[list, list]] = {}              # by length, fewer than rows_most each
        n_kept = 0
        for batch in batches:
            ids, vectors = batch.column("vec_id").to_numpy(), batch.column("embedding")
            sizes = pa.compute.list_value_length(vectors).to_numpy()
            flat = vectors.flatten().to_numpy().astype(np.float64)
            first = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                matrix = np.floor(SCALE * flat[first[rows][:, None] + np.arange(dim)])
                some = kept.setdefault(int(dim), ([], []))
                some[0].append(ids[rows])
                some[1].append(matrix)
                n_kept += len(rows)
                held = sum(map(len, some[0]))
                if held >= rows_most:
                    all_ids, whole = np.concatenate(some[0]), np.concatenate(some[1])
                    full = held // rows_most * rows_most
                    for a in range(0, full, rows_most):
                        yield _packed(int(dim), [all_ids[a:a + rows_most]], [whole[a:a + rows_most]], name)
                        name += 1
                    kept[int(dim)] = ([all_ids[full:]], [whole[full:].copy()])
                    n_kept -= full
            if n_kept >= 2 * rows_most:                      # many lengths
                for dim, (some_ids, some) in kept.items():
                    if sum(map(len, some_ids)):
                        yield _packed(dim, some_ids, some, name)
                        name += 1
                kept, n_kept = {}, 0
        for dim, (some_ids, some) in kept.items():
            if sum(map(len, some_ids)):
                yield _packed(dim, some_ids, some, name)
                name += 1
    return run


_PACKED = "name long, dim int, kind string, ids binary, matrix binary"


def _unpacked(rows: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and one matrix of packed rows, in order of id."""
    ids = [np.frombuffer(x, "<i8") for x in rows.column("ids").to_pylist()]
    kinds = rows.column("kind").to_pylist()
    parts = [np.frombuffer(x, kind).reshape(len(i), dim) for x, kind, i in zip(rows.column("matrix").to_pylist(), kinds, ids, strict=True)]
    every = np.concatenate(ids)
    order = np.argsort(every, kind="stable")
    return every[order], np.concatenate(parts)[order]


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products beyond doubles, as 64-bit integers that wrap."""
    to_int = np.vectorize(int, otypes=[object])
    exact = to_int(q) @ to_int(c).T
    return np.array([[((int(x) + (1 << 63)) & MASK64) - (1 << 63) for x in row] for row in exact], np.int64).reshape(exact.shape)


class _Best:
    """The best k candidates so far of some queries, from tiles whose candidates come in order of id."""

    def __init__(self, qi: np.ndarray, k: int, kind: type):
        self.qi, self.k = qi, k
        self.row, self.id, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, kind)
        self.full, self.least = np.zeros(len(qi), bool), np.zeros(len(qi), kind)     # which have k, and the last of these

    def add(self, ci: np.ndarray, score: np.ndarray) -> None:
        k, low = self.k, -np.inf if score.dtype.kind == "f" else np.iinfo(np.int64).min
        lo, hi = np.searchsorted(ci, self.qi), np.searchsorted(ci, self.qi, "right")
        own = np.flatnonzero(hi > lo)
        for r in own:
            score[r, lo[r]:hi[r]] = low
        hit = score > self.least[:, None]
        new = np.flatnonzero(~self.full)
        if len(new):
            hit[new] = True if score.shape[1] <= k else score[new] >= np.partition(score[new], score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
        for r in own:
            hit[r, lo[r]:hi[r]] = False
        row, col = np.nonzero(hit)
        if not len(row):
            return
        row, found, score = np.concatenate([self.row, row]), np.concatenate([self.id, ci[col]]), np.concatenate([self.score, score[row, col]])
        order = np.lexsort((found, -score, row)) if score.dtype.kind == "f" else np.lexsort((found, ~score, row))
        row, found, score = row[order], found[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = row[place == k - 1]
        self.full[last], self.least[last] = True, score[place == k - 1]
        self.row, self.id, self.score = row[place < k], found[place < k], score[place < k]


def _score(k: int):
    """The best k of a cell's candidates for each of its queries."""
    def run(key: tuple, blocks: pa.Table, shards: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]]
        if blocks.num_rows and shards.num_rows:
            dim = key[0].as_py()
            (qi, q), (ci, c) = _unpacked(blocks, dim), _unpacked(shards, dim)
            in_doubles = float(np.abs(q, dtype=np.float64).max(initial=0)) * float(np.abs(c, dtype=np.float64).max(initial=0)) * max(1, dim) < 2.0 ** 53
            for a in range(0, len(qi), TILE[0]):
                some = q[a:a + TILE[0]].astype(np.float64)
                best = _Best(qi[a:a + TILE[0]], k, np.float64 if in_doubles else np.int64)
                for b in range(0, len(ci), TILE[1]):
                    tile = c[b:b + TILE[1]].astype(np.float64)
                    best.add(ci[b:b + TILE[1]], some @ tile.T if in_doubles else _exact(some, tile))
                for x, y in zip(out, (best.qi[best.row], best.id, best.score.astype(np.int64)), strict=True):
                    x.append(y)
        made = [np.concatenate(x) for x in out]
        return pa.table([*map(pa.array, made), pa.array(np.full(len(made[0]), key[1].as_py(), np.int64))], ["query_id", "vec_id", "score", "slot"])
    return run


def topk(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The ``k`` best candidates of each query (all, if fewer).

    Takes ``vec_id long, embedding array<float or double>`` and a condition
    that marks the queries; every row is a candidate. Other columns are not
    looked at. Returns query_id, rank (from 1), vec_id, score.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = (vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("__query"))
            .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole))
    queries = rows.where("__query")
    n_rows, n_queries, width = rows.agg(F.count(F.lit(1)), F.count_if("__query"), F.max(F.size("embedding"))).first()
    n_shards, n_blocks = max(1, -(-n_rows // SHARD_ROWS)), max(1, -(-n_queries // BLOCK_ROWS))
    longer = -(-max(width or 0, WIDTH) // WIDTH)
    lanes = -(-n_blocks // max(1, LANE_BLOCKS // longer))
    slots = min(n_shards, max(-(-CELLS // lanes), -(-n_shards // max(1, SLOT_SHARDS // longer))))
    cell = ["dim", "slot", "lane"]

    def dealt(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    shards = rows.select("vec_id", "embedding").mapInArrow(_pack(SHARD_ROWS), _PACKED)
    shards = shards.select("dim", dealt("name", slots).alias("slot"), every(lanes).alias("lane"), "kind", "ids", "matrix")
    blocks = queries.select("vec_id", "embedding").repartition(n_blocks).mapInArrow(_pack(BLOCK_ROWS), _PACKED)
    blocks = blocks.select("dim", every(slots).alias("slot"), dealt("name", lanes).alias("lane"), "kind", "ids", "matrix")
    # As many tasks as cells: their work is in the products, of which the sizes of partitions say little.
    blocks, shards = (x.repartition(slots * lanes, *cell).groupBy(*cell) for x in (blocks, shards))
    best = blocks.cogroup(shards).applyInArrow(_score(k), "query_id long, vec_id long, score long, slot long")

    order = [F.desc("score"), "vec_id"]
    width = slots
    while width > MERGE:
        width = -(-width // MERGE)
        best = (best.withColumn("slot", F.pmod("slot", F.lit(width)))
                .withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "slot").orderBy(*order))).where(F.col("rank") <= k).drop("rank"))
    return (best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
