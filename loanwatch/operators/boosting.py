"""Boosted trees of very many rows, from binned rows that are written once.

The method is MLlib's: split candidates from a sample of some 10,000 rows, at most ``BINS``
bins a feature, trees of least variance on -1 and 1 and then on the negative gradients of the
log loss, rows and features drawn for each tree and node. MLlib keeps each sub-model's rows
as objects with four bytes a bin, next to the vectors and two numbers for each row and
tree, which beyond some millions of rows lie on disk, serialized. Here a row takes a byte a
feature and six more, for all sub-models together, and a pass over them counts the histograms
of one level of all sub-models' trees. Only histograms reach the driver.

Sums are taken in whole numbers below 2**53, and a row is drawn by a hash of its columns, so
neither the order nor the layout of rows changes a tree. Results are MLlib's model class.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dropped_pins, pin

BINS = 32
#: Rows that split candidates are looked for in, as MLlib.
SAMPLE = 10_000
#: Rows of a written block; trees after which the sums of their predictions are written next to the bins.
BLOCK_ROWS, KEEP_TREES = 65_536, 8
#: Bytes of histograms that tasks send to the driver as they are; more are added up by other tasks first.
DIRECT_BYTES = 1 << 24
_EPSILON = 2.0 ** -52


@dataclass
class Node:
    """A node of a tree; ``split`` is the number of its feature and the last bin that goes left."""

    depth: int
    stats: np.ndarray | None = None                         # rows, weight, sums of weighted targets and of their squares
    gain: float = -1.0
    split: tuple[int, int] | None = None
    children: list["Node"] = field(default_factory=list)

    def prediction(self) -> float:
        return float(self.stats[2] / self.stats[1]) if self.stats is not None and self.stats[1] else 0.0


def features_per_node(strategy, n: int) -> int | None:
    """How many features a node draws; None for what only MLlib knows."""
    if isinstance(strategy, int) or str(strategy).isdigit():
        return min(int(strategy), n) if int(strategy) > 0 else None
    try:
        share = float(strategy)
    except ValueError:
        return None
    return int(np.ceil(share * n)) if 0 < share <= 1 else None


def _thresholds(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Split candidates of a feature: all midpoints, or those nearest to equal weights."""
    distinct, at = np.unique(values, return_inverse=True)
    counts = np.bincount(at, weights)
    if len(distinct) - 1 <= most:
        return (distinct[:-1] + distinct[1:]) / 2.0
    stride, found = counts.sum() / (most + 1), []
    now, target = counts[0], stride
    for i in range(1, len(distinct)):
        before, now = now, now + counts[i]
        if abs(before - target) < abs(now - target):
            found.append((distinct[i - 1] + distinct[i]) / 2.0)
            target += stride
    return np.array(found[:most])


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Numbers of [0, 1) for each row and salt."""
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt % (1 << 64)) * np.uint64(0xD1342543DE82EF95)
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53


def _reached(root: Node, bins: np.ndarray) -> tuple[np.ndarray, list[Node]]:
    """The leaf each row comes to, as its number, and the leaves."""
    at, leaves = np.zeros(bins.shape[1], np.int32), []

    def walk(node: Node, rows: np.ndarray) -> None:
        if node.split is None:
            at[rows] = len(leaves)
            leaves.append(node)
            return
        left = bins[node.split[0]][rows] <= node.split[1]
        walk(node.children[0], rows[left])
        walk(node.children[1], rows[~left])
    walk(root, np.arange(bins.shape[1]))
    return at, leaves


@dataclass
class _Fit:
    """What tasks need to know of the sub-models: bins of thresholds, targets and weights by (category, label), trees so far."""

    edges: list[list[np.ndarray]]            # by sub-model and feature
    weight: np.ndarray                       # by sub-model and code; 0: not a row of it
    target: np.ndarray
    rate: float                              # of learning
    share: float                             # of rows in a tree
    seed: int
    trees: list[list[Node]]                  # by sub-model; the last one grows
    written: int = 0                         # trees whose predictions are written
    grids: list[int] = field(default_factory=list)       # the set of bins of each sub-model
    scale: list[tuple[float, float, float]] = field(default_factory=list)

    def margin(self, j: int, bins: np.ndarray, start: np.ndarray, upto: int) -> np.ndarray:
        out = start
        for m in range(self.written, upto):
            at, leaves = _reached(self.trees[j][m], bins)
            out = out + (1.0 if m == 0 else self.rate) * np.array([x.prediction() for x in leaves])[at]
        return out


def _open(root: Node) -> list[Node]:
    """Leaves of a tree that are not decided yet, from left to right."""
    if root.split is not None:
        return [x for c in root.children for x in _open(c)]
    return [root] if root.gain == -1.0 else []


def _blocks(batches: Iterator[pa.RecordBatch], n_features: int) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            n = row["n"]
            bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, n_features, n)
            code, draw = np.frombuffer(row["code"], np.uint16), np.frombuffer(row["draw"], np.uint32)
            margins = None if row["margins"] is None else np.frombuffer(row["margins"], np.float64).reshape(-1, n)
            yield row, n, bins, code, draw, margins


_BLOCK = "n int, bins binary, code binary, draw binary, margins binary"


def _pack(edges: list[list[np.ndarray]]):
    """Rows code, draw and features as blocks: bins by set of thresholds, feature and row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0

        def block(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            columns = [c.to_numpy() for c in table.columns]
            bins = np.stack([np.searchsorted(e, v, "left").astype(np.uint8) for some in edges for e, v in zip(some, columns[2:], strict=True)])
            return pa.RecordBatch.from_arrays(
                [pa.array([len(columns[0])], pa.int32()), pa.array([bins.tobytes()], pa.binary()), pa.array([columns[0].astype(np.uint16).tobytes()], pa.binary()),
                 pa.array([columns[1].astype(np.uint32).tobytes()], pa.binary()), pa.array([None], pa.binary())], ["n", "bins", "code", "draw", "margins"])
        for batch in batches:
            kept.append(batch)
            held += batch.num_rows
            if held >= BLOCK_ROWS:
                yield block(kept)
                kept, held = [], 0
        if held:
            yield block(kept)
    return run


def _histograms(fit: _Fit, n_features: int):
    """Each task's sums for the open nodes of the growing trees, as one row of whole numbers in doubles."""
    fronts = [_open(t[-1]) for t in fit.trees]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((4, len(front), n_features, BINS)) for front in fronts]
        for _, n, every, code, draw, margins in _blocks(batches, n_features):
            m = len(fit.trees[0]) - 1
            drawn = np.ones(n, bool) if fit.share >= 1 else _mixed(draw, fit.seed + m) < fit.share
            for j, front in enumerate(fronts):
                if not front:
                    continue
                w = fit.weight[j][code]
                rows = np.flatnonzero(drawn & (w > 0))
                bins, w, y = every[fit.grids[j]][:, rows], w[rows], fit.target[j][code[rows]]
                if m:
                    margin = fit.margin(j, bins, 0.0 if margins is None else margins[j][rows], m)
                    y = 4.0 * y / (1.0 + np.exp(np.minimum(2.0 * y * margin, 700.0)))
                at, leaves = _reached(fit.trees[j][-1], bins)
                place = {id(x): i for i, x in enumerate(front)}
                node = np.array([place.get(id(x), -1) for x in leaves])[at]
                if (node < 0).any():
                    on = node >= 0
                    bins, w, y, node = bins[:, on], w[on], y[on], node[on]
                by_w, by_y, by_yy = fit.scale[j]
                sums = [np.rint(w * by_w), np.rint(w * y * by_y), np.rint(w * y * y * by_yy)]
                start, size = node * BINS, len(front) * BINS
                for f in range(n_features):
                    key = start + bins[f]
                    total[j][0, :, f] += np.bincount(key, minlength=size).reshape(-1, BINS)
                    for s, x in enumerate(sums, 1):
                        total[j][s, :, f] += np.bincount(key, x, size).reshape(-1, BINS)
        yield _one(np.concatenate([x.ravel() for x in total]))
    return run


def _one(sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column("sums"):
            part = np.frombuffer(x.as_py())
            total = part if total is None else total + part     # whole numbers: in any order
    if total is not None:
        yield _one(total)


def _kept(fit: _Fit, n_features: int):
    """Blocks with the sums of all predictions so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, n, every, _, _, margins in _blocks(batches, n_features):
            now = np.stack([fit.margin(j, every[fit.grids[j]], np.zeros(n) if margins is None else margins[j], len(fit.trees[j])) for j in range(len(fit.trees))])
            yield pa.RecordBatch.from_pylist([row | {"margins": now.tobytes()}], pa.schema([("n", pa.int32())] + [(c, pa.binary()) for c in ("bins", "code", "draw", "margins")]))
    return run


def _summed(blocks: DataFrame, fit: _Fit, n_features: int) -> list[np.ndarray]:
    sizes = [4 * len(_open(t[-1])) * n_features * BINS for t in fit.trees]
    parts = blocks.mapInArrow(_histograms(fit, n_features), "sums binary")
    if sum(sizes) * 8 * blocks.rdd.getNumPartitions() > DIRECT_BYTES:
        parts = parts.repartition(4).mapInArrow(_added, "sums binary")
    whole = np.zeros(sum(sizes))
    for x in parts.toArrow().column("sums"):
        whole = whole + np.frombuffer(x.as_py())
    out = []
    for j, part in enumerate(np.split(whole, np.cumsum(sizes)[:-1])):
        h = part.reshape(4, -1, n_features, BINS)
        out.append(h / np.array([1.0, *fit.scale[j]])[:, None, None, None])
    return out


def _variance(s: np.ndarray) -> np.ndarray:
    """Of sums (rows, weight, weighted targets, their squares) along the first axis."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(s[1] > 0, np.maximum(s[3] - s[2] * s[2] / s[1], 0.0) / s[1], 0.0)


def _decide(node: Node, h: np.ndarray, n_edges: list[int], some: list[int], least: int, max_depth: int) -> None:
    """Split an open node where that lessens the variance most, or make it a leaf. ``h``: its sums by feature and bin."""
    node.gain, whole = 0.0, h[:, some[0]].sum(axis=1)
    node.stats = whole
    if node.depth >= max_depth or not whole[1] or _variance(whole) < _EPSILON:
        return
    best = (0.0, None, None)
    for f in some:
        if not n_edges[f]:
            continue
        left = np.cumsum(h[:, f], axis=1)[:, :n_edges[f]]
        right = whole[:, None] - left
        gain = _variance(whole) - left[1] / whole[1] * _variance(left) - right[1] / whole[1] * _variance(right)
        gain = np.where((left[0] >= least) & (right[0] >= least), gain, -1.0)
        b = int(np.argmax(gain))
        if gain[b] > best[0]:
            best = (float(gain[b]), (f, b), (left[:, b], right[:, b]))
    if best[1] is None:
        return
    node.gain, node.split = best[0], best[1]
    node.children = [Node(node.depth + 1, s) for s in best[2]]
    for c in node.children:
        if c.depth >= max_depth or _variance(c.stats) < _EPSILON:
            c.gain = 0.0


def _model(spark, trees: list[Node], edges: list[np.ndarray], rate: float) -> GBTClassificationModel:
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    ml = jvm.org.apache.spark.ml

    def node(x: Node):
        numbers = gateway.new_array(jvm.double, 3)
        for i in range(3):
            numbers[i] = float(x.stats[i + 1])
        calc = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(numbers, int(x.stats[0]))
        if x.split is None:
            return ml.tree.LeafNode(x.prediction(), float(_variance(x.stats)), calc)
        split = ml.tree.ContinuousSplit(x.split[0], float(edges[x.split[0]][x.split[1]]))
        return ml.tree.InternalNode(x.prediction(), float(_variance(x.stats)), x.gain, node(x.children[0]), node(x.children[1]), split, calc)
    made = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(jvm.double, len(trees))
    for m, t in enumerate(trees):
        made[m] = ml.regression.DecisionTreeRegressionModel(f"dtr_{uuid.uuid4().hex[:12]}", node(t), len(edges))
        weights[m] = 1.0 if m == 0 else rate
    return GBTClassificationModel(ml.classification.GBTClassificationModel(f"GBTClassifier_{uuid.uuid4().hex[:12]}", made, weights, len(edges), 2))


def fit_trees(df: DataFrame, features: list[str], label: Column, cat: Column, counts: dict, jobs: list, params: dict, seed: int) -> dict[str, GBTClassificationModel]:
    """The boosted model of each job (name, row filter, target, weight) over the columns ``__label`` and ``__cat``.

    ``counts`` has the rows of each (category, label).
    """
    if not jobs:
        return {}
    spark, F_ = df.sparkSession, len(features)
    per_node = features_per_node(params["colsample"], F_)
    codes = sorted(counts, key=repr)
    pairs = spark.createDataFrame([(i, *codes[i]) for i in range(len(codes))], f"i int, __cat {df.select(cat).dtypes[0][1]}, __label {df.select(label).dtypes[0][1]}")
    known = sorted(pairs.select("i", *[F.struct((F.lit(True) if where is None else F.coalesce(where, F.lit(False))).alias("is"), hit.cast("double").alias("y"),
                                                weight.cast("double").alias("w")).alias(f"j{j}") for j, (_, where, hit, weight) in enumerate(jobs)]).collect())
    if any(r[j + 1]["is"] and None in r[j + 1] for r in known for j in range(len(jobs))):
        raise ValueError("a label is missing in the training rows")
    weight = np.array([[r[j + 1]["w"] if r[j + 1]["is"] else 0.0 for r in known] for j in range(len(jobs))])
    target = np.array([[2.0 * r[j + 1]["y"] - 1.0 if r[j + 1]["is"] else 0.0 for r in known] for j in range(len(jobs))])
    rows_of = np.array([counts[c] for c in codes], dtype=np.float64)

    values = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, f in enumerate(features)]
    code = F.lit(None).cast("int")
    for i, (c, y) in enumerate(codes):
        code = F.when(cat.eqNullSafe(F.lit(c)) & label.eqNullSafe(F.lit(y)), i).otherwise(code)
    draw = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]).bitwiseAND(F.lit((1 << 32) - 1))
    rows = df.select(code.alias("code"), draw.alias("draw"), *values)

    # Split candidates: of each set of rows that sub-models share, as many rows as MLlib takes.
    members = [tuple(np.flatnonzero(w > 0)) for w in weight]
    share = {m: min(1.0, SAMPLE / max(rows_of[list(m)].sum(), 1.0)) for m in set(members)}
    cut = F.lit(0)
    for m, s in share.items():
        cut = F.greatest(cut, F.when(F.col("code").isin([int(x) for x in m]), int(s * (1 << 32))).otherwise(0))
    sample = rows.where(F.col("draw") < cut).toArrow()
    at, drawn, columns = sample.column("code").to_numpy(), sample.column("draw").to_numpy(), [sample.column(f"f{i}").to_numpy() for i in range(F_)]
    edges = []
    for j, m in enumerate(members):
        mine = np.isin(at, m) & (drawn < int(share[m] * (1 << 32)))
        edges.append([_thresholds(c[mine], weight[j][at[mine]], BINS - 1) if mine.any() else np.empty(0) for c in columns])
    # Sub-models with the same thresholds share their bins.
    sets, grids = [], []
    for some in edges:
        same = next((i for i, other in enumerate(sets) if all(np.array_equal(a, b) for a, b in zip(some, other, strict=True))), len(sets))
        if same == len(sets):
            sets.append(some)
        grids.append(same)

    n_trees, max_depth, rate = params["n_trees"], params["max_depth"], params["learning_rate"]
    fit = _Fit(edges, weight, target, rate, params["subsample"], seed, [[] for _ in jobs], grids=grids)
    for j in range(len(jobs)):
        mass, most = float((weight[j] * rows_of).sum()), max(float(weight[j].max()), 1.0)
        fit.scale.append(tuple(2.0 ** np.floor(51 - np.log2(max(mass * x, most * x, 1.0))) for x in (1.0, 4.0, 16.0)))
    with dropped_pins(spark):
        blocks = pin(rows.mapInArrow(_pack(sets), _BLOCK))
        for m in range(n_trees):
            for trees in fit.trees:
                trees.append(Node(0))
            while any(_open(t[-1]) for t in fit.trees):
                found = _summed(blocks, fit, F_)
                for j, trees in enumerate(fit.trees):
                    for i, node in enumerate(_open(trees[-1])):
                        draws = np.random.default_rng([abs(seed) + m, j, node.depth, i])
                        some = sorted(draws.permutation(F_)[:per_node].tolist())
                        _decide(node, found[j][:, i], [len(e) for e in edges[j]], some, params.get("min_child_rows", 1), max_depth)
            if (m + 1) % KEEP_TREES == 0 and m + 1 < n_trees:
                blocks = pin(blocks.mapInArrow(_kept(fit, F_), _BLOCK))
                fit.written = m + 1
    return {name: _model(spark, fit.trees[j], edges[j], rate) for j, (name, *_) in enumerate(jobs)}
