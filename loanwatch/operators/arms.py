"""Model arms: four ways to get P(severe) from boosted trees.

MLlib boosts binary targets only, so a class distribution is built from binary
models: one-vs-rest and renormalised (multiclass), cumulative and differenced
(ordinal), or one model family per current category (per_cat).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..session import keep, scratch_root
from . import boosting
from .boosting import features_per_node, fit_trees
from .decide import RAW
from .ranking import average_precision, ranked_population

_VEC = "__features"
#: From here on MLlib's sub-models are fitted one after the other.
MANY_ROWS = 2_000_000
#: More rows are fitted from binned rows (``boosting``), whose memory and disk MLlib's objects pass many times over.
BINNED_ROWS = 2_000_000


def class_weights(df: DataFrame, label: str = "LABEL", cost_matrix=None) -> DataFrame:
    """(label, weight): inverse class frequency, optionally times the class's
    row sum of the cost matrix. One row per observed class."""
    from pyspark.sql import Window
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))                         # at most one row per class
    w = F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))
    if cost_matrix is not None:
        cost = F.element_at(F.array(*[F.lit(float(sum(r))) for r in cost_matrix]),
                            (F.col(label) + 1).cast("int"))
        w = w * cost
    return counts.select(label, w.alias("weight"))


def ordinal_distribution(cum: list[Column]) -> list[Column]:
    """P(y>0), P(y>1), ... to class probabilities: running minimum (separate
    models can cross), differences, floor 1e-9, renormalised."""
    mono = [cum[0]]
    for c in cum[1:]:
        mono.append(F.least(mono[-1], c))
    raw = [1 - mono[0]] + [a - b for a, b in zip(mono, mono[1:])] + [mono[-1]]
    return _normalised([F.greatest(r, F.lit(1e-9)) for r in raw])


def _normalised(cols: list[Column]) -> list[Column]:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return [c / total for c in cols]


@dataclass
class Arm:
    """A fitted arm. ``models`` maps a sub-model name to a tree model, or to a
    constant where the training rows held one outcome only."""

    kind: str
    features: list[str]
    models: dict[str, GBTClassificationModel | float] = field(default_factory=dict)
    strata: dict[int, list[int]] = field(default_factory=dict)   # per_cat: classes seen

    def _probability(self, df: DataFrame, name: str) -> DataFrame:
        """Add column ``__q_<name>`` = P(target) of one sub-model."""
        m = self.models[name]
        if isinstance(m, float):
            return df.withColumn(f"__q_{name}", F.lit(m))
        cols = {p: f"__{p}_{name}" for p in ("raw", "prob", "pred")}
        m = m.copy()
        m.setFeaturesCol(_VEC).setRawPredictionCol(cols["raw"])
        m.setProbabilityCol(cols["prob"]).setPredictionCol(cols["pred"])
        return m.transform(df).withColumn(
            f"__q_{name}", vector_to_array(cols["prob"])[1]).drop(*cols.values())

    def predict(self, df: DataFrame, cat: str = "CURRENT_CAT") -> DataFrame:
        """Add p0..p3 (the binary arm: p0 = not severe, p3 = severe)."""
        df = _assemble(df, self.features)
        for name in self.models:
            df = self._probability(df, name)
        q = {n: F.col(f"__q_{n}") for n in self.models}
        if self.kind == "multiclass":
            probs = _normalised([F.greatest(q[f"y{k}"], F.lit(1e-9)) for k in range(C.NUM_CLASSES)])
        elif self.kind == "binary":
            p = q["severe"]
            probs = [1 - p, F.lit(0.0), F.lit(0.0), p]
        elif self.kind == "ordinal":
            probs = ordinal_distribution([q[f"gt{k}"] for k in range(C.NUM_CLASSES - 1)])
        else:
            probs = self._per_category(q, F.col(cat))
        return df.withColumns(dict(zip(RAW, probs))).drop(_VEC, *[f"__q_{n}" for n in self.models])

    def _per_category(self, q: dict[str, Column], cat: Column) -> list[Column]:
        """A category's models spread over its reachable classes; a category
        without a model puts all mass on itself."""
        out = []
        for k in range(C.NUM_CLASSES):
            col = F.when(F.least(cat, F.lit(C.SEVERE)) == k, 1.0).otherwise(0.0)
            for c, seen in self.strata.items():
                if len(seen) == 2:
                    p = q[f"c{c}_y{seen[1]}"]
                    mass = {seen[0]: 1 - p, seen[1]: p}
                else:
                    parts = _normalised([F.greatest(q[f"c{c}_y{y}"], F.lit(1e-9)) for y in seen])
                    mass = dict(zip(seen, parts))
                col = F.when(cat == c, mass.get(k, F.lit(0.0))).otherwise(col)
            out.append(col)
        return out


def _assemble(df: DataFrame, features: list[str]) -> DataFrame:
    cols = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]
    return VectorAssembler(inputCols=features, outputCol=_VEC).transform(
        df.select(*[c for c in df.columns if c not in features], *cols))


def _trees(params: dict, seed: int) -> GBTClassifier:
    p = {**C.TREE_DEFAULTS, **params}
    return GBTClassifier(featuresCol=_VEC, labelCol="__y", weightCol="__w", maxIter=p["n_trees"],
                         maxDepth=p["max_depth"], stepSize=p["learning_rate"],
                         subsamplingRate=p["subsample"], featureSubsetStrategy=str(p["colsample"]),
                         minInstancesPerNode=p.get("min_child_rows", 1), seed=seed)


def fit_arm(kind: str, df: DataFrame, features: list[str], params: dict | None = None,
            label: str = "LABEL", cat: str = "CURRENT_CAT", cost_matrix=None,
            seed: int = C.SEED, parallelism: int = 4, partitions: int | None = None) -> Arm:
    """Fit one arm. Sub-models are independent Spark jobs over one kept frame,
    a few of them submitted at a time (as OneVsRest does). Of more than
    ``MANY_ROWS`` rows one at a time: a fit keeps its own binned copy of the rows in
    memory, and one fit keeps all cores busy. More than ``BINNED_ROWS`` rows are fitted by
    ``boosting``, all sub-models in the same passes.

    MLlib's boosting samples by partition, so the frame gets a layout that depends on
    its rows alone: dealt by content to ``partitions`` (the session's shuffle
    partitions by default) and sorted there. Permuted input gives equal trees.
    """
    if kind not in C.ARMS:
        raise ValueError(f"unknown arm {kind!r}")
    scratch_root(df.sparkSession)                 # where boosting cuts its lineage
    chosen = {**C.TREE_DEFAULTS, **(params or {})}
    counts = {(r["__cat"], r["__label"]): r["n"] for r in df.groupBy(F.col(cat).alias("__cat"), F.col(label).alias("__label")).agg(
        F.count(F.lit(1)).alias("n")).collect()}                 # categories x classes
    arm = Arm(kind, list(features))
    jobs = _plan(arm, counts, cost_matrix)
    if sum(counts.values()) > BINNED_ROWS and features_per_node(chosen["colsample"], len(features)):
        arm.models.update(fit_trees(df, features, F.col(label), F.col(cat), counts, jobs, chosen, seed))
        arm.models = dict(sorted(arm.models.items()))
        return arm
    narrow = df.select(label, cat, *features)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = narrow.repartition(n, F.xxhash64(*narrow.columns)).sortWithinPartitions(*narrow.columns)
    rows = keep(_assemble(narrow, features).select(
        F.col(label).alias("__label"), F.col(cat).alias("__cat"), _VEC))
    try:
        def run(job):
            name, where, hit, weight = job
            part = rows if where is None else rows.where(where)
            data = part.select(_VEC, hit.cast("double").alias("__y"), weight.cast("double").alias("__w"))
            return name, _trees(params or {}, seed).fit(data)
        at_once = parallelism if sum(counts.values()) <= MANY_ROWS else 1
        with ThreadPool(min(at_once, max(len(jobs), 1))) as pool:
            arm.models.update(pool.map(run, jobs))
        arm.models = dict(sorted(arm.models.items()))
        return arm
    finally:
        rows.unpersist()


def _plan(arm: Arm, counts: dict, cost_matrix) -> list:
    """The binary fits an arm needs: (name, row filter, target, weight)."""
    y = F.col("__label")
    total = sum(counts.values())

    def n_where(test):
        return sum(n for (c, k), n in counts.items() if test(c, k))
    jobs = []

    def add(name, where, hit, pos, size, weight):
        if pos in (0, size):
            arm.models[name] = float(pos > 0)
        else:
            jobs.append((name, where, hit, weight))

    if arm.kind == "multiclass":
        seen = sorted({k for _, k in counts})
        weight = F.lit(1.0)
        for k in seen:
            w = total / (len(seen) * n_where(lambda c, j, k=k: j == k))
            if cost_matrix is not None:
                w *= sum(cost_matrix[k])
            weight = F.when(y == k, w).otherwise(weight)
        for k in range(C.NUM_CLASSES):
            add(f"y{k}", None, y == k, n_where(lambda c, j, k=k: j == k), total, weight)
    elif arm.kind in ("binary", "ordinal"):
        targets = {"severe": C.SEVERE - 1} if arm.kind == "binary" else {
            f"gt{k}": k for k in range(C.NUM_CLASSES - 1)}
        for name, k in targets.items():
            pos = n_where(lambda c, j, k=k: j > k)
            balance = F.when(y > k, (total - pos) / max(pos, 1)).otherwise(1.0)
            add(name, None, y > k, pos, total, balance)
    else:
        for c in range(C.NUM_CLASSES - 1):
            # Labels below the category cannot happen; they count as the category.
            floor = F.greatest(y, F.lit(c))
            seen = sorted({max(k, c) for (cc, k) in counts if cc == c})
            if len(seen) < 2:
                continue                                          # point mass on the category
            arm.strata[c] = seen
            size = n_where(lambda cc, k, c=c: cc == c)
            for k in (seen[1:] if len(seen) == 2 else seen):
                pos = n_where(lambda cc, j, c=c, k=k: cc == c and max(j, c) == k)
                add(f"c{c}_y{k}", F.col("__cat") == c, floor == k, pos, size, F.lit(1.0))
    return jobs


def ranked_severe_ap(scored: DataFrame, score: str = "p3", label: str = "LABEL") -> float | None:
    """AP of P(severe) over the rows the queue ranks; None without a severe row."""
    q = ranked_population(scored)
    q = q.withColumn("SEV", F.when(F.col(label) == C.SEVERE, 1).otherwise(0))
    return average_precision(q, score=score).first()["pr_auc"]


# Ranges the search draws from: trees 200-900, depth 3-8, rate 0.01-0.3,
# subsample 0.6-1, colsample 0.5-1.
DEFAULT_GRID = {"n_trees": [200, 500, 900], "max_depth": [3, 5, 8], "learning_rate": [0.03, 0.1]}


def tune_arm(kind: str, train: DataFrame, val: DataFrame, features: list[str],
             grid: dict[str, list] | None = None, seed: int = C.SEED) -> tuple[dict, DataFrame]:
    """Best parameters by AP on the ranked validation rows, and all trials.

    A validation slice without a ranked severe row is an error.
    """
    grid = grid or DEFAULT_GRID
    slice_ = ranked_population(val).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("LABEL") == C.SEVERE).alias("p")).first()
    if not slice_["n"] or not slice_["p"]:
        raise ValueError(f"cannot tune: the ranked validation slice holds {slice_['n']} row(s) "
                         f"and {slice_['p']} severe event(s)")
    trials = []
    for values in product(*grid.values()):
        params = dict(zip(grid, values))
        arm = fit_arm(kind, train, features, params, seed=seed)
        trials.append((str(params), ranked_severe_ap(arm.predict(val)), params))
    best = max(trials, key=lambda t: (t[1], t[0]))
    spark: SparkSession = train.sparkSession
    return best[2], spark.createDataFrame([(t[0], t[1]) for t in trials], "params string, ap double")
