"""Classification metrics from 16 counts per slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.columns import is_severe, ratio
from ..functions.position import with_running_sum
from ..session import small_side
from . import decide, nested, ranking

K = range(C.NUM_CLASSES)
CELLS = [(i, j) for i in K for j in K]


def _cell(i: int, j: int) -> Column:
    return F.col(f"n{i}{j}")


def confusion_wide(df: DataFrame, label: str = "LABEL", pred: str = "PRED",
                   by: list[str] | None = None, extra: tuple = ()) -> DataFrame:
    """All 16 cells per slice in one aggregation (map-side combined)."""
    counts = [F.count_if((F.col(label) == i) & (F.col(pred) == j)).alias(f"n{i}{j}")
              for i, j in CELLS]
    return df.groupBy(*(by or [])).agg(*counts, *extra)


def confusion(df: DataFrame, label: str = "LABEL", pred: str = "PRED",
              by: list[str] | None = None) -> DataFrame:
    """(true_class, pred_class, n): every cell is present."""
    wide = confusion_wide(df, label, pred, by)
    cells = F.array(*[F.struct(F.lit(i).alias("true_class"), F.lit(j).alias("pred_class"),
                               _cell(i, j).alias("n")) for i, j in CELLS])
    return wide.select(*(by or []), F.inline(cells))


def _sum(cols) -> Column:
    total = None
    for c in cols:
        total = c if total is None else total + c
    return total


def metric_columns(cost_matrix=C.COST_MATRIX) -> dict[str, Column]:
    """Metrics as arithmetic on the 16 cells."""
    n = _sum(_cell(i, j) for i, j in CELLS)
    row = [_sum(_cell(i, j) for j in K) for i in K]
    col = [_sum(_cell(i, j) for i in K) for j in K]
    f1 = [F.coalesce(ratio(2 * _cell(k, k), row[k] + col[k]), F.lit(0.0)) for k in K]
    recall = [F.coalesce(ratio(_cell(k, k), row[k]), F.lit(0.0)) for k in K]
    seen = _sum(F.when(row[k] + col[k] > 0, 1).otherwise(0) for k in K)
    observed = _sum(_cell(i, j) * float((i - j) ** 2) for i, j in CELLS)
    expected = _sum(row[i].cast("double") * col[j] * float((i - j) ** 2) for i, j in CELLS)
    out = {
        "n": n,
        "macro_f1": _sum(f1) / float(C.NUM_CLASSES),
        "qwk": F.when(seen >= 2, 1 - ratio(observed * n, expected)),
        "accuracy": ratio(_sum(_cell(k, k) for k in K), n),
    }
    out.update({f"recall_class_{k}": recall[k] for k in K})
    out["avg_cost"] = ratio(_sum(_cell(i, j) * float(cost_matrix[i][j]) for i, j in CELLS), n)
    return out


def brier_row(probs: list[str], label: str = "LABEL") -> Column:
    """Squared error of one row, averaged over classes."""
    parts = [F.pow(F.col(p) - F.when(F.col(label) == k, 1.0).otherwise(0.0), F.lit(2.0))
             for k, p in enumerate(probs)]
    return _sum(parts) / float(len(probs))


def classification_metrics(df: DataFrame, label: str = "LABEL", pred: str = "PRED",
                           probs: list[str] | None = None, by: list[str] | None = None,
                           cost_matrix=C.COST_MATRIX) -> DataFrame:
    """One row of metrics per slice: macro-F1 over all classes, kappa (NULL when
    nothing varies), accuracy, recalls, average cost and, given probabilities, Brier."""
    extra = (F.avg(brier_row(probs, label)).alias("brier_score"),) if probs else ()
    wide = confusion_wide(df, label, pred, by, extra)
    cols = [c.alias(k) for k, c in metric_columns(cost_matrix).items()]
    return wide.select(*(by or []), *cols, *(["brier_score"] if probs else []))


def to_long(df: DataFrame, block: str, slice_col: Column | None = None,
            skip: tuple = (), of: Column | None = None) -> DataFrame:
    """(block, slice, metric, value) rows of a wide metric frame; ``of`` names each row's block."""
    names = [c for c in df.columns if c not in skip]
    sl = F.lit("all") if slice_col is None else slice_col.cast("string")
    entries = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                        for c in names])
    return df.select((F.lit(block) if of is None else of).alias("block"), sl.alias("slice"), F.inline(entries))


def full_evaluation(df: DataFrame, ledger: DataFrame | None = None,
                    raw: list[str] = decide.RAW, calibrated: list[str] | None = None,
                    cost_matrix=C.COST_MATRIX, n_loans: str | None = None,
                    exposure: str | None = None, ties=ranking.TIES) -> DataFrame:
    """Every metric block of one scored test set in long form, at either grain.

    raw argmax; argmax and cost rule on calibrated, masked probabilities; cost
    rule per category; ranking pooled, for single-loan customers, per exposure
    decile and per label vintage (if the rows hold several), and each of
    these by category. All ranking blocks come from one sorted pass.
    """
    df = decide.with_monotone_mask(df, probs=calibrated or raw)
    m = [F.col(c) for c in decide.MASKED]
    df = df.withColumns({
        "__raw": decide.first_max([F.col(c) for c in raw]),
        "__cal": decide.first_max(m),
        "__cost": decide.cost_decision(m, cost_matrix),
        "__sev": m[-1],
    })
    cat = ["CURRENT_CAT"]
    parts = [
        to_long(classification_metrics(df, pred="__raw", probs=raw), "argmax_raw"),
        to_long(classification_metrics(df, pred="__cal", probs=decide.MASKED), "argmax_cal"),
        to_long(classification_metrics(df, pred="__cost", probs=decide.MASKED), "cost_rule"),
        to_long(classification_metrics(df, pred="__cost", probs=decide.MASKED, by=cat),
                "cost_rule_by_category", F.col("CURRENT_CAT"), tuple(cat)),
        ranking_blocks(ranking.ranked_population(df), ledger, "__sev", n_loans, exposure, ties),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ranking_blocks(queue: DataFrame, ledger: DataFrame | None = None, score: str = "SCORE", n_loans: str | None = None,
                   exposure: str | None = None, ties=ranking.TIES) -> DataFrame:
    """All ranking blocks of the ranked population in long form (block, slice, metric, value)."""
    blocks = {"ranking": F.lit(nested.ALL)}
    if n_loans:
        blocks["ranking_single_loan"] = F.when(F.col(n_loans) == 1, F.lit(nested.ALL))
    if exposure:
        queue = ranking.with_exposure_decile(queue, exposure, ties=ties, keep=True)
        blocks["ranking_by_exposure"] = F.col("DECILE")
    if ledger is not None:
        queue = queue.join(small_side(ledger.select("SNAPSHOT_DATE", F.col("STATUS").alias("__status"))), "SNAPSHOT_DATE", "left")
        blocks["ranking_by_label_status"] = F.col("__status")
    wide = nested.nested_ranking(queue, blocks, score, ties=ties, exposure=exposure)
    long = to_long(wide, "", F.col("slice"), ("block", "slice", "exposure_min", "exposure_max"), of=F.col("block"))
    if exposure:
        edges = wide.where("block = 'ranking_by_exposure'").select("block", "slice", "exposure_min", "exposure_max")
        long = long.unionByName(to_long(edges, "", F.col("slice"), ("block", "slice"), of=F.col("block")))
    if ledger is not None:
        if wide.where("block = 'ranking_by_label_status'").count() < 2:            # slices, not rows
            long = long.where(~F.col("block").startswith("ranking_by_label_status"))
    return long


def bootstrap_intervals(df: DataFrame, label: str = "LABEL", pred: str = "PRED",
                        draws: int = 500, alpha: float = 0.05, seed: int = C.SEED) -> DataFrame:
    """Mean and interval of macro-F1, kappa and the recalls of classes 2 and 3.

    Each metric is a function of the 16 cells, so resampling rows with
    replacement is the same as one multinomial draw over the cells: the work
    per draw does not depend on the number of rows.
    """
    spark = df.sparkSession
    row = confusion_wide(df, label, pred).first()
    cells = [int(row[f"n{i}{j}"]) for i, j in CELLS]

    def draw(batches):
        import numpy as np
        import pandas as pd
        k = C.NUM_CLASSES
        total = sum(cells)
        p = np.array(cells, dtype=float) / total
        w = np.array([[(i - j) ** 2 for j in range(k)] for i in range(k)], dtype=float)
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                cm = np.random.default_rng([seed, int(i)]).multinomial(total, p).reshape(k, k)
                r, c, tp = cm.sum(1), cm.sum(0), np.diag(cm)
                seen = (r + c) > 0                       # labels that occur in the draw
                f1 = np.where(r + c > 0, 2 * tp / np.maximum(r + c, 1), 0.0)
                exp = (w * np.outer(r, c)).sum() / total
                rec = np.where(r > 0, tp / np.maximum(r, 1), 0.0)
                out.append((int(i), float(f1[seen].mean()),
                            float(1 - (w * cm).sum() / exp) if exp > 0 else None,
                            float(rec[2]), float(rec[3])))
            yield pd.DataFrame(out, columns=["id", "macro_f1", "qwk", "recall_class_2", "recall_class_3"])

    schema = T.StructType([T.StructField("id", T.LongType())] + [
        T.StructField(c, T.DoubleType()) for c in
        ("macro_f1", "qwk", "recall_class_2", "recall_class_3")])
    drawn = spark.range(draws).mapInPandas(draw, schema)
    long = drawn.unpivot("id", ["macro_f1", "qwk", "recall_class_2", "recall_class_3"],
                         "metric", "value")
    return long.groupBy("metric").agg(           # one value per draw
        F.avg("value").alias("mean"),
        F.percentile("value", F.lit(alpha / 2)).alias("lower_ci"),
        F.percentile("value", F.lit(1 - alpha / 2)).alias("upper_ci"))


def one_vs_rest(df: DataFrame, probs: list[str], label: str = "LABEL") -> DataFrame:
    """(class, score, hit) rows, one per row and class."""
    entries = F.array(*[F.struct(F.lit(k).alias("class"), F.col(p).cast("double").alias("score"),
                                 F.when(F.col(label) == k, 1).otherwise(0).alias("hit"))
                        for k, p in enumerate(probs)])
    return df.select(F.inline(entries))


def _score_groups(long: DataFrame, by: list[str], score: str, hit: str, descending: bool):
    groups = long.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("threshold")).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.col(hit).cast("bigint")).alias("__pos"))
    order = F.col("threshold").desc() if descending else F.col("threshold").asc()
    return with_running_sum(groups, [order], {"__cn": "__n", "__cpos": "__pos"}, within=by)


def roc_points(long: DataFrame, by: list[str] = ("class",), score: str = "score",
               hit: str = "hit") -> DataFrame:
    """ROC curve at every distinct score, highest first: threshold, fpr, tpr."""
    by = list(by)
    run = _score_groups(long, by, score, hit, True)
    total = run.groupBy(*by).agg(F.sum("__n").alias("__tn"), F.sum("__pos").alias("__tp"))
    total = total.select(*[F.col(c).alias(f"__k_{c}") for c in by], "__tn", "__tp")
    on = None
    for c in by:
        cond = F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        on = cond if on is None else on & cond
    return run.join(total, on).select(
        *by, "threshold", ratio(F.col("__cn") - F.col("__cpos"), F.col("__tn") - F.col("__tp")).alias("fpr"),
        ratio(F.col("__cpos"), F.col("__tp")).alias("tpr"))


def auc(long: DataFrame, by: list[str] = ("class",), score: str = "score",
        hit: str = "hit") -> DataFrame:
    """Area under the ROC curve per group, ties counted half, from one row per
    distinct score. Also n and n_pos."""
    by = list(by)
    run = _score_groups(long, by, score, hit, False)
    neg = F.col("__n") - F.col("__pos")
    below = F.col("__cn") - F.col("__cpos") - neg
    wins = F.sum(F.col("__pos") * (below + neg / 2.0))
    n, pos = F.sum("__n"), F.sum("__pos")
    return run.groupBy(*by).agg(
        n.alias("n"), pos.alias("n_pos"),
        ratio(wins, pos.cast("double") * (n - pos)).alias("auc"))


def fold_summary(per_fold: DataFrame) -> DataFrame:
    """(fold, metric, value) rows to mean, population std, min, max and count."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return per_fold.groupBy("metric").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"), F.count(v).alias("n"))


def severe_hits(df: DataFrame, label: str = "LABEL") -> DataFrame:
    return df.withColumn("SEV", is_severe(F.col(label)))
