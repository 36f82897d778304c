"""Ranking metrics at a call budget, on the population that is ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.columns import is_severe, ratio
from ..functions.position import with_position, with_running_sum

TIES = ("LOAN_ID", "SNAPSHOT_DATE")


def ranked_population(df: DataFrame, cat: str = "CURRENT_CAT",
                      carve: int = C.CARVE_CATEGORY) -> DataFrame:
    """Rows that compete for calls: the current category is below the carve."""
    return df.where(F.col(cat) < carve)


def call_order(score: str = "SCORE", ties=TIES) -> list[Column]:
    """Score descending, then the tie keys ascending."""
    return [F.col(score).desc_nulls_last()] + [F.col(t).asc() for t in ties]


def positions(df: DataFrame, by: list[str] | None = None, score: str = "SCORE",
              label: str = "LABEL", ties=TIES, extra: tuple = ()) -> DataFrame:
    """Each row's place in the call order (restarted per slice), slice size N."""
    by = by or []
    cols = dict.fromkeys([*by, score, *ties, *extra])
    narrow = df.select(*cols, is_severe(F.col(label)).cast("bigint").alias("SEV"))
    return with_position(narrow, call_order(score, ties), within=by, name="POS", total="N")


def average_precision(df: DataFrame, by: list[str] | None = None, score: str = "SCORE",
                      sev: str = "SEV") -> DataFrame:
    """AP per slice: sum over distinct scores of recall step times precision.

    Rows are first reduced to one per (slice, score), so ties cost nothing.
    """
    by = by or []
    groups = df.groupBy(*by, F.col(score).alias("__score")).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.col(sev).cast("bigint")).alias("__tp"))
    run = with_running_sum(groups, [F.col("__score").desc_nulls_last()],
                           {"__cn": "__n", "__ctp": "__tp"}, within=by)
    return run.groupBy(*by).agg(
        ratio(F.sum(F.col("__tp") * (F.col("__ctp") / F.col("__cn"))), F.sum("__tp"))
        .alias("pr_auc"))


def ranking_metrics(df: DataFrame, by: list[str] | None = None, score: str = "SCORE",
                    label: str = "LABEL", ties=TIES, windows=None,
                    exposure: str | None = None) -> DataFrame:
    """One row per slice: n_ranked, n_severe, base_rate, pr_auc and, for each
    budget window, k, recall, precision and lift. The order restarts in every
    slice. Slices without a severe row get the counts only."""
    by = by or []
    windows = C.REF_WINDOWS if windows is None else windows
    pos = positions(df, by, score, label, ties, extra=(exposure,) if exposure else ())
    ks = {w: F.least(F.lit(int(C.CALLS_PER_HOUR * h)).cast("bigint"), F.col("N"))
          for w, h in windows.items()}
    aggs = [F.count(F.lit(1)).alias("n_ranked"), F.sum("SEV").alias("n_severe")]
    aggs += [F.sum(F.when(F.col("POS") <= k, F.col("SEV")).otherwise(0)).alias(f"__hit_{w}")
             for w, k in ks.items()]
    if exposure:
        aggs += [F.min(exposure).alias("exposure_min"), F.max(exposure).alias("exposure_max")]
    out = pos.groupBy(*by).agg(*aggs)
    ap = average_precision(pos, by, score)
    out = _join_slices(out, ap, by)
    some = F.col("n_severe") > 0
    base = ratio(F.col("n_severe"), F.col("n_ranked"))
    cols = [*by, "n_ranked", "n_severe", base.alias("base_rate"),
            F.when(some, F.col("pr_auc")).alias("pr_auc")]
    for w, h in windows.items():
        k = F.least(F.lit(int(C.CALLS_PER_HOUR * h)).cast("bigint"), F.col("n_ranked"))
        hit = F.col(f"__hit_{w}")
        cols += [F.when(some, k).alias(f"k_{w}"),
                 F.when(some, ratio(hit, F.col("n_severe"))).alias(f"recall_{w}"),
                 F.when(some, ratio(hit, k)).alias(f"precision_{w}"),
                 F.when(some, ratio(hit, k) / base).alias(f"lift_{w}")]
    if exposure:
        cols += ["exposure_min", "exposure_max"]
    return out.select(*cols)


def _join_slices(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Join two one-row-per-slice frames (a slice key may be NULL)."""
    keys = by or ["__one"]
    if not by:
        left, right = (d.withColumn("__one", F.lit(1)) for d in (left, right))
    right = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                         *[c for c in right.columns if c not in keys])
    on = None
    for k in keys:
        c = left[k].eqNullSafe(right[f"__r_{k}"])
        on = c if on is None else on & c
    out = left.join(right, on, "left").drop(*[f"__r_{k}" for k in keys])
    return out if by else out.drop("__one")


def capture_curve(df: DataFrame, by: list[str] | None = None, n_points: int = 200,
                  score: str = "SCORE", label: str = "LABEL", ties=TIES) -> DataFrame:
    """Cumulative gains at up to ``n_points`` evenly spread list positions."""
    return curve_from_positions(positions(df, by, score, label, ties), by, n_points)


def curve_from_positions(pos: DataFrame, by: list[str] | None = None,
                         n_points: int = 200) -> DataFrame:
    """Curve points from placed rows (POS, N, SEV).

    Point j is position 1 + j*(n-1)/(m-1), rounded down. A row counts from the
    first point at or after it, so one aggregation per point and a running sum
    over at most ``n_points`` rows per slice give the curve.
    """
    by = by or []
    m = F.least(F.lit(n_points).cast("bigint"), F.col("N"))
    step = F.when(F.col("N") > 1, F.col("N") - 1).otherwise(1)
    pos = pos.withColumn("__m", m).withColumn("__step", step)
    point = F.when(F.col("N") == 1, F.lit(0)).otherwise(
        F.expr("((POS - 1) * (__m - 1) + __step - 1) div __step"))
    per = pos.groupBy(*by, point.cast("bigint").alias("point")).agg(
        F.sum("SEV").alias("__s"), F.max("N").alias("N"), F.max("__m").alias("__m"))
    w = Window.partitionBy(*by).orderBy("point")
    all_rows = Window.partitionBy(*by)
    per = per.withColumns({"__hits": F.sum("__s").over(w),
                           "__sev": F.greatest(F.sum("__s").over(all_rows), F.lit(1))})
    k = F.when(F.col("__m") > 1, F.expr("1 + (point * (N - 1)) div (__m - 1)")).otherwise(1)
    return per.select(*by, "point", k.alias("k"), (k / F.col("N")).alias("frac_called"),
                      (F.col("__hits") / F.col("__sev")).alias("recall"),
                      (k / C.CALLS_PER_HOUR).alias("hours"))


def with_exposure_decile(df: DataFrame, exposure: str = C.EXPOSURE_FEATURE, bins: int = 10,
                         ties=TIES, keep: bool = False) -> DataFrame:
    """Decile of the ranked rows by exposure: equal counts, ties split by key.

    Fewer rows than bins have no deciles: they are dropped, or with ``keep`` stay without one.
    """
    out = with_position(df, [F.col(exposure).asc_nulls_last()] + [F.col(t).asc() for t in ties],
                        name="__p", total="__n")
    decile = (F.expr(f"((__p - 1) * {bins}) div __n") + 1).cast("int")
    if keep:
        decile = F.when(F.col("__n") >= bins, decile)
    else:
        out = out.where(F.col("__n") >= bins)
    return out.withColumn("DECILE", decile).drop("__p", "__n")


def exposure_decile_metrics(df: DataFrame, exposure: str = C.EXPOSURE_FEATURE, bins: int = 10,
                            **kw) -> DataFrame:
    """The ranking block inside each exposure decile of the ranked rows."""
    return ranking_metrics(with_exposure_decile(ranked_population(df), exposure, bins),
                           by=["DECILE"], exposure=exposure, **kw)
