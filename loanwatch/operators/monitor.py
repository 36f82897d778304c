"""Monthly outcome monitor: how did the predictions that were made turn out?

All cohorts are handled in one pass keyed by SNAPSHOT_DATE; positions restart
per snapshot, and a snapshot's list may span many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.columns import band_dpd, cap_category, is_severe, ratio, to_date, wilson
from ..functions.position import with_position
from ..functions.quantiles import quantile_columns, quantiles
from ..session import small_side
from . import ranking
from .clean import engine_predictions
from .maturity import with_label_status

SNAP = ["SNAPSHOT_DATE"]
KEY = ["SNAPSHOT_DATE", "LOAN_ID"]


class MonitorError(ValueError):
    """Outcome data contradicts itself."""


# ---- inputs ------------------------------------------------------------------------

def cutoff(asof: int) -> Column:
    """Start of the day after ``asof``: what lies before it existed by then."""
    return (to_date(F.lit(int(asof))) + F.expr("interval 1 day")).cast("timestamp")


def existed_by(df: DataFrame, column: str, asof: int) -> DataFrame:
    return df.where(F.col(column) < cutoff(asof))


def pick_runs(runs: DataFrame) -> DataFrame:
    """Newest usable run per snapshot and how many were usable. Reduced by one
    aggregation; equal dates are decided by the run id."""
    usable = runs.where(F.col("OPERATION_STATUS").isin(*C.USABLE_RUN_STATUSES)
                        & F.col("SNAPSHOT_DATE").isNotNull())
    newest = F.max(F.struct("OPERATION_DATE", "OPERATION_ID", "OPERATION_STATUS", "INFERENCE_FAILURES"))
    return usable.groupBy(F.col("SNAPSHOT_DATE").cast("bigint").alias("SNAPSHOT_DATE")).agg(
        newest.alias("r"), F.count(F.lit(1)).alias("N_USABLE_RUNS")).select(
        "SNAPSHOT_DATE", "r.OPERATION_ID", "r.OPERATION_STATUS", "r.OPERATION_DATE",
        "r.INFERENCE_FAILURES", "N_USABLE_RUNS")


def predictions(output: DataFrame, tracking: DataFrame, runs: DataFrame) -> DataFrame:
    """Prediction rows of the chosen runs with their tracking status."""
    chosen = small_side(runs.select("OPERATION_ID", "SNAPSHOT_DATE"))    # one row per month
    out = output.drop("SNAPSHOT_DATE").join(chosen, "OPERATION_ID")
    status = tracking.select("OPERATION_ID", "LOAN_ID", "OPERATION_STATUS_ENRICHMENT")
    return engine_predictions(out.join(status, ["OPERATION_ID", "LOAN_ID"], "left"))


def outcomes(loans: DataFrame, state_log: DataFrame, asof: int) -> DataFrame:
    """Worst days past due so far over each loan's label window.

    The snapshot month counts through its end state, later months through their
    worst. An equi-join on the loan with the window as residual: a loan has one
    state row per month, so at most a window's worth of rows match.
    """
    t = loans.select("SNAPSHOT_DATE", "LOAN_ID", "LABEL_HORIZON_DATE",
                     F.col("WORST_FUTURE_CAT").alias("FINAL_CAT"))
    s = existed_by(state_log, "BUILT_AT", asof).select(
        F.col("LOAN_ID").alias("__loan"), "MONTH_END", "DPD_AT_MONTH_END", "MAX_DPD_IN_MONTH",
        "HAS_INSTALLMENTS")
    on = ((F.col("LOAN_ID") == F.col("__loan"))
          & F.col("MONTH_END").between(F.col("SNAPSHOT_DATE"), F.col("LABEL_HORIZON_DATE")))
    later = F.col("MONTH_END") > F.col("SNAPSHOT_DATE")
    dpd = F.when(F.col("MONTH_END") == F.col("SNAPSHOT_DATE"), F.col("DPD_AT_MONTH_END")).when(
        later, F.col("MAX_DPD_IN_MONTH"))
    return t.join(s, on, "left").groupBy(*KEY, "FINAL_CAT").agg(
        F.max(dpd).alias("WORST_DPD_SO_FAR"),
        F.count_if(later).alias("MONTHS_OBSERVED"),
        F.count_if(F.col("HAS_INSTALLMENTS") == 0).alias("MONTHS_DELETED"),
        F.count("__loan").alias("STATE_ROWS"))


# ---- preparation -------------------------------------------------------------------

def label_check(outs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per snapshot: loans with too many months, loans compared, differences.

    On FINAL snapshots the label must equal the banded worst of a loan that has
    all its months; other snapshots compare none.
    """
    comparable = ((F.col("LABEL_STATUS") == "FINAL") & (F.col("MONTHS_OBSERVED") == C.LABEL_MONTHS)
                  & F.col("FINAL_CAT").isNotNull() & F.col("WORST_DPD_SO_FAR").isNotNull())
    differs = comparable & (band_dpd(F.col("WORST_DPD_SO_FAR")) != F.col("FINAL_CAT"))
    return with_label_status(outs, ledger).groupBy(*SNAP, "LABEL_STATUS").agg(
        F.count_if(F.col("MONTHS_OBSERVED") > C.LABEL_MONTHS).alias("N_TOO_MANY_MONTHS"),
        F.count_if(comparable).alias("N_CHECKED"), F.count_if(differs).alias("N_DIFFERENT"))


def assert_labels_agree(outs: DataFrame, ledger: DataFrame) -> DataFrame:
    """:func:`label_check`, raising on any contradiction."""
    check = small_side(label_check(outs, ledger))
    bad = check.where("N_TOO_MANY_MONTHS > 0 or N_DIFFERENT > 0").collect()   # one row per month
    for r in bad:
        if r["N_TOO_MANY_MONTHS"]:
            raise MonitorError(f"snapshot {r['SNAPSHOT_DATE']}: more than {C.LABEL_MONTHS} state "
                               "months after it, the horizon no longer bounds the window")
    if bad:
        raise MonitorError("; ".join(f"snapshot {r['SNAPSHOT_DATE']}: {r['N_DIFFERENT']} FINAL labels "
                                     "differ from the state log" for r in bad))
    return check


def assert_unique(df: DataFrame, keys: list[str], what: str) -> None:
    if not df.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
        raise MonitorError(f"{what} are not unique per {keys}")


def matched(preds: DataFrame, outs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Predictions with their outcome rows and flags: UNMATCHED (no outcome row
    at all; a NULL label is not that), MATURED, BLIND (open, nothing observed)."""
    o = with_label_status(outs, ledger).withColumn("__row", F.lit(True))
    df = preds.join(o, KEY, "left")
    matured = F.col("LABEL_STATUS").isNotNull()
    here = F.col("__row").isNotNull()
    return df.withColumns({
        "UNMATCHED": ~here, "MATURED": here & matured,
        "BLIND": here & ~matured & F.col("WORST_DPD_SO_FAR").isNull()}).drop("__row")


def with_outcome(df: DataFrame) -> DataFrame:
    """Usable rows with OUTCOME: the label once final, else the worst so far."""
    usable = ~F.col("UNMATCHED") & ~F.col("BLIND") & ~(F.col("MATURED") & F.col("FINAL_CAT").isNull())
    raw = F.when(F.col("MATURED"), F.col("FINAL_CAT")).otherwise(band_dpd(F.col("WORST_DPD_SO_FAR")))
    return df.where(usable).withColumn("OUTCOME", cap_category(raw).cast("int")).drop(
        "UNMATCHED", "BLIND")


def prepare(preds: DataFrame, outs: DataFrame, ledger: DataFrame) -> DataFrame:
    return with_outcome(matched(preds, outs, ledger))


def quality(preds: DataFrame, outs: DataFrame, ledger: DataFrame,
            runs: DataFrame | None = None) -> DataFrame:
    """Data-quality rows (snapshot_date, item, n)."""
    df = matched(preds, outs, ledger)
    gone = F.col("BLIND") & (F.col("STATE_ROWS") > 0)
    per = df.groupBy(*SNAP).agg(
        F.count(F.lit(1)).alias("prediction_rows"),
        F.count_if("UNMATCHED").alias("unmatched"),
        F.count_if(gone).alias("no_outcome_deleted"),
        F.count_if(F.col("BLIND") & (F.col("STATE_ROWS") == 0)).alias("no_outcome_no_state_rows"))
    labels = outs.join(ledger, "SNAPSHOT_DATE").groupBy(*SNAP).agg(
        F.count_if(F.col("FINAL_CAT").isNull()).alias("unlabelled"),
        F.max("LOANS_UNLABELLED").alias("ledger_unlabelled"),
        F.max("LOANS_MISSING_MONTHS").alias("ledger_missing_months"))
    parts = [_items(per), _items(labels)]
    parts.append(_items(label_check(outs, ledger).where("LABEL_STATUS = 'FINAL'").select(
        *SNAP, F.col("N_CHECKED").alias("cross_checked"))))
    if runs is not None:
        parts.append(_items(runs.select(*SNAP, F.col("N_USABLE_RUNS").alias("usable_runs"),
                                        F.col("INFERENCE_FAILURES").alias("inference_failures"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _items(df: DataFrame) -> DataFrame:
    names = [c for c in df.columns if c not in SNAP]
    cols = [F.col(n).cast("bigint").alias(n) for n in names]
    return df.select(*SNAP, *cols).unpivot(SNAP, names, "item", "n").where("n is not null")


# ---- cohorts -----------------------------------------------------------------------

def routing(prepared: DataFrame) -> DataFrame:
    """Where each snapshot's cohort goes: matured, interim or not_yet."""
    return prepared.groupBy(*SNAP).agg(
        F.max("LABEL_STATUS").alias("LABEL_STATUS"),
        F.max("MONTHS_OBSERVED").alias("m")).select(
        *SNAP, "LABEL_STATUS",
        F.when(F.col("LABEL_STATUS").isNotNull(), "matured").when(F.col("m") > 0, "interim")
        .otherwise("not_yet").alias("COHORT"))


def placed(cohort: DataFrame) -> DataFrame:
    """Ranked rows with POS and N in their snapshot's list (score desc, loan)."""
    cols = [*KEY, "CURRENT_CAT", "RISK_SCORE", "REMAINING_AMNT", "FLAGGED", "OUTCOME",
            "MONTHS_OBSERVED", "LABEL_STATUS"]
    rows = cohort.where(F.col("CURRENT_CAT") < C.CARVE_CATEGORY).select(
        *cols, is_severe(F.col("OUTCOME")).cast("bigint").alias("SEV"))
    return with_position(rows, [F.col("RISK_SCORE").desc_nulls_last(), F.col("LOAN_ID").asc()],
                         within=SNAP, name="POS", total="N")


def matured_list(prepared: DataFrame) -> DataFrame:
    return placed(prepared.where("MATURED"))


def interim_list(prepared: DataFrame) -> DataFrame:
    """Open snapshots that have seen at least one month."""
    seen = routing(prepared).where("COHORT = 'interim'").select(*SNAP)
    return placed(prepared.join(small_side(seen), "SNAPSHOT_DATE", "left_semi"))


def cut_rows(n: Column, cut) -> Column:
    """A cut-off as a row count: a float is a share rounded up, an int a count."""
    k = F.ceil(F.lit(cut) * n) if isinstance(cut, float) else F.lit(int(cut))
    return F.least(n, k.cast("bigint"))


def matured_metrics(lst: DataFrame, cuts=None) -> DataFrame:
    """One row per matured snapshot, one column group per cut-off."""
    cuts = cuts or C.MONITOR_CUTOFFS
    aggs = [F.max("LABEL_STATUS").alias("LABEL_STATUS"), F.count(F.lit(1)).alias("n_ranked"),
            F.sum("SEV").alias("n_severe"), F.sum("RISK_SCORE").alias("predicted_severe"),
            F.sum(F.when(F.col("SEV") == 1, F.col("REMAINING_AMNT"))).alias("__amt")]
    for name, cut in cuts.items():
        top = (F.col("POS") <= cut_rows(F.col("N"), cut)) & (F.col("SEV") == 1)
        aggs += [F.count_if(top).alias(f"__h_{name}"),
                 F.sum(F.when(top, F.col("REMAINING_AMNT"))).alias(f"__a_{name}")]
    out = lst.groupBy(*SNAP).agg(*aggs)
    ap = ranking.average_precision(lst, by=SNAP, score="RISK_SCORE")
    out = out.join(ap, "SNAPSHOT_DATE", "left")
    some = F.col("n_severe") > 0
    base = ratio(F.col("n_severe"), F.col("n_ranked"))
    cols = [*SNAP, "LABEL_STATUS", "n_ranked", "n_severe", base.alias("base_rate"),
            F.when(some, F.col("pr_auc")).alias("pr_auc"),
            F.when(some, F.col("predicted_severe")).alias("predicted_severe")]
    for name, cut in cuts.items():
        k, h = cut_rows(F.col("n_ranked"), cut), F.col(f"__h_{name}")
        lo, hi = wilson(h, F.col("n_severe"))
        caught = F.coalesce(F.col(f"__a_{name}"), F.lit(0.0))
        cols += [F.when(some, k).alias(f"{name}_k"),
                 ratio(h, F.col("n_severe")).alias(f"{name}_recall"),
                 lo.alias(f"{name}_recall_lo"), hi.alias(f"{name}_recall_hi"),
                 F.when(some, ratio(h, k)).alias(f"{name}_precision"),
                 F.when(some, ratio(h, k) / base).alias(f"{name}_lift"),
                 F.when(F.col("__amt") > 0, caught / F.col("__amt")).alias(f"{name}_exposure_caught")]
    return out.select(*cols)


def with_severe(lst: DataFrame) -> DataFrame:
    """The lists that hold a severe loan; the others are only counted."""
    some = lst.where("SEV = 1").select(*SNAP).distinct()             # one row per month
    return lst.join(some, "SNAPSHOT_DATE", "left_semi")


def queue_by_category(lst: DataFrame, cuts=None) -> DataFrame:
    """Per current category inside the one pooled list (not ranked again)."""
    lst = with_severe(lst)
    cuts = cuts or C.MONITOR_CUTOFFS
    by = [*SNAP, "CURRENT_CAT"]
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("SEV").alias("n_severe"), F.max("N").alias("__N")]
    for name, cut in cuts.items():
        top = F.col("POS") <= cut_rows(F.col("N"), cut)
        aggs += [F.count_if(top).alias(f"__t_{name}"),
                 F.count_if(top & (F.col("SEV") == 1)).alias(f"__h_{name}")]
    out = lst.groupBy(*by).agg(*aggs).join(
        ranking.average_precision(lst, by=by, score="RISK_SCORE"), by)
    cols = [*by, "n", "n_severe", ratio(F.col("n_severe"), F.col("n")).alias("base_rate"), "pr_auc"]
    for name, cut in cuts.items():
        cols += [ratio(F.col(f"__t_{name}"), cut_rows(F.col("__N"), cut)).alias(f"share_of_{name}"),
                 ratio(F.col(f"__h_{name}"), F.col("n_severe")).alias(f"recall_{name}")]
    return out.select(*cols)


def calibration_deciles(lst: DataFrame) -> DataFrame:
    """Mean score and severe rate by tenth of the list: (lo, hi] on positions."""
    lst = with_severe(lst)
    bin_no = F.when(F.col("N") <= 1, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.expr("(10 * (POS - 1) + N - 2) div (case when N > 1 then N - 1 else 1 end)")))
    return lst.groupBy(*SNAP, bin_no.cast("int").alias("DECILE")).agg(
        F.avg("RISK_SCORE").alias("mean_score"), F.avg("SEV").alias("severe_rate"),
        F.count(F.lit(1)).alias("n"))


def migration(lst: DataFrame, main: str = C.MONITOR_MAIN_CUTOFF, cuts=None) -> DataFrame:
    """Current category to outcome, for the head of the list and for the rest."""
    lst = with_severe(lst)
    cut = (cuts or C.MONITOR_CUTOFFS)[main]
    head = F.when(F.col("POS") <= cut_rows(F.col("N"), cut), "top").otherwise("rest")
    return lst.groupBy(*SNAP, head.alias("GROUP"), "CURRENT_CAT").agg(
        *[F.count_if(F.col("OUTCOME") == k).alias(f"to_{k}") for k in range(C.NUM_CLASSES)])


def cohort_capture(lst: DataFrame, n_points: int = 200) -> DataFrame:
    return ranking.curve_from_positions(with_severe(lst), SNAP, n_points)


def enrichment_rule(lst: DataFrame) -> DataFrame:
    """The exception rule against a list head of the same size."""
    lst = with_severe(lst)
    rule = lst.groupBy(*SNAP).agg(
        F.count_if("FLAGGED").alias("n_flagged"),
        F.count_if(F.col("FLAGGED") & (F.col("SEV") == 1)).alias("n_severe_flagged"),
        F.sum("SEV").alias("__sev"))
    sized = lst.select(*SNAP, "POS", "SEV").join(
        small_side(rule.select(*SNAP, "n_flagged")), "SNAPSHOT_DATE")        # one row per month
    same = sized.groupBy(*SNAP).agg(
        F.sum(F.when(F.col("POS") <= F.col("n_flagged"), F.col("SEV")).otherwise(0)).alias("__same"))
    return rule.join(same, "SNAPSHOT_DATE").select(
        *SNAP, "n_flagged", "n_severe_flagged",
        ratio(F.col("n_severe_flagged"), F.col("n_flagged")).alias("precision"),
        ratio(F.col("n_severe_flagged"), F.col("__sev")).alias("recall"),
        ratio(F.col("__same"), F.col("__sev")).alias("recall_top_same_size"))


def interim_metrics(lst: DataFrame, cuts=None, main: str = C.MONITOR_MAIN_CUTOFF) -> DataFrame:
    """Open cohorts: how many got worse or severe so far, by list head."""
    cuts = cuts or C.MONITOR_CUTOFFS
    worse = F.col("OUTCOME") > F.col("CURRENT_CAT")
    severe = F.col("SEV") == 1
    groups = {"rest": F.col("POS") > cut_rows(F.col("N"), cuts[main]),
              **{n: F.col("POS") <= cut_rows(F.col("N"), c) for n, c in cuts.items()},
              "rule": F.col("FLAGGED")}
    aggs = [F.count(F.lit(1)).alias("n_ranked"), F.count_if(worse).alias("__w"),
            F.count_if(severe).alias("__s")]
    for g, cond in groups.items():
        aggs += [F.count_if(cond).alias(f"{g}_n"), F.count_if(cond & worse).alias(f"__w_{g}"),
                 F.count_if(cond & severe).alias(f"__s_{g}")]
    out = lst.groupBy(*SNAP).agg(*aggs)
    months = lst.groupBy(*SNAP, "MONTHS_OBSERVED").agg(F.count(F.lit(1)).alias("k"))
    mode = months.groupBy(*SNAP).agg(
        F.max(F.struct("k", "MONTHS_OBSERVED")).getField("MONTHS_OBSERVED").alias("months_observed"),
        F.collect_list(F.struct("MONTHS_OBSERVED", "k")).alias("__all"))     # at most 7 entries
    short = F.aggregate(F.filter("__all", lambda x: x["MONTHS_OBSERVED"] < F.col("months_observed")),
                        F.lit(0).cast("bigint"), lambda a, x: a + x["k"])
    mode = mode.select(*SNAP, "months_observed", short.alias("n_short_months"))
    out = out.join(mode, "SNAPSHOT_DATE")
    cols = [*SNAP, "months_observed", "n_short_months", "n_ranked",
            ratio(F.col("__w"), F.col("n_ranked")).alias("deteriorated_rate"),
            ratio(F.col("__s"), F.col("n_ranked")).alias("severe_so_far_rate")]
    rest = ratio(F.col("__w_rest"), F.col("rest_n"))
    for g in groups:
        rate = ratio(F.col(f"__w_{g}"), F.col(f"{g}_n"))
        cols += [f"{g}_n", rate.alias(f"{g}_deteriorated_rate"),
                 ratio(F.col(f"__s_{g}"), F.col(f"{g}_n")).alias(f"{g}_severe_so_far_rate")]
        if g in cuts:
            cols.append((rate / F.when(rest != 0, rest)).alias(f"{g}_lift_vs_rest"))
    return out.select(*cols)


# ---- drift -------------------------------------------------------------------------

def psi(reference: DataFrame, current: DataFrame, by: list[str], value: str, weight: str,
        bins: int = 10) -> DataFrame:
    """Population stability index per group between two weighted value frames.

    Bins are the reference's quantile edges, repeats removed, the ends open;
    fewer than three edges give NULL.
    """
    edges = quantiles(reference, by, value, [i / bins for i in range(bins + 1)], weight=weight)
    edges = edges.groupBy(*by).agg(F.array_sort(F.collect_set("value")).alias("__e"))  # bins + 1
    edges = small_side(edges.where(F.size("__e") >= 3))

    def shares(df, name):
        inner = F.slice("__e", 2, F.size("__e") - 2)
        b = F.size(F.filter(inner, lambda e: e <= F.col(value)))
        return df.join(edges, by).groupBy(*by, b.alias("__bin")).agg(F.sum(weight).alias(name))

    counts = shares(reference, "__a").join(shares(current, "__b"), [*by, "__bin"], "full")
    total = Window.partitionBy(*by)                       # at most `bins` rows per group
    counts = counts.withColumns({"__ta": F.sum("__a").over(total), "__tb": F.sum("__b").over(total)})
    floor = F.lit(1e-6)
    a = F.greatest(F.coalesce(ratio(F.col("__a"), F.col("__ta")), F.lit(0.0)), floor)
    b = F.greatest(F.coalesce(ratio(F.col("__b"), F.col("__tb")), F.lit(0.0)), floor)
    return counts.where("__ta > 0 and __tb > 0").groupBy(*by).agg(F.sum((b - a) * F.log(b / a)).alias("psi"))


def drift(preds: DataFrame, history: int = C.PSI_REF_SNAPSHOTS) -> DataFrame:
    """Per snapshot: rows, ranked rows, category shares, score level, PSI of the
    scores against the previous snapshots pooled."""
    per = preds.groupBy(*SNAP).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("CURRENT_CAT") < C.CARVE_CATEGORY).alias("n_ranked"),
        *[ratio(F.count_if(F.col("CURRENT_CAT") == c), F.count(F.lit(1))).alias(f"cat_{c}_share")
          for c in range(C.NUM_CLASSES)],
        F.avg(F.when(F.col("CURRENT_CAT") < C.CARVE_CATEGORY, F.col("RISK_SCORE"))).alias("score_mean"))
    ranked = preds.where(F.col("CURRENT_CAT") < C.CARVE_CATEGORY)
    # One row per (snapshot, distinct score); every later step reads this.
    scores = ranked.groupBy(*SNAP, "RISK_SCORE").agg(F.count(F.lit(1)).alias("w"))
    level = quantiles(scores, SNAP, "RISK_SCORE", [0.9, 0.99], weight="w").groupBy(*SNAP).agg(
        F.max(F.when(F.col("prob") == 0.9, F.col("value"))).alias("score_p90"),
        F.max(F.when(F.col("prob") == 0.99, F.col("value"))).alias("score_p99"))
    # Each snapshot is a reference for the next few: (source, target) pairs.
    order = preds.select(*SNAP).distinct().agg(
        F.sort_array(F.collect_set("SNAPSHOT_DATE")).alias("s"))       # one number per month
    pairs = order.select(F.posexplode("s").alias("i", "SOURCE"), "s").select(
        "SOURCE", F.explode(F.slice("s", F.col("i") + 2, F.lit(history))).alias("SNAPSHOT_DATE"))
    reference = (scores.withColumnRenamed("SNAPSHOT_DATE", "SOURCE").join(small_side(pairs), "SOURCE")
                 .groupBy(*SNAP, "RISK_SCORE").agg(F.sum("w").alias("w")))
    index = psi(reference, scores, SNAP, "RISK_SCORE", "w").withColumnRenamed("psi", "score_psi")
    return per.join(level, "SNAPSHOT_DATE", "left").join(index, "SNAPSHOT_DATE", "left")


# ---- history -----------------------------------------------------------------------

def history(lst: DataFrame, cuts=None) -> DataFrame:
    """One row per matured cohort: headline, cut-offs, rule, vintage start mark.

    VINTAGE_START marks the first FINAL snapshot when LEGACY ones precede it.
    """
    head = matured_metrics(lst, cuts)
    cat0 = queue_by_category(lst, cuts).where("CURRENT_CAT = 0").select(
        *SNAP, F.col("pr_auc").alias("cat0_pr_auc"))
    rule = enrichment_rule(lst)
    rule = rule.select(*SNAP, *[F.col(c).alias(f"rule_{c}") for c in
                                ("n_flagged", "precision", "recall", "recall_top_same_size")])
    firsts = head.agg(F.min(F.when(F.col("LABEL_STATUS") == "FINAL", F.col("SNAPSHOT_DATE"))).alias("__f"),
                      F.min(F.when(F.col("LABEL_STATUS") == "LEGACY", F.col("SNAPSHOT_DATE"))).alias("__l"))
    f, le = firsts.first()
    start = F.lit(False) if f is None or le is None or le > f else F.col("SNAPSHOT_DATE") == f
    return (head.join(cat0, "SNAPSHOT_DATE", "left").join(rule, "SNAPSHOT_DATE", "left")
            .withColumn("VINTAGE_START", start))


def score_level(preds: DataFrame, method: str = "exact") -> DataFrame:
    return quantile_columns(preds, SNAP, "RISK_SCORE", {"score_p90": 0.9, "score_p99": 0.99}, method)
