"""The ranked call queue: rule flags, ranks, head and flag reports, sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.columns import ratio
from ..functions.position import with_position
from ..functions.quantiles import quantiles
from ..session import pin
from .decide import MASKED, with_decision, with_monotone_mask

#: Up to this rank Spark limits the rows of a group before the shuffle.
_FEW = 500

QUEUE_COLUMNS = [
    "RISK_RANK", "SNAPSHOT_DATE", "NATIONAL_CODE", "LOAN_ID", "N_LOANS_IN_PORTFOLIO",
    "CURRENT_CAT", "P_NO_DELAY", "P_CURRENT", "P_PAST_DUE", "P_SEVERE_PAST_DUE",
    "PREDICTED_CLASS", "RISK_SCORE", "EXPECTED_COST", "CUSTOMER_MAX_RISK_SCORE", "RULE_FLAG",
]


def with_customer_max(df: DataFrame, score: str = "RISK_SCORE") -> DataFrame:
    """The worst score over each (customer, snapshot), on every row of it.

    Aggregated and joined back rather than a window: the aggregate combines
    map-side, so a customer with very many loans does not meet in one task.
    """
    keys = ["NATIONAL_CODE", "SNAPSHOT_DATE"]
    worst = df.groupBy(*keys).agg(F.max(score).alias("CUSTOMER_MAX_RISK_SCORE"))
    return df.join(worst, keys, "left")


def recent_callers(called_log: DataFrame, as_of: str, ttl_days: int = C.CALL_TTL_DAYS) -> DataFrame:
    """Customers whose last call is within the TTL before ``as_of``."""
    cutoff = F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {int(ttl_days)} days")
    return called_log.where(F.col("CALLED_AT") >= cutoff).select("NATIONAL_CODE").distinct()


def with_rule_flag(df: DataFrame, called_log: DataFrame | None = None, as_of: str | None = None,
                   carve_category: int = C.CARVE_CATEGORY, act_threshold: float | None = None,
                   ttl_days: int = C.CALL_TTL_DAYS, newest_only: bool = True) -> DataFrame:
    """RULE_FLAG, first match wins; '' competes for the call budget.

    ALREADY_SEVERE > SUPERSEDED (an older snapshot row of the customer) >
    PREDICTED_SEVERE (score at or over the threshold, if set) > RECENTLY_CALLED.
    """
    flag = F.when(F.col("CURRENT_CAT") >= carve_category, "ALREADY_SEVERE")
    drop = []
    if newest_only:
        newest = df.groupBy("NATIONAL_CODE").agg(F.max("SNAPSHOT_DATE").alias("__newest"))
        df = df.join(newest, "NATIONAL_CODE", "left")
        flag = flag.when(F.col("SNAPSHOT_DATE") < F.col("__newest"), "SUPERSEDED")
        drop.append("__newest")
    if act_threshold is not None:
        flag = flag.when(F.col("RISK_SCORE") >= float(act_threshold), "PREDICTED_SEVERE")
    if called_log is not None:
        if as_of is None:
            raise ValueError("as_of is needed to judge how fresh a call is")
        recent = recent_callers(called_log, as_of, ttl_days).withColumn("__called", F.lit(True))
        df = df.join(recent, "NATIONAL_CODE", "left")
        flag = flag.when(F.col("__called"), "RECENTLY_CALLED")
        drop.append("__called")
    return df.withColumn("RULE_FLAG", flag.otherwise("")).drop(*drop)


def queue_order(loan: bool = True) -> list[Column]:
    """Unflagged first, riskiest first, then customer, loan and snapshot."""
    keys = [(F.col("RULE_FLAG") != "").asc(), F.col("RISK_SCORE").desc_nulls_last(),
            F.col("NATIONAL_CODE").asc_nulls_last()]
    if loan:
        keys.append(F.col("LOAN_ID").asc_nulls_last())
    return keys + [F.col("SNAPSHOT_DATE").asc()]


def with_rank(df: DataFrame) -> DataFrame:
    """RISK_RANK over the unflagged rows in queue order; NULL on flagged rows.

    Flagged rows sort behind the queue, so one pass ranks everything.
    """
    out = with_position(df, queue_order("LOAN_ID" in df.columns), name="__pos")
    return out.withColumn("RISK_RANK", F.when(F.col("RULE_FLAG") == "", F.col("__pos"))).drop("__pos")


def build_queue(df: DataFrame, called_log: DataFrame | None = None, as_of: str | None = None,
                cost_matrix=C.COST_MATRIX, **flag_options) -> DataFrame:
    """Calibrated probabilities p0..p3 per row to the ranked queue."""
    df = with_decision(with_monotone_mask(df), cost_matrix=cost_matrix)
    df = with_rule_flag(with_customer_max(df), called_log, as_of, **flag_options)
    df = df.withColumnsRenamed(dict(zip(
        MASKED, ["P_NO_DELAY", "P_CURRENT", "P_PAST_DUE", "P_SEVERE_PAST_DUE"])))
    have = [c for c in QUEUE_COLUMNS if c == "RISK_RANK" or c in df.columns]
    return with_rank(df.select(*[c for c in have if c != "RISK_RANK"])).select(*have)


def head_report(queue: DataFrame, hours: int = 24) -> DataFrame:
    """What the first hours of calls cover: slots, customers, duplicate slots."""
    head = queue.where(F.col("RISK_RANK") <= C.CALLS_PER_HOUR * hours)
    return head.agg(F.count(F.lit(1)).alias("n_slots"),
                    F.count_distinct("NATIONAL_CODE").alias("n_customers")).withColumn(
        "n_duplicate_slots", F.col("n_slots") - F.col("n_customers"))


def flag_report(queue: DataFrame) -> DataFrame:
    """Rows per flag and the hours it takes to call that many."""
    return queue.groupBy("RULE_FLAG").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "hours_to_call", F.col("n") / C.CALLS_PER_HOUR)


def with_quantile_bin(df: DataFrame, value: str, bins: int, name: str) -> tuple[DataFrame, int]:
    """Equal-probability bin number of a value, (lo, hi] intervals, repeated
    edges dropped. Also returns how many bins are left."""
    probs = [i / bins for i in range(bins + 1)]
    edges = sorted({r["value"] for r in quantiles(df, [], value, probs).collect()})
    inner = edges[1:-1]                      # at most bins - 1 numbers
    number = F.lit(0)
    for e in inner:
        number = number + F.when(F.col(value) > e, 1).otherwise(0)
    return df.withColumn(name, number), max(len(edges) - 1, 1)


def sample_across_risk(queue: DataFrame, n: int = 100, bins: int = 5,
                       include_flagged: bool = False, seed: int = C.SEED) -> DataFrame:
    """Stratified sample of the queue: the same number from every score bin.

    Rows are taken in the order of a seeded hash, so a run can be repeated.
    With ``include_flagged`` a few rows of every flag come along. The queue is
    written once: the bins' edges and both draws read it.
    """
    queue = pin(queue)
    binned, used = with_quantile_bin(queue.where(F.col("RULE_FLAG") == ""), "RISK_SCORE",
                                     bins, "RISK_BIN")
    parts = _draw(binned, "RISK_BIN", max(n // used, 1), seed)
    if include_flagged:
        flagged = queue.where(F.col("RULE_FLAG") != "").withColumn("RISK_BIN", F.lit(None).cast("int"))
        parts = parts.unionByName(_draw(flagged, "RULE_FLAG", max(n // 20, 3), seed))
    return parts


def _draw(df: DataFrame, group: str, quota: int, seed: int) -> DataFrame:
    """``quota`` rows per group, which may be of any size.

    Few rows are taken by a rank filter, which Spark turns into a limit per group in
    each task before the shuffle; many by their positions.
    """
    keys = ("NATIONAL_CODE", "LOAN_ID", "SNAPSHOT_DATE")
    order = [F.xxhash64(F.lit(seed), *keys).asc(), *[F.col(k).asc() for k in keys]]
    if quota <= _FEW:
        rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
        return df.withColumn("__r", rank).where(F.col("__r") <= quota).drop("__r")
    return with_position(df, order, within=[group], name="__r").where(F.col("__r") <= quota).drop("__r")


def hours_to_call(n: Column) -> Column:
    return ratio(n, F.lit(C.CALLS_PER_HOUR))
