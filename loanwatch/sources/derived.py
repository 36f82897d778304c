"""Loan-shaped inputs derived from order tables.

The supplied tables hold no loans. An order is read as a loan, its customer as
the borrower, a ship month as a snapshot and the month's worst weighted
quantity as days past due; every operator then runs over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.columns import band_dpd, cap_category

LAST_FINAL_SNAPSHOT = 20010501     # later snapshots are open
LAST_LEGACY_SNAPSHOT = 19991201

#: Name of the monthly load in the derived job log.
JOB = "MONTHLY_LOAD"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A supplied table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def yyyymmdd(ts: Column) -> Column:
    """A date as a YYYYMMDD number."""
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("bigint")


def state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month-end state per loan (LOAN_ID, MONTH_END, ...).

    Aggregated per (loan, month) before any shuffle on the loan alone, so a
    loan with very many items is small by the time its rows meet.
    """
    flag, qty = F.col("l_returnflag"), F.col("l_quantity")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    month = F.date_trunc("month", "l_shipdate")
    worst = F.when(flag == "N", 0.0).when(flag == "A", qty).otherwise(4 * qty)
    return (read(spark, sf_dir, "lineitem")
            .groupBy(F.col("l_orderkey").alias("LOAN_ID"), month.alias("MONTH_TS"))
            .agg(F.max(worst).cast("int").alias("DPD_AT_MONTH_END"),
                 F.count(F.lit(1)).alias("N_INST"),
                 F.sum(cents).alias("AMT_CENTS"),
                 F.sum(F.when(flag == "R", cents).otherwise(0)).alias("R_CENTS"),
                 F.count_if(flag == "R").alias("N_R"),
                 F.count_if(flag == "N").alias("N_N"),
                 F.sum(qty.cast("bigint")).alias("QTY"))
            .select("LOAN_ID", "MONTH_TS", yyyymmdd(F.col("MONTH_TS")).alias("MONTH_END"),
                    "DPD_AT_MONTH_END", F.col("DPD_AT_MONTH_END").alias("MAX_DPD_IN_MONTH"),
                    F.when(F.col("LOAN_ID") % 17 == 0, 0).otherwise(1).alias("HAS_INSTALLMENTS"),
                    (F.col("MONTH_TS") + F.expr("interval 1 month")
                     + F.expr("interval 3 days")).alias("BUILT_AT"),
                    "N_INST", "AMT_CENTS", "R_CENTS", "N_R", "N_N", "QTY"))


def loan_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loan table: keys, contract features, labels, borrower, horizon, score."""
    st = state_log(spark, sf_dir)
    month_no = F.year("MONTH_TS") * 12 + F.month("MONTH_TS")
    loan = Window.partitionBy("LOAN_ID").orderBy("MONTH_NO")
    past = loan.rowsBetween(Window.unboundedPreceding, -1)
    upto = loan.rowsBetween(Window.unboundedPreceding, 0)
    ahead = loan.rangeBetween(0, C.LABEL_MONTHS)
    dpd = F.col("DPD_AT_MONTH_END")
    late_ts = F.max(F.when(dpd > 0, F.col("MONTH_TS"))).over(upto)
    # A loan has at most one row per month here, so its window is short.
    wide = (st.withColumn("MONTH_NO", month_no)
            .select("LOAN_ID", "MONTH_TS", "MONTH_END", dpd.alias("DPD_DAYS"), "N_INST",
                    "AMT_CENTS", "R_CENTS", "N_R", "N_N", "QTY",
                    F.coalesce(F.lag(dpd).over(loan), F.lit(0)).alias("DPD_DAYS_T1"),
                    F.max(dpd).over(past).alias("HIST_MAX_DPD_DAYS"),
                    F.coalesce(F.datediff("MONTH_TS", late_ts), F.lit(C.NEVER))
                    .alias("DAYS_SINCE_LAST_DPD"),
                    (F.col("MONTH_NO") - F.min("MONTH_NO").over(upto)).alias("CONTRACT_AGE_MONTH"),
                    F.max(dpd).over(ahead).alias("WORST_FUTURE_DPD"),
                    F.count(F.lit(1)).over(ahead).alias("STATE_ROWS")))
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("LOAN_ID"),
        F.col("o_custkey").cast("string").alias("NATIONAL_CODE"))
    cat = band_dpd(F.col("DPD_DAYS"))
    fut = band_dpd(F.col("WORST_FUTURE_DPD"))
    hundredths = (F.lit(2) + 10 * F.least(cat, F.lit(2)) + F.expr(
        "((LOAN_ID * 7919 + MONTH_END) % 1000 * 4 + 50) div 100")
        + F.when((cap_category(fut) == C.SEVERE) & (F.col("LOAN_ID") % 3 != 0), 30).otherwise(0))
    return wide.join(orders, "LOAN_ID").select(
        "LOAN_ID", F.col("MONTH_END").alias("SNAPSHOT_DATE"), "NATIONAL_CODE",
        F.concat(F.lit("C"), F.col("LOAN_ID").cast("string")).alias("CONTRACT_NUMBER"),
        "DPD_DAYS", cat.alias("LOAN_CATEGORY"),
        F.col("N_INST").cast("int").alias("UNPAYED_INST_CNT"),
        (F.col("R_CENTS") / 100.0).alias("PAYED_OVERDUE_AMNT"),
        (F.col("N_R") / F.col("N_INST")).alias("OVERDUE_RATIO"),
        F.col("DPD_DAYS").between(45, 60).cast("int").alias("IS_IN_WARNING_ZONE"),
        F.when(F.col("LOAN_ID") % 11 != 0, F.col("N_N") / F.col("N_INST")).alias("ONTIME_RATIO"),
        F.when(F.col("LOAN_ID") % 7 != 0, F.col("QTY").cast("double")).alias("UPCOMING_AMNT"),
        "DPD_DAYS_T1", "HIST_MAX_DPD_DAYS", "DAYS_SINCE_LAST_DPD", "CONTRACT_AGE_MONTH",
        (F.col("AMT_CENTS") / 100.0).alias("REMAINING_AMNT"),
        "WORST_FUTURE_DPD", fut.alias("WORST_FUTURE_CAT"),
        yyyymmdd(F.col("MONTH_TS") + F.expr(f"interval {C.LABEL_MONTHS} month"))
        .alias("LABEL_HORIZON_DATE"),
        "MONTH_TS", "STATE_ROWS", (hundredths / 100.0).alias("SCORE"))


# Contract features the derived feed carries, in contract order.
FEED_FEATURES = [
    "DPD_DAYS", "LOAN_CATEGORY", "UNPAYED_INST_CNT", "PAYED_OVERDUE_AMNT", "OVERDUE_RATIO",
    "IS_IN_WARNING_ZONE", "ONTIME_RATIO", "UPCOMING_AMNT", "DPD_DAYS_T1", "HIST_MAX_DPD_DAYS",
    "DAYS_SINCE_LAST_DPD", "CONTRACT_AGE_MONTH", "REMAINING_AMNT",
]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows: keys, capped category, label and score, exposure."""
    return loan_feed(spark, sf_dir).select(
        "LOAN_ID", "NATIONAL_CODE", "SNAPSHOT_DATE", "DPD_DAYS",
        cap_category(F.col("LOAN_CATEGORY")).alias("CURRENT_CAT"),
        cap_category(F.col("WORST_FUTURE_CAT")).alias("LABEL"),
        "REMAINING_AMNT", "SCORE", "STATE_ROWS", "WORST_FUTURE_DPD")


def unlabelled(loan_id: Column) -> Column:
    """Loans the derived feed leaves without a label on finalised snapshots."""
    return loan_id % 97 == 0


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_trunc("month", "l_shipdate")
    return (read(spark, sf_dir, "lineitem").select(month.alias("MONTH_TS")).distinct()
            .select(yyyymmdd(F.col("MONTH_TS")).alias("SNAPSHOT_DATE"), "MONTH_TS"))


def ledger_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label ledger as stored: untidy status text, NULL counts on LEGACY."""
    legacy = F.col("SNAPSHOT_DATE") <= LAST_LEGACY_SNAPSHOT
    loan = F.col("l_orderkey")
    counts = read(spark, sf_dir, "lineitem").groupBy(
        F.date_trunc("month", "l_shipdate").alias("MONTH_TS")).agg(
        F.count_distinct(F.when(unlabelled(loan), loan)).alias("n")).withColumn(
        "SNAPSHOT_DATE", yyyymmdd(F.col("MONTH_TS")))
    return counts.where(F.col("SNAPSHOT_DATE") <= LAST_FINAL_SNAPSHOT).select(
        "SNAPSHOT_DATE", F.when(legacy, " Legacy ").otherwise("final").alias("STATUS"),
        (F.col("MONTH_TS") + F.expr("interval 7 month")).alias("FINALIZED_AT"),
        F.when(~legacy, F.col("n")).alias("LOANS_UNLABELLED"),
        F.when(~legacy, F.lit(0).cast("bigint")).alias("LOANS_MISSING_MONTHS"))


def feed_with_open_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loan table as it arrives: labels NULL where they are not final."""
    return with_open_labels(loan_feed(spark, sf_dir))


def with_open_labels(df: DataFrame) -> DataFrame:
    """The loan table with labels NULL where they are not final."""
    final = (F.col("SNAPSHOT_DATE") <= LAST_FINAL_SNAPSHOT) & ~(
        unlabelled(F.col("LOAN_ID")) & (F.col("SNAPSHOT_DATE") > LAST_LEGACY_SNAPSHOT))
    return df.withColumns({c: F.when(final, F.col(c))
                           for c in ("WORST_FUTURE_DPD", "WORST_FUTURE_CAT")})


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load and scoring runs: one per snapshot, a second usable one every third
    month, a newer failed one every fifth."""
    s = snapshots(spark, sf_dir)
    m = F.month("MONTH_TS")
    attempts = F.filter(
        F.array(*[F.struct(F.lit(suffix).alias("suffix"), F.lit(status).alias("status"),
                           F.lit(days).alias("days"), use.alias("use"))
                  for suffix, status, days, use in (
                      ("a", "SUCCESS", 2, F.lit(True)),
                      ("b", "PARTIAL_SUCCESS", 5, m % 3 == 0),
                      ("c", "FAILED", 9, m % 5 == 0))]),
        lambda a: a["use"])
    return s.select("SNAPSHOT_DATE", "MONTH_TS", F.explode(attempts).alias("a")).select(
        F.concat(F.lit("op-"), F.col("SNAPSHOT_DATE").cast("string"), F.col("a.suffix"))
        .alias("OPERATION_ID"),
        "SNAPSHOT_DATE", F.col("a.status").alias("OPERATION_STATUS"),
        F.expr("MONTH_TS + make_interval(0, 0, 0, a.days)").alias("OPERATION_DATE"),
        F.when(F.col("a.suffix") == "b", 3).otherwise(0).alias("INFERENCE_FAILURES"))


def called_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest strong sign-up event per user, read as the last call of a borrower."""
    return (read(spark, sf_dir, "events")
            .where((F.col("event_type") == "signup") & (F.col("value") > 120))
            .groupBy(F.col("user_id").cast("string").alias("NATIONAL_CODE"))
            .agg(F.max("ts").alias("CALLED_AT")))


def job_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The load job's own bookkeeping, one row per attempt."""
    return run_log(spark, sf_dir).select(
        F.lit(JOB).alias("JOB_NAME"), F.col("SNAPSHOT_DATE").alias("RUN_MONTH"),
        F.when(F.col("OPERATION_STATUS") == "PARTIAL_SUCCESS", "SUCCESS")
        .otherwise(F.col("OPERATION_STATUS")).alias("STATUS"),
        F.when(F.col("OPERATION_STATUS") == "FAILED", "publish").otherwise("done").alias("LAST_STEP"),
        F.when(F.col("OPERATION_STATUS") == "FAILED", "stopped").alias("ERROR_MESSAGE"),
        F.col("OPERATION_DATE").alias("END_TIME"))


def checked_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed with the columns the feed checks look at, faults planted."""
    df = feed_with_open_labels(spark, sf_dir)
    i = F.col("LOAN_ID")
    return df.withColumns({
        "MONTHS_IN_CURRENT_CATEGORY": (i % 8).cast("int"),
        "CATEGORY_T1": (i % 6).cast("int"),
        "CATEGORY_T2": (i % 5).cast("int"),
        "CATEGORY_T3": (i % 7 - 1).cast("int"),
        "HIST_MAX_CATEGORY": F.col("LOAN_CATEGORY"),
        "HAS_EVER_BEEN_NPL": (F.col("DPD_DAYS") >= 181).cast("int"),
        "HAS_EVER_BEEN_PRENPL": F.when(i % 13 != 0, (F.col("DPD_DAYS") >= 184).cast("int")),
        "DAYS_SINCE_LAST_30_DPD": F.when(i % 29 == 0, 0).otherwise(F.col("DAYS_SINCE_LAST_DPD")),
        "DAYS_SINCE_LAST_60_DPD": F.when(i % 31 == 0, 1).otherwise(F.lit(C.NEVER)),
        "DAYS_SINCE_LAST_90_DPD": F.lit(100000),
        "WORST_FUTURE_CAT": F.when(i % 37 == 0, F.col("WORST_FUTURE_CAT") - 2)
        .otherwise(F.col("WORST_FUTURE_CAT")),
        "LABEL_HORIZON_DATE": F.when((i % 41 == 0) & (F.col("SNAPSHOT_DATE") > 20000101),
                                     F.col("LABEL_HORIZON_DATE") + 1)
        .otherwise(F.col("LABEL_HORIZON_DATE")),
    })


def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines read as rows keyed by (order, ship month), which repeat."""
    month = F.date_trunc("month", "l_shipdate")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("LOAN_ID"), yyyymmdd(month).alias("SNAPSHOT_DATE"))


def text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as text, mangled on every 97th order."""
    q = F.col("l_quantity").cast("string")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("LOAN_ID"), "l_linenumber",
        F.when(F.col("l_orderkey") % 97 == 0, F.concat(q, F.lit("/5"))).otherwise(q).alias("QTY"),
        F.col("l_discount").cast("string").alias("DISC"))


def feed_with_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed with header text in the customer column of some rows."""
    i = F.col("LOAN_ID")
    return loan_feed(spark, sf_dir).withColumn(
        "NATIONAL_CODE", F.when(i % 101 == 0, "NATIONAL_CODE").when(i % 103 == 0, None)
        .otherwise(F.col("NATIONAL_CODE")))


def engine_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One output row per scored loan and usable or failed run."""
    f = loan_feed(spark, sf_dir).where(F.col("LOAN_CATEGORY") < 3)
    runs = run_log(spark, sf_dir).select("OPERATION_ID", "SNAPSHOT_DATE")
    return f.join(F.broadcast(runs), "SNAPSHOT_DATE").select(      # a few rows per month
        "OPERATION_ID", "SNAPSHOT_DATE", "LOAN_ID", "NATIONAL_CODE",
        F.col("SCORE").alias("P3"), F.col("LOAN_CATEGORY").alias("DPD_CAT"),
        F.col("DPD_DAYS").alias("DPD"), F.col("REMAINING_AMNT").alias("REMAIN_OF_ACCOUNT"))


def contract_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exception-rule status per (run, loan); only some loans have one."""
    return tracking_of(engine_output(spark, sf_dir))


def tracking_of(out: DataFrame) -> DataFrame:
    """The tracking rows of an engine output that is derived already."""
    hit = (F.col("P3") > 0.5) & (F.col("DPD") > 120)
    return out.where(hit | (F.col("LOAN_ID") % 3 == 0)).select(
        "OPERATION_ID", "LOAN_ID",
        F.when(hit, "PENDING_ENRICHMENT").otherwise("NOT_APPLICABLE")
        .alias("OPERATION_STATUS_ENRICHMENT"))


def flagged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction rows as the monitor reads them."""
    return scored(spark, sf_dir).select(
        "SNAPSHOT_DATE", "LOAN_ID", "NATIONAL_CODE", "CURRENT_CAT",
        F.col("SCORE").alias("RISK_SCORE"), "REMAINING_AMNT",
        ((F.col("SCORE") > 0.5) & (F.col("DPD_DAYS") > 120)).alias("FLAGGED"))


def class_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw probabilities p0..p3: the score for the worst class, the rest shared."""
    s = F.col("SCORE")
    shares = (0.5, 0.3, 0.2)
    return scored(spark, sf_dir).withColumns(
        {**{f"p{k}": (1 - s) * w for k, w in enumerate(shares)}, "p3": s})


MONITOR_ASOF = 20011015


def monitor_state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state log with nothing known where installments were deleted."""
    df = state_log(spark, sf_dir).select("LOAN_ID", "MONTH_END", "DPD_AT_MONTH_END",
                                         "MAX_DPD_IN_MONTH", "HAS_INSTALLMENTS", "BUILT_AT")
    known = F.col("HAS_INSTALLMENTS") == 1
    return df.withColumns({c: F.when(known, F.col(c)) for c in ("DPD_AT_MONTH_END", "MAX_DPD_IN_MONTH")})


def monitored_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loan table the monitor reads; some scored loans have left it."""
    return feed_with_open_labels(spark, sf_dir).where(F.col("LOAN_ID") % 53 != 0).select(
        "SNAPSHOT_DATE", "LOAN_ID", "LABEL_HORIZON_DATE", "WORST_FUTURE_CAT")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as enrichment responses, one row per (event, endpoint)."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    v, u, i = F.col("value"), F.col("user_id"), F.col("event_id")
    return e.select(
        F.col("event_type").alias("endpoint"), u.cast("string").alias("NATIONAL_CODE"),
        F.when(v > 60, 3).when(v > 35, 2).when(k < 30, 1).otherwise(0).alias("CURRENT_CAT"),
        F.when(i % 9 != 0, (F.when(v > 60, 100 + k).otherwise(k) * 1000 + F.round(v * 100).cast("bigint"))
               / 1000.0).alias("am_due"),
        k.alias("k"), (k % 7).alias("grade"),
        F.when(i % 5 != 0, F.concat(F.lit("c"), ((u + k) % 4).cast("string"))).alias("region"),
        (k >= 50).alias("active"),
        F.concat(F.lit("n"), (u % 3).cast("string")).alias("family_name"),
        F.lit("v1").alias("version"), F.concat(F.lit("id"), i.cast("string")).alias("ref"),
        F.when(F.col("event_type") == "purchase", v * 2).alias("basket"),
        F.when(i == 1, 1.5).alias("rare"))


def listed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as customers with a list of 0 to 3 registry records, some fields inside one-member unions."""
    item = """transform(if(o_orderkey % 4 = 0, array(), sequence(1, cast(o_orderkey % 4 as int))), i -> named_struct(
        'bankCode', cast(15 + (o_orderkey + i) % 4 as int),
        'amMoavagh', named_struct('double', cast((o_custkey * i) % 5000 as double)),
        'status', named_struct('int', cast(1 + (o_orderkey * i) % 5 as int)),
        'date', cast(14000101 + ((o_orderkey * i) % 4) * 10000 + ((o_orderkey + i) % 12) * 100 + o_custkey % 28 as int),
        'emhalDate', 0,
        'reasonCode', named_struct('int', if(i = 3, array(cast(o_custkey % 6 as int), 9), array(cast(o_custkey % 6 as int)))),
        'code', concat('R', cast(o_custkey % 9 as string)),
        'description', concat('reason ', cast(o_custkey % 9 as string))))"""
    return read(spark, sf_dir, "orders").select(
        F.lit("registry").alias("endpoint"), F.col("o_orderkey").cast("string").alias("NATIONAL_CODE"),
        F.expr("cast(least(3, (o_custkey % 11) div 3) as int)").alias("CURRENT_CAT"),
        F.expr(item).alias("rows"))


LIST_AS_OF = 738965 + 500          # ordinal of the day the registry was read
OWN_BANK = 17
