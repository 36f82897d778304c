"""Readers for the loan table and the small ledgers around it."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.columns import null_if_nan

log = logging.getLogger(__name__)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL compare differently; keep only NULL from here on."""
    floats = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: null_if_nan(F.col(c)) for c in floats}) if floats else df


def training_rows(loans: DataFrame, snapshot_dates: list[int] | None = None) -> DataFrame:
    """Rows of the wanted snapshots, all when none are named. On a table
    partitioned by snapshot the literal list prunes partitions."""
    if snapshot_dates:
        loans = loans.where(F.col("SNAPSHOT_DATE").isin([int(s) for s in snapshot_dates]))
    return loans


def prediction_rows(loans: DataFrame, snapshot_date: int | None = None) -> DataFrame:
    """One snapshot for scoring, without the label columns."""
    if snapshot_date:
        loans = loans.where(F.col("SNAPSHOT_DATE") == int(snapshot_date))
    return loans.drop("WORST_FUTURE_CAT", "WORST_FUTURE_DPD")


def available_snapshots(loans: DataFrame) -> DataFrame:
    """Distinct snapshots, ascending."""
    return loans.select("SNAPSHOT_DATE").distinct().orderBy("SNAPSHOT_DATE")


def label_ledger(table: DataFrame) -> DataFrame:
    """One row per finalised snapshot: tidy status, counts NULL where unknown."""
    cols = [F.col("SNAPSHOT_DATE").cast("bigint").alias("SNAPSHOT_DATE"),
            F.upper(F.trim("STATUS")).alias("STATUS"),
            F.col("LOANS_UNLABELLED").cast("bigint").alias("LOANS_UNLABELLED"),
            F.col("LOANS_MISSING_MONTHS").cast("bigint").alias("LOANS_MISSING_MONTHS")]
    if "FINALIZED_AT" in table.columns:
        cols.append(F.col("FINALIZED_AT"))
    return table.select(*cols)


def label_horizons(loans: DataFrame) -> DataFrame:
    """Snapshot to label horizon, for display only; empty without the column."""
    if "LABEL_HORIZON_DATE" not in loans.columns:
        return loans.select("SNAPSHOT_DATE", F.lit(None).cast("bigint")
                            .alias("LABEL_HORIZON_DATE")).where(F.lit(False))
    return loans.select("SNAPSHOT_DATE", "LABEL_HORIZON_DATE").dropna().distinct()


def load_runs(job_control: DataFrame, job: str, limit: int = 24) -> DataFrame:
    """The newest load attempts of the monthly job."""
    cols = [F.col("RUN_MONTH").alias("SNAPSHOT_DATE"), "STATUS", "LAST_STEP", "ERROR_MESSAGE"]
    return (job_control.where(F.col("JOB_NAME") == job)
            .orderBy(F.col("RUN_MONTH").desc(), F.col("END_TIME").desc_nulls_last())
            .limit(int(limit)).select(*cols))


def incomplete_runs(runs: DataFrame) -> DataFrame:
    """Attempts that did not report SUCCESS (a NULL status counts)."""
    return runs.where(~F.upper("STATUS").eqNullSafe("SUCCESS"))


def build_times(job_control: DataFrame, job: str) -> DataFrame:
    """When each snapshot was built: the newest SUCCESS attempt's end time."""
    return (job_control.where((F.col("JOB_NAME") == job) & (F.col("STATUS") == "SUCCESS")
                              & F.col("END_TIME").isNotNull())
            .groupBy(F.col("RUN_MONTH").alias("SNAPSHOT_DATE"))
            .agg(F.max("END_TIME").alias("END_TIME")))


def read_called_log(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The call ledger CSV; a missing file or column means there is none."""
    if not path:
        return None
    try:
        df = spark.read.csv(path, header=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        log.warning("call ledger not found: %s, RECENTLY_CALLED is skipped", path)
        return None
    missing = {"NATIONAL_CODE", "CALLED_AT"} - set(df.columns)
    if missing:
        log.warning("call ledger %s lacks %s, ignored", path, sorted(missing))
        return None
    return df.select("NATIONAL_CODE", F.col("CALLED_AT").try_cast("timestamp").alias("CALLED_AT"))


def resolve_column(df: DataFrame, *names: str, required: bool = True) -> str | None:
    """The frame's column under one of several spellings: exact, then any case."""
    for n in names:
        if n in df.columns:
            return n
    lower = {c.lower(): c for c in df.columns}
    for n in names:
        if n.lower() in lower:
            return lower[n.lower()]
    if required:
        raise ValueError(f"none of the columns {list(names)} found; there are {df.columns}")
    return None


def score_table(df: DataFrame) -> DataFrame:
    """Any scored table as risk, current_cat and, when present, y_true, pred_class."""
    wanted = {
        "risk": (("RISK_SCORE", "p3", "P_SEVERE_PAST_DUE"), "double", True),
        "current_cat": (("current_cat", "CURRENT_CAT"), "int", True),
        "y_true": (("y_true",), "int", False),
        "pred_class": (("pred_class", "PREDICTED_CLASS"), "int", False),
    }
    cols = []
    for out, (names, dtype, required) in wanted.items():
        c = resolve_column(df, *names, required=required)
        if c:
            cols.append(F.col(c).cast(dtype).alias(out))
    ids = [c for c in ("LOAN_ID", "SNAPSHOT_DATE") if c in df.columns]
    return df.select(*ids, *cols)
