"""Trends over snapshots: is history being deleted or is the book getting worse?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ... import constants as C
from ...functions.columns import ratio
from ..ranking import ranked_population


def per_snapshot_table(df: DataFrame, features: list[str] | None = None,
                       ranked_only: bool = False, n_loans: str = "N_LOANS_IN_PORTFOLIO",
                       loans: DataFrame | None = None) -> DataFrame:
    """One row per snapshot: size, customers, severe rate, portfolio size, means
    of the history features there are.

    ``df`` holds instances. At loan grain an instance is a loan row. At portfolio
    grain give the loan rows as ``loans``: they are counted, and features are
    averaged over them, for the customers and snapshots of the instances.
    """
    if ranked_only:
        df = ranked_population(df)
    rows = df if loans is None else loans.join(
        df.select("SNAPSHOT_DATE", "NATIONAL_CODE").distinct(), ["SNAPSHOT_DATE", "NATIONAL_CODE"], "left_semi")
    wanted = [f for f in (features or C.DELETION_CANARIES) if f in rows.columns]
    sizes = [F.count_distinct("NATIONAL_CODE").alias("n_customers"),
             F.avg((F.col("LABEL") == C.SEVERE).cast("double")).alias("severe_rate"), F.avg(n_loans).alias("mean_portfolio")]
    history = [F.count(F.lit(1)).alias("n_loan_rows"), *[F.avg(F.col(f).cast("double")).alias(f"mean_{f}") for f in wanted]]
    count = F.count(F.lit(1)).alias("n_instances")
    if loans is None:
        out = df.groupBy("SNAPSHOT_DATE").agg(count, *sizes, *history)
    else:
        out = df.groupBy("SNAPSHOT_DATE").agg(count, *sizes).join(rows.groupBy("SNAPSHOT_DATE").agg(*history), "SNAPSHOT_DATE", "left")
    return out.select("SNAPSHOT_DATE", "n_instances", "n_loan_rows", "n_customers", "severe_rate", "mean_portfolio",
                      *[f"mean_{f}" for f in wanted])


def trends(table: DataFrame) -> DataFrame:
    """Spearman rho of every series against snapshot order, first and last value.

    The table has one row per snapshot, so these windows are short. NULL with
    fewer than three points or a constant series.
    """
    series = [c for c in table.columns if c != "SNAPSHOT_DATE"]
    long = table.select("SNAPSHOT_DATE", *[F.col(c).cast("double").alias(c) for c in series]).unpivot(
        "SNAPSHOT_DATE", series, "series", "y")
    by = Window.partitionBy("series")
    long = long.withColumn("x", F.row_number().over(by.orderBy("SNAPSHOT_DATE")))
    ends = long.groupBy("series").agg(F.min_by("y", "SNAPSHOT_DATE").alias("first"),
                                      F.max_by("y", "SNAPSHOT_DATE").alias("last"))
    ok = long.where("y is not null and not isnan(y)")
    tied = F.count(F.lit(1)).over(Window.partitionBy("series", "y"))
    ok = ok.withColumn("r", F.rank().over(by.orderBy("y")) + (tied - 1) / 2.0)
    rho = ok.groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"),
        # not corr(): it divides by zero on a constant series
        ratio(F.covar_pop("r", F.col("x").cast("double")),
              F.stddev_pop("r") * F.stddev_pop("x")).alias("rho")).select(
        "series", F.when((F.col("n") >= 3) & (F.col("lo") < F.col("hi")), F.col("rho"))
        .alias("rho_vs_snapshot_order"))
    return ends.join(rho, "series", "left").select("series", "rho_vs_snapshot_order", "first", "last")


def verdict(trend: DataFrame, threshold: float = C.RHO_THRESHOLD) -> DataFrame:
    """One row: deletion_signature, deterioration or none, and the evidence."""
    rho, s = F.col("rho_vs_snapshot_order"), F.col("series")
    canary = s.startswith("mean_")
    out = trend.agg(
        F.max(F.when(s == "severe_rate", rho)).alias("severe_rho"),
        F.max(F.when(s == "severe_rate", F.col("first"))).alias("severe_first"),
        F.max(F.when(s == "severe_rate", F.col("last"))).alias("severe_last"),
        F.count_if(canary & (rho > threshold)).alias("n_hot"), F.count_if(canary).alias("n_series"))
    up = F.coalesce(F.col("severe_rho") > threshold, F.lit(False))
    return out.withColumn("verdict", F.when(up & (F.col("n_hot") > 0), "deletion_signature")
                          .when(up, "deterioration").otherwise("none"))
