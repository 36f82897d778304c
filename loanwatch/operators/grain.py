"""What one row is: a loan, or a customer's portfolio at a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.columns import cap_category
from ..functions.quantiles import quantiles
from .clean import canonical_order

KEYS = ["NATIONAL_CODE", "SNAPSHOT_DATE"]
#: A portfolio of more loans is combined where its rows lie, before they are shuffled.
HEAVY = 100_000
#: Rows to a task that combines portfolios.
TASK_ROWS = 200_000


def loan_rows(df: DataFrame) -> DataFrame:
    """Loan grain: every row, plus the customer's loan count at the snapshot.

    Counted by aggregate and joined back (not a window), so a customer with
    very many loans is counted map-side and AQE may split its join partition.
    """
    sizes = df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("N_LOANS_IN_PORTFOLIO"))
    right = sizes.select(F.col("NATIONAL_CODE").alias("__nc"), F.col("SNAPSHOT_DATE").alias("__sd"),
                         "N_LOANS_IN_PORTFOLIO")
    on = df["NATIONAL_CODE"].eqNullSafe(right["__nc"]) & (df["SNAPSHOT_DATE"] == right["__sd"])
    return df.join(right, on).drop("__nc", "__sd")


def worst_loans(df: DataFrame, max_loans: int) -> DataFrame:
    """The currently worst loans of each portfolio, never chosen by a label.

    Spark turns the rank filter into a per-task group limit before the shuffle.
    """
    w = Window.partitionBy(*KEYS).orderBy(*canonical_order()[2:])
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max_loans).drop("__r")


def _portfolio_facts(df: DataFrame, exposure: str | None, category: str, label: str) -> list:
    aggs = [F.count(F.lit(1)).alias("N_LOANS"), cap_category(F.max(category)).alias("CURRENT_CAT")]
    if label in df.columns:
        aggs.append(cap_category(F.max(label)).alias("LABEL"))
    if exposure:
        aggs.append(F.sum(exposure).alias("EXPOSURE"))
    return aggs


def portfolio_rows(df: DataFrame, exposure: str | None = None) -> DataFrame:
    """Portfolio grain without features: label and category over all loans."""
    return df.groupBy(*KEYS).agg(*_portfolio_facts(df, exposure, "LOAN_CATEGORY", "WORST_FUTURE_CAT"))


def portfolio_feature_names(features: list[str]) -> list[str]:
    return ([f"{s}_{f}" for s in ("MIN", "MAX", "MEAN", "STD") for f in features] + ["N_LOANS"])


def portfolio_features(df: DataFrame, features: list[str], max_loans: int | None = None,
                       exposure: str | None = None, category: str = "LOAN_CATEGORY",
                       label: str = "WORST_FUTURE_CAT", keys: list[str] | None = None, deal: bool = True) -> DataFrame:
    """Portfolio grain: min, max, mean, population std per feature and counts.

    With ``max_loans`` the statistics cover the worst loans only while label,
    category and count still cover all of them. ``category`` and ``label`` name
    the raw columns when the features themselves have been rescaled. ``deal``
    sends rows to their portfolio's task before they are combined; means and
    deviations then differ in their last bits from those combined map-side.
    """
    keys = keys or KEYS
    stats = []
    for f in features:
        stats += [F.min(f).alias(f"MIN_{f}"), F.max(f).alias(f"MAX_{f}"),
                  F.avg(f).alias(f"MEAN_{f}"), F.stddev_pop(f).alias(f"STD_{f}")]
    facts = _portfolio_facts(df, exposure, category, label)
    if max_loans is None:
        out = _combined(df, keys, [*facts, *stats]) if deal else df.groupBy(*keys).agg(*facts, *stats)
    else:
        kept = worst_loans(df, max_loans).groupBy(*keys).agg(*stats)
        out = df.groupBy(*keys).agg(*facts).join(kept, keys)
    names = portfolio_feature_names(features)
    return out.select(*[c for c in out.columns if c not in names], *names)


def _combined(df: DataFrame, keys: list[str], aggs: list) -> DataFrame:
    """``df.groupBy(*keys).agg(*aggs)`` for many statistics of mostly small groups.

    Seven numbers a feature travel if rows are combined before the shuffle, which
    hardly lessens rows of small groups. So the rows themselves are dealt by key, to as
    many tasks as their number asks for. Only groups of more than ``HEAVY`` rows,
    found by a count before, are combined before the shuffle.
    """
    spark = df.sparkSession
    named = [F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)]
    sizes = df.groupBy(*named).agg(F.count(F.lit(1)).alias("__n"))
    heavy = F.collect_list(F.when(F.col("__n") > HEAVY, F.struct(*[c for c in sizes.columns if c != "__n"])))
    total = sizes.agg(F.sum("__n").alias("rows"), heavy.alias("heavy")).first()         # of HEAVY rows, one key at most
    tasks = max(spark.sparkContext.defaultParallelism, -(-(total["rows"] or 0) // TASK_ROWS))
    light, parts = df, []
    if total["heavy"]:
        few = F.broadcast(spark.createDataFrame(total["heavy"], sizes.drop("__n").schema))
        here = F.lit(True)
        for i, k in enumerate(keys):
            here = here & df[k].eqNullSafe(few[f"__h{i}"])
        light = df.join(few, here, "left_anti")
        parts = [df.join(few, here, "left_semi").groupBy(*keys).agg(*aggs)]
    out = light.repartition(tasks, *keys).groupBy(*keys).agg(*aggs)
    for p in parts:
        out = out.unionByName(p)
    return out


def portfolio_means(df: DataFrame, features: list[str]) -> DataFrame:
    """The mean loan of each portfolio."""
    keep = [cap_category(F.max(c)).alias(n) for c, n in
            (("WORST_FUTURE_CAT", "LABEL"), ("LOAN_CATEGORY", "CURRENT_CAT")) if c in df.columns]
    return df.groupBy(*KEYS).agg(*keep, *[F.avg(F.col(f).cast("double")).alias(f) for f in features])


def build_features(df: DataFrame, features: list[str], grain: str = "loan") -> DataFrame:
    """Rows ready for a model at a grain; a repeated loan key is an error."""
    if grain == "portfolio":
        return portfolio_features(df, features)
    if grain != "loan":
        raise ValueError(f"unknown grain {grain!r}")
    dup = df.groupBy("LOAN_ID", "SNAPSHOT_DATE").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    if not dup.isEmpty():
        raise ValueError("loan grain needs one row per (LOAN_ID, SNAPSHOT_DATE)")
    return loan_rows(df)


def feature_names(features: list[str], grain: str = "loan") -> list[str]:
    return list(features) if grain == "loan" else portfolio_feature_names(features)


def loans_per_customer(df: DataFrame, method: str = "exact") -> DataFrame:
    """99th percentile (cut to a whole number) and largest loan count."""
    per = df.groupBy("NATIONAL_CODE").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("NATIONAL_CODE").isNotNull())
    p99 = quantiles(per, [], "n", [0.99], method).select(F.floor("value").alias("v"))
    top = per.agg(F.max("n").alias("v"))
    return (p99.select(F.lit("p99").alias("stat"), "v")
            .unionByName(top.select(F.lit("max").alias("stat"), "v")))


def with_exposure(df: DataFrame, feature: str = C.EXPOSURE_FEATURE) -> DataFrame:
    """Value at risk per loan row, taken from the raw feature."""
    return df.withColumn("EXPOSURE", F.col(feature).cast("double"))
