"""Table profile and class-proportional sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ... import constants as C
from ...functions.columns import cap_category
from ...functions.position import with_position
from ..grain import loans_per_customer
from ..maturity import mature_snapshots


def profile(loans: DataFrame, ledger: DataFrame, method: str = "exact") -> DataFrame:
    """(section, item, value) rows.

    Rows per snapshot; loans per customer and category mix on the newest
    snapshot; label mix on the newest mature one; missing percentages.
    """
    per = loans.groupBy("SNAPSHOT_DATE").agg(F.count(F.lit(1)).alias("v"))
    newest = loans.agg(F.max("SNAPSHOT_DATE")).first()[0]
    label_snap = mature_snapshots(loans, ledger).agg(F.max("SNAPSHOT_DATE")).first()[0]
    now = loans.where(F.col("SNAPSHOT_DATE") == newest)

    def rows(df, section, item, value="v"):
        return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"),
                         F.col(value).cast("double").alias("value"))

    def mix(df, col, section):
        return rows(df.where(col.isNotNull()).groupBy(col.alias("c")).agg(F.count(F.lit(1)).alias("v")),
                    section, F.col("c"))
    cat, lab = F.col("LOAN_CATEGORY"), F.col("WORST_FUTURE_CAT")
    out = rows(per, "rows_per_snapshot", F.col("SNAPSHOT_DATE"))
    out = out.unionByName(rows(loans_per_customer(now, method), "loans_per_customer", F.col("stat")))
    out = out.unionByName(mix(now, cat, "category_raw"))
    out = out.unionByName(mix(now, cap_category(cat), "category_capped"))
    if label_snap is not None:
        final = loans.where(F.col("SNAPSHOT_DATE") == label_snap)
        out = out.unionByName(mix(final, lab, "label_raw"))
        out = out.unionByName(mix(final, cap_category(lab), "label_capped"))
    names = loans.columns
    miss = now.agg(*[F.round(F.avg(F.col(c).isNull().cast("double")) * 100, 2).alias(c) for c in names])
    miss = miss.unpivot([], names, "c", "v").where("v > 0")
    return out.unionByName(rows(miss, "missing_pct", F.col("c")))


def stratified_sample(df: DataFrame, size: int, label: str = "LABEL", keys=("LOAN_ID", "SNAPSHOT_DATE"),
                      seed: int = C.SEED) -> DataFrame:
    """About ``size`` rows with the class shares kept, at least one per class.

    Rows are drawn in the order of a seeded hash; a class of any size may span
    tasks, since it is ranked by range and not in one window.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()    # one row per class
    total = sum(r["n"] for r in counts)
    if total <= size:
        return df
    quota = F.lit(0)
    for r in counts:
        q = max(1, round(size * r["n"] / total))
        quota = F.when(F.col(label).eqNullSafe(F.lit(r[label])), q).otherwise(quota)
    order = [F.xxhash64(F.lit(seed), *keys).asc(), *[F.col(k).asc() for k in keys]]
    return with_position(df, order, within=[label], name="__r").where(F.col("__r") <= quota).drop("__r")
