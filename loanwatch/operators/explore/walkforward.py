"""Walk-forward stability from a long metrics table.

Input rows: FOLD_ID, TEST_SNAP, VAL_SNAP, N_TRAIN_SNAPS, ARM, DEPLOYED,
SLICE, METRIC, VALUE. Slices used: "ranking" (pooled), "cat0", "class".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ... import constants as C

FOLD = ["FOLD_ID", "TEST_SNAP", "VAL_SNAP", "N_TRAIN_SNAPS"]


def _value(slice_: str, metric: str):
    return F.max(F.when((F.col("SLICE") == slice_) & (F.col("METRIC") == metric), F.col("VALUE")))


def with_min_train(metrics: DataFrame, min_n: int) -> DataFrame:
    """Folds with at least ``min_n`` training snapshots."""
    return metrics.where(F.col("N_TRAIN_SNAPS") >= min_n)


def deployed_arm_table(metrics: DataFrame) -> DataFrame:
    """The deployed arm's headline numbers, one row per fold."""
    return metrics.where("DEPLOYED").groupBy(*FOLD, F.col("ARM").alias("DEPLOYED_ARM")).agg(
        _value("ranking", "pr_auc").alias("pooled_AP"), _value("cat0", "pr_auc").alias("cat0_AP"),
        *[_value("ranking", f"recall_{w}").alias(f"recall_{w}") for w in C.REF_WINDOWS],
        _value("class", "macro_f1").alias("macro_f1"))


def arm_comparison(metrics: DataFrame, arms: list[str]) -> DataFrame:
    """Pooled AP of every arm side by side per fold."""
    ap = metrics.where("SLICE = 'ranking' and METRIC = 'pr_auc'")
    out = ap.groupBy(*FOLD).pivot("ARM", arms).agg(F.max("VALUE"))
    return out.withColumnsRenamed({a: f"{a}_AP" for a in arms})


def arm_stability(metrics: DataFrame) -> DataFrame:
    """Per arm over folds: mean, population std, range and share of folds won."""
    ap = metrics.where("SLICE = 'ranking' and METRIC = 'pr_auc'").withColumn(
        "VALUE", F.when(~F.isnan("VALUE"), F.col("VALUE")))
    best = Window.partitionBy("FOLD_ID").orderBy(F.col("VALUE").desc_nulls_last(), "ARM")  # few arms
    won = F.when((F.row_number().over(best) == 1) & F.col("VALUE").isNotNull(), 1).otherwise(0)
    ap = ap.withColumn("WON", won)
    per = ap.groupBy("ARM").agg(
        F.count("VALUE").alias("n_folds"), F.avg("VALUE").alias("mean_AP"),
        F.stddev_pop("VALUE").alias("std_AP"), F.min("VALUE").alias("min_AP"),
        F.max("VALUE").alias("max_AP"), F.sum("WON").alias("__won"))
    total = F.sum("__won").over(Window.partitionBy(F.lit(0)))             # one row per arm
    return per.withColumn("fold_win_rate", F.col("__won") / F.when(total > 0, total)).drop("__won")


def unstable_folds(deployed: DataFrame, threshold: float = C.UNSTABLE_AP) -> DataFrame:
    return deployed.where(F.col("pooled_AP") < threshold)
