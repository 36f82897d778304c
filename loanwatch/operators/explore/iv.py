"""Information value and weight of evidence of every feature, one-vs-rest.

Rows are reduced once to counts per (feature, distinct value); binning and all
classes work on those counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ... import constants as C
from ...functions.quantiles import quantiles
from ...session import pin, small_side

CLASSES = range(C.NUM_CLASSES)
MIN_ROWS = 10


def value_counts(df: DataFrame, features: list[str], label: str = "LABEL") -> DataFrame:
    """(feature, v, n, n0..n3) over finite values."""
    finite = [F.when(F.abs(F.col(f).cast("double")) < float("inf"), F.col(f).cast("double")).alias(f)
              for f in features]
    long = df.select(F.col(label).alias("__y"), *finite).unpivot("__y", features, "feature", "v")
    return long.where("v is not null").groupBy("feature", "v").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("__y") == k).alias(f"n{k}") for k in CLASSES])


def bins(counts: DataFrame, n_bins: int = 10) -> DataFrame:
    """One row per usable feature: inner edges and, for mode-dominated
    features, the value that gets a bin of its own.

    Fewer than two values or ten rows: no bins. Up to ``n_bins`` values: one bin
    each. Else quantile edges; when those collapse, the median value stands
    alone and the rest is quantile-binned.
    """
    probs = sorted({i / n_bins for i in range(n_bins + 1)} | {0.5})
    size = counts.groupBy("feature").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct"),
        # only kept when there are few: at most n_bins values
        F.when(F.count(F.lit(1)) <= n_bins, F.lit(True)).alias("few"))
    few = counts.join(small_side(size.where("few")), "feature").groupBy("feature").agg(
        F.array_sort(F.collect_list("v")).alias("values"))
    q = quantiles(counts, ["feature"], "v", probs, weight="n")
    grid = F.col("prob").isin([i / n_bins for i in range(n_bins + 1)])
    edge = q.groupBy("feature").agg(
        F.array_sort(F.collect_set(F.when(grid, F.col("value")))).alias("edges"),
        F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("median"))
    spec = size.join(edge, "feature").join(few, "feature", "left").where(
        (F.col("rows") >= MIN_ROWS) & (F.col("distinct") >= 2))
    spec = small_side(spec)                                # one row per feature
    heavy = spec.where(F.col("values").isNull() & (F.size("edges") < 3)).select("feature", "median")
    rest = counts.join(heavy, "feature").where(F.col("v") != F.col("median"))
    sub = quantiles(rest, ["feature"], "v", [i / n_bins for i in range(n_bins + 1)], weight="n")
    sub = sub.groupBy("feature").agg(F.array_sort(F.collect_set("value")).alias("sub"))

    def inner(e):
        return F.slice(e, F.lit(2), F.greatest(F.size(e) - 2, F.lit(0)))
    out = spec.join(small_side(sub), "feature", "left")
    return out.select(
        "feature", "rows",
        F.when(F.col("values").isNotNull(), F.slice("values", F.lit(2), F.size("values")))
        .when(F.col("sub").isNull(), inner(F.col("edges"))).otherwise(inner(F.col("sub"))).alias("inner"),
        F.when(F.col("sub").isNotNull(), F.col("median")).alias("mode"))


def woe_bins(counts: DataFrame, spec: DataFrame) -> DataFrame:
    """(feature, class, bin, count, event, ..., woe, iv_contribution)."""
    above = F.size(F.filter("inner", lambda e: e <= F.col("v")))
    number = F.when(F.col("mode").isNull(), above).when(F.col("v") == F.col("mode"), 0).otherwise(above + 1)
    per = counts.join(spec, "feature").groupBy("feature", number.alias("bin")).agg(
        F.sum("n").alias("count"), *[F.sum(f"n{k}").alias(f"n{k}") for k in CLASSES])
    classes = F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"n{k}").alias("event"))
                        for k in CLASSES])
    per = per.select("feature", "bin", "count", F.inline(classes))
    totals = per.groupBy("feature", "class").agg(
        F.greatest(F.sum("event"), F.lit(1)).alias("te"),
        F.greatest(F.sum(F.col("count") - F.col("event")), F.lit(1)).alias("tn"))
    x = per.join(totals, ["feature", "class"])
    de = F.greatest(F.col("event").cast("double"), F.lit(0.5)) / F.col("te")
    dn = F.greatest((F.col("count") - F.col("event")).cast("double"), F.lit(0.5)) / F.col("tn")
    x = x.withColumns({"non_event": F.col("count") - F.col("event"),
                       "dist_event": de, "dist_non_event": dn})
    woe = F.log(F.greatest(F.col("dist_event") / F.col("dist_non_event"), F.lit(1e-9)))
    return x.withColumn("woe", woe).withColumn(
        "iv_contribution", (F.col("dist_event") - F.col("dist_non_event")) * F.col("woe")).drop("te", "tn")


def information_values(df: DataFrame, features: list[str], label: str = "LABEL",
                       n_bins: int = 10) -> DataFrame:
    """One row per feature: iv_ovr0..3, iv_max, iv_mean, strongest first."""
    counts = pin(value_counts(df, features, label))
    woe = woe_bins(counts, small_side(bins(counts, n_bins)))
    wide = woe.groupBy("feature").pivot("class", list(CLASSES)).agg(F.sum("iv_contribution"))
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    iv = [F.coalesce(F.col(str(k)), F.lit(0.0)) for k in CLASSES]
    total = iv[0]
    for c in iv[1:]:
        total = total + c
    return names.join(wide, "feature", "left").select(
        "feature", *[F.round(c, 5).alias(f"iv_ovr{k}") for k, c in enumerate(iv)],
        F.round(F.greatest(*iv), 5).alias("iv_max"),
        F.round(total / float(C.NUM_CLASSES), 5).alias("iv_mean")).orderBy(F.col("iv_max").desc(), "feature")


def coverage(ivs: DataFrame) -> DataFrame:
    """How many features are strong, medium, useless for each class."""
    long = ivs.unpivot("feature", [f"iv_ovr{k}" for k in CLASSES], "target", "iv")
    return long.groupBy("target").agg(
        F.count_if(F.col("iv") >= 0.10).alias("strong"),
        F.count_if((F.col("iv") >= 0.02) & (F.col("iv") < 0.10)).alias("medium"),
        F.count_if(F.col("iv") < 0.02).alias("useless"))
