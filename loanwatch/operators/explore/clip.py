"""What clipping a feature to its bounds costs.

Rows are reduced once to counts per (feature, category, distinct value); every
figure of the report comes from those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ... import constants as C
from ... import contract
from ...functions.columns import ratio
from ...functions.quantiles import quantiles
from ...session import pin, small_side
from ..preprocess import Preprocessor

SIDES = ("tail", "head")
STRATA = range(C.CARVE_CATEGORY)


def null_fractions(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, pct_null) before anything is filled in."""
    wide = df.agg(*[F.avg(F.col(f).isNull().cast("double")).alias(f) for f in features])
    return wide.unpivot([], features, "feature", "pct_null")


def reported_features(features: list[str], only: list[str] | None = None,
                      include_exempt: bool = False) -> list[str]:
    return [f for f in features if f not in contract.BINARY
            and (include_exempt or f not in contract.NO_CLIP)
            and (not only or f in only)]


def value_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, cat, v, n, n_sev) of finite values, NULL included."""
    sev = (F.col("LABEL") == C.SEVERE).cast("int")
    long = df.select(F.col("CURRENT_CAT").alias("cat"), sev.alias("__s"),
                     *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        ["cat", "__s"], features, "feature", "v")
    return long.where("v is null or abs(v) < double('infinity')").groupBy("feature", "cat", "v").agg(
        F.count(F.lit(1)).alias("n"), F.sum("__s").alias("n_sev"))


def bounds(counts: DataFrame, features: list[str]) -> DataFrame:
    """(feature, p1, p99): the clipper's own rule; declared ranges win."""
    q = quantiles(counts.where(~F.col("feature").isin(list(contract.CLIP_BOUNDS))), ["feature"], "v",
                  [0.01, 0.99], weight="n").groupBy("feature").agg(
        F.max(F.when(F.col("prob") == 0.01, F.col("value"))).alias("p1"),
        F.max(F.when(F.col("prob") == 0.99, F.col("value"))).alias("p99"))
    declared = [(f, *contract.CLIP_BOUNDS[f]) for f in features if f in contract.CLIP_BOUNDS]
    return q.unionByName(counts.sparkSession.createDataFrame(
        declared, "feature string, p1 double, p99 double"))


def clip_report(df: DataFrame, features: list[str], only: list[str] | None = None,
                ranked_only: bool = True, include_exempt: bool = False) -> DataFrame:
    """One row per feature. Bounds and merge counts cover all rows; lift and
    gradient cover the ranked rows (or all), and each queued category apart."""
    names = reported_features(features, only, include_exempt)
    nulls = null_fractions(df, names)
    counts = pin(value_counts(df, names))
    filled = Preprocessor(names).fit_fill(counts).imputed_counts(counts)
    return report_from_counts(filled, names, ranked_only).join(nulls, "feature", "left")


def report_from_counts(counts: DataFrame, names: list[str], ranked_only: bool) -> DataFrame:
    spec = small_side(bounds(counts, names))                  # one row per feature
    x = counts.join(spec, "feature")
    v, n, s = F.col("v"), F.col("n"), F.col("n_sev")
    hi, lo = v > F.col("p99"), v < F.col("p1")
    mask = (F.col("cat") < C.CARVE_CATEGORY) if ranked_only else F.lit(True)

    def total(cond: Column, what: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, what)), F.lit(0))

    aggs = [F.max("v").alias("max"), F.sum("n").alias("__n"),
            total(hi, n).alias("n_hi"), total(lo, n).alias("n_lo"),
            total(v == F.col("p99"), n).alias("__th"), total(v == F.col("p1"), n).alias("__tl"),
            F.count_distinct(F.when(hi, v)).alias("n_merged")]
    slices = {"": mask, **{f"_cat{k}": F.col("cat") == k for k in STRATA}}
    for name, cond in slices.items():
        aggs += [total(cond, n).alias(f"__bn{name}"), total(cond, s).alias(f"__bs{name}")]
        for side, beyond in (("tail", hi), ("head", lo)):
            aggs += [total(cond & beyond, n).alias(f"__{side}_n{name}"),
                     total(cond & beyond, s).alias(f"__{side}_s{name}")]
    out = x.groupBy("feature", "p1", "p99").agg(*aggs)
    spread = F.col("p99") - F.col("p1")
    cols = ["feature", F.col("feature").isin(sorted(contract.NO_CLIP)).alias("exempt"), "p1", "p99", "max",
            "n_hi", "n_lo", ratio(F.col("n_hi"), F.col("__n")).alias("pct_hi"),
            ratio(F.col("n_lo"), F.col("__n")).alias("pct_lo"),
            ratio(F.col("__th"), F.col("__n")).alias("pct_tied_hi"),
            ratio(F.col("__tl"), F.col("__n")).alias("pct_tied_lo"), "n_merged",
            F.when(spread > 0, F.greatest(F.lit(0.0), (F.col("max") - F.col("p99")) / spread)).alias("tail_span")]
    for name in slices:
        base = ratio(F.col(f"__bs{name}"), F.col(f"__bn{name}"))
        for side, end in (("tail", "hi"), ("head", "lo")):
            cols.append((ratio(F.col(f"__{side}_s{name}"), F.col(f"__{side}_n{name}"))
                         / F.when(base > 0, base)).alias(f"{side}_lift{name}"))
            if name:
                cols.append(F.col(f"__{side}_n{name}").alias(f"n_{end}{name}"))
    out = out.select(*cols)
    return out.join(_gradients(x, mask), "feature", "left")


def _gradients(x: DataFrame, mask: Column) -> DataFrame:
    """Severe rate of a clipped region's outer quartile over its inner one.

    NULL when the region has too few rows or events or only one value.
    """
    side = F.when(F.col("v") > F.col("p99"), "tail").when(F.col("v") < F.col("p1"), "head")
    names = F.array_compact(F.array(
        F.when(mask, ""), F.when(F.col("cat") < C.CARVE_CATEGORY,
                                 F.concat(F.lit("_cat"), F.col("cat").cast("string")))))
    region = x.withColumn("side", side).where("side is not null").select(
        "feature", "side", F.explode(names).alias("slice"), "v", "n", "n_sev")
    by = ["feature", "side", "slice"]
    cuts = quantiles(region, by, "v", [0.25, 0.75], weight="n").groupBy(*by).agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("c_lo"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("c_hi"))
    z = region.join(small_side(cuts), by)                    # features x sides x slices
    top, bottom = F.col("v") >= F.col("c_hi"), F.col("v") <= F.col("c_lo")
    far = F.when(F.col("side") == "tail", top).otherwise(bottom)
    near = F.when(F.col("side") == "tail", bottom).otherwise(top)
    per = z.groupBy(*by, "c_lo", "c_hi").agg(
        F.sum("n").alias("n"),
        *[F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).alias(f"{c}_{w}")
          for w, cond in (("far", far), ("near", near)) for c in ("n", "n_sev")])
    ok = ((F.col("n") >= C.CLIP_MIN_TAIL_ROWS) & (F.col("c_lo") < F.col("c_hi"))
          & (F.col("n_sev_far") + F.col("n_sev_near") >= C.CLIP_MIN_EVENTS))
    rate = ratio(F.col("n_sev_near"), F.col("n_near"))
    grad = F.when(ok, ratio(F.col("n_sev_far"), F.col("n_far")) / F.when(rate > 0, rate))
    per = per.select("feature", F.concat("side", F.lit("_gradient"), "slice").alias("name"), grad.alias("g"))
    wanted = [f"{s}_gradient{n}" for s in SIDES for n in ("", *[f"_cat{k}" for k in STRATA])]
    return per.groupBy("feature").pivot("name", wanted).agg(F.max("g"))


def side_verdict(side: str, lift_thr: float = C.CLIP_LIFT_THRESHOLD,
                 grad_thr: float = C.CLIP_GRADIENT_THRESHOLD) -> Column:
    """none, tiny, ramp, swamped (or both), block, inert for one end.

    A category's figures count only when its own region is large enough.
    """
    end = "hi" if side == "tail" else "lo"

    def figures(kind):
        out = [F.col(f"{side}_{kind}")]
        out += [F.when(F.col(f"n_{end}_cat{k}") >= C.CLIP_MIN_TAIL_ROWS, F.col(f"{side}_{kind}_cat{k}"))
                for k in STRATA]
        return F.array(*out)
    merged = F.coalesce(F.col(f"pct_{end}"), F.lit(0.0))
    ramp = F.exists(figures("gradient"), lambda g: F.coalesce(g > grad_thr, F.lit(False)))
    informative = F.exists(figures("lift"), lambda v: F.coalesce(
        (v > lift_thr) | (v < 1.0 / lift_thr), F.lit(False)))
    swamped = informative & (F.col(f"pct_tied_{end}") >= C.SWAMP_RATIO * merged)
    return (F.when(merged <= 0, "none").when(F.col(f"n_{end}") < C.CLIP_MIN_TAIL_ROWS, "tiny")
            .when(ramp & swamped, "ramp+swamped").when(ramp, "ramp").when(swamped, "swamped")
            .when(informative, "block").otherwise("inert"))


def with_verdicts(report: DataFrame, **kw) -> DataFrame:
    return report.withColumns({f"{s}_verdict": side_verdict(s, **kw) for s in SIDES})


def against_baseline(report: DataFrame, baseline: DataFrame) -> DataFrame:
    """p99 and maximum of an older data set next to today's."""
    old = baseline.select("feature", F.col("p99").alias("p99_before"), F.col("max").alias("max_before"))
    return report.join(old, "feature", "left").withColumn(
        "p99_ratio", F.col("p99") / F.when(F.col("p99_before") != 0, F.col("p99_before")))


def findings(report: DataFrame) -> DataFrame:
    """(feature, finding): degenerate bounds, high null rate, costly clips,
    harmless blocks, exemptions that are justified or idle."""
    costly = F.col("tail_verdict").rlike("^(ramp|swamped)") | F.col("head_verdict").rlike("^(ramp|swamped)")
    block = (F.col("tail_verdict") == "block") | (F.col("head_verdict") == "block")
    kinds = F.array_compact(F.array(
        F.when(F.col("p1") >= F.col("p99"), "degenerate"),
        F.when(F.col("pct_null") > C.CLIP_HIGH_NULL_RATE, "high_null_rate"),
        F.when(F.col("exempt") & costly, "exemption_justified"),
        F.when(F.col("exempt") & ~costly, "exemption_idle"),
        F.when(~F.col("exempt") & costly, "clip_costs"),
        F.when(~F.col("exempt") & ~costly & block, "block_only")))
    return report.select("feature", F.explode(kinds).alias("finding"))
