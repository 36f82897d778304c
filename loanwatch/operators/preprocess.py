"""Impute, clip, scale: fitted on training rows, one small row per feature.

The three fits run in order on raw, imputed and clipped values; each alone works
on counts of distinct values, ``fit`` does all three on rows. Statistics are kept by feature name, so column order cannot apply one feature's numbers to another.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contract
from ..functions.quantiles import order_statistics, quantiles
from ..session import dropped_pins, pin
from .clean import ContractError


def feature_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, v, n): how often each value occurs, NULL included.

    Everything the fits need is in these counts, so the rows are read once.
    """
    return df.select(*[F.col(c).cast("double").alias(c) for c in features]).unpivot(
        [], features, "feature", "v").groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))


def _collect_quantiles(counts, features, probs, method) -> dict[str, dict[float, float]]:
    """Quantiles per feature on the driver: features x probs numbers."""
    out: dict[str, dict[float, float]] = {f: {} for f in features}
    if features:
        part = counts.where(F.col("feature").isin(features))
        for r in quantiles(part, ["feature"], "v", probs, method,
                           weight=None if method == "approx" else "n").collect():
            out[r["feature"]][r["prob"]] = r["value"]
    return out


def _per_feature(values: dict[str, float]):
    """A feature's own number, by name."""
    return F.element_at(F.create_map(*[x for f, v in values.items() for x in (F.lit(f), F.lit(float(v)))]),
                        F.col("feature"))


def _ends(p: float, n: int) -> tuple[int, int, float]:
    """Ranks that quantile p of n values lies between, and how far."""
    h = p * (n - 1)
    lo = int(h // 1)
    return lo, min(lo + 1, n - 1), h - lo


def _between(p: float, n: int, value: Callable[[int], float]) -> float:
    lo, hi, frac = _ends(p, n)
    a = value(lo)
    return a if frac == 0 else a + (value(hi) - a) * frac


@dataclass
class Preprocessor:
    """Fitted statistics by feature name."""

    features: list[str]
    fill: dict[str, float] = field(default_factory=dict)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    center: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    # -- fit -------------------------------------------------------------------
    def fit_fill(self, counts: DataFrame, method: str = "exact") -> "Preprocessor":
        """Never-happened days: maximum + 1. Amounts and ratios: median. Else 0."""
        days = [f for f in self.features if f.startswith("DAYS_SINCE")]
        med = [f for f in self.features if f not in days and ("AMNT" in f or "RATIO" in f)]
        self.fill = dict.fromkeys(self.features, 0.0)
        if days:
            top = {r["feature"]: r["m"] for r in counts.where(F.col("feature").isin(days)).groupBy(
                "feature").agg(F.max("v").alias("m")).collect()}         # one row per feature
            self.fill.update({f: 9999.0 if top.get(f) is None else top[f] + 1.0 for f in days})
        q = _collect_quantiles(counts, med, [0.5], method)
        self.fill.update({f: q[f].get(0.5, 0.0) for f in med})
        return self

    def fit_bounds(self, imputed: DataFrame, method: str = "exact") -> "Preprocessor":
        """[p1, p99] of imputed counts; a declared range wins; flags are exempt."""
        clipped = [f for f in self.features
                   if f not in contract.BINARY and f not in contract.NO_CLIP]
        declared = {f: contract.CLIP_BOUNDS[f] for f in clipped if f in contract.CLIP_BOUNDS}
        sampled = [f for f in clipped if f not in declared]
        q = _collect_quantiles(imputed, sampled, [0.01, 0.99], method)
        self.bounds = {f: declared.get(f) or (q[f][0.01], q[f][0.99]) for f in clipped
                       if f in declared or q[f]}
        return self

    def fit_scale(self, clipped: DataFrame, method: str = "exact") -> "Preprocessor":
        """Median and quartile range of clipped counts; a zero range divides by 1."""
        scaled = [f for f in self.features
                  if f not in contract.BINARY and f not in contract.NO_SCALE]
        q = _collect_quantiles(clipped, scaled, [0.25, 0.5, 0.75], method)
        for f in scaled:
            if q[f]:
                self.center[f] = q[f][0.5]
                span = q[f][0.75] - q[f][0.25]
                self.scale[f] = span if span != 0 else 1.0
        return self

    def imputed_counts(self, counts: DataFrame) -> DataFrame:
        return counts.withColumn("v", F.coalesce(F.col("v"), _per_feature(self.fill)))

    def clipped_counts(self, imputed: DataFrame) -> DataFrame:
        if not self.bounds:
            return imputed
        lo = _per_feature({f: b[0] for f, b in self.bounds.items()})
        hi = _per_feature({f: b[1] for f, b in self.bounds.items()})
        return imputed.withColumn("v", F.when(lo.isNull(), F.col("v")).otherwise(
            F.greatest(lo, F.least(hi, F.col("v")))))

    def fit(self, df: DataFrame, method: str = "exact") -> "Preprocessor":
        """All three fits from one set of order statistics of the raw values.

        Filling puts the NULLs at one known place of the order and clipping
        keeps the order, so the values that later fits interpolate between are
        raw values at known ranks, the fill, or a bound. The narrow feature
        table is written once and read by each pass. With ``method="approx"``
        the rows are sketched, one pass per fit.
        """
        if method == "approx":
            return self._fit_approx(df)
        with dropped_pins(df.sparkSession):
            return self._fit_exact(df)

    def _fit_exact(self, df: DataFrame) -> "Preprocessor":
        long = pin(df.select(*[F.col(c).cast("double").alias(c) for c in self.features])).unpivot(
            [], self.features, "feature", "v")
        sizes = {r["feature"]: (r["rows"], r["n"], r["top"]) for r in long.groupBy("feature").agg(
            F.count(F.lit(1)).alias("rows"), F.count("v").alias("n"), F.max("v").alias("top")).collect()}   # one row per feature
        ranks = {f: sorted({q for p in (0.01, 0.25, 0.5, 0.75, 0.99) for r in _ends(p, rows)[:2] for q in (r, r - rows + n)}
                           | {*_ends(0.5, n)[:2]}) for f, (rows, n, _) in sizes.items()}
        wanted = F.from_json(F.lit(json.dumps({f: [{"id": r, "rank": r} for r in rs] for f, rs in ranks.items()})),
                             "map<string,array<struct<id:bigint,rank:bigint>>>")
        found: dict[str, dict[int, float]] = {f: {} for f in self.features}
        for r in order_statistics(long, ["feature"], "v", lambda n: F.element_at(wanted, F.col("feature")), written=True).collect():
            found[r["feature"]][r["id"]] = r["v"]               # some 20 numbers per feature

        self.fill = dict.fromkeys(self.features, 0.0)
        for f, (rows, n, top) in sizes.items():
            if f.startswith("DAYS_SINCE"):
                self.fill[f] = 9999.0 if top is None else top + 1.0
            elif n and ("AMNT" in f or "RATIO" in f):
                self.fill[f] = _between(0.5, n, found[f].__getitem__)

            def imputed(rank, f=f, nulls=rows - n):
                at, fill = found[f], self.fill[f]
                if at.get(rank, fill) < fill:
                    return at[rank]
                return max(at.get(rank - nulls, fill), fill)

            if f not in contract.BINARY and f not in contract.NO_CLIP:
                self.bounds[f] = contract.CLIP_BOUNDS.get(f) or tuple(_between(p, rows, imputed) for p in (0.01, 0.99))
            if f not in contract.BINARY and f not in contract.NO_SCALE:
                lo, hi = self.bounds.get(f, (float("-inf"), float("inf")))
                low, self.center[f], high = (_between(p, rows, lambda r: max(lo, min(hi, imputed(r)))) for p in (0.25, 0.5, 0.75))
                self.scale[f] = high - low if high != low else 1.0
        for f in self.features:
            if f not in sizes and f in contract.CLIP_BOUNDS:
                self.bounds[f] = contract.CLIP_BOUNDS[f]        # no rows at all
        return self

    def _fit_approx(self, df: DataFrame) -> "Preprocessor":
        long = df.select(*[F.col(c).cast("double").alias(c) for c in self.features]).unpivot(
            [], self.features, "feature", "v")
        self.fit_fill(long, "approx")
        imputed = self.imputed_counts(long)
        self.fit_bounds(imputed, "approx")
        return self.fit_scale(self.clipped_counts(imputed), "approx")

    # -- transform -------------------------------------------------------------
    def impute(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(float(v)))
                               for f, v in self.fill.items()})

    def clip(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            f: F.when(F.col(f).isNotNull(),
                      F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.col(f).cast("double"))))
            for f, (lo, hi) in self.bounds.items()})

    def rescale(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f: (F.col(f) - float(self.center[f])) / float(s)
                               for f, s in self.scale.items()})

    def transform(self, df: DataFrame, features: list[str] | None = None) -> DataFrame:
        """All three steps, one projection each. ``features`` is the list the
        caller is about to feed; any difference to the fitted list is an error."""
        if features is not None:
            self.check_features(features)
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ContractError(f"missing feature column(s): {missing}")
        return self.rescale(self.clip(self.impute(df)))

    def check_features(self, features: list[str]) -> None:
        if list(features) != self.features:
            diff = feature_diff(self.features, features)
            raise ContractError(f"fitted on a different feature list ({diff})")

    # -- as a table --------------------------------------------------------------
    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, f, self.fill.get(f), *(self.bounds.get(f) or (None, None)),
                 self.center.get(f), self.scale.get(f)) for i, f in enumerate(self.features)]
        return spark.createDataFrame(
            rows, "pos int, feature string, fill double, lo double, hi double, "
                  "center double, scale double")

    @classmethod
    def from_frame(cls, df: DataFrame) -> "Preprocessor":
        rows = sorted(df.collect(), key=lambda r: r["pos"])      # one row per feature
        p = cls([r["feature"] for r in rows])
        for r in rows:
            f = r["feature"]
            if r["fill"] is not None:
                p.fill[f] = r["fill"]
            if r["lo"] is not None:
                p.bounds[f] = (r["lo"], r["hi"])
            if r["scale"] is not None:
                p.center[f], p.scale[f] = r["center"], r["scale"]
        return p


def feature_diff(fitted: list[str], given: list[str]) -> str:
    """Names the difference of two feature lists."""
    missing = [f for f in fitted if f not in given]
    extra = [f for f in given if f not in fitted]
    if missing or extra:
        return f"missing={missing} extra={extra}"
    return "same columns, DIFFERENT ORDER"
