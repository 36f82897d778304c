"""Per-class isotonic calibration, pooled and per current category.

The curves are fitted and looked up by ``isotonic.py``; only the sizes of the
strata reach the driver.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..session import pin
from .decide import RAW
from .isotonic import isotonic_blocks, look_up, segments

log = logging.getLogger(__name__)

CALIBRATED = RAW


def score_groups(df: DataFrame, probs: list[str] = RAW, label: str = "LABEL",
                 cat: str = "CURRENT_CAT") -> DataFrame:
    """(cat, class, score, n, rate): one row per distinct score, which is all an
    isotonic fit needs; equal scores are pooled."""
    entries = F.array(*[F.struct(F.lit(k).alias("class"), F.col(p).cast("double").alias("score"),
                                 F.when(F.col(label) == k, 1).otherwise(0).alias("hit"))
                        for k, p in enumerate(probs)])
    return df.select(F.col(cat).alias("cat"), F.inline(entries)).groupBy("cat", "class", "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))


@dataclass
class Calibrator:
    """Isotonic curves by (stratum, class) as a table of blocks; stratum NULL is the pooled one."""

    blocks: DataFrame
    strata: list[int]

    def transform(self, df: DataFrame, probs: list[str] = RAW, cat: str = "CURRENT_CAT") -> DataFrame:
        """Probabilities replaced by calibrated ones: per class, floor 1e-6,
        renormalised. Strata without curves of their own, and rows without a
        category, use the pooled ones."""
        table = segments(self.blocks)
        stratum = F.when(F.col(cat).isin(self.strata), F.col(cat).cast("long")) if self.strata else F.lit(None).cast("long")
        out = df
        for k, p in enumerate(probs):
            out = look_up(out, table.where(F.col("class") == k), p, {"stratum": stratum}, f"__iso_{k}")
        found = [F.col(f"__iso_{k}") for k in range(len(probs))]
        floored = [F.when(x.isNotNull(), F.greatest(x, F.lit(1e-6))) for x in found]
        total = floored[0]
        for x in floored[1:]:
            total = total + x
        return out.withColumns({p: x / total for p, x in zip(probs, floored, strict=True)}).select(*df.columns)


def fit_calibrator(df: DataFrame, probs: list[str] = RAW, label: str = "LABEL",
                   cat: str = "CURRENT_CAT", stratified: bool = True,
                   min_stratum_n: int = C.CALIBRATION_MIN_STRATUM_N) -> Calibrator:
    """Pooled curves and, for categories with enough rows, their own: all of them in one fit."""
    groups = pin(score_groups(df, probs, label, cat))
    strata = []
    if stratified:
        sizes = groups.where((F.col("class") == 0) & F.col("cat").isNotNull()).groupBy("cat").agg(F.sum("n").alias("n")).collect()
        for r in sorted(sizes, key=lambda r: r["cat"]):           # one row per category
            if r["n"] >= min_stratum_n:
                strata.append(int(r["cat"]))
            else:
                log.info("category %s has %s rows, the pooled calibrator is used", r["cat"], r["n"])
    # -0.0 and 0.0 are one score.
    curve = [F.col("cat").cast("long").alias("stratum"), "class", (F.col("score") + F.lit(0.0)).alias("score"), "n", "hits"]
    pooled = groups.select(F.lit(None).cast("long").alias("stratum"), *curve[1:])
    own = groups.where(F.col("cat").isin(strata)).select(*curve) if strata else pooled.limit(0)
    points = pooled.unionByName(own).groupBy("stratum", "class", "score").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return Calibrator(isotonic_blocks(points, ["stratum", "class"]), strata)


def refresh(calibrator: Calibrator | None, scored: DataFrame,
            min_stratum_n: int = C.CALIBRATION_MIN_STRATUM_N) -> Calibrator | None:
    """A new calibrator from labelled scored rows of a finalised snapshot; the
    old one stays when there are none."""
    labelled = scored.where(F.col("LABEL").isNotNull())
    if labelled.isEmpty():
        log.warning("no labelled rows to calibrate on (an open snapshot?), calibrator unchanged")
        return calibrator
    return fit_calibrator(labelled, min_stratum_n=min_stratum_n)


def newest_mature(loans: DataFrame, ledger: DataFrame) -> DataFrame:
    """Labelled rows of the newest finalised snapshot the table holds."""
    from .maturity import mature_snapshots
    newest = mature_snapshots(loans, ledger).agg(F.max("SNAPSHOT_DATE")).first()[0]
    return loans.where((F.col("SNAPSHOT_DATE") == newest) & F.col("WORST_FUTURE_CAT").isNotNull())
