"""Risk bands of the queue and the skim simulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ... import constants as C
from ...functions.columns import ratio
from ...functions.position import with_position
from ...functions.quantiles import quantiles
from ..ranking import TIES, ranked_population

RATE = C.CALLS_PER_HOUR


def population_summary(df: DataFrame) -> DataFrame:
    """Who is ranked, who is flagged by rule, and what calling them costs."""
    carved = F.col("current_cat") >= C.CARVE_CATEGORY
    aggs = [F.count(F.lit(1)).alias("n")]
    if "y_true" in df.columns:
        aggs.append(F.count_if(F.col("y_true") == C.SEVERE).alias("n_severe_label"))
    out = df.groupBy(carved.alias("__c")).agg(*aggs)          # two rows
    out = out.withColumn("population", F.explode(F.array(
        F.when(F.col("__c"), "rule-flagged (ALREADY_SEVERE)").otherwise("ranked queue"),
        F.lit("all rows"))))
    out = out.groupBy("population").agg(*[F.sum(c).alias(c) for c in out.columns
                                          if c.startswith("n")])
    cols = ["population", "n", (F.col("n") / RATE).alias("hours_to_call_all")]
    if "n_severe_label" in out.columns:
        cols += ["n_severe_label", ratio(F.col("n_severe_label"), F.col("n")).alias("severe_rate")]
    return out.select(*cols)


def class_crosstab(df: DataFrame, method: str = "exact") -> DataFrame:
    """True by predicted class on the queue, with the risk spread per true class."""
    q = ranked_population(df, "current_cat")
    table = q.groupBy("y_true").agg(
        *[F.count_if(F.col("pred_class") == k).alias(f"pred_{k}") for k in range(C.NUM_CLASSES)],
        F.count(F.lit(1)).alias("n"), F.avg("risk").alias("mean_risk"))
    spread = quantiles(q, ["y_true"], "risk", [0.5, 0.9, 0.99], method).groupBy("y_true").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"risk_p{int(p * 100)}")
          for p in (0.5, 0.9, 0.99)])
    return table.join(spread, "y_true", "left")


def _placed(df: DataFrame, ties) -> DataFrame:
    q = ranked_population(df, "current_cat").select(
        "risk", *ties, F.when(F.col("y_true") == C.SEVERE, 1).otherwise(0).cast("bigint").alias("SEV"))
    return with_position(q, [F.col("risk").desc_nulls_last()] + [F.col(t).asc() for t in ties],
                         name="POS", total="N")


def band_table(df: DataFrame, n_bands: int = 20, ties=TIES) -> DataFrame:
    """Equal-count bands, riskiest first; the first n mod k bands are one longer."""
    k = int(n_bands)
    pos = _placed(df, ties).withColumns({"__q": F.expr(f"N div {k}"), "__r": F.expr(f"N % {k}")})
    long_part = F.col("__r") * (F.col("__q") + 1)
    band = F.when(F.col("POS") <= long_part, F.expr("(POS - 1) div (__q + 1) + 1")).otherwise(
        F.expr("__r + (POS - 1 - __r * (__q + 1)) div greatest(__q, 1) + 1"))
    per = pos.groupBy(band.cast("int").alias("band")).agg(
        F.max("risk").alias("risk_hi"), F.min("risk").alias("risk_lo"),
        F.count(F.lit(1)).alias("n"), F.sum("SEV").alias("n_severe"))
    run = Window.partitionBy(F.lit(0)).orderBy("band")            # one row per band
    every = Window.partitionBy(F.lit(0))
    per = per.withColumns({"__seen": F.sum("n").over(run), "__hit": F.sum("n_severe").over(run),
                           "__sev": F.sum("n_severe").over(every), "__all": F.sum("n").over(every)})
    base = F.col("__sev") / F.col("__all")
    some = F.greatest(F.col("__sev"), F.lit(1))
    return per.select("band", "risk_hi", "risk_lo", "n", "n_severe",
                      (F.col("n_severe") / F.col("n")).alias("precision"),
                      ((F.col("n_severe") / F.col("n")) / F.when(base != 0, base)).alias("lift"),
                      (F.col("n_severe") / some).alias("share_of_severe"),
                      (F.col("__hit") / some).alias("cum_recall"),
                      (F.col("__seen") / RATE).alias("cum_hours"))


def default_thresholds(df: DataFrame, method: str = "exact") -> list[float]:
    """Distinct score quantiles of the queue: a handful of numbers."""
    q = ranked_population(df, "current_cat")
    return sorted({r["value"] for r in
                   quantiles(q, [], "risk", list(C.SKIM_QUANTILES), method).collect()})


def skim_simulation(df: DataFrame, thresholds: list[float] | None = None, ties=TIES) -> DataFrame:
    """Act directly on rows at or over a threshold; what do calls reach of the rest?

    Two passes over the placed rows: counts per threshold first, then hits per
    budget window counted from where the acted rows end.
    """
    thresholds = default_thresholds(df) if thresholds is None else [float(t) for t in thresholds]
    pos = _placed(df, ties)
    aggs = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("SEV"), F.lit(0)).alias("sev")]
    for i, t in enumerate(thresholds):
        over = F.col("risk") >= t
        aggs += [F.count_if(over).alias(f"a{i}"), F.count_if(over & (F.col("SEV") == 1)).alias(f"s{i}")]
    c = pos.agg(*aggs).first()                                  # two counts per threshold
    n, sev = c["n"], c["sev"]

    # A severe row's place among the severe rows says when a share of them is reached.
    severe = with_position(pos.where("SEV = 1").select("POS"), [F.col("POS").asc()], name="NTH")
    want = {}
    hits = []
    for i, t in enumerate(thresholds):
        left = sev - c[f"s{i}"]
        for w, h in C.REF_WINDOWS.items():
            k = min(RATE * h, n - c[f"a{i}"])
            hits.append(F.count_if((F.col("SEV") == 1) & (F.col("POS") > c[f"a{i}"])
                                   & (F.col("POS") <= c[f"a{i}"] + k)).alias(f"h{i}_{w}"))
        for pct in (50, 80):
            need = -(-pct * max(left, 1) // 100)                # rounded up
            want[(i, pct)] = c[f"s{i}"] + need
    h = pos.agg(*hits).first() if hits else {}
    at = {r["NTH"]: r["POS"] for r in
          severe.where(F.col("NTH").isin(sorted(set(want.values())))).collect()}

    rows = []
    for i, t in enumerate(thresholds):
        acted, acted_sev = c[f"a{i}"], c[f"s{i}"]
        left, all_sev = sev - acted_sev, max(sev, 1)
        row = [t, acted, acted_sev / acted if acted else None, acted / RATE, acted_sev / all_sev,
               n - acted, left]
        for w in C.REF_WINDOWS:
            row += [h[f"h{i}_{w}"] / max(left, 1), (acted_sev + h[f"h{i}_{w}"]) / all_sev]
        for pct in (50, 80):
            place = at.get(want[(i, pct)])
            row.append((place - acted) / RATE if place is not None else None)
        rows.append(tuple(row))
    cols = ["threshold double", "n_acted bigint", "acted_precision double", "hours_saved double",
            "acted_recall double", "n_queue_after bigint", "severe_left bigint"]
    for w in C.REF_WINDOWS:
        cols += [f"api_recall_{w} double", f"combined_{w} double"]
    cols += ["hours_to_50pct_left double", "hours_to_80pct_left double"]
    return df.sparkSession.createDataFrame(rows, ", ".join(cols))
