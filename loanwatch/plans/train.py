"""Train, calibrate and evaluate the arms of one fold."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import arms as G
from ..operators import calibrate as H
from ..operators import classify as L
from ..operators import maturity as E
from ..operators import ranking as K
from ..operators.clean import drop_unlabelled
from ..operators.decide import RAW, with_decision, with_monotone_mask
from ..operators.preprocess import Preprocessor
from ..session import pin
from ..sources.artifact import Model, model_columns, shape_rows

log = logging.getLogger(__name__)

_KEPT = [f"r{k}" for k in range(C.NUM_CLASSES)]           # raw next to calibrated


@dataclass
class FoldResult:
    """What one fold leaves behind: the deployed model, all metrics in long
    form (arm, block, slice, metric, value) and the scored test rows."""

    deployed: str
    model: Model
    metrics: DataFrame | None
    scored_test: DataFrame | None
    intervals: DataFrame | None = None
    trials: dict[str, DataFrame] = field(default_factory=dict)


def mature_training_rows(loans: DataFrame, ledger: DataFrame) -> DataFrame:
    """Labelled rows of mature snapshots."""
    return drop_unlabelled(E.mature_rows(loans, ledger))


def static_split(loans: DataFrame, ledger: DataFrame, final: bool = False, **roles) -> DataFrame:
    """Rows with SPLIT for the evaluation split, or for the deployment fit."""
    mature = E.mature_snapshots(loans, ledger)
    r = E.final_roles(mature) if final else E.static_roles(mature, **roles)
    return E.split_rows(mature_training_rows(loans, ledger), r,
                        customer_holdout=roles.get("val_mode", "customer") == "customer")


def _calibrated(arm: G.Arm, df: DataFrame, cal: H.Calibrator | None) -> DataFrame:
    out = arm.predict(df)
    out = out.withColumns({r: F.col(p) for r, p in zip(_KEPT, RAW)})
    if cal is None:
        return out
    if arm.kind == "binary":
        return cal.transform(out, ["p0", "p3"])
    return cal.transform(out)


def _fit_calibrator(arm: G.Arm, val: DataFrame, min_n: int) -> H.Calibrator:
    scored = arm.predict(val)
    if arm.kind == "binary":
        scored = scored.withColumn("__y", (F.col("LABEL") == C.SEVERE).cast("int"))
        return H.fit_calibrator(scored, ["p0", "p3"], "__y", min_stratum_n=min_n)
    return H.fit_calibrator(scored, min_stratum_n=min_n)


def train_fold(rows: DataFrame, features: list[str], ledger: DataFrame | None = None,
               arms=C.ARMS, deploy: str = C.DEPLOY_ARM, params: dict | None = None,
               grid: dict | None = None, grain: str = "loan", draws: int = 500,
               method: str = "exact", min_stratum_n: int = C.CALIBRATION_MIN_STRATUM_N) -> FoldResult:
    """Preprocess on train, fit every arm, calibrate on val, evaluate on test.

    ``deploy`` names the arm to ship, or "auto" for the best pooled AP among the
    arms that give a full distribution. Without test rows (the deployment fit)
    only the named arm is trained. The shaped rows are written once and shared.
    """
    if deploy != "auto" and deploy not in C.FULL_DISTRIBUTION_ARMS:
        raise ValueError(f"arm {deploy!r} has no class distribution and cannot be deployed")
    pre = Preprocessor(list(features)).fit(rows.where("SPLIT = 'train'"), method)
    shaped = pin(shape_rows(rows, pre, features, grain, keep_columns=("SPLIT",)))
    have = {r[0] for r in shaped.select("SPLIT").distinct().collect()}
    part = {s: shaped.where(F.col("SPLIT") == s) for s in ("train", "val", "test")}
    if "test" not in have:
        if deploy == "auto":
            raise ValueError("a deployment fit needs a named arm: there is no test set to choose on")
        arms = (deploy,)
    cols = model_columns(features, grain)
    ties = K.TIES if grain == "loan" else ("NATIONAL_CODE", "SNAPSHOT_DATE")

    fitted, tables, scored, trials = {}, [], {}, {}
    for kind in arms:
        chosen = params
        if grid and "val" in have and deploy in ("auto", kind) and kind in C.FULL_DISTRIBUTION_ARMS:
            chosen, trials[kind] = G.tune_arm(kind, part["train"], part["val"], cols, grid)
        arm = G.fit_arm(kind, part["train"], cols, chosen)
        cal = _fit_calibrator(arm, part["val"], min_stratum_n) if "val" in have else None
        fitted[kind] = (arm, cal)
        if "test" not in have:
            continue
        test = pin(_calibrated(arm, part["test"], cal).drop(*cols) if grain != "loan" else
                   _calibrated(arm, part["test"], cal).drop(*[c for c in cols if c != C.EXPOSURE_FEATURE]))
        scored[kind] = test
        if kind == "binary":
            m = L.to_long(K.ranking_metrics(K.ranked_population(test), score="p3", ties=ties), "ranking")
        else:
            m = L.full_evaluation(test, ledger, raw=_KEPT, calibrated=RAW, n_loans="N_LOANS_IN_PORTFOLIO",
                                  exposure="EXPOSURE" if "EXPOSURE" in test.columns else None, ties=ties)
        tables.append(m.withColumn("arm", F.lit(kind)))

    metrics = None
    if tables:
        metrics = tables[0]
        for t in tables[1:]:
            metrics = metrics.unionByName(t)
        metrics = pin(metrics)
    name = deploy
    if deploy == "auto":
        ap = metrics.where("block = 'ranking' and metric = 'pr_auc'").where(
            F.col("arm").isin(*C.FULL_DISTRIBUTION_ARMS))
        name = ap.agg(F.max_by("arm", F.struct(F.coalesce("value", F.lit(-1.0)), "arm"))).first()[0]
    model = Model(pre, *fitted[name], features=list(features), grain=grain)
    out = FoldResult(name, model, metrics, None, trials=trials)
    if "test" in have:
        out.scored_test = with_decision(with_monotone_mask(scored[name]))
        out.intervals = L.bootstrap_intervals(out.scored_test, pred="PREDICTED_CLASS", draws=draws)
    return out


def walk_forward(loans: DataFrame, ledger: DataFrame, features: list[str], min_train: int = C.MIN_TRAIN_SNAPSHOTS,
                 window: int | None = None, **fold_options) -> tuple[list[FoldResult], DataFrame]:
    """Every fold in turn (a list of months, not of rows) and their summary."""
    folds = pin(E.walk_forward_folds(E.mature_snapshots(loans, ledger), min_train, window))
    rows = mature_training_rows(loans, ledger)
    results, headline = [], None
    for f in folds.orderBy("FOLD_ID").collect():
        one = E.fold_rows(rows, folds.where(F.col("FOLD_ID") == f["FOLD_ID"])).drop("FOLD_ID")
        res = train_fold(one, features, ledger, **fold_options)
        results.append(res)
        wanted = ((F.col("block") == "ranking") & F.col("metric").isin(
            "pr_auc", *[f"recall_{w}" for w in C.REF_WINDOWS])) | (
            (F.col("block") == "argmax_raw") & (F.col("metric") == "macro_f1"))
        part = res.metrics.where((F.col("arm") == res.deployed) & wanted).select(
            F.lit(f["FOLD_ID"]).alias("fold"), "metric", "value")
        headline = part if headline is None else headline.unionByName(part)
    if headline is None:
        raise ValueError("no valid fold")
    return results, L.fold_summary(headline)
