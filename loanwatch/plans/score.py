"""Score a loan table into the ranked queue."""

from __future__ import annotations

import dataclasses
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import calibrate as H
from ..operators import maturity as E
from ..operators.clean import drop_unlabelled
from ..operators.queue import build_queue
from ..session import pin
from ..sources import artifact, store, tables
from . import ingest

log = logging.getLogger(__name__)

# What an unset knob falls back to.
_DEFAULTS = {
    "act_threshold": None,
    "carve_category": C.CARVE_CATEGORY,
    "min_stratum_n": C.CALIBRATION_MIN_STRATUM_N,
    "ttl_days": C.CALL_TTL_DAYS,
    "newest_only": True,
    "cost_matrix": C.COST_MATRIX,
    "called_log_path": None,
}


@dataclasses.dataclass
class ScoringParams:
    """Per-call knobs of a scoring run; the model path is required."""

    model_path: str
    as_of: str | None = None
    calibration_rows: DataFrame | None = None
    output_folder: str | None = None
    called_log_path: str | None = None
    act_threshold: float | None = None
    carve_category: int | None = None
    min_stratum_n: int | None = None
    ttl_days: int | None = None
    newest_only: bool | None = None
    cost_matrix: tuple | None = None

    def resolve(self) -> "ScoringParams":
        """A copy with unset knobs at their defaults, named in one warning."""
        if not self.model_path:
            raise ValueError("model_path is required")
        out = dataclasses.replace(self)
        filled = []
        for name, default in _DEFAULTS.items():
            if getattr(out, name) is None:
                setattr(out, name, default)
                filled.append(f"{name}={default!r}")
        if filled:
            log.warning("%d scoring knob(s) not set, using defaults: %s", len(filled), ", ".join(filled))
        return out


def score_frame(df: DataFrame, model: artifact.Model, params: ScoringParams,
                called_log: DataFrame | None = None) -> DataFrame:
    """Loan rows to the ranked queue with an already loaded model.

    Labels are never scoring inputs. The probabilities are written out once:
    the flags, the customer roll-up and the ranking all read them.
    """
    calibrator = model.calibrator
    if params.calibration_rows is not None:
        labelled = model.raw_probs(drop_unlabelled(params.calibration_rows))
        calibrator = H.refresh(calibrator, labelled, params.min_stratum_n)
    rows = model.raw_probs(df.drop("WORST_FUTURE_CAT", "WORST_FUTURE_DPD"))
    rows = calibrator.transform(rows) if calibrator else rows
    keep = [c for c in ("LOAN_ID", "SNAPSHOT_DATE", "NATIONAL_CODE", "N_LOANS_IN_PORTFOLIO", "CURRENT_CAT",
                        "p0", "p1", "p2", "p3") if c in rows.columns]
    return build_queue(pin(rows.select(*keep)), called_log, params.as_of,
                       cost_matrix=params.cost_matrix, carve_category=params.carve_category,
                       act_threshold=params.act_threshold, ttl_days=params.ttl_days,
                       newest_only=params.newest_only)


def run_scoring(spark: SparkSession, df: DataFrame, params: ScoringParams) -> DataFrame:
    """Score with the model and knobs of ``params``; writes the queue if asked."""
    params = params.resolve()
    model = artifact.load(spark, params.model_path)
    called = tables.read_called_log(spark, params.called_log_path)
    queue = score_frame(df, model, params, called)
    if params.output_folder:
        queue = pin(queue)
        store.write_queue(queue, params.output_folder)
    return queue


def predict(spark: SparkSession, loans: DataFrame, ledger: DataFrame, params: ScoringParams,
            snapshots: list[int] | None = None, recalibrate: bool = True,
            store_path: str | None = None, build_times: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Score the wanted snapshots of the loan table (default: all open ones),
    after refreshing the calibrator on the newest finalised snapshot.

    With ``store_path`` and ``build_times`` both come through the snapshot store, which
    watches the feed rules on the way; else the rows to score are checked by a scan.
    """
    mature = loans
    if store_path:
        rows = ingest.scoring_loans(loans, ledger, build_times, store_path, snapshots, strict)
        if recalibrate and params.calibration_rows is None:
            mature = ingest.training_loans(loans, ledger, store_path, strict)
    else:
        wanted = [r[0] for r in E.snapshots_to_score(loans, ledger, snapshots).collect()]   # months
        rows = ingest.checked(loans.where(F.col("SNAPSHOT_DATE").isin(wanted)), ledger, strict)
    if recalibrate and params.calibration_rows is None:
        params = dataclasses.replace(params, calibration_rows=H.newest_mature(mature, ledger))
    return run_scoring(spark, rows, params)
