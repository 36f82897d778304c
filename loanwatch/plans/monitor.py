"""The monthly monitor from engine tables to report tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import monitor as M
from ..session import pin
from ..sources.tables import label_ledger


@dataclass
class EngineTables:
    """What the monitor reads."""

    run_log: DataFrame
    output: DataFrame
    tracking: DataFrame
    ledger: DataFrame
    state_log: DataFrame
    loans: DataFrame


def monitor(t: EngineTables, asof: int) -> dict[str, DataFrame]:
    """All report tables by name, as things stood at the end of ``asof``."""
    runs = M.pick_runs(M.existed_by(t.run_log, "OPERATION_DATE", asof))
    if runs.isEmpty():
        raise M.MonitorError(f"no usable run by {asof}")
    ledger = label_ledger(M.existed_by(t.ledger, "FINALIZED_AT", asof))
    preds = pin(M.predictions(t.output, t.tracking, runs))
    scored = preds.select("SNAPSHOT_DATE").distinct()
    outs = pin(M.outcomes(t.loans.join(scored, "SNAPSHOT_DATE", "left_semi"), t.state_log, asof))
    M.assert_unique(preds, M.KEY, "predictions")
    M.assert_unique(outs, M.KEY, "outcomes")
    M.assert_labels_agree(outs, ledger)
    rows = pin(M.prepare(preds, outs, ledger))
    done, going = pin(M.matured_list(rows)), pin(M.interim_list(rows))
    return {
        "routing": M.routing(rows),
        "matured": M.matured_metrics(done),
        "queue_by_category": M.queue_by_category(done),
        "calibration_deciles": M.calibration_deciles(done),
        "migration": M.migration(done),
        "capture_curve": M.cohort_capture(done),
        "enrichment_rule": M.enrichment_rule(done),
        "interim": M.interim_metrics(going),
        "drift": M.drift(preds),
        "quality": M.quality(preds, outs, ledger, runs),
        "history": M.history(done),
    }


def run_monitor(t: EngineTables, asof: int, folder: str) -> dict[str, str]:
    """Write every report table; the history also as CSV. Returns the paths."""
    paths = {}
    base = folder.rstrip("/")
    for name, df in monitor(t, asof).items():
        paths[name] = f"{base}/{asof}/{name}"
        df.write.mode("overwrite").parquet(paths[name])
        if name == "history":
            df.orderBy("SNAPSHOT_DATE").write.mode("overwrite").csv(f"{base}/history", header=True)
    return paths
