"""A seven-loan cohort with every figure worked out by hand, and its variants."""
import pytest
from support import by, one
from pyspark.sql import functions as F

from loanwatch.operators import monitor as M
from loanwatch.operators.clean import engine_predictions

SNAP = 20250320
CUTS = {"top_2": 2, "top_half": 0.5}
BAND_DPD = {0: 0, 1: 30, 2: 100, 3: 170, 4: 200}
LABEL = [4, 0, 3, 0, 0, 3, 0]
LEDGER = "SNAPSHOT_DATE long, STATUS string, LOANS_UNLABELLED long, LOANS_MISSING_MONTHS long"
OUTS = ("SNAPSHOT_DATE long, LOAN_ID long, FINAL_CAT int, WORST_DPD_SO_FAR int, MONTHS_OBSERVED long, "
        "MONTHS_DELETED long, STATE_ROWS long")


def cohort(spark, status="FINAL", months=None, **change):
    cat = [0, 0, 1, 0, 0, 0, 0]
    amount = [100., 1., 50., 1., 1., 50., 1.]
    preds = spark.createDataFrame(
        [(SNAP, i, "abcdefg"[i], cat[i], (9 - i) / 10, amount[i], i in (1, 2)) for i in range(7)],
        "SNAPSHOT_DATE long, LOAN_ID long, NATIONAL_CODE string, CURRENT_CAT int, RISK_SCORE double, "
        "REMAINING_AMNT double, FLAGGED boolean")
    final = status is not None
    rows = [[SNAP, i, LABEL[i] if final else None, BAND_DPD[LABEL[i]], months or (6 if final else 3), 0,
             7 if final else 4] for i in range(7)]
    for i, fields in change.get("rows", {}).items():
        for k, v in fields.items():
            rows[i][k] = v
    rows = [tuple(r) for i, r in enumerate(rows) if i not in change.get("without", ())]
    ledger = spark.createDataFrame([(SNAP, status, change.get("unlabelled", 0), 0)] if final else [], LEDGER)
    return preds, spark.createDataFrame(rows, OUTS), ledger


def test_band_edges(spark):
    dpd = [0, 1, 60, 61, 155, 156, 180, 181, 400]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(dpd)], "i int, d int")
    assert [r["b"] for r in df.select("i", M.band_dpd(F.col("d")).alias("b")).orderBy("i").collect()] == \
        [0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_matured_cohort_by_hand(spark):
    preds, outs, ledger = cohort(spark)
    assert one(M.assert_labels_agree(outs, ledger))["N_CHECKED"] == 7
    rows = M.prepare(preds, outs, ledger)
    assert one(M.routing(rows))["COHORT"] == "matured"
    lst = M.matured_list(rows)
    m = one(M.matured_metrics(lst, CUTS))
    assert (m["LABEL_STATUS"], m["n_ranked"], m["n_severe"]) == ("FINAL", 7, 3)
    assert (m["top_2_k"], m["top_half_k"]) == (2, 4)
    assert m["top_2_recall"] == pytest.approx(1 / 3) and m["top_half_recall"] == pytest.approx(2 / 3)
    assert m["top_half_precision"] == pytest.approx(.5) and m["top_half_lift"] == pytest.approx(.5 / (3 / 7))
    assert m["top_half_exposure_caught"] == pytest.approx(150 / 200)
    assert m["top_half_recall_lo"] < 2 / 3 < m["top_half_recall_hi"]
    assert m["predicted_severe"] == pytest.approx(4.2)
    q = by(M.queue_by_category(lst, CUTS), "CURRENT_CAT")
    assert q[0]["recall_top_half"] == pytest.approx(1 / 2) and q[1]["recall_top_half"] == 1
    assert q[1]["share_of_top_half"] == pytest.approx(1 / 4)
    rule = one(M.enrichment_rule(lst))
    assert rule["n_flagged"] == 2 and rule["precision"] == pytest.approx(.5)
    assert rule["recall"] == rule["recall_top_same_size"] == pytest.approx(1 / 3)
    mig = M.migration(lst, "top_half", CUTS).collect()
    size = {g: sum(r[f"to_{k}"] for r in mig for k in range(4) if r["GROUP"] == g) for g in ("top", "rest")}
    assert size == {"top": 4, "rest": 3}
    assert not one(M.history(lst, CUTS))["VINTAGE_START"]


def test_open_snapshot_uses_the_state_log(spark):
    preds, outs, ledger = cohort(spark, None)
    rows = M.prepare(preds, outs, ledger)
    assert one(M.routing(rows))["COHORT"] == "interim" and M.matured_list(rows).count() == 0
    i = one(M.interim_metrics(M.interim_list(rows), CUTS, "top_half"))
    assert (i["months_observed"], i["n_short_months"]) == (3, 0)
    assert i["deteriorated_rate"] == pytest.approx(3 / 7)
    assert i["top_2_deteriorated_rate"] == pytest.approx(1 / 2)
    assert i["rest_deteriorated_rate"] == pytest.approx(1 / 3)
    assert i["rule_deteriorated_rate"] == pytest.approx(1 / 2)
    assert i["top_2_lift_vs_rest"] == pytest.approx(1.5)


def test_rows_without_outcome_are_counted_by_cause(spark):
    preds, outs, ledger = cohort(spark, None, rows={1: {3: None, 6: 0}, 2: {3: None, 5: 4}})
    q = by(M.quality(preds, outs, ledger), "item")
    assert (q["no_outcome_deleted"]["n"], q["no_outcome_no_state_rows"]["n"]) == (1, 1)
    assert {r["LOAN_ID"] for r in M.prepare(preds, outs, ledger).collect()} == {0, 3, 4, 5, 6}


def test_just_scored_snapshot_waits(spark):
    preds, outs, ledger = cohort(spark, None, rows={i: {4: 0} for i in range(7)})
    rows = M.prepare(preds, outs, ledger)
    assert one(M.routing(rows))["COHORT"] == "not_yet" and M.interim_list(rows).count() == 0


def test_unlabelled_and_unmatched_loans(spark):
    preds, outs, ledger = cohort(spark, rows={5: {2: None}}, without=(6,))
    q = by(M.quality(preds, outs, ledger), "item")
    assert (q["unlabelled"]["n"], q["ledger_unlabelled"]["n"], q["unmatched"]["n"]) == (1, 0, 1)
    assert {r["LOAN_ID"] for r in M.prepare(preds, outs, ledger).collect()} == {0, 1, 2, 3, 4}


def test_label_cross_check(spark):
    _, bad, ledger = cohort(spark, rows={3: {3: 170}})
    with pytest.raises(M.MonitorError, match="differ"):
        M.assert_labels_agree(bad, ledger)
    _, bad, legacy = cohort(spark, "LEGACY", rows={3: {3: 170}})
    assert one(M.assert_labels_agree(bad, legacy))["N_CHECKED"] == 0
    _, late, ledger = cohort(spark, months=7)
    with pytest.raises(M.MonitorError, match="more than 6"):
        M.assert_labels_agree(late, ledger)
    _, short, ledger = cohort(spark, months=5)
    assert one(M.assert_labels_agree(short, ledger))["N_CHECKED"] == 0


def test_newest_usable_run(spark):
    runs = spark.createDataFrame(
        [("a", 20260723, "SUCCESS", "2026-07-25", 0), ("b", 20260723, "PARTIAL_SUCCESS", "2026-07-28", 3),
         ("c", 20260723, "FAILED", "2026-07-30", 0), ("d", 20260823, "SUCCESS", "2026-08-25", 0),
         ("e", None, "SUCCESS", "2026-08-25", 0)],
        "OPERATION_ID string, SNAPSHOT_DATE long, OPERATION_STATUS string, d string, INFERENCE_FAILURES int") \
        .withColumn("OPERATION_DATE", F.to_timestamp("d"))
    got = M.pick_runs(runs).orderBy("SNAPSHOT_DATE").collect()
    assert [(r["OPERATION_ID"], r["N_USABLE_RUNS"]) for r in got] == [("b", 2), ("d", 1)]
    assert M.existed_by(runs, "OPERATION_DATE", 20260728).count() == 2


def test_engine_columns(spark):
    out = spark.createDataFrame([(123456789012345678, "x", 0.7, 4, 6e7, SNAP, s) for s in
                                 ("PENDING_ENRICHMENT", None, "NOT_APPLICABLE")],
                                "LOAN_ID long, NATIONAL_CODE string, P3 double, DPD_CAT int, REMAIN_OF_ACCOUNT double, "
                                "SNAPSHOT_DATE long, OPERATION_STATUS_ENRICHMENT string")
    rows = engine_predictions(out).collect()
    assert rows[0]["LOAN_ID"] == 123456789012345678 and rows[0]["CURRENT_CAT"] == 3
    assert [r["FLAGGED"] for r in rows] == [True, False, False]


def test_cutoffs_and_psi(spark):
    n = spark.createDataFrame([(100_000,), (500,)], "n long")
    got = n.select(M.cut_rows(F.col("n"), 0.05).alias("a"), M.cut_rows(F.col("n"), 1000).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(5000, 1000), (25, 500)]
    x = spark.range(5000).select(F.lit(1).alias("g"), (F.col("id") / 5000).alias("v"), F.lit(1).alias("w"))
    assert one(M.psi(x, x, ["g"], "v", "w"))["psi"] == pytest.approx(0, abs=1e-9)
    assert one(M.psi(x, x.withColumn("v", F.pow("v", F.lit(3.0))), ["g"], "v", "w"))["psi"] > .25
    flat = x.withColumn("v", F.lit(1.0))
    assert M.psi(flat, flat, ["g"], "v", "w").count() == 0


def test_deciles_follow_the_interval_rule(spark):
    lst = spark.range(1, 24).select(F.lit(SNAP).alias("SNAPSHOT_DATE"), F.col("id").alias("POS"), F.lit(23).cast("long").alias("N"),
                                    F.lit(.5).alias("RISK_SCORE"), (F.col("id") == 5).cast("int").alias("SEV"))
    assert M.calibration_deciles(lst.withColumn("SEV", F.lit(0))).count() == 0
    assert [r["n"] for r in M.calibration_deciles(lst).orderBy("DECILE").collect()] == [3, 2, 2, 2, 3, 2, 2, 2, 2, 3]
