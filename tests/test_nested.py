"""Ranking blocks of overlapping slices from one sorted pass, against one block at a time."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanwatch import constants as C
from loanwatch.operators import classify, nested, ranking

WINDOWS = {"a": 7 / C.CALLS_PER_HOUR, "b": 40 / C.CALLS_PER_HOUR, "c": 100_000}


def brute(rows):
    """rows: (score, tie, severe) of one slice -> the ranking block."""
    rows = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -math.inf), r[1]))
    n, sev = len(rows), sum(r[2] for r in rows)
    out = {"n_ranked": n, "n_severe": sev, "base_rate": sev / n}
    if not sev:
        return out
    ap, cn, ctp = 0.0, 0, 0
    i = 0
    while i < n:
        j = i
        while j < n and rows[j][0] == rows[i][0]:
            j += 1
        tp = sum(r[2] for r in rows[i:j])
        cn, ctp = j, ctp + tp
        ap += tp * ctp / cn
        i = j
    out["pr_auc"] = ap / sev
    for w, h in WINDOWS.items():
        k = min(int(C.CALLS_PER_HOUR * h), n)
        hit = sum(r[2] for r in rows[:k])
        out |= {f"k_{w}": k, f"recall_{w}": hit / sev, f"precision_{w}": hit / k, f"lift_{w}": hit / k / (sev / n)}
    return out


def table(seed, n, ties):
    r = np.random.default_rng(seed)
    return [(i, int(r.integers(0, 3)), int(r.integers(0, 4)), None if i % 41 == 0 else float(r.integers(0, ties)) / ties,
             int(r.integers(1, 3)), ["FINAL", "LEGACY", None][int(r.integers(0, 3))], float(i % 13)) for i in range(n)]


@pytest.mark.parametrize("partitions,ties", [(1, 5), (7, 3), (7, 10_000), (40, 1)])
def test_every_slice_equals_a_block_of_its_own(spark, partitions, ties):
    rows = table(partitions, 400, ties)
    df = spark.createDataFrame(rows, "LOAN_ID int, CURRENT_CAT int, LABEL int, SCORE double, NL int, STATUS string, AMOUNT double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = nested.nested_ranking(df, {"all": F.lit(nested.ALL), "single": F.when(F.col("NL") == 1, F.lit(nested.ALL)), "status": F.col("STATUS")},
                                    ties=("LOAN_ID",), windows=WINDOWS, exposure="AMOUNT").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for i, cat, label, score, nl, status, amount in rows:
        names = [("all", "all"), ("all_by_category", str(cat))]
        names += [("single", "all"), ("single_by_category", str(cat))] if nl == 1 else []
        names += [("status", status), ("status_by_category", f"{status}/{cat}")] if status else []
        for name in names:
            want.setdefault(name, []).append((score, i, int(label == 3), amount))
    assert {(r["block"], r["slice"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        mine = want[r["block"], r["slice"]]
        for name, value in brute(mine).items():
            assert r[name] == pytest.approx(value, abs=1e-12), (r["block"], r["slice"], name)
        assert (r["exposure_min"], r["exposure_max"]) == (min(x[3] for x in mine), max(x[3] for x in mine))


def test_rows_are_sorted_by_score_once_and_slices_without_severe_rows_get_counts(spark, monkeypatch):
    sorts = []
    real = nested.sorted_slices
    monkeypatch.setattr(nested, "sorted_slices", lambda df, order: sorts.append(1) or real(df, order))
    df = spark.createDataFrame([(1, 0, 3, 0.9, 20240101, 1), (2, 1, 0, 0.5, 20240101, 2), (3, 1, 1, 0.4, 20240201, 1)],
                               "LOAN_ID int, CURRENT_CAT int, LABEL int, SCORE double, SNAPSHOT_DATE int, NL int")
    led = spark.createDataFrame([(20240101, "FINAL"), (20240201, "FINAL")], "SNAPSHOT_DATE int, STATUS string")
    got = {(r["block"], r["slice"], r["metric"]): r["value"] for r in classify.ranking_blocks(df, led, n_loans="NL").collect()}
    assert sorts == [1]
    assert got["ranking_by_category", "1", "n_ranked"] == 2 and got["ranking_by_category", "1", "pr_auc"] is None
    assert got["ranking_single_loan", "all", "n_severe"] == 1 and got["ranking_single_loan_by_category", "1", "n_ranked"] == 1
    assert not any(b.startswith("ranking_by_label_status") for b, _, _ in got)      # one vintage only
    two = led.withColumn("STATUS", F.when(F.col("SNAPSHOT_DATE") == 20240101, "LEGACY").otherwise("FINAL"))
    got = {(r["block"], r["slice"]) for r in classify.ranking_blocks(df, two, n_loans="NL").collect()}
    assert {("ranking_by_label_status", "FINAL"), ("ranking_by_label_status_by_category", "LEGACY/0")} <= got


def test_few_rows_have_no_deciles_and_no_rows_no_slices(spark):
    df = spark.createDataFrame([(i, 0, 3 * (i % 2), i / 10, 20240101, float(i)) for i in range(9)],
                               "LOAN_ID int, CURRENT_CAT int, LABEL int, SCORE double, SNAPSHOT_DATE int, AMOUNT double")
    got = {r["block"] for r in classify.ranking_blocks(df, exposure="AMOUNT").collect()}
    assert got == {"ranking", "ranking_by_category"}
    assert classify.ranking_blocks(df.limit(0), exposure="AMOUNT").count() == 0
    assert len(ranking.with_exposure_decile(df, "AMOUNT").collect()) == 0


def test_a_worker_holds_a_piece_and_pieces_change_no_result(spark, monkeypatch):
    rows = table(2, 300, 4)
    df = spark.createDataFrame(rows, "LOAN_ID int, CURRENT_CAT int, LABEL int, SCORE double, NL int, STATUS string, AMOUNT double").repartition(2)

    def run():
        got = nested.nested_ranking(df, {"all": F.lit(nested.ALL), "status": F.col("STATUS")}, ties=("LOAN_ID",), windows=WINDOWS).collect()
        return {(r["block"], r["slice"]): r.asDict() for r in got}
    want, real = run(), nested._walk

    def checked(blocks, budgets):
        walk = real(blocks, budgets)

        def piece(rows, before):
            if rows.num_rows > 7:
                raise ValueError(f"{rows.num_rows} rows at once")
            return walk(rows, before)
        return piece
    monkeypatch.setattr(nested, "PIECE", 7)
    monkeypatch.setattr(nested, "_walk", checked)
    got = run()
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert r == {n: v if not isinstance(v, float) else pytest.approx(v, abs=1e-12) for n, v in want[k].items()}
