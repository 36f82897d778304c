"""Contract, cleaning, feed checks, store, splits and preprocessing."""
import numpy as np
import pytest
from support import by, one
from pyspark.sql import functions as F

from loanwatch import contract
from loanwatch.operators import clean, feed_checks, grain, maturity
from loanwatch.operators.preprocess import Preprocessor
from loanwatch.sources import store, tables


def test_contract_shape():
    assert (len(contract.SCHEMA), len(contract.FEATURES), len(contract.META)) == (71, 64, 7)
    assert (len(contract.BINARY), len(contract.NO_CLIP), len(contract.NO_SCALE), len(contract.CLIP_BOUNDS)) == (7, 27, 4, 3)
    assert contract.NO_SCALE <= contract.NO_CLIP and set(contract.SENTINELS) == contract.NO_SCALE
    assert len(contract.REQUIRED) == 71 - 30 - 5


GOOD = [(1, 20250131, 20250731, 0, 1, 1, 0, 0, 0, 0, 0, 0), (2, 20250131, 20250731, 2, 2, 6, 1, 1, 10, 20, 30, 99999),
        (3, 20250131, 20250731, 0, 0, 1, 0, 0, 99999, 99999, 99999, 99999)]
COLS = ("LOAN_ID long, SNAPSHOT_DATE long, LABEL_HORIZON_DATE long, LOAN_CATEGORY int, WORST_FUTURE_CAT int, "
        "MONTHS_IN_CURRENT_CATEGORY int, HAS_EVER_BEEN_NPL int, HAS_EVER_BEEN_PRENPL int, DAYS_SINCE_LAST_DPD int, "
        "DAYS_SINCE_LAST_30_DPD int, DAYS_SINCE_LAST_60_DPD int, DAYS_SINCE_LAST_90_DPD int")


def feed(spark, **edit):
    names = [c.split()[0] for c in COLS.split(", ")]
    rows = [list(r) for r in GOOD]
    for col, (i, v) in edit.items():
        rows[i][names.index(col)] = v
    return spark.createDataFrame([tuple(r) for r in rows], COLS)


def test_clean_feed_has_no_violations(spark):
    assert feed_checks.feed_violations(feed(spark)).count() == 0


@pytest.mark.parametrize("rule, edit", [
    ("label_below_category", {"WORST_FUTURE_CAT": (1, 1)}), ("ladder", {"DAYS_SINCE_LAST_DPD": (1, 25)}),
    ("months_range", {"MONTHS_IN_CURRENT_CATEGORY": (0, 7)}), ("category_range", {"LOAN_CATEGORY": (0, -1)}),
    ("duplicate_key", {"LOAN_ID": (0, 2)}), ("npl_nesting", {"HAS_EVER_BEEN_PRENPL": (1, None)}),
    ("horizon_varies", {"LABEL_HORIZON_DATE": (0, 20250801)})])
def test_each_rule_fires(spark, rule, edit):
    bad = feed_checks.feed_violations(feed(spark, **edit)).collect()
    assert {r["rule"] for r in bad} == {rule}
    with pytest.raises(feed_checks.FeedError, match=rule):
        feed_checks.feed_violations(feed(spark, **edit), strict=True)


def test_null_labels_do_not_break_row_rules_and_follow_the_ledger(spark):
    open_feed = feed(spark).withColumn("WORST_FUTURE_CAT", F.lit(None).cast("int"))
    led = "SNAPSHOT_DATE long, STATUS string, LOANS_UNLABELLED long"
    empty, final = spark.createDataFrame([], led), spark.createDataFrame([(20250131, "FINAL", 1)], led)
    assert feed_checks.feed_violations(open_feed, empty).count() == 0
    assert one(feed_checks.feed_violations(feed(spark), empty))["n_bad"] == 3
    assert feed_checks.feed_violations(feed(spark, WORST_FUTURE_CAT=(0, None)), final).count() == 0
    assert one(feed_checks.feed_violations(feed(spark), final))["n_bad"] == 1


def test_missing_sentinel_needs_enough_rows(spark):
    big = feed(spark).crossJoin(spark.range(400).withColumnRenamed("id", "i")).withColumn(
        "LOAN_ID", F.col("LOAN_ID") * 1000 + F.col("i")).drop("i").withColumn("DAYS_SINCE_LAST_90_DPD", F.lit(99998))
    assert "sentinel_missing" in {r["rule"] for r in feed_checks.feed_violations(big).collect()}
    assert "sentinel_missing" not in {r["rule"] for r in feed_checks.feed_violations(big.limit(900)).collect()}


def test_projection_by_name(spark):
    df = feed(spark)
    assert clean.project_features(df, ["LOAN_CATEGORY", "DAYS_SINCE_LAST_DPD"], keep_meta=False).columns == \
        ["LOAN_CATEGORY", "DAYS_SINCE_LAST_DPD"]
    with pytest.raises(clean.ContractError, match="REMAINING_AMNT"):
        clean.project_features(df, ["REMAINING_AMNT"])


def test_headers_and_bad_numbers(spark):
    df = spark.createDataFrame([("NATIONAL_CODE", "x"), (None, "12/5"), ("a", "7"), ("b", "NaN"), ("c", None)],
                               "NATIONAL_CODE string, DPD_DAYS string")
    kept = clean.drop_header_rows(df)
    assert kept.count() == 4
    assert [r["DPD_DAYS"] for r in clean.coerce_features(kept, ["DPD_DAYS"]).collect()] == [None, 7.0, None, None]
    rep = one(clean.coercion_report(kept, ["DPD_DAYS"]))
    assert (rep["n_bad"], rep["example"]) == (2, "12/5")


def test_truncation_follows_today_not_the_label(spark):
    # Worst now is loan 1, worst later is loan 3.
    df = spark.createDataFrame([(1, "x", 20250131, 90, 2, 2), (2, "x", 20250131, 90, 2, 2), (3, "x", 20250131, 0, 0, 4)],
                               "LOAN_ID long, NATIONAL_CODE string, SNAPSHOT_DATE long, DPD_DAYS int, LOAN_CATEGORY int, WORST_FUTURE_CAT int")
    assert [r["LOAN_ID"] for r in grain.worst_loans(df, 1).collect()] == [1]
    p = one(grain.portfolio_features(df, ["DPD_DAYS"], max_loans=2))
    assert (p["N_LOANS"], p["LABEL"], p["CURRENT_CAT"], p["MIN_DPD_DAYS"], p["MAX_DPD_DAYS"]) == (3, 3, 2, 90, 90)
    with pytest.raises(ValueError, match="one row per"):
        grain.build_features(df.unionByName(df), ["DPD_DAYS"])


def _snaps(spark, *s):
    return spark.createDataFrame([(x,) for x in s], "SNAPSHOT_DATE long")


def test_static_roles(spark):
    assert one(maturity.static_roles(_snaps(spark, 20250131)))["ROLE"] == "train"
    two = {r[0]: r[1] for r in maturity.static_roles(_snaps(spark, 20250131, 20250228)).collect()}
    assert two == {20250131: "train", 20250228: "test"}
    # 181 days are 5.95 average months: not a full horizon.
    many = {r[0]: r[1] for r in maturity.static_roles(_snaps(spark, 20250722, 20250822, 20251122, 20260219)).collect()}
    assert many == {20250722: "train", 20250822: "gap", 20251122: "gap", 20260219: "test"}
    assert maturity.walk_forward_folds(_snaps(spark, 20250131, 20260131)).count() == 0


def test_customers_never_straddle_the_split(spark):
    rows = spark.range(3000).select((F.col("id") % 300).cast("string").alias("NATIONAL_CODE"),
                                    F.when(F.col("id") % 2 == 0, 20240101).otherwise(20250101).alias("SNAPSHOT_DATE"))
    roles = spark.createDataFrame([(20240101, "train"), (20250101, "test")], "SNAPSHOT_DATE int, ROLE string")
    s = maturity.split_rows(rows, roles)
    sides = {k: {r["NATIONAL_CODE"] for r in s.where(F.col("SPLIT") == k).collect()} for k in ("train", "val")}
    assert not sides["train"] & sides["val"] and .1 < len(sides["val"]) / 150 < .3
    import hashlib
    code = next(iter(sides["val"]))
    assert int(hashlib.md5(f"42:{code}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF < .2


def test_preprocessing_equals_numpy(spark):
    rng = np.random.default_rng(5)
    n = 500
    amount = [None if i % 50 == 0 else float(v) for i, v in enumerate(rng.lognormal(3, 2, n))]
    flag = [int(v) for v in rng.integers(0, 2, n)]
    never = [99999 if i % 3 else int(v) for i, v in enumerate(rng.integers(0, 900, n))]
    df = spark.createDataFrame(list(zip(amount, flag, never)), "REMAINING_AMNT double, IS_DETERIORATING int, DAYS_SINCE_LAST_DPD int")
    p = Preprocessor(df.columns).fit(df)
    med = np.median([a for a in amount if a is not None])
    full = np.array([med if a is None else a for a in amount])
    lo, hi = np.percentile(full, [1, 99])
    cl = np.clip(full, lo, hi)
    q1, q2, q3 = np.percentile(cl, [25, 50, 75])
    assert p.fill["REMAINING_AMNT"] == pytest.approx(med) and p.fill["DAYS_SINCE_LAST_DPD"] == 100000
    assert p.bounds == {"REMAINING_AMNT": pytest.approx((lo, hi))}
    assert list(p.scale) == ["REMAINING_AMNT"]
    got = sorted(r[0] for r in p.transform(df).select("REMAINING_AMNT").collect())
    assert got == pytest.approx(sorted((cl - q2) / (q3 - q1)))
    again = Preprocessor.from_frame(p.to_frame(spark))
    assert (again.fill, again.bounds, again.scale) == (p.fill, p.bounds, p.scale)
    with pytest.raises(clean.ContractError, match="DIFFERENT ORDER"):
        p.check_features(df.columns[::-1])


def test_store_is_permanent_and_guarded(spark, tmp_path):
    cols = "LOAN_ID long, SNAPSHOT_DATE long, NATIONAL_CODE string, DPD_DAYS int, WORST_FUTURE_CAT int"
    loans = spark.createDataFrame([(1, 20240101, "a", 5, 1), (2, 20240201, "b", 6, 0), (3, 20240301, "c", 7, None)], cols)
    led = spark.createDataFrame([(20240101, "LEGACY"), (20240201, " final ")], "SNAPSHOT_DATE long, STATUS string") \
        .withColumns({"LOANS_UNLABELLED": F.lit(None), "LOANS_MISSING_MONTHS": F.lit(None)})
    led = tables.label_ledger(led)
    assert {r["STATUS"] for r in led.collect()} == {"LEGACY", "FINAL"}
    path = str(tmp_path / "store")
    assert store.store_mature(loans, led.where("STATUS = 'LEGACY'"), path) == [20240101]
    assert store.store_mature(loans.withColumn("DPD_DAYS", F.lit(0)), led, path) == [20240201]
    kept = by(store.read_store(spark, path), "LOAN_ID")
    assert kept[1]["DPD_DAYS"] == 5 and kept[2]["DPD_DAYS"] == 0        # the first is not rewritten
    with pytest.raises(store.StoreError, match="not in the label ledger"):
        store.store_rows(loans.where("LOAN_ID = 3"), led, path)
    with pytest.raises(store.StoreError, match="unlabelled"):
        store.store_rows(loans.where("LOAN_ID = 1").withColumn("WORST_FUTURE_CAT", F.lit(None).cast("int")), led, path)
    built = spark.createDataFrame([(20240301, "2024-03-05")], "SNAPSHOT_DATE long, END_TIME string")
    opened = str(tmp_path / "open")
    last = loans.where("LOAN_ID = 3")
    assert store.store_open(last, built, opened) == [20240301]
    assert store.store_open(last, built, opened) == []
    assert store.store_open(last, built.withColumn("END_TIME", F.lit("2024-03-06")), opened) == [20240301]


def test_parts_with_other_features_are_refused(spark):
    a = spark.createDataFrame([(1, 2, 3)], "LOAN_ID long, DPD_DAYS int, LOAN_CATEGORY int")
    assert store.combine({"a": a, "b": a}).count() == 2
    with pytest.raises(clean.ContractError, match="DIFFERENT ORDER"):
        store.combine({"a": a, "b": a.select("LOAN_ID", "LOAN_CATEGORY", "DPD_DAYS")})
    with pytest.raises(clean.ContractError, match="LOAN_CATEGORY"):
        store.combine({"a": a, "b": a.drop("LOAN_CATEGORY")})


def test_called_log_is_optional(spark, tmp_path):
    assert tables.read_called_log(spark, None) is None
    assert tables.read_called_log(spark, str(tmp_path / "nothing.csv")) is None
    (tmp_path / "odd.csv").write_text("WHO,WHEN\na,2024-01-01\n")
    assert tables.read_called_log(spark, str(tmp_path / "odd.csv")) is None
    (tmp_path / "log.csv").write_text("NATIONAL_CODE,CALLED_AT\na,2024-01-01\n")
    assert tables.read_called_log(spark, str(tmp_path / "log.csv")).first()["CALLED_AT"].year == 2024
    with pytest.raises(ValueError, match="P_SEVERE"):
        tables.score_table(spark.createDataFrame([(1,)], "current_cat int"))


def test_store_with_another_feature_list_is_refused_by_name(spark, tmp_path):
    from loanwatch.operators.clean import ContractError
    from loanwatch.sources.store import read_store
    path = str(tmp_path / "store")
    months = store.SnapshotStore(spark, path)
    one_month = spark.createDataFrame([(20260101, 1, 5.0, 0)], "SNAPSHOT_DATE long, LOAN_ID long, DPD_DAYS double, LOAN_CATEGORY int")
    other = one_month.withColumn("SNAPSHOT_DATE", F.lit(20260201).cast("bigint"))
    for month, rows in ((20260101, one_month), (20260201, other)):
        assert months.fill(rows, [month], mature=False) == [month]
    assert sorted(r["SNAPSHOT_DATE"] for r in read_store(spark, path).collect()) == [20260101, 20260201]
    late = one_month.withColumn("SNAPSHOT_DATE", F.lit(20260301).cast("bigint")).withColumnRenamed("LOAN_CATEGORY", "RENAMED")
    months.fill(late, [20260301], mature=False)
    with pytest.raises(ContractError, match="20260301.*RENAMED"):
        read_store(spark, path)
    assert read_store(spark, path, [20260101, 20260201]).count() == 2


def test_rules_of_a_repeated_key_are_counted_from_a_few_numbers_a_key(spark):
    twice = feed(spark).unionByName(feed(spark, DAYS_SINCE_LAST_DPD=(1, 25), WORST_FUTURE_CAT=(0, None))).unionByName(
        feed(spark, MONTHS_IN_CURRENT_CATEGORY=(0, 7)))
    f = one(feed_checks.snapshot_facts(twice))
    assert (f["n"], f["surplus"], f["n_null"], f["lo"], f["hi"]) == (9, 6, 1, 20250731, 20250731)
    bad = {(r["rule"], r["detail"]): r["n_bad"] for r in feed_checks.feed_violations(twice).collect()}
    assert bad == {("ladder", "DAYS_SINCE_LAST_DPD > DAYS_SINCE_LAST_30_DPD"): 1, ("duplicate_key", "LOAN_ID, SNAPSHOT_DATE"): 6,
                   ("months_range", "MONTHS_IN_CURRENT_CATEGORY outside 1..6"): 1}
    plan = feed_checks.snapshot_facts(twice)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    by_key = [line for line in plan if "Aggregate [" in line][-1]
    assert by_key.count("count(") == 1 and "more fields" not in by_key


def test_rows_of_small_portfolios_travel_as_they_are_and_heavy_ones_are_combined(spark, monkeypatch):
    rows = [(i, None if i % 40 == 0 else ("big" if i < 120 else f"c{i % 90}"), 20250131 + i % 2, float(i % 11), i % 4, i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "LOAN_ID long, NATIONAL_CODE string, SNAPSHOT_DATE long, DPD_DAYS double, LOAN_CATEGORY int, WORST_FUTURE_CAT int")
    whole = grain.portfolio_features(df, ["DPD_DAYS"])
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "partial_" not in plan.split("Exchange")[1]                         # nothing is combined below the shuffle
    want = by(whole, *grain.KEYS)
    plain = by(df.groupBy(*grain.KEYS).agg(F.count(F.lit(1)).alias("N_LOANS"), F.stddev_pop("DPD_DAYS").alias("s"), F.avg("DPD_DAYS").alias("m")), *grain.KEYS)
    assert want.keys() == plain.keys()
    monkeypatch.setattr(grain, "HEAVY", 4)
    monkeypatch.setattr(grain, "TASK_ROWS", 50)
    got = by(grain.portfolio_features(df, ["DPD_DAYS"]), *grain.KEYS)
    for k, p in plain.items():
        for r in (want[k], got[k]):
            assert (r["N_LOANS"], r["MEAN_DPD_DAYS"], r["STD_DPD_DAYS"]) == (p["N_LOANS"], pytest.approx(p["m"]), pytest.approx(p["s"], abs=1e-9))
        assert tuple(got[k])[:5] == tuple(want[k])[:5]
