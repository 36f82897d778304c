"""Arms, calibration, artifacts and whole plans: properties, not values."""
import numpy as np
import pytest
from support import by, one
from pyspark.sql import functions as F

from loanwatch.operators import arms, calibrate, decide
from loanwatch.plans import monitor as monitor_plan
from loanwatch.plans import score, train
from loanwatch.sources import artifact
from loanwatch.sources import derived as D

SF = "/root/testdata/sf0.001"
SMALL = {"n_trees": 3, "max_depth": 2, "learning_rate": 0.3}
FEATS = ["DPD_DAYS", "REMAINING_AMNT"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 1500
    cat = rng.integers(0, 4, n)
    y = np.minimum(3, cat + (rng.random(n) < .4) * rng.integers(0, 4, n))
    x = y * 30 + rng.normal(0, 20, n)
    return spark.createDataFrame(
        [(i, 1, int(cat[i]), int(y[i]), float(x[i]), float(i % 7)) for i in range(n)],
        "LOAN_ID long, SNAPSHOT_DATE long, CURRENT_CAT int, LABEL int, DPD_DAYS double, REMAINING_AMNT double").cache()


@pytest.mark.parametrize("kind", ["multiclass", "binary", "ordinal", "per_cat"])
def test_arm_gives_a_distribution_that_ranks(rows, kind):
    arm = arms.fit_arm(kind, rows, FEATS, SMALL)
    out = arm.predict(rows)
    p = [F.col(c) for c in decide.RAW]
    bad = out.where((F.abs(p[0] + p[1] + p[2] + p[3] - 1) > 1e-9) | (F.least(*p) < 0))
    assert bad.count() == 0 and out.count() == rows.count()
    base = one(rows.where("CURRENT_CAT < 3").agg(F.avg((F.col("LABEL") == 3).cast("int"))))[0]
    assert arms.ranked_severe_ap(out) > base + .1
    if kind == "per_cat":            # nothing below the category, all on 3 for severe rows
        assert out.where("CURRENT_CAT = 2 and p0 + p1 > 0").count() == 0
        assert out.where("CURRENT_CAT = 3 and p3 < 1").count() == 0


@pytest.mark.parametrize("kind", ["multiclass", "per_cat"])
def test_fit_does_not_depend_on_the_order_or_layout_of_rows(rows, kind):
    params = {**SMALL, "subsample": 0.6}
    a = arms.fit_arm(kind, rows, FEATS, params)
    b = arms.fit_arm(kind, rows.repartition(7).orderBy(F.rand(5)), FEATS, params)
    assert a.models.keys() == b.models.keys()
    assert all(x == y if isinstance(x, float) else x.toDebugString.split("\n")[1:] == y.toDebugString.split("\n")[1:]
               for x, y in ((a.models[k], b.models[k]) for k in a.models))


def test_arm_survives_missing_classes(rows):
    few = rows.where("LABEL in (0, 3) and CURRENT_CAT = 0")
    for kind in ("multiclass", "ordinal", "per_cat"):
        out = arms.fit_arm(kind, few, FEATS, SMALL).predict(few)
        assert out.where("p0 + p3 < 0.999").count() == 0
    single = rows.where("LABEL = 0 and CURRENT_CAT = 0")
    out = arms.fit_arm("per_cat", single, FEATS, SMALL).predict(rows)
    assert out.where("p0 + p1 + p2 + p3 <> 1 or element_at(array(p0, p1, p2, p3), CURRENT_CAT + 1) <> 1").count() == 0


def test_tuning_needs_a_ranked_severe_row(rows):
    with pytest.raises(ValueError, match="cannot tune"):
        arms.tune_arm("multiclass", rows, rows.where("CURRENT_CAT = 3"), FEATS)


def _pav(x, y):
    """Brute-force isotonic fit: blocks of (x, mean) after pooling."""
    xs = np.unique(x)
    blocks = [[float(y[x == v].mean()), int((x == v).sum()), [v]] for v in xs]
    i = 0
    while i < len(blocks) - 1:
        if blocks[i][0] > blocks[i + 1][0] + 1e-15:
            a, b = blocks[i], blocks.pop(i + 1)
            blocks[i] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]]
            i = max(i - 1, 0)
        else:
            i += 1
    return {v: m for m, _, vs in blocks for v in vs}


def test_isotonic_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    s = rng.integers(0, 40, 3000) / 40
    y = np.where(rng.random(3000) < s ** 2, 3, 0)
    df = spark.createDataFrame([(0, int(b), float(1 - a), 0., 0., float(a)) for a, b in zip(s, y)],
                               "CURRENT_CAT int, LABEL int, p0 double, p1 double, p2 double, p3 double")
    cal = calibrate.fit_calibrator(df, stratified=False)
    got = cal.transform(df.withColumn("raw", F.col("p3"))).select("raw", "p0", "p3").distinct().collect()
    want3, want0 = _pav(s, (y == 3).astype(float)), _pav(1 - s, (y == 0).astype(float))
    for r in got:
        a, b = max(want3[r["raw"]], 1e-6), max(want0[1 - r["raw"]], 1e-6)
        assert r["p3"] == pytest.approx(a / (a + b + 2e-6), abs=1e-6)


def test_small_strata_use_the_pooled_models(spark):
    df = spark.range(600).select((F.col("id") % 6 == 0).cast("int").alias("CURRENT_CAT"),
                                 F.when(F.col("id") % 3 == 0, 3).otherwise(0).alias("LABEL"),
                                 (F.col("id") % 5 / 10 + .1).alias("p3")).withColumns(
        {"p0": 1 - F.col("p3"), "p1": F.lit(0.), "p2": F.lit(0.)})
    cal = calibrate.fit_calibrator(df, min_stratum_n=300)
    assert cal.strata == [0]
    out = cal.transform(df)
    assert out.where("abs(p0 + p1 + p2 + p3 - 1) > 1e-9").count() == 0
    assert calibrate.refresh(cal, df.withColumn("LABEL", F.lit(None).cast("int"))) is cal


def test_scoring_params_fill_in_and_keep_what_is_set(caplog):
    p = score.ScoringParams("m", carve_category=9).resolve()
    assert p.carve_category == 9 and p.ttl_days == 30 and "knob(s) not set" in caplog.text
    assert p.resolve().carve_category == 9
    with pytest.raises(ValueError):
        score.ScoringParams("").resolve()


def test_train_store_score(spark, tmp_path):
    from loanwatch.sources.tables import label_ledger
    led = label_ledger(D.ledger_table(spark, SF))
    loans = D.feed_with_open_labels(spark, SF)
    res = train.train_fold(train.static_split(loans, led), D.FEED_FEATURES, led, arms=("multiclass",), params=SMALL,
                           draws=20, min_stratum_n=200)
    assert res.deployed == "multiclass" and res.intervals.count() == 4
    ap = by(res.metrics.where("block = 'ranking'"), "metric")
    assert ap["pr_auc"]["value"] > ap["base_rate"]["value"]
    path = str(tmp_path / "model")
    artifact.save(res.model, spark, path)
    back = artifact.load(spark, path)
    test = loans.where("SNAPSHOT_DATE = 20010601")
    a, b = (by(m.probs(test), "LOAN_ID") for m in (res.model, back))
    assert all(a[k]["p3"] == pytest.approx(b[k]["p3"]) for k in a)
    q = score.predict(spark, loans, led, score.ScoringParams(path, min_stratum_n=200, output_folder=str(tmp_path / "out")),
                      [20010601])
    n = q.where("RULE_FLAG = ''").count()
    assert sorted(r[0] for r in q.where("RISK_RANK is not null").select("RISK_RANK").collect()) == list(range(1, n + 1))
    shuffled = test.select(*reversed(test.columns)).withColumn("COLUMN_72", F.lit(1)).repartition(5)
    c = by(back.probs(shuffled), "LOAN_ID")
    assert all(a[k]["p3"] == pytest.approx(c[k]["p3"]) for k in a)
    with pytest.raises(ValueError, match="DPD_DAYS"):
        back.probs(test.drop("DPD_DAYS"))
    with pytest.raises(ValueError, match="cannot be deployed"):
        train.train_fold(loans, D.FEED_FEATURES, deploy="binary")


def test_artifact_without_features_is_refused(spark, tmp_path):
    from loanwatch.operators.preprocess import Preprocessor
    m = artifact.Model(Preprocessor([]), arms.Arm("binary", [], {"severe": 1.0}), None, [])
    artifact.save(m, spark, str(tmp_path / "m"))
    with pytest.raises(artifact.ArtifactError, match="feature list"):
        artifact.load(spark, str(tmp_path / "m"))


def test_monitor_end_to_end(spark, tmp_path):
    t = monitor_plan.EngineTables(D.run_log(spark, SF), D.engine_output(spark, SF), D.contract_tracking(spark, SF),
                                  D.ledger_table(spark, SF), D.monitor_state_log(spark, SF),
                                  D.feed_with_open_labels(spark, SF))
    paths = monitor_plan.run_monitor(t, D.MONITOR_ASOF, str(tmp_path))
    hist = spark.read.parquet(paths["history"])
    assert hist.where("VINTAGE_START").count() == 1 and hist.count() > 50
    assert {r[0] for r in spark.read.parquet(paths["routing"]).select("COHORT").distinct().collect()} >= {"matured", "interim"}
    assert spark.read.csv(str(tmp_path / "history"), header=True).count() == hist.count()


def test_the_loan_table_of_a_model_query_is_derived_once(spark, monkeypatch):
    from loanwatch.plans.queries import models
    calls, seen, real = [], {}, D.loan_feed
    monkeypatch.setattr(models.D, "loan_feed", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(models.TR, "train_fold", lambda rows, *a, **k: seen.update(rows=rows) or (_ for _ in ()).throw(InterruptedError))
    with pytest.raises(InterruptedError):
        models._j3m(spark, SF)
    assert calls == [1]
    plan = seen["rows"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan                  # rows of the written table


def test_many_rows_are_fitted_one_model_at_a_time(rows, monkeypatch):
    sizes, real = [], arms.ThreadPool
    monkeypatch.setattr(arms, "ThreadPool", lambda n: sizes.append(n) or real(n))
    a = arms.fit_arm("multiclass", rows, FEATS, SMALL)
    monkeypatch.setattr(arms, "MANY_ROWS", 100)
    b = arms.fit_arm("multiclass", rows, FEATS, SMALL)
    assert sizes == [4, 1] and all(a.models[k].toDebugString.split("\n")[1:] == b.models[k].toDebugString.split("\n")[1:] for k in a.models)


@pytest.mark.parametrize("kind", ["multiclass", "per_cat"])
def test_binned_rows_give_mllibs_trees_where_nothing_is_drawn(rows, kind, monkeypatch):
    params = {**SMALL, "subsample": 1.0, "colsample": 1.0}
    a = arms.fit_arm(kind, rows, FEATS, params)
    monkeypatch.setattr(arms, "BINNED_ROWS", 100)
    monkeypatch.setattr(arms.boosting, "BLOCK_ROWS", 200)
    monkeypatch.setattr(arms.boosting, "KEEP_TREES", 2)
    monkeypatch.setattr(arms.boosting, "DIRECT_BYTES", 1000)
    b = arms.fit_arm(kind, rows, FEATS, params)
    assert a.models.keys() == b.models.keys() and a.strata == b.strata
    p, q = (by(x.predict(rows), "LOAN_ID") for x in (a, b))
    assert all(p[k][c] == pytest.approx(q[k][c], abs=1e-9) for k in p for c in decide.RAW)


def test_binned_trees_do_not_depend_on_the_order_or_layout_of_rows(rows, monkeypatch):
    monkeypatch.setattr(arms, "BINNED_ROWS", 100)
    a = arms.fit_arm("binary", rows, FEATS, SMALL)
    b = arms.fit_arm("binary", rows.repartition(5).orderBy(F.rand(5)), FEATS, SMALL)
    assert a.models["severe"].toDebugString.split("\n")[1:] == b.models["severe"].toDebugString.split("\n")[1:]
    assert arms.ranked_severe_ap(a.predict(rows)) > one(rows.where("CURRENT_CAT < 3").agg(F.avg((F.col("LABEL") == 3).cast("int"))))[0] + .1


def test_preprocessing_leaves_no_tables_and_many_portfolio_rows_are_dealt_first(rows, monkeypatch):
    from loanwatch import session
    from loanwatch.operators.preprocess import Preprocessor
    loans = rows.withColumns({"NATIONAL_CODE": (F.col("LOAN_ID") % 300).cast("string"), "LOAN_CATEGORY": F.col("CURRENT_CAT"), "WORST_FUTURE_CAT": F.col("LABEL")}).drop("CURRENT_CAT", "LABEL")
    held = list(session._PINS)
    pre = Preprocessor(FEATS).fit(loans)
    assert session._PINS == held
    few = artifact.shape_rows(loans, pre, FEATS, "portfolio")
    monkeypatch.setattr(artifact, "BINNED_ROWS", 100)
    many = artifact.shape_rows(loans, pre, FEATS, "portfolio")
    assert ["RepartitionByExpression" in x._jdf.queryExecution().optimizedPlan().toString() for x in (few, many)] == [False, True]
    a, b = (by(x, "NATIONAL_CODE") for x in (few, many))
    assert a.keys() == b.keys() and all(a[k][c] == pytest.approx(b[k][c]) for k in a for c in few.columns if c != "NATIONAL_CODE")
