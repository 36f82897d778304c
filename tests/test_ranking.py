"""Ranking metrics worked out by hand."""
import pytest
from support import by, one
from pyspark.sql import functions as F

from loanwatch import constants as C
from loanwatch.operators import classify, decide, ranking

RATE = C.CALLS_PER_HOUR


def frame(spark, label, score, cat=None):
    rows = [(i, 20250101, int(y), float(s), int((cat or [0] * len(label))[i]))
            for i, (y, s) in enumerate(zip(label, score))]
    return spark.createDataFrame(rows, "LOAN_ID long, SNAPSHOT_DATE long, LABEL int, SCORE double, CURRENT_CAT int")


LABEL = [3, 3, 0, 1, 2, 0, 0, 1, 0, 3]
SCORE = [.9, .8, .7, .6, .5, .4, .3, .2, .15, .1]


def test_recall_precision_lift(spark):
    m = one(ranking.ranking_metrics(frame(spark, LABEL, SCORE), windows={"test": 3 / RATE}))
    assert (m["n_ranked"], m["n_severe"], m["k_test"]) == (10, 3, 3)
    assert m["recall_test"] == pytest.approx(2 / 3) and m["precision_test"] == pytest.approx(2 / 3)
    assert m["lift_test"] == pytest.approx((2 / 3) / 0.3)
    assert m["pr_auc"] == pytest.approx((1 + 1 + 3 / 10) / 3)


def test_already_severe_rows_leave_the_population(spark):
    df = frame(spark, LABEL, SCORE, [3, 0, 0, 1, 2, 0, 0, 1, 0, 2])
    m = one(ranking.ranking_metrics(ranking.ranked_population(df)))
    assert (m["n_ranked"], m["n_severe"]) == (9, 2)


def test_ties_are_decided_by_the_key(spark):
    w = {"one": 1 / RATE}
    assert one(ranking.ranking_metrics(frame(spark, [0, 3], [.5, .5]), windows=w))["recall_one"] == 0
    assert one(ranking.ranking_metrics(frame(spark, [3, 0], [.5, .5]), windows=w))["recall_one"] == 1


def test_slice_without_positives_has_counts_only(spark):
    m = one(ranking.ranking_metrics(frame(spark, [0, 1, 2], [.1, .2, .3])))
    assert m["n_severe"] == 0 and m["pr_auc"] is None and m["k_1_day"] is None


def test_tied_scores_share_one_precision(spark):
    # 4 rows on one score, 2 severe: AP is the base rate whatever the order.
    df = classify.severe_hits(frame(spark, [3, 0, 3, 0], [.5] * 4))
    assert one(ranking.average_precision(df))["pr_auc"] == pytest.approx(0.5)


def test_capture_curve_ends_at_one(spark):
    c = sorted(ranking.capture_curve(frame(spark, LABEL, SCORE)).collect(), key=lambda r: r["k"])
    assert [r["k"] for r in c] == list(range(1, 11)) and c[-1]["recall"] == 1.0
    single = one(ranking.capture_curve(frame(spark, [3], [.5])))
    assert (single["k"], single["recall"]) == (1, 1.0)


def test_exposure_deciles_are_equal_count(spark):
    df = frame(spark, [0] * 23, [.1] * 23).withColumn("REMAINING_AMNT", F.lit(5.0))
    n = [r["n_ranked"] for r in ranking.exposure_decile_metrics(df).orderBy("DECILE").collect()]
    assert n == [3, 2, 2, 3, 2, 2, 3, 2, 2, 2]
    assert ranking.exposure_decile_metrics(df.limit(9)).count() == 0


def test_decision_layer(spark):
    df = spark.createDataFrame([(.45, .20, .30, .05, 2), (.90, .06, .03, .01, 0), (1., 0., 0., 0., 3)],
                               "p0 double, p1 double, p2 double, p3 double, CURRENT_CAT int")
    raw = df.withColumn("d", decide.cost_decision([F.col(p) for p in decide.RAW])).withColumn(
        "z", decide.do_nothing_cost([F.col(p) for p in decide.RAW])).collect()
    assert [r["d"] for r in raw][:2] == [2, 0]
    assert raw[0]["z"] == pytest.approx(.20 * 1.5 + .30 * 4 + .05 * 7.5)
    m = decide.with_monotone_mask(df).collect()
    assert (m[0]["m0"], m[0]["m1"]) == (0, 0) and m[0]["m2"] == pytest.approx(.30 / .35)
    assert [m[1][c] for c in decide.MASKED] == pytest.approx([.90, .06, .03, .01])
    assert [m[2][c] for c in decide.MASKED] == [0, 0, 0, 1]           # everything masked away


def test_classification_metrics(spark):
    pairs = [(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2 + [(2, 3)] + [(3, 3)] * 2 + [(3, 0)]
    df = spark.createDataFrame(pairs, "LABEL int, PRED int")
    m = one(classify.classification_metrics(df))
    assert m["accuracy"] == pytest.approx(.7)
    assert m["macro_f1"] == pytest.approx((6 / 8 + 4 / 5 + 0 + 4 / 6) / 4)
    assert m["recall_class_2"] == 0 and m["recall_class_3"] == pytest.approx(2 / 3)
    assert m["avg_cost"] == pytest.approx((.5 + .5 + 7.5) / 10)
    w = lambda i, j: (i - j) ** 2
    row, col = [4, 2, 1, 3], [4, 3, 0, 3]
    exp = sum(w(i, j) * row[i] * col[j] / 10 for i in range(4) for j in range(4))
    assert m["qwk"] == pytest.approx(1 - sum(w(*p) for p in pairs) / exp)
    flat = one(classify.classification_metrics(spark.createDataFrame([(3, 3)] * 4, "LABEL int, PRED int")))
    assert flat["qwk"] is None and flat["macro_f1"] == .25


def test_bootstrap_brackets_the_point_estimate(spark):
    df = spark.range(2000).select((F.col("id") % 4).cast("int").alias("LABEL"),
                                  F.when(F.col("id") % 5 == 0, 0).otherwise(F.col("id") % 4).cast("int").alias("PRED"))
    m, ci = one(classify.classification_metrics(df)), by(classify.bootstrap_intervals(df, draws=200), "metric")
    for k in ("macro_f1", "qwk", "recall_class_2", "recall_class_3"):
        assert ci[k]["lower_ci"] < m[k] < ci[k]["upper_ci"]


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([("a", 1., 1), ("a", 1., 0), ("a", 2., 1), ("a", 0., 0)], "class string, score double, hit int")
    assert one(classify.auc(df))["auc"] == pytest.approx((0.5 + 1 + 1 + 1) / 4)
    pts = classify.roc_points(df).orderBy(F.desc("threshold")).collect()
    assert [(r["fpr"], r["tpr"]) for r in pts] == [(0, .5), (.5, 1), (1, 1)]
