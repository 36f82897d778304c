"""Global positions, running sums and quantiles against plain computation."""
import numpy as np
import pytest
from support import by
from pyspark.sql import functions as F

from loanwatch.functions.position import with_position, with_running_sum
from loanwatch.functions.quantiles import quantiles
from loanwatch.session import small_side


@pytest.fixture(scope="module")
def tied(spark):
    # A third of all rows on one score, the rest on 20 more; two very unequal groups.
    return spark.range(0, 20000, 1, 7).select(
        F.col("id").alias("LOAN_ID"),
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") * 7919 % 20 / 20).alias("s"),
        F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("g"))


def test_position_equals_plain_sort(tied):
    got = [(r["POS"], r["LOAN_ID"]) for r in
           with_position(tied, [F.col("s").desc(), F.col("LOAN_ID").asc()]).collect()]
    want = sorted(((-r["s"], r["LOAN_ID"]) for r in tied.collect()))
    assert sorted(got) == [(i, loan) for i, (_, loan) in enumerate(want, 1)]


def test_position_restarts_in_groups_and_reports_totals(tied):
    got = with_position(tied, [F.col("s").desc(), F.col("LOAN_ID").asc()], within=["g"], total="N").collect()
    for g in ("a", "b"):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: (-r["s"], r["LOAN_ID"]))
        assert [r["POS"] for r in mine] == list(range(1, len(mine) + 1))
        assert {r["N"] for r in mine} == {len(mine)}


def test_position_does_not_depend_on_arrival(tied):
    order = [F.col("s").desc(), F.col("LOAN_ID").asc()]
    a = by(with_position(tied, order), "LOAN_ID")
    b = by(with_position(tied.repartition(11).orderBy(F.rand(3)), order), "LOAN_ID")
    assert all(a[k]["POS"] == b[k]["POS"] for k in a)


def test_running_sum(tied):
    got = with_running_sum(tied.withColumn("w", F.col("LOAN_ID") % 5), [F.col("LOAN_ID").asc()],
                           {"cum": "w"}, within=["g"]).collect()
    for g in ("a", "b"):
        run = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["LOAN_ID"]):
            run += r["w"]
            assert r["cum"] == run


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [("x", float(v)) for v in rng.normal(size=777)] + [("y", float(v)) for v in rng.integers(0, 4, 500)]
    rows += [("x", None), ("z", 5.0)]
    df = spark.createDataFrame(rows, "f string, v double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = by(quantiles(df, ["f"], "v", probs), "f", "prob")
    for f in "xyz":
        vals = [v for g, v in rows if g == f and v is not None]
        for p in probs:
            assert got[(f, p)]["value"] == pytest.approx(np.quantile(vals, p), abs=1e-12)
    counted = df.groupBy("f", "v").agg(F.count(F.lit(1)).alias("n"))
    weighted = by(quantiles(counted, ["f"], "v", probs, weight="n"), "f", "prob")
    assert all(weighted[k]["value"] == got[k]["value"] for k in got)
    rough = by(quantiles(df, ["f"], "v", [0.5], method="approx"), "f", "prob")
    assert rough[("x", 0.5)]["value"] == pytest.approx(np.quantile([v for g, v in rows if g == "x" and v is not None], .5), abs=.05)


def test_quantiles_without_groups(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert {r["prob"]: r["value"] for r in quantiles(df, [], "v", [0.1, 0.5]).collect()} == {0.1: 10.0, 0.5: 50.0}


def test_small_side_falls_back_when_it_is_not_small(spark):
    df = spark.range(50)
    assert small_side(df, 10) is df
    assert small_side(df, 50).count() == 50


def test_positions_take_one_range_shuffle_and_no_join_on_slices(tied):
    order = [F.col("s").desc(), F.col("LOAN_ID").asc()]
    plan = with_position(tied, order)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan            # the sorted frame is written; what is read back needs no shuffle
    grouped = with_position(tied, order, within=["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert grouped.count("Join") == 1 and "__part" not in grouped.split("Join")[1].split("\n")[0]


def test_call_list_files_follow_the_call_order(spark, tmp_path):
    from loanwatch.operators.queue import with_rank
    from loanwatch.sources.store import write_queue
    rows = spark.range(500).select(
        F.lit(20260101).cast("bigint").alias("SNAPSHOT_DATE"), F.col("id").alias("LOAN_ID"), F.col("id").cast("string").alias("NATIONAL_CODE"),
        (F.hash("id") % 97 / 97.0).alias("RISK_SCORE"), F.lit(1).alias("CURRENT_CAT"),
        F.when(F.col("id") % 9 == 0, "RECENTLY_CALLED").otherwise("").alias("RULE_FLAG"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = write_queue(with_rank(rows.repartition(7)), str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    import csv
    import glob
    files = sorted(glob.glob(f"{path}/part-*.csv"))
    got = [r["RISK_RANK"] for f in files for r in csv.DictReader(open(f))]
    ranked = [int(x) for x in got if x]
    assert len(files) > 1 and ranked == list(range(1, len(ranked) + 1)) and not any(got[len(ranked):]) and len(got) == 500


def test_few_groups_are_joined_without_gathering_a_group(spark, tied):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        frames = (with_position(tied, [F.col("s").desc(), F.col("LOAN_ID").asc()], within=["g"], total="N"),
                  with_running_sum(tied.withColumn("w", F.lit(1)), [F.col("LOAN_ID").asc()], {"cum": "w"}, within=["g"]))
        plans = [f._jdf.queryExecution().executedPlan().toString() for f in frames]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)
