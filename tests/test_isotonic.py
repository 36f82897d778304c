"""Isotonic fits over slices against pooling in one place, and look-ups against interpolation."""
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loanwatch.operators import calibrate
from loanwatch.operators.isotonic import isotonic_blocks, look_up, pool, segments


def brute(points):
    """Greatest convex minorant by the max-min formula; points (score, n, hits) with distinct scores."""
    points = sorted(points)
    n = np.cumsum([0, *[p[1] for p in points]])
    h = np.cumsum([0, *[p[2] for p in points]])
    fit = [max(min((h[k] - h[j]) / (n[k] - n[j]) for k in range(i + 1, len(points) + 1)) for j in range(i + 1)) for i in range(len(points))]
    return [(p[0], v) for p, v in zip(points, fit, strict=True)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 4)), min_size=1, max_size=25), st.integers(1, 25))
def test_pooling_is_associative_and_least_squares(counts, cut):
    points = [(i / 7, n, min(n, h)) for i, (n, h) in enumerate(counts)]
    single = [(s, s, n, h) for s, n, h in points]
    whole = pool(single)
    assert pool(pool(single[:cut]) + pool(single[cut:])) == whole
    for s, v in brute(points):
        (block,) = [b for b in whole if b[0] <= s <= b[1]]
        assert block[3] / block[2] == pytest.approx(v, abs=1e-12)


def curves(seed):
    """Curves with ties, constants, one row, a NULL key, and one that spans many slices."""
    r = np.random.default_rng(seed)
    out = {(0, 0): [(0.5, 9, 4)], (0, 1): [(k / 10, 3, 0) for k in range(11)], (1, 0): [(k / 10, 2, 2) for k in range(5)],
           (None, 0): [(float(s), 1, int(r.random() < s)) for s in np.unique(r.random(400))],
           (None, 1): [(float(s), int(r.integers(1, 5)), 1) for s in np.unique(np.round(r.random(80), 2))],
           (2, 1): [(float(s), 1, int(r.random() < 1 - s)) for s in np.unique(r.random(60))],
           (3, 0): [(-1e300, 1, 0), (-0.5, 2, 1), (0.0, 1, 0), (1e-9, 1, 1), (1.0, 3, 2), (7.5, 2, 2)]}
    return out


@pytest.mark.parametrize("partitions", [1, 3, 70])
def test_blocks_do_not_depend_on_the_slices(spark, partitions):
    want = curves(1)
    rows = [(a, b, s, n, h) for (a, b), ps in want.items() for s, n, h in ps] + [(0, 0, None, 5, 5)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = isotonic_blocks(spark.createDataFrame(rows, "a int, b int, score double, n int, hits int"), ["a", "b"]).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for (a, b), ps in want.items():
        mine = sorted((r for r in got if (r["a"], r["b"]) == (a, b)), key=lambda r: r["block"])
        assert [(r["lo"], r["hi"], r["n"], r["hits"]) for r in mine] == pool([(s, s, n, h) for s, n, h in sorted(ps)])
        assert [r["block"] for r in mine] == list(range(len(mine)))
        assert [r["next_lo"] for r in mine] == [*[r["lo"] for r in mine[1:]], None]
    assert sum(len(pool([(s, s, n, h) for s, n, h in sorted(ps)])) for ps in want.values()) == len(got)


def test_look_up_interpolates_and_clips(spark):
    rows = [(a, b, s, n, h) for (a, b), ps in curves(2).items() for s, n, h in ps]
    blocks = isotonic_blocks(spark.createDataFrame(rows, "a int, b int, score double, n int, hits int"), ["a", "b"])
    table = segments(blocks)
    by_curve = {}
    for r in sorted(blocks.collect(), key=lambda r: r["block"]):
        xs, ys = by_curve.setdefault((r["a"], r["b"]), ([], []))
        xs += [r["lo"], r["hi"]]
        ys += [r["hits"] / r["n"]] * 2
    r = np.random.default_rng(3)
    scores = [float(x) for x in r.random(60)] + [0.0, -0.0, 1.0, -3.0, 9.0, 1e-300, 1 - 1e-16, 0.5]
    scores += [x for xs, _ in by_curve.values() for x in xs]
    asked = [(a, b, s, 1, "lo") for a, b in by_curve for s in scores] + [(0, 0, None, 1, "x"), (0, 0, float("nan"), 1, "x"), (9, 9, 0.5, 1, "x")]
    df = spark.createDataFrame(asked, "a int, b int, score double, n int, lo string")
    got = look_up(df, table, "score", {"a": F.col("a"), "b": F.col("b")}, "fit")
    assert got.columns == [*df.columns, "fit"]
    rows = got.collect()
    assert len(rows) == len(asked)
    for x in rows:
        if x["score"] is None or x["score"] != x["score"] or x["a"] == 9:
            assert x["fit"] is None
        else:
            assert x["fit"] == pytest.approx(float(np.interp(x["score"], *by_curve[x["a"], x["b"]])), abs=1e-12)


def test_transform_joins_a_table_and_runs_no_python(spark):
    df = spark.range(3000).select((F.col("id") % 3).cast("int").alias("CURRENT_CAT"), (F.col("id") % 4).cast("int").alias("LABEL"),
                                  *[((F.col("id") * (k + 3)) % 101 / 100).alias(f"p{k}") for k in range(4)])
    cal = calibrate.fit_calibrator(df, min_stratum_n=500)
    assert cal.strata == [0, 1, 2]
    plan = cal.transform(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 4 and not re.search("Python|Arrow|NestedLoop|Cartesian", plan)
    assert cal.transform(df.withColumn("CURRENT_CAT", F.lit(None).cast("int"))).where("abs(p0 + p1 + p2 + p3 - 1) > 1e-9").count() == 0
    assert cal.transform(df.withColumn("p1", F.lit(None).cast("double"))).where("p0 is not null").count() == 0


def test_the_bucket_of_a_score_is_a_column_before_the_join(spark):
    blocks = spark.createDataFrame([(0, .1, .2, 10, 1, .3, .5), (1, .3, .4, 10, 5, None, None)],
                                   "block int, lo double, hi double, n long, hits long, next_lo double, next_value double")
    df = spark.createDataFrame([(.05,), (.25,), (.9,), (None,), (float("nan"),)], "p double")
    out = look_up(df, segments(blocks), "p", {}, "q")
    assert [r["q"] for r in out.collect()] == [pytest.approx(.1), pytest.approx(.3), pytest.approx(.5), None, None]
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in line]
    assert joins and not any("LOG2" in line.upper() for line in joins)
