"""Whitening and its rank-one updates against dense eigendecompositions."""

import math

import numpy as np
import pytest

from loanwatch.llm import secular, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long, component string"


def scatter(x):
    away = x - x.mean(axis=0)
    return away.T @ away


@pytest.mark.parametrize("kind", ["dense", "whole", "low rank", "copies", "scales", "one", "two"])
def test_rank_one_updates_keep_the_spectrum(kind):
    r = np.random.default_rng(3)
    n = {"one": 1, "two": 2}.get(kind, 12)
    x = r.normal(size=(3, 40, n))
    if kind == "whole":
        x = np.floor(2 * x)
    elif kind == "low rank":
        x[:, :, 3:] = x[:, :, :1]
    elif kind == "copies":
        x = np.repeat(x[:, :4], 10, axis=1)
    elif kind == "scales":
        x = x * np.logspace(-7, 5, n)
    values, vectors = np.zeros((3, n)), np.repeat(np.eye(n)[None], 3, axis=0)
    for i in range(1, 40):
        values, vectors = secular.update(values, vectors, np.full(3, i / (i + 1)), x[:, i] - x[:, :i].mean(axis=1))
    for k in range(3):
        want = scatter(x[k])
        assert np.abs((vectors[k] * values[k]) @ vectors[k].T - want).max() <= 1e-12 * np.abs(want).max()
        assert np.abs(vectors[k].T @ vectors[k] - np.eye(n)).max() < 1e-13
        assert (np.diff(values[k]) >= 0).all()
    both, turned = secular.merge((values[0], vectors[0]), (values[1], vectors[1]))
    assert np.abs((turned * both) @ turned.T - scatter(x[0]) - scatter(x[1])).max() <= 1e-12 * np.abs(both).max()


def test_nothing_and_equal_directions_are_deflated():
    values, vectors = np.array([[1.0, 1.0, 2.0]]), np.eye(3)[None]
    got, turned = secular.update(values, vectors, np.ones(1), np.zeros((1, 3)))
    assert (got == values).all() and (turned == vectors).all()
    got, turned = secular.update(values, vectors, np.ones(1), np.array([[1.0, 1.0, 0.0]]))
    assert np.allclose(got, [[1, 2, 3]]) and np.allclose((turned[0] * got[0]) @ turned[0].T, np.diag([1, 1, 2.0]) + np.outer([1, 1, 0], [1, 1, 0]))


def brute(rows):
    """(n, deviations by row, whitened by row up to sign, explained) of rows of one length."""
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for v in rows]
    u = np.array(sorted(set(map(tuple, x))))
    n, sums = len(u), [sum(c) for c in zip(*u.tolist(), strict=True)]
    values, vectors = np.linalg.eigh(scatter(u.astype(float)) / n)
    order = np.argsort(-values)[:4]
    white = (np.array(x) - np.array(sums) / n) @ vectors[:, order]
    return n, [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x], white, values[order], values.sum()


def test_awkward_vectors_equal_brute_force(spark):
    r = np.random.default_rng(1)
    long = [[float(c) for c in r.normal(size=6)] for _ in range(60)]
    flat = [[1.0, 2.0, float(k)] for k in range(5)]                    # two dimensions are constant
    rows = [(i, v) for i, v in enumerate(long)] + [(i, long[0]) for i in range(100, 180)] + [(200 + i, v) for i, v in enumerate(flat)]
    rows += [(5, long[1]), (None, long[2]), (300, [0.25])]
    bad = [(400, None), (401, []), (402, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (403, [math.nan] * 6), (404, [math.inf, 0.0, 0.0]), (405, [1e30] * 6)]
    frame = spark.createDataFrame([(i, v, 1, "x", 2, "y") for i, v in rows + bad], SCHEMA)
    got = whitening.whiten(frame).collect()
    for dim in (6, 3, 1):
        part = [(i, v) for i, v in rows if len(v) == dim]
        n, deviation, white, values, trace = brute([v for _, v in part])
        k = min(4, dim)
        mine = [g for g in got if g["vec_id"] in {i for i, _ in part} and g["n"] == n]
        assert len(mine) == k * len(part)
        assert sorted((str(g["vec_id"]), g["deviation"]) for g in mine if g["component"] == 1) == sorted((str(i), d) for (i, _), d in zip(part, deviation, strict=True))
        for c in range(k):
            column = [((g["vec_id"], g["deviation"]), g["whitened"]) for g in mine if g["component"] == c + 1]
            if trace == 0 or values[c] < 1e-12 * trace:
                assert all(w is None for _, w in column)
                continue
            want = [((i, d), w / math.sqrt(values[c])) for (i, _), d, w in zip(part, deviation, white[:, c].tolist(), strict=True)]
            by_id = dict(column)
            sign = math.copysign(1, sum(by_id[i] * w for i, w in want))
            assert all(abs(by_id[i] * sign - w) < 1e-9 for i, w in want)
            share = {g["explained"] for g in mine if g["component"] == c + 1}
            assert len(share) == 1 and abs(share.pop() - values[c] / trace) < 1e-12
        errors = {g["identity_error"] for g in mine}
        assert len(errors) == 1 and (errors == {None} if dim == 1 else errors.pop() < 1e-9)
    assert not [g for g in got if g["vec_id"] in range(400, 410)]


def test_a_tree_of_many_partitions_gives_the_same_fit(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(c) for c in r.normal(size=5) * (1 + np.arange(5))]) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n, coalesce in (("1", "true"), ("70", "false")):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            seen.append(whitening.fit(whitening.whole_vectors(frame))[5])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    a, b = seen
    assert np.allclose(a.eigenvalues, b.eigenvalues, rtol=1e-13) and (a.sums == b.sums).all()
    assert np.allclose(np.abs((a.components * b.components).sum(axis=0)), 1, atol=1e-12)


def test_no_vectors(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 1, "x", 2, "y")], SCHEMA)).count() == 0


def test_deviations_beyond_a_long_are_null():
    x = np.array([[1 << 40, 0], [3, 4]])
    assert whitening._deviations(x, 1 << 10, np.array([0, 0])) == [None, (3 << 10) ** 2 + (4 << 10) ** 2]
