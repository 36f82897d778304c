"""Exact top-k and embedding near-dedup against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_dedup import brute_components

from loanwatch.llm import embedding_dedup, topk

SCHEMA = "vec_id long, embedding array<double>, label int, slot int, rep long, name string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, 2, "x") for i, v, lab in rows], SCHEMA)


def valid(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def awkward(dim=8):
    r = random.Random(1)
    rows = [(i, [r.choice([-1.5, -0.25, 0.0, 0.5, 1.0]) for _ in range(dim)], i % 3) for i in range(120)]
    rows += [(200, None, 1), (250, [1.0, None] + [0.0] * 6, 1), (300, [math.nan] * dim, 1), (350, [math.inf] * dim, 1), (400, [0.0] * dim, 1),
             (None, [1.0] * dim, 1), (450, [1.0] * dim, None), (500, [1.0] * dim, 2), (550, [2.0] * dim, 2), (600, [1.0] * 3, 2), (650, [], 2)]
    return rows + [(1000 + i, [1.0] * dim, 0) for i in range(60)]


def brute_topk(rows, k, every):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and valid(v)]
    for i, q in good:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in good if j != i and len(c) == len(q))
            yield from ((i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k]))


@pytest.mark.parametrize("shard", [4096, 16])
def test_topk_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 5)
    monkeypatch.setattr(topk, "MERGE", 2)
    got = topk.topk(frame(spark, awkward()), F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(map(tuple, got)) == sorted(brute_topk(awkward(), 5, 50))


def test_topk_cells_of_many_tiles_equal_brute_force(spark, monkeypatch):
    """Several lanes and slots with several blocks and shards each, numbers of every width, ties that go on in the next tile."""
    for name, value in (("SHARD_ROWS", 16), ("BLOCK_ROWS", 3), ("MERGE", 2), ("CELLS", 1), ("LANE_BLOCKS", 4), ("SLOT_SHARDS", 3), ("TILE", (2, 5))):
        monkeypatch.setattr(topk, name, value)
    rows = awkward() + [(2000, [127.99, -128.0] * 4, 0), (2050, [128.0, 3.0] * 4, 0), (2100, [9e6, 1.0] * 4, 0)]
    found = topk.topk(frame(spark, rows), F.col("vec_id") % 10 == 0, 5)
    assert sorted(map(tuple, found.collect())) == sorted(brute_topk(rows, 5, 10))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan                                              # no row for each pair of a block and a shard


def test_topk_blocks_are_full_and_narrow(spark):
    rows = spark.range(25).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(0.5)).alias("embedding")).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        packed = rows.mapInArrow(topk._pack(10), topk._PACKED).select("kind", F.length("ids").alias("ids"), F.length("matrix").alias("bytes")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, packed)) == [("<i2", 40, 20), ("<i2", 80, 40), ("<i2", 80, 40)]


def test_topk_beyond_doubles_is_exact(spark):
    rows = [(i, [3e13 + i, 1.0], 0) for i in range(4)]
    got = topk.topk(frame(spark, rows), F.col("vec_id") == 0, 2).collect()
    q = [math.floor(256 * x) for x in rows[0][1]]
    wrapped = {j: (sum(a * math.floor(256 * x) for a, x in zip(q, v, strict=True)) + 2**63) % 2**64 - 2**63 for j, v, _ in rows[1:]}
    best = sorted(wrapped, key=lambda j: (-wrapped[j], j))[:2]
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(j, wrapped[j]) for j in best]


def brute_links(rows, threshold):
    unit = {}
    for i, v, lab in rows:
        if i is not None and lab is not None and valid(v) and any(v):
            x = np.array(v)
            unit[i] = (lab, len(v), x / np.linalg.norm(x))
    ids = sorted(unit)
    return [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:]
            if unit[a][:2] == unit[b][:2] and unit[a][2] @ unit[b][2] >= threshold - 1e-12]


def near_copies(seed, groups, size, dim=32):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        center = r.normal(size=dim)
        for _ in range(size if g else 10 * size):
            rows.append((len(rows) * 7 % 100_003, (center + r.normal(size=dim) * r.choice([0.0, 0.1, 0.4])).tolist(), int(g % 2)))
    return rows


@pytest.mark.parametrize("tile,rows", [(1024, awkward()), (1024, near_copies(1, 30, 8)), (16, near_copies(2, 12, 9)), (1024, [])])
def test_embedding_dedup_finds_nine_in_ten_links_and_no_other(spark, monkeypatch, tile, rows):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    monkeypatch.setattr(embedding_dedup, "BUCKET_ROWS", 40)
    got = embedding_dedup.embedding_dedup(frame(spark, rows)).collect()
    assert sorted(str(r["vec_id"]) for r in got) == sorted(str(i) for i, *_ in rows)
    links = brute_links(rows, 0.93)
    count = dict.fromkeys((i for i, *_ in rows), 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    found = {r["vec_id"]: r["n_links"] for r in got}
    assert all(found[i] <= count[i] for i in found)
    assert sum(found.values()) >= 0.9 * sum(count.values())
    roots = brute_components([i for i in count if i is not None], links)
    same = [r["component_id"] == roots.get(r["vec_id"]) for r in got]
    assert sum(same) >= 0.9 * len(same)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_index_recall_on_the_test_table(spark):
    from loanwatch.llm.queries import QUERIES
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = {r["vec_id"]: r["n_links"] for r in QUERIES["op5_embedding_dedup"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows) and sum(got.values()) >= 0.9 * 2 * len(brute_links(rows, 0.93))
    hits = sorted(map(tuple, QUERIES["op8_exact_topk"](spark, "/root/testdata/sf0.01").collect()))
    assert hits == sorted(brute_topk(rows, 5, 50))


@pytest.mark.parametrize("copies", ["near", "exact"])
def test_embedding_dedup_finds_the_links_of_a_group_with_a_third_of_all_rows(spark, copies):
    r = np.random.default_rng(3)
    center, noise = r.normal(size=64), 0.2 if copies == "near" else 0.0
    group = center + noise * r.normal(size=(1100, 64))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([group, r.normal(size=(2200, 64))]))]
    got = embedding_dedup.embedding_dedup(frame(spark, rows)).collect()
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    count = (unit @ unit.T >= 0.93 - 1e-12).sum(axis=1) - 1
    assert all(x["n_links"] <= count[x["vec_id"]] for x in got)
    assert sum(x["n_links"] for x in got) >= 0.99 * count.sum() > 0
    assert {x["component_id"] for x in got if count[x["vec_id"]] and x["vec_id"] < 1100} == {0}
