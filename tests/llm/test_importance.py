"""Importance resampling against brute force and against labelled held-out rows."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from llm_cases import awkward, documents, prose
from pyspark.sql import functions as F

from loanwatch.llm import importance


def bag(text):
    """N-grams by name, for texts of ASCII characters."""
    w = re.findall(r"[a-z0-9]+|[^a-z0-9\s]+", (text or "").lower())
    return Counter([(x,) for x in w] + list(zip(w, w[1:], strict=False)))


def bucket_of(gram):
    """The bucket of a gram, by a text that holds nothing else."""
    found = importance._ngrams(pa.array([" ".join(gram)]))[1]
    return int(found[-1])


def test_ngrams_are_tokens_and_pairs_of_one_text():
    texts = ["One two, ONE two", "", "two", "***a b"]
    row, bucket = importance._ngrams(pa.array(texts))
    for i, t in enumerate(texts):
        want = Counter()
        for gram, n in bag(t).items():
            want[bucket_of(gram)] += n
        assert Counter(bucket[row == i].tolist()) == want


def test_weights_and_draw_equal_brute_force(spark):
    rows = [(i, prose(i % 7, 5 + i)) for i in range(60)] + [(7, prose(0, 12)), (7, prose(0, 12)), (90, None), (91, ""), (None, "x y")]
    target = rows[:20]
    got = importance.resample(documents(spark, rows), documents(spark, target), 0.4).collect()
    sides = []
    for side in (target, rows):
        n = np.zeros(importance.BUCKETS)
        for _, t in side:
            for gram, c in bag(t).items():
                n[bucket_of(gram)] += c
        sides.append(np.log((n + 1) / (n.sum() + importance.BUCKETS)))
    weight = {(i, t): sum(c * (sides[0] - sides[1])[bucket_of(g)] for g, c in bag(t).items()) for i, t in rows}

    def noise(i):
        u = spark.range(1).select(F.xxhash64(F.lit(importance.SEED), F.lit(i).cast("long"))).first()[0]
        return -math.log(-math.log((((u % 2**64) >> 11) + 0.5) / 2**53))
    key = {(i, t): w + noise(i) for (i, t), w in weight.items() if i is not None}
    best = set(sorted(key, key=lambda x: -key[x])[:round(0.4 * len(key))])
    want = sorted((str(i), round(weight[i, t], 6), round(key[i, t], 6) if i is not None else None, (i, t) in best) for i, t in rows)
    assert sorted((str(r["doc_id"]), round(r["log_weight"], 6), r["key"] and round(r["key"], 6), r["selected"]) for r in got) == want


def test_awkward_and_empty_tables(spark):
    got = importance.resample(documents(spark, awkward()), documents(spark, []), 0.5).collect()
    assert len(got) == len(awkward()) and {r["log_weight"] for r in got} == {0.0}
    assert not any(r["selected"] for r in got if r["doc_id"] is None)
    assert importance.resample(documents(spark, []), documents(spark, awkward()), 0.5).count() == 0


def test_registered_query_covers_all_documents_and_tells_quality(spark):
    from loanwatch.llm.queries import QUERIES
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op2_importance_resampling"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    own = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    kept = {q: np.mean([r["selected"] for r in own if labels[r["doc_id"]] == q]) for q in (0, 1)}
    assert kept[1] > 0.95 and kept[0] < 0.1
