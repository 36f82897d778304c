"""Language ID and toxicity: model arithmetic, defined results, held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import awkward, documents
from pyspark.sql import functions as F

from loanwatch.llm import language_id, toxicity
from loanwatch.llm.common import held_out

SF = "/root/testdata/sf0.01"


def speech(letters, n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(60)]
    return [" ".join(r.choice(words) for _ in range(30)) for _ in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, lang) for lang, letters in (("aa", "abcde"), ("bb", "defgh")) for i, t in enumerate(speech(letters, 40, lang))]
    rows += [(99, "zzz", None), (98, None, "aa")]
    return language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_n_grams_are_those_of_the_words():
    row, key, letters = language_id._grams(pa.array(["Ab, c", "", "é"]))
    def grams(word):
        padded = [0, 0, 0, *map(ord, word), 0]
        return [sum(ch << (16 * (3 - k)) for k, ch in enumerate(padded[i:i + 4])) for i in range(len(word) + 1)]
    assert language_id._grams(pa.array(["\u0301 \u0301", "漢"]))[2].tolist() == [0, 1]       # marks alone are no letters
    assert key.tolist() == grams("ab") + grams("c") + grams("é") and row.tolist() == [0] * 5 + [2] * 2 and letters.tolist() == [3, 0, 1]


def test_probabilities_of_all_characters_after_a_context_add_up_to_one(model):
    chars = model.chars
    for context in ("", "a", "ab", "cab", "zz"):
        above = 0
        for ch in context:
            above = above << 16 | ord(ch)
        keys = np.array([(above << 16 | int(c)) & (2**64 - 1) for c in chars], np.uint64)
        total = np.array([np.exp(model.log_prob(i, keys)).sum() for i in range(len(model.langs))])
        assert np.all(total > 0.8) and np.all(total <= 1.0001), (context, total)


def test_kneser_ney_of_a_hand_worked_text(spark):
    """Order four over one word 'ab': every n-gram once, so the discount is one half at each order."""
    _, key, _ = language_id._grams(pa.array(["ab"]))
    m = language_id.train(spark.createDataFrame([("ab", "x")], "text string, lang string"))
    # Order 1: a, b and the end each follow one context: (1 - .5) / 3 + .5 * 3 / 3 * 1 / 4.
    low = 0.5 / 3 + 0.5 / 4
    assert np.allclose(np.exp(m.logs[0][0]), low)
    one = 0.5 + 0.5 * low                       # orders 2 to 4: one continuation of each context
    two = 0.5 + 0.5 * one
    assert np.allclose(np.exp(m.logs[0][3][np.searchsorted(m.grams[0][3], key)]), 0.5 + 0.5 * two)


def test_language_results_are_defined_for_awkward_rows(spark, model):
    got = {(r["doc_id"], r["source"]): r for r in language_id.identify(documents(spark, awkward()), model, ("source", "row")).collect()}
    rows = language_id.identify(documents(spark, awkward()), model).collect()
    assert len(rows) == len(awkward()) and got
    for r in rows:
        assert r["lang_pred"] in ("aa", "bb", "und") and 0 <= r["score"] <= 1
    und = [r for r in rows if r["doc_id"] in (5, 6, 7)]
    assert [(r["lang_pred"], r["score"], r["entropy"], r["rejected"]) for r in und] == [("und", 0.0, None, True)] * 3
    assert language_id.identify(documents(spark, []), model).count() == 0
    assert language_id.train(documents(spark, [])) is None
    none = language_id.identify(documents(spark, awkward()), None).collect()
    assert {(r["lang_pred"], r["rejected"]) for r in none} == {("und", True)}


def test_foreign_text_is_rejected_and_known_text_is_not(spark, model):
    rows = [(i, t) for i, t in enumerate(speech("abcde", 10, "aa") + speech("defgh", 10, "bb"))] + [(50, " ".join(speech("qrstuvxyz", 1, 1)))]
    got = {r["doc_id"]: r for r in language_id.identify(documents(spark, rows), model).collect()}
    assert [got[i]["lang_pred"] for i in range(20)] == ["aa"] * 10 + ["bb"] * 10
    assert [i for i in got if got[i]["rejected"]] == [50]


def test_layout_does_not_change_the_model(spark, model):
    rows = [(i, t, lang) for lang, letters in (("aa", "abcde"), ("bb", "defgh")) for i, t in enumerate(speech(letters, 40, lang))]
    again = language_id.train(spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string").repartition(7))
    assert all((a == b).all() for x, y in zip(model.logs + model.grams, again.logs + again.grams, strict=True) for a, b in zip(x, y, strict=True))


def kneser_ney(texts):
    """Log-probability of a padded 4-gram after ``texts``, by dictionaries of tuples."""
    grams = {3: Counter()}
    for t in texts:
        for word in re.findall(r"[a-z]+", t.lower()):
            padded = "000" + word + "0"
            grams[3].update(padded[i:i + 4] for i in range(len(word) + 1))
    for k in (2, 1, 0):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    cut = {}
    for k, g in grams.items():
        once, twice = (sum(n == m for n in g.values()) for m in (1, 2))
        cut[k] = once / (once + 2 * twice) if once and twice else 0.5

    def prob(gram, chars):
        k = len(gram) - 1
        if k < 0:
            return 1 / (chars + 1)
        after = {g: n for g, n in grams[k].items() if g[:-1] == gram[:-1]}
        if not after:
            return prob(gram[1:], chars)
        total = sum(after.values())
        return max(after.get(gram, 0) - cut[k], 0) / total + cut[k] * len(after) / total * prob(gram[1:], chars)
    return prob, set(grams[0])


def test_predictions_equal_brute_force_kneser_ney(spark):
    train = {"aa": speech("abcde", 5, 3), "bb": speech("defgh", 3, 4), "cc": ["hij ij j"]}
    train["aa"].append(train["aa"][0])
    model = language_id.train(spark.createDataFrame([(t, x) for x, ts in train.items() for t in ts], "text string, lang string"))
    models = {x: kneser_ney(ts) for x, ts in train.items()}
    chars = set().union(*(c for _, c in models.values()))
    docs = [(i, t) for i, t in enumerate(speech("abcdefghij", 12, 9) + speech("abcde", 2, 3) + ["hij, de!", "a", "qq jq"])]
    got = {r["doc_id"]: r for r in language_id.identify(documents(spark, docs), model).collect()}
    for i, t in docs:
        padded = ["000" + word + "0" for word in re.findall(r"[a-z]+", t)]
        grams = [p[j:j + 4] for p in padded for j in range(len(p) - 3)]

        def log(x, g, memo={}):
            if (x, g) not in memo:
                prob = models[x][0](g, len(chars))
                if g[-1] not in chars:          # a character of no language: what contexts hand down, times one in 65,536
                    prob = prob * (len(chars) + 1) / ((1 << 16) * prob_of_none(x))
                memo[x, g] = math.log(prob)
            return memo[x, g]

        def prob_of_none(x):                    # the weight that order one hands to the uniform distribution
            return models[x][0]("?", len(chars)) * (len(chars) + 1)
        mean = {x: sum(log(x, g) for g in grams) / len(grams) for x in train}
        best = max(mean, key=lambda x: (mean[x], [-ord(c) for c in x]))
        assert got[i]["lang_pred"] == best and abs(got[i]["entropy"] + mean[best]) < 1e-9, (i, mean, got[i])


def test_held_out_is_one_fifth_by_crc(spark):
    got = {r["id"]: r["h"] for r in spark.range(300).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(300)}


def test_language_query_on_held_out_rows(spark):
    from loanwatch.llm.queries import QUERIES
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op9_language_id"](spark, SF).collect()
    own = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and own
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in own]) > 0.97


def auc(y, s):
    y, s = np.array(y, bool), np.array(s)
    return np.mean([(a > s[~y]).mean() + (a == s[~y]).mean() / 2 for a in s[y]])


def test_toxicity_query_on_held_out_rows(spark):
    from loanwatch.llm.queries import QUERIES
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1").collect()
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows) and len(rows) == 10_000
    own = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert auc([labels[r["doc_id"]] for r in own], [r["score"] for r in own]) > 0.95
    clean = [r["predicted"] for r in own if not labels[r["doc_id"]]]
    assert np.mean(clean) < 0.01


def test_toxicity_buckets_are_sets_of_word_grams():
    row, bucket = toxicity._text_grams(pa.array(["ab ab", "", "ab", "cd"]))
    sets = [set(bucket[row == i]) for i in range(4)]
    assert sets[0] == sets[2] and not sets[1] and len(bucket[row == 0]) == len(sets[0]) and not sets[2] & sets[3]


def test_toxicity_results_are_defined_for_awkward_rows(spark):
    rows = [(i, "you idiot " + t if i % 2 else t, i % 2) for i, t in enumerate(speech("abcde", 60, 1))] + [(90, None, 0), (91, "x", None), (92, "y", 7)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(labelled)
    got = toxicity.score(documents(spark, awkward() + [(77, "what an idiot")]), model).collect()
    assert len(got) == len(awkward()) + 1 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["predicted"] for r in got if r["doc_id"] in (5, 6, 7)} == {0}
    assert [r["predicted"] for r in got if r["doc_id"] == 77] == [1]
    assert toxicity.train(labelled.where("toxic = 0")) is None
    assert {r["score"] for r in toxicity.score(documents(spark, awkward()), None).collect()} == {0.0}
    assert toxicity.score(documents(spark, []), model).count() == 0


def test_sparse_fit_equals_plain_gradient_steps():
    r = np.random.default_rng(3)
    bits = r.random((200, 12)) < r.random(12)
    bits[:5] = False                            # rows without a feature
    y = (r.random(200) < 1 / (1 + np.exp(-(bits @ r.normal(size=12) - 1)))).astype(float)
    scale = r.normal(size=12)
    row, col = np.nonzero(bits)
    weight, bias = toxicity._fit(np.bincount(row, minlength=200), col, y, scale)
    x, w, b = bits * scale, np.zeros(12), 0.0
    for _ in range(40_000):
        miss = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.01 * (x.T @ miss + toxicity.RIDGE * w), b - 0.01 * miss.sum()
    assert np.allclose(weight, w * scale, atol=2e-2) and abs(bias - b) < 2e-2


def test_toxicity_scores_equal_brute_force(spark):
    """Buckets, log-count ratios and significance by sets and dictionaries; the fitted weights are taken from the model."""
    rows = [(i, ("you idiot " if i % 3 == 0 else "") + t, int(i % 3 == 0)) for i, t in enumerate(speech("abcdefgh", 80, 5))]
    rows += [rows[0], (None, None, 0), (91, "x", None)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    sets = [(set(toxicity._text_grams(pa.array([t or ""]))[1].tolist()), y) for _, t, y in rows if y is not None]
    n = [sum(y == k for _, y in sets) for k in (0, 1)]
    kept = set()
    for b in set().union(*(s for s, _ in sets)):
        c = [sum(b in s for s, y in sets if y == k) for k in (0, 1)]
        p, q = (c[1] + 1) / (n[1] + 2), (c[0] + 1) / (n[0] + 2)
        share = sum(c) / sum(n)
        if abs(p - q) >= toxicity.SIGNIFICANT * np.sqrt(max(share * (1 - share), 1e-12) * (1 / n[0] + 1 / n[1])):
            kept.add(b)
    assert set(np.flatnonzero(model.feature >= 0).tolist()) == kept
    docs = [(i, t) for i, t, _ in rows]
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["score"]) for r in toxicity.score(documents(spark, docs), model).collect())
    want = []
    for i, t in docs:
        z = model.bias + sum(model.weight[model.feature[b]] for b in set(toxicity._text_grams(pa.array([t or ""]))[1].tolist()) & kept)
        want.append((i is not None, i or 0, 1 / (1 + np.exp(-z))))
    assert np.allclose([g[2] for g in got], [w[2] for w in sorted(want)])


def test_toxicity_sample_bounds_leave_a_model(spark):
    rows = [(i, ("you idiot " if i % 2 else "") + t, i % 2) for i, t in enumerate(speech("abcde", 200, 6))]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(labelled, sample_rows=100, sample_entries=3000)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(documents(spark, [(1, "an idiot"), (2, "bad cab")]), model).collect()}
    assert got == {1: 1, 2: 0}
