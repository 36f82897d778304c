"""Substring, SimHash and line dedup against brute force."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import pytest
import xxhash
from llm_cases import SCHEMA, awkward, documents, prose
from pyspark.sql import functions as F

from loanwatch import session
from loanwatch.llm import line_dedup, simhash_dedup, substring_dedup
from loanwatch.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_windows(rows, size):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - size + 1):
            if i is not None:
                first[tuple(w[j:j + size])] = min(i, first.get(tuple(w[j:j + size]), i))
    for i, t in rows:
        w = WORD.findall(t or "")
        out = [False] * len(w)
        for j in range(len(w) - size + 1):
            if i is not None and first[tuple(w[j:j + size])] < i:
                out[j:j + size] = [True] * size
        yield i, len(w), sum(out), " ".join(x for x, o in zip(w, out, strict=True) if not o)


def mosaic(seed, n):
    """Texts made of shared passages, with windows that overlap and touch."""
    r = random.Random(seed)
    passages = [prose(100 + i, r.randint(10, 90)) for i in range(12)]
    return [(r.randint(0, 10**9), " ".join(r.choice(passages) for _ in range(r.randint(1, 6)))) for _ in range(n)]


@pytest.mark.parametrize("rows,size", [(awkward(), 50), (mosaic(1, 60), 50), (mosaic(2, 40), 7), ([(i, "same words again " * 40) for i in range(20)], 50)])
def test_substring_dedup_equals_brute_force(spark, rows, size):
    got = sorted(map(str, (tuple(r)[:3] + (r["kept_text"],) for r in substring_dedup.substring_dedup(documents(spark, rows), size)
                           .select("doc_id", "n_words", "n_removed", "kept_text").collect())))
    assert got == sorted(map(str, brute_windows(rows, size)))


def test_substring_spans_and_kept_columns(spark):
    shared = prose(1, 60)
    rows = [(1, shared), (2, f"a b {shared} c"), (3, "d")]
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(documents(spark, rows), keep=("source", "kept_text", "row"))
           .drop("kept_text").collect()}
    assert [tuple(s) for s in got[2]["spans"]] == [(2, 62)] and got[1]["spans"] == [] and got[3]["row"] == 1


def test_substring_hot_anchor_is_spread(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SPREAD", 4)
    monkeypatch.setattr(substring_dedup, "SETTLE", 500)
    rows = [(i, f"{prose(1, 55)} {prose(i, 10)}") for i in range(60)]
    got = sorted(map(str, (tuple(r) for r in substring_dedup.substring_dedup(documents(spark, rows)).drop("spans").collect())))
    assert got == sorted(map(str, brute_windows(rows, 50)))


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    shingles = [" ".join(w[j:j + 3]) for j in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_equal_brute_force(spark):
    got = sorted(map(str, ((r["doc_id"], r["fingerprint"]) for r in simhash_dedup.simhash_dedup(documents(spark, awkward())).collect())))
    assert got == sorted(map(str, ((i, f"{brute_fingerprint(t):016x}") for i, t in awkward())))


@pytest.mark.parametrize("small", [64, 2])
def test_simhash_links_equal_brute_force(spark, monkeypatch, small):
    """Random fingerprints with flipped bits; with SMALL = 2 nearly all blocks take the way of hot ones."""
    monkeypatch.setattr(simhash_dedup, "SMALL", small)
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(15)]
    prints = {i: r.choice(base) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for i in range(160)}
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()]
    monkeypatch.setattr(simhash_dedup, "fingerprints", lambda docs: spark.createDataFrame(signed, "doc_id long, fp long"))
    got = {x["doc_id"]: (x["fingerprint"], x["component_id"], x["kept"]) for x in simhash_dedup.simhash_dedup(None).collect()}
    roots = brute_components(prints, [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert got == {i: (f"{p:016x}", roots[i], roots[i] == i) for i, p in prints.items()}


def test_simhash_empty_texts_link_and_null_ids_do_not(spark):
    got = simhash_dedup.simhash_dedup(documents(spark, [(4, ""), (2, None), (None, ""), (3, " ")])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(2, 2), (3, 2), (4, 2)]
    assert [(r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is None] == [("0" * 16, None)]


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (200, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingle_set(line):
    return frozenset(line[i:i + 8] for i in range(max(1, len(line) - 7)))


def brute_lines(rows):
    order = sorted({((i is not None, i or 0), t or "") for i, t in rows})
    first = {}
    for i, t in order:
        for p, line in enumerate(t.split("\n")):
            if re.search(r"\S", line):
                first.setdefault(line, (i, t, p))
    sets = {line: shingle_set(line) for line in first}
    number = {line: k for k, line in enumerate(first)}
    links = [(number[a], number[b]) for a, b in itertools.combinations(first, 2)
             if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    roots = brute_components(number.values(), links)
    kept = {first[line] for line, k in number.items() if roots[k] == k}
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [p for p, line in enumerate(lines) if re.search(r"\S", line) and ((i is not None, i or 0), t or "", p) not in kept]
        yield i, len(lines), gone, "\n".join(x for p, x in enumerate(lines) if p not in gone)


def edited(seed, n_lines, copies, words=30):
    r = random.Random(seed)
    lines = [prose(1000 + seed * 100 + k, words).split() for k in range(n_lines)]
    out = []
    for i in range(copies):
        made = []
        for line in lines:
            line = list(line)
            if r.random() < 0.5:
                line[r.randrange(len(line))] = f"edit{i}"
            made.append(" ".join(line))
        out.append((i, "\n".join([*made, "", prose(9000 + seed * 1000 + i, 12)])))
    return out


@pytest.mark.parametrize("small,rows", [(64, awkward()), (64, edited(1, 4, 12)), (2, edited(2, 3, 20)), (64, [])])
def test_line_dedup_equals_brute_force(spark, monkeypatch, small, rows):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    monkeypatch.setattr(line_dedup, "CENTERS", 2 if small == 2 else 16)
    frame = documents(spark, rows)
    got = line_dedup.line_dedup(frame)
    assert got.columns == [f.name for f in SCHEMA] + ["line_dedup"]
    got = [(r["doc_id"], r["line_dedup"]["n_lines"], r["line_dedup"]["removed"], r["line_dedup"]["kept_text"]) for r in got.collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_lines(rows)))


def test_line_dedup_plan_has_no_python(spark):
    """The plans of all steps: the result's own, and those of the tables it writes on the way."""
    plans, write = [], line_dedup.pin

    def pin(df):
        plans.append(df._jdf.queryExecution().toString())
        return write(df)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(line_dedup, "pin", pin)
        patch.setattr(line_dedup, "SMALL", 2)
        plans.append(line_dedup.line_dedup(documents(spark, edited(2, 3, 8)))._jdf.queryExecution().toString())
    assert len(plans) >= 6
    assert not any(re.search("Python|Pandas|Arrow|MapPartitions", p) for p in plans)


def test_hashed_shingles_are_the_shingles(spark):
    lines = [(x,) for x in ("", "short", "exactly8", "nine char", "fifteen letters", "sixteen letters!", "\U0001F600 smile \U0001F600\U0001F601 end", "漢字かな交じり文。と" * 5)]
    frame = spark.createDataFrame(lines, "line string")
    plain = F.array_sort(F.array_distinct(F.transform(line_dedup.shingles(F.col("line")), lambda s: F.xxhash64(s))))
    fast = F.array_sort(F.array_distinct(line_dedup.hashed_shingles(F.col("line"))))
    assert frame.where(plain != fast).count() == 0


@pytest.mark.parametrize("n,common", [(5, 4), (10, 8), (9, 8)])
def test_short_lines_at_the_threshold_share_a_band(spark, n, common):
    """Pairs of 4 to 10 shingles: a line, and the same line without its last characters or with another end."""
    r = random.Random(n)
    pairs, other = [], {5: 4, 10: 8, 9: 9}[n]
    for k in range(1500):
        line = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n + 7))
        pairs.append((k, line, line[:other + 7] if other < n else line[:-1] + "#"))
    a, b = set(shingle_set(pairs[0][1])), set(shingle_set(pairs[0][2]))
    assert len(a & b) == common and len(a & b) >= 0.8 * len(a | b)
    frame = spark.createDataFrame(pairs, "k int, a string, b string")
    keys = [line_dedup.band_keys(frame.select(F.col("k").cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.col(c).alias("line")))
            .select("h1", F.col("keys").alias(c)) for c in "ab"]
    found = keys[0].join(keys[1], "h1").where(F.arrays_overlap("a", "b")).count()
    assert found >= 0.995 * len(pairs)


def test_dedup_of_empty_tables(spark):
    none = documents(spark, [])
    assert substring_dedup.substring_dedup(none).count() == 0
    assert simhash_dedup.simhash_dedup(none).count() == 0


def test_registered_queries_agree_with_their_operators(spark):
    from loanwatch.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {tuple(r) for r in QUERIES["op3_substring_dedup"](spark, sf).collect()}
    assert got == {(i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in brute_windows(docs, 50)}
    got = {r["doc_id"]: (r["n_lines"], r["removed"]) for r in QUERIES["op7_line_dedup"](spark, sf).collect()}
    assert got == {i: (n, gone) for i, n, gone, _ in brute_lines(docs)}
    prints = {i: brute_fingerprint(t) for i, t in docs}
    roots = brute_components(prints, [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    got = {tuple(r) for r in QUERIES["op4_simhash_dedup"](spark, sf).select("doc_id", "fingerprint", "component_id").collect()}
    assert got == {(i, f"{p:016x}", roots[i]) for i, p in prints.items()}


def test_lines_that_differ_inside_long_words_stay(spark):
    lines = [f"https://example.org/{prose(k, 6).replace(' ', '/')}" for k in range(6)] + ["Andththwhwh.", "Andththwhes.", "a\u00a0" * 9 + "b", "a\u00a0" * 9 + "c" * 9]
    full = [frozenset(x[i:i + 8] for i in range(max(1, len(x) - 7))) for x in lines]
    assert all(len(a & b) < 0.8 * len(a | b) for a, b in itertools.combinations(full, 2))
    copy = prose(40, 40)
    got = line_dedup.line_dedup(documents(spark, [(1, "\n".join(lines)), (2, copy), (3, copy + "s")])).collect()
    assert {r["doc_id"]: r["line_dedup"]["removed"] for r in got} == {1: [], 2: [], 3: [0]}


def test_shingles_start_at_every_character(spark):
    for line in ("short", "exactly8", "nine char", "\U0001F600 smile \U0001F600\U0001F601 end", "漢字かな交じり文。と"):
        got = spark.createDataFrame([(line,)], "line string").select(line_dedup.shingles(F.col("line"))).first()[0]
        assert got == [line[i:i + 8] for i in range(max(1, len(line) - 7))]


def test_line_dedup_leaves_only_what_its_result_reads(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SMALL", 2)
    before = len(session._PINS)
    rows = edited(3, 3, 20)
    frame = line_dedup.line_dedup(documents(spark, rows))
    left = session._PINS[before:]
    assert len(left) == 2 and all(spark.read.parquet(p).columns in (["node", "component"], ["id", "first"]) for p in left)
    assert sorted(r["doc_id"] for r in frame.collect()) == sorted(i for i, _ in rows)


def test_a_line_takes_each_center_of_its_bands_once(spark, monkeypatch):
    """Ten bands with the same 40 lines: a row for each line and center, not for each band too, and no join that makes one."""
    monkeypatch.setattr(line_dedup, "CENTERS", 4)
    rows = [((i, i), key, float(i)) for key in range(10) for i in range(40)]
    hot = spark.createDataFrame(rows, "id struct<h1:long,h2:long>, key long, typical double")
    pairs = [(r["u"]["h1"], r["v"]["h1"]) for r in line_dedup._with_centers(hot).collect()]
    want = {(min(i, c), max(i, c)) for i in range(40) for c in range(36, 40) if i != c}
    assert set(pairs) == want and len(pairs) == 40 * 4 - 4


def test_sketches_rule_out_strangers_and_no_pair_at_the_threshold(spark):
    lines = sorted({line for _, text in edited(4, 3, 12) for line in text.split("\n") if line} | {"short", "漢字かな交じり文。と" * 5, "漢字かな交じり文。と" * 6})
    frame = spark.createDataFrame([(k, 0, line) for k, line in enumerate(lines)], "h1 long, h2 long, line string")
    sketch = line_dedup._sketches(frame)
    pairs = line_dedup._pairs(sketch.withColumn("one", F.lit(1)), sketch.withColumn("one", F.lit(1)), "one", (F.col("a.id") < F.col("b.id")) & line_dedup._able("a", "b", 0.8))
    able = {(r["u"]["h1"], r["v"]["h1"]) for r in pairs.collect()}
    sets = [shingle_set(line) for line in lines]
    index = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(range(len(lines)), 2)}
    assert {p for p, j in index.items() if j >= 0.8} <= able
    assert not any(j < 0.4 for p, j in index.items() if p in able and min(len(sets[p[0]]), len(sets[p[1]])) > 20)


def test_coded_shingles_meet_as_the_shingles_do(spark):
    lines = ["", "short", "exactly8", "nine char", "ab" * 40, prose(50, 30), "\U0001F600 smile \U0001F600\U0001F601 end", "漢字かな交じり文。と" * 5, "﻿nine char", prose(50, 30) + "é"]
    sets = [shingle_set(line) for line in lines]
    frame = spark.createDataFrame(list(enumerate(lines)), "k int, line string").select("k", line_dedup.coded_shingles(F.col("line")).alias("s"))
    a, b = frame.toDF("a", "sa"), frame.toDF("b", "sb")
    got = {(r["a"], r["b"]): r["n"] for r in a.crossJoin(b).select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("n")).collect()}
    assert got == {(i, j): len(x & y) for i, x in enumerate(sets) for j, y in enumerate(sets)}


def test_lines_travel_only_where_the_kept_text_is_read(spark):
    """The join with the kept lines moves line numbers; a text travels only for the kept text, once, and is cut once."""
    found = line_dedup.line_dedup(documents(spark, edited(5, 3, 6)).select("doc_id", "text"))

    def moved(frame):
        node = frame._jdf.queryExecution().optimizedPlan()
        above = node.toString().split("Join LeftOuter")[0]
        while node.nodeName() != "Join":
            node = node.children().apply(0)
        output = node.children().apply(0).output()
        return sorted(output.apply(i).dataType().simpleString() for i in range(output.size())), above.count("split(")
    assert moved(found.select("doc_id", "line_dedup.n_lines", "line_dedup.removed")) == (["array<int>", "bigint", "bigint", "int"], 0)
    assert moved(found) == (["array<int>", "bigint", "bigint", "int", "string"], 1)
