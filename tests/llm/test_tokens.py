"""Byte-level BPE and packing against the tokenizer libraries."""

import base64
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from llm_cases import awkward, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loanwatch.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
OURS = bpe.load_ranks(PATH)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={
    base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))})


def encode(texts):
    packed, _, of_text = OURS.encode(pa.array(texts, pa.string()))
    return [np.frombuffer(b"".join(packed[a:b]), "<u4").tolist() for a, b in zip(of_text[:-1], of_text[1:], strict=True)]


PARTS = ["a", "B", "é", "'", "'s", "'re", "'ll", "'ve", "'T", "t", "d", "l", " ", "  ", "\n", "\t", " ", " ", "\x1c", "1", "٣", "½",
         "!", "#", "漢", "\U0001F600", "́", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), min_size=1, max_size=6))
def test_any_mix_of_classes_encodes_as_tiktoken(texts):
    assert encode(texts) == [THEIRS.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=40), max_size=4))
def test_any_text_round_trips(texts):
    assert [OURS.decode(np.array(x, "<u4").tobytes()).decode() for x in encode(texts)] == texts


def test_long_pieces_and_full_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    r = random.Random(3)
    texts = ["".join(r.choice("abcdeéth漢on") for _ in range(r.randint(1, 900))) for _ in range(60)] + ["a" * 3000]
    assert encode(texts) == [THEIRS.encode_ordinary(t) for t in texts]


def test_encode_documents(spark):
    got = bpe.encode_documents(documents(spark, awkward()), OURS).collect()
    by = defaultdict(list)
    for i, t in awkward():
        by[i].append(t or "")
    assert len(got) == len(awkward())
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["decoded"].decode() in by[r["doc_id"]] and ids == THEIRS.encode_ordinary(r["decoded"].decode()) and r["n_tokens"] == len(ids)
        sizes = np.cumsum([len(THEIRS.decode_single_token_bytes(x)) for x in ids]).tolist()
        assert np.frombuffer(r["ends"], "<i4").tolist() == sizes
    assert bpe.encode_documents(documents(spark, []), OURS).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_best_fit_fills_gapless_bins(sizes):
    bins, offsets = packing.best_fit(np.array(sizes, np.int64), 40)
    ends = defaultdict(int)
    for b, o, n in sorted(zip(bins.tolist(), offsets.tolist(), sizes, strict=True)):
        assert o == ends[b]
        ends[b] += n
    assert all(e <= 40 for e in ends.values())
    assert len(ends) <= -(-11 * -(-sum(sizes) // 40) // 9) + 4 + sum(n > 20 for n in sizes)


def check_packing(rows, docs, capacity=2048):
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    hf.encode_special_tokens = True
    wanted = sorted([i is not None, i or 0, [*hf.encode(t or "", add_special_tokens=False).ids, 0]] for i, t in docs)
    runs, seqs = [], defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["length"] == len(ids) <= capacity and r["ids_crc32"] == zlib.crc32(r["ids"])
        runs.append((r["doc_id"] is not None, r["doc_id"] or 0, r["piece"], r["start"], ids))
        seqs[r["sequence_id"]].append((r["offset"], len(ids)))
    whole = []
    for w in wanted:                            # each document's pieces are found among those of its id
        n, ids, k, at = w[2], [], 0, 0
        cuts = [len(n)] if len(n) <= capacity else [x for x in [len(n) % capacity] if x] + [capacity] * (len(n) // capacity)
        for k, size in enumerate(cuts):
            piece = (w[0], w[1], k, at, n[at:at + size])
            runs.remove(piece)
            at += size
        whole.append(ids)
    assert not runs
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs), -(-sum(len(w[2]) for w in wanted) // capacity)


@pytest.mark.parametrize("parts", [1, 20])
def test_packing_of_awkward_documents_over_many_partitions(spark, parts):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = awkward() + [(100 + i, prose(i, 10 + 13 * (i % 37))) for i in range(150)]
    rows = packing.pack(documents(spark, docs).repartition(parts), ranks).collect()
    n, least = check_packing(rows, docs)
    assert n <= least + 1


def test_packing_of_nothing(spark):
    assert packing.pack(documents(spark, []), OURS).count() == 0


def test_items_that_cannot_share_stay_apart(spark):
    lengths = spark.range(300).selectExpr("id as item", "1100L as length").repartition(9)
    assert packing.assign(lengths).select("sequence_id").distinct().count() == 300


def test_partitions_of_unlike_lengths_fill_as_well_as_mixed_ones(spark):
    apart = spark.range(2000).selectExpr("id as item", "if(id < 1000, 1100L, 900L) as length").repartitionByRange(2, "item")
    assert packing.assign(apart).select("sequence_id").distinct().count() <= 1010


@pytest.mark.parametrize("items", [10, 60])
def test_many_small_first_tasks_lose_little(spark, monkeypatch, items):
    """Against best fit of all items in one task."""
    monkeypatch.setattr(packing, "ITEMS", items)
    r = random.Random(items)
    for sizes in ([r.randint(1, 2048) for _ in range(300)], [1100] * 150 + [30] * 150):
        got = packing.assign(spark.createDataFrame(list(enumerate(sizes)), "item long, length long")).collect()
        ends = defaultdict(int)
        for q in sorted(got, key=lambda q: (q["sequence_id"], q["offset"])):
            assert q["offset"] == ends[q["sequence_id"]]
            ends[q["sequence_id"]] += sizes[q["item"]]
        assert len(got) == 300 and max(ends.values()) <= 2048
        assert len(ends) <= 1.1 * (packing.best_fit(np.array(sizes), 2048)[0].max() + 1)


def test_a_group_hands_on_every_bin_that_matters():
    """Groups of one half-empty bin and fuller ones at most: handing on as many bins as groups, and one, joins as many as handing on all."""
    r = random.Random(1)
    for _ in range(300):
        groups = [sorted(r.sample(range(1025, 2040), r.randint(0, 12)) + r.sample(range(1, 1025), r.randint(0, 1))) for _ in range(r.randint(1, 8))]
        used = [packing.best_fit(np.array([n for g in groups for n in g[:most]], np.int64), 2048)[0].max(initial=-1) + 1
                + sum(len(g[most:]) for g in groups) for most in (len(groups) + 1, 99)]
        assert used[0] <= used[1]


def test_registered_queries(spark):
    import hashlib

    from loanwatch.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {tuple(r) for r in QUERIES["op6_byte_bpe"](spark, sf).collect()}
    ids = {i: THEIRS.encode_ordinary(t) for i, t in docs}
    assert got == {(i, len(ids[i]), hashlib.sha256(np.array(ids[i], "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
                   for i, t in docs}
    rows = QUERIES["op1_best_fit_packing"](spark, sf).collect()
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_equal_pre_tokens_of_a_step_are_looked_up_once(monkeypatch):
    asked = []
    own = bpe.Bpe(OURS.ranks)
    monkeypatch.setattr(own, "cache", type("Cache", (dict,), {"get": lambda self, x: asked.append(x)})())
    texts = ["one two one two", "", "one two three one two", "naïve one"]
    ids, offsets = own.ids(pa.array(texts), 0)
    assert len(asked) == len(set(asked)) and b" two" in asked
    packed, _, of_text = OURS.encode(pa.array(texts))
    for k in range(len(texts)):
        want = np.frombuffer(b"".join(packed[of_text[k]:of_text[k + 1]]), "<u4").tolist()
        assert ids[offsets[k]:offsets[k + 1]].tolist() == [*want, 0]
