"""SimHash near-duplicates by pigeonhole blocks.

Method: 64-bit fingerprints over 3-word shingles; documents link at two or
fewer differing bits. Equal fingerprints are one class from the start. Distinct
fingerprints are split into four 16-bit blocks: of a close pair, two blocks or
more are equal, so pairs are joined on two blocks (32 bits, which keeps chance
meetings rare at any size) and then checked by their Hamming distance.

A block pair that more than ``SMALL`` fingerprints share (a large group of near
copies) is not paired out: each member writes its 33 forms with at most one of
the other 32 bits flipped. Members with a common form differ in two bits at
most, and any two that differ in one or two have one, so hanging each member on
the smallest of every common form links just the same, with rows in proportion
to the members. Components come from the edges by star contraction.

Defined results: a text that is null or without words has fingerprint zero and
links like any other; a null ``doc_id`` keeps its fingerprint, links with
nothing and has no component; rows that repeat a ``doc_id`` are judged each by
its own text; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .common import chunks, components

SHINGLE, SEED = 3, 42
BLOCK_PAIRS = tuple(combinations(range(4), 2))
#: Fingerprints on one block pair up to which they are joined pair by pair.
SMALL = 64


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hashes(text: bytes) -> list[int]:
    words = text.lower().split()
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return [h(line, SEED)] if words else []
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.append(0, ends[:-SHINGLE]).tolist()
    return [h(line[s:e], SEED) for s, e in zip(starts, (ends[SHINGLE - 1:] - 1).tolist(), strict=True)]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        found = [_hashes(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        n = np.array([len(x) for x in found])
        flat = np.array([h for x in found for h in x], np.uint64)
        prints = np.zeros(len(n), np.uint64)
        if len(flat):
            some = n > 0
            bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
            prints[some] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(prints.view(np.int64))], [*rest, "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id, fp``: the fingerprint of each whole text as a signed 64-bit number."""
    return (documents.select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(_fingerprints, "doc_id long, fp long"))


def _links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) between the smallest documents of fingerprints that differ in one or two bits."""
    def block(i):
        return F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))

    keys = F.array(*[F.shiftleft(F.lit(p).cast("long"), 32).bitwiseOR(F.shiftleft(block(i), 16)).bitwiseOR(block(j))
                     for p, (i, j) in enumerate(BLOCK_PAIRS)])
    keyed = distinct.select("fp", "rep", F.explode(keys).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = pin(keyed.join(shared, "key"))

    small = keyed.where(F.col("n") <= SMALL)
    a, b = small.alias("a"), small.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= 2
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & near)
    pairs = pairs.select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))

    masks = [[0, *(_signed(1 << (16 * k + bit)) for k in range(4) if k not in pair for bit in range(16))] for pair in BLOCK_PAIRS]
    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in masks])
    forms = (keyed.where(F.col("n") > SMALL)
             .select("key", "rep", "fp", F.explode(F.get(masks, F.shiftright("key", 32).cast("int"))).alias("mask"))
             .select("key", "rep", F.col("fp").bitwiseXOR(F.col("mask")).alias("form")))
    first = forms.groupBy("key", "form").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = forms.join(first, ["key", "form"]).where(F.col("rep") != F.col("least"))
    return pairs.unionByName(stars.select(F.col("rep").alias("u"), F.col("least").alias("v")))


def simhash_dedup(documents: DataFrame) -> DataFrame:
    """Near-duplicate components of whole texts.

    Takes ``doc_id long, text string``. Returns a row for each row: doc_id,
    fingerprint (16 hex digits), component_id (smallest doc_id that links
    reach, its own included), kept (doc_id = component_id).
    """
    prints = pin(fingerprints(documents))
    known = prints.where("doc_id is not null")
    distinct = known.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = components(_links(distinct))
    classes = (distinct.join(found, distinct["rep"] == found["node"], "left")
               .select("fp", F.coalesce("component", "rep").alias("component_id")))
    out = known.join(classes, "fp").unionByName(
        prints.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
                      (F.col("doc_id") == F.col("component_id")).alias("kept"))


def first_copies(documents: DataFrame) -> DataFrame:
    """The document that stays of each near-duplicate group: doc_id, h1, h2 (``text_hashes`` of its text), no two rows alike.

    Here a document is a doc_id with a text: rows that repeat both are one, and
    of two texts under one id each is judged by its own fingerprint. The first
    of a group by (doc_id, h1, h2) stays; rows without doc_id take no part.
    """
    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text", *text_hashes())
    prints = pin(texts.mapInArrow(_fingerprints, "doc_id long, h1 long, h2 long, fp long"))
    distinct = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("rep"))
    found = components(_links(distinct))
    return (distinct.join(found, distinct["rep"] == found["node"], "left")
            .select(F.coalesce("component", "rep").alias("first")).distinct().select("first.*"))


def text_hashes() -> list[Column]:
    """Two 64-bit hashes of a text, h1 and h2; a null text is an empty one."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]
