"""Removal of word passages that a document with a smaller id also holds.

Method: Rabin-Karp hashes of every window of ``window`` consecutive words; a
window whose hash also starts in a smaller document is repeated, and its words
go. Repeated windows are merged to maximal intervals of words.

Sending the hash of every window of the corpus through a shuffle would move
several times the input, so windows first get an *anchor*: the least hash of
the ``GRAM``-word grams inside the window. Equal windows have equal anchors and
neighbouring windows mostly share theirs, so anchors are few. Only windows
whose anchor occurs in two documents or more can be repeated; their hashes, and
no others, are counted. This loses nothing: the anchor is a function of the
window's words. Windows meet under (anchor, hash), 128 bits from two functions.

Skew: a passage may sit in a third of the documents. Each task first settles
its own windows (only the smallest document of a window goes on), and an anchor
found in many documents is spread over several buckets by window hash.

Defined results: a null text has no words; a null ``doc_id`` is smaller than
nothing and repeats nothing, so its row is returned whole; rows that share a
``doc_id`` are one document with several texts and remove nothing from each
other; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .common import chunks, mix64, partitions, text_bytes
from .words import sliding_min, window_hashes, word_bounds, word_hashes

WINDOW = 50
#: Words in the grams whose least hash is a window's anchor.
GRAM = 10
#: Windows that a task settles at once, and that a bucket is meant to hold.
SETTLE = 2_000_000
#: Documents of an anchor for each bucket it is spread over.
SPREAD = 50_000


def _segments(batch: pa.RecordBatch, window: int):
    """Stretches of consecutive windows of one text that share an anchor.

    Row in the batch, anchor, first window (its word number in the text) and
    number of windows of each stretch; then the hashes of all windows, in order.
    """
    data, offsets = text_bytes(batch.column("text"))
    starts, ends, of_doc = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    grams = min(GRAM, window)
    hashes = window_hashes(words, window)
    if not len(hashes):
        none = np.empty(0, np.int64)
        return none, none, none, none, hashes.view(np.int64)
    anchors = sliding_min(mix64(window_hashes(words, grams)), window - grams + 1)
    row = np.searchsorted(of_doc, np.arange(len(hashes)), side="right") - 1
    whole = np.arange(len(hashes)) + window <= of_doc[row + 1]
    at, row, anchors, hashes = np.flatnonzero(whole), row[whole], anchors[whole], hashes[whole]
    if not len(at):
        return row, at, at, at, hashes.view(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
    cut = np.flatnonzero(new)
    return (row[cut], anchors[cut].view(np.int64), at[cut] - of_doc[row[cut]],
            np.diff(np.append(cut, len(at))), hashes.view(np.int64))


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            row, anchor, *_ = _segments(batch, window)
            yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(ids[row], pa.int64())],
                                             ["anchor", "doc_id"])
    return run


def _settle(anchor: np.ndarray, hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows also start in a smaller document among these."""
    order = np.lexsort((doc, hashes, anchor))
    a, h, d = anchor[order], hashes[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (h[1:] != h[:-1])
    gone = np.empty(len(order), bool)
    gone[order] = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
    return gone


_ROWS = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("gone", pa.bool_()),
                   ("anchor", pa.int64()), ("windows", pa.binary()), ("hashes", pa.binary())])


def _packed(key: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[pa.Array]]:
    """Consecutive equal keys as one row each: first places, and the values as little-endian bytes."""
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    out = []
    for v in values:
        ends = np.append(cut, len(key)).astype(np.int32) * v.itemsize
        out.append(pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(v))]))
    return cut, out


def _window_rows(window: int, buckets: int):
    """Candidate windows as rows for each (bucket, text, anchor), and rows of windows already known to be repeated."""
    def flush(parts: list) -> pa.RecordBatch:
        anchor, hashes, doc, key, start, spread = (np.concatenate(x) for x in zip(*parts, strict=True))
        gone = _settle(anchor, hashes, doc)
        slot = mix64((anchor.view(np.uint64) + (mix64(hashes.view(np.uint64)) & (spread - 1).astype(np.uint64))))
        # What is settled only travels to its document: dealt by that, not by the anchor.
        slot = np.where(gone, mix64(doc.view(np.uint64)), slot)
        bucket = (slot % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((start, anchor, key, doc, bucket, gone))
        anchor, hashes, doc, key, start, bucket, gone = (x[order] for x in (anchor, hashes, doc, key, start, bucket, gone))
        change = np.zeros(len(order), np.int64)
        change[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in (anchor, doc, key, bucket, gone)])
        cut, (w, h) = _packed(np.cumsum(change), [start.astype(np.int32), hashes])
        h = pa.compute.if_else(pa.array(gone[cut]), pa.scalar(None, pa.binary()), h)
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(doc[cut]), pa.array(key[cut]), pa.array(gone[cut]),
                                           pa.array(anchor[cut]), w, h], schema=_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in chunks(batches, "text"):
            ids, keys = (batch.column(c).to_numpy() for c in ("doc_id", "text_key"))
            row, anchor, start, n, hashes = _segments(batch, window)
            wanted = batch.column("anchors").flatten()
            spread = dict(zip(*(wanted.field(i).to_pylist() for i in (0, 1)), strict=True))
            known, size = np.array(sorted(spread), np.int64), np.array([spread[a] for a in sorted(spread)], np.int64)
            at = np.minimum(np.searchsorted(known, anchor), max(len(known) - 1, 0))
            keep = known[at] == anchor if len(known) else np.zeros(len(anchor), bool)
            hashes, (row, anchor, start, at, n) = hashes[np.repeat(keep, n)], (x[keep] for x in (row, anchor, start, at, n))
            if not len(hashes):
                continue
            inside = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n)
            parts.append([np.repeat(anchor, n), hashes, np.repeat(ids[row], n), np.repeat(keys[row], n),
                          np.repeat(start, n) + inside, np.repeat(size[at], n)])
            held += len(hashes)
            if held >= SETTLE:
                yield flush(parts)
                parts, held = [], 0
        if parts:
            yield flush(parts)
    return run


def _resolve(rows: pa.Table) -> pa.Table:
    """The repeated windows of one bucket, as rows (doc_id, text_key, windows)."""
    done = rows.filter(rows["gone"]).select(["doc_id", "text_key", "windows"])
    rows = rows.filter(pa.compute.invert(rows["gone"])).combine_chunks()
    n = pa.compute.binary_length(rows["windows"]).to_numpy() // 4
    doc, key, anchor = (np.repeat(rows[c].to_numpy(), n) for c in ("doc_id", "text_key", "anchor"))
    start = np.frombuffer(b"".join(rows["windows"].to_pylist()), np.int32)
    hashes = np.frombuffer(b"".join(rows["hashes"].to_pylist()), np.int64)
    gone = _settle(anchor, hashes, doc)
    row = np.repeat(np.arange(len(n)), n)[gone]
    cut, (w,) = _packed(row, [start[gone]])
    found = pa.table([pa.array(doc[gone][cut], pa.int64()), pa.array(key[gone][cut], pa.int64()), w],
                     names=["doc_id", "text_key", "windows"])
    return pa.concat_tables([done.cast(found.schema), found])


def _cut(window: int, keep: list[str]):
    """Removes the words of repeated windows from each whole text."""
    found = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()),
                       ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())])

    def one(text: str, key: int, gone: list | None):
        words = text.encode().split()
        starts = [np.frombuffer(g["windows"], np.int32) for g in gone or () if g["text_key"] == key]
        if not starts:
            return len(words), 0, [], b" ".join(words).decode()
        step = np.zeros(len(words) + 1, np.int64)
        starts = np.unique(np.concatenate(starts))
        step[starts] += 1
        np.add.at(step, starts + window, -1)
        out = np.cumsum(step[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
        kept = b" ".join(w for w, o in zip(words, out.tolist(), strict=True) if not o)
        return len(words), int(out.sum()), [{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)], kept.decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "text_key", "gone")), strict=True)
            cut = [pa.array(x, t) for x, t in zip(zip(*(one(*r) for r in rows), strict=True), found.types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *keep)), *cut], ["doc_id", *keep, *found.names])
    return run


def substring_dedup(documents: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cut each word that a window shared with a smaller document covers.

    Takes ``doc_id long, text string``. Returns a row for each row: doc_id, the
    columns named in ``keep`` as they were (others are left out), n_words, n_removed, spans (removed intervals of
    word numbers, end excluded, in order, not touching), kept_text (kept words
    joined by one space). Windows are judged on the input, not on what is left.
    """
    spark = documents.sparkSession
    own = [f"__keep_{c}" for c in keep]
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"),
                            *[F.col(c).alias(k) for k, c in zip(own, keep, strict=True)])
    whole = docs.where("doc_id is not null").withColumn("text_key", F.xxhash64("text"))

    anchors = pin(whole.select("doc_id", "text").mapInArrow(_anchor_rows(window), "anchor long, doc_id long"))
    shared = (anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
              .where("lo < hi")
              .select("anchor", F.pow(F.lit(2), F.ceil(F.log2(F.ceil(F.col("n") / SPREAD)))).cast("long").alias("spread")))
    wanted = pin(anchors.join(shared, "anchor").groupBy("doc_id")
                 .agg(F.collect_set(F.struct("anchor", "spread")).alias("anchors")))
    windows = (wanted.agg(F.sum(F.size("anchors"))).first()[0] or 0) * (window - GRAM)
    buckets = max(partitions(spark), -(-windows // SETTLE))

    found = (whole.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "text_key", "anchors")
             .mapInArrow(_window_rows(window, buckets), "bucket int, doc_id long, text_key long, gone boolean, anchor long, windows binary, hashes binary")
             .groupBy("bucket").applyInArrow(_resolve, "doc_id long, text_key long, windows binary"))
    gone = found.groupBy("doc_id").agg(F.collect_list(F.struct("text_key", "windows")).alias("gone"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    out = ", ".join(["doc_id long", *(f"{k} {kinds[k]}" for k in own), "n_words long, n_removed long",
                     "spans array<struct<start:bigint,end:bigint>>, kept_text string"])
    nothing = F.lit(None).cast(gone.schema["gone"].dataType)
    return (whole.join(gone.hint("shuffle_hash"), "doc_id", "left")
            .unionByName(docs.where("doc_id is null").select("*", F.lit(0).cast("long").alias("text_key"), nothing.alias("gone")))
            .mapInArrow(_cut(window, own), out)
            .select("doc_id", *[F.col(k).alias(c) for k, c in zip(own, keep, strict=True)], "n_words", "n_removed", "spans", "kept_text"))
