"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Method: a text is the set of its hashed character n-grams (``ORDERS``
characters inside one word, word ends included). Over all labelled training
texts Spark counts, for each hash bucket, the toxic and the clean texts that
hold it; the smoothed log ratio of the two shares is the bucket's scale. Every
bucket whose two shares differ by ``SIGNIFICANT`` standard errors or more is a
feature. Logistic weights for the scaled features are fitted on a bounded
sample of labelled rows, by hash of id and text: about ``sample_rows`` rows, of
about ``sample_entries`` features in all. Scoring reads each whole text once.

Defined results: rows that repeat are counted and scored as often as they
stand, a null doc_id is as good as any, and columns beside doc_id, text and
toxic are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix64
from .language_id import _letter_codes

ORDERS = (3, 4, 5)
BUCKETS = 1 << 18
SIGNIFICANT = 2.0
SAMPLE_ROWS, SAMPLE_ENTRIES = 20_000, 6_000_000
SMOOTH, RIDGE, STEPS = 1.0, 1.0, 60


def _text_grams(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of the n-grams of each text, each bucket once per row, in order.

    ``wanted`` maps buckets to features (-1: none); then features take the place of buckets.
    """
    texts = column.to_pylist()
    row_of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    points = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le"), np.uint32)     # a word end on both sides of each text
    code = _letter_codes()[points]
    c = code.astype(np.uint64)
    edge = code == 0
    found = []
    for n in ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        inner = np.zeros(m, bool)
        for k in range(n):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += c[k:m + k]
            if 0 < k < n - 1:
                inner |= edge[k:m + k]
        at = np.flatnonzero(~inner)
        bucket = (mix64(h[at]) >> np.uint64(64 - 18)).astype(np.int64)
        if wanted is not None:
            bucket = wanted[bucket]
            at, bucket = at[bucket >= 0], bucket[bucket >= 0]
        found.append(row_of[at] * BUCKETS + bucket)     # row_of is one short: this is the row of the second character
    flat = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return flat // BUCKETS, flat % BUCKETS


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros((2, BUCKETS), np.int64)
    for batch in chunks(batches, "text"):
        row, bucket = _text_grams(batch.column("text"))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        for side in (0, 1):
            held[side] += np.bincount(bucket[toxic[row] == bool(side)], minlength=BUCKETS)
    some = np.flatnonzero(held.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[0, some]), pa.array(held[1, some])], ["bucket", "clean", "toxic"])


@dataclass
class ToxicityModel:
    """feature: the feature of each bucket or -1; weight: of each feature, the log-count ratio worked in."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        row, feature = _text_grams(column, self.feature)
        z = np.bincount(row, self.weight[feature], len(column)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _fit(sizes: np.ndarray, feature: np.ndarray, y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression over scaled 0/1 features, by L-BFGS.

    ``feature`` holds the features of all rows end to end, ``sizes`` how many are of each row.
    """
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    row = np.repeat(np.arange(len(y), dtype=np.int32), sizes)

    def loss(w):
        z = np.full(len(y), w[-1])
        if len(some):
            z[some] += np.add.reduceat((w[:-1] * scale)[feature], starts)
        miss = 1 / (1 + np.exp(-np.clip(z, -700, 700))) - y
        slope = np.append(np.bincount(feature, miss[row], len(scale)) * scale + RIDGE * w[:-1], miss.sum())
        return (np.logaddexp(0, z) - y * z).sum() + RIDGE / 2 * w[:-1] @ w[:-1], slope

    w = np.zeros(len(scale) + 1)
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    value, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        move, kept = -slope, []
        for s, d in reversed(past):
            kept.append((s @ move) / (s @ d))
            move = move - kept[-1] * d
        if past:
            move *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        else:
            move /= max(1.0, np.linalg.norm(slope))
        for (s, d), a in zip(past, reversed(kept), strict=True):
            move = move + (a - (d @ move) / (s @ d)) * s
        step, down = 1.0, slope @ move
        while True:                             # halve the step until the loss falls as the slope promises
            at = w + step * move
            new, new_slope = loss(at)
            if new <= value + 1e-4 * step * down or step < 1e-6:
                break
            step /= 2
        s, d = at - w, new_slope - slope
        done = value - new <= 1e-7 * abs(value)
        if new < value:
            w, value, slope = at, new, new_slope
        if done:
            break
        if s @ d > 0:
            past = [*past[-9:], (s, d)]
    return w[:-1] * scale, float(w[-1])


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_entries: int = SAMPLE_ENTRIES) -> ToxicityModel | None:
    """A model from ``doc_id, text, toxic`` (0 or 1); None without rows of both classes.

    Null texts count as empty; rows with another label or none are left out.
    All rows count towards the log-count ratios; the weights are fitted on
    about ``sample_rows`` of them, or fewer that hold ``sample_entries``
    features, by hash of doc_id and text.
    """
    rows = (labelled.select(F.col("doc_id").cast("long"), "text", F.col("toxic").cast("int").alias("toxic"))
            .where(F.col("toxic").isin(0, 1)))
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    counts = (rows.select("text", "toxic").mapInArrow(_count_buckets, "bucket long, clean long, toxic long")
              .groupBy("bucket").agg(F.sum("clean"), F.sum("toxic")).toArrow())     # a row for each bucket at most
    bucket, clean, toxic = (counts.column(i).to_numpy() for i in range(3))
    with_toxic, with_clean = (toxic + SMOOTH) / (sizes[1] + 2 * SMOOTH), (clean + SMOOTH) / (sizes[0] + 2 * SMOOTH)
    ratio = np.log(with_toxic / with_clean)
    share = (toxic + clean) / (sizes[0] + sizes[1])
    strength = np.abs(with_toxic - with_clean) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / sizes[0] + 1 / sizes[1]))
    best = np.sort(bucket[strength >= SIGNIFICANT])
    feature = np.full(BUCKETS, -1, np.int64)
    feature[best] = np.arange(len(best))
    scale, held = np.zeros(BUCKETS), np.zeros(BUCKETS, np.int64)
    scale[bucket], held[bucket] = ratio, clean + toxic

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            row, col = _text_grams(batch.column("text"), feature)
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows)))
            of_row = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(col.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), of_row], ["toxic", "features"])

    share = min(1.0, sample_rows / sum(sizes.values()), sample_entries / max(1, int(held[best].sum())))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < int((1 << 40) * share)
    sample = rows.where(part).select("toxic", "text").mapInArrow(features, "toxic int, features array<int>").toArrow().combine_chunks()
    if not sample.num_rows:
        return None
    lists = sample["features"].combine_chunks()
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat, y = lists.values.to_numpy()[ends[0]:], sample["toxic"].to_numpy()
    ends = ends - ends[0]
    sums = np.add.reduceat(np.append(mix64(flat.astype(np.uint64)), np.uint64(0)), ends[:-1])
    order = np.lexsort((sums, np.diff(ends), y))                # not by arrival
    sizes_in_order = np.diff(ends)[order]
    place = np.repeat(ends[:-1][order] - (np.cumsum(sizes_in_order) - sizes_in_order), sizes_in_order) + np.arange(len(flat))
    weight, bias = _fit(sizes_in_order, flat[place], y[order].astype(float), scale[best])
    return ToxicityModel(feature, weight, bias)


def score(documents: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """Toxicity of each whole text.

    Takes ``doc_id long, text string``; nothing else is looked at. Returns a
    row for each row: doc_id, score (0 to 1; a null or empty text gets the
    model's score of a text without n-grams), predicted (1 if score >= 0.5).
    Without a model every score is 0.
    """
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(batch.column("text")))], ["doc_id", "score"])
    return (rows.mapInArrow(run, "doc_id long, score double")
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
