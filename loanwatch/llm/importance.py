"""Quality selection by importance resampling over hashed n-gram models.

Method: a text is the bag of its tokens and pairs of neighbouring tokens, hashed
to ``BUCKETS`` buckets. A token is a run of letters, marks and digits in lower
case, or a run of other visible characters. Spark adds up the buckets of all
target texts and of all raw texts; each side is a generative model, the share
of a bucket with ``SMOOTH`` added to its count. A document's weight is the sum,
over all its n-grams, of log(target share / raw share). Drawing ``k`` documents
without replacement in proportion to their weights is taking the ``k`` largest
of weight + Gumbel noise. The noise comes from a hash of doc_id, so a
document's draw depends neither on the layout nor on other rows.

Size: a task and the driver hold one number for each bucket; every row and every
token counts. The ``k`` largest are cut by global positions, not in one task.

Defined results: a null or empty text has weight 0. Rows that repeat a doc_id
get one noise, and rows equal in doc_id and text are one document in the draw:
each is returned, and all are selected or none. A null doc_id is never
selected and has no key. Other columns are not looked at.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.position import with_position
from ..session import pin
from .common import chunks, mix64

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SMOOTH = 1.0
SEED = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)

_TABLES: tuple[np.ndarray, np.ndarray] | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower case, and its kind (0 white or control, 1 letter, mark or digit, 2 other)."""
    global _TABLES
    if _TABLES is None:
        lower, kind = np.arange(0x110000, dtype=np.uint32), np.full(0x110000, 2, np.int8)
        for cp in range(0x33480):
            ch = chr(cp)
            group = unicodedata.category(ch)
            lower[cp] = ord(ch.lower()[0])
            kind[cp] = 0 if group[0] in "ZC" or ch.isspace() else 1 if group[0] in "LMN" else 2
        _TABLES = lower, kind
    return _TABLES


def _ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each token and each pair of neighbouring tokens of a text, with repeats."""
    texts = column.to_pylist()
    lower, kinds = _tables()
    row_of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)      # every text ends in a white character
    kind = kinds[points]
    start = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    length = np.diff(np.append(start, len(points)))
    power = np.cumprod(np.full(int(length.max(initial=1)), _ODD))
    parts = mix64(lower[points].astype(np.uint64) + np.uint64(1)) * power[np.arange(len(points)) - np.repeat(start, length)]
    token = mix64(np.add.reduceat(parts, start)) if len(start) else np.empty(0, np.uint64)
    seen = kind[start] > 0
    token, row = token[seen], row_of[start[seen]]
    same = np.flatnonzero(row[1:] == row[:-1])
    pair = mix64(token[same] * _ODD + token[same + 1])
    bucket = np.concatenate([token, pair]) >> np.uint64(64 - BUCKET_BITS)
    return np.concatenate([row, row[same]]), bucket.astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(BUCKETS, np.int64)
    for batch in chunks(batches, "text"):
        held += np.bincount(_ngrams(batch.column("text"))[1], minlength=BUCKETS)
    some = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["bucket", "n"])


def counts(documents: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the texts of all rows."""
    found = documents.select("text").mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()        # a row for each bucket at most
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(target share / raw share) of each bucket."""
    def share(n):
        return np.log(n + SMOOTH) - np.log(n.sum() + SMOOTH * BUCKETS)
    return share(target) - share(raw)


def weigh(documents: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, h (hash of the text), log_weight of each whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            row, bucket = _ngrams(batch.column("text"))
            weight = np.bincount(row, shared.value[bucket], batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(weight)], ["doc_id", "h", "log_weight"])
    rows = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    return rows.mapInArrow(run, "doc_id long, h long, log_weight double")


def gumbel(doc_id, seed: int = SEED):
    """Standard Gumbel noise from a hash of the id: 53 bits of it are a number inside (0, 1)."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11).cast("double") + 0.5) * F.lit(2.0 ** -53)
    return -F.log(-F.log(u))


def resample(documents: DataFrame, target: DataFrame, share: float) -> DataFrame:
    """Draw a share of the documents that looks like the target texts.

    Takes ``doc_id long, text string`` of all (raw) documents and ``text`` of the
    target. Returns a row for each row: doc_id, log_weight, key (log_weight +
    noise), selected (among the round(share * documents) largest keys; equal
    keys: the smaller doc_id, then text hash). Without n-grams in the target
    the weights are 0 and the draw is a uniform one.
    """
    wanted = counts(target)
    ratios = log_ratios(wanted, counts(documents)) if wanted.any() else np.zeros(BUCKETS)
    rows = pin(weigh(documents, ratios).withColumn("key", F.when(F.col("doc_id").isNotNull(), F.col("log_weight") + gumbel(F.col("doc_id")))))
    different = rows.where("doc_id is not null").select("doc_id", "h", "key").dropDuplicates(["doc_id", "h"])
    k = round(share * different.count())
    drawn = with_position(different, [F.desc("key"), F.asc("doc_id"), F.asc("h")], name="__place").where(F.col("__place") <= k)
    drawn = drawn.select("doc_id", "h", F.lit(True).alias("selected"))
    return rows.join(drawn, ["doc_id", "h"], "left").select("doc_id", "log_weight", "key", F.coalesce("selected", F.lit(False)).alias("selected"))
