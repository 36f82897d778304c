"""Token ids in Parquet files that can be read in part.

Method: rows are dealt by range of doc_id, so each file holds one stretch of
the order and is sorted; only then are texts encoded, so that ids are never
shuffled. One row is one document: doc_id, the file's number, the document's
start among the file's ids, its number of ids, and the ids as a list column.
Ids are dictionary-encoded (a dictionary holds a row group's different ids, and
each id takes as many bits as their count asks) or delta-encoded; the other
columns take the delta encodings of Parquet's second version. Row groups are
closed at ``row_group_bytes`` and pages at ``page_bytes`` or ``page_rows``;
the writer adds a page index (least and greatest value, and place, of each
page). So a range of doc_ids reads the pages that hold it and no others, and
metadata reads touch no ids.

Starts over all files are the file's start plus the ids of the files before it:
one number per file, kept beside the files in ``shards``. Nothing is read
twice to place a document.

Ids are those of the tokenizers library, without special tokens and with
special tokens' strings taken as plain text. The library encodes each different
pre-token once (boundaries by ``bpe.token_starts``, which tests hold against whole
texts); equal ones of a step are found as an Arrow dictionary, and texts are put
together by array lookups. A worker keeps them from task to task in two generations of bounded size:
when one is full it becomes the older one, and what is not asked for again goes with it.

Skew: rows that repeat a doc_id are dealt by the hash of their text and their
place in the input too, so a doc_id with a third of all rows spans files. Texts
are taken ``STEP_BYTES`` at a time, a longer one by itself.

Defined results: a null or empty text is the end id alone; a null doc_id stands
before all others; rows that repeat a doc_id stand in order of their text's
hash; no rows make files without rows. Other columns are not looked at.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import different_pieces, laid_out
from .common import chunks, partitions

END_ID = 0
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 64 << 10, 1000
#: Bytes of text that are encoded together: the more, the more pre-tokens are looked up once.
STEP_BYTES = 2 << 20
#: Pre-tokens in a generation of a worker's cache.
GENERATION = 300_000

_ROWS = "shard int, doc_id long, start_in_shard long, n_tokens int, ids array<int>"
_SHARDS = "shard int, start long, n_rows long, n_tokens long"
_IDS = "ids.list.element"


@dataclass
class Library:
    """A tokenizer file of the tokenizers library, which encodes each different pre-token once."""

    path: str
    cache: dict[bytes, bytes] = field(init=False, repr=False, default_factory=dict)
    older: dict[bytes, bytes] = field(init=False, repr=False, default_factory=dict)

    def __post_init__(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")       # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(self.path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.lengths[list(vocabulary.values())] = list(map(len, vocabulary))       # byte-level: a character is a byte

    def __reduce__(self):
        return Library, (self.path,)

    def _joined(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens that are a blank and what is no white space: laid end to end they are one text with the
        same pre-tokens, so one call encodes them all; the ids' lengths in bytes say where each one ends."""
        if not pieces:
            return []
        text = self.tokenizer.encode_batch_fast([b"".join(pieces).decode()], add_special_tokens=False)[0]
        ids = np.array(text.ids, "<i4")
        ends = np.cumsum(self.lengths[ids])
        cut = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))))
        packed, stops = ids.tobytes(), (4 * (cut + 1)).tolist()
        return [packed[a:b] for a, b in pairwise([0, *stops])]

    def _packed(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of different pre-tokens."""
        if len(self.cache) > GENERATION:
            self.older, self.cache = self.cache, {}
        out = list(map(self.cache.get, pieces))
        missing = [i for i, y in enumerate(out) if y is None]
        joined, rest, older = [], [], self.older.get
        for i in missing:
            x = pieces[i]
            y = out[i] = older(x)
            if y is None:
                (joined if x[0] == 0x20 and len(x) > 1 and (0x20 < x[1] < 0x7F or 0xC2 < x[1] < 0xE0) else rest).append(i)
        encoded = self.tokenizer.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False)
        for i, y in [*zip(joined, self._joined([pieces[i] for i in joined]), strict=True), *((i, np.array(x.ids, "<i4").tobytes()) for i, x in zip(rest, encoded, strict=True))]:
            out[i] = y
        self.cache.update((pieces[i], out[i]) for i in missing)
        return out

    def encode(self, column: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """For texts without nulls: the ids of each pre-token (packed), and the n + 1 offsets of the texts' pre-tokens."""
        pieces, which, _, of_text = different_pieces(column)
        return list(map(self._packed(pieces).__getitem__, which.tolist())), of_text

    def ids(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """For texts without nulls: their ids end to end, each text's followed by the end id, and the n + 1 offsets of the texts among them."""
        pieces, which, _, of_text = different_pieces(column)
        return laid_out(self._packed(pieces), which, of_text, end_id)


def _encode(shared, end_id: int):
    """Rows of the file format from sorted rows; a task is a file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, shard, start = shared.value, TaskContext.get().partitionId(), 0
        for batch in chunks(batches, "text", STEP_BYTES):
            flat, offsets = library.ids(batch.column("text"), end_id)
            sizes = np.diff(offsets)
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sizes), shard, np.int32)), batch.column("doc_id"), pa.array(start + np.cumsum(sizes) - sizes),
                 pa.array(sizes.astype(np.int32)), ids], ["shard", "doc_id", "start_in_shard", "n_tokens", "ids"])
            start += int(sizes.sum())
    return run


def write_tokens(documents: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, encoding: str = "dictionary",
                 row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS, files: int | None = None) -> None:
    """Write ``doc_id long, text string`` as token files in ascending doc_id order.

    ``tokenizer`` is a file of the tokenizers library that every executor can
    read; ``encoding`` is "dictionary" or "delta" (of the ids). Writes
    ``folder/tokens`` (a file for each stretch of doc_ids) and
    ``folder/shards`` (a row for each file); the second is written last, so
    a folder without it is not whole.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding {encoding!r}")
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"key": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    dealt = (rows.repartitionByRange(files or partitions(spark), "doc_id", "key", "place")
             .sortWithinPartitions("doc_id", "key", "place").select("doc_id", "text"))
    options = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false",
               f"parquet.enable.dictionary#{_IDS}": str(encoding == "dictionary").lower(), "parquet.block.size": row_group_bytes,
               "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows, "compression": "zstd"}
    shared = spark.sparkContext.broadcast(Library(tokenizer))            # the file's path; a worker loads it once
    dealt.mapInArrow(_encode(shared, end_id), _ROWS).write.options(**options).parquet(f"{folder}/tokens")

    sums = (spark.read.schema(_ROWS).parquet(f"{folder}/tokens").groupBy("shard")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("n_tokens")).orderBy("shard").collect())
    start, shards = 0, []
    for r in sums:                                                      # one row for each file
        shards.append((r["shard"], start, r["n_rows"], r["n_tokens"]))
        start += r["n_tokens"]
    spark.createDataFrame(shards, _SHARDS).coalesce(1).write.parquet(f"{folder}/shards")


def _starts(spark: SparkSession, folder: str) -> Column:
    shards = spark.read.schema(_SHARDS).parquet(f"{folder}/shards").collect()
    literal = {r["shard"]: r["start"] for r in shards}
    return F.get(F.from_json(F.lit(json.dumps([literal.get(k, 0) for k in range(max(literal, default=-1) + 1)])), "array<bigint>"), F.col("shard"))


def read_tokens(spark: SparkSession, folder: str, where: Column | None = None, ids: bool = True) -> DataFrame:
    """Documents of a token folder: doc_id, start (ids of all documents before), n_tokens, and ids if wanted.

    ``where`` is a condition on doc_id and n_tokens; it reaches the files, which
    skip row groups and pages by their statistics. Without ``ids`` no id is read.
    """
    rows = spark.read.schema(_ROWS).parquet(f"{folder}/tokens")
    rows = rows if where is None else rows.where(where)
    return rows.select("doc_id", (_starts(spark, folder) + F.col("start_in_shard")).alias("start"),
                       F.col("n_tokens").cast("long").alias("n_tokens"), *["ids"] if ids else [])


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens (of the list) and ids_crc32 of ``read_tokens`` rows: CRC-32 of the ids as little-endian 32-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            data, offsets = memoryview(ids.values.to_numpy().astype("<i4", copy=False)).cast("B"), ids.offsets.to_numpy()
            sums = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets).astype(np.int64)),
                                              pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
