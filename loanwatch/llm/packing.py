"""Best-fit packing of tokenised documents into sequences.

Method: hierarchical residual packing. Pieces are dealt to partitions by hash,
so that a table ordered by length or source gives each a mix, and each
partition packs its own by best fit, longest first. Bins that are nearly full
are done. The others are items of the next round: the bins of eight
neighbouring partitions (then of eight such groups, and so on to one) are packed
again by best fit, each moving as a whole.

Best fit leaves at most one bin of a group half full or less, and two fuller
ones never go together. So all further joins need one of those bins each, of
which there are no more than groups; a group that hands on one bin more than
there are groups, its emptiest, leaves out none that could lower the number of
sequences: whatever a fuller bin would take, an emptier unused one takes too.

Token ids come from the byte-level BPE of ``bpe.py``, which a test holds
against the tokenizers library.

Defined results: a null or empty text is one piece with the end id alone; rows
that repeat a doc_id, or have none, are packed as documents of their own; other
columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .bpe import Bpe
from .common import chunks

CAPACITY, END_ID = 2048, 0
#: Fill from which a bin is done, as a share of the capacity; groups merged per round; items a first task packs, about.
NEARLY_FULL, FAN_IN, ITEMS = 0.99, 8, 1 << 17
#: Partition number above this bit of an item's or bin's number.
_PART = 40


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, each into the fullest bin that takes it (ties: the last opened)."""
    order = np.argsort(-lengths, kind="stable").tolist()
    sizes = lengths.tolist()
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    with_room: dict[int, list[int]] = {}
    rooms, made = 0, 0                          # rooms: bit r is set if a bin with room r is open
    for i in order:
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, made
            made += 1
        bins[i], offsets[i] = at, capacity - room
        left = room - size
        if left:
            with_room.setdefault(left, []).append(at)
            rooms |= 1 << left
    return bins, offsets


def _packed(names: np.ndarray, lengths: np.ndarray, capacity: int) -> list[pa.Array]:
    """into, offset, fill, turn for each item; a bin has the name of its first item.

    ``turn`` numbers a group's open bins from 0 by fill, emptiest first; it is -1 for those nearly full.
    """
    bins, offsets = best_fit(lengths, capacity)
    n = bins.max(initial=-1) + 1
    fill = np.bincount(bins, lengths, n).astype(np.int64)
    name = np.empty(n, np.int64)
    name[bins[offsets == 0]] = names[offsets == 0]
    turn = np.empty(n, np.int64)
    turn[np.argsort(fill, kind="stable")] = np.arange(n)
    turn[fill >= NEARLY_FULL * capacity] = -1
    return [pa.array(name[bins]), pa.array(offsets), pa.array(fill[bins]), pa.array(turn[bins])]


def pieces(documents: DataFrame, bpe: Bpe, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token ids of each whole text and the end id, cut into pieces of ``capacity`` only where longer.

    Returns item (unique), doc_id, piece, start, length, ids_crc32, ids (binary,
    little-endian unsigned 32-bit). Of a cut document the first piece may be
    shorter. ``item`` follows the layout: write the result before using it twice.
    """
    shared = documents.sparkSession.sparkContext.broadcast(bpe)
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = TaskContext.get().partitionId() << _PART
        for batch in chunks(batches, "text"):
            flat, offsets = shared.value.ids(batch.column("text"), end_id)
            flat, rows = flat.astype("<u4", copy=False).tobytes(), []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                n = b - a
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    part = flat[4 * (a + s):4 * (a + e)]
                    rows.append((item, doc, k, s, e - s, zlib.crc32(part), part))
                    item += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
    return (documents.select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(run, "item long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"))


def _fit_partition(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("item").to_numpy(), b.column("length").to_numpy()) for b in batches if b.num_rows]
        if held:
            items, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(items)
            items, lengths = items[order], lengths[order]
            into, offset, fill, turn = _packed(items, lengths, capacity)
            part = pa.array(np.full(len(items), TaskContext.get().partitionId(), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(items), into, offset, fill, turn, part], ["bin", "into", "offset", "fill", "turn", "part"])
    return run


def _fit_group(capacity: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bin")
        made = _packed(rows["bin"].to_numpy(), rows["fill"].to_numpy(), capacity)
        return pa.table([rows["bin"], *made, rows["part"]], names=["bin", "into", "offset", "fill", "turn", "part"])
    return run


_MOVES = "bin long, into long, offset long, fill long, turn long, part long"


def assign(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place items (``item long, length long``, each at most ``capacity``) in sequences: item, sequence_id, offset."""
    tasks = -(-lengths.count() // ITEMS) or 1
    placed = pin(lengths.select("item", "length").repartition(tasks, "item").mapInArrow(_fit_partition(capacity), _MOVES))
    width = placed.agg(F.max("part")).first()[0] or 0
    moved, last = None, placed
    while width:
        groups = width + 1
        width //= FAN_IN
        bins = last.where(F.col("turn").between(0, groups) & (F.col("offset") == 0)).select(F.col("into").alias("bin"), "fill", F.floor(F.col("part") / FAN_IN).alias("part"))
        last = pin(bins.groupBy("part").applyInArrow(_fit_group(capacity), _MOVES))
        step = last.select(F.col("bin").alias("into"), F.col("into").alias("to"), F.col("offset").alias("by"))
        if moved is None:
            moved = step.select(F.col("into").alias("bin"), F.col("to").alias("into"), F.col("by").alias("shift"))
        else:
            moved = moved.join(step, "into", "left").select(
                "bin", F.coalesce("to", "into").alias("into"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift"))
    own = placed.select(F.col("bin").alias("item"), F.col("into").alias("bin"), "offset")
    if moved is None:
        return own.select("item", F.col("bin").alias("sequence_id"), "offset")
    return own.join(moved, "bin", "left").select(
        "item", F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def pack(documents: DataFrame, bpe: Bpe, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all documents (``doc_id long, text string``) into sequences of at most ``capacity`` tokens.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32,
    ids, sequence_id, offset (place in the sequence; gapless from 0).
    """
    cut = pin(pieces(documents, bpe, capacity, end_id))
    return cut.join(assign(cut, capacity), "item").drop("item")
