"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

Pre-tokenisation works on arrays instead of a regular expression. Each code
point has a class; each class is a function from the tokeniser's states to its
states, and composing functions is associative. All compositions that can occur
form a small closed set, tabulated once, so the state before every character
comes from a scan over that set: blocks of the text are composed side by side,
the blocks' results are scanned, and each block is entered with the state the
blocks before it leave. A token starts where state, class and next class say so.

The slices are bytes; equal ones of a step are found as an Arrow dictionary, and each
distinct one is merged once (lowest rank first) and kept in a cache of bounded size.
Texts' ids are put together by array lookups. Decoding uses the retained token offsets.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_bytes

# Classes of code points. TAIL2/TAIL3: an apostrophe that could begin a contraction of that length. END: between texts.
LETTER, NUMBER, OTHER, BLANK, SPACE, TAIL2, TAIL3, END = range(8)
# States: what the last character was, or how much of a contraction is to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, AFTER_SPACE, ONE_MORE, TWO_MORE = range(8)
# Fixed values of the pattern: white space by the Unicode property, and the contractions by length.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")

BLOCK = 256
CACHE_ENTRIES = 400_000
#: Bytes from which a pre-token is merged by itself.
LONG_PIECE = 200

_CLASS: np.ndarray | None = None


def _classes() -> np.ndarray:
    global _CLASS
    if _CLASS is None:
        table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        for cp in range(len(table)):
            kind = unicodedata.category(chr(cp))[0]
            if kind in "LN":
                table[cp] = LETTER if kind == "L" else NUMBER
        table[WHITE] = SPACE
        table[0x20] = BLANK
        _CLASS = table
    return _CLASS


def _step(state: int, kind: int) -> int:
    if state in (ONE_MORE, TWO_MORE):
        return FRESH if state == ONE_MORE else ONE_MORE
    if kind in (TAIL2, TAIL3) and state not in (IN_OTHERS, AFTER_BLANK):
        return ONE_MORE if kind == TAIL2 else TWO_MORE
    return {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, BLANK: AFTER_BLANK, SPACE: AFTER_SPACE, END: FRESH}.get(kind, IN_OTHERS)


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The closed set of composed transition functions.

    ``of_class[c]``: element of class c; ``compose[a * n + b]``: first a, then
    b; ``value[a]``: the state that a leads to from FRESH.
    """
    basic = [tuple(_step(s, c) for s in range(8)) for c in range(8)]
    elements = list(dict.fromkeys([tuple(range(8)), *basic]))
    seen = set(elements)
    for e in elements:                          # grows while it is walked
        for b in basic:
            made = tuple(b[s] for s in e)
            if made not in seen:
                seen.add(made)
                elements.append(made)
    number = {e: i for i, e in enumerate(elements)}
    compose = np.array([[number[tuple(b[s] for s in a)] for b in elements] for a in elements])
    return (np.array([number[b] for b in basic], np.int32), compose.astype(np.int32).ravel(),
            np.array([e[FRESH] for e in elements], np.uint8))


_OF_CLASS, _COMPOSE, _VALUE = _monoid()
_N = len(_VALUE)


def _states_before(kinds: np.ndarray) -> np.ndarray:
    """The state before each character."""
    def scan(f: np.ndarray) -> np.ndarray:
        """Composition of all functions up to and with each."""
        if len(f) <= BLOCK:
            out = f.copy()
            for i in range(1, len(f)):
                out[i] = _COMPOSE[out[i - 1] * _N + f[i]]
            return out
        rows = -(-len(f) // BLOCK)
        grid = np.empty((BLOCK, rows), np.int32)
        padded = np.zeros(rows * BLOCK, np.int32)               # element 0 changes nothing
        padded[:len(f)] = f
        grid[:] = padded.reshape(rows, BLOCK).T
        for i in range(1, BLOCK):
            grid[i] = _COMPOSE[grid[i - 1] * _N + grid[i]]
        ahead = scan(grid[-1].copy())
        enter = np.zeros(rows, np.int32)
        enter[1:] = ahead[:-1]
        return _COMPOSE[enter[None, :] * _N + grid].T.reshape(-1)[:len(f)]

    out = np.full(len(kinds), FRESH, np.uint8)
    out[1:] = _VALUE[scan(_OF_CLASS[kinds])][:-1]
    return out


# Whether a token starts at a character, by state before it and class; white space after white space is settled apart.
_STARTS = np.zeros((8, 8), bool)
for _s in range(6):
    for _c, _in in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        _STARTS[_s, _c] = _s not in (_in, AFTER_BLANK)
    for _c in (TAIL2, TAIL3):
        _STARTS[_s, _c] = _s not in (IN_OTHERS, AFTER_BLANK)
    for _c in (BLANK, SPACE):
        _STARTS[_s, _c] = _s not in (AFTER_BLANK, AFTER_SPACE)


def token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte places at which a pre-token of any of the texts starts (texts laid end to end)."""
    first = (data & 0xC0) != 0x80
    at = np.flatnonzero(first)
    points = data[at].astype(np.uint32)
    if len(at) != len(data):
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    # One END before each text; empty texts add theirs too.
    place = np.searchsorted(at, offsets[:-1])
    kinds = np.insert(_classes()[points], place, END)
    shifted = np.arange(len(at)) + np.cumsum(np.bincount(place, minlength=len(at) + 1)[:len(at)])
    apostrophe = shifted[points == ord("'")]
    if len(apostrophe):
        full = np.full(len(kinds) + 3, 0, np.uint32)
        full[shifted] = points
        next1, next2 = full[apostrophe + 1], full[apostrophe + 2]
        kinds[apostrophe[np.isin(next1, [ord(x) for x in SHORT])]] = TAIL2
        kinds[apostrophe[np.logical_or.reduce([(next1 == ord(x[0])) & (next2 == ord(x[1])) for x in LONG])]] = TAIL3
    state = _states_before(kinds)
    start = _STARTS[state, kinds]
    white = (kinds == BLANK) | (kinds == SPACE)
    last = np.zeros(len(kinds), bool)           # white space before something that is none
    last[:-1] = white[:-1] & ~white[1:] & (kinds[1:] != END)
    start |= last & ((state == AFTER_BLANK) | (state == AFTER_SPACE))
    return at[start[shifted]]


def different_pieces(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """For texts without nulls: each different pre-token, which of them each pre-token is, the pre-tokens' byte ends, and the n + 1 offsets of the texts' pre-tokens."""
    data, offsets = text_bytes(column)
    starts = token_starts(data, offsets) if len(data) else np.empty(0, np.int64)
    bounds = np.append(starts, len(data)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    each, at = text_bytes(pieces.dictionary)
    each = np.insert(each, at[1:-1], 0xFF).tobytes().split(b"\xff") if len(each) else []        # a byte that UTF-8 never has
    return each, pieces.indices.to_numpy(), bounds[1:], np.searchsorted(starts, offsets)


def laid_out(packed: list[bytes], which: np.ndarray, of_text: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts end to end, each text's followed by the end id, and the n + 1 offsets of the texts among them.

    ``packed`` are the ids of each different pre-token, the others as ``different_pieces`` returns them.
    """
    packed = [*packed, np.array([end_id], "<i4").tobytes()]
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    ids = np.frombuffer(b"".join(packed), "<i4")
    which = np.insert(which, of_text[1:], len(packed) - 1)
    n = sizes[which]
    ends = np.append(0, np.cumsum(n))
    place = np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], n) + np.arange(ends[-1])
    return ids[place], ends[of_text + np.arange(len(of_text))]


_NONE = np.iinfo(np.int32).max


class Merger:
    """Merges pre-tokens into ids: many at a time, in step, each by its own lowest rank.

    ``pairs`` are the sorted numbers (left id << 32 | right id) of all pairs
    whose joined bytes are a token, ``made`` the tokens' ids.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        found = {(left << 32) | right: rank for token, rank in ranks.items() for i in range(1, len(token))
                 if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None}
        self.pairs = np.array(sorted(found), np.int64)
        self.made = np.array([found[k] for k in self.pairs.tolist()], np.int32)
        self._pair = None
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        if not len(self.pairs):
            return np.full(key.shape, _NONE)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (right >= 0) & (left >= 0), self.made[at], _NONE)

    def _step_all(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """Ids of pieces of similar length, as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(starts)
        cols = np.arange(lengths.max())
        inside = cols < lengths[:, None]
        ids = np.where(inside, self.of_byte[data[np.minimum(starts[:, None] + cols, len(data) - 1)]], -1)
        rank, row = self._rank(ids[:, :-1], ids[:, 1:]), np.arange(len(starts))
        while True:
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            least = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), _NONE)
            over = least == _NONE
            done, width = ids[over].astype("<u4").tobytes(), 4 * ids.shape[1]
            for r, a, n in zip(row[over].tolist(), range(0, len(done), width), (4 * (ids[over] >= 0).sum(axis=1)).tolist(), strict=False):
                out[r] = done[a:a + n]
            if over.all():
                return out
            row, ids, rank, at, least = (x[~over] for x in (row, ids, rank, at, least))
            n = np.arange(len(row))
            cols = np.arange(ids.shape[1] - 1)
            ids[n, at] = least
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)
            rank = np.take_along_axis(rank, cols[:-1] + (cols[:-1] >= at[:, None]), axis=1)
            for side in (at - 1, at):           # the two pairs that the new token stands in
                some = np.flatnonzero((side >= 0) & (side < rank.shape[1]))
                rank[some, side[some]] = self._rank(ids[some, side[some]], ids[some, side[some] + 1])

    def _long(self, piece: bytes) -> bytes:
        """One long piece: a heap of pairs and a linked list of parts."""
        ids, n = self.of_byte[np.frombuffer(piece, np.uint8)].tolist(), len(piece)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pair = dict(zip(self.pairs.tolist(), self.made.tolist(), strict=True)).get if self._pair is None else self._pair
        self._pair = pair
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair((ids[i] << 32) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue                        # one of the two is part of another token by now
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := pair((ids[a] << 32) | ids[b])) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        known = list(map(self.ranks.get, pieces))
        out = [b"" if k is None else k.to_bytes(4, "little") for k in known]
        todo = np.array([i for i, k in enumerate(known) if k is None], np.int64)
        todo = todo[np.argsort([len(pieces[i]) for i in todo], kind="stable")].tolist()
        while todo and len(pieces[todo[-1]]) > LONG_PIECE:
            out[todo[-1]] = self._long(pieces[todo[-1]])
            todo.pop()
        data = np.frombuffer(b"".join(pieces[i] for i in todo), np.uint8)
        lengths = np.array([len(pieces[i]) for i in todo], np.int64)
        starts, a = np.cumsum(lengths) - lengths, 0
        while a < len(todo):                    # a step takes pieces up to half as long again, and a bounded matrix
            b = int(np.searchsorted(lengths, max(lengths[a] + 2, lengths[a] * 3 // 2), side="right"))
            b = min(b, a + max(1, (1 << 20) // int(lengths[b - 1])))
            for i, ids in zip(todo[a:b], self._step_all(data, starts[a:b], lengths[a:b]), strict=True):
                out[i] = ids
            a = b
        return out


@dataclass
class Bpe:
    """A byte-level BPE vocabulary: ranks are ids."""

    ranks: dict[bytes, int]
    cache: dict[bytes, bytes] = field(init=False, repr=False, default_factory=dict)

    def __post_init__(self):
        self.merger = Merger(self.ranks)
        self.pieces = dict(zip(self.ranks.values(), self.ranks.keys(), strict=True))

    def __reduce__(self):
        return Bpe, (self.ranks,)

    def _packed(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of different pre-tokens."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        packed = list(map(self.cache.get, pieces))
        missing = [i for i, x in enumerate(packed) if x is None]
        if missing:
            new = [pieces[i] for i in missing]
            for i, x in zip(missing, self.merger.merge(new), strict=True):
                packed[i] = x
            self.cache.update((pieces[i], packed[i]) for i in missing)
        return packed

    def encode(self, column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """For texts without nulls: ids of each pre-token (packed), the pre-tokens' byte ends, and the n + 1 offsets of the texts' pre-tokens."""
        pieces, which, ends, of_text = different_pieces(column)
        return list(map(self._packed(pieces).__getitem__, which.tolist())), ends, of_text

    def ids(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """For texts without nulls: their ids end to end, each text's followed by the end id, and the n + 1 offsets of the texts among them."""
        pieces, which, _, of_text = different_pieces(column)
        return laid_out(self._packed(pieces), which, of_text, end_id)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load_ranks(path: str) -> Bpe:
    """A vocabulary file of lines "base64 rank", read on the driver; its size is the tokeniser's."""
    with open(path, "rb") as lines:
        return Bpe({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


def encode_documents(documents: DataFrame, bpe: Bpe) -> DataFrame:
    """Encode each whole text and decode it again.

    Takes ``doc_id long, text string`` (null text: empty; other columns are not
    looked at). Returns a row for each row: doc_id, n_tokens, ids (binary,
    little-endian unsigned 32-bit), ends (binary, little-endian 32-bit: where
    in the text's bytes each id's bytes end), decoded (binary).
    """
    shared = documents.sparkSession.sparkContext.broadcast(bpe)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        size = np.zeros(max(own.pieces, default=0) + 1, np.int64)
        size[list(own.pieces)] = [len(x) for x in own.pieces.values()]
        for batch in chunks(batches, "text"):
            packed, _, of_text = own.encode(batch.column("text"))
            ids = [b"".join(packed[a:b]) for a, b in zip(of_text[:-1].tolist(), of_text[1:].tolist(), strict=True)]
            ends = [np.cumsum(size[np.frombuffer(x, "<u4")]).astype("<i4").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                                              pa.array(ends, pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())], schema=schema)
    return (documents.select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(run, "doc_id long, n_tokens long, ids binary, ends binary, decoded binary"))
