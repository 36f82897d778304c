"""Language identification with interpolated Kneser-Ney character models.

Method: one character model of order ``ORDER`` per language, smoothed by
interpolated Kneser-Ney and stored as arrays sorted by n-gram; the language
with the lowest length-normalised cross-entropy wins. A rejection limit is
calibrated on the training texts.

Counting and smoothing run in Spark over every training text and every n-gram:
each task counts the n-grams of its texts per language, the counts are added up
by n-gram, lower orders count different left extensions, and discounts, context
totals and interpolated probabilities come from grouping and equi-joins. No
n-gram is left out, so the model grows with what the training texts hold: its
arrays (16 bytes for an n-gram of a language, and as much for a context) pass
the driver and are broadcast. Scoring finds the different n-grams of a chunk of
text once, and each language's probabilities for those.

An n-gram is a 64-bit number of up to four 16-bit characters. Letters are
lower-cased; everything else is one boundary character, and contexts do not
reach across it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .common import chunks

ORDER = 4
#: N-grams of a language that a counting task holds.
HELD = 1_000_000
#: Bits of the direct index into the sorted n-grams.
INDEX_BITS = 20
UNKNOWN = "und"
#: Share of training texts that the calibrated limit may reject.
REJECT_SHARE = 0.0005
#: Letters a text's cross-entropy is judged by as if it had as many more at the average.
PRIOR_LETTERS = 20

_TABLES: tuple[np.ndarray, np.ndarray] | None = None
_SHIFTS = [np.uint64(16 * k) for k in range(ORDER)]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the 16-bit number of a letter's or mark's lower case (0 for all else), and whether it is a letter."""
    global _TABLES
    if _TABLES is None:
        code, letter = np.zeros(0x110000, np.uint16), np.zeros(0x110000, bool)
        for cp in range(0x33480):
            ch = chr(cp)
            kind = unicodedata.category(ch)[0]
            if kind in "LM":
                code[cp] = (ord(ch.lower()[0]) % 65521) or 1
                letter[cp] = kind == "L"
        _TABLES = code, letter
    return _TABLES


def _letter_codes() -> np.ndarray:
    return _tables()[0]


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and n-gram of each character that is scored, and the letters of each row.

    Scored are letters and the boundary that ends a word. The last character of
    an n-gram stands in its lowest 16 bits, the oldest in its highest.
    """
    texts = column.to_pylist()
    row_of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    c = _letter_codes()[points]
    letters = np.bincount(row_of[_tables()[1][points]], minlength=len(texts))
    before = np.zeros(len(c), np.uint16)
    before[1:] = c[:-1]
    at = np.flatnonzero((c > 0) | (before > 0))
    key, context = c[at].astype(np.uint64), before
    for k in range(1, ORDER):
        key |= context[at].astype(np.uint64) << _SHIFTS[k]
        if k < ORDER - 1:
            older = np.zeros(len(c), np.uint16)
            older[1 + k:] = c[:-1 - k]
            older[context == 0] = 0
            context = older
    return row_of[at], key, letters


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted list of n-grams and counts from several."""
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[cut], np.add.reduceat(n, cut) if len(cut) else n


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def rows(lang, keys, n):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)],
                                          ["lang", "gram", "n"])

    for batch in chunks(batches, "text"):
        langs, of_row = np.unique(np.array(batch.column("lang").to_pylist(), str), return_inverse=True)
        row, key, _ = _grams(batch.column("text"))
        for i, lang in enumerate(langs.tolist()):
            parts = held.setdefault(lang, [])
            parts.append(np.unique(key[(of_row == i)[row]], return_counts=True))
            if sum(len(k) for k, _ in parts) > HELD:
                parts[:] = [_added(parts)]
                if len(parts[0][0]) > HELD // 2:        # a task holds no more than this; Spark adds the parts up
                    yield rows(lang, *held.pop(lang)[0])
    for lang, parts in held.items():
        yield rows(lang, *_added(parts))


class Sorted:
    """Sorted keys with a direct index by hash, which spares most binary searches."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.index = np.zeros(1 << INDEX_BITS, np.int32)
        self.index[self._slot(keys)] = np.arange(len(keys))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - INDEX_BITS)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key, and whether it is there."""
        at = self.index[self._slot(keys)]
        seen = self.keys[at] == keys
        left = np.flatnonzero(~seen)
        if len(left):
            at[left] = np.minimum(np.searchsorted(self.keys, keys[left]), len(self.keys) - 1)
            seen[left] = self.keys[at[left]] == keys[left]
        return at, seen


def _find(among: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted array, and whether it is there."""
    if not len(among):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return at, among[at] == keys


@dataclass
class LanguageModel:
    """Natural-log probabilities of n-grams, by language.

    Of language i, grams[i][k] are its sorted n-grams of order k + 1,
    logs[i][k] their smoothed log-probabilities, contexts[i][k] the sorted
    contexts of that order and gamma[i][k] the log weights they hand down.
    chars are the sorted characters of all languages.
    """

    langs: list[str]
    grams: list[list[np.ndarray]]
    logs: list[list[np.ndarray]]
    contexts: list[list[np.ndarray]]
    gamma: list[list[np.ndarray]]
    chars: np.ndarray
    limit: np.ndarray
    typical: np.ndarray

    def __post_init__(self):
        self.known = Sorted(np.unique(np.concatenate([g[-1] for g in self.grams])))

    def __reduce__(self):
        return LanguageModel, (self.langs, self.grams, self.logs, self.contexts, self.gamma, self.chars, self.limit, self.typical)

    def distinct(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different ones among n-grams, and the place there of each."""
        at, seen = self.known.find(key)
        used = np.zeros(len(self.known.keys), bool)
        used[at[seen]] = True
        new, of_new = np.unique(key[~seen], return_inverse=True)
        place = np.empty(len(key), np.int64)
        place[seen] = (np.cumsum(used) - 1)[at[seen]]
        place[~seen] = used.sum() + of_new
        return np.concatenate([self.known.keys[used], new]), place

    def log_prob(self, i: int, key: np.ndarray) -> np.ndarray:
        """Log-probability in language i of the last character of each n-gram after the others."""
        out, left = np.zeros(len(key)), np.arange(len(key))
        for k in range(ORDER - 1, -1, -1):
            part = key[left] & np.uint64((1 << (16 * (k + 1))) - 1)
            at, seen = _find(self.grams[i][k], part)
            out[left[seen]] += self.logs[i][k][at[seen]]
            left, part = left[~seen], part[~seen]
            if k:
                at, seen = _find(self.contexts[i][k], part >> np.uint64(16))
                out[left[seen]] += self.gamma[i][k][at[seen]]
        # Left are characters of other languages, and those that no training text holds.
        out[left] += np.where(_find(self.chars, part)[1], self.gamma[i][0][0] - np.log(len(self.chars) + 1), -np.log(1 << 16))
        return out


def _smooth(counts: DataFrame, n_lang: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Interpolated Kneser-Ney over the counts of the highest order (``l int, gram long, n long``).

    Returns for each order ``l, gram, log`` and ``l, context, gamma``. Lower
    orders count different left extensions; an order of a language without
    n-grams that occur once, or twice, is discounted by one half.
    """
    levels = [counts]
    for k in range(ORDER - 2, -1, -1):
        low = F.col("gram").bitwiseAND(F.lit((1 << (16 * (k + 1))) - 1))
        levels.insert(0, pin(levels[0].groupBy("l", low.alias("gram")).agg(F.count(F.lit(1)).alias("n"))))
    uniform = F.lit(1.0 / (levels[0].select("gram").distinct().count() + 1))          # order 0, over characters
    logs, gamma, below = [], [], None
    for k, level in enumerate(levels):
        cuts = [0.5] * n_lang
        for i, once, twice in level.groupBy("l").agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).collect():
            if once and twice:
                cuts[i] = once / (once + 2 * twice)
        cut = F.element_at(F.array(*map(F.lit, cuts)), F.col("l") + 1)
        level = level.withColumn("context", F.shiftrightunsigned("gram", 16))
        contexts = pin(level.groupBy("l", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
                       .withColumn("hand", cut * F.col("kinds") / F.col("total")))
        rows = level.join(contexts, ["l", "context"])
        if below is None:
            rows = rows.withColumn("below", uniform)
        else:
            rows = rows.withColumn("low", F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1))).join(
                below.select("l", F.col("gram").alias("low"), F.col("p").alias("below")), ["l", "low"])
        own = F.greatest(F.col("n") - cut, F.lit(0.0)) / F.col("total")
        below = pin(rows.select("l", "gram", (own + F.col("hand") * F.col("below")).alias("p")))
        logs.append(below.select("l", "gram", F.log("p").alias("log")))
        gamma.append(contexts.select("l", "context", F.log("hand").alias("gamma")))
    return logs, gamma


def _arrays(rows: DataFrame, n_lang: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and their values, of each language."""
    l, key, value = (c.to_numpy() for c in rows.toArrow().columns)
    key = key.view(np.uint64)
    order = np.lexsort((key, l))
    cuts = np.searchsorted(l[order], np.arange(1, n_lang))
    return list(zip(np.split(key[order], cuts), np.split(value[order], cuts), strict=True))


def train(documents: DataFrame) -> LanguageModel | None:
    """A model from the rows that have a text and a language; None if there are none with a letter.

    Rows that repeat count as often as they stand; columns other than text and
    lang are not looked at. The rejection limit of a language is the
    cross-entropy (drawn towards the language's average for short texts) that
    all but REJECT_SHARE of its training texts stay below, plus a tenth.
    """
    rows = documents.select("text", F.col("lang").cast("string")).where("text is not null and lang is not null")
    counts = pin(rows.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    number = F.element_at(F.create_map(*[F.lit(x) for pair in zip(langs, range(len(langs)), strict=True) for x in pair]), F.col("lang"))
    logs, gamma = _smooth(counts.select(number.alias("l"), "gram", "n"), len(langs))
    by_gram, by_context = ([_arrays(x, len(langs)) for x in frames] for frames in (logs, gamma))
    grams, logs = ([[order[i][j] for order in by_gram] for i in range(len(langs))] for j in (0, 1))
    contexts, gamma = ([[order[i][j] for order in by_context] for i in range(len(langs))] for j in (0, 1))
    chars = np.unique(np.concatenate([g[0] for g in grams]))
    model = LanguageModel(langs, grams, logs, contexts, gamma, chars, np.full(len(langs), np.inf), np.zeros(len(langs)))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    scored = pin(_scored(rows.withColumn("row", F.lit(0).cast("long")), shared, ["lang"]))
    own = scored.where(F.col("lang") == F.col("lang_pred"))
    average = {r[0]: r[1] for r in own.groupBy("lang").agg(F.sum(F.col("entropy") * F.col("letters")) / F.sum("letters")).collect()}
    model.typical = np.array([average.get(x, 0.0) for x in langs])
    drawn = _drawn(F.col("entropy"), F.col("letters"), model, F.col("lang"))
    limits = {r[0]: r[1] for r in own.groupBy("lang").agg(F.percentile_approx(drawn, 1 - REJECT_SHARE, 10000)).collect()}
    model.limit = np.array([1.1 * limits.get(x, np.inf) for x in langs])
    return model


def _drawn(entropy: Column, letters: Column, model: LanguageModel, lang: Column) -> Column:
    """Cross-entropy with PRIOR_LETTERS letters of the language's average added."""
    typical = _by_lang(model, model.typical, lang)
    return (entropy * letters + typical * F.lit(PRIOR_LETTERS)) / (letters + F.lit(PRIOR_LETTERS))


def _by_lang(model: LanguageModel, values: np.ndarray, lang: Column) -> Column:
    pairs = [x for k, v in zip(model.langs, values, strict=True) for x in (F.lit(k), F.lit(float(v)))]
    return F.element_at(F.create_map(*pairs), lang)


def _scored(documents: DataFrame, shared, extra: list[str]) -> DataFrame:
    """row, extra columns, lang_pred, entropy (nats per character), score, letters."""
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}
    schema = ", ".join(["row long", *(f"{c} {kinds[c]}" for c in extra), "lang_pred string, entropy double, score double, letters long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = np.array([*model.langs, UNKNOWN], object)
        for batch in chunks(batches, "text"):
            row, key, letters = _grams(batch.column("text"))
            n = np.bincount(row, minlength=batch.num_rows)
            sums, some = np.zeros((batch.num_rows, len(model.langs))), n > 0
            if some.any():
                different, place = model.distinct(key)
                for i in range(len(model.langs)):
                    sums[some, i] = np.add.reduceat(model.log_prob(i, different)[place], (np.cumsum(n) - n)[some])
            mean = sums / np.maximum(n, 1)[:, None]
            best = mean.argmax(axis=1)
            top = mean[np.arange(len(best)), best]
            share = 1 / np.exp((mean - top[:, None]) * np.sqrt(n)[:, None] * 2).sum(axis=1)
            best[letters == 0] = len(model.langs)
            share[letters == 0] = 0.0
            entropy = pa.array(np.where(letters > 0, -top, 0.0), mask=letters == 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *(batch.column(c) for c in extra), pa.array(langs[best], pa.string()), entropy,
                 pa.array(share), pa.array(letters.astype(np.int64))],
                ["row", *extra, "lang_pred", "entropy", "score", "letters"])
    return documents.select("row", *extra, "text").mapInArrow(run, schema)


def identify(documents: DataFrame, model: LanguageModel | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Language of each whole text.

    Takes ``doc_id long, text string``; nothing else is looked at. Returns a
    row for each row: doc_id, the columns named in ``keep`` as they were, lang_pred, score (0 to 1), entropy (nats per
    character, null without letters), rejected. ``und`` with score 0, rejected,
    where the text is null or has no letter, and everywhere without a model.
    Texts whose cross-entropy lies above their language's limit are rejected
    but keep their ``lang_pred``. Equal scores: the language first by name.
    A null doc_id is returned as it is, and rows that repeat come back each.
    """
    own = [f"__keep_{c}" for c in keep]
    back = [F.col(k).alias(c) for k, c in zip(own, keep, strict=True)]
    rows = documents.select(F.col("doc_id").cast("long").alias("row"), "text", *[F.col(c).alias(k) for k, c in zip(own, keep, strict=True)])
    if model is None:
        return rows.select(F.col("row").alias("doc_id"), *back, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    high = _drawn(F.col("entropy"), F.col("letters"), model, F.col("lang_pred")) > _by_lang(model, model.limit, F.col("lang_pred"))
    return _scored(rows, shared, own).select(
        F.col("row").alias("doc_id"), *back, "lang_pred", "score", "entropy",
        F.when(F.col("lang_pred") == UNKNOWN, True).otherwise(F.coalesce(high, F.lit(False))).alias("rejected"))

