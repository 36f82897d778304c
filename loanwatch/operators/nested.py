"""Ranking metrics of many overlapping slices from one sorted pass.

A row of the ranked population counts in the pooled block, in its own value of
each block (single loan, exposure decile, label vintage), and once more in each
of these by its category. Instead of a sort for each, rows are sorted once by
score and tie keys, and each partition is cut into pieces of at most ``PIECE`` rows.
What stood before a piece is added up per (piece, slice); then each piece is
walked once, with a running count for every slice, which gives hits within
each budget and the steps of average precision. Scores that may go on in the
next piece (the first and last of a slice's stretch) are handed on as counts and
settled by score.

No slice is a group of rows: a slice of any size spans pieces, and what is
grouped is one row for each (piece, slice). A Python worker holds one piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.columns import is_severe, ratio
from ..functions.position import sorted_slices
from ..session import pin
from .ranking import TIES, call_order

_SEP, _NONE = "\x1f", "\x00"
#: Most rows of a piece, which is what a Python worker holds at a time.
PIECE = 250_000
#: A piece's number: its partition above this bit, its place in the partition below.
_PIECE_BITS = 31
#: Slice name of a block that has one slice.
ALL = "all"


def _names(blocks: list[str], cell: str) -> list[tuple[str, str]]:
    """(block, slice) of the rows of a cell: block values and category, joined."""
    *values, cat = cell.split(_SEP)
    out = []
    for block, value in zip(blocks, values, strict=True):
        if value != _NONE:
            out += [(block, value), (f"{block}_by_category", cat if value == ALL else f"{value}/{cat}")]
    return out


def _membership(blocks: list[str], cell: Column) -> Column:
    """The same as an array column of struct(block, slice)."""
    parts = F.split(cell, _SEP)
    cat = F.get(parts, F.lit(len(blocks)))
    made = []
    for i, block in enumerate(blocks):
        value = F.get(parts, F.lit(i))
        nested = F.when(value == ALL, cat).otherwise(F.concat(value, F.lit("/"), cat))
        entries = F.array(F.struct(F.lit(block).alias("block"), value.alias("slice")),
                          F.struct(F.lit(f"{block}_by_category").alias("block"), nested.alias("slice")))
        made.append(F.when(value != _NONE, entries).otherwise(F.array().cast("array<struct<block:string,slice:string>>")))
    return F.concat(*made)


def _walk(blocks: list[str], budgets: list[int]):
    """A piece's rows in order, and what stood before them per slice, to partial metrics of each slice."""
    def run(rows: pa.Table, before: pa.Table) -> pa.Table:
        rows = rows.sort_by("__idx")
        score = rows["score"].to_numpy().astype(np.float64)
        score = np.where(np.isnan(score), np.where(rows["missing"].to_numpy(), -np.inf, np.inf), score)
        severe = rows["SEV"].to_numpy().astype(np.int64)
        cells = rows["cell"].combine_chunks().dictionary_encode()
        codes = cells.indices.to_numpy()
        holds: dict[tuple[str, str], list[int]] = {}
        for code, cell in enumerate(cells.dictionary.to_pylist()):
            for name in _names(blocks, cell):
                holds.setdefault(name, []).append(code)
        out = []
        for b in before.to_pylist():
            mine = np.isin(codes, holds.get((b["block"], b["slice"]), []))
            s, hit = score[mine], severe[mine]
            if not len(s):
                continue
            n = b["n_before"] + np.arange(1, len(s) + 1)
            tp = b["sev_before"] + np.cumsum(hit)
            ends = np.append(np.flatnonzero(s[1:] != s[:-1]), len(s) - 1)
            step = np.diff(tp[ends], prepend=b["sev_before"])
            inner = slice(1, len(ends) - 1)
            ap = float((step[inner] * (tp[ends][inner] / n[ends][inner])).sum())
            hits = [int(hit[n <= k].sum()) for k in budgets]
            out.append((b["block"], b["slice"], None, ap, 0, 0, 0, hits))
            for g in sorted({0, len(ends) - 1}):
                out.append((b["block"], b["slice"], float(s[ends[g]]), 0.0, int(step[g]), int(n[ends[g]]), int(tp[ends[g]]), [0] * len(budgets)))
        types = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        columns = list(zip(*out, strict=True)) if out else [[] for _ in types]
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
                        names=["block", "slice", "score", "ap", "tp", "cn", "ctp", "hits"])
    return run


def nested_ranking(df: DataFrame, blocks: dict[str, Column], score: str = "SCORE", label: str = "LABEL", ties=TIES,
                   windows: dict | None = None, exposure: str | None = None, cat: str = "CURRENT_CAT") -> DataFrame:
    """The ranking block of every slice, by (block, slice), and of each slice by category, as ``<block>_by_category``.

    ``blocks`` maps a block's name to the row's slice in it (``ALL`` for a block of one
    slice, NULL for rows outside). Rows of equal score stand in the order of ``ties``;
    rows without a score are one tie at the end. With ``exposure`` its least and
    greatest value in each slice are added. Slices without a severe row get
    the counts only; slices without rows are not there.
    """
    windows = C.REF_WINDOWS if windows is None else windows
    names, budgets = list(blocks), [int(C.CALLS_PER_HOUR * h) for h in windows.values()]
    values = [F.coalesce(v.cast("string"), F.lit(_NONE)) for v in blocks.values()]
    cell = F.concat_ws(_SEP, *values, F.coalesce(F.col(cat).cast("string"), F.lit("")))
    amount = F.col(exposure) if exposure else F.lit(None)
    s = F.col(score).cast("double")
    narrow = df.select(s.alias("score"), s.isNull().alias("missing"), *[F.col(t).alias(f"__t{i}") for i, t in enumerate(ties)],
                       is_severe(F.col(label)).cast("int").alias("SEV"), cell.alias("cell"), amount.cast("double").alias("amount"))
    rows = sorted_slices(narrow, call_order("score", [f"__t{i}" for i in range(len(ties))]))
    rows = rows.withColumn("__part", F.shiftleft("__part", _PIECE_BITS) + F.floor(F.col("__idx") / PIECE))

    counts = rows.groupBy("__part", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("SEV").alias("sev"),
                                                F.min("amount").alias("lo"), F.max("amount").alias("hi"))
    per = pin(counts.select("__part", "n", "sev", "lo", "hi", F.inline(_membership(names, F.col("cell"))))
              .groupBy("__part", "block", "slice").agg(F.sum("n").alias("n"), F.sum("sev").alias("sev"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    past = Window.partitionBy("block", "slice").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)      # one row a piece
    before = per.select("__part", "block", "slice", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("n_before"),
                        F.coalesce(F.sum("sev").over(past), F.lit(0)).alias("sev_before"))
    walked = pin(rows.select("__part", "__idx", "score", "missing", "SEV", "cell").groupBy("__part").cogroup(before.groupBy("__part")).applyInArrow(
        _walk(names, budgets), "block string, slice string, score double, ap double, tp long, cn long, ctp long, hits array<long>"))

    key = ["block", "slice"]
    split = walked.where("score is not null").groupBy(*key, "score").agg(F.sum("tp").alias("tp"), F.max("cn").alias("cn"), F.max("ctp").alias("ctp"))
    sums = walked.select(*key, "ap", *[F.get("hits", F.lit(i)).alias(f"h{i}") for i in range(len(budgets))]).unionByName(
        split.select(*key, (F.col("tp") * (F.col("ctp") / F.col("cn"))).alias("ap")), allowMissingColumns=True).unionByName(
        per.select(*key, "n", "sev", "lo", "hi"), allowMissingColumns=True)
    total = sums.groupBy(*key).agg(F.sum("n").alias("n_ranked"), F.sum("sev").alias("n_severe"), F.sum("ap").alias("ap"),
                                   F.min("lo").alias("exposure_min"), F.max("hi").alias("exposure_max"),
                                   *[F.sum(f"h{i}").alias(f"h{i}") for i in range(len(budgets))])
    some, base = F.col("n_severe") > 0, ratio(F.col("n_severe"), F.col("n_ranked"))
    out = [*key, "n_ranked", "n_severe", base.alias("base_rate"), F.when(some, ratio(F.col("ap"), F.col("n_severe"))).alias("pr_auc")]
    for i, (w, budget) in enumerate(zip(windows, budgets, strict=True)):
        k, hit = F.least(F.lit(budget).cast("bigint"), F.col("n_ranked")), F.col(f"h{i}")
        out += [F.when(some, k).alias(f"k_{w}"), F.when(some, ratio(hit, F.col("n_severe"))).alias(f"recall_{w}"),
                F.when(some, ratio(hit, k)).alias(f"precision_{w}"), F.when(some, ratio(hit, k) / base).alias(f"lift_{w}")]
    return total.select(*out, *["exposure_min", "exposure_max"] if exposure else [])
