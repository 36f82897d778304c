"""Merkle manifest of a document table: a hash tree for each language, one over the languages, and a proof for each row.

Method: nested-struct rollup. A row's place in its language (its rank) is read
as octal digits. Inside a block of 8 ** ``LEVELS`` neighbouring ranks the digits
are grouped away one after the other, from the last: each grouping gathers at
most eight children as structs inside their parent's struct, and hashes them.
All groupings of a block run on one shuffle by (tree, block). The blocks'
hashes are the items of the next tier, which is 8 ** ``LEVELS`` times smaller,
until a tree is one block; then the languages' subroots are the items of one more
tree, rolled up the same way.

Proofs come out of the nested structs from the top: each level is exploded, and
every child takes the hashes left and right of it in its run along with the path
of its parent. No level is joined; where a tier hands its paths to the tier
below, a block and its path meet in one grouping of two rows.

No group is larger than a block, whatever share of the rows a language holds.
Ranks come from a sort by range (``with_position``). The driver sees one number
for each tier.

Hashes are SHA-256 in lowercase hex; a node is the hash of its children's hex
digits, laid end to end.

Defined results: null doc_ids stand before all others; rows that repeat a doc_id
are leaves of their own, in order of their hash. A null lang is a language, the
first one. Null values and empty texts have different leaves. A row is proved
against the leaf it had when the manifest was made. An empty table has no root
and no proofs. Columns beside doc_id, source, lang, n_chars and text are not
looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.position import with_position
from ..session import pin

#: Children of a node (one octal digit), and digits that are grouped away in one block.
FAN, LEVELS = 8, 3
_BITS = 3 * LEVELS
_HEX = 64
_PATH = "array<struct<before:string,after:string>>"


def leaf_hash(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The hash of a row: each value as "-" if null, else its UTF-8 byte count, a colon and itself."""
    def told(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*[told(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the hashes beside its path lead to."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["before"], h, step["after"]), 256))


def siblings(path: Column) -> Column:
    """All hashes beside a path, from the leaf's run to the root's, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def _run(children: Column) -> Column:
    return F.array_join(F.transform(children, lambda c: c["h"]), "")


def _deep(level: int) -> Column:
    """Whether a tree of ``n`` items has more than one node left below this level of the tier."""
    return F.col("n") > FAN ** (level - 1)


def _tier(items: DataFrame) -> DataFrame:
    """Blocks of the items ``tree, n (of the tree), rank, h, load``: tree, n, block, h, and the nested children."""
    digits = [F.shiftright("rank", 3 * k).bitwiseAND(F.lit(FAN - 1)).cast("tinyint").alias(f"d{k}") for k in range(LEVELS)]
    rows = items.select("tree", "n", F.shiftright("rank", _BITS).alias("block"), *digits, "h", F.col("load").alias("inner"))
    rows = rows.repartition("tree", "block")
    for level in range(1, LEVELS + 1):
        child = F.struct(F.col(f"d{level - 1}").alias("d"), "h", "inner")
        rows = (rows.groupBy("tree", "n", "block", *[f"d{k}" for k in range(level, LEVELS)])
                .agg(F.sort_array(F.collect_list(child)).alias("inner")))
        rows = rows.withColumn("h", F.when(_deep(level), F.sha2(_run(F.col("inner")), 256)).otherwise(F.get("inner", F.lit(0))["h"]))
    return rows


def _up(items: DataFrame) -> list[DataFrame]:
    """All tiers over the items, the last with one block for each tree."""
    tiers = []
    while True:
        tiers.append(pin(_tier(items)))
        if not tiers[-1].agg(F.max("block")).first()[0]:
            return tiers
        items = tiers[-1].select("tree", F.shiftright(F.col("n") + ((1 << _BITS) - 1), _BITS).alias("n"),
                                 F.col("block").alias("rank"), "h", F.struct("block").alias("load"))


def _down(tiers: list[DataFrame], paths: DataFrame) -> DataFrame:
    """From the top blocks' ``tree, block, path, ends`` to each item's ``tree, load, path, ends``."""
    for k in reversed(range(len(tiers))):
        rows = (tiers[k].select("tree", "block", "n", "inner").unionByName(paths, allowMissingColumns=True)
                .groupBy("tree", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "inner", "path", "ends")]))
        for level in range(LEVELS, 0, -1):
            rows = rows.withColumn("run", _run(F.col("inner"))).select("tree", "n", "path", "ends", "run", F.posexplode("inner").alias("i", "child"))
            before = F.col("run").substr(F.lit(1), _HEX * F.col("i"))
            after = F.col("run").substr(_HEX * (F.col("i") + 1) + 1, F.lit(_HEX * FAN))
            step = F.concat(F.array(F.struct(before.alias("before"), after.alias("after"))), "path")
            rows = rows.select("tree", "n", "ends", F.when(_deep(level), step).otherwise(F.col("path")).alias("path"), F.col("child.inner").alias("inner"))
        paths = rows.select("tree", "path", "ends", F.col("inner").alias("load"))
        if k:
            paths = paths.select("tree", F.col("load.block").alias("block"), "path", "ends")
    return paths


@dataclass
class Manifest:
    """``root``: one row (root); ``subroots``: lang, subroot, n; ``proofs``: doc_id, lang, leaf, also, subroot, root, path."""

    root: DataFrame
    subroots: DataFrame
    proofs: DataFrame


def manifest(documents: DataFrame, also: Column | None = None) -> Manifest:
    """The hash trees of ``doc_id long, source string, lang string, n_chars long, text string``.

    ``proofs`` has a row for each row: ``path`` holds, from the leaf's run up to
    the root, the hashes before and after the node (none for a level of one
    node). ``also`` is a value of the row that is handed through.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    also = F.lit(None).cast("string") if also is None else also
    leaves = pin(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                                  leaf_hash(*columns).alias("leaf"), also.alias("also")))
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("also")]
    ranked = with_position(leaves, order, within=["lang"], name="pos", total="n")
    tiers = _up(ranked.select(F.col("lang").alias("tree"), "n", (F.col("pos") - 1).alias("rank"), F.col("leaf").alias("h"),
                              F.struct("doc_id", "leaf", "also").alias("load")))

    subroots = pin(with_position(tiers[-1].select(F.col("tree").alias("lang"), F.col("h").alias("subroot")),
                                 [F.col("lang").asc_nulls_first()], name="pos"))
    top = _up(subroots.select(F.lit(None).cast("string").alias("tree"), F.lit(subroots.count()).cast("long").alias("n"),
                              (F.col("pos") - 1).alias("rank"), F.col("subroot").alias("h"), F.struct("lang", "subroot").alias("load")))
    none = F.array().cast(_PATH).alias("path")
    paths = _down(top, top[-1].select("tree", "block", none, F.struct(F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root")).alias("ends")))
    paths = paths.select(F.col("load.lang").alias("tree"), F.lit(0).cast("long").alias("block"), "path",
                         F.struct("load.subroot", "ends.root").alias("ends"))
    proofs = _down(tiers, paths).select("load.doc_id", F.col("tree").alias("lang"), "load.leaf", "load.also", "ends.subroot", "ends.root", "path")
    sizes = ranked.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("lang", "of")
    return Manifest(top[-1].select(F.col("h").alias("root")),
                    subroots.join(sizes, F.col("lang").eqNullSafe(F.col("of"))).select("lang", "subroot", "n"), proofs)
