"""The hash trees and proofs against a brute-force version."""

import hashlib
import re
import zlib
from itertools import groupby

from llm_cases import awkward, documents, prose
from pyspark.sql import functions as F

from loanwatch.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(doc_id, source, lang, n_chars, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """The root, and for each node the (before, after) hashes of its runs up to the root."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i:i + 8] for i in range(0, len(level), 8)]
        for k, i in enumerate(at):
            run = runs[i // 8]
            paths[k].append(("".join(run[:i % 8]), "".join(run[i % 8 + 1:])))
            at[k] = i // 8
        level = [digest(*run) for run in runs]
    return (level[0] if level else None), paths


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted (doc_id, leaf, subroot, root, siblings, folded from a changed leaf)."""
    def key(r):
        return (r[2] is not None, (r[2] or "").encode())
    made = []
    for _, group in groupby(sorted(rows, key=key), key):
        group = sorted(group, key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(*r)))
        made.append((group, *tree([brute_leaf(*r) for r in group])))
    root, above = tree([subroot for _, subroot, _ in made])
    out = []
    for (group, subroot, paths), top in zip(made, above, strict=True):
        for r, path in zip(group, paths, strict=True):
            h = changed(r)
            for before, after in path + top:
                h = digest(before, h, after)
            out.append((r[0], brute_leaf(*r), subroot, root, "".join(a + b for a, b in path + top), h))
    return sorted(out, key=str)


def changed(r):
    if r[0] is None or zlib.crc32(str(r[0]).encode()) % 3 or r[4] is None:
        return brute_leaf(*r)
    return brute_leaf(*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))


def found(frame):
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    also = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0,
                  merkle.leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), low))
    proofs = merkle.manifest(frame, also).proofs.select(
        "doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("path")).alias("s"),
        merkle.fold(F.coalesce("also", "leaf"), F.col("path")).alias("f"))
    return sorted(map(tuple, proofs.collect()), key=str)


def frame_of(spark, rows):
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").select(
        *names, F.lit(1).alias("rank"), F.lit("x").alias("path"), F.lit(2).alias("pos"), F.lit("y").alias("h"))


def test_awkward_rows_equal_brute_force(spark):
    rows = [(i, None, "en", None if t is None else len(t), t) for i, t in awkward()]
    assert found(documents(spark, awkward())) == brute(rows)


def test_blocks_tiers_and_languages_equal_brute_force(spark):
    """A language of 1,300 rows (three blocks), languages of 1, 8, 9, 64, 65, 512 and 513 rows, a null and an empty one."""
    sizes = {"hot": 1300, None: 3, "": 1, "b": 1, "c": 8, "d": 9, "é": 64, "f": 65, "g": 512, "h": 513}
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i * 7919 % 100_003, f"s{i % 3}" if i % 5 else None, lang, i if i % 4 else None, f"Text {i}" if i % 6 else None))
    assert found(frame_of(spark, rows)) == brute(rows)


def test_more_languages_than_a_block_holds(spark):
    rows = [(i, "S", f"l{i:04d}", i, f"A{i}") for i in range(600)]
    assert found(frame_of(spark, rows)) == brute(rows)


def test_one_row_and_no_rows(spark):
    rows = [(3, "s", "en", 5, "Hello")]
    assert found(frame_of(spark, rows)) == brute(rows)
    none = merkle.manifest(documents(spark, []))
    assert none.proofs.count() == none.subroots.count() == none.root.count() == 0


def test_a_changed_text_is_found_and_no_other(spark):
    rows = [(i, "s", "en", None, f"Upper {prose(i, 5)}" if i % 2 else prose(i, 5)) for i in range(100)]
    got = found(frame_of(spark, rows))
    false = {r[0] for r in got if r[5] != r[3]}
    assert false == {i for i in range(100) if i % 2 and zlib.crc32(str(i).encode()) % 3 == 0}


def test_proofs_need_neither_joins_nor_python(spark):
    rows = [(i, "s", "en" if i % 3 else "de", i, "t") for i in range(700)]
    made = merkle.manifest(frame_of(spark, rows))
    plan = made.proofs._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and not re.search("Join|Python|Pandas|Arrow", plan)
    assert {(r["lang"], r["n"]) for r in made.subroots.collect()} == {("en", 466), ("de", 234)}
