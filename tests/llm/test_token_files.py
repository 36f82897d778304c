"""Token files against the tokenizers library, and what a partial read touches."""

import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from llm_cases import awkward, documents, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loanwatch.llm import token_files

JSON = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(texts):
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def write(spark, rows, folder, **how):
    token_files.write_tokens(documents(spark, rows), str(folder), JSON, **how)
    return str(folder)


def order(row):
    return (row[0] is not None, row[0] or 0)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_ids_starts_and_checksums_equal_the_library(spark, tmp_path, encoding):
    rows = awkward() + [(50, "<|endoftext|> is plain text"), (51, "it'll we've 'sx  \n\n a b 　"), (52, "ÀÉ́ नमस्ते 👩‍👩‍👧")]
    folder = write(spark, rows, tmp_path / "t", encoding=encoding)
    got = token_files.read_tokens(spark, folder).collect()
    assert sorted(((r["doc_id"], list(r["ids"])) for r in got), key=str) == sorted(zip([i for i, _ in rows], library_ids([t for _, t in rows]), strict=True), key=str)
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert (r["start"], r["n_tokens"]) == (start, len(r["ids"]))
        start += r["n_tokens"]
    in_order = sorted(got, key=lambda r: r["start"])
    assert [order(r) for r in in_order] == sorted(order(r) for r in got)
    sums = token_files.checksums(token_files.read_tokens(spark, folder)).collect()
    assert {(r["start"], r["n_tokens"], r["ids_crc32"]) for r in sums} == {
        (r["start"], r["n_tokens"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in got}


def test_files_have_the_encodings_row_groups_and_page_indexes(spark, tmp_path):
    rows = [(i, prose(i, 60)) for i in range(1500)]
    for encoding, want in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        folder = write(spark, rows, tmp_path / encoding, encoding=encoding, files=1, row_group_bytes=100_000, page_rows=100)
        meta = pq.ParquetFile(glob.glob(f"{folder}/tokens/*.parquet")[0]).metadata
        assert meta.num_row_groups > 2
        for g in range(meta.num_row_groups):
            columns = {c.path_in_schema: c for c in (meta.row_group(g).column(k) for k in range(meta.num_columns))}
            assert want in columns["ids.list.element"].encodings
            assert all("DELTA_BINARY_PACKED" in c.encodings for name, c in columns.items() if name != "ids.list.element")
            assert all(c.has_column_index and c.has_offset_index for c in columns.values())
        lows = [meta.row_group(g).column(1).statistics.min for g in range(meta.num_row_groups)]
        assert lows == sorted(lows) and lows[0] == 0


def test_partial_reads_push_the_range_and_leave_the_ids(spark, tmp_path):
    rows = [(i, prose(i, 30)) for i in range(400)]
    folder = write(spark, rows, tmp_path / "t", files=4)
    whole = {r["doc_id"]: r for r in token_files.read_tokens(spark, folder).collect()}
    some = token_files.read_tokens(spark, folder, F.col("doc_id").between(100, 120), ids=False)
    assert {r["doc_id"]: (r["start"], r["n_tokens"]) for r in some.collect()} == {i: (whole[i]["start"], whole[i]["n_tokens"]) for i in range(100, 121)}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,100)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert len(glob.glob(f"{folder}/tokens/*.parquet")) == 4


def test_one_doc_id_with_most_rows_spans_files(spark, tmp_path):
    rows = [(7, "the same text")] * 300 + [(i, prose(i, 5)) for i in range(50)]
    folder = write(spark, rows, tmp_path / "t", files=4)
    sizes = [r["n_rows"] for r in spark.read.parquet(f"{folder}/shards").collect()]
    assert len(sizes) == 4 and max(sizes) < 200
    starts = sorted((r["start"], r["n_tokens"]) for r in token_files.read_tokens(spark, folder).collect())
    assert [s for s, _ in starts] == np.cumsum([0, *[n for _, n in starts[:-1]]]).tolist()


def test_no_rows_and_unknown_encoding(spark, tmp_path):
    folder = write(spark, [], tmp_path / "t")
    assert token_files.read_tokens(spark, folder).count() == 0
    assert token_files.checksums(token_files.read_tokens(spark, folder)).count() == 0
    with pytest.raises(ValueError):
        write(spark, [], tmp_path / "u", encoding="plain")


def test_pieces_encode_as_whole_texts_do(spark):
    texts = [t or "" for _, t in awkward()] + [" ".join(prose(k, 50).split()).title() + "\t\t 12,5%\r\n" for k in range(20)]
    packed, of_text = token_files.Library(JSON).encode(pa.array(texts))
    got = [np.frombuffer(b"".join(packed[a:b]), "<i4").tolist() + [0] for a, b in zip(of_text[:-1], of_text[1:], strict=True)]
    assert got == library_ids(texts)


def test_words_of_any_letters_reach_the_library_in_one_text(monkeypatch):
    """A text of one word costs the library many times what the word costs in a longer text; equal words cost nothing."""
    words = [f"{a}é{b}ž" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    texts = [" ".join(words[i:] + words[:i]) + f" {i} 's  \n" for i in range(20)] + ["", "\u00a0\u2003 x \x1c y"]
    library, handed = token_files.Library(JSON), []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, batch, **how):
            handed.extend(batch)
            return self.inner.encode_batch_fast(batch, **how)
    monkeypatch.setattr(library, "tokenizer", Counted(library.tokenizer))
    ids, offsets = library.ids(pa.array(texts), 0)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == library_ids(texts)
    assert len(handed) < 30 and sum(map(len, handed)) < 2 * sum(len(x) + 1 for x in words)
