"""Registered queries of the training-text operators: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_root
from . import bpe, embedding_dedup, importance, language_id, line_dedup, merkle, packing, simhash_dedup, token_files, topk, toxicity, whitening
from .common import held_out, table
from .substring_dedup import substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))     # the vocabulary of byte_bpe_50k.json
    return packing.pack(table(spark, sf_dir, "documents"), ranks).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: labelled good training texts. Drawn: the share of all documents that is good among the labelled ones."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = docs.select("doc_id", "text").where(~held_out(F.col("doc_id"))).join(labels.select("doc_id", "quality").hint("shuffle_hash"), "doc_id")
    share = known.agg(F.avg(F.when(F.col("quality").isin(0, 1), F.col("quality")))).first()[0]
    return importance.resample(docs, known.where("quality = 1"), share or 0.0).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "log_weight", "key", "selected")


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_dedup(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out(F.col("doc_id"))))
    return language_id.identify(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = docs.select("doc_id", "text").where(~held_out(F.col("doc_id"))).join(labels.select("doc_id", "toxic").hint("shuffle_hash"), "doc_id")       # one plan at every size
    return toxicity.score(docs, toxicity.train(known)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "line_dedup.n_lines", F.size("line_dedup.removed").alias("n_removed"), "line_dedup.removed")


@query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.checksums(token_files.read_tokens(spark, folder))


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's proof, and the root that it gives once the text of every third id has its A-Z lower-cased."""
    docs = table(spark, sf_dir, "documents")
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0,
                      merkle.leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), low))
    proofs = merkle.manifest(docs, tampered).proofs
    folded = proofs.withColumn("folded_root", merkle.fold(F.coalesce("also", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


SQL["op3_substring_dedup"] = r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
  s as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50),
  k as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as t from s),
  f as (select t, min(doc_id) as first from k group by 1),
  g as (select doc_id, list(distinct p) as gone from (
    select k.doc_id, unnest(range(k.i, k.i + 50)) as p from k join f using (t) where f.first < k.doc_id) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
  sha256(array_to_string(case when gone is null then w else list_filter(w, lambda x, i: not list_contains(gone, i)) end, ' ')) as kept_sha256
from d left join g using (doc_id)"""

SQL["op5_embedding_dedup"] = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where vec_id is not null and label is not null
    and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
  l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_cosine_similarity(a.e, b.e) >= 0.93),
  r(vec_id, reach) as (select vec_id, vec_id from embeddings union select r.vec_id, l.b from r join l on r.reach = l.a),
  c as (select vec_id, min(reach) as component_id from r group by 1), n as (select a as vec_id, count(*) as n_links from l group by 1)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings left join c using (vec_id) left join n using (vec_id)"""

SQL["op8_exact_topk"] = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  p as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
    from v q join v c on c.vec_id <> q.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0)
select query_id, rank, vec_id, score from (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from p) where rank <= 5"""


# crc32 is not in DuckDB: computed bit by bit over the digits of doc_id.
SQL["op13_merkle_manifest"] = """
with recursive
  crc(doc_id, rest, c) as (
    select doc_id, cast(doc_id as varchar), cast(4294967295 as bigint) from (select distinct doc_id from documents where doc_id is not null)
    union all
    select doc_id, rest[2:], list_reduce(list_prepend(xor(c, ascii(rest[1])), range(8)),
      lambda x, i: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end))
    from crc where rest <> ''),
  hit as (select doc_id from crc where rest = '' and xor(c, 4294967295) % 3 = 0),
  low as (select *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents),
  told as (select doc_id, lang, text, low,
    coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as head from low),
  hashed as (select doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    sha256(head || coalesce(strlen(low) || ':' || low, '-')) as lowered from told),
  leaf as (select h.*, case when hit.doc_id is null then leaf else lowered end as shown,
    row_number() over (partition by lang order by h.doc_id nulls first, leaf) - 1 as rank, count(*) over (partition by lang) as n
    from hashed h left join hit on h.doc_id = hit.doc_id),
  node(lang, level, rank, n, h) as (
    select lang, 0, rank, n, leaf from leaf
    union all
    select lang, level + 1, rank // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' order by rank)) from node where n > 1 group by lang, level, rank // 8),
  sub as (select lang, level as depth, h as subroot, row_number() over (order by lang nulls first) - 1 as rank, count(*) over () as n from node where n = 1),
  above(level, rank, n, h) as (
    select 0, rank, n, subroot from sub
    union all
    select level + 1, rank // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' order by rank)) from above where n > 1 group by level, rank // 8),
  run as (select lang, level, rank // 8 as up, list(h order by rank) as hs from node where n > 1 group by lang, level, rank // 8),
  run_above as (select level, rank // 8 as up, list(h order by rank) as hs from above where n > 1 group by level, rank // 8),
  walk(lang, doc_id, leaf, level, rank, h, proof) as (
    select lang, doc_id, leaf, 0, rank, shown, '' from leaf
    union all
    select w.lang, w.doc_id, w.leaf, w.level + 1, w.rank // 8,
      sha256(array_to_string(list_concat(hs[:w.rank % 8], [w.h], hs[w.rank % 8 + 2:]), '')),
      w.proof || array_to_string(list_concat(hs[:w.rank % 8], hs[w.rank % 8 + 2:]), '')
    from walk w join run r on r.lang is not distinct from w.lang and r.level = w.level and r.up = w.rank // 8),
  on_top(lang, doc_id, leaf, subroot, level, rank, h, proof) as (
    select w.lang, w.doc_id, w.leaf, s.subroot, 0, s.rank, w.h, w.proof
    from walk w join sub s on s.lang is not distinct from w.lang and s.depth = w.level
    union all
    select w.lang, w.doc_id, w.leaf, w.subroot, w.level + 1, w.rank // 8,
      sha256(array_to_string(list_concat(hs[:w.rank % 8], [w.h], hs[w.rank % 8 + 2:]), '')),
      w.proof || array_to_string(list_concat(hs[:w.rank % 8], hs[w.rank % 8 + 2:]), '')
    from on_top w join run_above r on r.level = w.level and r.up = w.rank // 8),
  last as (select h as root, level from above where n = 1)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, h as folded_root, h = root as verified
from on_top join last using (level)"""
