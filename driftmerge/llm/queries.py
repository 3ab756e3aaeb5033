"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmerge.llm import lattice
from driftmerge.llm.chaining import fuzzy_repeats
from driftmerge.llm.decontaminate import decontaminate
from driftmerge.llm.media import media_digest
from driftmerge.llm.near_dedup import near_duplicates
from driftmerge.llm.pieces import decode, encode
from driftmerge.llm.quality import judged
from driftmerge.llm.sharding import sharded
from driftmerge.llm.suffix_dedup import remove_repeats
from driftmerge.llm.toxicity import learn, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_consistent_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sized = docs.select("doc_id", (F.octet_length("text") + 1).cast("bigint").alias("size"), F.crc32("text").alias("text_crc32"))
    return sharded(sized, "doc_id").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(_table(spark, sf_dir, "documents"))


def op5_compression_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = learn(docs.where(~held_out), _table(spark, sf_dir, "labels").where(~held_out))
    return toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    found = lattice.scored(docs, lattice.learn(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_shared_prefix_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they give the text back."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decode(encode(docs))
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "piece_score", "ids", F.coalesce("text", F.lit("")).eqNullSafe(F.col("decoded")).alias("restored"))


def op8_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_signature_inverted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fuzzy_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_repeated", F.size("spans").cast("bigint").alias("n_spans"), "spans")


OP9_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as gram from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), pairs as (
  select a.doc_id as u, b.doc_id as v, count(*) as k from s a join s b using (gram) where a.doc_id < b.doc_id group by all
), links as (
  select u, v from pairs join n a on a.doc_id = u join n b on b.doc_id = v where 100 * k >= 75 * (a.n + b.n - k)
), ends as (
  select u, v from links union all select v, u from links
), reach(doc_id, root) as (
  select doc_id, doc_id from d union select v, root from reach join ends on u = reach.doc_id
)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept
from (select doc_id, min(root) as component_id from reach group by doc_id) left join n using (doc_id)
"""


OP2_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), windows as (
  select distinct item_id, size, array_to_string(w[i : i + size - 1], ' ') as gram
  from (select item_id, w, least(13, len(w)) as size, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)
), places as (
  select doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') as gram
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, (select distinct size from windows))
), hits as (
  select doc_id, item_id, i, size from places join windows using (size, gram)
), hit_words as (
  select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + size)) as k from hits) group by doc_id
), hit_items as (
  select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
  from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit_words using (doc_id) left join hit_items using (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_winnowing_decontamination": op2_winnowing_decontamination,
    "op3_consistent_hash_ring": op3_consistent_hash_ring,
    "op4_lossless_webp": op4_lossless_webp,
    "op5_compression_distance": op5_compression_distance,
    "op6_subword_lattice": op6_subword_lattice,
    "op7_shared_prefix_viterbi": op7_shared_prefix_viterbi,
    "op8_weak_labels": op8_weak_labels,
    "op9_signature_inverted_join": op9_signature_inverted_join,
    "op10_collinear_chaining": op10_collinear_chaining,
}

ORACLE_SQL: dict[str, str] = {
    "op2_winnowing_decontamination": OP2_SQL,
    "op9_signature_inverted_join": OP9_SQL,
}
