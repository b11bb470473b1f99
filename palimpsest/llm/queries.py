"""One query per operator over the whole ``documents`` table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, kd_shards, lattice_lm, lexical, license_scan, mixing, quality, simhash, spelling, suffix_dedup, token_output, toxicity, winnowing
from .common import crc_remainder, documents

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
END_ID = 2


def vocabulary_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, toxicity.training_labels(labels))
    rows = toxicity.score_documents(docs, model)
    return rows.select("doc_id", (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(documents(spark, sf_dir), 100, keep_bytes=False)
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(documents(spark, sf_dir), shingle=3, distance=3)
    return rows.select("doc_id", simhash.hex_mark(F.col("mark")).alias("fingerprint"), "component_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)
    return rows.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = mixing.apply_mix(docs, mixing.plan_mix(docs), keep=False)
    return rows.select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = lattice_lm.sentencepiece_vocabulary(vocabulary_path(PIECES))
    rows = lattice_lm.score_documents(documents(spark, sf_dir), lattice_lm.learned_from(), pieces)
    return rows.select("doc_id", (crc_remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.tokens_to_parquet(documents(spark, sf_dir), vocabulary_path(), END_ID).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kd_shards.shard_documents(documents(spark, sf_dir), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_scan.scan_licenses(documents(spark, sf_dir))
    starts = F.col("base_starts")
    best = F.greatest(F.when(F.size(starts) > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max("found.share"), F.lit(0.0)))
    return rows.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), F.least(F.lit(1.0), best).alias("score"),
    )


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnowing.compare_edited(documents(spark, sf_dir))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), winnowing.digest(F.col("marks")).alias("fingerprint"), winnowing.digest(F.col("edited_marks")).alias("edited_fingerprint"), "near_edited", "near_next")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(documents(spark, sf_dir), least_length=7, least_count=2, ratio=10, edits=31)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(documents(spark, sf_dir))
    return lexical.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10).withColumnRenamed("query_id", "item_id")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.score_documents(docs, quality.training_labels(labels))
    return rows.select("doc_id", (crc_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_suffix_dedup, op3_simhash, op4_decontamination, op5_mixing, op6_lattice_lm, op7_token_output, op8_kd_shards, op9_license_scan, op10_winnowing, op11_spelling, op12_lexical_search, op13_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op12_lexical_search": LEXICAL_SQL}


#: Every document scored for every item it shares a term with.
LEXICAL_SQL = r"""
with docs as (
  select row_number() over () as row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as terms
  from documents),
sized as (select row, doc_id, terms, len(terms) as n from docs where len(terms) > 0),
total as (select count(*) as docs, cast(sum(n) as bigint) as size from sized),
counted as (select row, term, count(*) as tf from (select row, unnest(terms) as term from sized) group by row, term),
frequency as (select term, count(*) as df from counted group by term),
asked as (
  select distinct item_id, term from (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as term
    from benchmark)),
weighted as (
  select item_id, term, cast(floor(1000 * ln((2.0 * docs + 2) / (2.0 * df + 1))) as bigint) as w
  from asked join frequency using (term), total),
scored as (
  select item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // size)))) as score
  from weighted join counted using (term) join sized using (row), total
  group by item_id, doc_id, row),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from ranked where rank <= 10
"""
