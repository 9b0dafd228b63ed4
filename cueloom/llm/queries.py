"""The queries opN_<name>: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, convrepair, kmeans, knn, licenses, linededup, packing, quality, sharding, simhash, sql, substring, toxicity, urlfilter
from .common import SPACE_CLASS, table, text_bytes

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def sha(col):
    return F.sha2(F.coalesce(col, F.lit("")).cast("binary"), 256)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` has no paths, so each stands in a tree by its id; every eighth id is its folder's license file."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 8 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".txt")))
    path = F.concat_ws("/", F.expr("doc_id div 512"), F.expr("doc_id div 8"), name)
    return licenses.scan(docs.select("doc_id", "text", path.alias("path")))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.trim(F.regexp_replace("text", f"{SPACE_CLASS}+", " "))
    return kept.select("doc_id", "n_words", "n_removed", sha(words).alias("kept_sha256"))


#: The contract's rules.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", sha(F.col("text")).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select("doc_id", (text_bytes(F.col("text")) + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.assign(sized, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality.FEATURES, "base_failed", "kept")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.with_inertia(kmeans.cluster(table(spark, sf_dir, "embeddings"), 40, 5, 64, 256))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "conversations")
    rows = convrepair.damaged(whole)
    return convrepair.digests(rows, convrepair.plans(rows, every=whole))


def queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_license_scan": op2_license_scan,
        "op3_exact_top_k": op3_exact_top_k,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_url_filter": op5_url_filter,
        "op6_bpe": op6_bpe,
        "op7_line_dedup": op7_line_dedup,
        "op8_simhash": op8_simhash,
        "op9_sharding": op9_sharding,
        "op10_quality_rules": op10_quality_rules,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_toxicity": op12_toxicity,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
