"""The corpus pipeline: quality rules, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next stage's docs. All but the last return the
columns of `documents`; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm import linededup, packing, quality, shinglesets, substring
from cueloom.llm.common import release, table, tables_written, written
from cueloom.llm.queries import VOCABULARY
from cueloom.session import ship

#: Near duplicates: a Jaccard similarity of 0.8 or more of the whole sets of five-word shingles. Pairs under a common key
#: are discarded by fingerprints of 128 bits, and what is left is compared by these sets. Two sets of similarity 0.8 have a
#: cosine of 1.6 / 1.8, so each fingerprint bit agrees with chance 0.848 and 19.5 of 128 bits differ on average, standard
#: deviation 4.1: by that model 0.999998 of such pairs of long texts differ in at most 38 bits. In sets of 4 and 5 shingles a
#: bit differs with chance 3 / 16, 24 of 128 on average, and 0.00095 of such pairs are lost. None of it depends on the number of rows.
SHINGLE, LANES, RADIUS = 5, 2, 38


def _as_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    kept = rows.select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. Null, empty and blank texts are rejected."""
    return quality.kept(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their frequent lines. A document that loses every line stays, with an empty text."""
    return _as_documents(linededup.dedup_lines(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group. Rows that share an id are one document; rows without one stay."""
    found = shinglesets.groups(docs, SHINGLE, RADIUS, LANES)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 35 words or more that repeat. A document that loses every word stays, with an empty text."""
    return _as_documents(substring.dedup_substrings(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids."""
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: Fingerprints, difference covers and BPE have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents. What a stage has written on the way goes when its result is written."""
    ship(spark)
    docs, before = table(spark, sf_dir, "documents"), set(tables_written())
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        release(spark, [p for p in tables_written()[:-1] if p not in before])
    return STAGES[-1][1](spark, docs, sf_dir)
