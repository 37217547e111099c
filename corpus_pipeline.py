"""A corpus made ready for training in stages, each written as Parquet and read again as the next one's documents.

Quality rules drop documents, line dedup shortens texts, near-duplicate search leaves one document of each group,
decontamination drops documents that hold benchmark items, and the last stage encodes what is left. The first four return
the columns of ``documents``. Rows with null keys pass the stages that need keys; a document of which no line is left stays
with an empty text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, line_dedup, minmax, pieces, quality_rules
from quarry.llm.common import table
from quarry.session import ship, write_out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest keep."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels"), sample_rows=20_000))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without lines that repeat an earlier line that is not blank, or come within three edits of one."""
    kept = line_dedup.dedup_lines(docs, line_dedup.repeated_lines(docs, min_chars=20, edits=3))
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on five-word shingles."""
    return minmax.keep_one(docs, words=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"), window=13, similar=0.8)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every document left."""
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("encoding", encoding)]

#: Isolation trees and piece encoding have no SQL; the tests compare the stages with plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = write_out(stage(spark, docs, sf_dir))
    return docs
