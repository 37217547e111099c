"""The registered queries of the corpus operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table
from quarry.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return build(spark, folder)

        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return build

    return register


#: All rows against the stated queries, ranked.
_TOP_PRODUCTS = """
    WITH whole AS (
      SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
    scored AS (
      SELECT q.vec_id AS query_id, w.vec_id, CAST(list_inner_product(q.x, w.x) AS BIGINT) AS score
      FROM whole q JOIN whole w ON q.vec_id % 50 = 0 AND w.vec_id <> q.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
    SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5"""


#: Terms, weights and scores as the contract of operator 12 defines them.
_RANKED = r"""
    WITH doc_words AS (
      SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM documents),
    item_words AS (
      SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark),
    lengths AS (SELECT doc_id, count(*) AS n FROM doc_words GROUP BY doc_id),
    corpus AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lengths),
    held AS (SELECT doc_id, term, count(*) AS tf FROM doc_words WHERE term IN (SELECT term FROM item_words) GROUP BY doc_id, term),
    weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, corpus GROUP BY term, big_n),
    scored AS (
      SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
      FROM item_words JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus GROUP BY item_id, doc_id),
    placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
    SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM placed WHERE place <= 50"""


@query("op9_hilbert_shards")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm import hilbert

    placed = hilbert.shard(table(spark, folder, "documents"), shards=16, dims=("lang", "source", "n_chars"), law="rows")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


@query("op10_packed_ids")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm import packed_ids
    from quarry.session import write_out

    written = packed_ids.write_ids(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)
    found = write_out(packed_ids.read_index(spark, written))
    return packed_ids.global_starts(found).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op8_piece_encoding")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm import pieces

    return pieces.digests(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op6_quality_rules")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm import quality_rules

    docs = table(spark, folder, "documents")
    forest = quality_rules.fit(docs, table(spark, folder, "labels"), sample_rows=20_000)
    return quality_rules.judge(docs, forest)


@query("op7_minmax_duplicates")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm import minmax

    return minmax.near_duplicates(table(spark, folder, "documents"), words=4, percent=80)


@query("op4_importance_resampling")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm import resample

    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    ratios = resample.log_ratios(docs, labels.filter("quality = 1").select("doc_id"))
    return resample.resample(docs, ratios, resample.good_share(labels))


@query("op3_token_trees")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm import token_trees

    revised = token_trees.revision(table(spark, folder, "documents"))
    return token_trees.count_edited(revised, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op1_spaced_seeds")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm import decontaminate

    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=13, similar=0.8)


@query("op5_line_edit_join")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm import line_dedup

    docs = table(spark, folder, "documents")
    return line_dedup.line_report(docs, line_dedup.repeated_lines(docs, min_chars=20, edits=3))


@query("op2_suffix_groups")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm import suffix_dedup

    docs = table(spark, folder, "documents")
    return suffix_dedup.dedup_report(docs, suffix_dedup.repeated_spans(docs, length=400))


@query("op11_lanczos_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm import vectors, whitening

    rows = vectors.whole_vectors(table(spark, folder, "embeddings"))
    return whitening.whiten(rows, whitening.fit(rows, components=4))


@query("op12_posting_blocks", _RANKED)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm import lexical_blocks

    return lexical_blocks.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"), top=50)


@query("op13_sorted_lists", _TOP_PRODUCTS)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm import top_products, vectors

    rows = vectors.whole_vectors(table(spark, folder, "embeddings"))
    return top_products.top_products(rows, rows.filter("vec_id % 50 = 0"), k=5)
