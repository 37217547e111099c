"""Importance resampling of raw text towards a target (hashed n-gram models, Gumbel top-k).

Two bag-of-n-grams models over the same hashed buckets, one of the target documents and one of all documents, give every
document a log importance weight: the sum of the log ratios of its n-grams. Adding Gumbel noise and keeping the largest
k draws k documents without replacement in proportion to their weights. The noise is a hash of the key, so a rerun or a
retried task draws the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import name, require
from quarry.llm.common import flat_bytes, text_slices, words_of
from quarry.operators.ordered import number_rows
from quarry.session import write_out

BUCKETS = 1 << 15  # the model's size, half for words and half for pairs of words; what reaches the driver is this many counts
SMOOTHING = 1.0
SEED = 41
SMALL_IDS = 500_000
ROWS_PER_RANGE = 5_000


def ngram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word and of every pair of neighbours (ASCII letters in lower case), and the text each belongs to."""
    raw, ends = flat_bytes(pc.ascii_lower(texts))
    words, counts = words_of(raw, ends)
    coded = words.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    word = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else hashes
    owner = np.repeat(np.arange(len(counts)), counts)
    half = BUCKETS // 2
    ones = (word % np.uint64(half)).astype(np.int64)
    both = np.flatnonzero(owner[1:] == owner[:-1])
    mixed = word[both] * np.uint64(0x9E3779B97F4A7C15) + word[both + 1]
    pairs = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(half)).astype(np.int64) + half
    return np.concatenate([ones, pairs]), np.concatenate([owner, owner[both]])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in text_slices(batches):
        found, owner = ngram_buckets(batch.column("text"))
        raw += np.bincount(found, minlength=BUCKETS)
        wanted = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
        target += np.bincount(found[wanted[owner]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "n_raw", "n_target"])


def log_ratios(docs: DataFrame, target_ids: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Log ratio per bucket of the target's smoothed model to that of all documents; counts cover every document."""
    require(docs, key, text)
    ids = write_out(target_ids.toDF("_target").na.drop().distinct())
    if ids.count() <= SMALL_IDS:
        ids = F.broadcast(ids)
    flagged = docs.select(name(key).alias("_key"), name(text).cast("string").alias("text")).join(ids, F.col("_key") == F.col("_target"), "left")
    counted = (flagged.select("text", F.col("_target").isNotNull().alias("target"))
               .mapInArrow(_counted, "bucket long, n_raw long, n_target long")
               .groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target")).toPandas())
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counted["bucket"]], target[counted["bucket"]] = counted["n_raw"], counted["n_target"]

    def model(n: np.ndarray) -> np.ndarray:
        halves = n.reshape(2, -1) + SMOOTHING
        return np.log(halves / halves.sum(axis=1, keepdims=True)).ravel()

    return model(target) - model(raw)


def _weighed(ratios: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        found, owner = ngram_buckets(batch.column("text"))
        weight = np.bincount(owner, weights=ratios[found], minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.bincount(owner, minlength=batch.num_rows)), pa.array(np.round(weight, 6))],
                                         names=["doc_id", "n_ngrams", "log_weight"])


def resample(docs: DataFrame, ratios: np.ndarray, share: float, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key as ``doc_id``, ``n_ngrams``, ``log_weight``, ``gumbel``, ``score`` (their sum), ``rank`` (0: the largest score)
    and ``kept``: the first ``share`` of all rows.

    A null or empty text has no n-grams and weight 0. Ties in the score go by key, null keys last; equal rows get ranks of
    their own. An empty table gives no rows; other columns are not read.
    """
    require(docs, key, text)
    slim = docs.select(name(key).alias("doc_id"), name(text).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    weighed = slim.mapInArrow(partial(_weighed, ratios), f"doc_id {kind}, n_ngrams long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    drawn = weighed.withColumn("gumbel", F.round(-F.log(-F.log(uniform)), 6))
    drawn = write_out(drawn.withColumn("score", F.col("log_weight") + F.col("gumbel")).withColumn("_order", -F.col("score")))
    ranked = number_rows(drawn, ["_order", "doc_id", "n_ngrams"], out="rank", rows_per_range=ROWS_PER_RANGE)
    k = round(share * drawn.count())
    return ranked.withColumn("kept", F.col("rank") < k).drop("_order")


def good_share(labels: DataFrame) -> float:
    """Share of good rows among all labelled ones; 1 without labels."""
    return labels.agg(F.avg((F.col("quality") > 0).cast("double"))).first()[0] if labels.take(1) else 1.0
