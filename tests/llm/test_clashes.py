"""Documents whose other columns bear the names that operators work with: nothing is lost and nothing is ambiguous."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, hilbert, lexical_blocks, line_dedup, minmax, packed_ids, pieces, quality_rules, suffix_dedup

NAMES = ("_id _key _removed _leaking _dropped quality id key line lines line_no more removed first late n print band hub root u v r s kept score failed "
         "core full start stop spans item_id words doc_words shift w rank curve cell law upto _before file place terms counts alike m item").split()
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def wide(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in NAMES if c not in docs.columns])


def untouched(df, wide):
    assert df.columns == wide.columns
    assert df.select(*[c for c in wide.columns if c.startswith("_") or c in NAMES]).distinct().count() == 1


def test_stages_keep_clashing_columns(spark, wide):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").withColumn("_id", F.lit(1)).withColumn("text", F.lit("x"))
    slim = spark.read.parquet(f"{FOLDER}/documents.parquet")
    forest = quality_rules.fit(wide, labels, 2000)
    good = quality_rules.keep_good(wide, forest)
    untouched(good, wide)
    assert good.count() == quality_rules.keep_good(slim, quality_rules.fit(slim, labels, 2000)).count() < slim.count()
    removed = line_dedup.repeated_lines(wide, edits=1)
    lines = line_dedup.dedup_lines(wide, removed)
    untouched(lines, wide)
    assert line_dedup.line_report(wide, removed).agg(F.sum("n_removed")).first()[0] > 0
    untouched(minmax.keep_one(wide), wide)
    clean = decontaminate.without_leaks(wide, spark.read.parquet(f"{FOLDER}/benchmark.parquet").withColumn("doc_id", F.lit(1)).withColumn("_leaking", F.lit(1)), window=13, similar=0.8)
    untouched(clean, wide)
    assert 0 < clean.count() < slim.count()


def test_reports_read_only_their_columns(spark, wide, tmp_path):
    n = wide.count()
    assert suffix_dedup.dedup_report(wide, suffix_dedup.repeated_spans(wide)).count() == n
    assert pieces.digests(wide, public_tokenizers.path("piece_bpe_32k.model")).count() == n
    assert packed_ids.read_index(spark, packed_ids.write_ids(wide, public_tokenizers.path("word_bpe_49k.json"))).count() == n
    placed = hilbert.shard(wide, 4)
    assert hilbert.write_shards(wide, placed, str(tmp_path / "shards")).agg(F.sum("rows")).first()[0] == n
    assert spark.read.parquet(str(tmp_path / "shards")).select("_id", "curve").distinct().count() == 1
    with pytest.raises(ValueError, match="rename size"):
        hilbert.write_shards(wide.withColumn("size", F.lit(1)), placed, str(tmp_path / "other"))
    items = spark.createDataFrame([(1, "one the and", 2)], "item_id long, text string, item long")
    assert lexical_blocks.ranked(wide, items, 3).count() <= 3


def test_letters_that_grow_before_marks():
    """Letters that NFC or lower-casing takes apart, before every ASCII mark, and marks that combine with capitals."""
    import unicodedata

    letters = [chr(c) for c in range(0x80, 0x30000) if unicodedata.category(chr(c))[0] == "L" and (unicodedata.normalize("NFC", chr(c)) != chr(c) or len(chr(c).lower()) != 1)]
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    texts = ["".join(f" {g}{m}{g} x{g}{m}" for m in marks) for g in letters] + ["J̌.", "SERGİ: DENİ.", "(KENDİ), x", "Bİ- T̈! ẗ?", "é. É."]
    encoder = packed_ids.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    sizes, ids = encoder(pa.array(texts, pa.large_string()), 2)
    for text, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        assert got.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids + [2], text
