import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))]

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text) of the smallest table, for plain versions of the operators."""
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return [(r["doc_id"], r["text"]) for r in rows]


#: Nulls, empty and blank texts, ties, repeated rows, one very long text, and columns whose names the operators use themselves.
CASES = [
    (1, "The cat sat on the mat and looked at the moon for a long long while tonight.", "en", "a", 5, 0, "x"),
    (2, "The cat sat on the mat and looked at the moon for a long long while tonight.", "en", "a", 5, 0, "x"),
    (2, "The cat sat on the mat and looked at the moon for a long long while tonight.", "en", "a", 5, 0, "x"),
    (3, None, None, None, None, None, None),
    (4, "", "en", "a", 0, 1, ""),
    (5, " \n\t ", "en", "b", 4, 1, " "),
    (None, "A text without a key, yet with words enough to be taken for a document by all the rules there are in here today.", "fr", "b", 9, 2, "y"),
    (7, "word " * 60_000, "de", "b", 300_000, 3, "z"),
    (8, "日本語 é́ ﬁ 😀 \x00 ▁ <|endoftext|> a.b,c!", "ja", "c", 9, 3, "z"),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key long, words string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(CASES, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
