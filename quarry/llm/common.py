"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quarry.functions.columns import name, require

SLICE_BYTES = 2 << 20


def table(spark: SparkSession, folder: str, what: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{what}.parquet")


def two_columns(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id`` and ``text`` only, so that other columns cannot clash with working ones."""
    require(docs, key, text)
    return docs.select(name(key).alias("doc_id"), name(text).cast("string").alias("text"))


def fresh(stem: str) -> str:
    """A column name that no table has, for work beside columns of the caller's."""
    return f"{stem}_{uuid.uuid4().hex}"


def text_slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, or one row; null texts become empty."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = batch.schema.get_field_index(text)
        column = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
        batch = pa.RecordBatch.from_arrays([column if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)
        upto = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(upto[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(upto, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] … starts[i] + lengths[i] - 1`` for every i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def split_words(texts: pa.Array, mark: str = " ") -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Per text the end of its words in the flat list, the index of every word, and the distinct words."""
    parts = pc.split_pattern(texts, mark)
    ends = np.asarray(parts.offsets, dtype=np.int64)
    coded = parts.flatten().dictionary_encode()
    return ends[1:] - ends[0], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a batch of large strings without nulls, and where each text ends."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    if not len(ends) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), ends
    start = int(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset])
    return np.frombuffer(texts.buffers()[2], np.uint8)[start:start + int(ends[-1])], ends


#: Bytes that stand between words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = b" \t\n\x0b\x0c\r"
_IS_BLANK = np.isin(np.arange(256), list(BLANKS))


def words_of(raw: np.ndarray, ends: np.ndarray, between: np.ndarray = _IS_BLANK) -> tuple[pa.Array, np.ndarray]:
    """The words of texts given by ``flat_bytes``, one after the other, and their number per text; ``between`` marks the bytes that part words."""
    blank = between[raw]
    opens = ~blank
    opens[1:] &= blank[:-1]
    begin = (np.concatenate([[0], ends[:-1]]) if len(ends) else ends)[np.diff(ends, prepend=0) > 0]
    opens[begin] = ~blank[begin]  # a text begins a word of its own
    upto = np.concatenate([[0], np.cumsum(opens, dtype=np.int64)])
    solid = np.ascontiguousarray(raw[~blank])
    at = (np.cumsum(~blank) - 1)[opens]
    offsets = np.append(at, len(solid)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(solid)])
    return words, np.diff(upto[ends], prepend=0)
