"""Quality rules whose statistics are judged together by an isolation forest.

Every document gets the counts that quality rules look at. Trees of random splits isolate documents with unusual counts
after few splits; the mean path length becomes an anomaly score, and the score above which a document is rejected is
calibrated on labelled rows. Trees and threshold come from a bounded sample of the labelled rows (``SAMPLE_ROWS``, those
with the smallest key hashes); statistics and verdicts cover every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import name, require
from quarry.llm.common import BLANKS, flat_bytes, fresh, text_slices, words_of

SAMPLE_ROWS = 20_000
TREES, TREE_ROWS = 100, 256
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
GOOD_WEIGHT = 25  # a good document lost counts as much as so many bad ones kept
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "stutter", "capitals", "digits", "marks")
TAIL = 0.0005  # share of good rows that may lie beyond a rule's limit on either side
BAD_SHARE = 0.2  # of the bad sample rows, that trees are grown on beside the good ones


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=np.int32)
    table[list(chars)] = 1
    return table


_KINDS = {
    "blank": _class(BLANKS),
    "points": _class(bytes(b for b in range(256) if b & 0xC0 != 0x80)),  # bytes that begin a code point
    "symbols": _class(SYMBOLS.encode()),
    "capitals": _class(bytes(range(65, 91))),
    "letters": _class(bytes([*range(65, 91), *range(97, 123)])),
    "digits": _class(b"0123456789"),
    "marks": _class(b"!\"'(),-./:;?@[\\]^_`{}~+="),
}


def _sums(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over consecutive stretches that end at ``ends``."""
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(upto[ends], prepend=0)


def repeated_words(ids: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text the words that lie in a window of ``window`` words which the text holds twice or more."""
    counts = np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(len(ends)), counts)
    first = np.arange(len(ids)) + window <= np.repeat(ends, counts)
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(len(ends), dtype=np.int64)
    code = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    code ^= code >> np.uint64(29)
    key = owner[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(window):
        key = key * np.uint64(0xBF58476D1CE4E5B9) + code[at + k]
    ranked = np.sort(key)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    at = at[np.isin(key, twice)]  # holds every repeated window; hashes that merely collide are told apart below
    rows = np.column_stack([owner[at], *[ids[at + k] for k in range(window)]])
    _, inverse, found = np.unique(rows, axis=0, return_inverse=True, return_counts=True) if len(at) else (None, at, at)
    hit = at[found[inverse] > 1]
    change = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + window, -1)
    return _sums(np.cumsum(change[:-1]) > 0, ends)


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of ``BASE`` and ``FEATURES`` for a batch of texts (large strings without nulls)."""
    raw, ends = flat_bytes(texts)
    total = {k: _sums(t[raw], ends) for k, t in _KINDS.items()}
    words, n_words = words_of(raw, ends)
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    word_ends = np.cumsum(n_words)
    owner = np.repeat(np.arange(len(ends)), n_words)
    again = np.zeros(len(ids), dtype=bool)  # equal to the word before it in the same text
    again[1:] = (ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])

    lines = pc.split_pattern(texts, "\n")
    line_ends = np.asarray(lines.offsets, dtype=np.int64)
    coded = lines.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    worded = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)), 0).to_numpy(zero_copy_only=False)
    line_owner = np.repeat(np.arange(len(ends)), np.diff(line_ends))
    real = worded[codes] if len(codes) else np.zeros(0, bool)
    n_lines = np.bincount(line_owner[real], minlength=len(ends))
    distinct = np.unique(line_owner[real] * (len(worded) + 1) + codes[real]) // (len(worded) + 1)
    out = {"n_words": n_words, "word_chars": total["points"] - total["blank"], "n_symbols": total["symbols"],
           "n_dup_lines": n_lines - np.bincount(distinct, minlength=len(ends)), "n_repeat_words": repeated_words(ids, word_ends)}
    many, letters = np.maximum(n_words, 1), np.maximum(total["letters"], 1)
    out |= {"word_length": out["word_chars"] / many, "symbols": out["n_symbols"] / many,
            "dup_lines": out["n_dup_lines"] / np.maximum(n_lines, 1), "repeats": out["n_repeat_words"] / many,
            "stutter": _sums(again, word_ends) / many, "capitals": total["capitals"] / letters,
            "digits": total["digits"] / many, "marks": total["marks"] / many}
    return out


def excess(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far each statistic lies beyond its rule's limits, in widths of the allowed range, at most 1."""
    return np.clip(np.maximum(x - high, low - x) / (high - low + 1e-3), 0, 1)


def base_failed(found: dict[str, np.ndarray]) -> np.ndarray:
    return (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"])


@dataclass
class Forest:
    """Rule limits, isolation trees as flat arrays (feature -1: a leaf; ``value``: the split point or the leaf's path length), threshold."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: np.ndarray
    scale: float
    low: np.ndarray
    high: np.ndarray
    threshold: float = math.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / expected path length): near 1 for rows that few splits isolate."""
        x = excess(x, self.low, self.high)
        paths = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            while True:
                inner = self.feature[at] >= 0
                if not inner.any():
                    break
                less = x[rows[inner], self.feature[at[inner]]] < self.value[at[inner]]
                at[inner] = np.where(less, self.left[at[inner]], self.right[at[inner]])
            paths += self.value[at]
        return np.power(2.0, -paths / (len(self.roots) * self.scale))


def _mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, good: np.ndarray, seed: int = 7) -> Forest:
    """Rule limits from the good rows, then ``TREES`` trees of at most ``TREE_ROWS`` rows each, split at random until rows stand alone or depth log2 is reached."""
    rng = np.random.default_rng(seed)
    limits = np.quantile(x[good], TAIL, axis=0), np.quantile(x[good], 1 - TAIL, axis=0)
    bad = np.flatnonzero(~good)
    x = excess(np.concatenate([x[good], x[rng.choice(bad, math.ceil(BAD_SHARE * len(bad)), replace=False)]]), *limits)
    rows = min(TREE_ROWS, len(x))
    depth = max(1, math.ceil(math.log2(max(2, rows))))
    feature, value, left, right, roots = [], [], [], [], []

    def node(part: np.ndarray, level: int) -> int:
        here = len(feature)
        for out in (feature, value, left, right):
            out.append(0)
        low, high = part.min(axis=0), part.max(axis=0)
        open_to = np.flatnonzero(high > low)
        if level >= depth or len(part) < 2 or not len(open_to):
            feature[here], value[here] = -1, level + _mean_path(len(part))
            return here
        f = int(rng.choice(open_to))
        cut = rng.uniform(low[f], high[f]) or high[f]
        side = part[:, f] < cut
        if side.all() or not side.any():
            feature[here], value[here] = -1, level + _mean_path(len(part))
            return here
        feature[here], value[here] = f, cut
        left[here] = node(part[side], level + 1)
        right[here] = node(part[~side], level + 1)
        return here

    for _ in range(TREES):
        roots.append(node(x[rng.choice(len(x), rows, replace=False)], 0))
    return Forest(np.array(feature), np.array(value, dtype=float), np.array(left), np.array(right), np.array(roots), max(_mean_path(rows), 1e-9), *limits)


def calibrate(scores: np.ndarray, good: np.ndarray) -> float:
    """Threshold with the least cost, ``GOOD_WEIGHT`` per good row above it and 1 per bad row at or below it; the middle of the gap."""
    order = np.argsort(scores)
    ranked, is_good = scores[order], good[order]
    cost = np.append(0, np.cumsum(~is_good)) + GOOD_WEIGHT * (is_good.sum() - np.append(0, np.cumsum(is_good)))
    cost[1:-1][ranked[1:] == ranked[:-1]] = np.iinfo(np.int64).max  # no cut between equal scores
    cut = len(cost) - 1 - int(np.argmin(cost[::-1]))  # the most lenient of the best cuts
    if cut == 0 or cut == len(ranked):
        return float(ranked[-1]) if cut else float(np.nextafter(ranked[0], -1))
    return float((ranked[cut - 1] + ranked[cut]) / 2)


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        found = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(base_failed(found)), *[pa.array(found[f].astype(float)) for f in FEATURES]],
                                         names=["quality", "failed", *FEATURES])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text") -> Forest | None:
    """Trees and threshold from at most ``sample_rows`` labelled documents; None without labelled documents of both kinds.

    ``labels`` has the key and ``quality`` (1 good, 0 bad). Rows with nulls in either are left out.
    """
    own, good_ = fresh("id"), fresh("quality")
    picked = (labels.select(F.col("doc_id").alias(own), F.col("quality").alias(good_)).na.drop()
              .orderBy(F.xxhash64(own), own, good_).limit(sample_rows))
    bounded = F.broadcast(picked)  # at most sample_rows pairs of numbers
    rows = docs.join(bounded, name(key) == F.col(own)).select(name(text).cast("string").alias("text"), F.col(good_).cast("int").alias("quality"))
    found = rows.mapInArrow(_features_of, "quality int, failed boolean, " + ", ".join(f"{f} double" for f in FEATURES))
    held = found.limit(2 * sample_rows).toPandas()  # more rows than labels only where keys repeat
    held = held[~held["failed"]].sort_values(list(held.columns), ignore_index=True)  # rows that reach the forest, in a fixed order
    good = held["quality"].to_numpy() > 0
    if not len(held) or good.all() or not good.any():
        return None
    x = held[list(FEATURES)].to_numpy(dtype=float)
    forest = grow(x, good)
    forest.threshold = calibrate(forest.score(x), good)
    return forest


def verdicts(found: dict[str, np.ndarray], forest: Forest | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base_failed, score, kept)."""
    failed = base_failed(found)
    if forest is None:
        return failed, np.zeros(len(failed)), ~failed
    score = forest.score(np.column_stack([found[f] for f in FEATURES]))
    return failed, score, ~failed & (score <= forest.threshold)


def _judged(forest: Forest | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        found = statistics(batch.column("text"))
        failed, score, kept = verdicts(found, forest)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(found[b].astype(np.int64)) for b in BASE], pa.array(failed), pa.array(kept), pa.array(score)],
                                         names=["doc_id", *BASE, "base_failed", "kept", "score"])


def judge(docs: DataFrame, forest: Forest | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key as ``doc_id``, the counts of ``BASE``, ``base_failed``, ``kept``, ``score``.

    A null or empty text has no words and fails. Without a forest the base rules alone decide. Rows stay apart, equal ones
    and null keys included; an empty table gives no rows; other columns are not read.
    """
    require(docs, key, text)
    slim = docs.select(name(key).alias("doc_id"), name(text).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(partial(_judged, forest), f"doc_id {kind}, " + ", ".join(f"{b} long" for b in BASE) + ", base_failed boolean, kept boolean, score double")


def _passing(forest: Forest | None, text: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        at = 0
        for batch in text_slices([whole], text):
            _, _, kept = verdicts(statistics(batch.column(text)), forest)
            yield whole.slice(at, batch.num_rows).filter(pa.array(kept))
            at += batch.num_rows


def keep_good(docs: DataFrame, forest: Forest | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, in one pass."""
    require(docs, text)
    return docs.mapInArrow(partial(_passing, forest, text), docs.schema)
