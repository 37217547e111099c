"""Token counts that survive edits.

A text is cut into pre-tokens by the tokenizer's pattern, and each pre-token's tokens are counted on their own. Blocks of
pre-tokens are the leaves of a segment tree with sums of characters and tokens, so an edit finds its place, re-encodes the
pre-tokens it touches plus the context the pattern may have looked at, and updates the sums on the way to the root. The
scan stops as soon as a new boundary falls on an old one behind the edit: from there on the cut is the old one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import name, require
from quarry.llm.common import text_slices

BLOCK = 64  # pre-tokens of a leaf when a tree is built
CACHED = 400_000
#: Characters behind a pre-token that decide where it ends: an apostrophe's contraction is two letters long.
LOOK_AHEAD = 2


class Counter:
    """Cuts texts into pre-tokens and counts the tokens of each, equal ones once per worker."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("pre-tokens", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern, self.seen = regex.compile(pattern), {}

    def cut(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def counts(self, parts: Sequence[str]) -> list[int]:
        seen = self.seen
        try:
            return [seen[p] for p in parts]
        except KeyError:
            if len(seen) > CACHED:
                seen.clear()
            for p in set(parts).difference(seen):
                seen[p] = len(self.encoding.encode_ordinary(p))
            return [seen[p] for p in parts]


@lru_cache(maxsize=2)
def counter(ranks: str, pattern: str) -> Counter:
    return Counter(ranks, pattern)


class TokenTree:
    """Segment tree over blocks of pre-tokens; node 1 is the root, ``sums[k]`` holds (characters, tokens) below node k."""

    def __init__(self, lengths: Sequence[int], counts: Sequence[int]):
        self._build([(list(lengths[i:i + BLOCK]), list(counts[i:i + BLOCK])) for i in range(0, len(lengths), BLOCK)] or [([], [])])

    def _build(self, blocks: list[tuple[list[int], list[int]]]) -> None:
        self.blocks = blocks
        self.width = 1 << (len(blocks) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), dtype=np.int64)
        self.sums[self.width:self.width + len(blocks)] = [(sum(a), sum(b)) for a, b in blocks]
        level = self.width
        while level > 1:
            self.sums[level // 2:level] = self.sums[level:2 * level].reshape(-1, 2, 2).sum(axis=1)
            level //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def characters(self) -> int:
        return int(self.sums[1, 0])

    def leaves(self) -> tuple[list[int], list[int]]:
        return [x for a, _ in self.blocks for x in a], [x for _, b in self.blocks for x in b]

    def _block_at(self, offset: int) -> tuple[int, int]:
        """The block that holds the character at ``offset`` (the last one behind the end) and where the block begins."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if offset >= start + self.sums[node, 0] and self.sums[node + 1, 0] > 0:
                start += int(self.sums[node, 0])
                node += 1
        return min(node - self.width, len(self.blocks) - 1), start

    def _set(self, block: int, lengths: list[int], counts: list[int]) -> None:
        self.blocks[block] = (lengths, counts)
        node = self.width + block
        self.sums[node] = sum(lengths), sum(counts)
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, new_text: str, start: int, stop: int, size: int, count: Counter) -> int:
        """Characters ``start`` to ``stop`` became ``size`` others, which gave ``new_text``; returns the pre-tokens encoded anew."""
        first, begin = self._block_at(max(0, start - LOOK_AHEAD))
        if begin and begin + LOOK_AHEAD > start:
            first, begin = self._block_at(begin - 1)
        kept = 0  # pre-tokens of the first block that end too early to have seen the edit
        for n in self.blocks[first][0]:
            if begin + n + LOOK_AHEAD > start:
                break
            begin, kept = begin + n, kept + 1
        shift = size - (stop - start)
        last, at, old = first, kept, begin  # walks over the old boundaries
        parts: list[str] = []
        met = False
        for found in count.pattern.finditer(new_text, begin):
            parts.append(found.group())
            target = found.end() - shift  # this boundary in the old text
            if found.end() < start + size or target < stop:
                continue
            while old < target:
                if at == len(self.blocks[last][0]):
                    if last + 1 == len(self.blocks):
                        break
                    last, at = last + 1, 0
                    continue
                old, at = old + self.blocks[last][0][at], at + 1
            if old == target:
                met = True
                break
        if not met:  # the cut changed up to the end
            last, at = len(self.blocks) - 1, len(self.blocks[-1][0])
        rest = self.blocks[last][0][at:], self.blocks[last][1][at:]
        head = self.blocks[first][0][:kept], self.blocks[first][1][:kept]
        for b in range(first + 1, last + 1):
            self._set(b, [], [])
        self._set(first, head[0] + [len(p) for p in parts] + rest[0], head[1] + count.counts(parts) + rest[1])
        if len(self.blocks[first][0]) > 4 * BLOCK:
            self.__init__(*self.leaves())
        return len(parts)


def tree(text: str, count: Counter) -> TokenTree:
    parts = count.cut(text)
    return TokenTree([len(p) for p in parts], count.counts(parts))


def edited(text: str, edits: Sequence[tuple[int, int, str]], count: Counter) -> tuple[TokenTree, str, int, int, int]:
    """(tree, text, tokens before, pre-tokens before, pre-tokens encoded anew) after edits (start, stop, replacement) in order.

    Offsets are characters of the text as the edit finds it, cut to its length.
    """
    own = tree(text, count)
    before, parts, anew = own.tokens, sum(len(a) for a, _ in own.blocks), 0
    for start, stop, new in edits:
        start = min(max(start, 0), len(text))
        stop = min(max(stop, start), len(text))
        text = text[:start] + new + text[stop:]
        anew += own.edit(text, start, stop, len(new), count)
    return own, text, before, parts, anew


def _counted(ranks: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = counter(ranks, pattern)
    for batch in text_slices(batches):
        rows = []
        for text, edits in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist()):
            asked = [(e["start"] or 0, e["stop"] if e["stop"] is not None else e["start"] or 0, e["replacement"] or "") for e in edits or () if e]
            own, _, before, parts, anew = edited(text, asked, count)
            rows.append((before, parts, own.tokens, sum(len(a) for a, _ in own.blocks), anew, own.characters))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in zip(*rows)]],
                                         names=["doc_id", "n_tokens", "n_pretokens", "n_tokens_edited", "n_pretokens_edited", "n_encoded_anew", "n_chars_edited"])


def count_edited(docs: DataFrame, ranks: str, pattern: str, edits: str = "edits", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key as ``doc_id``; tokens and pre-tokens before and after its edits, pre-tokens encoded anew, characters afterwards.

    ``edits`` is an array of (start, stop, replacement) in order of application; null or empty: none; a null start counts
    as 0, a null stop as the start, a null replacement as empty. A null text is empty. Rows stay apart, equal ones and null
    keys included; an empty table gives no rows; other columns are not read.
    """
    require(docs, key, text, edits)
    slim = docs.select(name(key).alias("doc_id"), name(text).cast("string").alias("text"),
                       name(edits).cast("array<struct<start:int,stop:int,replacement:string>>").alias("edits"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(partial(_counted, ranks, pattern), f"doc_id {kind}, n_tokens long, n_pretokens long, n_tokens_edited long, "
                           "n_pretokens_edited long, n_encoded_anew long, n_chars_edited long")


def _stored(ranks: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = counter(ranks, pattern)
    for batch in text_slices(batches):
        cut = [count.cut(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([[len(p) for p in c] for c in cut], pa.list_(pa.int32())),
                                          pa.array([count.counts(c) for c in cut], pa.list_(pa.int32()))], names=["doc_id", "lengths", "counts"])


def trees(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The leaves of every tree, to be stored: ``doc_id``, ``lengths`` and ``counts``; ``TokenTree(lengths, counts)`` restores it."""
    require(docs, key, text)
    slim = docs.select(name(key).alias("doc_id"), name(text).cast("string").alias("text"))
    return slim.mapInArrow(partial(_stored, ranks, pattern), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lengths array<int>, counts array<int>")


def revision(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``edits`` to every document: drop its second line's first 12 characters, double the middle 20, put its length at the end."""
    body = F.coalesce(name(text).cast("string"), F.lit(""))
    n, line = F.length(body), F.instr(body, "\n")
    middle = F.floor(n / 2).cast("int")
    drop = F.struct(line.alias("start"), (line + 12).alias("stop"), F.lit("").alias("replacement"))
    after = F.greatest(F.lit(0), middle - 12)
    double = F.struct(after.alias("start"), after.alias("stop"), F.substring(body, middle, F.lit(20)).alias("replacement"))
    tail = F.struct((n + 20).alias("start"), (n + 20).alias("stop"), F.concat(F.lit(" "), n.cast("string")).alias("replacement"))
    return docs.withColumn("edits", F.array(drop, double, tail))
