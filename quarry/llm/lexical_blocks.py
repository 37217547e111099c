"""Exact ranked search for items of text over posting lists cut into blocks of similar documents.

A document's vector has an impact per term; an item's score is the weighted sum over its terms. Documents are brought near
similar ones by the signs of a random projection and cut into segments of bounded size, so that a frequent term's posting
list lies in as many segments as it needs. In a segment every posting list is clustered: each document joins the pivot whose
direction is nearest to its own. A block, the documents of one pivot, keeps the coordinatewise maximum of their vectors. The
weighted sum of these maxima over an item's terms bounds the score of every document of the block; a block is skipped only
where that bound lies below a score that fifty documents are known to reach.

Posting lists whose largest impacts together cannot lift a document to that score need no entry at all: a document that
qualifies stands in another list. The index holds the terms of the items it is built for, of all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import flat_bytes, ragged, text_slices, two_columns, words_of
from quarry.operators import ordered
from quarry.session import write_out

#: Fixed by the definition of terms: letters and digits of ASCII and all bytes of other characters; only A-Z are lower-cased.
_BETWEEN = np.ones(256, bool)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _BETWEEN[_first:_last + 1] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

PLANES = 16  # of the projection that tells similar documents
BLOCK_DOCS = 32  # documents per pivot
SEGMENT_POSTINGS = 200_000
SLOTS = 8  # documents per term that set the first floors
BATCH_BYTES = 16 << 20  # of the items' terms that are searched for at a time
ALL_COORDINATES = 20_000_000


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a batch of texts (large strings without nulls), one after the other, and their number per text."""
    raw, ends = flat_bytes(texts)
    return words_of(_LOWER[raw], ends, _BETWEEN)


@dataclass(frozen=True)
class Asked:
    """Items as lists of term numbers, the vocabulary they number, and what is known of each term and item.

    ``weights`` and ``peaks`` (the largest impact) are per term, ``floors`` per item; ``entries`` marks the terms of each item
    whose posting lists it enters.
    """

    numbers: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    vocabulary: pa.Array
    weights: np.ndarray
    floors: np.ndarray
    entries: np.ndarray
    top: int

    def item(self, i: int) -> slice:
        return slice(self.starts[i], self.starts[i + 1])


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, terms, bytes), written: distinct terms of every item; rows with the same id and text count once."""
    rows = two_columns(items, key, text).select(F.col("doc_id").alias("item_id"), "text").distinct()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words, counts = terms_of(batch.column(1))
            held = [pc.unique(words.slice(end - n, n)).to_pylist() for n, end in zip(counts.tolist(), np.cumsum(counts).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.binary())),
                                              pa.array([sum(len(t) + 8 for t in x) for x in held], pa.int64())], names=["item_id", "terms", "bytes"])

    kind = rows.schema["item_id"].dataType.simpleString()
    found = rows.mapInArrow(split, f"item_id {kind}, terms array<binary>, bytes long").filter("bytes > 0")
    return write_out(found.withColumn("item", F.monotonically_increasing_id()))


def batches_of(items: DataFrame, most: int = BATCH_BYTES) -> list[DataFrame]:
    """The items cut so that a batch holds about ``most`` bytes of terms, or one item."""
    total = items.agg(F.sum("bytes")).first()[0]
    if not total:
        return []
    if total <= most:
        return [items]
    cut = write_out(ordered.running_total(items, {"upto": F.col("bytes")}, ["item"]).withColumn("batch", F.floor(F.col("upto") / most)))
    return [cut.filter(F.col("batch") == r["batch"]) for r in cut.select("batch").distinct().orderBy("batch").toLocalIterator()]


def forward(docs: DataFrame, vocabulary: pa.Array, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts, alike, place), written: a row per document.

    ``n`` counts all its terms, ``terms`` and ``counts`` those of the vocabulary; ``alike`` is near for similar documents and
    ``place`` a hash of the row's position.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.to_pylist())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.large_binary())
        planes = _planes(len(known))
        for batch in text_slices(batches):
            words, n = terms_of(batch.column(1))
            coded = words.dictionary_encode()
            number = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False)
            term = number[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int32)
            who = np.repeat(np.arange(batch.num_rows), n)[term >= 0]
            pair, count = np.unique(who * len(known) + term[term >= 0], return_counts=True)
            who, term = pair // max(1, len(known)), (pair % max(1, len(known))).astype(np.int32)
            ends = np.searchsorted(who, np.arange(batch.num_rows + 1)).astype(np.int32)
            signs = _per_row(np.sqrt(count)[:, None].astype(np.float32) * planes[term], ends) > 0
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(term)),
                pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int32))), pa.array(signs @ (1 << np.arange(PLANES)).astype(np.int32), pa.int32()),
            ], names=["doc_id", "n", "terms", "counts", "alike"])

    rows = two_columns(docs, key, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(read, f"doc_id {kind}, n long, terms array<int>, counts array<int>, alike int")
    return write_out(found.withColumn("place", F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 43) - 1))))


def _planes(width: int) -> np.ndarray:
    return np.random.default_rng(3).choice(np.array([-1, 1], np.int8), (max(1, width), PLANES))


def _per_row(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs that ``ends`` cuts ``values`` into; a run without values sums to 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), values])
    full = np.flatnonzero(np.diff(ends) > 0)
    out = np.zeros((len(ends) - 1, *values.shape[1:]), values.dtype)
    if len(full):
        out[full] = np.add.reduceat(total[1:], ends[:-1][full], axis=0)
    return out


def _gentle(n: int, length: int) -> Column:
    """The part of a document's length in its impacts: 50 + (50 n N) div L."""
    return (F.expr(f"(cast(50 as decimal(20,0)) * n * {n}) div {max(1, length)}").cast("long") + 50).alias("m")


def _impacts(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    counts = counts.astype(np.int64)
    return ((1_000_000_000 * counts) // (1000 * counts + 20 * m)).astype(np.int32)


def _scores(wanted: np.ndarray, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """Per row number in ``rows`` the sum of wanted weight times impact over its terms; every such row has a term."""
    at = ragged(starts[rows], sizes[rows])
    return np.add.reduceat(wanted[terms[at]] * impacts[at], np.concatenate([[0], np.cumsum(sizes[rows])[:-1]]).astype(np.int64))


def vocabulary_of(batch: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Numbers of the items, where each one's terms begin, the terms' numbers, and the sorted vocabulary."""
    flat = pa.array([t for r in batch for t in r["terms"]], pa.large_binary())
    coded = flat.dictionary_encode()
    starts = np.concatenate([[0], np.cumsum([len(r["terms"]) for r in batch])]).astype(np.int64)
    return np.array([r["item"] for r in batch], np.int64), starts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary


def prepare(batch: list, n: int, rows: DataFrame, top: int) -> Asked:
    """Weights, peaks and floors of a batch of items over the ``forward`` rows with their ``m``.

    A floor is the ``top``-th best score among a few documents per term, those with the largest impact in each of ``SLOTS``
    hash classes, so that many documents reach it; 0 where there are fewer.
    """
    numbers, starts, terms, vocabulary = vocabulary_of(batch)
    held = rows.select("place", "m", F.inline(F.arrays_zip("terms", "counts")))
    impact = F.expr("(1000000000L * counts) div (1000L * counts + 20L * m)")
    best = F.max(F.shiftleft(impact, 43).bitwiseOR(F.col("place"))).alias("best")
    known = write_out(held.groupBy("terms", F.pmod("place", F.lit(SLOTS)).alias("slot")).agg(F.count(F.lit(1)).alias("df"), best))
    weights, peaks = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    for r in known.groupBy("terms").agg(F.sum("df").alias("df"), F.shiftright(F.max("best"), 43).alias("peak")).toLocalIterator():  # a row per term of the items
        weights[r["terms"]], peaks[r["terms"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1))), r["peak"]
    asked = Asked(numbers, starts, terms, vocabulary, weights, np.zeros(len(numbers), np.int64), np.ones(len(terms), bool), top)
    shared = rows.sparkSession.sparkContext.broadcast((numbers, starts, terms, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers_, starts_, terms_, weights_ = shared.value
        wanted = np.zeros(len(weights_), np.int64)
        for part in batches:
            sizes = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            held_ = part.column(1).flatten().to_numpy(zero_copy_only=False)
            impacts = _impacts(part.column(2).flatten().to_numpy(zero_copy_only=False), np.repeat(part.column(0).to_numpy(), sizes))
            who, what = [], []
            for i in range(len(numbers_)):
                mine = terms_[starts_[i]:starts_[i + 1]]
                wanted[mine] = weights_[mine]
                got = _per_row(wanted[held_] * impacts, np.concatenate([[0], np.cumsum(sizes)]))
                wanted[mine] = 0
                got = np.sort(got[got > 0])[::-1][:top]
                who.append(np.full(len(got), i))
                what.append(got)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who), pa.int64()), pa.array(np.concatenate(what), pa.int64())], names=["i", "score"])

    champions = known.select(F.col("best").bitwiseAND(F.lit((1 << 43) - 1)).alias("place")).distinct()
    scored = rows.join(champions, "place", "left_semi").select("m", "terms", "counts").mapInArrow(score, "i long, score long")
    nth = Window.partitionBy("i").orderBy(F.col("score").desc())
    for r in scored.withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= top).filter(F.col("nth") == top).toLocalIterator():  # a row per item
        asked.floors[r["i"]] = r["score"]
    reach = weights * peaks
    for i in range(len(numbers)):
        mine = np.arange(starts[i], starts[i + 1])
        mine = mine[np.argsort(reach[terms[mine]], kind="stable")]
        asked.entries[mine[np.cumsum(reach[terms[mine]]) < asked.floors[i]]] = False
    return asked


def _coordinates(asked: Asked) -> dict[int, np.ndarray | None]:
    """Per entered term the terms of the items that enter it, which is what its summaries need; None for all."""
    by_term: dict[int, list[int]] = {}
    for i in range(len(asked.numbers)):
        here = asked.item(i)
        for t in asked.terms[here][asked.entries[here]].tolist():
            by_term.setdefault(t, []).append(i)
    found: dict[int, np.ndarray | None] = {}
    room = ALL_COORDINATES
    for t, items in by_term.items():
        size = sum(int(asked.starts[i + 1] - asked.starts[i]) for i in items)
        room -= size
        found[t] = np.unique(np.concatenate([asked.terms[asked.item(i)] for i in items])) if size <= len(asked.weights) * 4 and room > 0 else None
    return found


def build_segment(doc_ids: pa.Array, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, asked: Asked,
                  coordinates: dict[int, np.ndarray | None], planes: np.ndarray, block_docs: int = BLOCK_DOCS) -> dict:
    """The documents of a segment and the blocks of their posting lists."""
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    weighed = (asked.weights[terms] * impacts).astype(np.float32)
    direction = _per_row(weighed[:, None] * planes[terms], starts)
    direction /= np.maximum(np.linalg.norm(direction, axis=1, keepdims=True), 1e-9)
    entered = np.zeros(len(asked.weights), bool)
    entered[list(coordinates)] = True
    at = np.flatnonzero(entered[terms])
    at = at[np.argsort(terms[at], kind="stable")]
    who = np.repeat(np.arange(len(sizes)), sizes)[at]
    cuts = np.flatnonzero(np.diff(terms[at], prepend=-1))
    block_terms, block_sizes, members, summary_sizes, summary_terms, summary_impacts = [], [], [], [], [], []
    needed = np.zeros(len(asked.weights), bool)
    for first, last in zip(cuts, [*cuts[1:], len(at)]):
        term, docs = int(terms[at[first]]), who[first:last]
        if len(docs) > block_docs:
            pivot = np.argmax(direction[docs] @ direction[docs[::block_docs]].T, axis=1)
            docs, pivot = docs[order := np.argsort(pivot, kind="stable")], pivot[order]
            inner = np.cumsum(np.diff(pivot, prepend=pivot[0]) > 0)
        else:
            inner = np.zeros(len(docs), np.int64)
        wide = coordinates[term]
        held = ragged(starts[docs], sizes[docs])
        block = np.repeat(inner, sizes[docs])
        if wide is not None:
            needed[wide] = True
            keep = needed[terms[held]]
            needed[wide] = False
            held, block = held[keep], block[keep]
        cell = block * len(asked.weights) + terms[held]
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        opens = np.flatnonzero(np.diff(cell, prepend=-1))
        count = int(inner[-1]) + 1
        block_terms.append(np.full(count, term, np.int32))
        block_sizes.append(np.bincount(inner, minlength=count))
        members.append(docs)
        summary_sizes.append(np.bincount(cell[opens] // len(asked.weights), minlength=count))
        summary_terms.append(cell[opens] % len(asked.weights))
        summary_impacts.append(np.maximum.reduceat(impacts[held][order], opens))
    flat = lambda parts: np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return {"doc_ids": doc_ids, "sizes": sizes.astype(np.int32), "terms": terms, "impacts": impacts,
            "block_terms": flat(block_terms), "block_sizes": flat(block_sizes), "members": flat(members),
            "summary_sizes": flat(summary_sizes), "summary_terms": flat(summary_terms), "summary_impacts": flat(summary_impacts)}


_INTS = ("sizes", "terms", "impacts", "block_terms", "block_sizes", "members", "summary_sizes", "summary_terms", "summary_impacts")


def build(rows: DataFrame, asked: Asked, block_docs: int = BLOCK_DOCS, segment_postings: int = SEGMENT_POSTINGS) -> DataFrame:
    """The index, written: a row per segment with its documents' vectors and the blocks of its posting lists.

    ``terms`` and ``impacts`` hold the documents' vectors, ``sizes`` of them each; ``members`` the documents of each block,
    ``summary_terms`` and ``summary_impacts`` its maxima. Documents without a term of the items are in no list.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(asked)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_ = shared.value
        coordinates, planes = _coordinates(asked_), _planes(len(asked_.weights))
        for batch in batches:
            size = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(size)
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + segment_postings, side="right")))
                part, sizes = batch.slice(first, last - first), size[first:last]
                impacts = _impacts(part.column(3).flatten().to_numpy(zero_copy_only=False), np.repeat(part.column(1).to_numpy(), sizes))
                made = build_segment(part.column(0), sizes, part.column(2).flatten().to_numpy(zero_copy_only=False), impacts, asked_, coordinates, planes, block_docs)
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), made["doc_ids"])
                yield pa.RecordBatch.from_arrays([ids, *[pa.ListArray.from_arrays(pa.array([0, len(made[c])], pa.int32()), pa.array(made[c], pa.int32())) for c in _INTS]],
                                                 names=["doc_ids", *_INTS])
                first = last

    near = rows.filter(F.size("terms") > 0).repartitionByRange("alike", "place").sortWithinPartitions("alike", "place")
    return write_out(near.select("doc_id", "m", "terms", "counts").mapInArrow(cut, f"doc_ids array<{kind}>, " + ", ".join(f"{c} array<int>" for c in _INTS)))


def search_segment(segment: dict[str, np.ndarray], ids: np.ndarray, asked: Asked) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
    """Per item its number, the best documents of the segment, their scores, and how many blocks were entered and skipped."""
    starts = np.concatenate([[0], np.cumsum(segment["sizes"])]).astype(np.int64)
    sizes = segment["sizes"].astype(np.int64)
    first = np.concatenate([[0], np.cumsum(segment["block_sizes"])]).astype(np.int64)
    sum_sizes = segment["summary_sizes"].astype(np.int64)
    sum_starts = np.concatenate([[0], np.cumsum(sum_sizes)]).astype(np.int64)
    wanted = np.zeros(len(asked.weights), np.int64)
    met = np.zeros(len(sizes), bool)
    for i in range(len(asked.numbers)):
        here = asked.item(i)
        mine, entered = asked.terms[here], asked.terms[here][asked.entries[here]]
        left, right = np.searchsorted(segment["block_terms"], entered), np.searchsorted(segment["block_terms"], entered, side="right")
        blocks = ragged(left, right - left)
        if not len(blocks):
            continue
        wanted[mine] = asked.weights[mine]
        bounds = _scores(wanted, blocks, sum_starts, sum_sizes, segment["summary_terms"], segment["summary_impacts"])
        order = np.argsort(-bounds, kind="stable")
        blocks, bounds = blocks[order], bounds[order]
        floor = max(1, int(asked.floors[i]))
        best_docs, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, 8
        while at < len(blocks) and bounds[at] >= floor:
            now = blocks[at:at + step][bounds[at:at + step] >= floor]
            docs = np.unique(segment["members"][ragged(first[now], first[now + 1] - first[now])])
            docs = docs[~met[docs]]
            met[docs] = True
            if len(docs):
                got = _scores(wanted, docs, starts, sizes, segment["terms"], segment["impacts"])
                best_docs, best = np.concatenate([best_docs, docs[got >= floor]]), np.concatenate([best, got[got >= floor]])
                kept = np.lexsort((ids[best_docs], -best))[:asked.top]
                best_docs, best = best_docs[kept], best[kept]
                if len(best) == asked.top:
                    floor = max(floor, int(best[-1]))
            at += len(now)
            step *= 2
            if len(now) == 0:
                break
        wanted[mine] = 0
        met[:] = False
        yield i, best_docs, best, at, len(blocks) - at


def search(index: DataFrame, asked: Asked) -> DataFrame:
    """(item, doc_id, score): the best documents of every segment for each item, at most ``top`` of them."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    shared = index.sparkSession.sparkContext.broadcast(asked)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_ = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                segment = {c: batch.column(j + 1)[r].values.to_numpy(zero_copy_only=False) for j, c in enumerate(_INTS)}
                held = batch.column(0)[r].values
                by_id = np.empty(len(held), np.int64)  # places in ascending order of ids, nulls last
                by_id[pc.sort_indices(held, null_placement="at_end").to_numpy()] = np.arange(len(held))
                found = list(search_segment(segment, by_id, asked_))
                docs = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([asked_.numbers[f[0]] for f in found], [len(f[1]) for f in found]).astype(np.int64), pa.int64()), held.take(pa.array(docs)),
                    pa.array(np.concatenate([f[2] for f in found]) if found else docs, pa.int64())], names=["item", "doc_id", "score"])

    return index.mapInArrow(read, f"item long, doc_id {kind}, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = 50, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
           block_docs: int = BLOCK_DOCS, segment_postings: int = SEGMENT_POSTINGS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0, exactly; equal scores by ascending doc_id.

    Terms, weights and scores are those of the contract of this operator. Null and empty texts have no terms: such a document
    is never found and does not count, such an item has no rows. Rows that share a doc_id are documents of their own, a null
    doc_id comes last among equals. Items of the same id and text count once; other items of one id are ranked one by one.
    Whole texts are read, however long. Other columns are not read. Empty tables give an empty result.
    """
    asked_items = item_terms(items, item_key, item_text)
    found = None
    for batch in batches_of(asked_items, batch_bytes):
        held = batch.select("item", "terms").collect()  # bounded by batch_bytes
        rows = forward(docs, vocabulary_of(held)[3], key, text)
        n, length = rows.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        rows = rows.withColumn("m", _gentle(n, length or 0))
        asked = prepare(held, n, rows, top)
        part = search(build(rows, asked, block_docs, segment_postings), asked)
        found = part if found is None else found.unionByName(part)
    doc_kind = two_columns(docs, key, text).schema["doc_id"].dataType.simpleString()
    item_kind = asked_items.schema["item_id"].dataType.simpleString()
    if found is None:
        return docs.sparkSession.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(asked_items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
