"""Exact removal of byte strings that occur more than once in the corpus, by suffix arrays of bounded groups.

Which bytes lie in a string of ``LENGTH`` bytes that starts anywhere else too? Every such window is handed to one anchor,
a position chosen by content alone (the least hash in some stretch of ``STRETCH`` positions), at least ``STRETCH - 1`` bytes
behind the window's start. Equal windows have equal anchors at equal offsets, and all windows of an anchor hold the same
middle part, the core. So windows only need comparing within the group of anchors with one core:

* anchors whose whole surroundings (all their windows) occur twice need no comparison;
* the others are sorted: the core and what all members share around it becomes one symbol, a member is the bytes left of it,
  that symbol, and the bytes right of it, and a suffix array over the members finds, for every window, whether a
  neighbour in suffix order agrees on all of it;
* groups with very many members are split by further shared bytes first, so no sort sees more than ``GROUP`` members.

The suffix arrays are built linearly: suffixes are grouped by their Lyndon prefix, groups are processed in descending order
through pointers to the previous smaller group, and the suffixes' order within groups follows in one ascending pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import name, require
from quarry.llm.common import flat_bytes, text_slices
from quarry.session import write_out

LENGTH = 400
GRAM, STRETCH = 16, 64  # bytes an anchor's hash sees; positions among which the least hash becomes an anchor
GROUP = 256
BATCH_SYMBOLS = 50_000
SMALL_KEYS = 2_000_000  # keys that may be broadcast: 16 MB
_P = 0x9E3779B97F4A7C15
_POWERS = [np.uint64(pow(_P, 1 << k, 1 << 64)) for k in range(4)]


def suffix_array(text: Sequence[int]) -> list[int]:
    """Order of the suffixes of ``text`` (positive integers), a suffix before all that it begins."""
    n = len(text) + 1
    symbols = [*text, 0]  # the end, smaller than any symbol
    order = sorted(range(n), key=symbols.__getitem__)
    place, first, behind, last = [0] * n, [0] * n, [0] * n, None  # place in the order; first place of the own group; by first place: the place behind the group
    for i, s in enumerate(order):
        if symbols[s] != last:
            last, start = symbols[s], i
        place[s], first[s] = i, start
        behind[start] = i + 1
    # Groups in descending order. ``before[s]``: the last suffix in front of s whose group is smaller.
    before = [-1] * n
    top = n
    while top > 0:
        start = first[order[top - 1]]
        met: dict[int, int] = {}
        group = sorted(order[start:top]) if top - start > 1 else order[start:top]
        for s in group:
            p = s - 1
            while p >= 0 and first[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0:
                met[p] = met.get(p, 0) + 1
        # A suffix met k times goes on with k copies of this group's prefix: more copies, larger suffix.
        by_copies: dict[int, list[int]] = {}
        for p, k in met.items():
            by_copies.setdefault(k, []).append(p)
        for k in sorted(by_copies, reverse=True):
            moved: dict[int, int] = {}  # group: how many of its suffixes leave it for a new group at its end
            chosen = by_copies[k]
            for p in chosen:
                own = first[p]
                moved[own] = moved.get(own, 0) + 1
                to = behind[own] - moved[own]
                other, at = order[to], place[p]
                order[to], order[at] = p, other
                place[p], place[other] = to, at
            for own, size in moved.items():
                end = behind[own]
                behind[end - size] = end
                if end - size != own:
                    behind[own] = end - size
            for p in chosen:
                first[p] = behind[first[p]] if place[p] >= behind[first[p]] else first[p]
        top = start
    # Within groups: a suffix comes after the smaller one that follows its Lyndon prefix.
    free = list(range(n))  # by first place of a group: where its next suffix goes
    done = [False] * n
    order[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        p = order[i] - 1
        while p >= 0 and not done[p]:
            own = first[p]
            order[free[own]] = p
            free[own] += 1
            done[p] = True
            p = before[p]
    return order[1:]


def shared_prefixes(text: Sequence[int], order: Sequence[int]) -> list[int]:
    """Per place in the suffix order the length of the prefix shared with the suffix before it (0 at the first)."""
    n = len(text)
    place = [0] * n
    for i, s in enumerate(order):
        place[s] = i
    out, h = [0] * n, 0
    for s in range(n):
        i = place[s]
        if i == 0:
            h = 0
            continue
        t = order[i - 1]
        end = n - max(s, t)
        while h < end and text[s + h] == text[t + h]:
            h += 1
        out[i] = h
        if h:
            h -= 1
    return out


def anchors(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions that have the least hash (the last of equals) among some STRETCH positions of one text."""
    if len(raw) < GRAM + STRETCH:
        return np.zeros(0, np.int64)
    h = raw.astype(np.uint64) + np.uint64(1)
    for k in range(4):
        step = 1 << k
        h = h[:-step] * _POWERS[k] + h[step:]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h &= np.uint64(0xFFFFFFFF00000000)
    h |= np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64)
    for k in range(6):
        h = np.minimum(h[:-(1 << k)], h[1 << k:])
    least = (np.uint64(0xFFFFFFFF) - (h & np.uint64(0xFFFFFFFF))).astype(np.int64)
    within = np.ones(len(least), dtype=bool)  # stretches that lie in one text
    for e in ends[:-1].tolist():
        within[max(0, e - STRETCH - GRAM + 2):e] = False
    least = least[within]
    return least[np.append(True, least[1:] != least[:-1])] if len(least) else least


def surroundings(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first, last): anchors that have windows, and the first and last start of their windows, as flat positions."""
    at = anchors(raw, ends)
    owner = np.searchsorted(ends, at, side="right")
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    follows = np.append(False, owner[1:] == owner[:-1]) if len(at) else np.zeros(0, bool)
    gap = STRETCH - 1
    first = np.maximum(starts[owner], np.where(follows, np.append(0, at[:-1]) - gap + 1 if len(at) else at, np.iinfo(np.int64).min))
    last = np.minimum(at - gap, ends[owner] - length)
    some = last >= first
    return owner[some], at[some], first[some], last[some]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in text_slices(batches, limit=1 << 20):
        yield (batch, *flat_bytes(batch.column("text")))


def _core_span(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that all possible windows of an anchor hold."""
    return at - (STRETCH - 1), at - 2 * (STRETCH - 1) + length


def _hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    view, digest = memoryview(np.ascontiguousarray(raw)), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[a:b]) for a, b in zip(starts.tolist(), stops.tolist())), np.uint64, len(starts)).view(np.int64)


def _cores(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, raw, ends in _slices(batches):
        _, at, _, _ = surroundings(raw, ends, length)
        yield pa.RecordBatch.from_arrays([pa.array(_hashes(raw, *_core_span(at, length)))], names=["core"])


def _places(length: int, sides: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per anchor: core, hash of all its windows, document, where the windows begin and end; with ``sides`` the bytes around the core."""
    for batch, raw, ends in _slices(batches):
        owner, at, first, last = surroundings(raw, ends, length)
        begin = (np.concatenate([[0], ends[:-1]]) if len(ends) else ends)[owner]
        a, b = _core_span(at, length)
        columns = [pa.array(_hashes(raw, a, b)), pa.array(_hashes(raw, first, last + length)), batch.column("doc_id").take(pa.array(owner)),
                   pa.array(a - begin), pa.array(first - begin), pa.array(last - begin)]
        names = ["core", "full", "doc_id", "core_at", "first", "last"]
        if sides:
            whole = raw.tobytes()
            columns += [pa.array([whole[x:y] for x, y in zip(first.tolist(), a.tolist())], pa.binary()),
                        pa.array([whole[x:y] for x, y in zip(b.tolist(), (last + length).tolist())], pa.binary())]
            names += ["left", "right"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def repeated_windows(members: Sequence[tuple[bytes, bytes]], low: int, high: int) -> list[list[int]]:
    """Per member (left, right) of one group the windows that another member holds too.

    Window a takes the last a bytes of ``left``, the core and the first ``STRETCH - 1 - a`` bytes of ``right``; a runs from ``low`` to ``high``.
    """
    return _repeated([(members, low, high)])[0]


def _repeated(groups: Sequence[tuple[Sequence[tuple[bytes, bytes]], int, int]]) -> list[list[list[int]]]:
    """``repeated_windows`` for several groups with one suffix array."""
    span = STRETCH - 1
    text: list[int] = []
    laid = []
    for g, (members, _, _) in enumerate(groups):
        lefts, rights = [m[0] for m in members], [m[1] for m in members]
        near = len(_common_prefix([x[::-1] for x in lefts]))  # bytes next to the core that all members share
        far = len(_common_prefix(rights))
        starts = []
        for x, y in zip(lefts, rights):
            left = x[:len(x) - near]
            starts.append((len(text), len(left)))
            text += [b + 1 for b in left]
            text.append(258 + g)
            text += [b + 1 for b in y[far:]]
            text.append(257)  # between members; larger than any byte
        laid.append((near, far, starts))
    order = suffix_array(text)
    shared = shared_prefixes(text, order)
    best = [0] * len(text)
    for i, s in enumerate(order):
        best[s] = max(shared[i], shared[i + 1] if i + 1 < len(shared) else 0)
    out = []
    for (members, low, high), (near, far, starts) in zip(groups, laid):
        found = []
        for (x, y), (start, left) in zip(members, starts):
            mine = []
            for a in range(max(low, span - len(y)), min(high, len(x)) + 1):
                before, after = max(a - near, 0), max(span - a - far, 0)
                if best[start + left - before] >= before + 1 + after or before + after == 0:
                    mine.append(a)
            found.append(mine)
        out.append(found)
    return out


def _common_prefix(texts: Sequence[bytes]) -> bytes:
    low, high = min(texts), max(texts)
    k = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
    return low[:k]


def _sorted_groups(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive ordered by group; the covered spans of the members that occur once leave."""
    waiting: list[tuple[list, int, int]] = []
    key, symbols = None, 0

    def settle(groups: list) -> pa.RecordBatch:
        groups = [g for g in groups if len(g[0]) > 1]
        rows = []
        if groups:
            found = _repeated([([(m["left"], m["right"]) for m in members], low, high) for members, low, high in groups])
            for (members, _, _), windows in zip(groups, found):
                for m, mine in zip(members, windows):
                    if m["n"] > 1:
                        continue
                    at = 0
                    while at < len(mine):  # runs of neighbouring windows make one span
                        to = at
                        while to + 1 < len(mine) and mine[to + 1] == mine[to] + 1:
                            to += 1
                        rows.append((m["doc_id"], m["core_at"] - mine[to], m["core_at"] - mine[at] + length))
                        at = to + 1
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["doc_id", "start", "stop"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["key"] != key:
                if symbols > BATCH_SYMBOLS:
                    yield settle(waiting)
                    waiting, symbols = [], 0
                key = row["key"]
                waiting.append(([], row["low"], row["high"]))
            waiting[-1][0].append(row)
            symbols += len(row["left"]) + len(row["right"]) + 2
    yield settle(waiting)


def _among(rows: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    return rows.join(F.broadcast(wanted) if wanted.count() <= SMALL_KEYS else wanted, on, "left_semi")


def _split(states: DataFrame) -> DataFrame:
    """Halve the windows of every state; each half's key adds the bytes that all its windows hold."""
    span = STRETCH - 1
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high")))
    cut = states.withColumn("half", F.explode(halves)).withColumn("low", F.col("half.low")).withColumn("high", F.col("half.high")).drop("half")
    cut = cut.filter((F.octet_length("left") >= F.col("low")) & (F.octet_length("right") >= span - F.col("high"))
                     & (F.greatest(F.col("low"), span - F.octet_length("right")) <= F.least(F.col("high"), F.octet_length("left"))))
    near = F.expr("substring(left, octet_length(left) - low + 1, low)")
    far = F.expr(f"substring(right, 1, {span} - high)")
    return cut.withColumn("key", F.xxhash64("core", "low", "high", near, far))


def repeated_spans(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """(doc_id, start, stop): byte spans that lie in a string of ``length`` bytes which starts anywhere else too; they may overlap.

    Strings lie within one text. Null texts and texts shorter than ``length`` hold none; rows with null keys take no part;
    keys must be unique (a repeated row would find itself). ``length`` is at least 4 * STRETCH.
    """
    require(docs, key, text)
    if length < 4 * STRETCH:
        raise ValueError(f"length must be {4 * STRETCH} or more")
    span = STRETCH - 1
    slim = docs.select(name(key).cast("long").alias("doc_id"), name(text).cast("string").alias("text")).filter(
        f"doc_id is not null and octet_length(text) >= {length}")
    twice = write_out(slim.mapInArrow(partial(_cores, length), "core long").groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core"))
    fields = "core long, full long, doc_id long, core_at long, first long, last long"
    hits = write_out(_among(slim.mapInArrow(partial(_places, length, False), fields), twice, "core"))
    fulls = write_out(hits.groupBy("core", "full").agg(F.count(F.lit(1)).alias("n")))
    whole = hits.join(fulls.filter("n > 1").select("core", "full"), ["core", "full"], "left_semi").select(
        "doc_id", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    mixed = write_out(fulls.groupBy("core").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("core"))
    members = _among(slim.mapInArrow(partial(_places, length, True), fields + ", left binary, right binary"), mixed, "core")
    members = members.groupBy("core", "full").agg(F.min(F.struct("doc_id", "core_at", "left", "right")).alias("m"), F.count(F.lit(1)).alias("n"))
    states = write_out(members.select("core", "n", "m.*", F.lit(0).alias("low"), F.lit(span).alias("high"), F.col("core").alias("key")))
    spans = write_out(whole)
    while True:
        sizes = write_out(states.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
        few = write_out(sizes.filter(F.col("members") <= group).select("key"))
        dealt = _among(states, few, "key").repartition(F.col("key")).sortWithinPartitions("key")
        found = dealt.select("key", "n", "doc_id", "core_at", "left", "right", "low", "high").mapInArrow(
            partial(_sorted_groups, length), "doc_id long, start long, stop long")
        spans = spans.unionByName(write_out(found))
        large = write_out(sizes.filter(F.col("members") > group).select("key"))
        if not large.take(1):
            return spans
        hot = _among(states, large, "key")
        single = hot.filter("low = high and n = 1")  # all members of such a group share their one window
        spans = spans.unionByName(write_out(single.select("doc_id", (F.col("core_at") - F.col("low")).alias("start"), (F.col("core_at") - F.col("low") + length).alias("stop"))))
        states = write_out(_split(hot.filter("low < high")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        rows = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw, kept, at, removed, runs = text.encode(), [], 0, 0, 0
            reach = -1  # end of the run of removed bytes so far
            for s in spans or ():
                if s["start"] > reach:
                    kept.append(raw[max(at, 0):s["start"]])
                    runs += 1
                    removed += s["stop"] - s["start"]
                    reach = s["stop"]
                elif s["stop"] > reach:
                    removed += s["stop"] - reach
                    reach = s["stop"]
                at = reach
            kept.append(raw[max(at, 0):])
            rows.append((len(raw), removed, runs, hashlib.sha256(b"".join(kept)).hexdigest()))
        a, b, c, d = zip(*rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup_report(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key as ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` of the bytes that stay.

    A null text is empty; an empty table gives no rows; other columns are not read.
    """
    gathered = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans")).withColumnRenamed("doc_id", "_key")
    joined = docs.select(name(key).cast("long").alias("doc_id"), name(text).cast("string").alias("text")).join(gathered, F.col("doc_id") == F.col("_key"), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
