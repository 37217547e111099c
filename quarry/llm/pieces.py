"""SentencePiece encoding and decoding for merge-type vocabularies.

A segment's symbols, at first its characters, meet in an agenda of adjacent pairs ordered by the score of the piece they
form, the leftmost pair first among equals; the best pair merges until none forms a piece. Many short segments run in lock
step: every round takes the best pair of each segment with one segmented minimum, so a batch needs as many numpy rounds as
its longest word has merges. Long segments use a heap. A pair can only merge across two characters that stand side by side
in some piece, so texts fall apart before each run of blanks, and equal segments are encoded once per worker.

In every Arrow batch the segments met for the first time are checked against the sentencepiece library, and every decoded
text is the library's own; a difference stops the job.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import ragged, text_slices, two_columns

BLANK = "▁"
LOCK_STEP = 48  # symbols of a segment, beyond which the heap is used
CACHED_SEGMENTS = 400_000
NONE = np.int32(2 ** 31 - 1)
CODE_POINTS = 0x110000
#: Kinds of pieces and the kind of model in the library's file format: fixed values.
NORMAL, UNKNOWN, CONTROL, BYTE, MERGE_MODEL = 1, 2, 3, 6, 2


class Pieces:
    """The merge table of one model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        rules, trained = model.normalizer_spec, model.trainer_spec
        kinds = [p.type for p in model.pieces]
        if trained.model_type != MERGE_MODEL or not trained.byte_fallback or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only merge-type models with byte fallback and without user-defined or unused pieces are supported")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces or trained.treat_whitespace_as_suffix:
            raise ValueError("only models that keep the text as it is, with a blank put before it, are supported")
        self.size = len(kinds)
        words = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.cuts_at_blanks = not any(BLANK in w.lstrip(BLANK) for w in words)
        self.symbol_of = np.arange(CODE_POINTS, dtype=np.int32) + self.size  # a character without a piece keeps its code point
        for w, i in words.items():
            if len(w) == 1:
                self.symbol_of[ord(w)] = i

        def symbol(part: str) -> int | None:
            return int(self.symbol_of[ord(part)]) if len(part) == 1 else words.get(part)

        pairs = {}
        for w, i in words.items():
            for cut in range(1, len(w)):
                left, right = symbol(w[:cut]), symbol(w[cut:])
                if left is not None and right is not None:
                    pairs[left * (self.size + CODE_POINTS) + right] = i
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.formed = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int32)
        scores = np.array([p.score for p in model.pieces])
        self.order = np.unique(-scores, return_inverse=True)[1].astype(np.int32)  # 0: the best score
        self.byte_ids = np.array([self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.raw = [p.piece.replace(BLANK, " ").encode() if p.type == NORMAL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" for p in model.pieces]
        self.silent = {i for i, k in enumerate(kinds) if k in (CONTROL, UNKNOWN)}
        self.blank_first = {i for w, i in words.items() if w[0] == BLANK}
        self.end = self.library.eos_id()
        self.shown = [str(i) for i in range(self.size)]
        self.kind = np.uint16 if self.size <= 1 << 16 else np.int32
        self.seen: dict[str, bytes] = {}  # ids of the segments met so far

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the agenda, piece formed) of adjacent symbols; NONE where they form no piece."""
        key = left.astype(np.int64) * (self.size + CODE_POINTS) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        piece = self.formed[at]
        return np.where(self.keys[at] == key, self.order[piece], NONE), piece

    def lock_step(self, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all segments side by side: (symbols, symbols per segment) in the same order."""
        own = np.arange(len(sizes))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank, piece = self.pair(sym, np.append(sym[1:], 0))
        rank[np.cumsum(sizes) - 1] = NONE
        while len(own):
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(rank, starts)
            over = best == NONE
            if over.any():
                out = np.repeat(over, sizes)
                done.append((own[over], sizes[over], sym[out]))
                sym, rank, piece, own, best, sizes = sym[~out], rank[~out], piece[~out], own[~over], best[~over], sizes[~over]
                if not len(own):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            owner = np.repeat(np.arange(len(own)), sizes)[hits]
            at = hits[np.diff(owner, prepend=-1) != 0]  # the leftmost best pair of each segment
            sym[at] = piece[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            sym, rank, piece = sym[keep], rank[keep], piece[keep]
            at = at - np.arange(len(at))
            sizes = sizes - 1
            ends = np.cumsum(sizes)
            rank[at], piece[at] = self.pair(sym[at], sym[np.minimum(at + 1, len(sym) - 1)])
            rank[ends - 1] = NONE
            left = at[at > ends - sizes] - 1
            rank[left], piece[left] = self.pair(sym[left], sym[left + 1])
        order = np.argsort(np.concatenate([d[0] for d in done]), kind="stable")
        counts = np.concatenate([d[1] for d in done])
        flat = np.concatenate([d[2] for d in done])
        starts = np.cumsum(counts) - counts
        return flat[ragged(starts[order], counts[order])], counts[order]

    def by_heap(self, sym: list[int]) -> list[int]:
        """The same agenda for one long segment."""
        after = list(range(1, len(sym) + 1))
        before = list(range(-1, len(sym) - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(lefts: list[int]) -> None:
            pairs = [(i, after[i]) for i in lefts if i >= 0 and after[i] < len(sym)]
            if pairs:
                rank, piece = self.pair(np.array([sym[i] for i, _ in pairs]), np.array([sym[j] for _, j in pairs]))
                for (i, j), r, p in zip(pairs, rank.tolist(), piece.tolist()):
                    if r != NONE:
                        heapq.heappush(agenda, (r, i, sym[i], sym[j], p))

        offer(list(range(len(sym))))
        while agenda:
            _, i, left, right, formed = heapq.heappop(agenda)
            j = after[i]
            if sym[i] != left or j >= len(sym) or sym[j] != right:
                continue  # one of the two has merged elsewhere
            sym[i], sym[j] = formed, -1
            after[i] = after[j]
            if after[i] < len(sym):
                before[after[i]] = i
            offer([before[i], i])
        return [s for s in sym if s >= 0]

    def with_bytes(self, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the ids of their UTF-8 bytes."""
        lone = sym >= self.size
        if not lone.any():
            return sym, sizes
        point = np.where(lone, sym - self.size, 0)
        width = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
        ends = np.cumsum(width)
        out = np.repeat(np.where(lone, 0, sym), width)
        for j in range(4):
            some = lone & (width > j)
            shift = 6 * (width[some] - 1 - j)
            bits = point[some] >> shift
            byte = np.where(width[some] == 1, bits, np.array([0, 0, 0xC0, 0xE0, 0xF0])[width[some]] | bits) if j == 0 else 0x80 | (bits & 0x3F)
            out[(ends - width)[some] + j] = self.byte_ids[byte]
        upto = np.concatenate([[0], ends])[np.cumsum(sizes)]
        return out, np.diff(upto, prepend=0)

    def segments(self, text: str) -> list[str]:
        """The parts of a text that never merge with each other, each without its first blank."""
        if not text:
            return []
        if not self.cuts_at_blanks:
            return [text.replace(" ", BLANK)]
        if "  " in text or BLANK in text or text[0] == " " or text[-1] == " ":
            return [s[1:] for s in re.findall(f"{BLANK}+[^{BLANK}]*", BLANK + text.replace(" ", BLANK))]
        return text.split(" ")

    def learn(self, new: list[str]) -> None:
        """Encode segments that no earlier batch held."""
        short = [s for s in new if len(s) < LOCK_STEP]
        if short:
            points = np.frombuffer((BLANK + BLANK.join(short)).encode("utf-32-le") if all(BLANK not in s for s in short)
                                   else "".join(BLANK + s for s in short).encode("utf-32-le"), np.uint32)
            ids, counts = self.with_bytes(*self.lock_step(self.symbol_of[points].copy(), np.array([len(s) + 1 for s in short])))
            cuts = np.cumsum(counts).tolist()
            flat, start = ids.tolist(), 0
            for s, stop in zip(short, cuts):
                self.keep(s, flat[start:stop])
                start = stop
        for s in new:
            if len(s) >= LOCK_STEP:
                sym = self.by_heap(self.symbol_of[np.frombuffer((BLANK + s).encode("utf-32-le"), np.uint32)].tolist())
                self.keep(s, self.with_bytes(np.array(sym), np.array([len(sym)]))[0].tolist())

    def keep(self, segment: str, ids: list[int]) -> None:
        self.seen[segment] = np.array(ids, dtype=self.kind).tobytes()

    def check(self, segments: list[str]) -> None:
        """Compare with the library, which puts the same blank before a text."""
        theirs = self.library.encode([s.replace(BLANK, " ") for s in segments], num_threads=1)
        for s, expected in zip(segments, theirs, strict=True):
            if s and np.array(expected, dtype=self.kind).tobytes() != self.seen[s]:
                raise ValueError(f"the library encodes {s[:80]!r} otherwise")

    def encode(self, texts: Sequence[str]) -> list[tuple[str, list[int]]]:
        """Per text its ids, as decimal text and as numbers, without an end id."""
        parts = [self.segments(t) for t in texts]
        wanted = set().union(*parts)
        if len(self.seen) + len(wanted) > CACHED_SEGMENTS:
            self.seen = {}
        new = sorted(wanted.difference(self.seen))
        for at in range(0, len(new), 50_000):
            self.learn(new[at:at + 50_000])
            self.check(new[at:at + 50_000])
        out = []
        for own in parts:
            ids = np.frombuffer(b"".join([self.seen[s] for s in own]), self.kind).tolist()
            out.append((" ".join([self.shown[i] for i in ids]), ids))
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: pieces joined, runs of byte ids as UTF-8 with a replacement mark per stray byte, the first blank dropped."""
        raw, parts, start = self.raw, [], 0
        if self.silent.isdisjoint(ids[:-1]):
            ids = ids[:-1] if len(ids) and ids[-1] in self.silent else ids
            text = _readable(b"".join([raw[x] for x in ids]))
            return text[1:] if len(ids) and ids[0] in self.blank_first else text
        for stop in [*(i for i, x in enumerate(ids) if x in self.silent), len(ids)]:  # a control id ends a run of bytes
            if stop > start:
                parts.append(_readable(b"".join([raw[x] for x in ids[start:stop]])))
            start = stop + 1
        first = next((x for x in ids if x not in self.silent), None)
        text = "".join(parts)
        return text[1:] if first in self.blank_first else text


def _readable(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):  # one mark for each byte that belongs to no character
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at:at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)  # kept by the worker, so later tasks find its segments


def round_trip(model: Pieces, texts: list[str]) -> Iterator[tuple[str, list[int], str]]:
    """Ids as text and as numbers, end id included, and the library's text of them, which must be that of ``decode``."""
    for shown, ids in model.encode(texts):
        ids.append(model.end)
        decoded = model.library.decode(ids)
        if decoded != model.decode(ids):
            raise ValueError(f"the library decodes otherwise: {ids[:20]}")
        yield f"{shown} {model.end}".lstrip(), ids, decoded


def _digests(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    for batch in text_slices(batches, limit=2 << 20):
        rows = [(len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                for shown, ids, decoded in round_trip(model, batch.column("text").to_pylist())]
        counts, first, second = zip(*rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                                         names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    for batch in text_slices(batches, limit=2 << 20):
        rows = [(ids, decoded) for _, ids, decoded in round_trip(model, batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.string())],
                                         names=["doc_id", "ids", "decoded"])


def _decoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    for batch in batches:
        texts = [model.decode(ids) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def digests(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``n_tokens`` with the end id, ``ids_sha256``, ``decoded_sha256``.

    A null or empty text has the end id alone. Rows stay apart, equal ones and null keys included; an empty table gives none.
    Only the key and text columns are read.
    """
    slim = two_columns(docs, key, text)
    return slim.mapInArrow(partial(_digests, model), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``ids`` (end id included) and the ``decoded`` text; cases as in ``digests``."""
    slim = two_columns(docs, key, text)
    return slim.mapInArrow(partial(_encoded, model), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Per row of (``doc_id``, ``ids``) its ``doc_id`` and ``text``; null ids give an empty text."""
    from pyspark.sql import functions as F

    slim = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return slim.mapInArrow(partial(_decoded, model), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, text string")
