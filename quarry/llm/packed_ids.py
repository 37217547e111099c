"""Token ids as fixed-width bit-packed files.

Documents are dealt by ranges of their key, so file order is key order. Every file is a run of blocks: a header, the keys
and id counts of the block's documents, and their ids, each in the least number of bits that holds the vocabulary. The last
record of a file lists where its blocks begin, which gives random access; a block unpacks with a few numpy operations.

The files are written by Spark's own text writer (each record ends in one line feed), so a lost executor's attempt never
leaves half a file, and read back as binary files from whatever store Spark reaches.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ragged, split_words, text_slices, two_columns
from quarry.session import scratch_path

BLOCK_IDS = 1 << 18
FILE_TEXT_BYTES = 16 << 20
CACHED_WORDS = 400_000
HEAD = struct.Struct("<4sIQQ")  # mark, bits, documents, ids
TAIL = struct.Struct("<4sIQQ")  # mark, blocks, documents, ids of the file
BLOCK_MARK, FILE_MARK = b"QIDB", b"QIDF"


def width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, math.ceil(math.log2(max(2, vocabulary))))


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit string: id k takes bits ``k * bits`` to ``(k + 1) * bits - 1``; padded to whole 8 bytes."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit into {bits} bits")
    if bits in (8, 16, 32):
        body = ids.astype(f"<u{bits // 8}", copy=False).tobytes()
        return body + bytes(-len(body) % 8)
    at = np.arange(len(ids), dtype=np.uint64) * np.uint64(bits)
    words = np.zeros((len(ids) * bits + 63) // 64 + 1, dtype=np.uint64)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    value = ids.astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))  # the first id that begins in each word
    if len(ids):
        words[word[first]] = np.bitwise_or.reduceat(value << shift, first)
        over = np.flatnonzero(shift + np.uint64(bits) > np.uint64(64))  # one id at most runs over the end of a word
        words[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
    return words[:-1].tobytes()


def unpack(body: bytes | memoryview, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from id ``first`` on."""
    if bits in (8, 16, 32):
        return np.frombuffer(body, f"<u{bits // 8}", count, first * bits // 8).astype(np.uint32)
    words = np.append(np.frombuffer(body, "<u8", len(body) // 8), np.uint64(0))
    at = (np.arange(count, dtype=np.uint64) + np.uint64(first)) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (((words[word] >> shift) | high) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def block(keys: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """One block: header, keys, whether a key is known, ids per document, packed ids."""
    flags = known.astype(np.uint8).tobytes()
    return (HEAD.pack(BLOCK_MARK, bits, len(keys), len(ids)) + keys.astype("<i8").tobytes() + counts.astype("<u8").tobytes()
            + flags + bytes(-len(flags) % 8) + pack(ids, bits))


def open_block(data: memoryview, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, memoryview]:
    """Keys, known flags, id counts, bits and packed ids of the block at byte ``at``."""
    mark, bits, docs, ids = HEAD.unpack_from(data, at)
    if mark != BLOCK_MARK:
        raise ValueError(f"no block at byte {at}")
    at += HEAD.size
    keys = np.frombuffer(data, "<i8", docs, at)
    counts = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
    known = np.frombuffer(data, np.uint8, docs, at + 16 * docs).astype(bool)
    at += 16 * docs + docs + (-docs % 8)
    size = ids * bits // 8 + (-(ids * bits // 8) % 8) if bits in (8, 16, 32) else (ids * bits + 63) // 64 * 8
    return keys, known, counts, bits, data[at:at + size]


def block_offsets(data: memoryview) -> np.ndarray:
    """Where the blocks of a file begin, from its last record."""
    mark, blocks, _, _ = TAIL.unpack_from(data, len(data) - 1 - TAIL.size)
    if mark != FILE_MARK or data[-1] != 10:
        raise ValueError("not a file of packed ids, or cut short")
    return np.frombuffer(data, "<u8", blocks, len(data) - 1 - TAIL.size - 8 * blocks)


def read_ids(data: bytes, key: int) -> np.ndarray | None:
    """The ids of the first document with ``key`` in one file, unpacking nothing else."""
    view = memoryview(data)
    for at in block_offsets(view).tolist():
        keys, known, counts, bits, body = open_block(view, at)
        hit = np.flatnonzero(known & (keys == key))
        if len(hit):
            return unpack(body, bits, int(counts[:hit[0]].sum()), int(counts[hit[0]]))
    return None


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Ids of whole texts through the tokenizers library, each distinct word encoded once per worker.

    Holds for tokenizers that lower-case, drop white space and split letters from punctuation: a text's ids are then the
    ids of its words in order. Texts in which the name of an added token occurs are encoded whole, and those in which a mark
    combines with an ASCII capital, as the tokenizer composes letters before it lower-cases them. The cache of words is
    emptied when it is full, so memory stays bounded.
    """

    #: A letter before ASCII punctuation other than the apostrophe and the bar. Only letters that stay one letter when they
    #: are composed and lower-cased; others, such as the capital i with a dot, would leave a combining mark to the punctuation.
    SEAM = r"([a-zÀ-ÖØ-öø-įı-ɏ])([!-&(-/:-@\[-`{}~])"
    COMBINED = r"[A-Z]\pM"

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([""], pa.large_string())  # the words known, and where their ids lie in ``flat``
        self.starts, self.sizes, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, self.kind)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for at in range(0, len(texts), 4096):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[at:at + 4096], add_special_tokens=False)]
        return out

    def _learn(self, words: pa.Array) -> None:
        found = self._encode(words.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
        self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(found), self.kind, int(sizes.sum())))
        self.sizes = np.append(self.sizes, sizes)
        self.words = pa.concat_arrays([self.words, words])

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids per text, all ids), ``end`` after each text."""
        named = np.zeros(len(texts), dtype=bool)
        for mark in self.names:
            named |= pc.match_substring(texts, mark, ignore_case=True).to_numpy(zero_copy_only=False)
        named |= pc.match_substring_regex(texts, self.COMBINED).to_numpy(zero_copy_only=False)
        whole = dict(zip(np.flatnonzero(named).tolist(), self._encode(texts.filter(pa.array(named)).to_pylist())))
        plain = pc.if_else(pa.array(named), "", texts) if whole else texts
        for mark in "\n\r\t":
            plain = pc.replace_substring(plain, mark, " ")
        ends, words, distinct = split_words(pc.replace_substring_regex(pc.ascii_lower(plain), self.SEAM, r"\1 \2"))
        if len(self.words) > CACHED_WORDS:
            self._forget()
        known = pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = known < 0
        known[new] = len(self.words) + np.arange(int(new.sum()))
        self._learn(distinct.filter(pa.array(new)))
        place = known[words]
        lengths = self.sizes[place]
        ids = self.flat[ragged(self.starts[place], lengths)]
        upto = np.concatenate([[0], np.cumsum(lengths)])[ends]
        if whole:
            cuts = np.split(ids, upto[:-1])
            for i, found in whole.items():
                cuts[i] = np.array(found, self.kind)
            ids, upto = np.concatenate(cuts), np.cumsum([len(c) for c in cuts])
        return np.diff(upto, prepend=0) + 1, np.insert(ids, upto, self.kind(end))


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)  # kept by the worker, so later tasks find its words


def drops_white_space(path: str) -> bool:
    """Whether a tokenizer's ids of a text are those of its words: checked on its own rules, before any job."""
    tokenizer = _tokenizer(path)
    probe = "One two,Three\n four \t5 it's  END."
    cut = probe.lower().replace(",", " ,").replace(".", " .").split()
    words = [i for w in cut for i in tokenizer.encode(w, add_special_tokens=False).ids]
    return tokenizer.encode(probe, add_special_tokens=False).ids == words


def _records(path: str, end: int, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode, offsets, at, docs, total = _encoder(path), [], 0, 0, 0

    def record(body: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], names=["value"])

    for batch in text_slices(batches, limit=2 << 20):
        counts, ids = encode(batch.column("text"), end)
        column = batch.column("doc_id")
        known = pc.is_valid(column).to_numpy(zero_copy_only=False)
        keys = pc.fill_null(column, 0).to_numpy(zero_copy_only=False)
        upto, start = np.cumsum(counts), 0
        while start < len(keys):
            before = int(upto[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, before + BLOCK_IDS, side="right")))
            body = block(keys[start:stop], known[start:stop], counts[start:stop], ids[before:int(upto[stop - 1])], bits)
            offsets.append(at)
            at += len(body) + 1
            docs, total, start = docs + stop - start, total + int(upto[stop - 1]) - before, stop
            yield record(body)
    if offsets:
        yield record(np.array(offsets, "<u8").tobytes() + TAIL.pack(FILE_MARK, len(offsets), docs, total))


def write_ids(docs: DataFrame, tokenizer: str, folder: str | None = None, end: int = 2, key: str = "doc_id", text: str = "text") -> str:
    """Encode every whole text, append ``end`` and write the packed files in ascending key order; returns their folder.

    A null text is empty (its only id is ``end``); null keys come first; rows with equal keys stay together in any order;
    an empty table writes a folder without blocks. Only the key and text columns are read.
    """
    if not drops_white_space(tokenizer):
        raise ValueError("the tokenizer keeps case or white space, so texts cannot be encoded word by word")
    slim = two_columns(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "-ids")
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_TEXT_BYTES))
    bits = width(_tokenizer(tokenizer).get_vocab_size(with_added_tokens=True))
    dealt = slim.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    records = dealt.mapInArrow(partial(_records, tokenizer, end, bits), "value binary")
    records.select(F.col("value").cast("string").alias("value")).write.text(folder)
    return folder


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            view = memoryview(content.as_buffer())
            before = 0
            for at in block_offsets(view).tolist():
                keys, known, counts, bits, body = open_block(view, at)
                ids = unpack(body, bits, 0, int(counts.sum())).astype("<u4")
                ends = np.cumsum(counts)
                sums = [zlib.crc32(ids[e - n:e]) for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(keys), pa.string()), pa.array(keys, pa.int64(), mask=~known), pa.array(before + ends - counts, pa.int64()),
                     pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["file", "doc_id", "start", "n_tokens", "ids_crc32"])
                before += int(ends[-1])


def read_index(spark, folder: str) -> DataFrame:
    """Per document, from the files alone: ``file``, ``doc_id``, ``start`` within the file, ``n_tokens``, ``ids_crc32``."""
    files = spark.read.format("binaryFile").load(folder).filter("length > 0").select("path", "content")
    return files.mapInArrow(_documents, "file string, doc_id long, start long, n_tokens long, ids_crc32 long")


def global_starts(found: DataFrame) -> DataFrame:
    """Turn ``start`` within the file into the number of ids of all documents before it.

    ``found`` is a written result of ``read_index``. One small row per file passes through the driver.
    """
    files = found.groupBy("file").agg(F.min_by("doc_id", F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("first"), F.sum("n_tokens").alias("n")).collect()
    files.sort(key=lambda r: (r["first"] is not None, r["first"] or 0))
    before, rows = 0, []
    for r in files:
        rows.append((r["file"], before))
        before += r["n"]
    offsets = found.sparkSession.createDataFrame(rows, "file string, _before long")
    return found.join(F.broadcast(offsets), "file").select("file", "doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")
