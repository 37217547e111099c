"""Operators that judge or encode each document on its own, against plain versions and the libraries."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quarry.llm import hilbert, packed_ids, pieces, quality_rules, queries, resample, token_trees

FOLDER = "/root/testdata/sf0.001"
PIECES, WORDS, RANKS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Quality rules


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_quality_counts(spark, documents):
    found = {r["doc_id"]: r for r in queries.QUERIES["op6_quality_rules"](spark, FOLDER).collect()}
    assert len(found) == len(documents)
    for key, text in documents:
        r = found[key]
        want = counts(text)
        assert tuple(r[b] for b in quality_rules.BASE) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_quality_counts_of_odd_texts(spark, odd, none):
    found = quality_rules.judge(odd, None).collect()
    assert len(found) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in found:
        assert tuple(r[b] for b in quality_rules.BASE) == counts(texts[r["doc_id"]])
    assert {r["doc_id"] for r in quality_rules.keep_good(odd, None).collect()} == {r["doc_id"] for r in found if r["kept"]}
    assert quality_rules.keep_good(odd, None).columns == odd.columns
    assert quality_rules.judge(none, None).count() == 0
    assert quality_rules.fit(none, none.select("doc_id", F.lit(1).alias("quality"))) is None


def test_repeated_words_at_the_seams():
    ids = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 6, 7, 8])
    assert quality_rules.repeated_words(ids, np.array([17, 25])).tolist() == [16, 0]  # not across texts
    assert quality_rules.repeated_words(np.ones(9, int), np.array([9])).tolist() == [9]  # overlapping windows
    assert quality_rules.repeated_words(np.zeros(0, int), np.array([0, 0])).tolist() == [0, 0]


def test_forest_tells_junk_from_good():
    """Held-out accuracy on rows the forest has not seen."""
    rng = np.random.default_rng(1)
    width = len(quality_rules.FEATURES)
    good, junk = rng.normal(1, 0.1, (4000, width)), rng.normal(1, 0.1, (400, width))
    junk[np.arange(400), rng.integers(0, width, 400)] += 3
    x, y = np.concatenate([good, junk]), np.arange(4400) < 4000
    half = rng.random(4400) < 0.5
    forest = quality_rules.grow(x[half], y[half])
    forest.threshold = quality_rules.calibrate(forest.score(x[half]), y[half])
    kept = forest.score(x[~half]) <= forest.threshold
    assert kept[y[~half]].mean() > 0.99 and kept[~y[~half]].mean() < 0.1


def test_threshold_keeps_good_rows():
    scores, good = np.array([0.4, 0.4, 0.5, 0.6, 0.7]), np.array([True, True, True, False, False])
    assert 0.5 < quality_rules.calibrate(scores, good) < 0.6
    assert quality_rules.calibrate(np.array([0.5, 0.5]), np.array([True, False])) >= 0.5  # a tie is not cut


# Piece encoding


@pytest.fixture(scope="module")
def model():
    return pieces.pieces(PIECES)


def test_pieces_same_as_the_library(model):
    rng = random.Random(1)
    texts = ["", " ", "  a  b ", "\n", "a\n\nb", "▁", "a▁b", "x" * 300, "日本語😀é́\x00", "<s></s><unk><0x0A>", "\t {\r\n}\r", "e" * 47, "e" * 48, "的" * 100 + " ab" * 60]
    texts += ["".join(rng.choice(" aebtionsh.,\n▁é日😀<>{}\r") for _ in range(rng.randrange(90))) for _ in range(1500)]
    for (shown, ids, decoded), text in zip(pieces.round_trip(model, texts), texts, strict=True):
        assert ids == model.library.encode(text) + [2] and shown == " ".join(map(str, ids)) and decoded == model.library.decode(ids)


def test_heap_and_lock_step_agree(model):
    rng = random.Random(2)
    for _ in range(200):
        points = [ord(rng.choice("▁theandiong")) for _ in range(rng.randrange(1, 40))]
        sym = model.symbol_of[points]
        assert model.lock_step(sym.copy(), np.array([len(sym)]))[0].tolist() == model.by_heap(sym.tolist())


def test_decoding_of_any_ids(model):
    rng = random.Random(3)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), 1, 2]) for _ in range(rng.randrange(12))]
        assert model.decode(ids) == model.library.decode(ids)


def test_piece_digests(spark, documents, model, odd, none):
    found = {r["doc_id"]: r for r in queries.QUERIES["op8_piece_encoding"](spark, FOLDER).collect()}
    assert len(found) == len(documents)
    for key, text in documents:
        ids = model.library.encode(text) + [2]
        assert tuple(found[key])[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(model.library.decode(ids)))
    rows = pieces.encode(odd, PIECES)
    assert rows.count() == odd.count() and pieces.encode(none, PIECES).count() == 0
    assert [list(r["ids"]) for r in rows.filter("doc_id = 3").collect()] == [[2]]
    back = {r["doc_id"]: r["text"] for r in pieces.decode(rows, PIECES).collect()}
    assert back[7] == "word " * 60_000


# Packed ids


def test_packing_every_width():
    rng = np.random.default_rng(0)
    for bits in range(1, 33):
        for n in (0, 1, 7, 100, 513):
            ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
            body = packed_ids.pack(ids, bits)
            assert len(body) % 8 == 0 and (packed_ids.unpack(body, bits, 0, n) == ids).all()
            if n > 5:
                assert (packed_ids.unpack(body, bits, 3, n - 4) == ids[3:n - 1]).all()
    with pytest.raises(ValueError):
        packed_ids.pack(np.array([8]), 3)
    assert packed_ids.width(49_408) == 16 and packed_ids.width(32_000) == 15 and packed_ids.width(1) == 1


def test_packed_file_round_trip(spark, documents, odd, none, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op10_packed_ids"](spark, FOLDER).collect()}
    before = 0
    for key, text in documents:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert found[key] == (before, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        before += len(ids)
    folder = packed_ids.write_ids(odd, WORDS, str(tmp_path / "ids"))
    read = packed_ids.read_index(spark, folder)
    assert read.count() == odd.count() and read.filter("doc_id is null").count() == 1
    files = [f.read_bytes() for f in sorted((tmp_path / "ids").glob("part-*")) if f.stat().st_size]
    for key, text in {r["doc_id"]: r["text"] for r in odd.collect()}.items():
        if key is not None:
            ids = next(i for i in (packed_ids.read_ids(f, key) for f in files) if i is not None)
            assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
    assert all(packed_ids.read_ids(f, 12345) is None for f in files)
    assert packed_ids.read_index(spark, packed_ids.write_ids(none, WORDS)).count() == 0


def test_word_encoder_same_as_the_library():
    import pyarrow as pa

    rng = random.Random(4)
    texts = ["", "<|ENDOFTEXT|> a", "it's we'll I'D", "a\tb\r\nc", "Σίσυφος ΑΣ", "İstanbul", "é.́ x", "foo<|endoftext|>bar."]
    texts += ["".join(rng.choice("aB'st.,!?| \n日é́<>_-5") for _ in range(rng.randrange(40))) for _ in range(3000)]
    encoder = packed_ids.WordEncoder(WORDS)
    sizes, ids = encoder(pa.array(texts, pa.large_string()), 2)
    ends = np.cumsum(sizes)
    for text, size, end in zip(texts, sizes, ends):
        assert ids[end - size:end].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids + [2], text


# Token trees


def test_trees_after_edits():
    count = token_trees.counter(RANKS, P.PATTERN)
    rng, letters = random.Random(5), "ab 'lsrev\n\t1.é日 ,  "
    for _ in range(2500):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 40, 900])))
        edits = []
        for _ in range(rng.randrange(4)):
            at = rng.randrange(-2, len(text) + 5)
            edits.append((at, at + rng.randrange(30), "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 20, 400])))))
        own, new, before, _, _ = token_trees.edited(text, edits, count)
        assert own.leaves()[0] == [len(p) for p in count.cut(new)]
        assert own.tokens == len(count.encoding.encode_ordinary(new)) and own.characters == len(new) and before == len(count.encoding.encode_ordinary(text))


def test_token_counts(spark, documents, odd, none):
    count = token_trees.counter(RANKS, P.PATTERN)
    docs = token_trees.revision(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    edits = {r["doc_id"]: [tuple(e) for e in r["edits"]] for r in docs.select("doc_id", "edits").collect()}
    found = {r["doc_id"]: r for r in queries.QUERIES["op3_token_trees"](spark, FOLDER).collect()}
    for key, text in documents:
        new = text
        for a, b, put in edits[key]:
            a = min(max(a, 0), len(new))
            new = new[:a] + put + new[min(max(b, a), len(new)):]
        assert (found[key]["n_tokens"], found[key]["n_tokens_edited"]) == (len(count.encoding.encode_ordinary(text)), len(count.encoding.encode_ordinary(new)))
        assert found[key]["n_encoded_anew"] <= 60
    asked = odd.withColumn("edits", F.lit(None).cast("array<struct<start:int,stop:int,replacement:string>>"))
    plain = token_trees.count_edited(asked, RANKS, P.PATTERN)
    assert plain.count() == odd.count() and plain.filter("n_tokens <> n_tokens_edited or n_encoded_anew <> 0").count() == 0
    assert token_trees.count_edited(token_trees.revision(none), RANKS, P.PATTERN).count() == 0
    stored = token_trees.trees(odd.filter("doc_id = 1"), RANKS, P.PATTERN).first()
    assert token_trees.TokenTree(stored["lengths"], stored["counts"]).tokens == plain.filter("doc_id = 1").first()["n_tokens"]


# Importance resampling


def test_resampling_prefers_the_target(spark):
    rows = [(i, "good plain words here " * 5 + f"w{i}" if i % 3 else "junk ### spam ### junk") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ratios = resample.log_ratios(docs, docs.filter("doc_id % 3 > 0 and doc_id < 300").select("doc_id"))
    found = resample.resample(docs, ratios, 2 / 3)
    assert found.filter("kept").count() == 600 and found.filter("kept and doc_id % 3 = 0").count() == 0
    assert sorted(r["rank"] for r in found.collect()) == list(range(900))


def test_resampling_same_as_a_plain_sort(spark, odd, none):
    ratios = np.linspace(-1, 1, resample.BUCKETS)
    found = resample.resample(odd, ratios, 0.5).collect()
    assert len(found) == odd.count() and sum(r["kept"] for r in found) == round(0.5 * len(found))
    key = lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"] or 0)
    assert [r["rank"] for r in sorted(found, key=key)] == sorted(r["rank"] for r in found)
    assert all(r["log_weight"] == 0 for r in found if r["doc_id"] in (3, 4, 5))
    assert resample.resample(none, ratios, 0.5).count() == 0
    assert not resample.log_ratios(none, none.select("doc_id")).any()


def test_gumbel_draws_in_proportion(spark):
    """With equal texts every document is as likely as any other; with weights log 3 apart, three times as likely first."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("text"))
    import pyarrow as pa

    (a,), (b,) = (resample.ngram_buckets(pa.array([t], pa.large_string()))[0] for t in "ab")
    ratios = np.zeros(resample.BUCKETS)
    ratios[a], ratios[b] = np.log(3), 0.0
    top = resample.resample(rows, ratios, 0.02).filter("kept")
    share = top.filter("doc_id % 2 = 0").count() / top.count()
    assert abs(share - 0.75) < 0.08


# Sharding


def test_curve_is_a_hilbert_curve(spark):
    for axes, bits in ((2, 3), (3, 2), (2, 1)):
        cells = spark.range(2 ** (axes * bits)).select(*[F.expr(f"cast(shiftright(id, {bits * i}) & {2 ** bits - 1} as int)").alias(f"x{i}") for i in range(axes)])
        rows = cells.select("*", hilbert.curve_index([F.col(f"x{i}") for i in range(axes)], bits).alias("h")).orderBy("h").collect()
        assert [r["h"] for r in rows] == list(range(2 ** (axes * bits)))
        for a, b in zip(rows, rows[1:]):  # neighbours on the curve are neighbours in space
            assert sum(abs(a[f"x{i}"] - b[f"x{i}"]) for i in range(axes)) == 1


@pytest.mark.parametrize("law", hilbert.LAWS)
def test_shards(spark, odd, none, law):
    for docs, shards in ((spark.read.parquet(f"{FOLDER}/documents.parquet"), 16), (odd, 4)):
        rows = hilbert.shard(docs, shards=shards, law=law).collect()
        assert len(rows) == docs.count()
        by = collections.defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r)
        for part in by.values():
            assert sorted(r["slot"] for r in part) == list(range(len(part)))
        sizes = [len(by[s]) for s in range(shards)] if law == "rows" else [sum(r["size"] for r in by[s]) for s in range(shards)]
        assert max(sizes) - min(sizes) <= (1 if law == "rows" else 2 * max(r["size"] for r in rows))
        order = sorted(rows, key=lambda r: (r["curve"], r["doc_id"] is None, r["doc_id"] or 0))
        assert [r["shard"] for r in order] == sorted(r["shard"] for r in rows)
        texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
        assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]])) for r in rows)
    assert hilbert.shard(none, law=law).count() == 0


def test_shards_prune_files(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    manifest = hilbert.write_shards(docs, hilbert.shard(docs), str(tmp_path / "shards")).collect()
    assert sum(r["rows"] for r in manifest) == docs.count()
    for column, value in (("lang", "fr"), ("source", "src3")):
        hit = sum(r[f"min_{column}"] <= value <= r[f"max_{column}"] for r in manifest)
        assert hit < len(manifest)
