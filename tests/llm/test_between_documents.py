"""Operators that compare documents with each other, against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import decontaminate, line_dedup, minmax, quality_rules, queries, suffix_dedup

FOLDER = "/root/testdata/sf0.001"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


# Suffix arrays


def test_suffix_array_same_as_sorting():
    rng = random.Random(1)
    for _ in range(2000):
        n, k = rng.randrange(60), rng.choice([1, 2, 3, 10])
        text = [rng.randrange(1, k + 1) for _ in range(n)]
        if n and rng.random() < 0.3:
            text = (text[:rng.randrange(1, 5)] * n)[:n]
        order = suffix_dedup.suffix_array(text)
        assert order == sorted(range(n), key=lambda i: text[i:])
        shared = suffix_dedup.shared_prefixes(text, order)
        for i in range(1, n):
            a, b = text[order[i - 1]:], text[order[i]:]
            assert shared[i] == next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def cut(texts, length=400):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) per text."""
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        covered = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                covered[i:i + length] = True
        kept = bytes(b for b, c in zip(r, covered) if not c)
        out.append((len(r), int(covered.sum()), int((np.diff(covered.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def report(docs, **options):
    return {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.dedup_report(docs, suffix_dedup.repeated_spans(docs, **options)).collect()}


def test_repeats_on_documents(spark, documents):
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op2_suffix_groups"](spark, FOLDER).collect()}
    assert found == {k: w for (k, _), w in zip(documents, cut([t for _, t in documents]))}


@pytest.mark.parametrize("group", [256, 2])
def test_repeats_with_a_hot_passage(spark, group):
    """A passage in all documents, at the edges, with more and less context shared; groups split by further bytes when large."""
    rng = random.Random(group)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, long = word(390), word(900)
    texts = []
    for i in range(24):
        middle = {0: passage, 1: word(10) + passage, 2: long[:rng.randrange(380, 900)], 3: long[rng.randrange(0, 500):]}[i % 4]
        texts.append(word(rng.randrange(0, 60)) + rng.choice(["", "same left side " * 3]) + middle + rng.choice(["", "same right side " * 3]) + word(rng.randrange(0, 80)))
    texts += ["x" * 1000, "ab" * 450, "short", "", None, texts[3], long, long[:400], long[:399], (word(200) * 3), "x" * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert report(docs, group=group) == dict(enumerate(cut(texts)))


def test_repeats_odd_texts(spark, odd, none):
    found = report(odd)
    assert found[3] == found[4] == (0, 0, 0, hashlib.sha256(b"").hexdigest())
    assert found[7][1] == found[7][0] == 300_000  # five letters again and again: every byte lies in a repeated string
    assert len(suffix_dedup.dedup_report(odd, suffix_dedup.repeated_spans(odd)).collect()) == odd.count()
    assert report(none) == {}
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(odd, length=100)


# Near duplicates


def linked(texts, words, percent=80):
    """doc_id -> (size of the set, smallest linked key) by comparing all pairs."""
    sets = {}
    for key, text in texts:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[key] = {tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in sets}


def test_near_duplicates_on_documents(spark, documents):
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op7_minmax_duplicates"](spark, FOLDER).collect()}
    assert found == linked(documents, 4)


@pytest.mark.parametrize("limit", [50_000, 0])
def test_near_duplicates_of_one_large_group(spark, limit):
    """Near copies of one text, many of them only linked through others, beside a second, similar family."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    other = base[:80] + [rng.choice(words) for _ in range(40)]
    texts = []
    for i in range(120):
        text = list(base if i % 3 else other)
        for _ in range(rng.randrange(1, 5)):
            text[rng.randrange(len(text))] = f"new{rng.randrange(10 ** 6)}"
        texts.append((1000 - i, " ".join(text)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in minmax.near_duplicates(docs, words=5, one_task_links=limit).collect()} == linked(texts, 5)


def test_near_duplicates_odd_texts(spark, odd, none):
    rows = minmax.near_duplicates(odd, words=4).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["component_id"] == 1 and not by[2]["kept"] and by[1]["kept"]
    assert (by[3]["n_shingles"], by[3]["component_id"], by[3]["kept"]) == (0, 3, True) and by[4]["component_id"] == 4
    assert by[None]["component_id"] is None and by[None]["kept"]
    kept = minmax.keep_one(odd, words=4)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, None, 7, 8]))
    assert minmax.near_duplicates(none).count() == 0


def test_signature_halves_estimate_similarity():
    rng = np.random.default_rng(2)
    common = rng.integers(0, 2 ** 63, 800, dtype=np.uint64)
    a = np.unique(np.concatenate([common, rng.integers(0, 2 ** 63, 100, dtype=np.uint64)]))
    b = np.unique(np.concatenate([common, rng.integers(0, 2 ** 63, 100, dtype=np.uint64)]))
    one, two = minmax.signatures([a, b])
    assert abs((one == two).mean() - 0.8) < 0.15 and len(one) == 2 * minmax.PERMUTATIONS
    assert minmax.bands(np.array([one, two])).shape == (2, 2 * minmax.PERMUTATIONS // minmax.ROWS_PER_BAND)


# Lines


@pytest.mark.parametrize("most", [1, 2, 3])
def test_bit_parallel_distance(spark, most):
    rng, rows = random.Random(most), []
    for _ in range(800):
        a = [rng.choice("ab") for _ in range(rng.randrange(14))]
        b = list(a)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(b) + 1)
            b[i:i + rng.randrange(2)] = [rng.choice("abc")] * rng.randrange(2)
        a, b = sorted(("".join(a), "".join(b)), key=len, reverse=True)
        if len(a) - len(b) <= most:
            rows.append((a, b, edits(a, b)))
    found = spark.createDataFrame(rows, "a string, b string, d int").withColumn("e", line_dedup.edit_distance(F.col("a"), F.col("b"), most)).collect()
    assert all(r["e"] == r["d"] if r["d"] <= most else r["e"] > most for r in found)


def removed(docs, least):
    first, places = {}, []
    for key, text in sorted(docs):
        for i, line in enumerate((text or "").split("\n")):
            if len(line) >= least:
                places.append((key, i, line))
                first.setdefault(line, (key, i))
    lines = sorted(first, key=first.get)
    late = {x for i, x in enumerate(lines) if any(abs(len(x) - len(y)) <= 1 and edits(x, y) <= 1 for y in lines[:i])}
    out = collections.defaultdict(list)
    for key, i, line in places:
        if line in late or first[line] != (key, i):
            out[key].append(i)
    return dict(out)


@pytest.mark.parametrize("group", [64, 3])
def test_lines_against_all_pairs(spark, group):
    """With a small group limit, shared segments are refined instead of paired."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.choice([20, 21, 22, 30]))) for _ in range(12)]
    docs = []
    for key in range(40):
        lines = []
        for _ in range(rng.randrange(5)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2])):
                i = rng.randrange(len(line))
                line[i:i + rng.randrange(2)] = rng.choice(["", "a", "x", "日"])
            lines.append("".join(line))
        docs.append((key, "\n".join(lines)))
    docs += [(100 + i, f"page number {i} of the annual report") for i in range(12)] + [(99, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: list(r["removed"]) for r in line_dedup.repeated_lines(frame, 20, group).collect()} == removed(docs, 20)


def removed_within(docs, least, most, copies_from=None):
    """As ``removed``, for lines up to ``most`` edits apart and, where given, copies of shorter lines that are not blank."""
    first, places = {}, []
    for key, text in sorted(docs):
        for i, line in enumerate((text or "").split("\n")):
            if len(line) >= least or copies_from is not None and len(line) >= copies_from and line.strip():
                places.append((key, i, line))
                first.setdefault(line, (key, i))
    lines = sorted((x for x in first if len(x) >= least), key=first.get)
    late = set()
    letters = {x: collections.Counter(x) for x in lines}
    for i, x in enumerate(lines):
        for y in lines[:i]:
            if abs(len(x) - len(y)) <= most and (letters[x] - letters[y]).total() <= most >= (letters[y] - letters[x]).total() and edits(x, y) <= most:
                late.add(x)
                break
    out = collections.defaultdict(list)
    for key, i, line in places:
        if line in late or first[line] != (key, i):
            out[key].append(i)
    return dict(out)


@pytest.mark.parametrize("most, group", [(2, 64), (3, 64), (3, 3)])
def test_lines_within_several_edits(spark, most, group):
    rng = random.Random(most)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.choice([20, 21, 23, 40]))) for _ in range(8)]
    docs = []
    for key in range(30):
        lines = []
        for _ in range(rng.randrange(5)):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(6)):
                i = rng.randrange(len(line))
                line[i:i + rng.randrange(2)] = rng.choice(["", "a", "x", "日"])
            lines.append("".join(line))
        docs.append((key, "\n".join(lines)))
    docs += [(100 + i, f"page number {i * 37} of the annual report") for i in range(40)] + [(99, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: list(r["removed"]) for r in line_dedup.repeated_lines(frame, 20, group, edits=most).collect()}
    assert found == removed_within(docs, 20, most)
    assert found != removed_within(docs, 20, 1)


def test_lines_query_takes_several_edits(spark, documents):
    rows = {r["doc_id"]: r["n_removed"] for r in queries.QUERIES["op5_line_edit_join"](spark, FOLDER).collect()}
    wanted = removed_within(documents, 20, 3, copies_from=1)
    assert wanted != removed_within(documents, 20, 3)
    assert rows == {k: len(wanted.get(k, ())) for k, _ in documents}


def test_short_lines_repeated(spark):
    docs = [(1, "Of.\nDie.\n\n  \nOf."), (2, "Die\n\n  \nOf.\nDie."), (3, "Dir.")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: list(r["removed"]) for r in line_dedup.repeated_lines(frame).collect()} == {1: [4], 2: [3, 4]}
    assert {r["doc_id"]: list(r["removed"]) for r in line_dedup.repeated_lines(frame, copies_from=4).collect()} == {2: [4]}


def test_lines_odd_texts(spark, odd, none):
    gone = line_dedup.repeated_lines(odd)
    assert {r["doc_id"]: list(r["removed"]) for r in gone.collect()} == {2: [0]}
    kept = line_dedup.dedup_lines(odd, gone)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert kept.columns == odd.columns and kept.count() == odd.count() and texts[2] == "" and texts[3] is None and texts[7] == "word " * 60_000
    rows = {r["doc_id"]: tuple(r)[1:] for r in line_dedup.line_report(odd, gone).collect()}
    assert rows[3][:3] == (0, 0, 0) and rows[2][:3] == (1, 1, 0) and rows[5][:2] == (2, 0)
    assert line_dedup.line_report(none, line_dedup.repeated_lines(none)).count() == 0


def test_lines_query_stays_native(spark):
    plan = queries.QUERIES["op5_line_edit_join"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Benchmarks


def held(docs, items, window=13):
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, item in items:
        want = tokens(item)
        if len(want) < decontaminate.SPAN:
            continue
        width = min(window, len(want))
        for d, text in docs:
            words = tokens(text)
            for shift in range(-len(want) + 1, len(words)):
                same = [0 <= shift + j < len(words) and words[shift + j] == x for j, x in enumerate(want)]
                if max(sum(same[j:j + width]) for j in range(len(same) - width + 1)) >= width - min(width - -(-width * 8 // 10), (width - 2) // 5):
                    out.add((d, i))
                    break
    return out


def test_leaks_with_substitutions(spark):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([3, 5, 8, 13, 30])))) for i in range(15)]
    docs = []
    for d in range(80):
        words = text(rng.randrange(0, 40))
        part = items[rng.randrange(15)][1].split()
        for _ in range(rng.randrange(3)):
            part[rng.randrange(len(part))] = "other"
        docs.append((d, " ".join(words[:10] + (part[rng.randrange(2):] if d % 2 else []) + words[10:]).upper()))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == held(docs, items)


def test_leaks_in_documents(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    found = queries.QUERIES["op1_spaced_seeds"](spark, FOLDER).collect()
    verbatim = {(d, i) for d, t in documents for i, item in items if item in t}
    assert verbatim and verbatim <= {(r["doc_id"], r["item_id"]) for r in found}
    assert all(r["matched"] >= 0.8 * r["width"] for r in found)


def test_leaks_odd_texts(spark, odd, none):
    items = odd.select(F.col("key").alias("item_id"), F.substring("text", 1, 150).alias("text"), "doc_id")
    assert {r["doc_id"] for r in decontaminate.leaks(odd.filter("doc_id is null or doc_id <> 7"), items).collect()} == {1, 2, 8}
    kept = decontaminate.without_leaks(odd, items.filter("doc_id < 7"))
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 7, 8, None}
    bench = none.select(F.col("key").alias("item_id"), "text")
    assert decontaminate.leaks(odd, bench).count() == 0 and decontaminate.leaks(none, items).count() == 0


def test_leaks_query_stays_native(spark):
    plan = queries.QUERIES["op1_spaced_seeds"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Pipeline


def test_pipeline_same_as_plain_stages(spark, documents):
    import public_tokenizers as P
    import sentencepiece

    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "encoding"]
    docs, texts = spark.read.parquet(f"{FOLDER}/documents.parquet"), dict(documents)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for stage, run in corpus_pipeline.STAGES[:-1]:
        out = run(spark, docs, FOLDER)
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        new = {r["doc_id"]: r["text"] for r in docs.collect()}
        if stage == "quality_rules":
            assert all(not (counts[0] < 20) for counts in [(len(t.split()),) for t in new.values()])
            assert set(new) < set(texts) and all(new[k] == texts[k] for k in new)
        elif stage == "line_dedup":
            gone = removed_within(list(texts.items()), 20, 3, 1)
            assert new == {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(k, ())) for k, t in texts.items()}
        elif stage == "near_duplicates":
            assert set(new) == {k for k, v in linked(list(texts.items()), 5).items() if v[2]}
        else:
            assert not {d for d, t in new.items() if any(item in t for _, item in items)}
            clean = {k for k, t in texts.items() if not any(item[:60] in t for _, item in items)}
            assert clean <= set(new)
        texts = new
    last = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()}
    assert last == {k: len(library.encode(t)) + 1 for k, t in texts.items()}


def test_pipeline_stages_take_odd_documents(spark, odd, none):
    for frame in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, FOLDER).count() <= frame.count()


@pytest.mark.parametrize("most", [1, 2, 3])
def test_first_keys_are_those_of_the_states(spark, most):
    lines = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).select(F.explode(F.split("text", "\n")).alias("line")).distinct().withColumn("id", F.xxhash64("line"))
    flat = line_dedup._first_keys(lines, most, 20)
    states = line_dedup._refined(line_dedup._started(lines, most, 20), most).select("id", "probe", "key")
    assert flat.count() == states.count() > 0 and flat.exceptAll(states).count() == 0


def test_lines_of_one_group_make_few_keys(spark):
    """Near copies that differ by whole words: twice as many lines make about twice as many keys."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    base, lines = [word() for _ in range(20)], []
    while len(lines) < 800:
        line = list(base)
        for i in rng.sample(range(20), rng.choice([1, 2, 2, 3])):
            line[i] = word()
        lines.append(" ".join(line))
    keys = []
    for n in (400, 800):
        frame = spark.createDataFrame(list(enumerate(lines[:n])), "doc_id long, text string")
        rows = line_dedup.lines_of(frame)
        firsts = rows.groupBy("id", "more").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
        keys.append(line_dedup._candidates(rows.select("id", "line"), firsts, line_dedup.GROUP, 3, 20)[0].count())
    assert 0 < keys[1] <= 2.5 * keys[0] and keys[1] <= 26 * 800, keys
    found = {r["doc_id"]: list(r["removed"]) for r in line_dedup.repeated_lines(frame, 20, edits=3).collect()}
    assert found == removed_within(list(enumerate(lines)), 20, 3) != {}


def test_lines_are_split_once(spark):
    """Spark infers filters from what a generator reads: the split is inside it, so it is not made again for each of them."""
    rows = line_dedup.lines_of(spark.range(3).selectExpr("id AS doc_id", "concat('one\\n', id) AS text").repartition(2), min_chars=1)
    assert rows._jdf.queryExecution().executedPlan().toString().count("split(") == 1
    assert rows.count() == 6


def test_ring_marks_tell_no_close_counts_apart(spark):
    pairs = [(a, b) for a in range(20) for b in range(20)]
    df = spark.createDataFrame([(a, b, 7, 7) for a, b in pairs], "a int, b int, c int, d int")
    got = df.select("a", "b", F.bit_count(line_dedup._ring_marks("a", "c").bitwiseXOR(line_dedup._ring_marks("b", "d"))).alias("n")).collect()
    assert all(r["n"] <= abs(r["a"] - r["b"]) and (r["n"] == abs(r["a"] - r["b"]) or abs(r["a"] - r["b"]) > 4) for r in got)
