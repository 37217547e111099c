"""Whitening, ranked lexical search and top-k products against plain versions."""

import math
import os
import re
import sys
from collections import Counter

import numpy as np
import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]
import compare  # noqa: E402

from quarry.llm import lexical_blocks, queries, top_products, vectors, whitening  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
INF, NAN = float("inf"), float("nan")


def table_of(spark, rows, parts=3):
    """Vectors with columns that bear the operators' own names."""
    shape = "vec_id long, embedding array<float>, x string, block int, part double, query_id long, score long, rank int, at int"
    return spark.createDataFrame([(i, v, "x", 1, 2.0, 3, 4, 5, 6) for i, v in rows], shape).repartition(parts)


def whole(v):
    return [math.floor(256 * float(np.float32(c))) for c in v]


# --- whitening -------------------------------------------------------------------------------------------------------------


def plain_whitening(x, components):
    """n, sums, variances, covariance and components of the distinct rows of ``x``."""
    distinct = np.unique(np.asarray(x), axis=0)
    cov = np.cov(distinct.T.astype(float), bias=True).reshape(distinct.shape[1], -1)
    values, columns = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    return len(distinct), distinct.sum(axis=0), values[order], cov, columns[:, order]


def test_whitening_same_as_eigenvectors(spark):
    found = queries.QUERIES["op11_lanczos_whitening"](spark, FOLDER).collect()
    rows = [(r["vec_id"], whole(r["embedding"])) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    n, sums, variances, cov, columns = plain_whitening([x for _, x in rows], 4)
    held = {(r["vec_id"], r["component"]): r for r in found}
    assert len(held) == len(found) == 4 * len(rows)
    for j in range(4):
        want = np.array([(np.array(x) - sums / n) @ columns[:, j] for _, x in rows]) / math.sqrt(variances[j])
        have = np.array([held[i, j + 1]["whitened"] for i, _ in rows])
        assert np.allclose(have * np.sign(have @ want), want, atol=1e-8)
    for i, x in rows:
        r = held[i, 1]
        assert r["n"] == n and r["deviation"] == sum((n * a - int(s)) ** 2 for a, s in zip(x, sums))
        assert r["explained"] == pytest.approx(variances[0] / np.trace(cov), rel=1e-9) and r["identity_error"] < 1e-9


@pytest.mark.parametrize("x", [
    np.vstack([np.eye(6, dtype=int) * 7, -np.eye(6, dtype=int) * 7]),  # one variance six times over
    np.repeat(np.random.default_rng(0).integers(-9, 9, (3, 5)), 4, axis=0),  # rank 2, repeated rows
    np.hstack([np.random.default_rng(1).integers(-9, 9, (40, 3))] * 2 + [np.zeros((40, 2), int)]),  # doubled and empty dimensions
    np.random.default_rng(2).integers(-10 ** 6, 10 ** 6, (40, 4)),
    np.arange(12)[:, None],
])
def test_components_are_eigenvectors(spark, x):
    rows = vectors.whole_vectors(spark.createDataFrame([(i, [float(c) / 256 for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>"))
    made = whitening.fit(rows)
    n, sums, variances, cov, _ = plain_whitening(x, 4)
    rank = int((variances > 1e-9 * np.trace(cov)).sum())
    assert made.n == n and made.sums == sums.tolist() and made.components.shape[1] == rank
    assert np.allclose(made.variances, variances[:rank], rtol=1e-10) and made.identity_error < 1e-9
    assert np.abs(cov @ made.components - made.components * made.variances).max() < 1e-9 * np.trace(cov)


def test_whitening_of_odd_tables(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (2, None), (3, [1.0, None]), (4, [NAN, 1.0]), (5, [INF, 1.0]), (6, []), (7, [-0.0, 0.5])]
    held = vectors.whole_vectors(table_of(spark, rows))
    found = whitening.whiten(held, whitening.fit(held)).collect()
    assert Counter((r["vec_id"], r["component"]) for r in found) == {(1, 1): 2, (1, 2): 2, (None, 1): 1, (None, 2): 1, (7, 1): 1, (7, 2): 1}
    assert {r["n"] for r in found} == {3}
    for none in (rows[3:8], [(1, [1.0, 2.0])] * 3, []):  # nothing valid, no variance, no rows
        held = vectors.whole_vectors(table_of(spark, none, 1))
        assert whitening.whiten(held, whitening.fit(held)).collect() == []
    with pytest.raises(ValueError):
        whitening.fit(vectors.whole_vectors(table_of(spark, [(1, [1.0]), (2, [1.0, 2.0])])))


# --- top products ----------------------------------------------------------------------------------------------------------


def plain_products(rows, asked, k):
    out = []
    for q, x in asked:
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_products_same_as_sql(spark):
    assert compare.difference(queries.QUERIES["op13_sorted_lists"](spark, FOLDER), compare.database(FOLDER), queries.ORACLE["op13_sorted_lists"]) is None


@pytest.mark.parametrize("block_rows, group_rows, k", [(2048, 512, 5), (16, 4, 5), (7, 3, 2), (3, 50, 9)])
def test_products_in_blocks(spark, block_rows, group_rows, k):
    random = np.random.default_rng(block_rows)
    x = random.integers(-40, 40, (120, 6))
    x[30:70] = x[3]  # a third of all rows are one vector
    x[5] = 0
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    held = spark.createDataFrame(rows, "vec_id long, x array<long>").repartition(4)
    found = top_products.top_products(held, held.filter("vec_id % 5 = 0"), k, block_rows, group_rows)
    assert sorted(map(tuple, found.collect())) == plain_products(rows, [r for r in rows if r[0] % 5 == 0], k)


def test_products_of_large_numbers(spark):
    x = np.random.default_rng(3).integers(-2 ** 28, 2 ** 28, (60, 4))
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    held = spark.createDataFrame(rows, "vec_id long, x array<long>")
    found = top_products.top_products(held, held.filter("vec_id < 9"), 4, 16, 4)
    assert sorted(map(tuple, found.collect())) == plain_products(rows, rows[:9], 4)
    with pytest.raises(Exception, match="range of a long"):
        top_products.top_products(spark.createDataFrame([(1, [2 ** 62]), (2, [2 ** 62])], "vec_id long, x array<long>"), held.limit(0).unionAll(
            spark.createDataFrame([(1, [2 ** 62])], "vec_id long, x array<long>"))).collect()


def test_reading_stops_early():
    """Lists whose heads decide are not read to the end, and the bounds lose nothing."""
    random = np.random.default_rng(4)
    x = random.integers(-5, 5, (400, 8))
    x[:12] += random.integers(200, 300, (12, 8))
    order = np.argsort(-x, axis=0, kind="stable").T.astype(np.int32)
    entries = np.take_along_axis(x.T, order.astype(np.int64), axis=1)
    asked = np.abs(random.integers(1, 9, (6, 8)))
    none = np.full(6, top_products.NONE)
    for i, inside, scores, depth in top_products.read_in_step(order, entries, np.arange(400), asked, np.full(6, -1), none, 3):
        assert depth < 400
        best = np.argsort(-(x @ asked[i]), kind="stable")[:3]
        assert set(best) <= set(inside.tolist()) and dict(zip(inside.tolist(), scores.tolist()))[best[0]] == (x @ asked[i]).max()


def test_products_of_odd_tables(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (None, [3.0, -1.0]), (50, None), (3, [1.0, None]), (4, [NAN, 1.0]), (5, [INF, 1.0]), (6, []), (100, [0.5, 0.5]), (7, [0.5, 0.5])]
    held = vectors.whole_vectors(table_of(spark, rows))
    found = sorted(map(tuple, top_products.top_products(held, held.filter("vec_id % 50 = 0")).collect()))
    assert found == [(0, 1, 7, 256 * 128 + 512 * 128), (0, 2, 100, 256 * 128 + 512 * 128), (100, 1, 0, 256 * 128 + 512 * 128), (100, 2, 7, 2 * 128 * 128)]
    empty = vectors.whole_vectors(table_of(spark, [], 1))
    assert top_products.top_products(empty, empty).collect() == [] and top_products.top_products(held, empty).collect() == []
    alone = vectors.whole_vectors(table_of(spark, [(0, [1.0])], 1))
    assert top_products.top_products(alone, alone).collect() == []


# --- ranked lexical search -------------------------------------------------------------------------------------------------


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain_ranking(docs, items, top):
    """(item_id, rank, doc_id, score) of all items, sorted."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held]
    n, length = sum(1 for _, _, x in held if x), sum(x for _, _, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in held:
            m = 50 + (50 * size * n) // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=repr)


def test_ranking_same_as_sql(spark):
    assert compare.difference(queries.QUERIES["op12_posting_blocks"](spark, FOLDER), compare.database(FOLDER), queries.ORACLE["op12_posting_blocks"]) is None


@pytest.mark.parametrize("top, block_docs, segment, batch", [(50, 32, 200_000, 16 << 20), (5, 4, 900, 16 << 20), (3, 2, 60, 2_000), (7, 1, 5_000, 1)])
def test_ranking_in_blocks(spark, documents, top, block_docs, segment, batch):
    docs = documents + [(10_000 + i, documents[7][1]) for i in range(90)]  # a large group of copies
    items = [(i, t) for i, t in enumerate([documents[3][1][:200], documents[7][1][:150], documents[20][1], "zzzz", "", None, "The the THE"])]
    found = lexical_blocks.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"),
                                  top, block_docs=block_docs, segment_postings=segment, batch_bytes=batch)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_ranking(docs, items, top)


def test_blocks_are_skipped_and_bounded(spark, documents):
    """Every summary is the maximum of its block's vectors over the terms asked for, and most blocks of a search are skipped."""
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(1)
    items = lexical_blocks.item_terms(spark.createDataFrame([(0, documents[3][1][:300]), (1, documents[20][1])], "item_id long, text string"))
    held = items.select("item", "terms").collect()
    rows = lexical_blocks.forward(docs, lexical_blocks.vocabulary_of(held)[3])
    n, length = rows.filter("n > 0").selectExpr("count(*)", "sum(n)").first()
    rows = rows.withColumn("m", lexical_blocks._gentle(n, length))
    asked = lexical_blocks.prepare(held, n, rows, 3)
    segments = lexical_blocks.build(rows, asked, block_docs=4).collect()
    entered = skipped = 0
    for s in segments:
        segment = {c: np.array(s[c], dtype=np.int64) for c in lexical_blocks._INTS}
        starts = np.concatenate([[0], np.cumsum(segment["sizes"])])
        vectors_ = [dict(zip(segment["terms"][a:b].tolist(), segment["impacts"][a:b].tolist())) for a, b in zip(starts, starts[1:])]
        first = np.concatenate([[0], np.cumsum(segment["block_sizes"])])
        at = np.concatenate([[0], np.cumsum(segment["summary_sizes"])])
        for b, term in enumerate(segment["block_terms"].tolist()):
            inside = [vectors_[d] for d in segment["members"][first[b]:first[b + 1]]]
            assert all(term in v for v in inside)
            summary = dict(zip(segment["summary_terms"][at[b]:at[b + 1]].tolist(), segment["summary_impacts"][at[b]:at[b + 1]].tolist()))
            assert summary == {t: max(v.get(t, 0) for v in inside) for t in summary} and term in summary
        for _, _, _, came, left in lexical_blocks.search_segment(segment, np.arange(len(vectors_)), asked):
            entered, skipped = entered + came, skipped + left
    assert skipped > 0 and entered > 0


def test_ranking_of_odd_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "cat moon", "a"), (1, "cat moon", "b"), (1, "word", "c"), (None, "日本語 é́", "d"), (2, None, "e"), (3, "", "f"), (4, "<|endoftext|> \x00", "g")],
                                  "item_id long, text string, terms string")
    found = lexical_blocks.ranked(odd, items, 2).collect()
    plain = plain_ranking([(r["doc_id"], r["text"]) for r in odd.collect()], [(1, "cat moon"), (1, "word"), (None, "日本語 é́"), (4, "endoftext")], 2)
    assert sorted(map(tuple, found), key=repr) == plain
    assert lexical_blocks.ranked(none, items, 2).collect() == []
    assert lexical_blocks.ranked(odd, items.limit(0), 2).collect() == []
