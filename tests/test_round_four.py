"""What the fourth round's findings asked for, on rows of their own."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import fuzzy, joins


def score(x, y):
    return 100.0 * (1.0 - (len(x) + len(y) - 2 * fuzzy.common_length(x, y)) / (len(x) + len(y)))


@pytest.mark.parametrize("one_task_rows", [fuzzy.ONE_TASK_EDGES, 60])
def test_clusters_of_short_texts_list_no_pairs(spark, monkeypatch, one_task_rows):
    """Numbered names: a row for every text and letter, where there were twelve pairs for every text and more with every name."""
    names = [f"Somebody#{i:08d}" for i in range(700)]  # 17 letters: one may be another at 94
    random.seed(3)
    names += ["Somebody#0000012", "Somebody#00000012x", "Somebody#000000120x", "Somebody#000000120", "Somebody#0000001200", "a", "Somebody#00000b1é"]
    random.shuffle(names)
    df = spark.createDataFrame(list(enumerate(names)), "id long, word string")
    links = fuzzy._links(df, 94)
    pairs = sum(1 for i, x in enumerate(names) for y in names[:i] if score(x, y) >= 94)
    assert pairs > 20_000 and links.count() < 8 * len(names)
    head = {}
    for v in names:
        if v not in head:
            head.update({w: v for w in names if w not in head and score(v, w) >= 94})
    met = {names[r["id"]]: names[r["head"]] for r in fuzzy.heads_by_keys(links, one_task_rows, 50).collect()}
    assert met == {w: v for w, v in head.items() if w in met} and all(head[w] == w for w in names if w not in met)
    monkeypatch.setattr(fuzzy, "similar_pairs", None)
    found = {r["value"]: (r["cluster"], r["score"]) for r in fuzzy.fuzzy_clusters(df, "word", 94, "id").collect()}
    many = {v for w, v in head.items() if w != v}
    assert found == {w: (v, score(w, v)) for w, v in head.items() if v in many}


@pytest.fixture
def many_pairs(monkeypatch):
    """What ``_split`` counted: pairs that meet at the nodes, true ones and others."""
    met, split = [], joins._split

    def counted(points, intervals, keys, *limits):
        n = points.groupBy(*keys).count().withColumnRenamed("count", "a").join(intervals.groupBy(*keys).count(), keys)
        met.append(n.agg(F.sum(F.col("a") * F.col("count"))).first()[0] or 0)
        return split(points, intervals, keys, *limits)

    monkeypatch.setattr(joins, "_split", counted)
    return met


def test_narrow_bands_meet_few_others(spark, many_pairs, monkeypatch):
    """Two pairs for each that belongs together or thereabouts, where a whole bucket met a whole bucket."""
    monkeypatch.setattr(joins, "ROWS_PER_LEAF", 4)
    n = 6000
    values = spark.range(n).select("id", (F.pmod(F.col("id") * 7919, F.lit(n)) + 0.5).alias("v"))
    found = joins.band_join(values, values, "v", "v", 12.0, 25.0, pairs_per_task=50_000, rows_per_bucket=2000)
    want = sum(min(n, i + 26) - max(0, i - 12) for i in range(n))
    assert tuple(found.agg(F.count("*"), F.count_if(F.abs(F.col("v_right") - F.col("v") - 6.5) <= 18.5)).first()) == (want, want)
    assert many_pairs[0] < 3 * want  # 20 times as many before


def test_long_and_short_intervals_choose_their_leaves():
    assert joins._base_level([(2, 10 ** 6)], 10 ** 7, 20_000, 1, 9) == 0  # bands over three buckets
    assert joins._base_level([(9, 1000)], 10 ** 7, 20_000, 1, 9) > 2  # a few long ones: fewer rows, though more pairs


def test_pairs_of_a_left_join_come_in_blocks(spark, tmp_path):
    """Many points in many intervals: tasks by the number of pairs, rows in an order in which both sides repeat, and the file packs."""
    points = spark.range(3000).select(F.xxhash64("id").alias("p"), F.when(F.col("id") % 10 > 0, F.col("id").cast("double")).alias("x"))
    spans = spark.range(400).select(F.xxhash64(F.col("id") + 5000).alias("s"), (F.col("id") * 2.0).alias("low"), (2000.0 + F.col("id")).alias("high"))
    found = joins.interval_join(points, spans, "x", "low", "high", "left", pairs_per_task=40_000, rows_per_part=1000).select("p", "s")
    found.write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    want = [sum(2 * j <= i <= 2000 + j for j in range(400)) if i % 10 else 0 for i in range(3000)]
    assert rows.filter("s IS NOT NULL").count() == rows.filter("s IS NOT NULL").distinct().count() == sum(want)
    assert rows.filter("s IS NULL").count() == want.count(0)
    files = [f for f in (tmp_path / "out").glob("*.parquet")]
    assert len(files) >= 4 and sum(f.stat().st_size for f in files) < sum(want)  # less than a byte a row


@pytest.mark.parametrize("pairs", [20, 2_000, 25_000])  # blocks and parts, blocks, a plain join; leaves are fine in all three
def test_fine_leaves_with_equal_columns(spark, monkeypatch, pairs):
    """Columns that must be equal are still there when few columns of the result are asked for."""
    monkeypatch.setattr(joins, "ROWS_PER_LEAF", 4)
    rows = [(i, i % 2, "ab"[i % 3 > 0], float(i * 37 % 400), float(i * 37 % 400 + i % 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g int, h string, low double, high double")
    found = joins.overlap_join(df, df, "low", "high", on="g,h", pairs_per_task=pairs, rows_per_part=10).groupBy("id").agg(F.count("*").alias("n"), F.sum("id_right").alias("s"))
    want = {}
    for i, g, h, low, high in rows:
        met = [j for j, k, l, since, till in rows if (g, h) == (k, l) and low <= till and since <= high]
        want[i] = (len(met), sum(met))
    assert {r["id"]: (r["n"], r["s"]) for r in found.collect()} == want
