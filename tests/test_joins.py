"""Range joins and null-aware anti joins against plain loops, and their plans without broadcasts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import joins

FOLDER = "/root/testdata/sf0.001"
TINY = {"rows_per_bucket": 5, "pairs_per_task": 40, "rows_per_part": 6}


def plain(points, spans, closed="both"):
    after = {"both": lambda p, l: p >= l, "left": lambda p, l: p >= l}.get(closed, lambda p, l: p > l)
    before = {"both": lambda p, h: p <= h, "right": lambda p, h: p <= h}.get(closed, lambda p, h: p < h)
    fine = lambda x: x is not None and x == x
    return sorted((i, j) for i, p in points for j, low, high in spans if fine(p) and fine(low) and fine(high) and after(p, low) and before(p, high))


@pytest.fixture(scope="module")
def sides(spark):
    random.seed(5)
    value = lambda: random.choice([None, math.nan, math.inf, -math.inf, 3.0, 3.0, 3.0]) if random.random() < 0.2 else round(random.uniform(-20, 20), 1)
    points = [(i, 3.0 if i % 3 == 0 else value()) for i in range(150)]  # a third of all points at one place
    spans = []
    for j in range(60):
        low, size = value(), random.choice([0.0, 0.5, 4.0, 30.0, -1.0])
        spans.append((j, low, None if low is None else low + size))
    return points, spans, spark.createDataFrame(points, "id int, x double").repartition(3), spark.createDataFrame(spans, "id int, low double, x double").repartition(2)


@pytest.mark.parametrize("closed", ["both", "left", "right", "neither"])
@pytest.mark.parametrize("limits", [{}, TINY, {"rows_per_bucket": 1}])
def test_points_in_intervals(sides, closed, limits):
    points, spans, a, b = sides
    found = joins.interval_join(a, b, "x", "low", "x", closed=closed, **limits)
    assert found.columns == ["id", "x", "id_right", "low", "x_right"]
    assert sorted((r["id"], r["id_right"]) for r in found.collect()) == plain(points, spans, closed)


@pytest.mark.parametrize("how", ["left", "semi", "anti"])
def test_other_kinds_keep_repeated_points(spark, sides, how):
    points, spans, a, b = sides
    want = plain(points, spans)
    met = {i for i, _ in want}
    twice = a.unionAll(a)
    found = joins.interval_join(twice, b, "x", "low", "x", how, **TINY).collect()
    if how == "left":
        rest = [(i, None) for i, _ in points if i not in met]
        key = lambda p: (p[0], p[1] is None, p[1] or 0)
        assert sorted([(r["id"], r["id_right"]) for r in found], key=key) == sorted((want + rest) * 2, key=key)
    else:
        assert sorted(r["id"] for r in found) == sorted(2 * [i for i, _ in points if (i in met) == (how == "semi")])


def test_open_ends_equal_columns_and_texts(spark, sides):
    points, spans, a, b = sides
    found = joins.interval_join(a, b, "x", "low", None, on="id", **TINY)
    good = lambda x: x is not None and x == x
    assert sorted(r["id"] for r in found.collect()) == sorted(i for i, p in points for j, low, _ in spans if i == j and good(p) and good(low) and p >= low)
    words = spark.createDataFrame([(w,) for w in ["ant", "bee", "cat", "dog", None, "cat"]], "w string")
    ranges = spark.createDataFrame([("b", "d"), ("cat", "cat"), ("x", None), ("d", "b")], "f string, t string")
    got = sorted((r["w"], r["f"]) for r in joins.interval_join(words, ranges, "w", "f", "t", rows_per_bucket=1).collect())
    assert got == [("bee", "b"), ("cat", "b"), ("cat", "b"), ("cat", "cat"), ("cat", "cat")]
    whole = spark.range(2 ** 60, 2 ** 60 + 9).withColumnRenamed("id", "n")  # beyond what a double tells apart
    pick = whole.filter(F.col("n") == 2 ** 60 + 4).select(F.col("n").alias("low"), (F.col("n") + 1).alias("high"))
    assert sorted(r["n"] - 2 ** 60 for r in joins.interval_join(whole, pick, "n", "low", "high", rows_per_bucket=2).collect()) == [4, 5]


@pytest.mark.parametrize("limits", [{}, TINY])
def test_bands_and_overlaps(spark, limits):
    random.seed(6)
    left = [(i, float(random.randint(0, 60))) for i in range(80)]
    a = spark.createDataFrame(left, "id int, v double")
    found = joins.band_join(a, a, "v", "v", 2.0, 5.0, **limits)
    assert sorted((r["id"], r["id_right"]) for r in found.collect()) == sorted((i, j) for i, x in left for j, y in left if x - 2 <= y <= x + 5)
    spans = [(i, low := random.randint(0, 50), low + random.choice([0, 0, 1, 9, 40, -3])) for i in range(60)]
    b = spark.createDataFrame(spans, "id int, low int, high int")
    found = joins.overlap_join(b, b, "low", "high", **limits)
    assert found.columns == ["id", "low", "high", "id_right", "low_right", "high_right"]
    assert sorted((r["id"], r["id_right"]) for r in found.collect()) == sorted(
        (i, j) for i, a0, a1 in spans for j, b0, b1 in spans if a0 <= a1 and b0 <= b1 and a0 <= b1 and b0 <= a1)


def test_empty_sides(spark, sides):
    _, _, a, b = sides
    none_a, none_b = a.limit(0), b.limit(0)
    assert joins.interval_join(none_a, b, "x", "low", "x").collect() == [] and joins.interval_join(a, none_b, "x", "low", "x").collect() == []
    assert joins.interval_join(a, none_b, "x", "low", "x", "anti").count() == 150 and joins.interval_join(a, none_b, "x", "low", "x", "left").count() == 150
    for wrong in ({"how": "full"}, {"closed": "open"}, {"low": None, "high": None}, {"point": "none"}):
        with pytest.raises(ValueError):
            joins.interval_join(a, b, **({"point": "x", "low": "low", "high": "x"} | wrong))


def test_wide_intervals_have_few_rows(spark):
    """An interval over all buckets is stored at both ends and at a few nodes per level, not in every bucket."""
    nodes = spark.range(1).select(joins._nodes(F.lit(3), F.lit(1020), 10).alias("n")).first()["n"]
    covered = []
    for n in nodes[2:]:
        level, place = divmod(n, joins.LEVEL)
        covered += range(place << level, (place + 1) << level)
    assert sorted(covered) == list(range(4, 1020)) and len(nodes) <= 20 and sorted(nodes[:2]) == [3, 1020]


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_plans_without_broadcasts(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
        spans = spark.read.parquet(f"{FOLDER}/supplier.parquet").selectExpr("s_acctbal * 20 AS low", "s_acctbal * 20 + 9000 AS high")
        made = [joins.interval_join(orders, spans, "o_totalprice", "low", "high"), joins.band_join(orders, orders, "o_totalprice", "o_totalprice", 9.0, 9.0),
                joins.interval_join(orders, spans, "o_totalprice", "low", "high", "anti"), joins.not_in(orders, "o_custkey", orders.filter("o_orderstatus = 'F'"), "o_custkey")]
        for df in made:
            plan = _plan(df)
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "BroadcastExchange" not in plan and "SortMergeJoin" in plan
            assert df.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


@pytest.mark.parametrize("listed, want", [([2, 3], [1]), ([2, None], []), ([], [None, 1, 2, 2]), ([None], []), ([7], [1, 2, 2])])
def test_not_in(spark, listed, want):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "listed int, t string")
    found = joins.not_in(df, "listed", spark.createDataFrame([(x,) for x in listed], "k int"), "k")
    assert sorted([r["listed"] for r in found.collect()], key=lambda x: (x is not None, x or 0)) == want


def test_points_with_and_without_intervals_need_no_pairs(spark, monkeypatch):
    """Semi and anti joins lay both sides out in order, and a left join sends its pairs straight to the result."""
    made = []
    real = joins._pairs
    monkeypatch.setattr(joins, "_pairs", lambda *a: made.append(1) or real(*a))
    monkeypatch.setattr(joins.ordered, "ROWS_PER_RANGE", 7)
    random.seed(11)
    points = [(i, random.choice([None, 1, 2]), random.choice([None, float("nan"), *map(float, range(30))])) for i in range(120)]
    spans = [(random.choice([None, 1, 2]), random.choice([None, *range(30)]), random.choice([None, *range(30)])) for _ in range(9)]
    a, b = spark.createDataFrame(points, "id int, g int, x double"), spark.createDataFrame(spans, "g int, low int, high int")
    good = lambda x: x is not None and x == x
    for closed, low, high, on in (("both", "low", "high", "g"), ("neither", "low", "high", None), ("left", "low", None, "g"), ("right", None, "high", None)):
        above = lambda p, e: low is None or e is not None and (p >= e if closed in ("both", "left") else p > e)
        below = lambda p, e: high is None or e is not None and (p <= e if closed in ("both", "right") else p < e)
        want = sorted(i for i, g, x in points if good(x) and any((not on or g is not None and g == h) and above(x, f) and below(x, t) for h, f, t in spans))
        for how, ids in (("semi", want), ("anti", sorted({i for i, _, _ in points} - set(want)))):
            assert sorted(r["id"] for r in joins.interval_join(a, b, "x", low, high, how, on=on, closed=closed).collect()) == ids
    assert not made
    left = joins.interval_join(a, b, "x", "low", "high", "left", on="g")
    assert left._jdf.queryExecution().optimizedPlan().nodeName() == "Union" and {r["id"] for r in left.collect()} == set(range(120))


def test_a_bucket_is_looked_up_once(spark):
    stays = spark.range(300).selectExpr("id % 3 AS g", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) AS since").selectExpr("*", "since + INTERVAL 3 HOURS AS till")
    met = joins.overlap_join(stays, stays, "since", "till", on="g", rows_per_bucket=10)
    assert "aggregate(" not in _plan(met) and len(_plan(met)) < 60_000 and met.count() == 300 + 2 * 297
