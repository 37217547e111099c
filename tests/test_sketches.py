"""Approximate modes keep their bounds and read their table once; cross tables have no limit on labels."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import frames, stats

FOLDER = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("made", [
    lambda t: stats.profile(t, approx=True), lambda t: stats.describe(t, approx=True), lambda t: stats.groupby(t, "l_returnflag", "l_tax:median,l_quantity:mean", approx=True)])
def test_one_scan_and_no_shuffle_by_value(spark, made):
    found = plan(made(spark.read.parquet(f"{FOLDER}/lineitem.parquet")))
    assert found.count("FileScan") == 1 and found.count("Exchange") == 1 and "Generate" not in found.split("Exchange")[1]


def test_frequent_values_within_the_bound(spark):
    random.seed(9)
    items, n = 64, 40_000
    values = ["hot"] * 12_000 + ["warm"] * 5_000 + [f"v{random.randrange(20_000)}" for _ in range(n - 17_000)]
    random.shuffle(values)
    df = spark.createDataFrame([(v, float(i)) for i, v in enumerate(values)], "v string, x double").repartition(6)
    held = {r["value"]: r["n"] for r in stats.profile(df, top=5, approx=True, items=items).filter("column = 'v' AND rank IS NOT NULL").collect()}
    true = Counter(values)
    assert {"hot", "warm"} <= set(held)
    assert all(true[v] <= k <= true[v] + 3.5 * n / items for v, k in held.items())
    few = stats.profile(df.withColumn("v", F.substring("v", 1, 2)), top=3, approx=True).filter("column = 'v'")  # few values: exact
    exact = stats.profile(df.withColumn("v", F.substring("v", 1, 2)), top=3).filter("column = 'v'")
    assert [tuple(r)[3:] for r in few.orderBy("rank").collect()] == [tuple(r)[3:] for r in exact.orderBy("rank").collect()]


def test_approximate_ranks_and_counts(spark):
    df = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_extendedprice", "l_partkey", "l_shipdate")
    n = df.count()
    points = {r["metric"]: r["value"] for r in stats.describe(df, [0.1, 0.9], approx=True).filter("column = 'l_extendedprice'").collect()}
    for p in (0.1, 0.5, 0.9):
        below, upto = df.select(F.count_if(F.col("l_extendedprice") < points[f"{p * 100:g}%"]), F.count_if(F.col("l_extendedprice") <= points[f"{p * 100:g}%"])).first()
        assert below / n <= p + 2 / stats.ACCURACY and upto / n >= p - 2 / stats.ACCURACY
    near, true = (f.filter("column = 'l_partkey'").first()["unique_pct"] for f in (stats.profile(df, 1, approx=True), stats.profile(df, 1)))
    assert abs(near - true) <= 5 * stats.RELATIVE_ERROR * true


def test_profile_of_empty_and_missing(spark):
    rows = [(None, None, None), (float("nan"), "a", 1), (1.0, None, 1)]
    df = spark.createDataFrame(rows, "x double, `odd name.s` string, rows int")
    for approx in (False, True):
        found = {(r["column"], r["rank"]): (r["non_null_pct"], r["value"], r["n"]) for r in stats.profile(df, approx=approx, histogram=True).collect()}
        assert found["odd name.s", 1] == (pytest.approx(100 / 3), "a", 1) and found["rows", 1] == (pytest.approx(200 / 3), "1", 2)
        assert found["x", 1] == (pytest.approx(100 / 3), "1.0", 1)
        none = stats.profile(spark.createDataFrame([(None,)], "z string"), approx=approx).collect()
        assert [(r["column"], r["non_null_pct"], r["rank"], r["value"]) for r in none] == [("z", 0.0, None, None)]
    bars = stats.profile(df, histogram=True).filter("column = 'rows' AND rank = 1").first()["histogram"]
    assert len(bars) == 20 and sum(b["n"] for b in bars) == 2 and (bars[0]["low"], bars[-1]["high"]) == (0.5, 1.5)
    assert stats.profile(df, histogram=True).filter("column = 'odd name.s'").first()["histogram"] is None
    with pytest.raises(ValueError):
        stats.profile(df, sample=0)


def test_sample_of_a_profile_is_exact_and_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k").withColumn("v", F.col("k") % 7)
    a, b = (stats.profile(d, sample=0.2, key="k", seed=5).orderBy("column", "rank").collect() for d in (df, df.repartition(7)))
    assert a == b and {r["unique_pct"] for r in a if r["column"] == "k"} == {100.0} and sum(r["n"] for r in a if r["column"] == "k") == 5


def test_histograms_of_many_columns_share_scans(spark):
    df = spark.read.parquet(f"{FOLDER}/part.parquet")
    found = stats.histograms(df, ["p_size", "p_retailprice", "p_partkey"], 8)
    assert plan(found).count("FileScan") == 1
    for c in ("p_size", "p_retailprice"):
        want = [(r["bin"], r["low"], r["high"], r["n"]) for r in frames.hist_frame(df, c, 8).orderBy("bin").collect()]
        assert [(r["bin"], r["low"], r["high"], r["n"]) for r in found.filter(F.col("column") == c).orderBy("bin").collect()] == want


def test_associations_read_the_table_once_per_kind(spark):
    df = spark.read.parquet(f"{FOLDER}/part.parquet")
    few = plan(frames.associations(df, ["p_brand", "p_type"], ["p_size", "p_retailprice"])).count("FileScan")
    many = plan(frames.associations(df.withColumn("more", F.substring("p_name", 1, 2)), ["p_brand", "p_type", "p_name", "more"], ["p_size", "p_retailprice", "p_partkey"])).count("FileScan")
    assert few == many <= 4


def test_crosstab_of_twenty_thousand_labels(spark):
    """No pivot, no limit: the cells that occur, with margins, and all pairs of labels counted without being shuffled."""
    n = 20_000
    df = spark.range(n).select(F.concat(F.lit("r"), "id").alias("a"), F.concat(F.lit("c"), F.pmod(F.col("id") * 7919, F.lit(n))).alias("b"))
    sparse = stats.crosstab(df, "a", "b", margins=True, zeros=False)
    assert sparse.count() == 3 * n + 1 and sparse.filter("row = 'All' AND col = 'All'").first()["value"] == n
    full = stats.crosstab(df.filter("a < 'r1008'"), "a", "b")
    rows = df.filter("a < 'r1008'").count()
    assert tuple(full.selectExpr("count(*)", "sum(value)", "count_if(value = 0)").first()) == (rows * rows, rows, rows * (rows - 1))
    whole = stats.crosstab(df, "a", "b", normalize="index")
    assert "Pivot" not in plan(whole) and whole.filter("row = 'r5'").selectExpr("count(*)", "sum(value)").first() == (n, 1.0)


@pytest.mark.parametrize("normalize", [None, "index", "columns", "all"])
def test_crosstab_blocks(spark, normalize):
    import pandas as pd

    random.seed(3)
    pairs = [(random.choice("abcde"), random.choice("uvwxyz")) for _ in range(60)] + [(None, "u"), ("a", None)]
    df = spark.createDataFrame(pairs, "p string, q string")
    frame = pd.DataFrame([x for x in pairs if None not in x], columns=["p", "q"])
    want = pd.crosstab(frame["p"], frame["q"], normalize=normalize or False, margins=True)
    for block in (1, 4, 1000):
        cells = stats._crosstab_cells(df, "p", "q", normalize, True, block=block).collect()
        got = {(r["row"], r["col"]): r["value"] for r in cells}
        assert len(cells) == len(got) == want.size and all(got[i, j] == pytest.approx(want.loc[i, j]) for i in want.index for j in want.columns)
