"""The data behind charts and reports: bars, histograms, points, boxes, grids, profiles, comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import (
    as_list, as_number, missing, name, numeric_columns, present, require, require_numeric, text_columns,
)
from quarry.operators import ordered, rows, stats
from quarry.operators.geo import grid_counts


def bar_frame(df: DataFrame, cat: str, num: str, agg: str | None = None, stack: str | None = None) -> DataFrame:
    """One bar per category, or per category and stack (missing bars 0); without ``agg`` the plain values."""
    require(df, cat, num, stack)
    if agg is None:
        return df.select(*map(name, [c for c in (cat, stack, num) if c]))
    keys = [c for c in (cat, stack) if c]
    if agg not in ("sum", "mean", "count", "min", "max", "median"):
        raise ValueError("agg must be sum, mean, count, min, max or median")
    if stack is None:
        return stats.groupby(df, keys, [(num, agg)]).withColumnRenamed(f"{num}_{agg}", agg)
    wide = stats.groupby_pivot(df, keys, [(num, agg)])
    return wide.na.fill(0).toDF(*[c.removesuffix(f"_{num}_{agg}") for c in wide.columns])


def hist_frame(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width counts (bin, low, high, n); bins closed on the left, the last one on both sides."""
    require_numeric(df, col)
    x = F.when(~missing(df, col), name(col).cast("double"))
    low, high = df.agg(F.min(x), F.max(x)).first()
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin int, low double, high double, n long")
    if low == high:
        low, high = low - 0.5, high + 0.5
    number = F.least(F.lit(bins - 1), F.floor((x - low) / (high - low) * bins)).cast("int")
    counted = df.filter(x.isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (high - low) / bins
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def scatter_frame(df: DataFrame, x: str, y: str, max_points: int | None = None, key: str | Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Points with both coordinates; with ``max_points`` a repeatable sample of that size."""
    require(df, x, y)
    points = present(df, x, y)
    if max_points is not None:
        points = rows.sample(points, n=max_points, key=key, seed=seed)
    return points.select(name(x).alias("x"), name(y).alias("y"))


def line_frame(df: DataFrame, x: str, y: str, buckets: int | None = None) -> DataFrame:
    """Points ordered by x, or min, max and average of y in equal-width stretches of x."""
    require(df, x, y)
    points = present(df, x, y)
    if buckets is None:
        return points.select(name(x).alias("x"), name(y).alias("y")).orderBy("x", "y")
    at = as_number(df, x)
    low, high = points.agg(F.min(at), F.max(at)).first()
    if low is None:
        return points.limit(0).select(F.lit(0).alias("bucket"), F.lit(0.0).alias("min_y"), F.lit(0.0).alias("max_y"), F.lit(0.0).alias("avg_y"))
    span = (high - low) or 1.0
    number = F.least(F.lit(buckets - 1), F.floor((at - low) / span * buckets)).cast("int")
    return points.groupBy(number.alias("bucket")).agg(
        F.min(name(y)).alias("min_y"), F.max(name(y)).alias("max_y"), F.avg(name(y)).alias("avg_y")).orderBy("bucket")


def box_frame(df: DataFrame, cols: str | Sequence[str]) -> DataFrame:
    """(column, min, q1, median, q3, max), exact."""
    cols = as_list(cols)
    require_numeric(df, *cols)
    points = ordered.quantiles(df, cols, [0.0, 0.25, 0.5, 0.75, 1.0])
    heads = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    return points.groupBy("column").agg(*[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(h) for h, p in heads.items()])


def heatmap_frame(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    return grid_counts(df, y, x, bins, "y_bin", "x_bin")


def pair_frame(df: DataFrame, cols: str | Sequence[str], key: str | Sequence[str], max_points: int = 1000, bins: int = 10,
               seed: int = 0) -> DataFrame:
    """Scatter matrix as (row, col, x, y, n): histograms on the diagonal, one shared sample off it."""
    cols = as_list(cols)
    require_numeric(df, *cols)
    points = rows.sample(df, n=max_points, key=key, seed=seed)
    shape = lambda r, c, x, y, n: [F.lit(r).alias("row"), F.lit(c).alias("col"), x.cast("double").alias("x"), y.cast("double").alias("y"), n.cast("long").alias("n")]
    none = F.lit(None)
    cells = [F.struct(*shape(b, a, name(a), name(b), none)) for a in cols for b in cols if a != b]
    result = points.select(F.inline(F.array(*cells)))
    drawn = stats.histograms(df, list(dict.fromkeys(cols)), bins)
    return result.unionByName(drawn.select(F.col("column").alias("row"), F.col("column").alias("col"), F.col("low").alias("x"), none.cast("double").alias("y"), "n"))


def _ratios(df: DataFrame, cats: Sequence[str], nums: Sequence[str]) -> DataFrame:
    """(a, b, kind, value): the correlation ratio of every number given every category, from one scan."""
    at = [F.when(~missing(df, m), name(m).cast("double")).alias(f"x{i}") for i, m in enumerate(nums)]
    labels = F.array(*[F.struct(F.lit(c).alias("b"), name(c).cast("string").alias("label")) for c in cats])
    groups = df.select(*at, F.inline(labels)).filter("label IS NOT NULL").groupBy("b", "label").agg(*[x for i in range(len(nums)) for x in (
        F.count(f"x{i}").alias(f"n{i}"), F.avg(f"x{i}").alias(f"m{i}"), F.var_pop(f"x{i}").alias(f"v{i}"))])
    # weighted spread of the group means over the whole spread
    sums = groups.groupBy("b").agg(*[x for i in range(len(nums)) for x in (
        F.sum(F.col(f"n{i}") * F.col(f"v{i}")).alias(f"w{i}"), F.sum(f"n{i}").alias(f"n{i}"),
        F.sum(F.col(f"n{i}") * F.col(f"m{i}")).alias(f"s{i}"), F.sum(F.col(f"n{i}") * F.col(f"m{i}") * F.col(f"m{i}")).alias(f"q{i}"))])
    found = []
    for i, m in enumerate(nums):
        between = F.greatest(F.lit(0.0), F.col(f"q{i}") - F.col(f"s{i}") * F.col(f"s{i}") / F.nullif(F.col(f"n{i}"), F.lit(0)))
        found.append(F.struct(F.lit(m).alias("a"), F.lit("correlation_ratio").alias("kind"), F.sqrt(F.try_divide(between, between + F.col(f"w{i}"))).alias("value")))
    return sums.select("b", F.inline(F.array(*found))).select("a", "b", "kind", "value")


def _uncertainties(df: DataFrame, cats: Sequence[str]) -> DataFrame:
    """(a, b, kind, value): the uncertainty coefficient of every category given every other, from one scan."""
    pairs = list(combinations(cats, 2))
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), name(a).cast("string").alias("x"), name(b).cast("string").alias("y")) for a, b in pairs])
    joint = df.select(F.inline(cells)).filter("x IS NOT NULL AND y IS NOT NULL").groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    side = lambda of, x, y: F.struct(F.lit(of).alias("of"), x.alias("x"), y.alias("y"))
    none = F.lit(None).cast("string")
    # the pair's own counts and those of either side, told apart by what they are of
    sides = F.array(side("xy", F.col("x"), F.col("y")), side("x", F.col("x"), none), side("y", none, F.col("y")))
    counts = joint.select("a", "b", "n", F.explode(sides).alias("s")).groupBy("a", "b", "s").agg(F.sum("n").alias("n"))
    n = F.sum("n")
    entropies = counts.groupBy("a", "b", F.col("s.of").alias("of")).agg((F.log(n) - F.sum(F.col("n") * F.log("n")) / n).alias("h"))
    every = entropies.groupBy("a", "b").agg(*[F.max(F.when(F.col("of") == of, F.col("h"))).alias(f"h{of}") for of in ("x", "y", "xy")])
    shared = F.col("hx") + F.col("hy") - F.col("hxy")
    one = lambda a, b, own: F.struct(a.alias("a"), b.alias("b"), F.lit("uncertainty").alias("kind"), F.try_divide(shared, own).alias("value"))
    names = every.select(F.inline(F.array(one(F.col("a"), F.col("b"), F.col("hx")), one(F.col("b"), F.col("a"), F.col("hy")))))
    asked = df.sparkSession.createDataFrame([p for a, b in pairs for p in ((a, b), (b, a))], "a string, b string")
    return asked.join(names, ["a", "b"], "left").select("a", "b", F.lit("uncertainty").alias("kind"), "value")


def associations(df: DataFrame, categories: Sequence[str] | None = None, numbers: Sequence[str] | None = None) -> DataFrame:
    """(a, b, kind, value): correlation between numbers, correlation ratio of a number given a category,
    uncertainty coefficient of one category given another. One scan for each kind, however many columns."""
    cats = list(categories if categories is not None else text_columns(df))
    nums = list(numbers if numbers is not None else numeric_columns(df))
    require(df, *cats, *nums)
    parts = []
    if nums:
        parts.append(stats.corr_pearson(df, cols=nums).filter("a <> b").select("a", "b", F.lit("correlation").alias("kind"), F.col("corr").alias("value")))
    if cats and nums:
        asked = df.sparkSession.createDataFrame([(m, c) for m in nums for c in cats], "a string, b string")
        parts.append(asked.join(_ratios(df, cats, nums), ["a", "b"], "left").select("a", "b", F.lit("correlation_ratio").alias("kind"), "value"))
    if len(cats) > 1:
        parts.append(_uncertainties(df, cats))
    if not parts:
        return df.sparkSession.createDataFrame([], "a string, b string, kind string, value double")
    return reduce(DataFrame.unionByName, parts)


def eda(df: DataFrame) -> dict[str, DataFrame]:
    """Everything a first look needs: column profile, summary, associations, size."""
    size = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))
    return {"size": size, "profile": stats.profile(df), "summary": stats.describe(df), "associations": associations(df)}


def schema_diff(before: DataFrame, after: DataFrame) -> list[tuple[str, str, str | None, str | None]]:
    """(column, change, type before, type after) for added, removed and modified columns."""
    old, new = dict(stats.column_types(before)), dict(stats.column_types(after))
    diff = [(c, "added", None, t) for c, t in new.items() if c not in old]
    diff += [(c, "removed", t, None) for c, t in old.items() if c not in new]
    return diff + [(c, "modified", old[c], new[c]) for c in old if c in new and old[c] != new[c]]


def compare_tables(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(section, column, metric, before, after) of schema changes, row counts and column summaries."""
    spark = current.sparkSession
    changes = spark.createDataFrame(
        [("schema", c, kind, a, b) for c, kind, a, b in schema_diff(snapshot, current)],
        "section string, column string, metric string, before string, after string")
    def summed(df: DataFrame, out: str) -> DataFrame:
        shown = F.coalesce(F.round("value", 6).cast("string"), F.col("text"))
        counted = df.agg(F.count(F.lit(1)).cast("string").alias(out)).select(F.lit("rows").alias("section"), F.lit("*").alias("column"), F.lit("count").alias("metric"), out)
        return counted.unionByName(stats.describe(df).select(F.lit("summary").alias("section"), "column", "metric", shown.alias(out)))
    both = summed(snapshot, "before").join(summed(current, "after"), ["section", "column", "metric"], "full")
    return changes.unionByName(both.select(*changes.columns))


def map_points(df: DataFrame, lat: str, lon: str, order_by: str | Sequence[str], limit: int = 1000) -> DataFrame:
    """The first ``limit`` points that have coordinates other than 0, with the extent of those points."""
    order = as_list(order_by)
    require(df, lat, lon, *order)
    usable = present(df, lat, lon).filter((name(lat) != 0) & (name(lon) != 0))
    shown = usable.orderBy(*[name(c).asc_nulls_last() for c in order]).limit(limit)
    whole = Window.partitionBy(F.lit(0))  # at most ``limit`` rows
    return shown.select("*", F.min(name(lat)).over(whole).alias("min_lat"), F.max(name(lat)).over(whole).alias("max_lat"),
                        F.min(name(lon)).over(whole).alias("min_lon"), F.max(name(lon)).over(whole).alias("max_lon"))


