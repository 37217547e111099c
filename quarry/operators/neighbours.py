"""Exact nearest neighbours: against a small broadcast set, or between two large sets by a cell tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import as_list, haversine_km, missing, name, numeric_columns, present, require, require_numeric
from quarry.operators import ordered
from quarry.session import write_out

BROADCAST_CELLS = 100_000  # numbers in the broadcast matrix; beyond, the cell tree also does less work
BLOCK_CELLS = 4_000_000
LEAF_POINTS = 1_000
FINE_LEAF_POINTS = 128  # where there are more points than fill a leaf
PROBES = 4_096  # vectors sent to every task, whose distances bound the search over vectors with gaps
MAX_TREE_LEVELS = 15
MAX_PATTERNS = 32  # patterns of gaps, of queries and of points, up to which every pair of patterns has a tree of its own
VISITS_PER_TASK = 50_000

Distance = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[None, :, j]) ** 2
    return total


def euclidean_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(_squares(a, b))


def gap_aware_block(width: int) -> Distance:
    """Euclidean over the coordinates both rows have, scaled up to ``width``; NaN when they share none."""
    def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total, shared = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
        for j in range(a.shape[1]):
            both = ~np.isnan(a[:, j, None]) & ~np.isnan(b[None, :, j])
            total += np.where(both, np.nan_to_num(a[:, j, None] - b[None, :, j]) ** 2, 0.0)
            shared += both
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(shared > 0, np.sqrt(total / shared * width), np.nan)
    return distance


def closest_flat(queries: np.ndarray, points: np.ndarray, k: int, distance: Distance, slack: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (query, position, distance): the ``k`` nearest points of every query in order, the earlier point on a tie; with ``slack`` near ties as well."""
    step = max(1, BLOCK_CELLS // max(1, len(points)))
    for start in range(0, len(queries), step):
        block = distance(queries[start:start + step], points)
        far = np.where(np.isnan(block), np.inf, block)
        kth = np.partition(far, min(k, far.shape[1]) - 1, axis=1)[:, min(k, far.shape[1]) - 1]
        who, which = np.nonzero((far <= (kth * (1 + slack) + 1e-11 if slack else kth)[:, None]) & np.isfinite(far))
        d = far[who, which]
        order = np.lexsort((d, who))  # stable: earlier points first among equals
        who, which, d = who[order], which[order], d[order]
        if not slack:
            first = np.arange(len(who)) - np.searchsorted(who, who) < k
            who, which, d = who[first], which[first], d[first]
        yield who + start, which, d


def closest(queries: np.ndarray, points: np.ndarray, k: int, distance: Distance, slack: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per query the positions and distances of ``closest_flat``."""
    done = 0
    for who, which, d in closest_flat(queries, points, k, distance, slack):
        upto = min(len(queries), done + max(1, BLOCK_CELLS // max(1, len(points))))
        ends = np.searchsorted(who, np.arange(done + 1, upto))
        yield from zip(np.split(which, ends), np.split(d, ends))
        done = upto


def _matches(left: pd.DataFrame, a: np.ndarray, ids: np.ndarray, b: np.ndarray, k: int, distance: Distance, slack: float = 0.0) -> pd.DataFrame:
    """(v, d, p) of the points ``b`` with their ``ids`` nearest to the vectors ``a`` of ``left``."""
    found = list(closest_flat(a, b, k, distance, slack))
    who, which, d = (np.concatenate([f[i] for f in found]) for i in range(3))
    return pd.DataFrame({"v": left["v"].to_numpy()[who], "d": d, "p": ids[which]})


def _grow_cells(sample: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Split dimension and position of a complete binary tree, halving a sample at medians."""
    dim, cut = np.zeros(2 ** levels - 1, dtype=int), np.zeros(2 ** levels - 1)

    def split(node: int, rows: np.ndarray, level: int) -> None:
        if level == levels:
            return
        if len(rows):
            spread = rows.max(axis=0) - rows.min(axis=0)
            dim[node] = int(spread.argmax())
            cut[node] = float(np.median(rows[:, dim[node]]))
        above = rows[:, dim[node]] > cut[node]
        split(2 * node + 1, rows[~above], level + 1)
        split(2 * node + 2, rows[above], level + 1)

    split(0, sample, 0)
    return dim, cut


def _leaf_of(points: np.ndarray, dim: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    node = np.zeros(len(points), dtype=int)
    for _ in range(levels):
        node = 2 * node + 1 + (points[np.arange(len(points)), dim[node]] > cut[node])
    return node - (2 ** levels - 1)


def _box_gap(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.sqrt((np.maximum(0.0, np.maximum(low - points, points - high)) ** 2).sum(axis=1))


def _box_reach(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.sqrt((np.maximum(np.abs(points - low), np.abs(high - points)) ** 2).sum(axis=1))


def _one_cell(queries: DataFrame, points: DataFrame, k: int, slack: float) -> DataFrame:
    """``cells_join`` where the points fill one cell: they are sent to the queries, with the same distances and ties."""
    held = points.orderBy("p").collect()  # at most the points of a cell
    shared = points.sparkSession.sparkContext.broadcast(([r["p"] for r in held], np.array([r["v"] for r in held], dtype=float)))
    near = T.ArrayType(T.StructType([T.StructField("d", T.DoubleType()), T.StructField("p", points.schema["p"].dataType)]))
    shape = T.StructType([T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("near", near)])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, at = shared.value
        for pdf in batches:
            if len(pdf):
                found = closest(np.stack(pdf["v"].to_numpy()).astype(float), at, k, euclidean_block, slack)
                yield pd.DataFrame({"v": pdf["v"], "near": [[{"d": float(d), "p": ids[i]} for i, d in zip(which, far)] for which, far in found]})

    return queries.select("v").mapInPandas(search, shape)


def cells_join(queries: DataFrame, points: DataFrame, k: int, leaf_points: int = LEAF_POINTS,
               visits_per_task: int = VISITS_PER_TASK, slack: float = 0.0) -> DataFrame:
    """(v, near): the ``k`` nearest points (d, p) of every distinct query vector, exactly.

    With ``slack`` also all points whose distance exceeds the k-th by no more than that share of it (and 1e-11), for
    callers that decide ties by a measure of their own.
    ``queries`` has distinct ``v`` and ``points`` a sortable ``p`` and ``v``. A tree over a bounded
    sample cuts space into cells. From the cells' true extents and sizes every query gets a radius that
    is sure to hold k points, and visits the cells within it. A cell with many visits is copied to as
    many tasks as its visits need.
    """
    spark = points.sparkSession
    points = write_out(points.select("p", "v"))
    rows = points.count()
    dims = points.select(F.size("v")).first()[0] if rows else 0
    if not rows:
        return queries.select("v", F.array().cast("array<struct<d: double, p: string>>").alias("near"))
    if rows <= leaf_points:  # one cell: every query would visit it
        return _one_cell(queries, points, k, slack)
    levels = min(MAX_TREE_LEVELS, max(1, int(np.ceil(np.log2(rows / min(leaf_points, FINE_LEAF_POINTS))))))
    wanted = 16 * 2 ** levels  # half a million vectors at most
    sample = np.array([r[0] for r in points.select("v").sample(min(1.0, 1.5 * wanted / rows), seed=5).limit(2 * wanted).collect()] or
                      [points.first()["v"]], dtype=float)
    dim, cut = _grow_cells(sample, levels)
    leaves = 2 ** levels

    @F.pandas_udf(T.IntegerType())
    def leaf_of(v: pd.Series) -> pd.Series:
        return pd.Series(_leaf_of(np.stack(v.to_numpy()).astype(float), dim, cut, levels).astype("int32"))

    placed = write_out(points.withColumn("leaf", leaf_of("v")))
    extents = placed.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.min(F.col("v")[i]) for i in range(dims)]).alias("low"),
        F.array(*[F.max(F.col("v")[i]) for i in range(dims)]).alias("high")).collect()  # one row per cell
    count = np.zeros(2 * leaves - 1, dtype=np.int64)
    low, high = np.full((2 * leaves - 1, dims), np.inf), np.full((2 * leaves - 1, dims), -np.inf)
    for r in extents:
        node = leaves - 1 + r["leaf"]
        count[node], low[node], high[node] = r["n"], r["low"], r["high"]
    for node in reversed(range(leaves - 1)):
        a, b = 2 * node + 1, 2 * node + 2
        count[node], low[node], high[node] = count[a] + count[b], np.minimum(low[a], low[b]), np.maximum(high[a], high[b])
    tree = spark.sparkContext.broadcast((dim, cut, count, low, high))

    @F.pandas_udf("array<int>")
    def visited(v: pd.Series) -> pd.Series:
        dim_, cut_, count_, low_, high_ = tree.value
        at = np.stack(v.to_numpy()).astype(float)
        # the smallest reach of a box on the way down that holds k points
        node, radius = np.zeros(len(at), dtype=int), _box_reach(at, low_[0], high_[0])
        for _ in range(levels):
            node = 2 * node + 1 + (at[np.arange(len(at)), dim_[node]] > cut_[node])
            enough = count_[node] >= k
            reach = np.where(enough, _box_reach(at, np.where(enough[:, None], low_[node], 0.0), np.where(enough[:, None], high_[node], 0.0)), np.inf)
            radius = np.minimum(radius, reach)
        radius = radius * (1 + 1e-12 + slack) + (1e-11 if slack else 0.0)
        who, where = np.arange(len(at)), np.zeros(len(at), dtype=int)
        for _ in range(levels):
            who, where = np.repeat(who, 2), (2 * where[:, None] + np.array([1, 2])).ravel()
            full = count_[where] > 0
            who, where = who[full], where[full]
            close = _box_gap(at[who], low_[where], high_[where]) <= radius[who]
            who, where = who[close], where[close]
        order = np.argsort(who, kind="stable")
        ends = np.searchsorted(who[order], np.arange(1, len(at)))
        return pd.Series([x.astype("int32") for x in np.split(where[order] - (leaves - 1), ends)])

    visits = write_out(queries.select("v", F.explode(visited("v")).alias("leaf")))
    copies = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / visits_per_task).cast("int").alias("copies"))
    # fresh column identities, so that the two sides of the cogroup share none
    asked = visits.join(copies, "leaf").select(F.col("leaf").alias("cell"), F.pmod(F.xxhash64("v"), F.col("copies")).cast("int").alias("copy"), F.col("v").alias("v"))
    offered = placed.join(copies, "leaf").select(F.col("leaf").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"),
                                                 F.col("p").alias("p"), F.col("v").alias("v"))
    kind = points.schema["p"].dataType

    def match(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"v": [], "d": [], "p": []})
        right = right.sort_values("p", kind="stable")
        a, b = np.stack(left["v"].to_numpy()).astype(float), np.stack(right["v"].to_numpy()).astype(float)
        ids = right["p"].to_numpy()
        return _matches(left, a, ids, b, k, euclidean_block, slack)

    shape = T.StructType([T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("d", T.DoubleType()), T.StructField("p", kind)])
    pairs = asked.groupBy("cell", "copy").cogroup(offered.groupBy("cell", "copy")).applyInPandas(match, shape)
    # k candidates per visited cell, and their ties
    ranked = pairs.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("d", "p"))).alias("near"))
    if not slack:
        return ranked.select("v", F.slice("near", 1, k).alias("near"))
    reach = F.get("near", F.least(F.lit(k), F.size("near")) - 1)["d"] * (1 + slack) + 1e-11
    return ranked.withColumn("_reach", reach).select("v", F.filter("near", lambda x: x["d"] <= F.col("_reach")).alias("near"))


def _on_sphere(lat: Column, lon: Column) -> Column:
    flat = F.cos(F.radians(lat))
    return F.array(flat * F.cos(F.radians(lon)), flat * F.sin(F.radians(lon)), F.sin(F.radians(lat)))


def nearest(df: DataFrame, lat: str, lon: str, poi: DataFrame, k: int = 1, out_id: str = "nearest_poi_id",
            out_dist: str = "nearest_poi_dist_km", leaf_points: int = LEAF_POINTS) -> DataFrame:
    """The ``k`` nearest points of interest (id, lat, lon) by great-circle distance, rounded to a millionth of a metre; the smaller id on a tie.

    Scalars for k = 1, arrays otherwise; rows without coordinates get null. The cell tree finds the nearest places and all
    that come as near but for rounding; one distance formula then decides, so the answer does not depend on the number of
    rows or cells. Points at one place are collapsed to their ``k`` smallest ids first.
    """
    require(df, lat, lon)
    require(poi, "id", "lat", "lon")
    if k < 1:
        raise ValueError("k must be positive")
    poi = present(poi, "id", "lat", "lon").select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    here = Window.partitionBy("lat", "lon").orderBy("id")
    held = poi.withColumn("_no", F.row_number().over(here)).filter(F.col("_no") <= k).groupBy("lat", "lon").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    sites = write_out(ordered.number_rows(write_out(held), ["lat", "lon"], out="p").withColumn("v", _on_sphere(F.col("lat"), F.col("lon"))))
    asked = present(df, lat, lon).select(name(lat).cast("double").alias("_lat"), name(lon).cast("double").alias("_lon")).distinct()
    asked = write_out(asked.withColumn("v", _on_sphere(F.col("_lat"), F.col("_lon"))))
    near = cells_join(asked.select("v").distinct(), sites.select("p", "v"), k, leaf_points, slack=1e-9)
    if near.schema["near"].dataType.elementType["p"].dataType != sites.schema["p"].dataType:
        near = near.filter("false").select("v", F.lit(None).cast("array<struct<d:double,p:bigint>>").alias("near"))  # no points at all
    candidates = asked.join(near, "v").select("_lat", "_lon", F.explode(F.transform("near", lambda x: x["p"])).alias("p")).join(sites.drop("v"), "p")
    km = F.round(haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")), 9)
    ranked = candidates.select("_lat", "_lon", km.alias("km"), F.explode("ids").alias("id")).groupBy("_lat", "_lon").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("km", "id"))), 1, k).alias("_near"))
    same = (name(lat).cast("double") == F.col("_lat")) & (name(lon).cast("double") == F.col("_lon"))
    matched = df.join(ranked, same, "left")
    ids, far = F.transform("_near", lambda x: x["id"]), F.transform("_near", lambda x: x["km"])
    one = k == 1
    return matched.select(*[name(c) for c in df.columns if c not in (out_id, out_dist)],
                          (F.get(ids, F.lit(0)) if one else ids).alias(out_id), (F.get(far, F.lit(0)) if one else far).alias(out_dist))


def _blend(weights: str, near: list[float], values: list[float]) -> float:
    """Mean of the donors, plain or by inverse distance; donors at distance 0 stand alone."""
    d, v = np.asarray(near, dtype=float), np.asarray(values, dtype=float)
    if weights == "uniform":
        return float(v.mean())
    if (d == 0).any():
        return float(v[d == 0].mean())
    return float((v / d).sum() / (1 / d).sum())


def knn_impute(df: DataFrame, col: str, key: str | Sequence[str], neighbors: int = 5, weights: str = "uniform",
               features: Sequence[str] | None = None, broadcast_cells: int = BROADCAST_CELLS,
               leaf_points: int = LEAF_POINTS) -> DataFrame:
    """Fill missing values from the ``neighbors`` rows nearest in the other numeric columns.

    Distances use the coordinates both rows have, scaled up for the missing ones; the smaller key wins a
    tie; a row sharing no coordinate with any donor gets the column mean.
    """
    keys = as_list(key)
    require_numeric(df, col)
    require(df, *keys)
    if weights not in ("uniform", "distance"):
        raise ValueError("weights must be uniform or distance")
    others = [c for c in (features if features is not None else numeric_columns(df)) if c != col]
    require_numeric(df, *others)
    width = len(others) + 1
    donors = present(df, col)
    stats = donors.agg(F.count(F.lit(1)), F.avg(name(col).cast("double"))).first()
    if not stats[0]:
        return df
    mean = stats[1]
    clean = lambda c: F.when(~missing(df, c), name(c).cast("double"))
    filled = lambda value: [F.coalesce(clean(col), value).alias(c) if c == col else name(c) for c in df.columns]
    if not others:
        return df.select(*filled(F.lit(mean)))
    if stats[0] * width <= broadcast_cells:
        rows = donors.orderBy(*map(name, keys)).select(*[clean(c).alias(f"c{i}") for i, c in enumerate([*others, col])]).collect()  # size checked
        matrix = np.array([[np.nan if x is None else x for x in r] for r in rows], dtype=float)
        shared = df.sparkSession.sparkContext.broadcast(matrix)

        @F.pandas_udf(T.DoubleType())
        def guess(target: pd.Series, *columns: pd.Series) -> pd.Series:
            known = shared.value
            wanted = np.flatnonzero(target.isna().to_numpy())
            result = np.full(len(target), np.nan)
            asked = np.column_stack([c.to_numpy(dtype=float) for c in columns])[wanted]
            for row, (near, far) in zip(wanted, closest(asked, known[:, :-1], neighbors, gap_aware_block(width))):
                result[row] = _blend(weights, far, known[near, -1]) if len(near) else mean
            return pd.Series(result)

        return df.select(*filled(guess(clean(col), *[clean(c) for c in others])))
    return _knn_impute_large(df, col, keys, neighbors, weights, others, width, mean, leaf_points, clean, filled)


def _grow_gap_cells(sample: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Splits of a complete binary tree over vectors with gaps: by whether a coordinate is known, then at medians.

    Per inner node the coordinate, the cut, and whether the split asks for being known only.
    """
    dim, cut, known = np.zeros(2 ** levels - 1, dtype=int), np.zeros(2 ** levels - 1), np.zeros(2 ** levels - 1, dtype=bool)

    def split(node: int, rows: np.ndarray, level: int) -> None:
        if level == levels:
            return
        if len(rows):
            share = (~np.isnan(rows)).mean(axis=0)
            even = np.abs(share - 0.5)
            if even.min() < 0.5:  # some know it, some do not
                dim[node], known[node] = int(even.argmin()), True
            elif share.any():
                full = np.where(share == 1, np.ptp(np.nan_to_num(rows), axis=0), -1.0)
                dim[node] = int(full.argmax())
                cut[node] = float(np.median(rows[:, dim[node]]))
        above = _above(rows[:, dim[node]], cut[node], known[node])
        split(2 * node + 1, rows[~above], level + 1)
        split(2 * node + 2, rows[above], level + 1)

    split(0, sample, 0)
    return dim, cut, known


def _above(values: np.ndarray, cut: np.ndarray | float, known: np.ndarray | bool) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.where(known, ~np.isnan(values), values > cut)


def _gap_bounds(at: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray, all_: np.ndarray, any_: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query and node the least and the largest distance of a point of the node; infinite where none, or not all, share a coordinate.

    Of the coordinates the query knows, every point of the node knows those of ``all_`` and none more than those of ``any_``.
    """
    asked = ~np.isnan(at)
    sure, possible = asked & all_[node], asked & any_[node]
    here = np.where(asked, at, 0.0)
    gap = np.maximum(0.0, np.maximum(low[node] - here, here - high[node]))
    reach = np.maximum(np.abs(here - low[node]), np.abs(high[node] - here))
    with np.errstate(invalid="ignore", divide="ignore"):
        least = np.sqrt(np.where(sure, gap ** 2, 0.0).sum(axis=1) / possible.sum(axis=1) * width)
        most = np.sqrt(np.where(possible, reach ** 2, 0.0).sum(axis=1) / sure.sum(axis=1) * width)
    return np.where(possible.any(axis=1), least, np.inf), np.where(sure.any(axis=1), most, np.inf)


def _probes(points: DataFrame, most: int = PROBES) -> np.ndarray:
    """Some vectors of every pattern of gaps, or of the most frequent patterns; all of a pattern that has few."""
    pattern = F.transform("v", lambda x: x.isNotNull())
    counts = points.groupBy(pattern.alias("known")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "known").limit(most // 16)
    each = most // max(1, counts.count())
    wanted = points.select("v", pattern.alias("known")).join(F.broadcast(counts), "known").filter(F.rand(3) * F.col("n") < each)
    return np.array([r["v"] for r in wanted.select("v").limit(2 * most).collect()], dtype=float)


def gap_cells_join(queries: DataFrame, points: DataFrame, k: int, width: int, leaf_points: int = LEAF_POINTS, visits_per_task: int = VISITS_PER_TASK) -> DataFrame:
    """(v, d, p): the ``k`` points nearest to every distinct query vector by the distance of ``gap_aware_block``, the smaller p on a tie.

    Vectors may have gaps (null), in any pattern. One tree holds all points: its upper splits ask which coordinates are known,
    the lower ones cut at medians. A cell keeps the extent of each coordinate and which coordinates all or any of its points
    know; these bound the distance from a query with gaps of its own, so the number of jobs does not depend on the patterns.
    Where there are few patterns, as usual, ``_pattern_cells_join`` does the same without visits to points that tie.
    """
    spark = points.sparkSession
    points = write_out(points.select("p", "v"))
    rows = points.count()
    kind = points.schema["p"].dataType
    shape = T.StructType([T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("d", T.DoubleType()), T.StructField("p", kind)])
    if not rows:
        return spark.createDataFrame([], shape)
    dims = points.select(F.size("v")).first()[0]
    if dims <= 30:
        asked_, held_ = ([r[0] for r in df.select(_mask(dims)).distinct().limit(MAX_PATTERNS + 1).collect()] for df in (queries, points))
        if max(len(asked_), len(held_)) <= MAX_PATTERNS:
            return _pattern_cells_join(queries, points, k, width, leaf_points, visits_per_task, asked_, dims)
    levels = min(MAX_TREE_LEVELS, max(0, int(np.ceil(np.log2(max(1.0, rows / leaf_points))))))
    wanted = 16 * 2 ** levels
    picked = points.select("v").sample(min(1.0, 1.5 * wanted / rows), seed=5).limit(2 * wanted).collect() or [points.first()]
    dim, cut, known = _grow_gap_cells(np.array([r["v"] for r in picked], dtype=float), levels)
    leaves = 2 ** levels

    def matrix(v: pd.Series) -> np.ndarray:
        return np.stack(v.to_numpy()).astype(float).reshape(len(v), dims)

    @F.pandas_udf(T.IntegerType())
    def leaf_of(v: pd.Series) -> pd.Series:
        at, node = matrix(v), np.zeros(len(v), dtype=int)
        for _ in range(levels):
            node = 2 * node + 1 + _above(at[np.arange(len(at)), dim[node]], cut[node], known[node])
        return pd.Series((node - (leaves - 1)).astype("int32"))

    placed = write_out(points.withColumn("leaf", leaf_of("v")))
    each = lambda made: F.array(*[made(F.col("v")[i]) for i in range(dims)])
    extents = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), each(F.min).alias("low"), each(F.max).alias("high"), each(F.count).alias("known")).collect()  # one row per cell
    count = np.zeros(2 * leaves - 1, dtype=np.int64)
    low, high = np.full((2 * leaves - 1, dims), np.inf), np.full((2 * leaves - 1, dims), -np.inf)
    all_, any_ = np.ones((2 * leaves - 1, dims), dtype=bool), np.zeros((2 * leaves - 1, dims), dtype=bool)
    for r in extents:
        node = leaves - 1 + r["leaf"]
        have = np.array(r["known"])
        count[node], all_[node], any_[node] = r["n"], have == r["n"], have > 0
        low[node] = [np.inf if x is None else x for x in r["low"]]
        high[node] = [-np.inf if x is None else x for x in r["high"]]
    for node in reversed(range(leaves - 1)):
        a, b = 2 * node + 1, 2 * node + 2
        count[node], low[node], high[node] = count[a] + count[b], np.minimum(low[a], low[b]), np.maximum(high[a], high[b])
        all_[node], any_[node] = all_[a] & all_[b], any_[a] | any_[b]
    probes = _probes(points).reshape(-1, dims)
    tree = spark.sparkContext.broadcast((probes, dim, cut, known, count, low, high, all_, any_))  # at most 2 ** MAX_TREE_LEVELS cells

    @F.pandas_udf("array<int>")
    def visited(v: pd.Series) -> pd.Series:
        probes_, dim_, cut_, known_, count_, *boxes = tree.value
        at = matrix(v)
        radius, node = np.full(len(at), np.inf), np.zeros(len(at), dtype=int)
        if len(probes_) >= k:  # the k-th nearest of some points is no nearer than that of all
            step = max(1, BLOCK_CELLS // len(probes_))
            for start in range(0, len(at), step):
                far = gap_aware_block(width)(at[start:start + step], probes_)
                radius[start:start + step] = np.partition(np.where(np.isnan(far), np.inf, far), k - 1, axis=1)[:, k - 1]
        for level in range(levels + 1):
            enough = np.flatnonzero(count_[node] >= k)
            if len(enough):
                radius[enough] = np.minimum(radius[enough], _gap_bounds(at[enough], node[enough], *boxes, width)[1])
            if level < levels:
                values = at[np.arange(len(at)), dim_[node]]
                fuller = count_[2 * node + 2] > count_[2 * node + 1]
                right = np.where(known_[node] | np.isnan(values), np.where(np.isnan(values), fuller, True), values > cut_[node])
                node = 2 * node + 1 + right.astype(int)
        radius = radius * (1 + 1e-12)
        who, where = np.arange(len(at)), np.zeros(len(at), dtype=int)
        for level in range(levels + 1):
            near = (count_[where] > 0) & (_gap_bounds(at[who], where, *boxes, width)[0] <= radius[who])
            near &= ((~np.isnan(at[who])) & boxes[3][where]).any(axis=1)
            who, where = who[near], where[near]
            if level < levels:
                who, where = np.repeat(who, 2), (2 * where[:, None] + np.array([1, 2])).ravel()
        order = np.argsort(who, kind="stable")
        ends = np.searchsorted(who[order], np.arange(1, len(at)))
        return pd.Series([x.astype("int32") for x in np.split(where[order] - (leaves - 1), ends)])

    visits = write_out(queries.select("v", F.explode(visited("v")).alias("leaf")))
    copies = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / visits_per_task).cast("int").alias("copies"))
    # fresh column identities, so that the two sides of the cogroup share none
    asked = visits.join(copies, "leaf").select(F.col("leaf").alias("cell"), F.pmod(F.xxhash64("v"), F.col("copies")).cast("int").alias("copy"), F.col("v").alias("v"))
    offered = placed.join(copies, "leaf").select(F.col("leaf").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"),
                                                 F.col("p").alias("p"), F.col("v").alias("v"))

    def match(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"v": [], "d": [], "p": []})
        right = right.sort_values("p", kind="stable")
        ids = right["p"].to_numpy()
        return _matches(left, matrix(left["v"]), ids, matrix(right["v"]), k, gap_aware_block(width))

    pairs = asked.groupBy("cell", "copy").cogroup(offered.groupBy("cell", "copy")).applyInPandas(match, shape)
    best = Window.partitionBy("v").orderBy("d", "p")
    return pairs.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).drop("_n")


def _mask(dims: int) -> Column:
    """Which coordinates of ``v`` are known, as a number."""
    known = F.lit(0).cast("long")
    for i in range(dims):
        known = known + F.when(F.col("v")[i].isNotNull(), F.lit(1 << i)).otherwise(F.lit(0))
    return known


def _pattern_cells_join(queries: DataFrame, points: DataFrame, k: int, width: int, leaf_points: int, visits_per_task: int, patterns: Sequence[int], dims: int) -> DataFrame:
    """``gap_cells_join`` over a group of points per pattern of the queries and coordinates shared with it.

    A group's points are reduced to the shared coordinates, and of those at one place only the ``k`` smallest p stay, so points
    that tie on few coordinates are few. Each group has a cell tree, all groups share the jobs. A query looks first into one
    cell of each of its groups; the k-th distance found there, over all groups, bounds which cells it visits.
    """
    spark = points.sparkSession
    kind = points.schema["p"].dataType
    cols = [f"c{i}" for i in range(dims)]
    low_bits = (1 << dims) - 1
    place = [F.col("v")[i].alias(f"x{i}") for i in range(dims)]
    # a group's number holds the queries' pattern and the shared coordinates
    pattern, shared = F.shiftright("g", dims), F.col("g").bitwiseAND(F.lit(low_bits).cast("long"))
    projected = [F.when(shared.bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.col(f"x{i}")).alias(c) for i, c in enumerate(cols)]
    group = F.filter(F.transform(F.array(*[F.lit(q).cast("long") for q in patterns]), lambda q: F.struct((q.bitwiseAND(F.col("m")) != 0).alias("any"), (q * (low_bits + 1) + q.bitwiseAND(F.col("m"))).alias("g"))), lambda x: x["any"])
    spread = points.select("p", *place, _mask(dims).alias("m")).select("p", *[f"x{i}" for i in range(dims)], F.explode(F.transform(group, lambda x: x["g"])).alias("g")).select("p", "g", *projected)
    first = F.row_number().over(Window.partitionBy("g", *cols).orderBy("p"))
    held = write_out(spread.withColumn("_n", first).filter(F.col("_n") <= k).drop("_n"))
    sizes = {r["g"]: r["n"] for r in held.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most the pairs of patterns
    target = max(1.0, leaf_points, sum(sizes.values()) / 2 ** (MAX_TREE_LEVELS - 1))
    levels = {g: max(0, int(np.ceil(np.log2(n / target)))) for g, n in sizes.items()}
    picked = held.filter(F.rand(5) < 12.0 / target).select("g", *cols).toPandas()  # 12 a cell
    samples = {g: at[cols].to_numpy(dtype=float) for g, at in picked.groupby("g")}
    trees, cells = {}, 0
    for g in sorted(sizes):
        own = np.flatnonzero([g >> i & 1 for i in range(dims)])
        trees[g] = (own, *_grow_cells(samples.get(g, np.empty((0, dims)))[:, own], levels[g]), levels[g], cells)
        cells += 2 ** levels[g]
    planted = spark.sparkContext.broadcast(trees)

    def by_group(g: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
        numbers, at = np.unique(g.to_numpy(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        return zip(numbers.tolist(), np.split(order, np.searchsorted(at[order], np.arange(1, len(numbers)))))

    @F.pandas_udf(T.IntegerType())
    def cell_of(g: pd.Series, *at: pd.Series) -> pd.Series:
        points_, found = np.column_stack([c.to_numpy(dtype=float) for c in at]), np.zeros(len(g), dtype="int32")
        for number, rows in by_group(g) if len(g) else ():
            own, dim, cut, deep, start = planted.value[number]
            found[rows] = start + _leaf_of(points_[rows][:, own], dim, cut, deep)
        return pd.Series(found)

    placed = write_out(held.withColumn("cell", cell_of("g", *cols)))
    bounds = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[made(c).alias(f"{what}{c}") for c in cols for what, made in (("low", F.min), ("high", F.max))]).toPandas()  # one row per cell
    count = np.zeros(cells, dtype=np.int64)
    low, high = np.full((cells, dims), np.inf), np.full((cells, dims), -np.inf)
    seen = bounds["cell"].to_numpy(dtype=int)
    count[seen], low[seen], high[seen] = bounds["n"], bounds[[f"low{c}" for c in cols]].to_numpy(dtype=float), bounds[[f"high{c}" for c in cols]].to_numpy(dtype=float)
    boxed = {}
    for g, (own, dim, cut, deep, start) in trees.items():
        leaves = 2 ** deep
        n, a, b = np.zeros(2 * leaves - 1, dtype=np.int64), np.full((2 * leaves - 1, len(own)), np.inf), np.full((2 * leaves - 1, len(own)), -np.inf)
        n[leaves - 1:], a[leaves - 1:], b[leaves - 1:] = count[start:start + leaves], low[start:start + leaves][:, own], high[start:start + leaves][:, own]
        for node in reversed(range(leaves - 1)):
            x, y = 2 * node + 1, 2 * node + 2
            n[node], a[node], b[node] = n[x] + n[y], np.minimum(a[x], a[y]), np.maximum(b[x], b[y])
        boxed[g] = (own, dim, cut, deep, start, n, a, b)
    forest = spark.sparkContext.broadcast(boxed)

    @F.pandas_udf("array<int>")
    def visited(g: pd.Series, reach: pd.Series, *at: pd.Series) -> pd.Series:
        points_, bound = np.column_stack([c.to_numpy(dtype=float) for c in at]), reach.fillna(np.inf).to_numpy(dtype=float)
        found = np.empty(len(g), dtype=object)
        for number, rows in by_group(g) if len(g) else ():
            own, dim, cut, deep, start, n, a, b = forest.value[number]
            here = points_[rows][:, own]
            # as euclidean distances over the shared coordinates
            radius, node = bound[rows] / np.sqrt(width / len(own)), np.zeros(len(rows), dtype=int)
            for level in range(deep + 1):
                enough = np.flatnonzero(n[node] >= k)
                radius[enough] = np.minimum(radius[enough], _box_reach(here[enough], a[node[enough]], b[node[enough]]))
                if level < deep:
                    node = 2 * node + 1 + (here[np.arange(len(here)), dim[node]] > cut[node])
            radius = radius * (1 + 1e-9)
            who, where = np.arange(len(here)), np.zeros(len(here), dtype=int)
            for level in range(deep + 1):
                near = n[where] > 0
                who, where = who[near], where[near]
                near = _box_gap(here[who], a[where], b[where]) <= radius[who]
                who, where = who[near], where[near]
                if level < deep:
                    who, where = np.repeat(who, 2), (2 * where[:, None] + np.array([1, 2])).ravel()
            order = np.argsort(who, kind="stable")
            ends = np.searchsorted(who[order], np.arange(1, len(here)))
            for row, x in zip(rows, np.split(start + where[order] - (2 ** deep - 1), ends)):
                found[row] = x.astype("int32")
        return pd.Series(found)

    def match(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"no": [], "d": [], "p": []})
        right = right.sort_values("p", kind="stable")
        own = [c for c in cols if right[c].notna().iloc[0]]  # the same for all points of a group
        a, b = left[own].to_numpy(dtype=float), right[own].to_numpy(dtype=float)
        found = list(closest_flat(a, b, k, lambda x, y: np.sqrt(_squares(x, y) / float(len(own)) * width)))
        who, which, d = (np.concatenate([f[i] for f in found]) for i in range(3))
        near = d <= left["reach"].fillna(np.inf).to_numpy(dtype=float)[who]
        return pd.DataFrame({"no": left["no"].to_numpy()[who[near]], "d": d[near], "p": right["p"].to_numpy()[which[near]]})

    shape = T.StructType([T.StructField("no", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("p", kind)])

    def searched(visits: DataFrame) -> DataFrame:
        visits = write_out(visits)
        copies = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / visits_per_task).cast("int").alias("copies"))
        # fresh column identities, so that the two sides of the cogroup share none
        asked = visits.join(copies, "cell").select(F.col("cell").alias("at"), F.pmod(F.xxhash64("no"), F.col("copies")).cast("int").alias("copy"), F.col("no").alias("no"), F.col("reach").alias("reach"), *[F.col(c).alias(c) for c in cols])
        offered = placed.join(copies, "cell").select(F.col("cell").alias("at"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("p").alias("p"), *[F.col(c).alias(c) for c in cols])
        return write_out(asked.groupBy("at", "copy").cogroup(offered.groupBy("at", "copy")).applyInPandas(match, shape))

    numbered = write_out(queries.select(F.monotonically_increasing_id().alias("no"), "v"))
    groups = write_out(held.select("g").distinct())
    asked = numbered.select("no", *place, _mask(dims).alias("m")).join(F.broadcast(groups), F.col("m") == pattern).select("no", "g", *projected)
    tried = searched(asked.select("no", F.lit(None).cast("double").alias("reach"), cell_of("g", *cols).alias("cell"), *cols))
    reach = tried.groupBy("no").agg(F.get(F.sort_array(F.collect_list("d")), F.lit(k - 1)).alias("reach"))  # k for each of its groups
    bounded = write_out(asked.join(reach, "no", "left"))
    found = searched(bounded.select("no", "reach", F.explode(visited("g", "reach", *cols)).alias("cell"), *cols))
    best = Window.partitionBy("no").orderBy("d", "p")
    return found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).join(numbered, "no").select("v", "d", "p")


def _knn_impute_large(df, col, keys, neighbors, weights, others, width, mean, leaf_points, clean, filled) -> DataFrame:
    """Receivers and donors both too many to broadcast: one cell tree for all gap patterns."""
    vector = F.array(*[clean(c) for c in others])
    order = [f"k{i}" for i in range(len(keys))]
    known = present(df, col).select(vector.alias("x"), *[name(k).alias(o) for k, o in zip(keys, order)], name(col).cast("double").alias("y"))
    # Of donors with equal coordinates only the first few by key can be among the nearest.
    first = F.row_number().over(Window.partitionBy("x").orderBy(*order))
    known = write_out(known.withColumn("_n", first).filter(F.col("_n") <= neighbors).drop("_n"))
    known = write_out(ordered.number_rows(known, order, out="p"))
    asked = write_out(df.filter(missing(df, col)).select(vector.alias("v")).distinct())
    near = gap_cells_join(asked, known.select("p", F.col("x").alias("v")), neighbors, width, leaf_points)
    chosen = near.withColumnRenamed("v", "x").join(known.select("p", "y"), "p")
    if weights == "uniform":
        blended = F.avg("y")
    else:
        exact = F.avg(F.when(F.col("d") == 0, F.col("y")))
        blended = F.coalesce(exact, F.sum(F.try_divide(F.col("y"), F.col("d"))) / F.sum(F.try_divide(F.lit(1.0), F.col("d"))))
    guess = chosen.groupBy(F.col("x").alias("_x")).agg(blended.alias("_guess"))
    joined = df.withColumn("_vector", F.when(missing(df, col), vector)).join(guess, F.col("_vector") == F.col("_x"), "left")
    return joined.select(*filled(F.coalesce("_guess", F.lit(mean))))
