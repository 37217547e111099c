"""DBSCAN over a grid whose cells are smaller than eps, so that points of one cell are all neighbours.

A cell with min_samples points or more consists of core points without any distance being computed;
only the few points of thinner cells are compared, with the cells around them. Clusters are connected
components of *cells*. Whether two crowded cells touch is decided on boxes that are halved step by
step: most pairs of boxes are clearly near or clearly far, and points are compared only in small boxes.
"""

from __future__ import annotations

import json
import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import EARTH_RADIUS_KM, as_list, haversine_km, missing, name, present, require
from quarry.operators import ordered
from quarry.operators.components import components
from quarry.session import write_out

SMALL_BOX = 32
MAX_HALVINGS = 40


def _axes(metric: str, eps: float) -> tuple[list[Column], float]:
    """Coordinates in which neighbours are within ``reach`` in the plain sense."""
    lat, lon = F.col("lat"), F.col("lon")
    if metric == "euclidean":
        return [lat, lon], eps
    if metric != "haversine":
        raise ValueError("metric must be euclidean or haversine")
    flat = F.cos(F.radians(lat))
    sphere = [flat * F.cos(F.radians(lon)), flat * F.sin(F.radians(lon)), F.sin(F.radians(lat))]
    return sphere, 2.0 * math.sin(min(eps / (2.0 * EARTH_RADIUS_KM), math.pi / 2))


def _near(metric: str, eps: float, a: str, b: str) -> Column:
    """The exact distance test between the points of two sides of a join."""
    if metric == "haversine":
        return haversine_km(F.col(f"{a}.lat"), F.col(f"{a}.lon"), F.col(f"{b}.lat"), F.col(f"{b}.lon")) <= eps
    dy, dx = F.col(f"{a}.lat") - F.col(f"{b}.lat"), F.col(f"{a}.lon") - F.col(f"{b}.lon")
    return F.sqrt(dy * dy + dx * dx) <= eps


def _offsets(dims: int) -> list[tuple[int, ...]]:
    """Grid steps to cells that can hold a point within reach; the cell itself left out."""
    far = math.ceil(math.sqrt(dims))
    steps = []
    for step in product(range(-far, far + 1), repeat=dims):
        gap = sum(max(0, abs(s) - 1) ** 2 for s in step)  # squared gap in cell sides
        if any(step) and gap <= dims:
            steps.append(step)
    return steps


def _neighbour_cells(dims: int) -> Column:
    """All cells around ``cell`` as an array of cells."""
    around = F.from_json(F.lit(json.dumps(_offsets(dims))), "array<array<bigint>>")  # a constant
    return F.transform(around, lambda step: F.zip_with(F.col("cell"), step, lambda a, b: a + b))


def _box_edges(core: DataFrame, axes: list[str], side: float, reach: float, metric: str, eps: float, dims: int) -> DataFrame:
    """(u, v): numbers of neighbouring cells with a pair of core points within reach."""
    def boxes(level: int, points: DataFrame) -> DataFrame:
        box = F.array(*[F.floor(F.col(a) / (side / 2.0 ** level)) for a in axes]).alias("box")
        return points.groupBy("cell_no", box).agg(
            F.count(F.lit(1)).alias("n"), F.array(*[F.min(a) for a in axes]).alias("low"), F.array(*[F.max(a) for a in axes]).alias("high"))

    margin = 1e-9

    def judged(pairs: DataFrame) -> DataFrame:
        """Add far / near bounds of two boxes from their true extents."""
        def length(gap) -> Column:
            return F.sqrt(sum((gap(i) * gap(i) for i in range(dims)), F.lit(0.0)))

        def end(c: str, i: int) -> Column:
            return F.col(c)[i]

        most = length(lambda i: F.greatest(end("a_high", i) - end("b_low", i), end("b_high", i) - end("a_low", i)))
        least = length(lambda i: F.greatest(F.lit(0.0), end("a_low", i) - end("b_high", i), end("b_low", i) - end("a_high", i)))
        return pairs.withColumn("touch", most <= reach * (1 - margin)).withColumn("apart", least > reach * (1 + margin))

    def side_of(df: DataFrame, s: str) -> DataFrame:
        return df.select(F.col("cell_no").alias(f"{s}_cell"), F.col("box").alias(f"{s}_box"), F.col("n").alias(f"{s}_n"),
                         F.col("low").alias(f"{s}_low"), F.col("high").alias(f"{s}_high"))

    cells = core.groupBy("cell_no", "cell").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.min(a) for a in axes]).alias("low"),
                                                F.array(*[F.max(a) for a in axes]).alias("high"))
    cells = write_out(cells)
    around = cells.select("cell_no", F.explode(_neighbour_cells(dims)).alias("cell"))
    near_cells = around.join(cells.select(F.col("cell_no").alias("other"), "cell"), "cell").filter("cell_no < other")
    whole = cells.withColumn("box", F.col("cell"))
    pairs = (near_cells.select(F.col("cell_no").alias("a_cell"), F.col("other").alias("b_cell"))
             .join(side_of(whole, "a"), "a_cell").join(side_of(whole, "b"), "b_cell"))
    found, level = None, 0
    while True:
        looked = write_out(judged(pairs).filter("NOT apart"))
        touching = looked.filter("touch").select(F.col("a_cell").alias("u"), F.col("b_cell").alias("v")).distinct()
        found = touching if found is None else found.unionByName(touching)
        decided = found.select(F.col("u").alias("a_cell"), F.col("v").alias("b_cell"))
        open_pairs = looked.filter("NOT touch").join(decided, ["a_cell", "b_cell"], "left_anti")
        small = (F.col("a_n") <= SMALL_BOX) & (F.col("b_n") <= SMALL_BOX)
        last = level >= MAX_HALVINGS or looked.filter(~F.col("touch") & ~small).isEmpty()
        box = F.array(*[F.floor(F.col(a) / (side / 2.0 ** level)) for a in axes]) if level else F.col("cell")
        points = core.select(F.col("cell_no"), box.alias("box"), "lat", "lon")
        direct = open_pairs if last else open_pairs.filter(small)
        a = points.select(F.col("cell_no").alias("a_cell"), F.col("box").alias("a_box"), F.struct("lat", "lon").alias("p"))
        b = points.select(F.col("cell_no").alias("b_cell"), F.col("box").alias("b_box"), F.struct("lat", "lon").alias("q"))
        compared = (direct.select("a_cell", "a_box", "b_cell", "b_box").join(a, ["a_cell", "a_box"]).join(b, ["b_cell", "b_box"])
                    .filter(_near(metric, eps, "p", "q")).select(F.col("a_cell").alias("u"), F.col("b_cell").alias("v")).distinct())
        found = found.unionByName(compared).distinct()
        if last:
            return found
        found = write_out(found)
        left = write_out(open_pairs.filter(~small).select("a_cell", "a_box", "b_cell", "b_box")
                         .join(found.select(F.col("u").alias("a_cell"), F.col("v").alias("b_cell")), ["a_cell", "b_cell"], "left_anti"))
        if left.isEmpty():
            return found
        level += 1
        active = left.select(F.col("a_cell").alias("cell_no")).unionByName(left.select(F.col("b_cell").alias("cell_no"))).distinct()
        halves = write_out(boxes(level, core.join(active, "cell_no", "left_semi")))
        # halving is exact in binary, so a box's parent is its number halved
        parent = F.transform("box", lambda x: F.floor(x / 2))

        def children(s: str) -> DataFrame:
            return side_of(halves, s).join(
                halves.select(F.col("cell_no").alias(f"{s}_cell"), F.col("box").alias(f"{s}_box"), parent.alias(f"{s}_up")),
                [f"{s}_cell", f"{s}_box"])

        grown = left.select("a_cell", F.col("a_box").alias("a_up"), "b_cell", F.col("b_box").alias("b_up"))
        pairs = grown.join(children("a"), ["a_cell", "a_up"]).join(children("b"), ["b_cell", "b_up"])


def dbscan(df: DataFrame, lat: str, lon: str, eps: float = 0.5, min_samples: int = 5, metric: str = "euclidean",
           key: str | list[str] = (), out: str = "cluster_id", noise_label: int = -1) -> DataFrame:
    """Density clusters numbered by their first core row in ``key`` order; noise gets ``noise_label``.

    A point counts itself towards ``min_samples``; a border point joins the lowest-numbered cluster it
    can reach. Rows without coordinates get null.
    """
    keys = as_list(key)
    require(df, lat, lon, *keys)
    if not keys:
        raise ValueError("dbscan needs the key columns that order the rows")
    axes_of, reach = _axes(metric, eps)
    dims = len(axes_of)
    axes = [f"x{i}" for i in range(dims)]
    side = reach / math.sqrt(dims) * (1 - 1e-7)
    first = F.struct(*[name(k) for k in keys])
    # Rows at the same place collapse first, so a place with very many rows is one point.
    places = (
        present(df, lat, lon).select(name(lat).cast("double").alias("lat"), name(lon).cast("double").alias("lon"), first.alias("first"))
        .groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("w"), F.min("first").alias("first"))
        .select("*", *[a.alias(x) for a, x in zip(axes_of, axes)])
        .withColumn("cell", F.array(*[F.floor(F.col(x) / side) for x in axes]))
    )
    places = write_out(places)
    sizes = places.groupBy("cell").agg(F.sum("w").alias("cell_w"))
    cell_no = write_out(sizes.withColumn("cell_no", F.monotonically_increasing_id()))  # any numbers do; written, they stay
    points = write_out(places.join(cell_no, "cell"))
    thin = points.filter(F.col("cell_w") < min_samples)
    reachable = thin.select(F.struct("lat", "lon").alias("p"), F.explode(_neighbour_cells(dims)).alias("cell"))
    others = points.select("cell", F.struct("lat", "lon").alias("q"), "w")
    # At most min_samples - 1 points per thin cell: every point is compared with a bounded number of them.
    met = reachable.join(others, "cell").filter(_near(metric, eps, "p", "q")).groupBy("p").agg(F.sum("w").alias("met"))
    decided = (
        points.select("*", F.struct("lat", "lon").alias("p")).join(met, "p", "left")
        .withColumn("core", (F.col("cell_w") >= min_samples) | (F.col("cell_w") + F.coalesce("met", F.lit(0)) >= min_samples))
        .drop("p", "met")
    )
    points = write_out(decided)
    core = points.filter("core")
    links = _box_edges(core, axes, side, reach, metric, eps, dims)
    roots = components(links)
    cells = core.groupBy("cell_no").agg(F.min("first").alias("first")).join(roots, F.col("cell_no") == F.col("node"), "left")
    cells = cells.select("cell_no", F.coalesce("root", "cell_no").alias("root"), "first")
    firsts = write_out(cells.groupBy("root").agg(F.min("first").alias("first")).select("root", *[F.col(f"first.{k}").alias(f"k{i}") for i, k in enumerate(keys)]))
    numbered = ordered.number_rows(firsts, [f"k{i}" for i in range(len(keys))], out="label").select("root", "label")
    cell_label = write_out(cells.join(numbered, "root").select("cell_no", "label"))
    labelled_core = points.filter("core").join(cell_label, "cell_no")
    loose = points.filter("NOT core")
    around = loose.select(F.struct("lat", "lon").alias("p"), F.explode(F.array_append(_neighbour_cells(dims), F.col("cell"))).alias("cell"))
    border = (around.join(labelled_core.select("cell", F.struct("lat", "lon").alias("q"), "label"), "cell")
              .filter(_near(metric, eps, "p", "q")).groupBy("p").agg(F.min("label").alias("label")))
    labels = labelled_core.select("lat", "lon", "label").unionByName(border.select("p.lat", "p.lon", "label"))
    at = labels.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("label").alias("_label"))
    same = (name(lat).cast("double") == F.col("_lat")) & (name(lon).cast("double") == F.col("_lon"))
    label = F.when(missing(df, lat) | missing(df, lon), F.lit(None)).otherwise(F.coalesce("_label", F.lit(noise_label).cast("long")))
    return df.join(at, same, "left").select(*[name(c) for c in df.columns if c != out], label.alias(out))


def cluster_sizes(labelled: DataFrame, out: str = "cluster_id") -> DataFrame:
    """Preview: how many rows each cluster has."""
    return labelled.groupBy(name(out)).agg(F.count(F.lit(1)).alias("count")).orderBy(out)
