"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import write_out

ONE_TASK_EDGES = 500_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _roots(edges: pd.DataFrame) -> pd.DataFrame:
    """Smallest node of the component for every node of a bounded edge set."""
    root: dict[int, int] = {}

    def find(node: int) -> int:
        while root.setdefault(node, node) != node:
            root[node] = root[root[node]]
            node = root[node]
        return node

    for u, v in zip(edges["u"].tolist(), edges["v"].tolist()):
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return pd.DataFrame({"node": list(root), "root": [find(n) for n in root]})


def components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, root): the smallest node of its component for every node on an edge (u, v) of longs.

    Minima are combined before the shuffle, so a node with very many neighbours is no bottleneck.
    Every round is written out; the loop ends when a round changes nothing. A small edge set is settled
    in one task instead.
    """
    stars = write_out(edges.select("u", "v").filter("u <> v").distinct())
    if stars.count() <= one_task_edges:
        return stars.groupBy(F.lit("all")).applyInPandas(_roots, "node long, root long")
    seen = None
    while True:
        stars = write_out(_small_star(_large_star(stars)))
        state = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
