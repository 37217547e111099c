"""Isolation forest: trees grown on small samples in parallel, or level by level on all rows; all rows scored in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import as_list, name, present, require, require_numeric
from quarry.operators import ordered
from quarry.session import write_out


SMALL_INPUT_ROWS = 10_000_000
SPREAD = 1 << 31  # hashes are drawn from this many values


def _usual_path(n: float) -> float:
    """Average depth of an unsuccessful search in a tree of ``n`` values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(points: np.ndarray, depth_limit: int, rng: np.random.Generator) -> dict[str, list]:
    """One tree as flat arrays; inner nodes have a feature >= 0, leaves their expected remaining depth."""
    feature, cut, left, right, rest = [], [], [], [], []

    def add(rows: np.ndarray, depth: int) -> int:
        node = len(feature)
        for column, value in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (rest, 0.0)):
            column.append(value)
        low, high = rows.min(axis=0), rows.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= depth_limit or len(rows) <= 1 or not len(varying):
            rest[node] = depth + _usual_path(len(rows))
            return node
        f = int(rng.choice(varying))
        at = float(rng.uniform(low[f], high[f]))
        below = rows[:, f] <= at
        feature[node], cut[node] = f, at
        left[node] = add(rows[below], depth + 1)
        right[node] = add(rows[~below], depth + 1)
        return node

    add(points, 0)
    return {"feature": feature, "cut": cut, "left": left, "right": right, "rest": rest}


def _flat_forest(trees: list) -> tuple[np.ndarray, ...]:
    """All trees in one numbering: roots, split feature and position, both children, depth at the leaves."""
    starts = np.cumsum([0, *[len(t["feature"]) for t in trees]])[:-1]
    feature = np.concatenate([t["feature"] for t in trees]).astype(int)
    own = np.arange(len(feature))
    left = np.concatenate([np.asarray(t["left"], dtype=int) + s for t, s in zip(trees, starts)])
    right = np.concatenate([np.asarray(t["right"], dtype=int) + s for t, s in zip(trees, starts)])
    leaf = feature < 0
    child = np.column_stack([np.where(leaf, own, left), np.where(leaf, own, right)])
    return starts, np.where(leaf, 0, feature), np.concatenate([t["cut"] for t in trees]), child, np.concatenate([t["rest"] for t in trees])


def _sample_per_tree(df: DataFrame, cols: Sequence[str], key: Sequence[str], trees: int, size: int, rows: int, seed: int) -> DataFrame:
    """(tree, place, f0…): ``size`` rows without replacement for every tree, the same for the same seed.

    One hash per row keeps a pool of a few rows per draw; the trees then take the pool rows with their
    smallest hashes, again behind a threshold, so neither rows nor pool are copied once per tree. A
    threshold that kept too few is raised.
    """
    def drawn_below(share: float) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), *[f"k{i}" for i in range(len(key))]), F.lit(SPREAD)) < int(share * SPREAD)

    values = df.select(*[name(c).cast("double").alias(f"f{i}") for i, c in enumerate(cols)], *[name(k).alias(f"k{i}") for i, k in enumerate(key)])
    share = min(1.0, 8.0 * size * trees / rows)
    while True:
        pool = write_out(values.filter(drawn_below(share)) if share < 1.0 else values)
        pooled = pool.count()
        if share >= 1.0 or pooled >= 4 * size:
            break
        share = min(1.0, share * 4)
    share = min(1.0, 4.0 * size / pooled)
    while True:
        draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda i: F.struct(
            i.alias("tree"), F.pmod(F.xxhash64(F.lit(seed + 1), i, *[f"k{j}" for j in range(len(key))]), F.lit(SPREAD)).alias("draw")))
        drawn = write_out(pool.select("*", F.inline(F.filter(draws, lambda d: d["draw"] < int(share * SPREAD)) if share < 1.0 else draws)))
        least = drawn.groupBy("tree").count().agg(F.min("count"), F.count("*")).first()
        if share >= 1.0 or (least[1] == trees and least[0] >= size):
            break
        share = min(1.0, share * 4)
    place = F.row_number().over(Window.partitionBy("tree").orderBy("draw", *[f"k{i}" for i in range(len(key))]))
    return drawn.withColumn("place", place).filter(F.col("place") <= size)


def _grow_on_samples(picked: DataFrame, inputs: list[str], limit: int, seed: int) -> list:
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        points = pdf.sort_values("place")[inputs].to_numpy()
        grown = grow_tree(points, limit, np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [tree], **{c: [v] for c, v in grown.items()}})

    shape = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, rest array<double>"
    # Bounded result: n_estimators trees of at most 2 * max_samples nodes.
    return picked.groupBy("tree").applyInPandas(grow, shape).orderBy("tree").collect()


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    """A small input may sit in one file split: dealt out to all cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if rows <= SMALL_INPUT_ROWS else df


def _walk(points: np.ndarray, roots: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray, steps: int) -> np.ndarray:
    """The node of every tree (second axis) that a row reaches in so many steps; leaves lead to themselves."""
    values, row, sides = points.ravel(), np.arange(len(points)) * points.shape[1], child.ravel()
    reached = np.empty((len(points), len(roots)), dtype=np.int64)
    for tree, root in enumerate(roots):
        node = np.full(len(points), root)
        for _ in range(steps):
            node = sides.take(2 * node + (values.take(row + feature.take(node)) > cut.take(node)))
        reached[:, tree] = node
    return reached


def _grow_on_all(values: DataFrame, trees: int, dims: int, limit: int, seed: int) -> list[dict[str, list]]:
    """Trees on all rows of ``values`` (f0…), one pass a level: every task reduces its rows to a count and the extents of each open node."""
    sc = values.sparkSession.sparkContext
    grown = [{"feature": [-1], "cut": [0.0], "left": [-1], "right": [-1], "rest": [math.nan]} for _ in range(trees)]
    small = np.int16 if limit < 14 else np.int32  # small numbers are sorted by their digits
    rngs = [np.random.default_rng([seed, tree]) for tree in range(trees)]
    shape = "node int, n long, " + ", ".join(f"low{i} double, high{i} double" for i in range(dims))
    extremes = [made(f"{c}{i}").alias(f"{c}{i}") for c, made in (("low", F.min), ("high", F.max)) for i in range(dims)]
    for depth in range(limit + 1):
        flat = _flat_forest(grown)
        shared = sc.broadcast(flat[:4])

        def extents(batches: Iterator[pd.DataFrame], depth: int = depth, shared=shared) -> Iterator[pd.DataFrame]:
            forest = shared.value
            nodes = len(forest[1])
            count, low, high = np.zeros(nodes, dtype=np.int64), np.full((nodes, dims), np.inf), np.full((nodes, dims), -np.inf)
            for pdf in batches:
                points = pdf.to_numpy(dtype=float)
                if not len(points):
                    continue
                for node, root in zip(_walk(points, *forest, depth).T, forest[0]):
                    order = np.argsort((node - root).astype(small), kind="stable")
                    node = node.take(order)
                    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
                    here = node.take(starts)
                    count[here] += np.diff(starts, append=len(node))
                    for i in range(dims):
                        value = points[:, i].take(order)
                        low[here, i] = np.minimum(low[here, i], np.minimum.reduceat(value, starts))
                        high[here, i] = np.maximum(high[here, i], np.maximum.reduceat(value, starts))
            seen = np.flatnonzero(count)
            yield pd.DataFrame({"node": seen.astype("int32"), "n": count[seen]} | {f"{c}{i}": at[seen, i] for i in range(dims) for c, at in (("low", low), ("high", high))})

        found = values.mapInPandas(extents, shape).groupBy("node").agg(F.sum("n").alias("n"), *extremes)
        known = {r["node"]: r for r in found.collect()}  # at most trees * 2 ** (limit + 1) rows
        for tree, start, rng in zip(grown, flat[0], rngs):
            feature, cut, left, right, rest = tree.values()
            for node in range(len(feature)):
                if not math.isnan(rest[node]):
                    continue
                facts = known[int(start) + node]
                low, high = (np.array([facts[f"{c}{i}"] for i in range(dims)]) for c in ("low", "high"))
                varying = np.flatnonzero(high > low)
                if depth == limit or facts["n"] <= 1 or not len(varying):
                    rest[node] = depth + _usual_path(facts["n"])
                    continue
                f = int(rng.choice(varying))
                feature[node], cut[node] = f, min(float(rng.uniform(low[f], high[f])), float(np.nextafter(high[f], low[f])))
                left[node], right[node], rest[node] = len(feature), len(feature) + 1, 0.0
                for column, value in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (rest, math.nan)):
                    column += [value, value]
        shared.unpersist()
        if not any(math.isnan(x) for tree in grown for x in tree["rest"]):
            break
    return grown


def isolation_forest(df: DataFrame, features: str | Sequence[str], key: str | Sequence[str], n_estimators: int = 100,
                     max_samples: int | float | str = "auto", contamination: float | str = "auto", seed: int = 0,
                     out: str = "anomaly_score", max_depth: int | None = None) -> DataFrame:
    """Add an anomaly score; negative means more isolated than usual. Rows with gaps get null.

    Trees grown on few rows seldom see a rare one, which then looks like the outermost of those they saw. With
    ``max_samples=1.0`` and a ``max_depth`` (up to about 12, for the size of the trees) every tree grows on all rows, without
    gathering them.
    """
    cols, keys = as_list(features), as_list(key)
    require_numeric(df, *cols)
    require(df, *keys)
    usable = present(df, *cols)
    rows = usable.count()
    if rows == 0:
        return df.withColumn(out, F.lit(None).cast("double"))
    if max_samples == "auto":
        size = min(256, rows)
    else:
        size = min(rows, int(max_samples) if float(max_samples) > 1 else max(1, int(float(max_samples) * rows)))
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    if max_depth is not None:
        if max_depth < 1:
            raise ValueError("max_depth must be at least 1")
        limit = min(limit, max_depth)
    inputs = [f"f{i}" for i in range(len(cols))]
    if max_depth is not None and size == rows:
        grown = _grow_on_all(write_out(_dealt(usable.select(*[name(c).cast("double").alias(f) for c, f in zip(cols, inputs)]), rows)), n_estimators, len(cols), limit, seed)
    else:
        grown = _grow_on_samples(_sample_per_tree(usable, cols, keys, n_estimators, size, rows, seed), inputs, limit, seed)
    shared = df.sparkSession.sparkContext.broadcast(_flat_forest(grown))
    usual = _usual_path(size) or 1.0

    @F.pandas_udf(T.DoubleType())
    def isolation(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        roots, feature, cut, child, rest = shared.value
        for columns in batches:
            points = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            node = _walk(points, roots, feature, cut, child, limit)
            score = np.power(2.0, -rest[node].mean(axis=1) / usual)
            yield pd.Series(np.where(np.isnan(points).any(axis=1), np.nan, -score))

    scored = _dealt(df, rows).withColumn(out, F.nanvl(isolation(*[name(c).cast("double") for c in cols]), F.lit(None).cast("double")))
    if contamination == "auto":
        return scored.withColumn(out, F.col(out) + 0.5)
    offset = ordered.quantiles(scored.select(out), [out], [float(contamination)]).first()["quantile"]
    return scored.withColumn(out, F.col(out) - offset)
