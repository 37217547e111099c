"""Kendall's tau-b between numeric columns, exact and without comparing all pairs.

The distinct (x, y) pairs are put in (x, y) order; discordant pairs are inversions of y. They are
counted in three disjoint parts: inside a chunk of consecutive rows; between chunks but inside one
range of y; and between chunks and between ranges, which depends on (chunk, range) counts only and is
the same problem on fewer points. No task sees more than a chunk or a range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import numeric_columns, require_numeric
from quarry.operators import ordered
from quarry.operators.stats import complete_pairs, pair_names, with_diagonal
from quarry.session import write_out

CHUNK_ROWS = 200_000


def weighted_inversions(values: np.ndarray, weights: np.ndarray) -> float:
    """Sum of w[i] * w[j] over i < j with values[i] > values[j], one vectorised pass per bit."""
    ranks = np.unique(values, return_inverse=True)[1].astype(np.int64)
    weights = weights.astype(np.float64)
    total = 0.0
    for bit in reversed(range(int(ranks.max(initial=0)).bit_length())):
        # rows are grouped by their higher bits, in sequence order inside a group
        group = ranks >> (bit + 1)
        one = (ranks >> bit) & 1
        ones = np.cumsum(weights * one)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        before = np.repeat((ones - weights * one)[starts], np.diff(np.r_[starts, len(ranks)]))
        total += float(np.sum((weights * (ones - before))[one == 0]))
        order = np.argsort(ranks >> bit, kind="stable")
        ranks, weights = ranks[order], weights[order]
    return total


def _count_inside(points: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(pair, d): inversions of y inside each group of (pair, …) taken in ``order``."""
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(list(order), kind="stable")
        return pd.DataFrame({"pair": [rows["pair"].iloc[0]], "d": [weighted_inversions(rows["y"].to_numpy(), rows["w"].to_numpy())]})

    return points.groupBy(*group).applyInPandas(count, "pair int, d double")


def discordant(points: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(pair, d) from a written table of distinct (pair, x, y, w) points."""
    largest = points.groupBy("pair").count().agg(F.max("count")).first()[0] or 0
    if largest <= chunk_rows:
        return _count_inside(points, ["pair"], ["x", "y"])
    # Blocks so large that the (chunk, range) table is a tenth of the points at most.
    size = max(chunk_rows, math.isqrt(10 * largest))
    placed = write_out(ordered.number_rows(points, ["x", "y"], ["pair"], out="at", rows_per_range=chunk_rows)
                       .withColumn("chunk", F.floor(F.col("at") / size)))
    counts = write_out(points.groupBy("pair", "y").agg(F.count(F.lit(1)).alias("n")))
    ranges = ordered.running_total(counts, {"upto": F.col("n")}, ["y"], ["pair"], chunk_rows)
    # A y held by a whole block of rows is a range of its own: inside it there are only ties.
    ranges = ranges.select("pair", "y", (F.col("n") >= size).alias("alone"),
                           (F.floor((F.col("upto") - F.col("n")) / size) * 2 + (F.col("n") >= size).cast("int")).alias("range"))
    both = write_out(placed.join(ranges, ["pair", "y"]))
    inside_chunk = _count_inside(both, ["pair", "chunk"], ["at"])
    inside_range = _count_inside(both.filter("NOT alone"), ["pair", "range"], ["chunk", "y"])
    cells = write_out(both.groupBy("pair", F.col("chunk").cast("double").alias("x"), F.col("range").cast("double").alias("y")).agg(F.sum("w").alias("w")))
    between = discordant(cells, chunk_rows)
    return inside_chunk.unionByName(inside_range).unionByName(between).groupBy("pair").agg(F.sum("d").alias("d"))


def corr_kendall(df: DataFrame, min_periods: int | None = None, cols: Sequence[str] | None = None,
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Pairwise-complete tau-b matrix as (a, b, corr, n)."""
    cols = list(cols or numeric_columns(df))
    require_numeric(df, *cols)
    least = max(1, min_periods or 1)
    pairs = list(combinations(cols, 2))
    joint = complete_pairs(df, pairs)
    two = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    size = joint.groupBy("pair").agg(F.sum("w").alias("n"), two("w").alias("both"))
    tied = lambda c: joint.groupBy("pair", c).agg(F.sum("w").alias("w")).groupBy("pair").agg(two("w").alias(f"t{c}"))
    parts = size.join(tied("x"), "pair").join(tied("y"), "pair").join(write_out(discordant(joint, chunk_rows)), "pair")
    every = F.col("n").cast("double") * (F.col("n") - 1) / 2
    balance = every - F.col("tx") - F.col("ty") + F.col("both") - 2 * F.col("d")
    tau = F.try_divide(balance, F.sqrt(every - F.col("tx")) * F.sqrt(every - F.col("ty")))
    found = pair_names(df.sparkSession, pairs).join(parts, "pair", "left").select(
        "a", "b", F.when(F.col("n") >= least, tau).alias("corr"), F.coalesce("n", F.lit(0)).alias("n"))
    return with_diagonal(df, cols, found, least)
