"""Rolling averages, ranks and equal-width bins."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import as_list, missing, name, present, require, require_numeric
from quarry.operators import ordered
from quarry.session import write_out

CHUNK_ROWS = 100_000
PLAIN_GROUP_ROWS = 1_000_000


def moving_avg(df: DataFrame, col: str, window: int, center: bool = False, min_periods: int | None = None,
               order_by: str | Sequence[str] = (), partition_by: str | Sequence[str] = (),
               chunk_rows: int = CHUNK_ROWS, plain_group_rows: int = PLAIN_GROUP_ROWS) -> DataFrame:
    """Rolling mean over ``window`` rows as ``<col>_moving_avg``; null until ``min_periods`` values are there.

    Partitions of moderate size are plain windows. A larger partition, or the whole table when there is
    none, is numbered and cut into chunks; rows near a chunk's edge are copied into its neighbour, so
    every frame is complete inside one chunk and no task holds more than a chunk.
    """
    order, parts = as_list(order_by), as_list(partition_by)
    require_numeric(df, col)
    require(df, *order, *parts)
    if not order or window is None or window < 1:
        raise ValueError("moving_avg needs order_by and a positive window")
    least = window if min_periods is None else min_periods
    after = (window - 1) // 2 if center else 0
    before = window - 1 - after
    out = f"{col}_moving_avg"
    value = F.when(~missing(df, col), name(col).cast("double"))
    keep = [name(c) for c in df.columns]

    def rolled(rows: DataFrame, over: Window) -> Column:
        frame = over.rowsBetween(-before, after)
        return F.when(F.count("_value").over(frame) >= max(least, 1), F.avg("_value").over(frame)).alias(out)

    valued = df.withColumn("_value", value)
    if parts:
        biggest = df.groupBy(*map(name, parts)).count().agg(F.max("count")).first()[0] or 0
        if biggest <= plain_group_rows:
            over = Window.partitionBy(*map(name, parts)).orderBy(*[name(c).asc_nulls_last() for c in order])
            return valued.select(*keep, rolled(valued, over))
    size = max(chunk_rows, window)
    groups = [f"_g{i}" for i in range(len(parts))]
    for g, p in zip(groups, parts):  # null is a partition of its own here
        valued = valued.withColumn(g, F.struct(name(p).isNull().alias("n"), name(p).alias("v")).cast("string"))
    numbered = ordered.number_rows(write_out(valued), order, groups, out="_no")
    place = numbered.withColumn("_chunk", F.floor(F.col("_no") / size))
    offset = F.col("_no") - F.col("_chunk") * size
    copies = F.array_compact(F.array(
        F.struct(F.col("_chunk").alias("chunk"), F.lit(True).alias("own")),
        F.when(offset >= size - before, F.struct((F.col("_chunk") + 1).alias("chunk"), F.lit(False).alias("own"))),
        F.when((offset < after) & (F.col("_chunk") > 0), F.struct((F.col("_chunk") - 1).alias("chunk"), F.lit(False).alias("own"))),
    ))
    spread = place.withColumn("_copy", F.explode(copies))
    over = Window.partitionBy(*groups, "_copy.chunk").orderBy("_no")
    return spread.select(*keep, rolled(spread, over), F.col("_copy.own").alias("_own")).filter("_own").drop("_own")


def rank(df: DataFrame, col: str, method: str = "average", pct: bool = False, order_by: str | Sequence[str] = (),
         rows_per_range: int = ordered.ROWS_PER_RANGE) -> DataFrame:
    """Ascending rank as ``<col>_rank``, missing values unranked.

    Ranks are computed on distinct values and joined back; only ``first`` numbers the rows themselves, reading ``df`` several
    times: pass a table, not a long computation.
    """
    require(df, col)
    if method not in ("average", "min", "max", "first", "dense"):
        raise ValueError("method must be average, min, max, first or dense")
    out = f"{col}_rank"
    if method == "first":
        order = as_list(order_by)
        if not order:
            raise ValueError("method 'first' needs order_by")
        # the table itself is read again for the cut points and range sizes, of which only the order columns are needed
        numbered = ordered.running_total(present(df, col), {out: F.lit(1).cast("long")}, [col, *order], (), rows_per_range)
        place = F.col(out) / F.col(f"{out}_all") if pct else F.col(out)
        ranked = numbered.select(*map(name, df.columns), place.cast("double").alias(out))
        return ranked.unionByName(df.filter(missing(df, col)).withColumn(out, F.lit(None).cast("double")))
    counts = write_out(present(df, col).groupBy(name(col)).agg(F.count(F.lit(1)).alias("_n")))
    totals = ordered.running_total(counts, {"_upto": F.col("_n"), "_dense": F.lit(1).cast("long")}, [col], (), rows_per_range)
    place = {
        "average": F.col("_upto") - (F.col("_n") - 1) / 2,
        "min": F.col("_upto") - F.col("_n") + 1,
        "max": F.col("_upto"),
        "dense": F.col("_dense"),
    }[method].cast("double")
    if pct:
        place = place / (F.col("_dense_all") if method == "dense" else F.col("_upto_all"))
    return df.join(totals.select(name(col), place.alias(out)), col, "left").select(*map(name, df.columns), out)


def bin_edges(df: DataFrame, cols: Sequence[str], bins: int) -> dict[str, tuple[list[float], list[str]]]:
    """Equal-width edges and interval labels per column, from one min/max pass over all of them."""
    at = {c: F.when(~missing(df, c), name(c).cast("double")) for c in cols}
    ends = df.agg(*[x for i, c in enumerate(cols) for x in (F.min(at[c]).alias(f"a{i}"), F.max(at[c]).alias(f"b{i}"))]).first()
    found = {}
    for i, c in enumerate(cols):
        low, high = ends[f"a{i}"], ends[f"b{i}"]
        if low is None:
            found[c] = ([], [])
            continue
        cut, edges = pd.cut(pd.Series([low, high], dtype="float64"), bins=bins, retbins=True)
        found[c] = ([float(e) for e in edges], [str(x) for x in cut.cat.categories])
    return found


def bin_number(value: Column, edges: Sequence[float]) -> Column:
    """0-based number of the right-closed interval that holds ``value``; null outside or when missing."""
    if not edges:
        return F.lit(None).cast("int")
    if len(edges) <= 65:
        number = F.when(value.isNull() | F.isnan(value) | (value <= edges[0]) | (value > edges[-1]), F.lit(None).cast("int"))
        for i, edge in enumerate(edges[1:]):
            number = number.when(value <= edge, F.lit(i))
        return number
    inside = (value > edges[0]) & (value <= edges[-1])
    below = F.size(F.filter(F.lit([float(e) for e in edges[1:]]), lambda e: e < value))
    return F.when(inside, below)


def bin(df: DataFrame, col: str, bins: int = 10, labels: str | Sequence[str] | None = None) -> DataFrame:
    """Equal-width bins as ``<col>_bin``, the label of the interval."""
    require_numeric(df, col)
    edges, intervals = bin_edges(df, [col], bins)[col]
    names = as_list(labels) if labels is not None else intervals
    if labels is not None and len(names) != bins:
        raise ValueError("the number of labels must equal the number of bins")
    number = bin_number(name(col).cast("double"), edges)
    if not edges:
        return df.withColumn(f"{col}_bin", F.lit(None).cast("string"))
    return df.withColumn(f"{col}_bin", F.get(F.lit(list(names)), number))
