"""Choosing rows: first and last rows, samples, filters, search, sort, distinct, nulls, duplicates."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.columns import as_list, missing, name, require, text_columns
from quarry.functions.patterns import java_pattern, literal_pattern
from quarry.functions.predicate import predicate
from quarry.session import write_out

HASH_BITS = 16  # leading bits of the hash that name a cell; the one cell that is ranked holds about 2 ** -16 of a group
RANKED_ROWS = 10_000


def _ascending(cols: Sequence[str]) -> list[Column]:
    return [name(c).asc_nulls_last() for c in cols]


def head(df: DataFrame, n: int = 10, order_by: str | Sequence[str] = ()) -> DataFrame:
    cols = as_list(order_by)
    require(df, *cols)
    return df.orderBy(*_ascending(cols)).limit(n)


def tail(df: DataFrame, n: int = 10, order_by: str | Sequence[str] = ()) -> DataFrame:
    """Last ``n`` rows in their original order; only those ``n`` are sorted twice."""
    cols = as_list(order_by)
    require(df, *cols)
    return df.orderBy(*[name(c).desc_nulls_first() for c in cols]).limit(n).orderBy(*_ascending(cols))


def mark_by_hash(df: DataFrame, key: Sequence[str], seed: int, quota: DataFrame | int,
                 by: str | None = None, out: str = "taken") -> DataFrame:
    """Mark exactly ``quota`` rows (per ``by`` value when given as a table by, quota), repeatably.

    The rows with the smallest hashes of their keys are taken. Cells of equal leading bits are counted first;
    rows in cells below and above the boundary are decided by a comparison. A boundary cell of more than ``RANKED_ROWS``
    rows is cut by further bits of the hash, so only a cell of bounded size (or rows of one hash) is ranked, however many
    rows there are; the choice does not depend on the cells.
    """
    require(df, *key, by)
    spark = df.sparkSession
    mixed = F.xxhash64(F.lit(seed), *[name(k) for k in key])
    group = F.lit(0) if by is None else name(by)
    hashed = df.withColumn("_hash", mixed).withColumn("_group", group)
    prefix = lambda bits: F.shiftright("_hash", 64 - bits)
    if not isinstance(quota, DataFrame):
        quota = spark.range(1).select(F.lit(0).alias("_group"), F.lit(quota).cast("long").alias("_quota"))
    else:
        quota = quota.select(name(by).alias("_group"), F.col("quota").cast("long").alias("_quota"))
    group_cells = Window.partitionBy("_group")
    before = group_cells.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    slim = hashed.select("_group", "_hash")
    bits, edge = 0, None
    while True:
        # Per group: the first cell whose end reaches the quota, and how many of its rows are still wanted.
        more = min(64, bits + HASH_BITS)
        inside = slim if edge is None else slim.join(edge, F.col("_group").eqNullSafe(F.col("_of"))).filter(prefix(bits) == F.col("_edge"))
        cells = (
            inside.groupBy("_group", prefix(more).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .withColumn("_size", F.sum("_n").over(group_cells))
        )
        wanted = F.least(F.col("_quota"), F.col("_size"))
        edge = (
            cells.alias("c").join(quota.alias("q"), F.col("c._group").eqNullSafe(F.col("q._group")))
            .filter(F.col("_before") + F.col("_n") >= wanted)
            .groupBy("c._group").agg(F.min_by(F.struct("_cell", (wanted - F.col("_before")).alias("_rest"), "_n"), "_cell").alias("e"))
            .select(F.col("_group").alias("_of"), F.col("e._cell").alias("_edge"), F.col("e._rest").alias("_rest"), F.col("e._n").alias("_rows"))
        )
        edge, bits = write_out(edge), more
        if bits == 64 or not edge.filter((F.col("_rows") > RANKED_ROWS) & (F.col("_rest") > 0) & (F.col("_rest") < F.col("_rows"))).take(1):
            break
        quota = edge.select(F.col("_of").alias("_group"), F.col("_rest").alias("_quota"))
    hashed, edge = hashed.withColumn("_cell", prefix(bits)), edge.drop("_rows")
    placed = hashed.join(edge, F.col("_group").eqNullSafe(F.col("_of")))
    whole = placed.filter(F.col("_cell") != F.col("_edge")).withColumn(out, F.col("_cell") < F.col("_edge"))
    rank = F.row_number().over(Window.partitionBy("_group").orderBy("_hash", *[name(k) for k in key]))
    split = placed.filter(F.col("_cell") == F.col("_edge")).withColumn(out, rank <= F.col("_rest"))
    kept = [*[name(c) for c in df.columns], name(out)]
    return whole.select(*kept).unionByName(split.select(*kept))


def sample(df: DataFrame, frac: float | None = None, n: int | None = None, seed: int = 0,
           key: str | Sequence[str] = ()) -> DataFrame:
    """Exact-size sample without replacement; the same seed gives the same rows. ``key`` identifies a row."""
    keys = as_list(key)
    require(df, *keys)
    if not keys:
        raise ValueError("sample needs the columns that identify a row")
    if frac is not None and not 0 <= frac <= 1:
        raise ValueError("frac must be between 0 and 1")
    if frac is None and n is not None and n <= 0:
        raise ValueError("n must be a positive integer")
    size = round(frac * df.count()) if frac is not None else (n or 10)
    return mark_by_hash(df, keys, seed, size, out="_taken").filter("_taken").drop("_taken")


def filter_rows(df: DataFrame, where: str) -> DataFrame:
    return df.filter(predicate(df, where))


def sql(spark: SparkSession, query: str, params: dict | list | str | None = None) -> DataFrame:
    """Any SQL text; parameters by name (dict) or by position (list), as values or JSON."""
    if isinstance(params, str):
        params = json.loads(params)
    if params is not None and not isinstance(params, (dict, list)):
        raise ValueError("params must be a JSON object or array")
    return spark.sql(query, args=params) if params else spark.sql(query)


def search(df: DataFrame, term: str, cols: str | Sequence[str] | None = None, case_sensitive: bool = False,
           regex: bool = False) -> DataFrame:
    """Rows where any text column contains the term; with ``cols`` only those columns come back."""
    chosen = as_list(cols)
    require(df, *chosen)
    if chosen:
        df = df.select(*[name(c) for c in chosen])
    texts = text_columns(df)
    if not texts:
        return df.limit(0)
    if regex:
        found = [name(c).rlike(("" if case_sensitive else "(?iu)") + java_pattern(term)) for c in texts]
    elif case_sensitive:
        found = [F.contains(name(c), F.lit(term)) for c in texts]
    else:
        found = [name(c).rlike("(?iu)" + literal_pattern(term)) for c in texts]
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in found]))


def sort(df: DataFrame, col: str, order: str = "asc") -> DataFrame:
    require(df, col)
    return df.orderBy(name(col).asc_nulls_last() if order == "asc" else name(col).desc_nulls_last())


def distinct(df: DataFrame, col: str) -> DataFrame:
    require(df, col)
    return df.select(name(col)).distinct()


def value_counts(df: DataFrame, col: str) -> DataFrame:
    require(df, col)
    return (
        df.filter(~missing(df, col)).groupBy(name(col)).agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), name(col))
    )


def find_nulls(df: DataFrame, cols: str | Sequence[str] | None = None, mode: str = "any") -> DataFrame:
    chosen = as_list(cols) or df.columns
    require(df, *chosen)
    if mode not in ("any", "all"):
        raise ValueError("mode must be any or all")
    tests = [missing(df, c) for c in chosen]
    return df.filter(reduce((lambda a, b: a | b) if mode == "any" else (lambda a, b: a & b), tests))


def dups(df: DataFrame, col: str | Sequence[str] | None = None, keep: str = "first",
         order_by: str | Sequence[str] = ()) -> DataFrame:
    """Rows marked duplicate: all but the first, all but the last, or every member (``keep='none'``).

    Duplicated keys are found by a map-side combined aggregate and joined back, so a key that holds
    most rows is never sorted in one task. Ties in ``order_by`` go by the other columns; of identical rows all but one
    count as duplicates and are produced from their count, as in a whole-row comparison without an order.
    """
    subset = as_list(col) or df.columns
    order = as_list(order_by)
    require(df, *subset, *order)
    if keep not in ("first", "last", "none"):
        raise ValueError("keep must be first, last or none")
    groups = [name(c).alias(f"_k{i}") for i, c in enumerate(subset)]
    place = F.struct(*[F.struct(name(c).isNull().alias("n"), name(c).alias("v")).alias(f"o{i}")
                       for i, c in enumerate([*order, *[c for c in df.columns if c not in order]])])
    columns = [name(c) for c in df.columns]

    def surplus(counted: DataFrame) -> DataFrame:
        """All but one of ``_n`` identical rows, split into short runs so no task emits them all."""
        runs = counted.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 2) / 1000))))
        left = F.least(F.lit(1000), F.col("_n") - 1 - F.col("_run") * 1000)
        runs = runs.repartition(*columns, "_run")
        return runs.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), left))).select(*columns)

    if keep != "none" and not order:
        if subset != df.columns:
            raise ValueError("keep first/last needs order_by")
        return surplus(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    aggs = [F.count(F.lit(1)).alias("_n")]
    if keep != "none":
        aggs.append((F.min(place) if keep == "first" else F.max(place)).alias("_kept"))
    repeated = df.groupBy(*groups).agg(*aggs).filter("_n > 1")
    same = reduce(lambda a, b: a & b, [name(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(subset)])
    marked = df.join(repeated, same)
    if keep == "none":
        return marked.select(*columns)
    copies = marked.filter(place == F.col("_kept")).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return marked.filter(place != F.col("_kept")).select(*columns).unionByName(surplus(copies))
