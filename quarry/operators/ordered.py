"""Global order without a one-partition window.

Running totals, row numbers and exact quantiles over a total order. Rows are cut into ranges of the
order key by cut points taken from a sample; the ranges are then independent windows, and the totals
of earlier ranges are added as an offset. Results do not depend on the cut points, which only balance
the work: a group that holds a third of all rows is spread over as many ranges as its size asks for.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import as_number, long_form, name, present
from quarry.session import write_out

ROWS_PER_RANGE = 100_000
QUANTILE_RANGE_ROWS = 20_000  # fine, as only the ranges that hold a quantile are sorted
MAX_RANGES = 256  # cut points stand in every plan that uses them, so the driver holds no more of them when tables grow
SAMPLED_KEYS_PER_RANGE = 40


def _order_key(df: DataFrame, cols: Sequence[str]) -> Column:
    """Struct that sorts like ``cols`` ascending with nulls last.

    Only used to choose a range, so numbers and times may share a double: the mapping is monotone.
    """
    parts = []
    for i, c in enumerate(cols):
        ordered_type = isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType, T.DatetimeType))
        value = as_number(df, c) if ordered_type else name(c).cast("string")
        parts += [name(c).isNull().alias(f"n{i}"), value.alias(f"v{i}")]
    return F.struct(*parts)


def _cut_points(df: DataFrame, key: Column, rows_per_range: int, most: int | None = None) -> tuple[str, str, int]:
    """Cut points as a JSON array (their number is bounded), its type, and their count."""
    rows = df.count()
    ranges = min(most or MAX_RANGES, -(-rows // rows_per_range))
    if ranges <= 1:
        return "[]", "", 0
    keys = df.select(key.alias("k"))
    kind = f"array<{keys.schema['k'].dataType.simpleString()}>"
    fraction = min(1.0, SAMPLED_KEYS_PER_RANGE * ranges / rows)
    picked = (
        keys.sample(fraction, seed=11)
        .select("k", F.ntile(ranges).over(Window.partitionBy(F.lit(0)).orderBy("k")).alias("tile"))
        .filter("tile > 1")
        .groupBy("tile").agg(F.min("k").alias("k"))
        .agg(F.to_json(F.sort_array(F.collect_set("k"))).alias("cuts"), F.count_distinct("k").alias("n"))
        .first()
    )
    return picked["cuts"], kind, picked["n"]


def _with_range(df: DataFrame, key: Column, cuts: str, kind: str, count: int) -> DataFrame:
    """Add ``_range``, the number of cut points at or below ``key``.

    Binary search with halving strides, one generated projection per stride.
    """
    points = F.from_json(F.lit(cuts), kind)
    found = df.select("*", key.alias("_key"), F.lit(0).alias("_range"))
    for stride in (2 ** i for i in reversed(range(count.bit_length()))):
        reached = F.col("_range") + stride
        ahead = (reached <= count) & (F.col("_key") >= F.get(points, reached - 1))
        found = found.select(*[name(c) for c in df.columns], "_key", F.when(ahead, reached).otherwise(F.col("_range")).alias("_range"))
    return found.drop("_key")


def _offsets(ranged: DataFrame, outs: Iterable[str], by: Sequence[str]) -> DataFrame:
    """Per (by…, _range): the sum of every weight ``_w_<out>`` in earlier ranges, and in the whole group."""
    cells = [name(c) for c in [*by, "_range"]]
    totals = ranged.groupBy(*cells).agg(*[F.sum(f"_w_{o}").alias(f"_t_{o}") for o in outs])
    group = Window.partitionBy(*([name(c) for c in by] or [F.lit(0)]))
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *cells, *[F.col(f"_t_{o}") for o in outs],
        *[F.coalesce(F.sum(f"_t_{o}").over(earlier), F.lit(0)).alias(f"_o_{o}") for o in outs],
        *[F.sum(f"_t_{o}").over(group).alias(f"{o}_all") for o in outs],
    )


def running_total(df: DataFrame, weights: Mapping[str, Column], order: Sequence[str], by: Sequence[str] = (),
                  rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add, per output name, the sum of a weight over this row and all rows before it.

    ``order`` must be a total order within ``by``; ``by`` columns must not be null. Also adds
    ``<name>_all``, the group's whole sum. ``df`` is scanned several times: pass a written table.
    """
    by = list(by)
    key = _order_key(df, [*by, *order])
    cuts, kind, count = _cut_points(df, key, rows_per_range)
    if count == 0:  # all rows together fill one range at most
        group = Window.partitionBy(*([name(c) for c in by] or [F.lit(0)]))
        ahead = (group.orderBy(*[name(c).asc_nulls_last() for c in order])
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return df.select(
            "*",
            *[F.sum(w).over(ahead).alias(o) for o, w in weights.items()],
            *[F.sum(w).over(group).alias(f"{o}_all") for o, w in weights.items()],
        )
    ranged = _with_range(df, key, cuts, kind, count)
    cells = [*by, "_range"]
    upto = (Window.partitionBy(*[name(c) for c in cells])
            .orderBy(*[name(c).asc_nulls_last() for c in order])
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for out, weight in weights.items():
        ranged = ranged.withColumn(f"_w_{out}", weight)
    offsets = _offsets(ranged, weights, by)
    local = ranged.select("*", *[F.sum(f"_w_{o}").over(upto).alias(f"_l_{o}") for o in weights])
    joined = local.join(offsets, cells)
    return joined.select(
        *[name(c) for c in df.columns],
        *[(F.col(f"_l_{o}") + F.col(f"_o_{o}")).alias(o) for o in weights],
        *[F.col(f"{o}_all") for o in weights],
    )


def number_rows(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), out: str = "row_no",
                rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Row numbers 0, 1, … in ``order`` within ``by``."""
    counted = running_total(df, {out: F.lit(1).cast("long")}, order, by, rows_per_range)
    return counted.select(*[name(c) for c in df.columns], (F.col(out) - 1).alias(out))


def value_counts(df: DataFrame, values: Sequence[str], by: Sequence[str] = (), as_type: str = "double") -> DataFrame:
    """(by…, column, value, n) for every distinct value, written out: the shared base of ranks and quantiles.

    Equal values collapse before the shuffle, so a value held by most rows costs one row per task.
    """
    return write_out(
        long_form(present(df, *by), values, by, as_type)
        .groupBy(*[name(c) for c in by], "column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quantiles(df: DataFrame, values: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
              rows_per_range: int = QUANTILE_RANGE_ROWS) -> DataFrame:
    """Exact linearly interpolated quantiles as rows (by…, column, p, quantile)."""
    return quantiles_of_counts(value_counts(df, values, by), probs, [*by, "column"], rows_per_range)


def quantiles_of_counts(counts: DataFrame, probs: Sequence[float], groups: Sequence[str],
                        rows_per_range: int = QUANTILE_RANGE_ROWS) -> DataFrame:
    """Quantiles from a written (groups…, value, n) table.

    Range totals tell which ranges hold an asked position; only the rows of those ranges are sorted.
    """
    groups = list(groups)
    probs = [float(p) for p in probs]

    def covers(position: Column, start: Column, end: Column) -> Column:
        return (position >= start) & (position < end)

    def wanted(at: Column, start: Column, end: Column) -> Column:
        return covers(F.floor(at), start, end) | covers(F.ceil(at), start, end)

    # A quantile mixes the values at the two 0-based positions around p * (all - 1).
    last = F.col("upto_all") - 1

    def holds_any(start: Column, end: Column) -> Column:
        return reduce(lambda a, b: a | b, [wanted(F.lit(p) * last, start, end) for p in probs])

    key = _order_key(counts, [*groups, "value"])
    cuts, kind, count = _cut_points(counts, key, rows_per_range)
    if count == 0:
        ranked = running_total(counts, {"upto": F.col("n")}, ["value"], groups, rows_per_range)
    else:
        ranged = _with_range(counts, key, cuts, kind, count).withColumn("_w_upto", F.col("n"))
        ends = _offsets(ranged, ["upto"], groups).filter(holds_any(F.col("_o_upto"), F.col("_o_upto") + F.col("_t_upto")))
        ends = write_out(ends.drop("_t_upto"))  # at most two ranges per group and quantile
        cells = [*groups, "_range"]
        ahead = (Window.partitionBy(*[name(c) for c in cells]).orderBy("value")
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ranked = ranged.join(ends, cells).withColumn("upto", F.sum("n").over(ahead) + F.col("_o_upto"))
    start, end = F.col("upto") - F.col("n"), F.col("upto")  # the positions a row covers
    asked = F.array(*[F.struct(F.lit(p).alias("p"), (F.lit(p) * last).alias("at")) for p in probs])
    hits = (
        ranked.filter(holds_any(start, end))  # leaves a few rows per group
        .withColumn("_hits", F.filter(asked, lambda q: wanted(q["at"], start, end)))
        .select(*[name(g) for g in groups], "value", "n", "upto", F.explode("_hits").alias("_hit"))
    )
    low, high = F.floor(F.col("_hit.at")), F.ceil(F.col("_hit.at"))
    ends_of = hits.groupBy(*[name(g) for g in groups], F.col("_hit.p").alias("p"), F.col("_hit.at").alias("_at")).agg(
        F.max(F.when(covers(low, start, end), F.col("value"))).alias("_low"),
        F.max(F.when(covers(high, start, end), F.col("value"))).alias("_high"),
    )
    share = F.col("_at") - F.floor(F.col("_at"))
    return ends_of.select(*[name(g) for g in groups], "p",
                          (F.col("_low") + (F.col("_high") - F.col("_low")) * share).alias("quantile"))
