"""Grouping, pivots, cross tabulation, summaries, correlation and column profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import (
    as_list, is_numeric, missing, name, numeric_columns, present, require, require_numeric, text_columns,
)
from quarry.operators import ordered
from quarry.operators.rows import sample as sample_rows
from quarry.session import write_out

ACCURACY = 10_000  # approximate percentiles: the share of the rows that a rank may be off is one in this many
RELATIVE_ERROR = 0.02  # of approximate distinct counts
ITEMS = 10_000  # counters per column for frequent values
LABELS_PER_BLOCK = 1_000
BROADCAST_VALUES = 100_000  # distinct values whose ranks may be sent to the rows

_FUNCS = {
    "mean": F.avg, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "count": F.count, "min": F.min, "max": F.max, "std": F.stddev_samp,
    "var": F.var_samp, "nunique": F.count_distinct,
}


def _clean(df: DataFrame, col: str) -> Column:
    """The column with NaN read as missing."""
    return F.when(~missing(df, col), name(col))


def parse_agg(agg: str | Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """``"price:mean,qty:sum"`` as pairs."""
    if not isinstance(agg, str):
        return list(agg)
    pairs = [tuple(part.strip() for part in item.split(":")) for item in agg.split(",")]
    if any(len(p) != 2 for p in pairs):
        raise ValueError("agg must look like 'column:function,column:function'")
    return pairs


def groupby(df: DataFrame, keys: str | Sequence[str], agg: str | Sequence[tuple[str, str]] | None = None, approx: bool = False) -> DataFrame:
    """Group and summarise; without ``agg`` the group sizes. Rows with a missing key are left out.

    Medians are exact and spread over tasks by value range, whatever the size of the largest group. With ``approx`` they come
    from a mergeable sketch in the same pass as everything else: a value whose rank is at most 1 / ``ACCURACY`` of the group's
    size away from the middle.
    """
    keys = as_list(keys)
    require(df, *keys)
    rows = present(df, *keys)
    if not agg:
        return rows.groupBy(*map(name, keys)).agg(F.count(F.lit(1)).alias("counts"))
    pairs = parse_agg(agg)
    require(df, *[c for c, _ in pairs])
    unknown = [f for _, f in pairs if f not in _FUNCS and f != "median"]
    if unknown:
        raise ValueError(f"unknown aggregate: {', '.join(unknown)}")
    plain = [(c, f) for c, f in pairs if f != "median"]
    medians = [c for c, f in pairs if f == "median"]
    if approx:
        sketched = {c: F.percentile_approx(_clean(df, c).cast("double"), 0.5, ACCURACY).alias(f"{c}_median") for c in medians}
        return rows.groupBy(*map(name, keys)).agg(*[sketched[c] if f == "median" else _FUNCS[f](_clean(df, c)).alias(f"{c}_{f}") for c, f in pairs])
    grouped = rows.groupBy(*map(name, keys)).agg(
        F.count(F.lit(1)).alias("_rows"), *[_FUNCS[f](_clean(df, c)).alias(f"{c}_{f}") for c, f in plain])
    if medians:
        # neutral key names, as a key may be called like a column of the quantile table
        plain_keys = [f"_k{i}" for i in range(len(keys))]
        measured = rows.select(*[name(k).alias(p) for k, p in zip(keys, plain_keys)], *[name(c) for c in dict.fromkeys(medians)])
        middle = ordered.quantiles(measured, list(dict.fromkeys(medians)), [0.5], plain_keys)
        wide = middle.groupBy(*plain_keys).agg(
            *[F.max(F.when(F.col("column") == c, F.col("quantile"))).alias(f"{c}_median") for c in dict.fromkeys(medians)])
        wide = wide.select(*[F.col(p).alias(k) for k, p in zip(keys, plain_keys)], *[name(f"{c}_median") for c in dict.fromkeys(medians)])
        grouped = grouped.join(wide, keys, "left")
    return grouped.select(*map(name, keys), *[name(f"{c}_{f}") for c, f in pairs])


def _pivot_values(df: DataFrame, col: str) -> list:
    """The new column heads; Spark's own limit on pivot values applies."""
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = [r[0] for r in present(df, col).select(name(col)).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"column '{col}' has more than {limit} values; raise spark.sql.pivotMaxValues")
    return sorted(found)


def groupby_pivot(df: DataFrame, keys: str | Sequence[str], agg: str | Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Group, then turn the last key's values into columns ``<value>_<column>_<function>``."""
    keys = as_list(keys)
    if len(keys) < 2:
        raise ValueError("a pivot needs at least two keys")
    grouped = groupby(df, keys, agg)
    measures = grouped.columns[len(keys):]
    heads = _pivot_values(df, keys[-1])
    # Aggregates first: the pivot then moves one row per group, not the data.
    wide = grouped.groupBy(*map(name, keys[:-1])).agg(*[
        F.first(F.when(name(keys[-1]) == F.lit(v), name(m)), ignorenulls=True).alias(f"{v}_{m}")
        for v in heads for m in measures
    ])
    return wide


def pivot(df: DataFrame, index: str, columns: str, values: str, func: str = "mean",
          fill_value: float | str | None = None) -> DataFrame:
    require(df, index, columns, values)
    if func not in ("mean", "sum", "count", "min", "max"):
        raise ValueError("func must be mean, sum, count, min or max")
    # sums and counts of no values are 0, other statistics have no cell then
    rows = present(df, index, columns, *([] if func in ("sum", "count") else [values]))
    heads = _pivot_values(rows, columns)
    grouped = rows.groupBy(name(index)).pivot(columns, heads)
    if func == "sum":  # a pair of index and column that never occurs stays empty
        both = grouped.agg(_FUNCS[func](_clean(df, values)).alias("sum"), F.count(F.lit(1)).alias("rows"))
        cells = both.columns[1:]  # a sum and a count for each head
        wide = both.select(name(index), *[F.when(name(n) > 0, name(v)).alias(v.removesuffix("_sum")) for v, n in zip(cells[::2], cells[1::2])])
    else:
        wide = grouped.agg(_FUNCS[func](_clean(df, values)))
    if fill_value is None:
        return wide
    if isinstance(fill_value, str):
        fill_value = float(fill_value)
    return wide.na.fill(fill_value, [c for c in wide.columns if c != index])


def crosstab(df: DataFrame, row: str, col: str, normalize: str | None = None, margins: bool = False, zeros: bool = True) -> DataFrame:
    """Frequencies as rows (row, col, value); margins use the label All.

    Every combination of seen values is present, with 0 where the pair never occurs; ``zeros=False`` leaves these out. There is
    no limit on the number of labels: margins come from the cells that occur, and zeros are made last, block by block.
    """
    return _crosstab_cells(df, row, col, normalize, margins, zeros).select("row", "col", "value")


def _with_zeros(counts: DataFrame, rows: DataFrame, cols: DataFrame, block: int) -> DataFrame:
    """(row, col, n, of_row, of_col) for every pair of labels with the totals of both, from the cells that occur.

    Column labels are numbered in order and cut into blocks. A line and a block meet once, with the line's cells of that block
    as a map; the zeros arise where the block's labels are looked up in it, after all shuffles.
    """
    numbered = write_out(ordered.number_rows(cols, ["col"], out="no").select("col", "whole", F.floor(F.col("no") / block).cast("int").alias("block")))
    blocks = numbered.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("col", "whole"))).alias("labels"))
    last = numbered.agg(F.max("block")).first()[0]
    if last is None:
        return counts.select("row", "col", "n", F.col("n").alias("of_row"), F.col("n").alias("of_col"))
    held = counts.join(numbered.select("col", "block"), "col").groupBy("row", "block").agg(F.map_from_entries(F.collect_list(F.struct("col", "n"))).alias("held"))
    lines = rows.select("row", F.col("whole").alias("of_row"), F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block")).join(held, ["row", "block"], "left").join(blocks, "block")
    return lines.select("row", "of_row", "held", F.explode("labels").alias("label")).select(
        "row", F.col("label.col").alias("col"), F.coalesce(F.try_element_at("held", F.col("label.col")), F.lit(0)).alias("n"), "of_row", F.col("label.whole").alias("of_col"))


def _crosstab_cells(df: DataFrame, row: str, col: str, normalize: str | None, margins: bool, zeros: bool = True, block: int = LABELS_PER_BLOCK) -> DataFrame:
    """(row, col, value, any_row, any_col): the flags tell a margin from a label that happens to be All."""
    require(df, row, col)
    if normalize not in (None, "index", "columns", "all"):
        raise ValueError("normalize must be index, columns or all")
    counts = write_out(present(df, row, col).groupBy(name(row).cast("string").alias("row"), name(col).cast("string").alias("col")).agg(F.count(F.lit(1)).alias("n")))
    line = lambda label: write_out(counts.groupBy(label).agg(F.sum("n").alias("whole")))  # margins, from the cells that occur
    rows, cols = line("row"), line("col")
    flag = lambda yes: F.lit(int(yes)).cast("byte")
    if zeros:
        inner = _with_zeros(counts, rows, cols, block)
    else:
        inner = counts.join(rows.withColumnRenamed("whole", "of_row"), "row").join(cols.withColumnRenamed("whole", "of_col"), "col")
    parts = {(0, 0): inner}
    if margins:
        every = F.lit("All")
        total = lambda label: F.col("whole").alias(label)
        parts |= {(0, 1): rows.select("row", every.alias("col"), total("n"), total("of_row")), (1, 0): cols.select(every.alias("row"), "col", total("n"), total("of_col"))}
        if rows.take(1):
            parts[1, 1] = rows.agg(F.sum("whole").alias("n")).select(every.alias("row"), every.alias("col"), "n")
        if normalize == "index":
            parts = {at: p for at, p in parts.items() if at[1] == 0}
        elif normalize == "columns":
            parts = {at: p for at, p in parts.items() if at[0] == 0}
    found = []
    for (any_row, any_col), part in parts.items():
        if normalize is None:
            value = F.col("n").cast("double")
        elif normalize == "all" or normalize == "index" and any_row or normalize == "columns" and any_col:
            value = F.col("n") / rows.agg(F.sum("whole")).scalar()  # of everything, which is also the margin's own line
        else:
            value = F.col("n") / F.col("of_row" if normalize == "index" else "of_col")
        found.append(part.select("row", "col", value.alias("value"), flag(any_row).alias("any_row"), flag(any_col).alias("any_col")))
    return reduce(DataFrame.unionByName, found)


def crosstab_wide(df: DataFrame, row: str, col: str, normalize: str | None = None, margins: bool = False) -> DataFrame:
    """One row per label of ``row``, one column per label of ``col``; margins come last, as row and column All."""
    cells = _crosstab_cells(df, row, col, normalize, margins)
    heads = _pivot_values(cells.filter("any_col = 0"), "col")
    total = margins and normalize in (None, "columns", "all")
    if total and "All" in heads:
        raise ValueError("a label is called All, like the margin")
    wide = cells.filter("any_col = 0 or any_col = 1").groupBy("row", "any_row").pivot("col", heads + (["All"] if total else [])).agg(F.first("value"))
    return wide.drop("any_row")


def _numeric_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, max of every column in one pass, as (column, metric, value)."""
    metrics = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    one = df.agg(*[f(_clean(df, c)).cast("double").alias(f"{m}_{i}") for i, c in enumerate(cols) for m, f in metrics.items()])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(m).alias("metric"), F.col(f"{m}_{i}").alias("value"))
        for i, c in enumerate(cols) for m in metrics
    ])))


def percent_label(p: float) -> str:
    return f"{p * 100:g}%"


def describe(df: DataFrame, percentiles: Sequence[float] | None = None, include: str = "all",
             approx: bool = False) -> DataFrame:
    """Summary as rows (column, metric, value, text).

    Numbers get count, mean, std, min, percentiles (always with 50 %) and max; other columns count,
    unique, top and freq (smallest value on a tie). ``approx`` reads the table once and shuffles no values: percentiles,
    unique, top and freq then come from mergeable sketches (see ``profile``).
    """
    if include not in ("all", "number", "object"):
        raise ValueError("include must be all, number or object")
    probs = sorted({0.5, *([0.25, 0.75] if percentiles is None else percentiles)})
    if any(not 0 <= p <= 1 for p in probs):
        raise ValueError("percentiles must be between 0 and 1")
    numbers = numeric_columns(df) if include != "object" else []
    others = [c for c in df.columns if not is_numeric(df, c)] if include != "number" else []
    if approx:
        return _sketched_summary(df, numbers, others, probs)
    parts = []
    if numbers:
        parts.append(_numeric_summary(df, numbers).withColumn("text", F.lit(None).cast("string")))
        label = F.element_at(F.map_from_arrays(
            F.array(*[F.lit(float(p)) for p in probs]), F.array(*[F.lit(percent_label(p)) for p in probs])), F.col("p"))
        points = ordered.quantiles(df, numbers, probs).select("column", label.alias("metric"), F.col("quantile").alias("value"))
        parts.append(points.withColumn("text", F.lit(None).cast("string")))
    if others:
        counts = ordered.value_counts(df, others, as_type="string")
        top = counts.groupBy("column").agg(
            F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), F.max("n").alias("freq"),
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"))
        metric = lambda m, v, t: F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"), t.alias("text"))
        none = F.lit(None).cast("string")
        parts.append(top.select("column", F.inline(F.array(
            metric("count", F.col("count"), none), metric("unique", F.col("unique"), none),
            metric("top", F.lit(None), F.col("top")), metric("freq", F.col("freq"), none)))))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _heavy(df: DataFrame, col: str, top: int, items: int) -> Column:
    """The ``top`` most frequent present values of a column as texts with their counts, from a sketch of ``items`` counters."""
    return F.expr(f"approx_top_k(CAST({_quoted(col)} AS STRING), {int(top)}, {int(items)}) FILTER (WHERE {_filled(df, col)})")


def _quoted(col: str) -> str:
    return "`" + col.replace("`", "``") + "`"


def _filled(df: DataFrame, col: str) -> str:
    is_float = isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType))
    return f"{_quoted(col)} IS NOT NULL" + (f" AND NOT isnan({_quoted(col)})" if is_float else "")


def _sketched_summary(df: DataFrame, numbers: Sequence[str], others: Sequence[str], probs: Sequence[float], items: int = ITEMS) -> DataFrame:
    """What ``describe`` returns, from one aggregate over one scan."""
    plain = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    made = [f(_clean(df, c)).cast("double").alias(f"{m}_{i}") for i, c in enumerate(numbers) for m, f in plain.items()]
    made += [F.percentile_approx(_clean(df, c).cast("double"), [float(p) for p in probs], ACCURACY).alias(f"q_{i}") for i, c in enumerate(numbers)]
    for i, c in enumerate(others):
        made += [F.count(_clean(df, c)).alias(f"c_{i}"), F.approx_count_distinct(_clean(df, c), RELATIVE_ERROR).alias(f"u_{i}"), _heavy(df, c, 1, items).alias(f"t_{i}")]
    one = df.agg(*made)
    entry = lambda c, m, value, text=F.lit(None): F.struct(F.lit(c).alias("column"), F.lit(m).alias("metric"), value.cast("double").alias("value"), text.cast("string").alias("text"))
    cells = [entry(c, m, F.col(f"{m}_{i}")) for i, c in enumerate(numbers) for m in plain]
    cells += [entry(c, percent_label(p), F.get(F.col(f"q_{i}"), F.lit(j))) for i, c in enumerate(numbers) for j, p in enumerate(probs)]
    for i, c in enumerate(others):
        best = F.get(F.col(f"t_{i}"), F.lit(0))
        cells += [entry(c, "count", F.col(f"c_{i}")), entry(c, "unique", F.col(f"u_{i}")), entry(c, "top", F.lit(None), best["item"]), entry(c, "freq", best["count"])]
    return one.select(F.inline(F.array(*cells)))


def histograms(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width counts of several columns as (column, bin, low, high, n): one scan for the ends, one for the counts.

    Bins are closed on the left, the last one on both sides; a column of one value is widened by a half on both sides; a
    column without values has no bins.
    """
    cols = list(cols)
    require_numeric(df, *cols)
    at = {c: _clean(df, c).cast("double") for c in cols}
    ends = df.agg(*[x for i, c in enumerate(cols) for x in (F.min(at[c]).alias(f"a{i}"), F.max(at[c]).alias(f"b{i}"))]).first()
    spark, held = df.sparkSession, []
    for i, c in enumerate(cols):
        low, high = ends[f"a{i}"], ends[f"b{i}"]
        if low is not None:
            held.append((c, *((low - 0.5, high + 0.5) if low == high else (low, high))))
    if not held:
        return spark.createDataFrame([], "column string, bin int, low double, high double, n long")
    number = lambda c, low, high: F.when(at[c].isNotNull(), F.least(F.lit(bins - 1), F.floor((at[c] - low) / (high - low) * bins))).cast("int")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), number(c, low, high).alias("bin")) for c, low, high in held])
    counted = df.select(F.inline(cells)).filter("bin IS NOT NULL").groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(c, b, low + b * ((high - low) / bins), low + (b + 1) * ((high - low) / bins)) for c, low, high in held for b in range(bins)],
                                  "column string, bin int, low double, high double")
    return every.join(counted, ["column", "bin"], "left").select("column", "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def _matrix(pairs: DataFrame) -> DataFrame:
    """Both triangles of a symmetric matrix given as (a, b, corr, n) with a before b."""
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr", "n"))


def corr_pearson(df: DataFrame, min_periods: int | None = None, cols: Sequence[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson matrix as (a, b, corr, n); one pass for all pairs."""
    cols = list(cols or numeric_columns(df))
    require_numeric(df, *cols)
    least = max(1, min_periods or 1)
    pairs = [*combinations(cols, 2), *[(c, c) for c in cols]]
    at = {c: _clean(df, c).cast("double") for c in cols}
    def agreement(a: str, b: str) -> Column:
        # corr() divides by zero when a side does not vary
        x, y = F.when(at[b].isNotNull(), at[a]), F.when(at[a].isNotNull(), at[b])
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    one = df.agg(*[
        x for i, (a, b) in enumerate(pairs)
        for x in (agreement(a, b).alias(f"r{i}"), F.count_if(at[a].isNotNull() & at[b].isNotNull()).alias(f"n{i}"))
    ])
    flat = one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                 # a column always agrees with itself, unless it does not vary
                 F.when((F.col(f"n{i}") >= least) & F.col(f"r{i}").isNotNull() & ~F.isnan(f"r{i}"),
                        F.lit(1.0) if a == b else F.col(f"r{i}")).alias("corr"),
                 F.col(f"n{i}").alias("n"))
        for i, (a, b) in enumerate(pairs)])))
    return _matrix(flat.filter("a <> b")).unionByName(flat.filter("a = b"))


def complete_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(pair, x, y, w): per pair of columns the distinct values where both are present, and how often.

    Written out. All pairs share one scan, and equal pairs collapse before the shuffle.
    """
    at = {c: _clean(df, c).cast("double") for pair in pairs for c in pair}
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), at[a].alias("x"), at[b].alias("y")) for i, (a, b) in enumerate(pairs)])
    return write_out(
        df.select(F.inline(cells)).filter("x IS NOT NULL AND y IS NOT NULL")
        .groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w")))


def pair_names(spark, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, a string, b string")


def with_diagonal(df: DataFrame, cols: Sequence[str], found: DataFrame, least: int) -> DataFrame:
    """The full matrix from (a, b, corr, n) of the upper triangle; a column agrees with itself if it varies."""
    at = {c: _clean(df, c) for c in cols}
    one = df.agg(*[x for i, c in enumerate(cols) for x in (F.count(at[c]).alias(f"n{i}"), (F.min(at[c]) < F.max(at[c])).alias(f"v{i}"))])
    diagonal = one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"),
                 F.when((F.col(f"n{i}") >= least) & F.col(f"v{i}"), F.lit(1.0)).alias("corr"), F.col(f"n{i}").alias("n"))
        for i, c in enumerate(cols)])))
    return _matrix(found).unionByName(diagonal)


def _average_ranks(base: DataFrame, width: int, gaps: Sequence[int], rows_per_range: int) -> DataFrame:
    """(i, value, r), written: per column i of ``base`` (v0, v1, …) and distinct value its average ranks.

    The first is the rank among all values of the column; then one for each column of ``gaps``, among the rows that have a
    value there. All come from one running total over the distinct values, with a count for each of these.
    """
    sides = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("value")) for i in range(width)])
    held = [F.col(f"v{g}").isNotNull().alias(f"h{g}") for g in gaps]
    counts = write_out(base.select(*held, F.inline(sides)).filter("value IS NOT NULL").groupBy("i", "value").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(f"h{g}").alias(f"n{g}") for g in gaps]))
    totals = ordered.running_total(counts, {"upto": F.col("n")} | {f"upto{g}": F.col(f"n{g}") for g in gaps}, ["value"], ["i"], rows_per_range)
    middle = lambda upto, n: F.col(upto) - (F.col(n) - 1) / 2
    return write_out(totals.select("i", "value", F.array(middle("upto", "n"), *[middle(f"upto{g}", f"n{g}") for g in gaps]).alias("r")))


def corr_spearman(df: DataFrame, min_periods: int | None = None, cols: Sequence[str] | None = None,
                  rows_per_range: int = ordered.ROWS_PER_RANGE) -> DataFrame:
    """Pearson on average ranks taken over the rows where both columns have a value.

    Ranks are computed per column, not per pair, and joined to the rows once per column (where a column has few distinct
    values without a shuffle); one pass then sums the products of all pairs. A column's ranks differ between pairs only where
    the other column has gaps, so each value carries one more rank for every column that has some.
    """
    cols = list(cols or numeric_columns(df))
    require_numeric(df, *cols)
    least = max(1, min_periods or 1)
    base = df.select(*[_clean(df, c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    filled = base.agg(F.count(F.lit(1)), *[F.count(f"v{i}") for i in range(len(cols))]).first()
    gaps = [i for i in range(len(cols)) if filled[i + 1] < filled[0]]
    ranks = _average_ranks(base, len(cols), gaps, rows_per_range)
    distinct = {r["i"]: r["count"] for r in ranks.groupBy("i").count().collect()}
    ranked = base
    for i in range(len(cols)):
        side = ranks.filter(F.col("i") == i).select(F.col("value").alias(f"value{i}"), F.col("r").alias(f"r{i}"))
        few = distinct.get(i, 0) <= BROADCAST_VALUES
        ranked = ranked.join(F.broadcast(side) if few else side, F.col(f"v{i}") == F.col(f"value{i}"), "left").drop(f"value{i}")
    place = {g: k + 1 for k, g in enumerate(gaps)}
    pairs = list(combinations(range(len(cols)), 2))
    middle = (filled[0] + 1) / 2  # ranks are taken from here, so that sums of squares stay exact for longer
    sums = []
    for a, b in pairs:
        both = F.col(f"v{a}").isNotNull() & F.col(f"v{b}").isNotNull()
        x, y = (F.when(both, F.get(f"r{one}", F.lit(place.get(other, 0))) - middle) for one, other in ((a, b), (b, a)))
        sums += [F.count_if(both).alias(f"n_{a}_{b}"), F.sum(x * y).alias(f"xy_{a}_{b}"), F.sum(x * x).alias(f"xx_{a}_{b}"), F.sum(y * y).alias(f"yy_{a}_{b}"),
                 ((F.min(x) < F.max(x)) & (F.min(y) < F.max(y))).alias(f"vary_{a}_{b}")]
    cells = []
    for a, b in pairs:
        n = F.col(f"n_{a}_{b}").cast("double")
        off = (n + 1) / 2 - middle
        less = n * off * off  # n times the squared mean
        spread = F.sqrt(F.col(f"xx_{a}_{b}") - less) * F.sqrt(F.col(f"yy_{a}_{b}") - less)
        corr = F.when((F.col(f"n_{a}_{b}") >= least) & F.col(f"vary_{a}_{b}"), F.try_divide(F.col(f"xy_{a}_{b}") - less, spread))
        cells.append(F.struct(F.lit(cols[a]).alias("a"), F.lit(cols[b]).alias("b"), corr.alias("corr"), F.col(f"n_{a}_{b}").alias("n")))
    if not cells:
        found = df.sparkSession.createDataFrame([], "a string, b string, corr double, n long")
    else:
        found = ranked.agg(*sums).select(F.inline(F.array(*cells)))
    return with_diagonal(df, cols, found, least)


def _moment(df: DataFrame, numeric_only: bool, label: str, enough: int, formula) -> DataFrame:
    cols = numeric_columns(df)
    others = [c for c in df.columns if c not in cols]
    if others and not numeric_only:
        raise ValueError(f"not numeric: {', '.join(others)}; use numeric_only")
    at = {c: _clean(df, c).cast("double") for c in cols}
    one = df.agg(*[x for i, c in enumerate(cols) for x in (
        F.count(at[c]).cast("double").alias(f"n{i}"), F.skewness(at[c]).alias(f"skew{i}"), F.kurtosis(at[c]).alias(f"kurt{i}"))])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 # a constant column has no spread; its moments count as 0
                 F.when(F.col(f"n{i}") >= enough, F.coalesce(formula(i), F.lit(0.0))).alias(label))
        for i, c in enumerate(cols)])))


def skew(df: DataFrame, numeric_only: bool = False) -> DataFrame:
    """Bias-corrected skewness per column; null below three values."""
    def g1(i: int) -> Column:
        n = F.col(f"n{i}")
        return F.col(f"skew{i}") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return _moment(df, numeric_only, "skew", 3, g1)


def kurtosis(df: DataFrame, numeric_only: bool = False) -> DataFrame:
    """Bias-corrected excess kurtosis per column; null below four values."""
    def g2(i: int) -> Column:
        n = F.col(f"n{i}")
        return (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.col(f"kurt{i}") + 6)
    return _moment(df, numeric_only, "kurtosis", 4, g2)


def profile(df: DataFrame, top: int = 5, approx: bool = False, sample: float | None = None, histogram: bool = False, bins: int = 20,
            key: str | Sequence[str] = (), seed: int = 0, items: int = ITEMS) -> DataFrame:
    """Per column the share of present and of distinct values in percent, and its most frequent values.

    Rows (column, non_null_pct, unique_pct, rank, value, n); a column without values has one row with rank null.

    ``approx`` reads the table once and shuffles sketches instead of values. Distinct values then have a relative standard
    error of ``RELATIVE_ERROR``. Counts of frequent values are exact while a column has at most three quarters of ``items``
    different ones; beyond that a count is too high by at most 3.5 / ``items`` of the rows, and a value that is rarer than that may
    be missing. ``sample`` (above 0, at most 1) profiles that share of the rows: a repeatable choice of exact size where
    ``key`` names what tells rows apart, else each row by chance. ``histogram`` adds the column histogram, an array of
    (low, high, n) with ``bins`` equal bins for numbers, null for other columns.
    """
    if sample is not None:
        if not 0 < sample <= 1:
            raise ValueError("sample must be above 0 and at most 1")
        if sample < 1:
            df = sample_rows(df, frac=sample, key=key, seed=seed) if as_list(key) else df.sample(sample, seed)
    cols = df.columns
    if approx:
        one = df.agg(F.count(F.lit(1)).alias("rows"), *[x for i, c in enumerate(cols) for x in (
            F.count_if(~missing(df, c)).alias(f"c{i}"), F.approx_count_distinct(_clean(df, c), RELATIVE_ERROR).alias(f"u{i}"), _heavy(df, c, top, items).alias(f"t{i}"))])
        per = one.select("rows", F.inline(F.array(*[F.struct(
            F.lit(c).alias("column"), F.col(f"c{i}").alias("filled"), F.col(f"u{i}").alias("unique"),
            F.transform(f"t{i}", lambda t: F.struct(t["count"].alias("n"), t["item"].alias("value"))).alias("held")) for i, c in enumerate(cols)])))
        ranked = F.sort_array(F.transform("held", lambda t: F.struct((-t["n"]).alias("less"), t["value"].alias("value"))))
        listed = per.select("column", "rows", "filled", "unique", F.posexplode_outer(ranked).alias("at", "best"))
        shown = listed.select("column", (F.coalesce("filled", F.lit(0)) * 100 / F.col("rows")).alias("non_null_pct"), (F.col("unique") * 100 / F.col("rows")).alias("unique_pct"),
                              (F.col("at") + 1).alias("rank"), F.col("best.value").alias("value"), (-F.col("best.less")).alias("n"))
    else:
        counts = ordered.value_counts(df, cols, as_type="string")
        best = (
            counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value")))
            .filter(F.col("rank") <= top)
        )
        one = df.agg(F.count(F.lit(1)).alias("rows"))
        names = one.select("rows", F.explode(F.array(*[F.lit(c) for c in cols])).alias("column"))
        per = names.join(counts.groupBy("column").agg(F.sum("n").alias("filled"), F.count(F.lit(1)).alias("unique")), "column", "left")
        shares = per.select("column", (F.coalesce("filled", F.lit(0)) * 100 / F.col("rows")).alias("non_null_pct"),
                            (F.coalesce("unique", F.lit(0)) * 100 / F.col("rows")).alias("unique_pct"))
        shown = shares.join(best, "column", "left").select("column", "non_null_pct", "unique_pct", "rank", "value", "n")
    if not histogram:
        return shown
    drawn = histograms(df, numeric_columns(df), bins).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("low", "high", "n"))).alias("histogram"))
    return shown.join(drawn, "column", "left")


def profile_json(df: DataFrame, minimal: bool = False) -> DataFrame:
    """The summary of all columns as one JSON document; ``minimal`` leaves the percentiles out."""
    rows = describe(df)
    if minimal:
        rows = rows.filter(~F.col("metric").endswith("%"))
    # Output size depends on the number of columns only.
    entry = F.struct("column", "metric", "value", "text")
    return rows.agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("profile"))


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


