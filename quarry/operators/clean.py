"""Imputation, outliers, replacements, lookups and trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.columns import is_numeric, missing, name, present, require, require_numeric
from quarry.functions.patterns import java_pattern, java_replacement, strip_whitespace
from quarry.operators import ordered


def _filled(df: DataFrame, col: str):
    return F.when(~missing(df, col), name(col))


def impute_mode(df: DataFrame, col: str) -> DataFrame:
    """Fill missing values with the most frequent one, the smallest on a tie."""
    require(df, col)
    # Counting by value spreads over tasks; a single mode() aggregate would hold every value at once.
    best = present(df, col).groupBy(name(col).alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").limit(1).first()
    if best is None:
        return df
    return df.withColumn(col, F.coalesce(_filled(df, col), F.lit(best["v"]).cast(df.schema[col].dataType)))


def impute_group(df: DataFrame, target: str, group: str, std_max: float | None = None) -> DataFrame:
    """Fill missing values with the most frequent one of the row's group.

    With ``std_max`` nothing is filled, and an error raised, when any group spreads wider than that.
    """
    require(df, target, group)
    if std_max is not None and is_numeric(df, target):
        wide = (present(df, group).groupBy(name(group)).agg(F.stddev_samp(_filled(df, target)).alias("std"))
                .filter(F.col("std") > std_max).limit(5).collect())
        if wide:
            raise ValueError(f"groups exceed the standard deviation {std_max}: {[r[0] for r in wide]}")
    modes = (
        present(df, group, target).groupBy(name(group).alias("_g"), name(target).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("_g").agg(F.min_by("_v", F.struct(-F.col("_n"), F.col("_v"))).alias("_mode"))
    )
    filled = F.coalesce(_filled(df, target), F.col("_mode"))
    return df.join(modes, name(group) == F.col("_g"), "left").select(
        *[filled.alias(c) if c == target else name(c) for c in df.columns])


def regex_replace(df: DataFrame, col: str, pattern: str, repl: str) -> DataFrame:
    r"""Regex substitution with back-references (``\1``)."""
    require(df, col)
    return df.withColumn(col, F.regexp_replace(name(col).cast("string"), java_pattern(pattern), java_replacement(repl)))


def drop_outliers(df: DataFrame, col: str, sigma: float = 3.0, method: str = "zscore") -> DataFrame:
    """Values far from the rest become null: beyond ``sigma`` standard deviations, or 1.5 interquartile ranges."""
    require_numeric(df, col)
    x = _filled(df, col)
    if method == "iqr":
        q = {r["p"]: r["quantile"] for r in ordered.quantiles(df, [col], [0.25, 0.75]).collect()}
        if not q:
            return df
        reach = 1.5 * (q[0.75] - q[0.25])
        return df.withColumn(col, F.when((x >= q[0.25] - reach) & (x <= q[0.75] + reach), x))
    if method != "zscore":
        raise ValueError("method must be zscore or iqr")
    mean, std = df.agg(F.avg(x), F.stddev_samp(x)).first()
    if not std:
        return df
    return df.withColumn(col, F.when(F.abs(x - mean) / std <= sigma, x))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """A two-column CSV without header as (key, value); the last line wins for a repeated key."""
    lines = with_line_order(spark.read.csv(path, schema="key string, value string"))
    return lines.groupBy("key").agg(F.max_by("value", "line").alias("value"))


def with_line_order(df: DataFrame) -> DataFrame:
    """Rows of a file source with ``line``, which sorts like their place in the file."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    return df.select("*", place.alias("line"))


def map_values(df: DataFrame, col: str, mapping: DataFrame | dict) -> DataFrame:
    """Replace whole values by exact lookup; others stay. ``mapping`` has one row per key."""
    require(df, col)
    if isinstance(mapping, dict):
        mapping = df.sparkSession.createDataFrame([(str(k), str(v)) for k, v in mapping.items()], "key string, value string")
    pairs = mapping.select(F.col("key").cast("string").alias("_key"), F.col("value").cast("string").alias("_value"))
    text = name(col).cast("string")
    # Which side is broadcast, if any, follows from the size statistics of the mapping.
    return df.join(pairs, text == F.col("_key"), "left").select(
        *[F.coalesce("_value", text).alias(c) if c == col else name(c) for c in df.columns])


def trim(df: DataFrame, col: str, side: str = "both") -> DataFrame:
    require(df, col)
    if df.schema[col].dataType.simpleString() != "string":
        return df
    return df.withColumn(col, strip_whitespace(name(col), side))
