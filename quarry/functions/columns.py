"""Column checks and small expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_RADIUS_KM = 6371.0


def as_list(cols: str | Iterable[str] | None) -> list[str]:
    if cols is None:
        return []
    return [c.strip() for c in cols.split(",")] if isinstance(cols, str) else list(cols)


def require(df: DataFrame, *cols: str | None) -> None:
    """Unknown columns fail on the driver, before any job runs."""
    missing = [c for c in cols if c is not None and c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}; have {', '.join(df.columns)}")


def is_numeric(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.NumericType)


def require_numeric(df: DataFrame, *cols: str) -> None:
    require(df, *cols)
    for c in cols:
        if not is_numeric(df, c):
            raise ValueError(f"column '{c}' is not numeric")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_numeric(df, c)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def name(col: str) -> Column:
    """Column by its plain name, dots and blanks included."""
    return F.col(f"`{col.replace('`', '``')}`")


def missing(df: DataFrame, col: str) -> Column:
    """Null, or NaN for floating point columns."""
    c = name(col)
    if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(df: DataFrame, *cols: str) -> DataFrame:
    """Rows with a value in every one of ``cols``."""
    for c in cols:
        df = df.filter(~missing(df, c))
    return df


def long_form(df: DataFrame, values: Sequence[str], keep: Sequence[str] = (), as_type: str = "double",
              column: str = "column", value: str = "value") -> DataFrame:
    """One row per (kept columns, column name, value), missing values left out.

    A single scan: each row is expanded in place, nothing is shuffled.
    """
    pairs = F.array(*[
        F.struct(F.lit(c).alias(column), F.when(~missing(df, c), name(c)).cast(as_type).alias(value))
        for c in values
    ])
    return (
        df.select(*[name(k) for k in keep], F.explode(pairs).alias("_pair"))
        .select(*[name(k) for k in keep], F.col(f"_pair.{column}"), F.col(f"_pair.{value}"))
        .filter(F.col(value).isNotNull())
    )


def as_number(df: DataFrame, col: str) -> Column:
    """Numbers, dates and times as a double that keeps their order (times in microseconds)."""
    c, kind = name(col), df.schema[col].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):  # from the clock reading, whatever the session time zone
        seconds = F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
        return (seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    return c.cast("double")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres, atan2 form."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((p2 - p1) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    a = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))
