"""Points on the globe: checks, lookups, distances, extents and density grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import haversine_km, missing, name, present, require
from quarry.operators.windows import bin_edges, bin_number


def geo_validate(df: DataFrame, lat: str, lon: str, drop_invalid: bool = False) -> DataFrame:
    """Rows with coordinates out of range, or the other rows with ``drop_invalid``; missing is not invalid."""
    require(df, lat, lon)
    bad = F.coalesce(F.abs(name(lat)) > 90, F.lit(False)) | F.coalesce(F.abs(name(lon)) > 180, F.lit(False))
    return df.filter(~bad if drop_invalid else bad)


def geocode(df: DataFrame, addr: str, lookup: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Coordinates by exact address; the lookup has address, lat, lon. Repeated addresses: its last line wins (``line`` column), else the largest pair."""
    require(df, addr)
    require(lookup, "address", "lat", "lon")
    at = F.struct("lat", "lon")
    known = lookup.groupBy(F.col("address").alias("_address")).agg((F.max_by(at, "line") if "line" in lookup.columns else F.max(at)).alias("_at"))
    return df.join(known, name(addr) == F.col("_address"), "left").select(
        *[name(c) for c in df.columns if c not in (lat, lon)], F.col("_at.lat").alias(lat), F.col("_at.lon").alias(lon))


def reverse_geocode(df: DataFrame, lat: str, lon: str, lookup: DataFrame, out: str = "address") -> DataFrame:
    """Address by exact coordinates. Repeated coordinates: the last line of the lookup wins (``line`` column), else the largest."""
    require(df, lat, lon)
    require(lookup, "address", "lat", "lon")
    latest = F.max_by("address", "line") if "line" in lookup.columns else F.max("address")
    known = lookup.groupBy(F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon")).agg(latest.alias("_address"))
    same = (name(lat).cast("double") == F.col("_lat")) & (name(lon).cast("double") == F.col("_lon"))
    return df.join(known, same, "left").select(*[name(c) for c in df.columns if c != out], F.col("_address").alias(out))


def geo_distance(df: DataFrame, lat: str, lon: str, target_lat: float, target_lon: float, out: str = "distance_km") -> DataFrame:
    require(df, lat, lon)
    return df.withColumn(out, haversine_km(name(lat), name(lon), F.lit(float(target_lat)), F.lit(float(target_lon))))


def centroid(df: DataFrame, lat: str, lon: str) -> DataFrame:
    require(df, lat, lon)
    return df.agg(F.avg(name(lat)).alias("lat"), F.avg(name(lon)).alias("lon"))


def bounds(df: DataFrame, lat: str, lon: str, buffer: float = 0.0) -> DataFrame:
    require(df, lat, lon)
    return df.agg(
        (F.min(name(lat)) - buffer).alias("min_lat"), (F.max(name(lat)) + buffer).alias("max_lat"),
        (F.min(name(lon)) - buffer).alias("min_lon"), (F.max(name(lon)) + buffer).alias("max_lon"))


def grid_counts(df: DataFrame, y: str, x: str, bins: int, y_out: str, x_out: str) -> DataFrame:
    """Counts per cell of an equal-width grid over the rows that have both values; empty cells are left out."""
    require(df, y, x)
    rows = present(df, y, x)
    edges = bin_edges(rows, [y, x], bins)
    return (
        rows.select(bin_number(name(y).cast("double"), edges[y][0]).alias(y_out),
                    bin_number(name(x).cast("double"), edges[x][0]).alias(x_out))
        .groupBy(y_out, x_out).agg(F.count(F.lit(1)).alias("n"))
    )


def geo_heatmap(df: DataFrame, lat: str, lon: str, bins: int = 20) -> DataFrame:
    return grid_counts(df, lat, lon, bins, "lat_bin", "lon_bin")
