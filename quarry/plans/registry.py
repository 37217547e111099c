"""Registered queries: a name, a function from tables to a DataFrame, and the same result in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The Parquet tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        ship(spark)

    def __getattr__(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def views(self, *tables: str) -> SparkSession:
        for t in tables:
            getattr(self, t).createOrReplaceTempView(t)
        return self.spark

    def scratch(self, ending: str = "") -> str:
        """A fresh path in the shared folder."""
        return scratch_path(self.spark, ending)


def query(key: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[Tables], DataFrame]) -> Callable:
        if key in QUERIES:
            raise ValueError(f"query '{key}' is registered twice")
        QUERIES[key] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLE[key] = sql
        return build

    return register


def rounded(df: DataFrame, digits: int = 6, *cols: str) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    wanted = cols or [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if c in wanted else F.col(f"`{c}`") for c in df.columns])


def coordinates(df: DataFrame, key: str) -> DataFrame:
    """Derived coordinates in range, spread over the globe."""
    k = F.col(key).cast("long")
    return df.withColumn("lat", F.pmod(k * 7919, F.lit(18001)).cast("double") / 100 - 90).withColumn(
        "lon", F.pmod(k * 104729, F.lit(36001)).cast("double") / 100 - 180)


def coordinates_sql(key: str) -> str:
    return (f"CAST((CAST({key} AS BIGINT) * 7919) % 18001 AS DOUBLE) / 100 - 90 AS lat, "
            f"CAST((CAST({key} AS BIGINT) * 104729) % 36001 AS DOUBLE) / 100 - 180 AS lon")
