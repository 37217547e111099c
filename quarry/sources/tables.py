"""Reading, writing and merging tables."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import name, require

FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet", ".orc": "orc"}


def infer_format(path: str) -> str:
    ending = os.path.splitext(path.rstrip("/"))[1].lower()
    if ending not in FORMATS:
        raise ValueError(f"cannot tell the format of '{path}'; pass fmt")
    return FORMATS[ending]


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None,
               multiline: bool = False) -> DataFrame:
    """Read CSV (with header, quotes doubled inside quotes), JSON (lines, or one array per file), Parquet or ORC.

    Give ``schema`` for large CSV and JSON: it saves the inference scan and allows column pruning. ``multiline`` lets
    quoted CSV cells hold line breaks; such files cannot be split among tasks.
    """
    fmt = fmt or infer_format(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None, quote='"', escape='"', multiLine=multiline)
    if fmt == "json":
        start = spark.read.text(path).filter(F.trim("value") != "").first()
        array = bool(start) and start["value"].lstrip().startswith("[")
        return reader.json(path, multiLine=array)
    return reader.format(fmt).load(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    if mode not in ("overwrite", "append", "errorifexists"):
        raise ValueError("mode must be overwrite, append or errorifexists")
    writer = df.write.mode(mode)
    (writer.options(header=True, quote='"', escape='"') if fmt == "csv" else writer).format(fmt).save(path)


def merge_append(target: DataFrame, source: DataFrame) -> DataFrame:
    return target.unionByName(source, allowMissingColumns=True)


def merge_replace(target: DataFrame, source: DataFrame) -> DataFrame:
    return source


def merge_ignore(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the source rows whose key the target does not have (null keys are equal); an empty key leaves the target as it is."""
    if not keys:
        return target
    require(target, *keys)
    require(source, *keys)
    known = target.select(*[name(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = [name(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return merge_append(target, source.join(known, same, "left_anti"))


def merge_tables(targets: Mapping[str, DataFrame], sources: Mapping[str, DataFrame], strategy: str = "append",
                 tables: Sequence[str] | None = None, keys: Mapping[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    """Merge table by table; names starting with an underscore are bookkeeping and stay out."""
    names = [t for t in sources if not t.startswith("_")]
    if tables is not None:
        unknown = [t for t in tables if t not in names]
        if unknown:
            raise ValueError(f"not in the source: {', '.join(unknown)}")
        names = list(tables)
    if strategy not in ("append", "replace", "ignore"):
        raise ValueError("strategy must be append, replace or ignore")
    merged = dict(targets)
    for t in names:
        if t not in targets:
            merged[t] = sources[t]
        elif strategy == "append":
            merged[t] = merge_append(targets[t], sources[t])
        elif strategy == "replace":
            merged[t] = merge_replace(targets[t], sources[t])
        else:
            merged[t] = merge_ignore(targets[t], sources[t], (keys or {}).get(t, ()))
    return merged


def merge_folders(spark: SparkSession, target_dir: str, source_dir: str, out_dir: str, tables: Sequence[str],
                  strategy: str = "append", keys: Mapping[str, Sequence[str]] | None = None) -> None:
    """Merge two folders of Parquet tables into a third one; the inputs are never overwritten."""
    def load(folder: str) -> dict[str, DataFrame]:
        found = {}
        for t in tables:
            try:
                found[t] = spark.read.parquet(f"{folder}/{t}.parquet")
            except AnalysisException:
                continue
        return found

    for t, df in merge_tables(load(target_dir), load(source_dir), strategy, tables, keys).items():
        write_table(df, f"{out_dir}/{t}.parquet")


def compact(spark: SparkSession, path: str, out: str, target_files: int, analyze_as: str | None = None) -> DataFrame:
    """Rewrite a Parquet table into ``target_files`` files; optionally register it and gather statistics."""
    df = spark.read.parquet(path).repartition(target_files)
    if analyze_as:
        df.write.mode("overwrite").option("path", out).saveAsTable(analyze_as)
        spark.sql(f"ANALYZE TABLE {analyze_as} COMPUTE STATISTICS FOR ALL COLUMNS")
        return spark.table(analyze_as)
    df.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def geojson_features(df: DataFrame, lat: str, lon: str, id_col: str | None = None,
                     properties: Sequence[str] = ()) -> DataFrame:
    """One GeoJSON point feature per row, as text; unknown property names are left out."""
    require(df, lat, lon)
    known = [p for p in properties if p in df.columns]
    point = F.struct(F.lit("Point").alias("type"), F.array(name(lon), name(lat)).alias("coordinates"))
    props = F.struct(*[name(p) for p in known]) if known else F.from_json(F.lit("{}"), "struct<>")
    parts = [F.lit("Feature").alias("type"), point.alias("geometry"), props.alias("properties")]
    if id_col and id_col in df.columns:
        parts.append(name(id_col).alias("id"))
    return df.select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("feature"))


def export_geojson(df: DataFrame, lat: str, lon: str, path: str, id_col: str | None = None,
                   properties: Sequence[str] = ()) -> None:
    """Newline-delimited GeoJSON, one part file per partition."""
    geojson_features(df, lat, lon, id_col, properties).write.mode("overwrite").text(path)
