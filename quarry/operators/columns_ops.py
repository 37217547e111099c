"""Changing columns: rename, drop, cast, JSON detection and flattening, rule checks."""

from __future__ import annotations

import re
import json
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import missing, name, require, text_columns


def rename_col(df: DataFrame, old: str, new: str, dry_run: bool = False) -> DataFrame | list[str]:
    require(df, old)
    if new in df.columns:
        raise ValueError(f"column '{new}' exists already")
    if dry_run:
        return [new if c == old else c for c in df.columns]
    return df.withColumnRenamed(old, new)


def drop_col(df: DataFrame, col: str) -> DataFrame:
    require(df, col)
    return df.drop(name(col))


def _converted(col: Column, to: str, strict: bool) -> Column:
    if to == "text":
        return col.cast("string")
    if to == "blob":
        return F.encode(col.cast("string"), "UTF-8")
    if to == "real":
        return col.cast("double") if strict else col.try_cast("double")
    # Whole numbers go through double so that '1.5' truncates; plain integers keep all their digits.
    direct = col.try_cast("long")
    through = (col.cast("double") if strict else col.try_cast("double"))
    return F.coalesce(direct, through.cast("long") if strict else through.try_cast("long"))


def cast_col(df: DataFrame, col: str, to: str, on_error: str = "fail") -> DataFrame:
    """Cast to integer, real, text or blob; bad values raise, become null, or leave the column as it is."""
    require(df, col)
    if to not in ("integer", "real", "text", "blob"):
        raise ValueError("type must be integer, real, text or blob")
    if on_error not in ("fail", "nullify", "ignore"):
        raise ValueError("on_error must be fail, nullify or ignore")
    if on_error == "ignore" and to in ("integer", "real"):
        bad = _converted(name(col), to, strict=False).isNull() & name(col).isNotNull()
        if df.filter(bad).limit(1).count():
            return df
    return df.withColumn(col, _converted(name(col), to, strict=on_error == "fail"))


@F.pandas_udf(T.IntegerType())
def json_depth(values: pd.Series) -> pd.Series:
    """Nesting depth of a JSON text: scalars 0, every container one more; null when it does not parse."""

    def depth(value: object) -> int:
        inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else None
        return 0 if inner is None else 1 + max(map(depth, inner), default=0)

    def of(text: str | None) -> int | None:
        try:
            return depth(json.loads(text))
        except (TypeError, ValueError):
            return None

    return values.map(of).astype("Int32")


def detect_json(df: DataFrame, depth: int | None = None, threshold: float = 0.1) -> DataFrame:
    """Text columns whose share of JSON values reaches the threshold, as (column, valid_share)."""
    texts = text_columns(df)
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, valid_share double")

    def valid(c: str) -> Column:
        parses = F.try_parse_json(name(c)).isNotNull()
        return parses if depth is None else parses & (F.coalesce(json_depth(name(c)), F.lit(depth + 1)) <= depth)

    shares = df.agg(*[F.avg(F.when(name(c).isNotNull(), valid(c).cast("int"))).alias(f"s{i}")
                      for i, c in enumerate(texts)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("valid_share"))
                     for i, c in enumerate(texts)])
    return shares.select(F.inline(rows)).filter(F.col("valid_share") >= threshold)


def _leaves(kind: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    found = []
    for field in kind.fields:
        here = (*path, field.name)
        found += _leaves(field.dataType, here) if isinstance(field.dataType, T.StructType) else [here]
    return found


def json_schema(df: DataFrame, col: str) -> T.StructType:
    """Schema of the JSON objects in a text column, from one aggregate over all rows."""
    merged = df.agg(F.schema_of_variant_agg(F.try_parse_json(name(col)))).first()[0]
    # Variant schemas print OBJECT<…> and VOID where DDL says STRUCT<…> and a type; only where a type stands, never in a name.
    spelled = {"OBJECT<": "STRUCT<", "VOID": "STRING"}
    ddl = re.sub(r"`(?:[^`]|``)*`|(^|: ?|ARRAY<)(OBJECT<|VOID(?=[,> ]|$))",
                 lambda m: m[0] if m[2] is None else m[1] + spelled[m[2]], merged or "OBJECT<>")
    if not ddl.startswith("STRUCT<"):
        raise ValueError(f"column '{col}' does not hold JSON objects")
    return df.sparkSession.range(0).select(F.from_json(F.lit("{}"), ddl).alias("s")).schema["s"].dataType


def flatten_json(df: DataFrame, col: str, prefix: str | None = None, sep: str = "_", drop_original: bool = False,
                 schema: T.StructType | None = None) -> DataFrame:
    """Nested JSON objects become columns; arrays stay values. Pass ``schema`` to save the discovery job."""
    require(df, col)
    schema = schema or json_schema(df, col)
    lead = f"{col}{sep}" if prefix is None else prefix
    parsed = df.withColumn("_json", F.from_json(name(col), schema))
    outs = [(lead + sep.join(path), path) for path in _leaves(schema)]
    clash = [o for o, _ in outs if o in df.columns]
    if clash:
        raise ValueError(f"flattened columns exist already: {', '.join(clash)}")
    kept = [name(c) for c in df.columns if not (drop_original and c == col)]
    values = []
    for out, path in outs:
        value = F.col("_json")
        for part in path:
            value = value.getField(part)
        values.append(value.alias(out))
    return parsed.select(*kept, *values)


def _rule_tests(df: DataFrame, col: str, rule: Mapping) -> dict[str, Column]:
    """Violation conditions of the row checks in one rule."""
    c, tests = name(col), {}
    if "min" in rule:
        tests["min"] = c < F.lit(rule["min"])
    if "max" in rule:
        tests["max"] = c > F.lit(rule["max"])
    if rule.get("not_null"):
        tests["not_null"] = missing(df, col)
    if "regex" in rule:
        tests["regex"] = ~c.cast("string").rlike(rule["regex"])
    if "in" in rule:
        tests["in"] = ~c.isin(list(rule["in"]))
    return tests


_TYPE_RULES = {"int": T.IntegralType, "float": (T.FractionalType,), "str": T.StringType}


def validate_schema(df: DataFrame, rules: Mapping[str, str | Mapping] | str) -> DataFrame:
    """Violated rules as (column, rule, detail, violations); all row checks run in one pass."""
    rules = json.loads(rules) if isinstance(rules, str) else rules
    found: list[tuple] = []
    tests: list[tuple[str, str, Column]] = []
    for col, rule in rules.items():
        if col not in df.columns:
            found.append((col, "missing", "missing column", None))
            continue
        rule = {"type": rule} if isinstance(rule, str) else rule
        kind = df.schema[col].dataType
        wanted = rule.get("type")
        if wanted in _TYPE_RULES and not isinstance(kind, _TYPE_RULES[wanted]):
            found.append((col, "type", f"expected {wanted}, found {kind.simpleString()}", None))
        tests += [(col, check, test) for check, test in _rule_tests(df, col, rule).items()]
    shape = "column string, rule string, detail string, violations long"
    errors = df.sparkSession.createDataFrame(found, shape)
    if not tests:
        return errors
    counted = df.agg(*[F.count_if(test).alias(f"v{i}") for i, (_, _, test) in enumerate(tests)])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), F.lit("row check").alias("detail"),
                 F.col(f"v{i}").alias("violations"))
        for i, (c, r, _) in enumerate(tests)
    ])
    return errors.unionByName(counted.select(F.inline(rows)).filter("violations > 0"))


def rule_flags(df: DataFrame, rules: Mapping[str, Mapping], out: str = "broken_rules") -> DataFrame:
    """Each row with the names of the row checks it breaks; works on streams."""
    flags = [
        F.when(test, F.lit(f"{col}:{check}"))
        for col, rule in rules.items() if col in df.columns
        for check, test in _rule_tests(df, col, rule).items()
    ]
    return df.withColumn(out, F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>"))
