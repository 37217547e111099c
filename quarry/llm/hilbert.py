"""Sharding along a Hilbert curve.

Several metadata columns are quantised to a few bits each, the cell's index on the Hilbert curve is the sort key, and
the sorted rows are cut into runs. Neighbours on the curve are neighbours in every dimension, so each run covers a
small box and files can be skipped by their minima and maxima in any of the columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import name, require
from quarry.operators.ordered import number_rows, running_total
from quarry.llm.common import fresh
from quarry.session import write_out

LAWS = ("rows", "bytes")
ROWS_PER_RANGE = 5_000
SMALL_LEVELS = 10_000  # distinct values of a text dimension that may be broadcast


def curve_index(axes: Sequence[Column], bits: int) -> Column:
    """Hilbert index of a cell given by one integer below ``2 ** bits`` per axis (Skilling's transposition, 2004)."""
    n = len(axes)
    if n < 2 or bits < 1 or n * bits > 62:
        raise ValueError("the curve needs two axes or more and at most 62 bits")
    steps = [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)]

    def turn(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        low, first, here = q - 1, F.get(x, F.lit(0)), F.get(x, i)
        swap = first.bitwiseXOR(here).bitwiseAND(low)
        flip = here.bitwiseAND(q) != 0
        return F.transform(x, lambda v, j: F.when(flip & (j == 0), v.bitwiseXOR(low))
                           .when(~flip & ((j == 0) | (j == i)), v.bitwiseXOR(swap)).otherwise(v))

    def gray(a: Column, v: Column) -> Column:
        coded = a["last"].bitwiseXOR(v)
        return F.struct(coded.alias("last"), F.concat(a["out"], F.array(coded)).alias("out"))

    def interleave(coded: Column, twist: Column) -> Column:
        def bit(h: Column, p: Column) -> Column:
            return h * 2 + F.when(F.get(coded["out"], p["i"]).bitwiseXOR(twist).bitwiseAND(p["q"]) != 0, 1).otherwise(0)

        places = [F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)]
        return F.aggregate(F.array(*places), F.lit(0).cast("long"), bit)

    none = F.array().cast("array<long>")
    start = F.struct(F.lit(0).cast("long").alias("last"), none.alias("out"))
    todo = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q, i in steps])
    marks = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])
    x = F.array(*[a.cast("long") for a in axes])
    if not steps:  # one bit an axis: the Gray code alone
        return F.aggregate(x, start, gray, lambda coded: interleave(coded, F.lit(0).cast("long")))
    # Each stage hands its value to the next as a bound variable, so nothing is computed twice.
    return F.aggregate(todo, x, turn, lambda y: F.aggregate(
        y, start, gray, lambda coded: F.aggregate(
            marks, F.lit(0).cast("long"),
            lambda t, q: F.when(coded["last"].bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
            lambda twist: interleave(coded, twist))))


def quantised(df: DataFrame, dims: Sequence[str], bits: int) -> DataFrame:
    """Add ``_q0``, ``_q1``, …: a number below ``2 ** bits`` per dimension, monotone in its value.

    Numbers use the bit length of their size; texts the share of all rows whose value sorts earlier, so that frequent
    values get cells of their own. Nulls take cell 0.
    """
    top = (1 << bits) - 1
    for k, d in enumerate(dims):
        if isinstance(df.schema[d].dataType, T.NumericType):
            per_octave = max(1, (top + 1) // 32)
            size = F.greatest(name(d).cast("double"), F.lit(0.0))
            df = df.withColumn(f"_q{k}", F.coalesce(F.least(F.lit(top), F.floor(F.log2(size + 1) * per_octave)).cast("int"), F.lit(0)))
            continue
        counts = write_out(df.groupBy(name(d).alias(f"_v{k}")).agg(F.count(F.lit(1)).alias("n")).filter(F.col(f"_v{k}").isNotNull()))
        before = running_total(counts, {"upto": F.col("n")}, [f"_v{k}"], rows_per_range=ROWS_PER_RANGE)
        level = F.floor((F.col("upto") - F.col("n")) * (top + 1) / F.col("upto_all")).cast("int").alias(f"_q{k}")
        levels = write_out(before.select(f"_v{k}", level))
        if levels.count() <= SMALL_LEVELS:
            levels = F.broadcast(levels)
        df = df.join(levels, name(d) == F.col(f"_v{k}"), "left").drop(f"_v{k}").withColumn(f"_q{k}", F.coalesce(f"_q{k}", F.lit(0)))
    return df


def shard(docs: DataFrame, shards: int = 16, dims: Sequence[str] = ("lang", "source", "n_chars"), law: str = "rows", bits: int = 6,
          key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its key, ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``, ``curve``, the quantised
    cell ``cell``, ``law``, ``shard`` and ``slot``, its gapless place within the shard.

    ``law``: 'rows' cuts runs whose row counts differ by one at most, 'bytes' runs of near equal size. Rows are ordered by
    curve index, key, checksum and size; a null key sorts last and equal rows take any order among themselves.
    A null text counts as empty, a null dimension takes cell 0, an empty table gives no rows. Columns beside those named are ignored.
    """
    if law not in LAWS:
        raise ValueError(f"law is one of {', '.join(LAWS)}")
    require(docs, key, text, *dims)
    body = F.coalesce(name(text).cast("string"), F.lit(""))
    slim = docs.select(name(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
                       *[name(d).alias(f"_d{i}") for i, d in enumerate(dims)])
    names = [f"_d{i}" for i in range(len(dims))]
    celled = quantised(write_out(slim), names, bits)
    axes = [F.col(f"_q{i}") for i in range(len(dims))]
    placed = write_out(celled.select("doc_id", "size", "text_crc32", F.array(*axes).alias("cell"), curve_index(axes, bits).alias("curve")))
    order = ["curve", "doc_id", "text_crc32", "size"]
    ranked = number_rows(placed, order, out="rank", rows_per_range=ROWS_PER_RANGE)
    if law == "rows":
        total = max(placed.count(), 1)
        at = F.expr(f"cast((rank * {shards}L) div {total}L as int)")
        out = ranked.withColumn("shard", at).withColumn("slot", F.col("rank") - F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L"))
    else:
        sized = running_total(write_out(ranked), {"upto": F.col("size")}, ["rank"], rows_per_range=ROWS_PER_RANGE)
        out = write_out(sized.withColumn("shard", F.expr(f"cast(((upto - size) * {shards}L) div upto_all as int)")))
        firsts = out.groupBy("shard").agg(F.min("rank").alias("_first"))  # one row per shard
        out = out.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("rank") - F.col("_first"))
    return out.select("doc_id", "size", "text_crc32", "curve", "cell", F.lit(law).alias("law"), "shard", "slot")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, dims: Sequence[str] = ("lang", "source", "n_chars"), key: str = "doc_id") -> DataFrame:
    """Write ``docs`` with unique keys as one folder per shard in slot order; returns the manifest: rows, bytes, least and greatest value of every dimension per shard.

    The files carry ``shard``, ``slot`` and ``size``; a table that has columns of these names is an error. Rows with a null key
    are not placed by key and stay out. A shard is written by as many tasks as its rows ask for, each a run of slots.
    """
    taken = [c for c in docs.columns if c.lower() in ("shard", "slot", "size")]
    if taken:
        raise ValueError(f"rename {', '.join(taken)} first: the shards' files have columns of these names")
    id_ = fresh("id")
    own = placed.select(F.col("doc_id").alias(id_), "shard", "slot", "size")
    joined = docs.join(own, name(key) == F.col(id_)).drop(id_)
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    stored = docs.sparkSession.read.parquet(path)
    return stored.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"),
                                       *[f(name(d)).alias(f"{w}_{d}") for d in dims for w, f in (("min", F.min), ("max", F.max))])
