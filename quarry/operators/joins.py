"""Joins that equal keys alone cannot express, without comparing every row with every other.

Range conditions meet through an index of the number line: cut points sampled from the data part it into buckets, and the
buckets are the leaves of a binary tree. An interval is stored at the two leaves that hold its ends and at the few inner
nodes that together cover what lies between, so even one that spans everything has a few rows per level of the tree. A
point is looked up at its leaf and at the leaf's ancestors. A point and an interval that holds it meet at exactly one node,
so the join on nodes is an ordinary join on equal keys that gives each pair once. Only leaves can bring pairs together
that do not belong to each other; the condition itself is checked on every pair. So leaves are narrow where intervals are:
cut points are taken finely, and the tree begins at the level where pairs and rows together cost least.

Nodes where many points meet many intervals are split: both sides are dealt into parts, and every part of one side meets
every part of the other in a task of its own. Intervals meet points in blocks that are taken apart last, so pairs follow each
other block by block: both sides repeat within short distances, and a written result packs well.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import as_list, as_number, missing, name, require
from quarry.operators import ordered
from quarry.session import write_out

ROWS_PER_BUCKET = 20_000
PAIRS_PER_TASK = 20_000_000
ROWS_PER_PART = 50_000
MAX_BUCKETS = 20_000
ROWS_PER_LEAF = 32  # at the finest
PAIRS_PER_ROW = 60  # a row stored, shuffled and sorted takes as long as so many pairs compared
INTERVALS_PER_BLOCK = 128
MAX_TASKS = 2_000
LEVEL = 1 << 40  # a node is its level times this, plus its place on the level


def _line(df: DataFrame, col: str) -> Column:
    """A value to place a column by: numbers and times as doubles that keep their order, everything else as it is."""
    if isinstance(df.schema[col].dataType, (T.NumericType, T.BooleanType, T.DatetimeType)):
        return as_number(df, col)
    return name(col)


def _bucketed(df: DataFrame, outs: Sequence[str], cuts: str, kind: str, count: int) -> DataFrame:
    """Replace every value column in ``outs`` by the number of cut points at or below it.

    Each value is computed once and looked up once: conditions on the bucket must not be pushed below the search.
    """
    if not count:
        return df.withColumns({o: F.lit(0) for o in outs})
    if kind == "array<double>":
        shared = df.sparkSession.sparkContext.broadcast(np.array(json.loads(cuts), dtype=float))  # MAX_BUCKETS at most

        @F.pandas_udf(T.IntegerType())
        def place(value: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(shared.value, value.to_numpy(), side="right").astype("int32"))

        return df.withColumns({o: place.asNondeterministic()(o) for o in outs})
    points, kept = F.from_json(F.lit(cuts), kind), [c for c in df.columns if c not in outs]
    value = lambda o: f"{o}_value"
    found = df.select(*kept, *[F.col(o).alias(value(o)) for o in outs], *[F.lit(0).alias(o) for o in outs])
    for stride in (2 ** i for i in reversed(range(count.bit_length()))):
        reached = lambda o: F.col(o) + stride
        found = found.select(*kept, *map(value, outs), *[
            F.when((reached(o) <= count) & (F.col(value(o)) >= F.get(points, reached(o) - 1)), reached(o)).otherwise(F.col(o)).alias(o) for o in outs])
    return write_out(found.drop(*map(value, outs)))


def _nodes(first: Column, last: Column, depth: int) -> Column:
    """Nodes of an interval from bucket ``first`` to ``last``: both leaves, and the largest nodes that cover those between."""
    found = [first.cast("long"), F.when(last > first, last.cast("long"))]
    for level in range(depth):
        size = 1 << level
        low, high = F.floor((first + size) / size), F.floor(last / size)  # nodes low … high - 1 lie wholly between
        found += [F.when((low < high) & (low % 2 == 1), F.lit(level * LEVEL) + low), F.when((low < high) & (high % 2 == 1), F.lit(level * LEVEL) + high - 1)]
    return F.array_compact(F.array(*found))


def _base_level(spans: Sequence[tuple[int, int]], points: int, buckets: int, groups: int, most: int) -> int:
    """The level, ``most`` at the highest, whose nodes serve best as leaves; ``spans``: (bits, n) for n intervals over 2 ** bits buckets at most.

    Finer leaves bring fewer pairs together that do not belong to each other, and store points and intervals more often.
    """
    def cost(level: int) -> float:
        leaf, pairs, rows, levels = points / buckets / groups * 2 ** level, 0.0, 0.0, 1
        for bits, n in spans:
            wide = 0.75 * 2 ** (bits - level) if bits else 0.0
            pairs += n * min(2.0, 1 + wide) * leaf
            rows += n * (min(2.0, 1 + wide) + math.log2(max(1.0, wide)))
            levels = max(levels, bits - level)
        return pairs + PAIRS_PER_ROW * (rows + points * levels)

    return min(range(most + 1), key=cost)


def _split(points: DataFrame, intervals: DataFrame, keys: Sequence[str], pairs_per_task: int, rows_per_part: int) -> tuple[DataFrame, int]:
    """(keys…, parts_a, parts_b) of the nodes that one task should not have to itself, from a written table; and how many tasks all pairs fill."""
    a = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("a"))
    b = intervals.groupBy(*keys).agg(F.count(F.lit(1)).alias("b"))
    edge = max(1, min(rows_per_part, math.isqrt(pairs_per_task)))
    parts = lambda n: F.ceil(F.col(n) / edge).cast("int")
    both, pairs = write_out(a.join(b, list(keys))), F.col("a").cast("double") * F.col("b")
    filled = both.agg(F.sum(pairs)).first()[0] or 0
    large = (pairs > pairs_per_task) | (F.col("a") > rows_per_part) | (F.col("b") > 4 * edge)
    return both.filter(large).select(*keys, parts("a").alias("parts_a"), parts("b").alias("parts_b")), math.ceil(filled / pairs_per_task)


def _pairs(points: DataFrame, intervals: DataFrame, point: str, low: str | None, high: str | None, on: Sequence[str], closed: str,
           rows_per_bucket: int, pairs_per_task: int, rows_per_part: int) -> DataFrame:
    """(a, b): the whole rows, as structs, of every point and interval that belong together."""
    tag = uuid.uuid4().hex[:8]
    points = points.filter(~missing(points, point))
    for end in (low, high):
        if end is not None:
            intervals = intervals.filter(~missing(intervals, end))
    above = {"both": ">=", "left": ">=", "right": ">", "neither": ">"}[closed]
    below = {"both": "<=", "left": "<", "right": "<=", "neither": "<"}[closed]
    rows, finest = points.count(), rows_per_bucket
    groups = max(1, points.agg(F.approx_count_distinct(F.struct(*map(name, on)))).first()[0]) if on else 1  # rows of different groups never meet
    if points.select(_line(points, point)).dtypes[0][1] == "double" and rows * intervals.count() / groups > pairs_per_task:
        finest = max(1, min(rows_per_bucket, ROWS_PER_LEAF))
    cuts, kind, count = ordered._cut_points(points, _line(points, point), finest, MAX_BUCKETS)
    ends = {out: _line(intervals, end).alias(out) for out, end in (("first", low), ("last", high)) if end is not None}
    node, keys = f"node_{tag}", [f"node_{tag}", *[f"on{i}_{tag}" for i in range(len(on))]]
    equal = [name(c).alias(k) for c, k in zip(on, keys[1:])]
    scan = F.monotonically_increasing_id().alias("scan")  # tells equal rows apart; taken before any shuffle, so a task run again deals alike
    b = _bucketed(intervals.select(F.struct(*map(name, intervals.columns)).alias("b"), scan, *equal, *ends.values()), list(ends), cuts, kind, count)
    b = b.withColumns({out: F.lit(open_) for out, open_ in (("first", 0), ("last", count)) if out not in ends}).filter(F.col("first") <= F.col("last"))
    base, highest, reach = 0, count.bit_length(), None
    if finest < rows_per_bucket and count:
        bits = F.when(F.col("last") > F.col("first"), F.floor(F.log2(F.col("last") - F.col("first"))) + 1).otherwise(0).cast("int")
        found = b.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"), F.max("last").alias("last")).collect()  # a few lengths
        spans, reach = [(r["bits"], r["n"]) for r in found], (min((r["first"] for r in found), default=0), max((r["last"] for r in found), default=-1))
        base = _base_level(spans, rows, count + 1, groups, max(0, min(count.bit_length(), math.floor(math.log2(rows_per_bucket * (count + 1) / rows)))))
        highest = max((bits for bits, _ in spans), default=0)  # no node is larger than the longest interval
    depth = max(1, min((count >> base).bit_length(), highest - base + 1))
    leaf = lambda bucket: F.shiftright(bucket, base) if base else F.col(bucket)
    b = b.select("b", "scan", *keys[1:], F.explode(_nodes(leaf("first"), leaf("last"), depth)).alias(node))
    used = sorted(r[0] for r in b.select(F.floor(F.col(node) / LEVEL).cast("int").alias("level")).distinct().collect())  # a few levels
    a = _bucketed(points.select(F.struct(*map(name, points.columns)).alias("a"), scan, *equal, _line(points, point).alias("leaf")), ["leaf"], cuts, kind, count)
    if reach:  # points beyond all intervals need not be shuffled
        a = a.filter(F.col("leaf").between(*reach))
    a = a.withColumn("leaf", leaf("leaf").cast("long")).select("a", "scan", *keys[1:], F.explode(F.array(*[F.lit(v * LEVEL) + F.shiftright("leaf", v) for v in used] or [F.lit(-1).cast("long")])).alias(node))
    for k in keys[1:]:
        a, b = a.filter(F.col(k).isNotNull()), b.filter(F.col(k).isNotNull())
    hot, filled = _split(a.select(*keys), b.select(*keys), keys, pairs_per_task, rows_per_part)
    if hot.isEmpty():
        left, right = a.drop("scan"), b.drop("scan")
    else:
        hot = F.broadcast(hot) if hot.count() <= MAX_BUCKETS else hot
        deal = lambda side, own, other: (
            side.join(hot, keys, "left").fillna(1, ["parts_a", "parts_b"])
            .withColumn(own, F.pmod(F.xxhash64("scan"), F.col(f"parts_{own}")).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"parts_{other}") - 1))).drop("parts_a", "parts_b"))
        names = {"a": f"part_a_{tag}", "b": f"part_b_{tag}"}
        left = deal(a.withColumnRenamed("a", "row"), "a", "b").withColumnsRenamed({"a": names["a"], "b": names["b"], "row": "a"}).drop("scan")
        right = deal(b.withColumnRenamed("b", "row"), "b", "a").withColumnsRenamed({"a": names["a"], "b": names["b"], "row": "b"}).drop("scan")
        keys = [*keys, *names.values()]
    if filled <= 1:
        met = left.join(right, keys)
    else:  # tasks by the number of pairs, as few rows make many
        tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(filled, MAX_TASKS))
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
        blocks = right.groupBy(*keys).agg(F.collect_list("b").alias("all"))  # as many as four parts hold at most
        starts = F.sequence(F.lit(1), F.size("all"), F.lit(INTERVALS_PER_BLOCK))
        blocks = blocks.select(*keys, F.explode(F.transform(starts, lambda at: F.slice("all", at, INTERVALS_PER_BLOCK))).alias("block"))
        met = blocks.join(left, keys).select("a", F.explode("block").alias("b"))
    holds = F.lit(True)
    if low is not None:
        holds &= F.col("a")[point] >= F.col("b")[low] if above == ">=" else F.col("a")[point] > F.col("b")[low]
    if high is not None:
        holds &= F.col("a")[point] <= F.col("b")[high] if below == "<=" else F.col("a")[point] < F.col("b")[high]
    return met.filter(holds).select("a", "b")


def _alike(points: DataFrame, point: str, intervals: DataFrame, low: str | None, high: str | None) -> bool:
    """Whether points and ends are of one type, all numbers, or all times, so that the least and the largest of them decide comparisons."""
    kinds = [points.schema[point].dataType, *[intervals.schema[e].dataType for e in (low, high) if e is not None]]
    return len(set(kinds)) == 1 or any(all(isinstance(k, family) for k in kinds) for family in (T.NumericType, T.DatetimeType))


def _covered(points: DataFrame, intervals: DataFrame, point: str, low: str | None, high: str | None, on: Sequence[str], closed: str) -> tuple[DataFrame, list[str]]:
    """The distinct (on…, point) that some interval holds, and the names these have; no pairs are made.

    A value is held when the highest end of all intervals that begin at or before it lies at or behind it. With one side open
    a single end per group decides. Otherwise beginnings and points are laid out in order and cut into ranges, each with a
    running highest end, to which the highest one of the earlier ranges is added.
    """
    tag = uuid.uuid4().hex[:8]
    keys, at, reach = [f"on{i}_{tag}" for i in range(len(on))], f"at_{tag}", f"reach_{tag}"
    points = points.filter(~missing(points, point))
    for end in (low, high):
        if end is not None:
            intervals = intervals.filter(~missing(intervals, end))
    for c in on:
        points, intervals = points.filter(name(c).isNotNull()), intervals.filter(name(c).isNotNull())
    equal = [name(c).alias(k) for c, k in zip(on, keys)]
    asked = points.select(*equal, name(point).alias(at)).distinct()
    from_low = (lambda p, e: p >= e) if closed in ("both", "left") else (lambda p, e: p > e)
    to_high = (lambda p, e: p <= e) if closed in ("both", "right") else (lambda p, e: p < e)
    if low is None or high is None:
        least = F.min(name(low)) if high is None else F.max(name(high))
        far = intervals.groupBy(*equal).agg(least.alias(reach)) if on else F.broadcast(intervals.agg(least.alias(reach)))
        both = asked.join(far, keys) if on else asked.crossJoin(far)
        return both.filter((from_low if high is None else to_high)(F.col(at), F.col(reach))).select(*keys, at), [*keys, at]
    first = closed in ("both", "left")  # beginnings come before points of the same value, or after them
    starts = intervals.groupBy(*equal, name(low).alias(at)).agg(F.max(name(high)).alias(reach)).withColumn("asked", F.lit(not first))
    waiting = asked.withColumn(reach, F.lit(None).cast(starts.schema[reach].dataType)).withColumn("asked", F.lit(first))
    line = write_out(starts.unionByName(waiting))
    key = ordered._order_key(line, [*keys, at])
    cuts, kind, count = ordered._cut_points(line, key, ordered.ROWS_PER_RANGE)
    ranged = ordered._with_range(line, key, cuts, kind, count) if count else line.withColumn("_range", F.lit(0))
    upto = Window.partitionBy(*keys, "_range").orderBy(at, "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept, top = ranged.withColumn("_here", F.max(reach).over(upto)), F.col("_here")
    if count:
        earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        tops = ranged.groupBy(*keys, "_range").agg(F.max(reach).alias("_top")).select(*keys, "_range", F.max("_top").over(earlier).alias("_before"))
        swept, top = swept.join(tops, [*keys, "_range"]), F.greatest("_here", "_before")
    return swept.filter((F.col("asked") == first) & to_high(F.col(at), top)).select(*keys, at), [*keys, at]


def _columns(a: DataFrame, b: DataFrame, suffix: str) -> list[tuple[str, str]]:
    """(column of ``b``, its name in the result): ``suffix`` is added while the name is taken."""
    taken, found = set(a.columns), []
    for c in b.columns:
        out = c
        while out in taken:
            out += suffix
        taken.add(out)
        found.append((c, out))
    return found


def interval_join(points: DataFrame, intervals: DataFrame, point: str, low: str | None, high: str | None, how: str = "inner", on: str | Sequence[str] | None = None,
                  closed: str = "both", suffix: str = "_right", rows_per_bucket: int = ROWS_PER_BUCKET, pairs_per_task: int = PAIRS_PER_TASK,
                  rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Rows of ``points`` with the rows of ``intervals`` whose ``low`` to ``high`` holds their ``point``.

    ``low`` or ``high`` None leaves that side open without end; ``closed`` says which ends belong to the interval (both, left,
    right, neither). ``how`` is inner, left (points without an interval stay, with nulls), semi or anti (points with or
    without an interval, each once). ``on`` names columns that must be equal as well. Missing points and ends match nothing,
    an interval whose ends are the wrong way round holds nothing. Columns of ``intervals`` whose names are taken get
    ``suffix``. ``points`` is scanned several times: pass a table, not a long computation.
    """
    on = as_list(on)
    require(points, point, *on)
    require(intervals, low, high, *on)
    if how not in ("inner", "left", "semi", "anti"):
        raise ValueError("how must be inner, left, semi or anti")
    if closed not in ("both", "left", "right", "neither"):
        raise ValueError("closed must be both, left, right or neither")
    if low is None and high is None:
        raise ValueError("one of low and high must be given")
    limits = (rows_per_bucket, pairs_per_task, rows_per_part)
    outs = _columns(points, intervals, suffix)
    if how == "inner":
        met = _pairs(points, intervals, point, low, high, on, closed, *limits)
        return met.select(*[F.col("a")[c].alias(c) for c in points.columns], *[F.col("b")[c].alias(o) for c, o in outs])
    if not _alike(points, point, intervals, low, high):  # ends of another kind than the points have no order in common with them
        row = f"row_{uuid.uuid4().hex[:8]}"
        held = write_out(points.withColumn(row, F.monotonically_increasing_id()))
        slim = held.select(row, *{c: name(c) for c in [point, *on]}.values())
        ends = intervals.select(*{c: name(c) for c in [low, high, *on] if c is not None}.values()).distinct()
        met = _pairs(slim, ends, point, low, high, on, closed, *limits).select(F.col("a")[row].alias(row)).distinct()
        lone = lambda kind: held.join(met, row, kind).drop(row)
    else:
        met, same = _covered(points, intervals, point, low, high, on, closed)
        lone = lambda kind: points.join(met, reduce(lambda x, y: x & y, [name(c) == F.col(k) for c, k in zip([*on, point], same)]), kind)
    if how != "left":
        return lone(f"left_{how}")
    # the pairs go straight to the result; only points without one are looked up
    empty = [F.lit(None).cast(intervals.schema[c].dataType).alias(o) for c, o in outs]
    return interval_join(points, intervals, point, low, high, "inner", on, closed, suffix, *limits).unionAll(lone("left_anti").select(*map(name, points.columns), *empty))


def band_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, below: float, above: float, how: str = "inner", on: str | Sequence[str] | None = None,
              suffix: str = "_right", **limits: int) -> DataFrame:
    """Rows of ``left`` with the rows of ``right`` whose value lies from ``below`` less to ``above`` more than their own, ends included.

    Everything else is as in ``interval_join``; ``right`` keeps its own columns only.
    """
    require(right, right_on)
    tag = uuid.uuid4().hex[:8]
    low, high = f"low_{tag}", f"high_{tag}"
    # left - below <= right <= left + above says: left lies from right - above to right + below
    wide = right.withColumn(low, name(right_on) - F.lit(above)).withColumn(high, name(right_on) + F.lit(below))
    return interval_join(left, wide, left_on, low, high, how, on, "both", suffix, **limits).drop(low, high)


def overlap_join(a: DataFrame, b: DataFrame, low: str, high: str, on: str | Sequence[str] | None = None, suffix: str = "_right", **limits: int) -> DataFrame:
    """Pairs of rows whose closed intervals ``low`` to ``high`` overlap, columns named alike in both tables; ``b``'s get ``suffix``.

    Of two overlapping intervals one begins inside the other: at or after its start, or strictly after it.
    """
    require(a, low, high)
    require(b, low, high)
    valid = lambda df: df.filter(name(low) <= name(high))
    a, b = valid(a), valid(b)
    outs = _columns(a, b, suffix)
    later = interval_join(b, a, low, low, high, "inner", on, "both", "_left_of", **limits)
    back = [(c, o) for c, o in _columns(b, a, "_left_of")]
    one = later.select(*[name(o).alias(c) for c, o in back], *[name(c).alias(o) for c, o in outs])
    two = interval_join(a, b, low, low, high, "inner", on, "right", suffix, **limits)
    return one.unionByName(two)


def not_in(df: DataFrame, col: str, other: DataFrame, other_col: str) -> DataFrame:
    """Rows for which ``col NOT IN (SELECT other_col …)`` is true.

    SQL's rule for nulls: an empty list keeps every row, a list with a null none, and a null is never known not to be in a list.
    Two counts decide between these cases, then an ordinary anti join does the rest; nothing is broadcast by force.
    """
    require(df, col)
    require(other, other_col)
    tag = f"listed_{uuid.uuid4().hex[:8]}"
    listed = other.select(name(other_col).alias(tag))
    known = listed.agg(F.count(F.lit(1)), F.count(tag)).first()
    if not known[0]:
        return df
    if known[0] > known[1]:
        return df.limit(0)
    return df.filter(name(col).isNotNull()).join(listed.distinct(), name(col) == F.col(tag), "left_anti")
