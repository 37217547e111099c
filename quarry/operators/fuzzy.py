"""Grouping similar spellings: an exact similarity join, then greedy clusters decided in parallel.

Similarity is 100 · 2 · LCS / (length + length), where LCS is the longest common subsequence. From a
threshold of 87 on, two values that reach it must share one of their rarest character q-grams (prefix
filter), so only values with such a gram in common are compared; texts too short to differ by more than
two letters meet on what is left without a letter. Below it values meet through an index of segments
(``segments``). Clusters need no list of all pairs: short texts of one length that agree without a letter are
all similar, so what is left of them serves as their common key, and heads are found on keys.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import as_list, name, present, require
from quarry.operators import ordered, segments
from quarry.operators.clean import map_values
from quarry.session import write_out


ONE_TASK_EDGES = 500_000
FRONT_STEPS = 4_096  # the vertices in order, in so many steps; a row for each reaches the driver


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word style step per character of ``b``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & where.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([100.0 * (1.0 - (len(x) + len(y) - 2 * common_length(x, y)) / (len(x) + len(y))) if x or y else 100.0
                      for x, y in zip(a, b)], dtype="float64")


def _gram_plan(threshold: float) -> tuple[int, int]:
    """Gram length for a threshold, and up to which text length single characters are needed as well.

    A text of length n can differ from a similar one by at most n · 2(1-t)/t insertions and deletions,
    each of which spoils at most q grams. Where that could spoil all grams, single characters serve.
    """
    t = threshold / 100.0
    q = 3 if t >= 0.95 else 2 if t >= 0.87 else 1
    if q == 1:
        return 1, 0
    slack = 2 * (1 - t) / t
    edge = math.ceil(q / max(1e-9, 1 - q * slack)) + 2
    longest = max((n for n in range(0, edge + 1) if n - q + 1 <= q * math.floor(n * slack + 1e-9)), default=q - 1)
    return q, math.ceil(longest * (2 - t) / t)


def _signatures(words: DataFrame, q: int, threshold: float) -> DataFrame:
    """(id, size, gram, at): the rarest grams of every text, as many as guarantee a meeting."""
    t = threshold / 100.0
    size = F.length("word")
    grams = (
        words.withColumn("size", size)
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("size") - q + 1))))
        .withColumn("gram", F.substring(F.col("word"), F.col("at"), F.lit(q)))
    )
    # Repeated grams of one text are told apart by their count: "aa" the first time, the second time…
    listed = grams.groupBy("id", "size", "gram").agg(F.sort_array(F.collect_list("at")).alias("places"))
    listed = listed.select("id", "size", "gram", F.posexplode("places").alias("turn", "at"))
    listed = listed.withColumn("key", F.concat_ws("\u0001", F.lit(str(q)), "gram", F.col("turn").cast("string")))
    listed = write_out(listed)
    often = listed.groupBy("key").agg(F.count(F.lit(1)).alias("often"))
    ranked = listed.join(often, "key").groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("often", "key", "at"))).alias("grams"))
    total = F.size("grams")
    if q == 1:
        # the common part of similar texts has at least this many characters
        kept = total - F.ceil(F.col("size") * t / (2 - t) - 1e-9).cast("int") + 1
    else:
        kept = q * F.floor(F.col("size") * (2 * (1 - t) / t) + 1e-9).cast("int") + 1
    first = F.slice("grams", 1, F.greatest(F.lit(1), F.least(total, kept)))
    return ranked.select("id", "size", F.inline(first)).select("id", "size", "key", "at")


def _letter_masks(words: DataFrame) -> DataFrame:
    """(id, mask): 64 bits that stand for the letters of a text, repeats told apart.

    One insertion or deletion changes one letter of the bag, so at most one bit per edit differs.
    """
    letters = words.select("id", F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''")
    bags = letters.groupBy("id", "letter").agg(F.count(F.lit(1)).alias("n"))
    bits = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.col("n")), F.lit(0).cast("long"),
        lambda bag, turn: bag.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("letter", turn), F.lit(64)).cast("int"))))
    return bags.withColumn("bits", bits).groupBy("id").agg(F.bit_or("bits").alias("mask"))


def similar_pairs(words: DataFrame, threshold: float) -> DataFrame:
    """(u, v, score) with u < v for all pairs of (id, word) that reach the threshold; words are distinct."""
    if not 0 < threshold <= 100:
        raise ValueError("threshold must be above 0 and at most 100")
    t = threshold / 100.0
    q, short = _gram_plan(threshold)
    if q == 1:  # single characters tell too little apart
        return _verified(words, segments.candidates(words.join(_letter_masks(words), "id", "left").fillna(0, ["mask"]), threshold), threshold)
    brief = _brief(threshold)
    met = _one_letter_off(words.filter(F.length("word") <= brief))
    rest = _longer_pairs(words, threshold)
    return _verified(words, met if rest is None else met.unionByName(rest).distinct(), threshold)


def _brief(threshold: float) -> int:
    """Length of the longest text of which two may differ by two insertions and deletions at most."""
    t = threshold / 100.0
    return math.ceil(3 / (2 * (1 - t)) - 1e-6) - 1 if t < 1 else 0


def _longer_pairs(words: DataFrame, threshold: float) -> DataFrame | None:
    """(u, v), u < v: candidates of which one at least is no brief text, met through grams; None if all are brief."""
    t, brief = threshold / 100.0, _brief(threshold)
    q, short = _gram_plan(threshold)
    if not words.filter(F.length("word") > brief).take(1):
        return None
    signs = _signatures(words, q, threshold)
    if short:
        signs = signs.unionByName(_signatures(words.filter(F.length("word") <= short), 1, threshold))
    signs = write_out(signs.join(_letter_masks(words), "id"))
    a = signs.filter(F.col("size") > brief).select(F.col("id").alias("u"), F.col("size").alias("n"), "key", F.col("at").alias("i"), F.col("mask").alias("s"))
    b = signs.select(F.col("id").alias("v"), F.col("size").alias("m"), "key", F.col("at").alias("j"), F.col("mask").alias("t"))
    allowed = F.floor((1 - t) * (F.col("n") + F.col("m")) + 1e-9)  # insertions plus deletions
    shift = F.abs(F.col("i") - F.col("j"))
    meet = ((F.col("u") < F.col("v")) | (F.col("m") <= brief)) & (F.abs(F.col("n") - F.col("m")) <= allowed) & (F.bit_count(F.col("s").bitwiseXOR(F.col("t"))) <= allowed)
    close = shift <= allowed if not short else F.lit(True)
    # The letter test inside the join keeps texts apart that share a common gram only.
    return a.join(b, "key").filter(meet & close).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def _less(text: Column) -> Column:
    """The different texts that are left when ``text`` loses a letter."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))))


def _one_letter_off(words: DataFrame, one_length: bool = True) -> DataFrame:
    """(u, v), u < v: all pairs of (id, word) at most two insertions and deletions apart, or only those of different lengths.

    Texts of one length agree where each has lost a letter, others where the longer one has lost what it is longer by. So few
    texts share a key however many there are; equal hashes only add candidates.
    """
    words = words.withColumn("size", F.length("word"))
    lost = lambda df: df.select("id", F.explode(_less(F.col("word"))).alias("word"))
    sizes = words.select("size").distinct()
    longer = lambda by: words.join(F.broadcast(sizes.select((F.col("size") + by).alias("size"))), "size", "left_semi").filter(F.col("size") >= by)  # as many as there are lengths
    key = F.xxhash64("word").alias("key")
    one = write_out(lost(words.filter("size > 0") if one_length else longer(1)).select("id", key))
    whole = words.select(F.col("id").alias("u"), key)
    two = lost(lost(longer(2))).select(F.col("id").alias("v"), key).unionByName(one.select(F.col("id").alias("v"), "key"))
    found = whole.join(two, "key").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    if one_length:
        same = one.withColumnRenamed("id", "u").join(one.withColumnRenamed("id", "v"), "key").filter("u < v")
        found = found.unionByName(same.select("u", "v"))
    return write_out(found.filter("u < v").distinct())


def _links(words: DataFrame, threshold: float) -> DataFrame:
    """(id, key): two texts of (id, word) reach the threshold just where they share a key; words are distinct, texts without a key are like no other.

    Brief texts of one length are similar where each can lose a letter so that the same is left. That text is their key, named by
    the first of them and the place of the loss there: a row for every text and letter, however many pairs they make. All other
    pairs have a key of their own.
    """
    q = _gram_plan(threshold)[0]
    brief = 0 if q == 1 else _brief(threshold)
    if brief:
        words = words.withColumn("size", F.length("word"))
        two_edits = F.lit(100.0) * (F.lit(1.0) - F.lit(2.0) / (2 * F.col("size"))) >= threshold  # as ``similarity`` reckons
        left = words.filter((F.col("size") > 0) & (F.col("size") <= brief) & two_edits).select("id", F.posexplode(_less(F.col("word"))).alias("at", "left"))
        alike = Window.partitionBy("left")
        named = left.select("id", F.min(F.struct("id", "at")).over(alike).alias("first"), F.count(F.lit(1)).over(alike).alias("n"))
        shared = named.filter("n > 1").select("id", (F.col("first.id") * (brief + 1) + F.col("first.at")).alias("key"))
        words = words.drop("size")
        met, rest = _one_letter_off(words.filter(F.length("word") <= brief), one_length=False), _longer_pairs(words, threshold)
        return shared.unionByName(_own_keys(_verified(words, met if rest is None else met.unionByName(rest).distinct(), threshold)))
    return _own_keys(similar_pairs(words, threshold))


def _own_keys(pairs: DataFrame) -> DataFrame:
    """(id, key) with a key below 0 for every pair (u, v); to be written before it is used twice."""
    return pairs.select("u", "v", (-1 - F.monotonically_increasing_id()).alias("key")).select(F.explode(F.array("u", "v")).alias("id"), "key")


def _verified(words: DataFrame, met: DataFrame, threshold: float) -> DataFrame:
    """(u, v, score) of the pairs met that reach the threshold."""
    texts = met.join(words.select(F.col("id").alias("u"), F.col("word").alias("a")), "u").join(
        words.select(F.col("id").alias("v"), F.col("word").alias("b")), "v")
    return texts.withColumn("score", similarity("a", "b")).filter(F.col("score") >= threshold).select("u", "v", "score")


def fuzzy_pairs(df: DataFrame, col: str, threshold: float = 90) -> DataFrame:
    """(value, other, score), value < other: all pairs of different values whose similarity reaches the threshold."""
    require(df, col)
    values = write_out(present(df, col).select(name(col).cast("string").alias("word")).distinct())
    words = write_out(ordered.number_rows(values, ["word"], out="id"))
    found = similar_pairs(words, threshold)
    return (found.join(words.select(F.col("id").alias("u"), F.col("word").alias("value")), "u")
            .join(words.select(F.col("id").alias("v"), F.col("word").alias("other")), "v").select("value", "other", "score"))


def fuzzy_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, threshold: float = 90, suffix: str = "_right", score: str = "score") -> DataFrame:
    """Rows of ``left`` with the rows of ``right`` whose value is similar to their own, and the similarity as ``score``.

    Equal values score 100, missing ones match nothing. Columns of ``right`` whose names are taken get ``suffix``; ``left`` must
    not have a column ``score``. Values are compared once, however many rows hold them.
    """
    require(left, left_col)
    require(right, right_col)
    outs: list[tuple[str, str]] = []
    for c in right.columns:
        out = c
        while out in [*left.columns, *(o for _, o in outs)]:
            out += suffix
        outs.append((c, out))
    if score in [*left.columns, *(o for _, o in outs)]:
        raise ValueError(f"there is a column '{score}' already")
    tag = f"word_{uuid.uuid4().hex[:8]}"
    mine, theirs = f"{tag}_l", f"{tag}_r"
    words = lambda df, c: present(df, c).select(name(c).cast("string").alias("word"))
    met = fuzzy_pairs(words(left, left_col).unionAll(words(right, right_col)), "word", threshold)
    both = met.unionAll(met.select("other", "value", "score")).toDF(mine, theirs, score)
    same = words(left, left_col).distinct().select(F.col("word").alias(mine), F.col("word").alias(theirs), F.lit(100.0).alias(score))
    rows = right.select(name(right_col).cast("string").alias(theirs), *[name(c).alias(o) for c, o in outs])
    links = write_out(both.unionAll(same))
    return (left.withColumn(mine, name(left_col).cast("string")).join(links, mine).join(rows, theirs)
            .select(*map(name, left.columns), *[name(o) for _, o in outs], score))


def _heads_in_order(links: pd.DataFrame) -> list[int]:
    """The sequential rule on bounded rows (id, key): a vertex is a head when none of its keys has one."""
    links = links.sort_values("id")
    ids, keys = links["id"].to_numpy(), links["key"].tolist()
    ends = [*(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
    taken: set[int] = set()
    heads, start = [], 0
    for end in ends:
        mine = keys[start:end]
        if taken.isdisjoint(mine):
            taken.update(mine)
            heads.append(int(ids[start]))
        start = end
    return heads


def _settle(links: DataFrame) -> DataFrame:
    """(id) of the heads among the vertices of bounded rows, in one task."""
    return links.groupBy(F.lit("all")).applyInPandas(lambda pdf: pd.DataFrame({"id": _heads_in_order(pdf)}), "id long")


def heads_by_keys(links: DataFrame, one_task_rows: int = ONE_TASK_EDGES, steps: int = FRONT_STEPS) -> DataFrame:
    """(id, head): every vertex of (id, key) with the head of its cluster, in order of vertex number; vertices that share a key are neighbours.

    The sequential rule, take the first free vertex and claim all its free neighbours, makes a vertex a
    head when no smaller neighbour is one. Each round settles all vertices that come first under each of
    their keys, and the first open vertices among themselves, as many as one task holds, so that long chains
    cannot stall it. Neighbours are never paired: a head takes its keys, and whoever holds one of them is
    claimed. Every round is written out. A vertex that is no head joins its smallest neighbouring head.
    """
    links = open_ = write_out(links.select("id", "key"))
    heads = None
    while (rows := open_.count()) or heads is None:
        if rows <= one_task_rows:
            new = _settle(open_)
        else:
            low, high = open_.agg(F.min("id"), F.max("id")).first()
            width = (high - low) // steps + 1
            step = F.floor((F.col("id") - low) / width)
            held = sorted(tuple(r) for r in open_.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect())  # ``steps`` at most
            fits = [k for (k, _), upto in zip(held, accumulate(n for _, n in held)) if upto <= one_task_rows]
            front = open_.filter(step <= (fits[-1] if fits else held[0][0]))
            first = open_.select("id", (F.min("id").over(Window.partitionBy("key")) == F.col("id")).alias("first"))
            free = first.groupBy("id").agg(F.min("first").alias("first")).filter("first").select("id")
            new = free.unionByName(_settle(front)).distinct()
        new = write_out(new)
        heads = new if heads is None else write_out(heads.unionByName(new))
        if rows <= one_task_rows:
            break
        taken = open_.join(new, "id", "left_semi").select("key").distinct()
        claimed = open_.join(taken, "key", "left_semi").select("id").distinct()  # the heads themselves hold keys that are taken
        open_ = write_out(open_.join(claimed, "id", "left_anti"))
    owners = links.join(heads, "id").select("key", F.col("id").alias("head"))  # a key has one head at most
    return links.join(owners, "key").groupBy("id").agg(F.min("head").alias("head"))


def greedy_heads(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES, front: int = FRONT_STEPS) -> DataFrame:
    """``heads_by_keys`` for edges (u, v), each a key of its own."""
    return heads_by_keys(_own_keys(edges), one_task_edges, front)


def _numbered_values(df: DataFrame, col: str, order: Sequence[str] | None) -> DataFrame:
    """(id, word): distinct values numbered by first appearance, or by frequency without ``order``."""
    values = present(df, col)
    word = name(col).cast("string").alias("word")
    if order is None:
        counted = values.groupBy(word).agg((-F.count(F.lit(1))).alias("place0"))
        places = ["place0"]
    else:
        places = [f"place{i}" for i in range(len(order))]
        first = F.min(F.struct(*[name(c).alias(p) for c, p in zip(order, places)]))
        counted = values.groupBy(word).agg(first.alias("first")).select("word", *[F.col(f"first.{p}").alias(p) for p in places])
    numbered = ordered.number_rows(write_out(counted), [*places, "word"], out="id")
    return write_out(numbered.select("id", "word"))


def fuzzy_clusters(df: DataFrame, col: str, threshold: float = 90, order_by: str | Sequence[str] = ()) -> DataFrame:
    """Groups of two or more similar values as (cluster, value, score), clusters by first appearance.

    ``cluster`` is the value the group formed around; ``score`` is the similarity to it.
    """
    require(df, col, *as_list(order_by))
    if not as_list(order_by):
        raise ValueError("fuzzy_clusters needs order_by, which defines first appearance")
    words = _numbered_values(df, col, as_list(order_by))
    heads = write_out(heads_by_keys(_links(words, threshold)))
    grown = heads.groupBy("head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("head")
    return (
        heads.join(grown, "head")
        .join(words.select("id", F.col("word").alias("value")), "id")
        .join(words.select(F.col("id").alias("head"), F.col("word").alias("cluster")), "head")
        .select("cluster", "value", similarity("cluster", "value").alias("score"))
    )


def merge_clusters(df: DataFrame, col: str, choices: Mapping[str, str] | DataFrame) -> DataFrame:
    """Apply chosen spellings: a mapping from value to replacement."""
    return map_values(df, col, dict(choices) if isinstance(choices, Mapping) else choices)


def harmonize(df: DataFrame, col: str, threshold: float = 90) -> DataFrame:
    """Replace every value by the most frequent similar one (the smaller text on a tie)."""
    require(df, col)
    words = _numbered_values(df, col, None)
    heads = heads_by_keys(_links(words, threshold)).filter("id <> head")
    mapping = (heads.join(words.select("id", F.col("word").alias("key")), "id")
               .join(words.select(F.col("id").alias("head"), F.col("word").alias("value")), "head").select("key", "value"))
    return map_values(df, col, write_out(mapping))
