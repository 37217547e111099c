"""Candidate pairs of texts that may be within some insertions and deletions of each other, through an index of segments.

Take a shorter text of n characters, a longer one of m, and at most k insertions and deletions between them. Cut the shorter
into k + 1 segments: one of them, the j-th, is found whole in the longer text with exactly j edits before it, so it stands
-j, -j + 2, … or j places further on. Texts meet on (n, m, j, the segment's characters). What lies before and behind the
segment are two smaller problems, with j and k - j edits, so a key that very many texts share is cut again in the same way.

How far a key is cut is decided by counting: a key with few pairs is paired; a larger one is cut, and if its pieces would
make as many pairs as the key itself, its texts are indeed alike and it is paired as it is, dealt over as many tasks as
that takes. So the work follows the number of similar pairs, not the square of the number of texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import write_out

FEW_PAIRS = 2_048  # of a key, paired without another cut
SIDE_ROWS = 4_096  # texts of one side of a key that meet in one task


def edits_between(shorter: Column, longer: Column, threshold: float) -> Column:
    """The most insertions and deletions between texts of these lengths whose similarity reaches ``threshold`` percent."""
    return F.floor((1 - threshold / 100.0) * (shorter + longer) + 1e-9).cast("int")


def _gap(at: Column, size: Column, to: Column, wide: Column, most: Column) -> Column:
    """Open parts: ``size`` characters from ``at`` in the shorter text, ``wide`` from ``to`` in the text itself, ``most`` edits between."""
    return F.struct(at.cast("int").alias("at"), size.cast("int").alias("size"), to.cast("int").alias("to"), wide.cast("int").alias("wide"), most.cast("int").alias("most"))


def _roles(words: DataFrame, lengths: list[int], threshold: float) -> DataFrame:
    """States (id, word, probe, key, gaps, spare, mask): every word as the shorter and as the longer text of each pair of lengths that can be similar."""
    size = F.length("word")
    known = F.array(*[F.lit(n) for n in lengths])
    enough = lambda n, m: (n <= m) & (F.least(n, m) * 2 * 100.0 >= (threshold - 1e-7) * (n + m)) & (edits_between(n, m, threshold) > 0)
    as_short = F.transform(F.filter(known, lambda m: enough(size, m)), lambda m: F.struct(size.alias("n"), m.alias("m"), F.lit(False).alias("probe")))
    as_long = F.transform(F.filter(known, lambda n: enough(n, size)), lambda n: F.struct(n.alias("n"), size.alias("m"), F.lit(True).alias("probe")))
    zero, n, m = F.lit(0), F.col("r.n"), F.col("r.m")
    most = edits_between(n, m, threshold)
    # a shorter text stands at its own places, a longer one wherever the edits may have moved it
    whole = F.when(F.col("r.probe"), _gap(zero, n, zero, m, most)).otherwise(_gap(zero, n, zero, n, most))
    return (words.select("id", "word", "mask", F.explode(F.concat(as_short, as_long)).alias("r"))
            .select("id", "word", "mask", "r.probe", F.xxhash64("r.n", "r.m").alias("key"), (n == m).alias("even"), most.alias("edits"), F.array(whole).alias("gaps")))


def _cut(states: DataFrame) -> DataFrame:
    """Cut the gap with the most to spare; a state for each segment and place where it may be found, with its ``parent`` key."""
    nth = F.abs(F.array_max(F.transform("gaps", lambda g, i: F.struct((g["size"] - g["most"]).alias("spare"), (-i).alias("i"))))["i"])
    chosen = states.withColumn("nth", nth).withColumn("gap", F.get("gaps", F.col("nth")))
    gap = F.col("gap")
    moved = lambda j: F.when(F.col("probe") & (j > 0), F.sequence(-j, F.greatest(j, F.lit(1)), F.lit(2))).otherwise(F.array(F.lit(0)))
    places = F.flatten(F.transform(F.sequence(F.lit(0), gap["most"]), lambda j: F.transform(moved(j), lambda s: F.struct(j.alias("j"), s.alias("s")))))
    start = lambda j: F.floor(gap["size"] * j / (gap["most"] + 1)).cast("int")

    def fits(c: Column) -> Column:
        j, s = c["j"], c["s"]
        return ~F.col("probe") | ((F.abs(gap["wide"] - gap["size"] - s) <= gap["most"] - j) & (start(j) + s >= 0) & (start(j + 1) + s <= gap["wide"]))

    cut = chosen.select("*", F.explode(F.filter(places, fits)).alias("c"))
    j, s = F.col("c.j"), F.col("c.s")
    first, last = start(j), start(j + 1)
    left = _gap(gap["at"], first, gap["to"], first + s, j)
    right = _gap(gap["at"] + last, gap["size"] - last, gap["to"] + last + s, gap["wide"] - last - s, gap["most"] - j)
    beside = F.filter(F.array(left, right), lambda g: g["most"] > 0)
    rest = F.concat(F.filter("gaps", lambda g, i: i < F.col("nth")), beside, F.filter("gaps", lambda g, i: i > F.col("nth")))
    text = F.substring("word", gap["to"] + first + s + 1, last - first)
    return cut.select("id", "word", "mask", "probe", "even", "edits", F.col("key").alias("parent"), F.xxhash64("key", "nth", j, text).alias("key"), rest.alias("gaps"))


def _spare(gaps: str = "gaps") -> Column:
    """How much of the longest gap a further cut could ask for; 0 where none has more characters than edits."""
    return F.coalesce(F.array_max(F.transform(gaps, lambda g: g["size"] - g["most"])), F.lit(0))


def _counted(states: DataFrame, *keys: str) -> DataFrame:
    """(keys…, a, b, spare) of the keys that hold both shorter and longer texts; written out."""
    found = states.groupBy(*keys).agg(F.count_if(~F.col("probe")).alias("a"), F.count_if("probe").alias("b"), F.max(_spare()).alias("spare"))
    return write_out(found.filter("a > 0 and b > 0"))


def _paired(states: DataFrame, chosen: DataFrame) -> DataFrame:
    """(u, v) with u < v of the texts under the ``chosen`` (key, a, b) whose letters allow it; written out.

    A large key is dealt: each part of one side meets each part of the other in a task of its own.
    """
    parts = lambda n: F.ceil(F.col(n) / SIDE_ROWS).cast("int")
    dealt = states.select("id", "mask", "probe", "even", "edits", "key").distinct().join(chosen.select("key", parts("a").alias("a"), parts("b").alias("b")), "key")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    short = dealt.filter("not probe").withColumn("pa", own("a")).withColumn("pb", every("b")).select(
        "key", "pa", "pb", "even", "edits", F.col("id").alias("i"), F.col("mask").alias("s"))
    long = dealt.filter("probe").withColumn("pb", own("b")).withColumn("pa", every("a")).select("key", "pa", "pb", F.col("id").alias("j"), F.col("mask").alias("t"))
    allowed = (F.col("i") != F.col("j")) & (~F.col("even") | (F.col("i") < F.col("j"))) & (F.bit_count(F.col("s").bitwiseXOR(F.col("t"))) <= F.col("edits"))
    met = short.join(long, ["key", "pa", "pb"]).filter(allowed)
    return write_out(met.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).distinct())


def candidates(words: DataFrame, threshold: float, few_pairs: int = FEW_PAIRS) -> DataFrame:
    """(u, v), u < v, of (id, word, mask): every pair of distinct words whose similarity reaches ``threshold`` percent, and few others.

    ``mask`` has a bit per letter of the word, of which one insertion or deletion changes one at most.
    """
    words = write_out(words.select("id", "word", "mask"))
    lengths = sorted(r[0] for r in words.select(F.length("word").alias("n")).distinct().collect())  # as many as there are lengths
    found = [words.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0)]
    states = _roles(words, lengths, threshold)
    parents = _counted(states, "key")
    small = lambda: F.col("a") * F.col("b") <= few_pairs
    stop = small() | (F.col("spare") <= 0)
    if parents.filter(stop).take(1):
        found.append(_paired(states.join(parents.filter(stop).select("key"), "key", "left_semi"), parents.filter(stop)))
    open_ = parents.filter(~stop)
    states = states.join(open_.select("key"), "key", "left_semi")
    while open_.take(1):
        pieces = _cut(states)
        facts = _counted(pieces, "parent", "key")
        after = facts.groupBy("parent").agg(F.sum(F.col("a") * F.col("b")).alias("after"))
        # where cutting leaves as many pairs as there were, the texts are alike: the key is paired as it is
        alike = write_out(open_.join(after.withColumnRenamed("parent", "key"), "key").filter(F.col("after") >= F.col("a") * F.col("b") / 2).drop("after"))
        if alike.take(1):
            found.append(_paired(states.join(alike.select("key"), "key", "left_semi"), alike))
        facts = write_out(facts.join(alike.select(F.col("key").alias("parent")), "parent", "left_anti").drop("parent"))
        if facts.filter(stop).take(1):
            found.append(_paired(pieces.join(facts.filter(stop).select("key"), "key", "left_semi"), facts.filter(stop)))
        open_ = facts.filter(~stop)
        states = write_out(pieces.join(open_.select("key"), "key", "left_semi").drop("parent").dropDuplicates(["id", "probe", "key", "gaps"]))
    return write_out(reduce(DataFrame.unionByName, found).distinct())
