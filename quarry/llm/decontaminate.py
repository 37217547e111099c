"""Benchmark decontamination with spaced seeds, in DataFrame operations alone.

A mask keeps some of a few neighbouring words and ignores the others, so a hit survives substituted words. Masked hashes
of all benchmark positions meet those of all document positions; every hit fixes an alignment of item and document, and
the alignment is verified word by word: within some window of the item enough words must be equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import name, require
from quarry.llm.common import fresh
from quarry.session import write_out

#: Word positions that each mask compares.
MASKS = ((0, 1, 3, 4), (0, 2, 3, 4))
SPAN = 5  # words a mask covers; shorter items are not searched for
WINDOW, SIMILAR = 13, 0.8
SMALL_SEEDS = 500_000  # benchmark seeds that may be broadcast, about 30 MB
SMALL_IDS = 500_000


def word_hashes(text: Column) -> Column:
    """Hashes of the words (letters and digits, in lower case) of a text, in order."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep…, seed, at): a masked hash for every mask and position of the array ``words``; ``at`` is the position."""
    n = F.size("words") - (SPAN - 1)  # positions of a mask

    def masked(m: int, mask: tuple[int, ...]) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.lit(m), *[F.get(F.col("words"), i + o) for o in mask]))
        return F.when(n > 0, hashes).otherwise(F.array().cast("array<long>"))

    found = rows.select(*keep, F.greatest(n, F.lit(1)).alias("_n"), F.posexplode(F.concat(*[masked(m, mask) for m, mask in enumerate(MASKS)])).alias("_at", "seed"))
    return found.select(*keep, "seed", (F.col("_at") % F.col("_n")).alias("at"))


def _best_window(item: Column, words: Column, shift: Column, window: int) -> Column:
    """(matched, width, start): the window of the item with the most words equal to the document's at the same alignment."""
    equal = F.transform(item, lambda x, j: F.when(F.get(words, F.when(shift + j >= 0, shift + j).otherwise(F.size(words))) == x, 1).otherwise(0))
    width = F.least(F.size(item), F.lit(window))

    def best(marks: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.lit(-1).alias("most"), F.lit(0).alias("at"))

        def slide(a: Column, j: Column) -> Column:
            total = a["sum"] + F.get(marks, j) - F.when(j >= width, F.get(marks, F.greatest(j - width, F.lit(0)))).otherwise(0)
            better = (j >= width - 1) & (total > a["most"])
            return F.struct(total.alias("sum"), F.when(better, total).otherwise(a["most"]).alias("most"), F.when(better, j - width + 1).otherwise(a["at"]).alias("at"))

        return F.aggregate(F.sequence(F.lit(0), F.size(marks) - 1), start, slide,
                           lambda a: F.struct(a["most"].alias("matched"), width.alias("width"), a["at"].alias("start")))

    return F.transform(F.array(equal), best)[0]  # binds the marks, so that they are computed once


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similar: float = SIMILAR, key: str = "doc_id", text: str = "text",
          item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item that it holds: ``doc_id``, ``item_id``, ``matched`` of ``width`` words equal in the
    best window, ``doc_word`` and ``item_word`` where it begins.

    An item is held if, at one alignment, at least ``similar`` of the words of some window of ``window`` words (the whole
    item, if shorter) are equal, and at most one word in five beyond the second differs: so few substitutions always leave
    a mask intact, and items of five or six words must be found whole. Null texts are empty; items and documents of fewer than SPAN words and rows with null keys
    match nothing; rows that share a key count as one; empty tables give no rows; other columns are not read.
    """
    require(docs, key, text)
    require(benchmark, item_key, item_text)
    items = write_out(benchmark.select(name(item_key).alias("item_id"), word_hashes(name(item_text)).alias("words"))
                      .filter((F.size("words") >= SPAN) & F.col("item_id").isNotNull()).distinct())
    seeds = write_out(_seeds(items, ["item_id"]).select("seed", "item_id", F.col("at").alias("item_at")))
    if seeds.count() <= SMALL_SEEDS:
        seeds, items = F.broadcast(seeds), F.broadcast(items)
    slim = docs.select(name(key).alias("doc_id"), name(text).cast("string").alias("text")).filter("doc_id is not null")
    hits = _seeds(slim.select("doc_id", word_hashes(F.col("text")).alias("words")), ["doc_id"]).join(seeds, "seed")
    aligned = write_out(hits.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct())
    ids = write_out(aligned.select("doc_id").distinct())
    if ids.count() <= SMALL_IDS:
        ids = F.broadcast(ids)
    held = slim.join(ids, "doc_id", "left_semi").distinct().select("doc_id", word_hashes(F.col("text")).alias("doc_words"))
    pairs = aligned.join(held, "doc_id").join(items, "item_id")
    judged = pairs.select("doc_id", "item_id", "shift", _best_window(F.col("words"), F.col("doc_words"), F.col("shift"), window).alias("w"))
    width = F.col("w.width")
    others = F.least(width - F.ceil(F.lit(similar) * width), F.floor((width - 2) / SPAN))  # words that may differ
    enough = judged.filter(F.col("w.matched") >= width - others)
    best = enough.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("w.matched").alias("matched"), F.col("w.width").alias("width"),
                                                                  (-F.col("shift")).alias("shift"), F.col("w.start").alias("start"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.matched").alias("matched"), F.col("b.width").alias("width"),
                       (F.col("b.start") - F.col("b.shift")).alias("doc_word"), F.col("b.start").alias("item_word"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; rows with null keys stay."""
    leaking = fresh("leaking")
    found = write_out(leaks(docs, benchmark, key=key, **options).select(F.col("doc_id").alias(leaking)).distinct())
    if found.count() <= SMALL_IDS:
        found = F.broadcast(found)
    return docs.join(found, name(key) == F.col(leaking), "left_anti")
