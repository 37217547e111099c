"""Exact top-k search by inner product, reading sorted lists in step and never at random.

Vectors are dealt by a hash into blocks. In each block every dimension has a list of its entries, largest first, kept as a
table. A query reads all lists of a block at the same depth, from the top where its own entry is positive and from the
bottom where it is negative. What it has read gives each vector a lower bound (unread entries at the list's far end) and an
upper bound (unread entries at the last one read). Reading stops when no vector outside a few can reach the k-th best lower
bound; the scores of those few are then resolved from the rest of their entries. Many queries read a block in step, so that
the bounds of one depth are products of matrices.

Every query first reads one block; its k-th score there is a floor that lets it stop early in all other blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.vectors import one_length
from quarry.session import write_out

BLOCK_ROWS = 2048
GROUP_ROWS = 512
READS = 8  # depths at which a list is looked at again
NONE = np.iinfo(np.int64).min


def sort_block(block: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """The lists of a block: (block, dim, places, entries) with falling entries; dim -1 holds the ids, in the order of places."""
    pdf = pdf.sort_values("vec_id", kind="stable")
    x = np.stack(pdf["x"].to_numpy())
    order = np.argsort(-x, axis=0, kind="stable").T.astype(np.int32)
    lists = [(block, j, order[j], x[order[j], j]) for j in range(x.shape[1])]
    return pd.DataFrame([(block, -1, None, pdf["vec_id"].to_numpy()), *lists], columns=["block", "dim", "places", "entries"])


def read_in_step(places: np.ndarray, entries: np.ndarray, ids: np.ndarray, asked: np.ndarray, own: np.ndarray,
                 floors: np.ndarray, k: int, reads: int = READS) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Per query its number, the places and scores of the vectors that may be among its best, and the depth it has read.

    ``places`` and ``entries`` hold a list per row; ``asked`` a query per row; ``own`` the id a query must not find. Vectors
    below a query's floor are left out.
    """
    width, size = entries.shape
    largest = int(np.abs(asked).max(initial=0)) * int(np.abs(entries).max(initial=0)) * width
    if largest >= 1 << 63:
        raise OverflowError("inner products beyond the range of a long")
    kind = np.float64 if largest < 1 << 53 else np.int64  # both exact; the first is faster
    least = -np.inf if kind is np.float64 else NONE
    at = np.empty((size, width), np.int32)  # how deep a vector's entry stands in each list
    x = np.empty((size, width), kind)
    for j in range(width):
        at[places[j], j] = np.arange(size)
        x[places[j], j] = entries[j]
    ends = entries.astype(kind)
    up, down = np.maximum(asked, 0).astype(kind), np.minimum(asked, 0).astype(kind)
    floors = np.where(floors == NONE, least, floors.astype(kind))
    mine = np.minimum(np.searchsorted(ids, own), size - 1)
    mine = np.where(ids[mine] == own, mine, -1)
    few = 8 * k
    waiting = np.arange(len(asked))
    step = max(1, -(-size // reads))
    for depth in [*range(step, size, step), size]:
        plus, minus = up[waiting], down[waiting]
        top, low = at < depth, at >= size - depth
        read = plus @ np.where(top, x, 0).T + minus @ np.where(low, x, 0).T
        unread_top, unread_low = (~top).T.astype(kind), (~low).T.astype(kind)
        upper = read + (plus * ends[:, depth - 1]) @ unread_top + (minus * ends[:, size - depth]) @ unread_low
        lower = read + (plus * ends[:, -1]) @ unread_top + (minus * ends[:, 0]) @ unread_low
        self_ = np.flatnonzero(mine[waiting] >= 0)
        upper[self_, mine[waiting][self_]] = least
        lower[self_, mine[waiting][self_]] = least
        if size >= k:
            floors[waiting] = np.maximum(floors[waiting], np.partition(lower, size - k, axis=1)[:, size - k])
        open_ = (upper >= floors[waiting, None]) & (upper > least)
        done = (open_.sum(axis=1) <= few) | (depth == size)
        for i in np.flatnonzero(done):
            inside = np.flatnonzero(open_[i])
            yield int(waiting[i]), inside, (x[inside] @ asked[waiting[i]].astype(kind)).astype(np.int64), depth
        waiting = waiting[~done]
        if not len(waiting):
            return


def _search(k: int):
    def search(key, lists: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(lists) and len(queries):
            lists = lists.sort_values("dim")
            ids, rest = np.asarray(lists["entries"].iloc[0]), lists.iloc[1:]
            own = queries["query_id"].to_numpy()
            hits = read_in_step(np.stack(rest["places"].to_numpy()), np.stack(rest["entries"].to_numpy()), ids,
                                np.stack(queries["x"].to_numpy()), own, queries["floor"].to_numpy(), k)
            for i, inside, scores, depth in hits:
                best = np.lexsort((ids[inside], -scores))[:k]
                found += [(own[i], ids[inside[b]], scores[b], depth) for b in best]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score", "depth"])
    return search


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query with the other vectors, exactly.

    Both tables have ``vec_id`` and ``x``, an array of longs, as ``whole_vectors`` gives them. Equal scores go by ascending
    vec_id; a query never finds its own id. Rows that share an id count once, with the smallest of their vectors; rows
    without an id take no part. Fewer than ``k`` other vectors are all returned, none gives no row for the query; empty
    tables give an empty result. Vectors of different lengths and products beyond the range of a long are errors.
    """
    vectors, queries = (t.filter("vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("x").alias("x"))
                        for t in (vectors, queries))
    vectors, queries = write_out(vectors), write_out(queries)
    n, asked = vectors.count(), queries.count()
    shape = "query_id long, vec_id long, score long, depth int"
    if not n or not asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    one_length(vectors.select("x").unionAll(queries.select("x")))
    blocks, groups = -(-n // block_rows), -(-asked // group_rows)
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    lists = write_out(dealt.groupBy("block").applyInPandas(lambda key, pdf: sort_block(key[0], pdf), "block int, dim int, places array<int>, entries array<long>"))
    queries = queries.select(F.col("vec_id").alias("query_id"), "x", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int").alias("of"))

    def search(offered: DataFrame, wanted: DataFrame) -> DataFrame:
        # fresh column identities, so that the two sides of the cogroup share none
        offered = offered.select(F.col("block").alias("cell"), F.col("of").alias("part"), "dim", "places", "entries")
        return wanted.groupBy("block", "of").cogroup(offered.groupBy("cell", "part")).applyInPandas(
            lambda key, asked, lists: _search(k)(key, lists, asked), shape)

    home = F.pmod("of", F.lit(blocks)).cast("int")
    at_home = (lists.filter(F.col("block") < groups)
               .withColumn("of", F.explode(F.sequence(F.col("block"), F.lit(groups - 1), F.lit(blocks)))))
    first = write_out(search(at_home, queries.select("query_id", "x", "of", home.alias("block"), F.lit(NONE).alias("floor"))))
    if blocks > 1:
        floors = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        known = queries.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE)))
        away = lists.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).filter(home != F.col("block"))
        wanted = known.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).filter(home != F.col("block"))
        first = first.unionByName(search(away, wanted))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
