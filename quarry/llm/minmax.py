"""Near duplicates through min-max hashing.

Each permutation of the shingle hashes gives two signature values, the least and the greatest, so half the hash
evaluations fill a signature. Values are banded; documents that share a band are candidates, and links are confirmed on
the full shingle sets. Documents with equal sets stand for each other from the start.

No group is ever expanded into all its pairs. Candidates first meet the hub of their bands, the document that shares its
bands with most others (near copies of one text agree with that text more than with each other); once those links have
formed components, only documents whose band still holds another component are compared further, and of those only the
pairs that may be linked by what each of them shares with the hub (``_open_pairs``), so a large group of near copies costs
a few comparisons per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import name, require
from quarry.llm.common import flat_bytes, fresh, text_slices, two_columns, words_of
from quarry.operators.components import components
from quarry.session import write_out

PERMUTATIONS = 56  # two values each
ROWS_PER_BAND = 4  # 28 bands: a pair at similarity 0.8 shares none with probability 4e-7
SIMILAR_PERCENT = 80
SKETCH_MARGIN = 0.2  # sketches estimate the similarity; five standard deviations at 112 values
SMALL_IDS = 500_000  # ids that may be broadcast: 4 MB
ONE_TASK_LINKS = 50_000  # links, 800 kB, whose components one task may settle; more go through distributed rounds

_rng = np.random.default_rng(20)
_FLIPS = _rng.integers(0, 2 ** 63, PERMUTATIONS, dtype=np.uint64)
_ODD = _rng.integers(0, 2 ** 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its runs of ``words`` words (A-Z in lower case); of all words, if fewer."""
    raw, ends = flat_bytes(pc.ascii_lower(texts))
    found, counts = words_of(raw, ends)
    coded = found.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    code = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(found) else hashes
    runs = max(len(code) - words + 1, 0)
    whole = np.full(runs, np.uint64(words))
    for k in range(words):
        whole = _stir(whole * _MIX + code[k:k + runs])
    out, start = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(whole[start:start + n - words + 1]))
        elif n:
            one = np.full(1, np.uint64(n))
            for k in range(n):
                one = _stir(one * _MIX + code[start + k:start + k + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
        start += n
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 2 x PERMUTATIONS values per non-empty set: least and greatest of every permutation."""
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    for p in range(PERMUTATIONS):
        permuted = (flat ^ _FLIPS[p]) * _ODD[p]
        out[:, 2 * p] = np.minimum.reduceat(permuted, starts)
        out[:, 2 * p + 1] = np.maximum.reduceat(permuted, starts)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One hash per band of ROWS_PER_BAND values; values of one permutation fall into different bands."""
    rows, values = signature.shape
    apart = np.concatenate([signature[:, 0::2], signature[:, 1::2]], axis=1)
    n = values // ROWS_PER_BAND
    out = np.tile(np.arange(1, n + 1, dtype=np.uint64), (rows, 1))
    for k in range(ROWS_PER_BAND):
        out = _stir(out * _MIX + apart[:, k * n:(k + 1) * n])
    return out


def _sketched(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, limit=1 << 20):
        sets = shingle_sets(batch.column("text"), words)
        some = [i for i, s in enumerate(sets) if len(s)]
        prints, keys, sketches = [None] * len(sets), [None] * len(sets), [None] * len(sets)
        if some:
            signature = signatures([sets[i] for i in some])
            for i, k, s in zip(some, bands(signature).view(np.int64), (signature >> np.uint64(40)).astype(np.uint8)):
                prints[i], keys[i], sketches[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), k, s.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()),
             pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "print", "bands", "sketch"])


def _sets(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, limit=1 << 20):
        sets = shingle_sets(batch.column("text"), words)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "hashes"])


def _alike(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes allow the similarity and whose sketches do not rule it out."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        a, b = (np.array([np.frombuffer(s, np.uint8) for s in batch.column(c).to_pylist()]) for c in ("sketch_u", "sketch_v"))
        n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_u", "n_v"))
        keep = ((a == b).mean(axis=1) >= percent / 100 - SKETCH_MARGIN) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        yield batch.select(["u", "v"]).filter(pa.array(keep))


def _confirmed(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("hashes_u"), batch.column("hashes_v")):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.searchsorted(b, a)
            common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            keep.append(100 * common >= percent * (len(a) + len(b) - common))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _of_ids(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is among ``ids`` (a written table of distinct ``id``), without a shuffle where the ids are few."""
    if ids.count() <= SMALL_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, F.col(key) == F.col("id"), "left_semi")


def _confirm(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among candidate pairs (u, v): sketches first, then full sets; written out."""
    def with_both(rows: DataFrame, of: DataFrame) -> DataFrame:
        for side in "uv":
            rows = rows.join(of.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in of.columns if c != "id"]), side)
        return rows

    likely = write_out(with_both(pairs, sketches).mapInArrow(partial(_alike, percent), "u long, v long"))
    return write_out(with_both(likely, sets).mapInArrow(partial(_confirmed, percent), "u long, v long"))


def _beside_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per (u: a document, v: its hub): set size, hashes in common with the hub, and the others, cut to 32 bits."""
    for batch in batches:
        sizes, common, others = [], [], []
        for x, y in zip(batch.column("hashes_u"), batch.column("hashes_v")):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            hit = b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a
            sizes.append(len(a))
            common.append(int(hit.sum()))
            others.append(np.unique((a[~hit] & np.uint64(0xFFFFFFFF)).astype(np.uint32)).view(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(sizes, pa.int64()), pa.array(common, pa.int64()),
                                          pa.array(others, pa.list_(pa.int32()))], names=["id", "hub", "n", "common", "others"])


def _open_pairs(placed: DataFrame, first: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v), u > v, of different components within one band that may still be linked.

    ``placed`` is a written (band, id, r) with the component r. In every band the documents outside its largest component
    would have to meet all others of it. But two documents with the same hub that share nothing outside it have at most as
    many hashes in common as the one nearer to it has with the hub, so such pairs are left out unless that is enough for
    a link; those that share something outside the hub are found by it.
    """
    mixed = placed.groupBy("band").agg(F.min("r").alias("low"), F.max("r").alias("high")).filter("low < high").select("band")
    still = write_out(placed.join(mixed, "band", "left_semi"))
    ids = still.select("id").distinct().join(first.select(F.col("u").alias("id"), F.col("v").alias("hub")), "id", "left")
    both = ids.select(F.col("id").alias("u"), F.coalesce("hub", "id").alias("v"))
    for side in "uv":
        both = both.join(sets.select(F.col("id").alias(side), F.col("hashes").alias(f"hashes_{side}")), side)
    facts = write_out(both.mapInArrow(_beside_hub, "id long, hub long, n long, common long, others array<int>"))
    still = write_out(still.join(facts.drop("others"), "id"))
    main = still.groupBy("band", "r").agg(F.count(F.lit(1)).alias("k")).groupBy("band").agg(F.max(F.struct("k", "r")).alias("m")).select("band", F.col("m.r").alias("main"))
    main_hub = still.groupBy("band", "hub").agg(F.count(F.lit(1)).alias("k")).groupBy("band").agg(F.max(F.struct("k", "hub")).alias("m")).select("band", F.col("m.hub").alias("main_hub"))
    least = still.groupBy("band", "hub").agg(F.min("n").alias("least"))
    still = write_out(still.join(main_hub, "band"))
    strays = write_out(still.join(main, "band").filter("r <> main").join(least, ["band", "hub"])
                       .select("band", F.col("id").alias("a"), F.col("r").alias("ra"), F.col("hub").alias("hub_a"), F.col("n").alias("n_a"), F.col("common").alias("common_a"),
                               "least", F.col("main_hub").alias("main_a")))
    sizes = (F.lit(100) * F.least("n_a", "n") >= F.lit(percent) * F.greatest("n_a", "n")) & F.expr("ra <> r")

    def enough(common: Column, n: Column) -> Column:
        return common * (100 + percent) >= (F.col("n_a") + n) * percent  # what a similarity of ``percent`` needs in common

    close = strays.filter(enough(F.col("common_a"), F.col("least"))).drop("main_a")
    near = close.join(still.drop("main_hub").withColumnRenamed("hub", "hub_a"), ["band", "hub_a"]).filter(sizes & enough(F.least("common_a", "common"), F.col("n")))
    apart = F.expr("hub_a <> hub") & sizes
    far = (strays.filter("hub_a <> main_a").join(still, "band").filter(apart).select("a", "id")
           .unionByName(strays.join(still.filter("hub <> main_hub"), "band").filter(apart).select("a", "id")))
    # Pairs that share enough outside their hub. Hashes of one component alone join nothing; of the others, the rarest
    # first, a document may leave out as many as it must share less one.
    own = still.select("id", "hub", "n", "common", "r").distinct()
    lowest = own.groupBy("hub").agg(F.min("n").alias("lowest"))
    partner = F.greatest(F.ceil(F.col("n") * percent / 100), F.col("lowest"))  # the least size a linked document can have
    share = F.greatest(F.lit(1), F.ceil((F.col("n") + partner) * percent / (100 + percent)) - F.col("common"))
    outside = facts.select("id", F.explode("others").alias("hash")).join(own.join(lowest, "hub").withColumn("share", share), "id")
    spread = outside.groupBy("hub", "hash").agg(F.count(F.lit(1)).alias("k"), F.min("r").alias("low"), F.max("r").alias("high")).filter("low < high").select("hub", "hash", "k")
    mine = Window.partitionBy("id")
    outside = (outside.join(spread, ["hub", "hash"]).withColumn("rank", F.row_number().over(mine.orderBy("k", "hash"))).withColumn("held", F.count(F.lit(1)).over(mine))
               .filter("rank <= held - share + 1").select("id", "hub", "n", "r", "hash"))
    outside = write_out(outside)
    alone = strays.select(F.col("a").alias("id")).distinct()
    asked = outside.join(alone, "id", "left_semi").select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("r").alias("ra"), "hub", "hash")
    beside = asked.join(outside, ["hub", "hash"]).filter(sizes)
    found = near.select("a", "id").unionByName(far).unionByName(beside.select("a", "id"))
    return found.select(F.greatest("a", "id").alias("u"), F.least("a", "id").alias("v")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = SIMILAR_PERCENT, key: str = "doc_id", text: str = "text",
                    one_task_links: int = ONE_TASK_LINKS) -> DataFrame:
    """Per row: key as ``doc_id``, ``n_shingles`` (size of its set), ``component_id`` (the smallest key reachable over links), ``kept``.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets. A null or empty text has
    an empty set and is linked with nothing; a text with fewer words than a shingle has one shingle, all of it. Rows with
    equal keys share a component. Null keys are linked with nothing: no component, kept. An empty table gives no rows.
    """
    require(docs, key, text)
    slim = two_columns(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    sketched = write_out(slim.mapInArrow(partial(_sketched, words), "doc_id long, n_shingles long, print binary, bands array<long>, sketch binary"))
    linkable = sketched.filter("doc_id is not null and print is not null")
    chosen = write_out(linkable.groupBy("print").agg(F.min("doc_id").alias("id")))  # one document for all with equal sets
    own = linkable.join(chosen, "print").filter("doc_id = id").dropDuplicates(["id"]).select("id", "n_shingles", "bands", "sketch")
    members = write_out(own.select("id", F.explode("bands").alias("band")))
    buckets = write_out(members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = write_out(members.join(buckets, "band"))
    fame = write_out(met.groupBy("id").agg(F.sum("n").alias("fame")))
    known = write_out(met.join(fame, "id").select("band", "id", "fame"))
    hubs = write_out(known.groupBy("band").agg(F.max(F.struct("fame", (-F.col("id")).alias("order"))).alias("hub"))
                     .select("band", F.col("hub.fame").alias("hub_fame"), (-F.col("hub.order")).alias("hub")))
    shared = write_out(known.join(hubs, "band").select("band", "id", "hub", "hub_fame"))
    ids = write_out(shared.select("id").distinct())
    sketches = write_out(_of_ids(sketched.filter("print is not null"), "doc_id", ids).dropDuplicates(["doc_id"])
                         .select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch"))
    sets = write_out(_of_ids(slim, "doc_id", ids).dropDuplicates(["doc_id"]).mapInArrow(partial(_sets, words), "id long, hashes binary"))

    def with_roots(rows: DataFrame, cols: dict[str, str], roots: DataFrame) -> DataFrame:
        for col, out in cols.items():
            rows = rows.join(roots.select(F.col("node").alias(col), F.col("root").alias(out)), col, "left").withColumn(out, F.coalesce(out, col))
        return rows

    # Every document meets the greatest hub of its bands, then the hub of each band that holds another component.
    greatest = F.max(F.struct("hub_fame", (-F.col("hub")).alias("order")))
    first = write_out(shared.filter("id <> hub").groupBy("id").agg(greatest.alias("g")).select(F.col("id").alias("u"), (-F.col("g.order")).alias("v")))
    links = _confirm(first, sketches, sets, percent)
    roots = write_out(components(links, one_task_edges=one_task_links))
    second = (with_roots(shared.filter("id <> hub").select("id", "hub").distinct(), {"id": "r", "hub": "s"}, roots)
              .filter("r <> s").select(F.col("id").alias("u"), F.col("hub").alias("v")).join(first, ["u", "v"], "left_anti"))
    second = write_out(second)
    links = write_out(links.unionByName(_confirm(second, sketches, sets, percent)))
    roots = write_out(components(links, one_task_edges=one_task_links))
    placed = write_out(with_roots(shared.select("band", "id"), {"id": "r"}, roots))
    tried = first.unionByName(second).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    third = _open_pairs(placed, first, sets, percent).join(tried, ["u", "v"], "left_anti")
    more = _confirm(write_out(third), sketches, sets, percent)
    roots = write_out(components(links.unionByName(more), one_task_edges=one_task_links))

    standing = with_roots(chosen, {"id": "root"}, roots).select("print", "root")
    out = sketched.select("doc_id", "n_shingles", "print").join(standing, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = SIMILAR_PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that ``near_duplicates`` does not keep; rows with null keys stay."""
    gone = fresh("gone")
    dropped = write_out(near_duplicates(docs, words, percent, key, text).filter(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct())
    if dropped.count() <= SMALL_IDS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, name(key).cast("long") == F.col(gone), "left_anti")
