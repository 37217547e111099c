"""Near-duplicate lines through a segment-partition edit join, in DataFrame operations alone.

Of two lines at most k edits apart, the shorter one cut into k + 1 segments, one segment is found in the other line, shifted
by no more than the edits before it. So every distinct line is indexed by its segments, probed with the places for its own
length and for one to k characters less, and candidates are verified by a edit distance along diagonals. A segment that
very many lines share is not expanded into pairs: the gaps beside it, which share the k edits, are cut in the same way, until
few lines share a key or no gap is longer than its edits; the lines of such a group are all close to the earliest one.

A line is removed where the same line, or one at most k edits away, begins earlier in the corpus (by key, then line).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import name, require
from quarry.llm.common import fresh
from quarry.session import write_out

EDITS = 1  # of callers that name no threshold
MIN_CHARS = 20  # shorter lines are compared for equality alone
COPIES_FROM = 1  # lines shorter than this, and blank ones under MIN_CHARS, are left alone
LETTERS = ("aA", "eE", "iI", "oO", "nN", "tT", "rR", "sS", "hH", "dD", "lL", "uU", "wWgG", "yYbBfF")  # counted in every candidate; any letters would be right
GROUP = 512  # lines sharing a key beyond which the key is refined instead of paired; pairs of fewer are parted by their letters in the join
LISTED = 32  # keys of a line by which a pair that meets under several is made under one; pairs past these are made again
SMALL_IDS = 2_000_000  # keys of eight bytes that may be broadcast: 16 MB; they spare a shuffle of the lines' text


def edit_distance(long: Column, short: Column, most: int = EDITS) -> Column:
    """Edit distance of two texts whose lengths differ by ``most`` at most, exact up to ``most`` and larger beyond.

    ``long`` is the longer text. Edit by edit, ``far`` holds how many characters of the shorter text are settled at most on each
    diagonal, which is how much further on the longer text is read. Between edits the texts agree, and how far is found by
    halving: the work grows with the number of edits, not with every character.
    """
    unreached = -2 * most - 2

    def measured(both: Column) -> Column:
        rows, cols, high, wide, steps = both["rows"], both["cols"], both["high"], both["wide"], both["steps"]

        def agreed(at: Column, d: Column) -> Column:
            """``at``, moved on by what the texts agree in from there on diagonal ``d``."""
            end = F.least(wide, high - d)
            return F.aggregate(steps, at, lambda x, step: F.when((x + step <= end) & (F.substring(cols, x + 1, step) == F.substring(rows, x + d + 1, step)), x + step).otherwise(x))

        def after(a: Column, e: Column) -> Column:
            def reach(d: Column) -> Column:
                far = lambda by: F.coalesce(F.get(a["far"], F.greatest(d + by + most, F.lit(0))), F.lit(unreached))
                before = F.when(d > -most, far(-1)).otherwise(F.lit(unreached))
                at = F.least(F.greatest(far(0) + 1, before, far(1) + 1), wide, high - d)
                useful = F.abs(d - (high - wide)) <= most - e  # else the ends are out of reach
                return F.element_at(F.transform(F.array(at), lambda x: F.when(useful & (x >= 0), agreed(x, d)).otherwise(F.lit(unreached))), 1)

            far = F.transform(F.array(*[F.lit(d) for d in range(-most, most + 1)]), reach)
            moved = F.element_at(F.transform(F.array(far), lambda f: F.struct(F.when(F.get(f, high - wide + most) == wide, e).otherwise(F.lit(most + 1)).alias("score"), f.alias("far"))), 1)
            return F.when(a["score"] <= most, a).otherwise(moved)

        same = agreed(F.lit(0), F.lit(0))
        far = F.array(*[same if d == 0 else F.lit(unreached) for d in range(-most, most + 1)])
        start = F.struct(F.when(rows == cols, 0).otherwise(F.lit(most + 1)).alias("score"), far.alias("far"))
        return F.aggregate(F.array(*[F.lit(e) for e in range(1, most + 1)]), start, after, lambda a: a["score"])

    halving = F.transform(F.sequence(F.floor(F.log2(F.length(short) + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda x: F.pow(F.lit(2), x).cast("int"))
    parts = F.struct(long.alias("rows"), short.alias("cols"), F.length(long).alias("high"), F.length(short).alias("wide"), halving.alias("steps"))
    return F.element_at(F.transform(F.array(parts), measured), 1)


def _coded(line: Column) -> Column:
    """The characters of a line as four bytes each: a piece of it is found without reading what lies before."""
    return F.encode(line, "UTF-32")


def _width(coded: Column) -> Column:
    return F.coalesce(F.shiftright(F.octet_length(coded), 2), F.lit(0))  # never null: Spark would code each line again to test it


def _piece(coded: Column, start: Column, size: Column) -> Column:
    return F.substring(coded, 4 * start + 1, 4 * size)


def _cuts(most: int) -> list[tuple[int, int]]:
    """(segment, shift): which of ``most`` + 1 segments may be found how far from its own place, after so many edits before it."""
    return [(j, s) for j in range(most + 1) for s in range(-j, j + 1)]


def _parts(gap: Column, j: Column, shift: Column) -> tuple[Column, Column, Column, Column]:
    """Start and end of segment ``j`` in the indexed line's gap, whether it can be found ``shift`` further on, and the gaps beside it.

    A gap is what lies open between agreed ends: its place and length in the indexed line, those in the line itself, and its edits.
    Of ``most`` + 1 segments one is intact with j edits before and the others behind it: the first up to whose end lie as few as j.
    """
    most, size, wide = gap["most"], gap["size"], gap["wide"]
    start, end = F.floor(size * j / (most + 1)).cast("int"), F.floor(size * (j + 1) / (most + 1)).cast("int")
    fits = (j <= most) & (F.abs(wide - size - shift) <= most - j) & (start + shift >= 0) & (end + shift <= wide)
    left = F.struct(gap["at"].alias("at"), start.alias("size"), gap["to"].alias("to"), (start + shift).alias("wide"), j.alias("most"))
    right = F.struct((gap["at"] + end).alias("at"), (size - end).alias("size"), (gap["to"] + end + shift).alias("to"), (wide - end - shift).alias("wide"), (most - j).alias("most"))
    return start, end, fits, F.filter(F.array(left, right), lambda g: g["most"] > 0)


def _whole(size: Column, wide: Column, most: int) -> Column:
    zero = F.lit(0)
    return F.struct(zero.alias("at"), size.cast("int").alias("size"), zero.alias("to"), wide.cast("int").alias("wide"), F.lit(most).alias("most"))


def _started(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """States of lines (id, line) that agree on nothing yet: each taken as a line of its own length, and as one up to ``edits`` shorter."""
    wide = _width(_coded(F.col("line")))
    roles = F.filter(F.array(*[F.struct((F.col("wide") - d).alias("size"), F.lit(d > 0).alias("probe")) for d in range(edits + 1)]), lambda r: r["size"] >= min_chars)
    return (lines.select("id", "line", wide.alias("wide")).select("id", "line", "wide", F.explode(roles).alias("r"))
            .select("id", "line", "r.probe", F.xxhash64("r.size").alias("key"), F.array(_whole(F.col("r.size"), F.col("wide"), edits)).alias("gaps")))


def _refined(states: DataFrame, edits: int) -> DataFrame:
    """Cut the longest gap of every state into segments, one more than its edits, and make a state of each place where one may be found.

    States are (id, line, probe, key, gaps); ``twin`` tells what is left before the segment, ``side`` whether that must differ.
    A line's own segments at their own places are indexed, all others are probes.
    """
    longest = F.array_max(F.transform("gaps", lambda g, i: F.struct((g["size"] - g["most"]).alias("spare"), (-i).alias("i"))))["i"]
    chosen = states.select("id", "line", "probe", "key", "gaps", _coded(F.col("line")).alias("coded"), (-longest).cast("int").alias("nth")).withColumn("gap", F.get("gaps", F.col("nth")))
    places = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(s).alias("s")) for j, s in _cuts(edits)])
    fitting = F.filter(places, lambda c: _parts(F.col("gap"), c["j"], c["s"])[2])
    cut = chosen.select("*", F.explode(fitting).alias("c"))
    j, shift, gap = F.col("c.j"), F.col("c.s"), F.col("gap")
    start, end, _, beside = _parts(gap, j, shift)
    rest = F.concat(F.filter("gaps", lambda g, i: i < F.col("nth")), beside, F.filter("gaps", lambda g, i: i > F.col("nth")))
    to = gap["to"] + shift
    return cut.select("id", "line", (F.col("probe") | (shift != 0)).alias("probe"), F.xxhash64("key", "nth", j, _piece(F.col("coded"), to + start, end - start)).alias("key"),
                      rest.alias("gaps"), (j > 0).alias("side"), F.xxhash64(_piece(F.col("coded"), gap["to"], start + shift)).alias("twin"))


def _among(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose ``on`` is among those of ``wanted`` (distinct, read from a written table), without a shuffle where these are few."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= SMALL_IDS else wanted, on, "left_semi")


def _first_keys(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(id, probe, key) of the first cut: what ``_refined(_started(lines))`` gives, without states.

    A row per place of a segment in a line of some length, from one list of places: so the generated code stays short enough to
    be compiled, and each line is coded and measured once.
    """
    size, wide, start, end, d, s = (F.col(c) for c in ("size", "wide", "start", "end", "d", "s"))
    places = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(j).alias("j"), F.lit(s).alias("s")) for d in range(edits + 1) for j, s in _cuts(edits) if abs(d - s) <= edits - j])
    placed = lines.select("id", _coded(F.col("line")).alias("coded")).select("id", "coded", _width(F.col("coded")).alias("wide")).select("*", F.inline(places))
    sized = placed.select("*", (wide - d).alias("size")).filter(size >= min_chars)
    cut = sized.select("*", *[F.expr(f"cast((size * {j}) div {edits + 1} as int)").alias(c) for c, j in (("start", "j"), ("end", "(j + 1)"))])
    fitting = cut.filter((start + s >= 0) & (end + s <= wide))
    return fitting.select("id", ((d > 0) | (s != 0)).alias("probe"), F.xxhash64(F.xxhash64("size"), F.lit(0), "j", _piece(F.col("coded"), start + s, end - start)).alias("key"))


def _starred(members: DataFrame, firsts: DataFrame) -> DataFrame:
    """Pairs (u, v) of groups in which nothing is left to cut, from (id, probe, key, sure); written out.

    Any two ``sure`` lines of a group are within the edits of each other, so all are later than the earliest one, or close to
    it: one pair each is enough. The others meet all indexed lines.
    """
    placed = members.join(firsts.groupBy("id").agg(F.min("first").alias("first")), "id")
    head = placed.filter("sure").groupBy("key").agg(F.min_by("id", "first").alias("a"))
    star = head.join(placed.filter("sure").select("key", F.col("id").alias("b")), "key")
    rest = members.filter("not probe").select("key", F.col("id").alias("a")).join(members.filter("not sure").select("key", F.col("id").alias("b")), "key")
    return write_out(star.unionByName(rest).filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())


def _candidates(lines: DataFrame, firsts: DataFrame, group: int, edits: int, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """Members (id, probe, key) of keys that few lines share, and pairs (u, v) of groups in which nothing is left to cut.

    Lines (id, line) may repeat. Every line that comes within ``edits`` of an earlier one shares a key with it, one of the two
    being no probe there, or is in a pair with such a line. Both results are written out.
    """
    # The lines' own keys are written; probes, most of the keys, pass the shuffle once, in which few of them meet an own key.
    keys = _first_keys(lines, edits, min_chars)
    own = write_out(keys.filter("not probe").select("id", "key"))
    probes = keys.filter("probe").select("id", "key")
    hits = write_out(probes.join(own.select("key").hint("shuffle_hash"), "key", "left_semi").distinct().select("id", F.lit(True).alias("probe"), "key"))
    twice = own.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("key")
    asked = write_out(twice.unionAll(hits.select("key")).distinct())
    met = write_out(_among(own, asked, ["key"]).distinct().select("id", F.lit(False).alias("probe"), "key").unionAll(hits))
    sizes = write_out(met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("key", "n"))
    found = [met.join(sizes.filter(F.col("n") <= group).select("key"), "key", "left_semi")]
    starred = [firsts.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0)]
    large = write_out(sizes.filter(F.col("n") > group).select("key"))
    states = None
    if large.take(1):
        ids = write_out(_among(met, large, ["key"]).select("id").distinct())  # only lines that share a large key are cut further
        states = _refined(_started(_among(lines, ids, ["id"]).dropDuplicates(["id", "line"]), edits, min_chars), edits)
    while states is not None:
        spare = F.array_max(F.transform("gaps", lambda g: g["size"] - g["most"]))
        sure = F.forall("gaps", lambda g: F.greatest(g["size"], g["wide"]) <= g["most"])
        own = write_out(_among(states, large, ["key"]).dropDuplicates(["id", "probe", "key", "gaps"]).withColumn("spare", spare).withColumn("sure", sure))
        facts = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("twin").alias("low"), F.max("twin").alias("high"), F.max("side").alias("side"), F.max("spare").alias("spare"))
        # Where all lines agree before the segment, though edits were to lie there, an earlier segment's key has the same pairs.
        facts = write_out(facts.filter("not (side and low = high)"))
        small, done = F.col("n") <= group, F.col("spare") <= 0
        members = own.select("id", "probe", "key", "sure")
        found.append(_among(members, facts.filter(small).select("key"), ["key"]).select("id", "probe", "key").distinct())
        if facts.filter(~small & done).take(1):
            starred.append(_starred(_among(members, facts.filter(~small & done).select("key"), ["key"]), firsts))
        hot = facts.filter(~small & ~done).select("key")
        if not hot.take(1):
            break
        states = _refined(write_out(_among(own, hot, ["key"]).select("id", "line", "probe", "key", "gaps")), edits)
        slim = states.select("id", "probe", "key").distinct()
        shared = write_out(slim.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("probe").alias("least"), F.min("id").alias("low"), F.max("id").alias("high"))
                           .filter("not least and low < high").select("key", "n"))
        found.append(_among(slim, write_out(shared.filter(F.col("n") <= group).select("key")), ["key"]))
        large = write_out(shared.filter(F.col("n") > group).select("key"))
        if not large.take(1):
            break
    return write_out(reduce(DataFrame.unionByName, found).distinct()), write_out(reduce(DataFrame.unionByName, starred).distinct())


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, copies_from: int = COPIES_FROM) -> DataFrame:
    """(doc_id, line_no, line, id, more): lines of at least ``min_chars`` characters and shorter ones of at least ``copies_from``
    that are not blank, with two hashes that identify their text."""
    size = F.length("line")
    slim = docs.select(name(key).alias("doc_id"), name(text).cast("string").alias("text")).filter("doc_id is not null")
    # the split inside the generator: as a column of its own it would be made anew for each filter that Spark infers from it
    return (slim.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter((size >= min_chars) | (size >= copies_from) & F.col("line").rlike(r"\S"))
            .select("doc_id", "line_no", "line", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("more")))


def _ring_marks(*counts: str) -> Column:
    """Up to 16 counts as 64 bits, of which any two rows differ in no more than their counts' differences add up to.

    Four bits a count, along a ring of eight marks: one more or less changes one bit. So a join compares two numbers, not all
    counts, and its code stays short enough to be compiled.
    """
    ring = F.array(*[F.lit(x) for x in (0, 1, 3, 7, 15, 14, 12, 8)])
    return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(F.get(ring, F.pmod(F.col(c), F.lit(8)).cast("int")).cast("long"), 4 * i) for i, c in enumerate(counts)])


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, group: int = GROUP, key: str = "doc_id", text: str = "text", edits: int = EDITS,
                   copies_from: int = COPIES_FROM) -> DataFrame:
    """(doc_id, removed): the numbers of the lines that repeat an earlier one or come within ``edits`` of it; written out.

    Lines under ``min_chars`` are removed as exact copies only, and blank ones or those under ``copies_from`` never.
    Documents without such lines have no row; rows with null keys or texts take no part; rows that share a key count as one
    document.
    """
    require(docs, key, text)
    if edits < 1:
        raise ValueError("edits must be at least 1")
    lines = lines_of(docs, key, text, min_chars, copies_from)
    firsts = write_out(lines.groupBy("id", "more").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n")))
    long_lines = lines.filter(F.length("line") >= min_chars)
    members, starred = _candidates(long_lines.select("id", "line"), firsts, group, edits, min_chars)
    ids = write_out(members.select("id").unionAll(starred.select(F.explode(F.array("u", "v")).alias("id"))).distinct())
    held = _among(long_lines.select("id", "more", "line"), ids, ["id"]).distinct()
    without = lambda group_: reduce(lambda rest, letter: F.replace(rest, F.lit(letter), F.lit("")), group_, F.col("line"))
    letters = [(F.octet_length("line") - F.octet_length(without(group_))).alias(f"c{i}") for i, group_ in enumerate(LETTERS)]  # a byte each
    texts = write_out(held.join(_among(firsts, ids, ["id"]), ["id", "more"]).select("*", F.length("line").alias("size"), *letters)
                      .withColumn("others", reduce(lambda x, y: x - y, [F.col(f"c{i}") for i in range(len(LETTERS))], F.col("size"))))

    counts = [*[f"c{i}" for i in range(len(LETTERS))], "others"]

    def alike(a: str, b: str) -> Column:
        """Cheap test that every pair within the edits passes: an edit changes two of the counts by one, or one of them and the length."""
        return reduce(lambda x, y: x + y, [F.abs(F.col(f"{c}_{a}") - F.col(f"{c}_{b}")) for c in ("size", *counts)]) <= 2 * edits

    def sided(rows: DataFrame, side: str, told: tuple[str, ...], *kept: str) -> DataFrame:
        return rows.select(*kept, F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("first", *told)])

    def late(pairs: DataFrame) -> DataFrame:
        """(id, more) of the later line of every pair within the edits; written out."""
        both = pairs
        for side in "uv":
            both = both.join(sided(texts, side, ("size", *counts), F.col("more").alias(f"more_{side}"), F.col("line").alias(f"line_{side}")), side)
        both = both.filter(alike("u", "v"))
        ahead = F.length("line_u") >= F.length("line_v")
        both = both.select("*", F.when(ahead, F.col("line_u")).otherwise(F.col("line_v")).alias("long"), F.when(ahead, F.col("line_v")).otherwise(F.col("line_u")).alias("short"))
        links = both.filter(edit_distance(F.col("long"), F.col("short"), edits) <= edits)
        later_is_u = F.col("first_u") > F.col("first_v")
        return write_out(links.select(F.when(later_is_u, F.col("u")).otherwise(F.col("v")).alias("id"), F.when(later_is_u, F.col("more_u")).otherwise(F.col("more_v")).alias("more")).distinct())

    # A line needs one earlier line that is close: first each key's earliest line is tried, then, for lines it did not settle,
    # all earlier lines of their keys. So a group of near copies makes few pairs, not all.
    listed = lambda c: F.slice(F.array_sort(F.collect_set(c)), 1, LISTED)
    lists = members.groupBy("id").agg(listed(F.col("key")).alias("keys"), listed(F.when(~F.col("probe"), F.col("key"))).alias("own"))
    placed = write_out(members.join(lists, "id").join(texts.select("id", "first", _ring_marks("size", *counts).alias("marks")), "id"))
    heads = placed.groupBy("key").agg(F.min_by("id", "first").alias("a"))
    ordered_pair = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    star = heads.join(members.select("key", F.col("id").alias("b")), "key").filter("a <> b").select(*ordered_pair("a", "b"))
    tried = write_out(star.unionByName(starred).distinct())
    settled = late(tried)
    open_ids = write_out(texts.select("id", "more").join(settled, ["id", "more"], "left_anti").select("id").distinct())
    open_lines = sided(_among(placed, open_ids, ["id"]), "b", ("marks",), "key", F.col("probe").alias("probe_b"), F.col("keys").alias("keys_b"), F.col("own").alias("own_b"))
    met = F.array_min(F.concat(F.array_intersect("own", "keys_b"), F.array_intersect("keys", "own_b")))  # a key of both, one of them no probe
    close = F.bit_count(F.col("marks_a").bitwiseXOR(F.col("marks_b"))) <= 2 * edits
    rest = (sided(placed, "a", ("marks",), "key", "probe", "keys", "own").join(open_lines, "key").filter("a <> b AND first_a < first_b AND NOT (probe AND probe_b)").filter(close)
            .filter(F.coalesce(met, F.col("key")) >= F.col("key")).select(*ordered_pair("a", "b")))
    late_lines = settled.unionByName(late(write_out(rest.distinct().join(tried, ["u", "v"], "left_anti")))).distinct()
    copied = firsts.filter("n > 1").select("id", "more", "first")
    doomed = write_out(copied.join(late_lines.withColumn("late", F.lit(True)), ["id", "more"], "full_outer"))  # first: the place that stays, unless late
    places = lines.select("doc_id", "line_no", "id", "more")
    gone = (places.join(doomed, ["id", "more"])
            .filter(F.col("late").isNotNull() | (F.struct("doc_id", "line_no") != F.col("first"))))
    return write_out(gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("removed")))


def _kept_text(text: Column, removed: Column) -> Column:
    lines = F.split(text, "\n")
    return F.when(removed.isNull(), text).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(removed, i)), "\n"))


def dedup_lines(docs: DataFrame, removed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with their text less the removed lines, all columns kept; a null text stays null."""
    own, lost = fresh("key"), fresh("removed")
    gone = removed.select(F.col("doc_id").alias(own), F.col("removed").alias(lost))
    joined = docs.join(gone.hint("merge"), name(key) == F.col(own), "left")  # the list of removed lines grows with the corpus: never broadcast
    return joined.select(*[_kept_text(name(c), F.col(lost)).alias(c) if c == text else name(c) for c in docs.columns])


def line_report(docs: DataFrame, removed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key as ``doc_id``, ``n_lines``, ``n_removed``, ``kept_chars`` and ``kept_sha256`` (hex) of what is left; a null text has no lines."""
    own, lost = fresh("key"), fresh("removed")
    gone = removed.select(F.col("doc_id").alias(own), F.col("removed").alias(lost))
    body = F.coalesce(name(text).cast("string"), F.lit(""))
    kept = docs.join(gone.hint("merge"), name(key) == F.col(own), "left").select(
        name(key).alias("doc_id"), F.coalesce(F.when(name(text).isNotNull(), F.size(F.split(name(text).cast("string"), "\n"))), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col(lost).isNull(), 0).otherwise(F.size(lost)).cast("long").alias("n_removed"), _kept_text(body, F.col(lost)).alias("kept"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("kept").cast("long").alias("kept_chars"), F.sha2("kept", 256).alias("kept_sha256"))
