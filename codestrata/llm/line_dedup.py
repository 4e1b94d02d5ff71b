"""Fuzzy line dedup by MinHash, in DataFrame operations only.

Equal lines are one from the start. Every distinct line has its set of character shingles
(``Q`` characters; a shorter line is one shingle). The hash of a shingle deals it to one of
``BANDS`` bins, and a bin keeps the minima of its hashes in ``ROWS`` orders, which are those
of the hash turned by 16 bits each. Lines that agree in all minima of a bin meet in a bucket.
The share of common shingles varies from bin to bin around that of the lines, and the mean
of its fourth power is no less than the power of the mean: a pair of similarity 0.8 meets
with probability 0.985 at least, as with independent minima, short lines more often.
In a bucket the smallest line is the centre and the others are compared with it, by the
exact Jaccard similarity of the sets. These links join components over all buckets. Then
every two lines of a bucket that still lie in different components are compared: first, of
each line and component, the likeliest pair, and after another join all. So the components
are those of all similar pairs that share a bucket. A bucket that holds one family of lines
is settled by about as many comparisons as it has lines. Two tests come before a comparison:
a sketch of the minima, and bits set by the shingles. Two lines differ by at least as many
shingles as bits, so that no similar pair fails by those.
Links of at least ``SIMILAR`` join components, found by distributed union of stars. The
first line of a component, by doc_id and line number, stays.

Lines end at line feeds. Blank lines always stay. Null texts have no lines, empty ones
have one that is blank. A null doc_id counts as -1 where lines are ordered. Rows that
repeat a doc_id share the places of their lines: what stays in one, stays in each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import SMALL, attach, parts
from codestrata.llm.components import components
from codestrata.session import cut_lineage, release

Q = 8
BANDS = 8
ROWS = 4
SIMILAR = 0.8

#: Bytes of a sketch in one number.
LANES = 7

#: Of similar lines so large a share of the minima agrees; at 0.8 fewer do in one case of 700.
AGREEING = 0.5625

#: Numbers of 64 bits that the shingles of a bin set bits in.
WORDS = 8

#: Distinct shingles of a line from which on the sketch decides.
FEW = 100

#: Lines of a bucket that meet each line of it in one task, on average.
BLOCK = 1024

#: Pairs whose shingles are compared in one task, on average.
TASK_PAIRS = 5_000

#: Comparisons of sketches and bits in one task, on average.
TASK_MEETINGS = 2_000_000

#: Distinct lines signed by one task, on average; their bins fit Spark's fast map of 65,536 groups.
TASK_LINES = 8_000


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of all lines that are not blank."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(F.length(F.trim(F.translate("line", "\t\r\x0b\x0c", "    "))) > 0)


def _place() -> Column:
    """doc_id and line number as one number that sorts like them."""
    return (F.coalesce("doc_id", F.lit(-1)).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no")).cast("decimal(35,0)")


def distinct_lines(found: DataFrame) -> DataFrame:
    """A row for each distinct line: hash, first place and number of occurrences."""
    grouped = found.select("line", _place().alias("place")).groupBy("line").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    return grouped.select(F.xxhash64("line").alias("h"), "line", "place", "n")


def _code_points(line: Column) -> Column:
    """Four bytes for each character, so that a shingle is found by its place."""
    return F.encode(line, "UTF-32")


def _last_shingle(points: Column) -> Column:
    return F.greatest((F.octet_length(points) / 4).cast("int") - Q, F.lit(0))


def _binned(lines: DataFrame) -> DataFrame:
    """(h, x, bin): hash and bin of each shingle, repeats included; the rows of a line are in one partition."""
    tasks = parts(lines.count(), TASK_LINES)
    dealt = lines.select("h", "line").repartition(tasks, "h").select("h", _code_points(F.col("line")).alias("points"))
    each = dealt.select("h", "points", F.explode(F.sequence(F.lit(0), _last_shingle(F.col("points")))).alias("i"))
    hashed = each.select("h", F.xxhash64(F.substring("points", F.col("i") * 4 + 1, 4 * Q)).alias("x"))
    return hashed.select("h", "x", F.col("x").bitwiseAND(F.lit(BANDS - 1)).alias("bin"))


def _minima() -> list[Column]:
    return [F.min(_turned(F.col("x"), k)).alias(f"m{k}") for k in range(ROWS)]


def _of_bins(*facts: str) -> list[Column]:
    """Facts of the bins of a line side by side, fact0 to fact7."""
    return [F.max(F.when(F.col("bin") == b, F.col(c))).alias(f"{c}{b}") for c in facts for b in range(BANDS)]


def bands(lines: DataFrame) -> DataFrame:
    """(h, keys): for every line the bucket of each band. A bin without shingles has a bucket of its own."""
    bins = _binned(lines).groupBy("h", "bin").agg(*_minima())
    bins = bins.select("h", "bin", F.xxhash64("bin", *[f"m{k}" for k in range(ROWS)]).alias("key"))
    keys = [F.coalesce(f"key{b}", F.xxhash64(F.lit(b), "h")) for b in range(BANDS)]
    return bins.groupBy("h").agg(*_of_bins("key")).select("h", F.array(*keys).alias("keys"))


def marks(lines: DataFrame) -> DataFrame:
    """(h, mark): what tells chance meetings: bits set by the shingles, bytes of the minima, seven to a number, and the number of distinct shingles."""
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(x, 40) & 63 as int))")
    word = F.shiftrightunsigned("x", 46).bitwiseAND(F.lit(WORDS - 1))
    bits = [F.bit_or(F.when(word == w, bit)).alias(f"w{w}_") for w in range(WORDS)]
    bins = _binned(lines).distinct().groupBy("h", "bin").agg(*_minima(), *bits, F.count(F.lit(1)).alias("n"))
    some = [F.shiftleft(F.shiftright(f"m{k}", 20).bitwiseAND(F.lit(255)), 8 * k) for k in range(ROWS)]
    bins = bins.select("h", "bin", *[f"w{w}_" for w in range(WORDS)], "n", reduce(lambda x, y: x.bitwiseOR(y), some).alias("some"))
    signed = bins.groupBy("h").agg(F.sum("n").alias("n"), *_of_bins("some", *[f"w{w}_" for w in range(WORDS)]))
    lane = [F.shiftright(F.coalesce(f"some{k // ROWS}", F.lit(0)), 8 * (k % ROWS)).bitwiseAND(F.lit(255)) for k in range(BANDS * ROWS)]
    sketch = [reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(lane[k], 8 * (k - at)) for k in range(at, min(at + LANES, BANDS * ROWS))])
              for at in range(0, BANDS * ROWS, LANES)]
    words = [F.coalesce(f"w{w}_{b}", F.lit(0)) for w in range(WORDS) for b in range(BANDS)]
    return signed.select("h", F.struct(*[x.alias(f"s{i}") for i, x in enumerate(sketch)], *[x.alias(f"b{i}") for i, x in enumerate(words)],
                                       "n").alias("mark"))


def _ones(numbers: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(x) for x in numbers])


def _turned(x: Column, k: int) -> Column:
    """A hash turned by ``k`` times 16 bits."""
    return F.shiftleft(x, 16 * k).bitwiseOR(F.shiftrightunsigned(x, 64 - 16 * k)) if k else x


def _agreeing(a: Column, b: Column) -> Column:
    """Number of minima whose bytes are the same in two marks."""
    low, ones = int("7f" * LANES, 16), int("80" * LANES, 16)
    count = F.lit(0)
    for i in range(-(-BANDS * ROWS // LANES)):
        x = a[f"s{i}"].bitwiseXOR(b[f"s{i}"])
        differ = (x.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(x).bitwiseAND(F.lit(ones))
        count = count + F.lit(min(LANES, BANDS * ROWS - i * LANES)) - F.bit_count(differ)
    return count


def _shingles(line: Column) -> Column:
    """Hashes of the distinct shingles. The code points are bound to a variable, so that they are made once."""
    def cut(points: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), _last_shingle(points)),
                                            lambda i: F.xxhash64(F.substring(points, i * 4 + 1, 4 * Q))))

    return F.transform(F.array(_code_points(line)), cut)[0]


def _similarity(a: str, b: str) -> Column:
    """Jaccard similarity of the shingles of two lines. The sets are bound to a variable, so that each is made once."""
    def jaccard(p: Column) -> Column:
        both = F.size(F.array_intersect(p["x"], p["y"]))
        return both / (F.size(p["x"]) + F.size(p["y"]) - both)

    sets = F.struct(_shingles(F.col(a)).alias("x"), _shingles(F.col(b)).alias("y"))
    return F.transform(F.array(sets), jaccard)[0]


def _with_both(pairs: DataFrame, table: DataFrame, fact: str) -> DataFrame:
    """Adds the ``fact`` that ``table(h, ...)`` has of each line of pairs (a, b); an ``a`` may be in many pairs."""
    own = table.select("h", fact)
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n_pairs"))
    centres = cut_lineage(sizes.join(own, sizes["a"] == own["h"]).select("a", "n_pairs", F.col(fact).alias(f"{fact}_a")))
    theirs = pairs.join(own, pairs["b"] == own["h"]).select(*pairs.columns, F.col(fact).alias(f"{fact}_b"))
    return attach(theirs, centres, "a", "n_pairs", pairs.count(), F.col("b")).drop("n_pairs")


def _likely(a: Column, b: Column, similar: float) -> Column:
    """Two marks whose lines may be similar.

    No similar pair has more unlike bits than this, or sizes so unlike. Few shingles to a bin agree too unevenly for the sketch.
    """
    sizes = F.least(a["n"], b["n"]) >= F.greatest(a["n"], b["n"]) * F.lit(similar) - F.lit(1e-6)
    unlike = _ones([a[f"b{i}"].bitwiseXOR(b[f"b{i}"]) for i in range(WORDS * BANDS)])
    near = unlike * F.lit(1 + similar) <= (a["n"] + b["n"]) * F.lit(1 - similar) + F.lit(1e-6)
    agree = _agreeing(a, b) >= int(AGREEING * BANDS * ROWS * similar / SIMILAR)
    return sizes & ((F.least(a["n"], b["n"]) < FEW) | agree) & near


def verified(pairs: DataFrame, facts: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) of line hashes whose lines are similar; ``facts`` has the lines."""
    both = _with_both(pairs, facts, "line").repartition(parts(pairs.count(), TASK_PAIRS))
    return cut_lineage(both.filter(_similarity("line_a", "line_b") >= similar).select("a", "b").distinct())


def links(lines: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Links (a, b) between hashes of similar lines, which connect all that are similar and share a bucket."""
    return _linked(lines, similar)[0]


def _linked(lines: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """Links of similar lines, and (node, component) of what they connect."""
    signed = cut_lineage(bands(lines))
    every = signed.select("h", F.explode("keys").alias("key"))
    shared = cut_lineage(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    total, buckets = shared.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    members = cut_lineage(attach(every, shared, "key", "n", total, F.col("h"), n_groups=buckets).filter("n is not null").select("key", "h", "n"))
    release(signed, shared)
    # lines that share a bucket with others, with what comparisons need
    company = cut_lineage(members.groupBy(F.col("h").alias("_h")).agg(F.sum("n").alias("weight")))
    few = F.broadcast(company) if company.count() <= SMALL else company
    own = cut_lineage(lines.join(few, F.col("h") == F.col("_h"), "left_semi").select("h", "line"))
    marked = marks(own).withColumnRenamed("h", "_h")
    facts = cut_lineage(own.join(marked, F.col("h") == F.col("_h")).select("h", "mark", "line"))
    # all with one centre of each bucket: the line that meets most others, then the one that is similar to most
    tried = _near(_to_centre(members, company, None), facts, similar)
    found = verified(tried, facts, similar)
    linked = cut_lineage(components(found))
    members = members.filter("n > 2")  # two have been compared
    known = found.select("a").union(found.select("b")).groupBy(F.col("a").alias("_h")).agg(F.count(F.lit(1)).alias("weight"))
    for last in (False, True):
        if not last:
            apart = _near(_to_centre(members, known, linked), facts, similar)
        else:  # then all that still lie apart
            apart = _apart(members, facts, linked, similar).distinct()
        more = cut_lineage(apart.join(tried.select(F.col("a").alias("_a"), F.col("b").alias("_b")), F.expr("a = _a and b = _b"), "left_anti"))
        new = verified(more, facts, similar)
        found, tried, linked = found.union(new), tried.union(more), _joined(linked, new)
    release(company, own)
    return found, linked


def _to_centre(members: DataFrame, weights: DataFrame, linked: DataFrame | None) -> DataFrame:
    """Pairs (a, b) of every line with the heaviest one of each of its buckets, unless they are connected."""
    rows = members.select("key", "h").join(weights, F.col("h") == F.col("_h"), "left").select("key", "h", F.coalesce("weight", F.lit(0)).alias("weight"))
    root = F.col("h")
    if linked is not None:
        rows, root = rows.join(linked, F.col("h") == F.col("node"), "left"), F.coalesce("component", "h")
    rows = cut_lineage(rows.select("key", "h", "weight", root.alias("root")))
    centres = cut_lineage(rows.groupBy("key").agg(F.expr("max_by(struct(h, root), struct(weight, h))").alias("c"), F.count(F.lit(1)).alias("n")).select(
        "key", F.col("c.h").alias("centre"), F.col("c.root").alias("its"), "n"))
    total, buckets = centres.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    met = attach(rows, centres, "key", "n", total, F.col("h"), n_groups=buckets).filter("root <> its")
    pairs = cut_lineage(met.select(F.least("h", "centre").alias("a"), F.greatest("h", "centre").alias("b")).distinct())
    release(rows, centres)
    return pairs


def _near(pairs: DataFrame, facts: DataFrame, similar: float) -> DataFrame:
    """The pairs that may be similar by their marks."""
    a, b = F.col("mark_a"), F.col("mark_b")
    return cut_lineage(_with_both(pairs, facts, "mark").filter(_likely(a, b, similar)).select("a", "b"))


def _joined(linked: DataFrame, new: DataFrame) -> DataFrame:
    """Components after ``new`` links: those of the old components, each by its smallest node."""
    of = linked.select(F.col("node").alias("_node"), F.col("component").alias("_c"))
    at = new.join(of, F.col("a") == F.col("_node"), "left").select(F.coalesce("_c", "a").alias("a"), "b")
    at = at.join(of, F.col("b") == F.col("_node"), "left").select("a", F.coalesce("_c", "b").alias("b"))
    merged = cut_lineage(components(at).select(F.col("node").alias("_old"), F.col("component").alias("_new")))
    moved = linked.join(merged, F.col("component") == F.col("_old"), "left").select("node", F.coalesce("_new", "component").alias("component"))
    alone = merged.join(linked, F.col("_old") == F.col("node"), "left_anti").select(F.col("_old").alias("node"), F.col("_new").alias("component"))
    return cut_lineage(moved.union(alone))


def _apart(members: DataFrame, facts: DataFrame, linked: DataFrame, similar: float) -> DataFrame:
    """(a, b): likely pairs of a bucket that lie in different components.

    In a bucket all lines but those of its largest component are minor. They are dealt in
    blocks of about ``BLOCK``, and every line of the bucket meets every block. Two lines of
    different components are never both in the largest, so no pair is left out. What meets
    is tested inside the join, so that only likely pairs become rows.
    """
    named = facts.select("h", "mark").join(linked, F.col("h") == linked["node"], "left").select(
        F.col("h").alias("_h"), "mark", F.coalesce("component", "h").alias("root"))
    placed = cut_lineage(members.join(named, F.col("h") == F.col("_h")).select("key", "h", "root", "mark"))
    sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.expr("max_by(root, struct(n, root))").alias("main"), F.max("n").alias("most"))
    mixed = cut_lineage(mixed.filter("n > most").select("key", "n", "main", (F.col("n") * (F.col("n") - F.col("most"))).alias("meetings"),
                                                        F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("blocks")))
    total, buckets, meetings = mixed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("meetings"), F.lit(0))).first()
    open_ = cut_lineage(attach(placed, mixed, "key", "n", total, F.col("h"), n_groups=buckets).filter("main is not null").drop("meetings"))
    block = F.xxhash64("key", F.col("block"))
    tasks = max(parts(meetings, TASK_MEETINGS), parts(total, TASK_LINES))
    dealt = open_.select("h", "root", "mark", "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = dealt.select("h", "root", "mark", block.alias("at")).repartition(tasks, "at")
    minor = open_.filter("root <> main").withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    minor = minor.select(F.col("h").alias("minor"), F.col("root").alias("of"), F.col("mark").alias("its"), block.alias("_at")).repartition(tasks, "_at")
    a, b = F.col("mark"), F.col("its")
    maybe = (F.col("at") == F.col("_at")) & (F.col("root") != F.col("of")) & _likely(a, b, similar)
    return dealt.join(minor.hint("merge"), maybe).select(F.least("h", "minor").alias("a"), F.greatest("h", "minor").alias("b"))


def duplicate_lines(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, line_no, keep_place): every line that is not the first of its component, and the place of that one."""
    found = occurrences(docs)
    lines = cut_lineage(distinct_lines(found))
    linked = _linked(lines, similar)[1]
    facts = lines.select("h", "place", "n").join(linked, F.col("h") == linked["node"], "left").withColumn(
        "root", F.coalesce("component", "h")).filter("component is not null or n > 1")
    facts = cut_lineage(facts.select("h", "place", "n", "root"))
    firsts = facts.groupBy("root").agg(F.min("place").alias("keep_place"), F.count(F.lit(1)).alias("n_lines"))
    total = facts.count()
    named = cut_lineage(attach(facts, firsts, "root", "n_lines", total, F.col("h")).select("h", "n", "keep_place"))
    rows = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    mine = found.select("doc_id", "line_no", F.xxhash64("line").alias("h"), _place().alias("place"))
    met = attach(mine, named, "h", "n", rows, F.struct("doc_id", "line_no"))
    return met.filter(F.col("keep_place") != F.col("place")).select("doc_id", "line_no", "keep_place")


def decisions(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, n_lines, n_dropped and dropped (line numbers from 0): a row for each document."""
    gone = duplicate_lines(docs, similar).groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))
    gone = gone.withColumnRenamed("doc_id", "_id")
    size = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    size = size.withColumn("n_lines", F.greatest("n_lines", F.lit(0)).cast("long"))
    joined = size.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"))


def without_duplicate_lines(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Documents with the dropped lines taken out of their texts."""
    gone = decided.filter("n_dropped > 0").select(F.col("doc_id").alias("_id"), F.col("dropped").alias("_gone"))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_gone", i)), "\n")
    return joined.select(*[F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else docs[c]
                           for c in docs.columns])
