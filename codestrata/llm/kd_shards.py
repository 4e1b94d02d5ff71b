"""Sharding by a k-d tree over document metadata.

A node of the tree is split at the weighted median (by bytes) along its widest
dimension, until every leaf is one shard and holds about the target bytes. The law
is ``bytes``: at every cut the row boundary nearest to the wanted share is taken, so
the two sides miss it by at most half of one row.

Dimensions are whole numbers: bytes and characters of the text on a logarithmic
scale, and codes of language and source. The spread of a node along a dimension counts
relative to the spread of all rows; ties go to the dimension named first. Rows are
ordered along a dimension by its value, then by a digest of doc_id, then by a number that
each row gets when the table is written, so that one value, or one doc_id, held by a third
of all rows is cut like any other range. Slots go by a digest of that number.

Medians are exact and distributed: histograms of a fixed number of bins close in on the
cut for all nodes of a level at once, and the last few thousand rows around it are
compared directly. Nulls: text counts as empty, language and source as "", doc_id as none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import parts
from codestrata.session import cut_lineage

SHARDS = 16

#: Histogram bins of a node in each pass.
BINS = 2048

#: With so few rows left around a cut of a node, they are compared directly on the driver.
FEW = 4096

#: Rows numbered together by one task, on average.
SLOT_ROWS = 20_000

#: Values of a row's place along a dimension: the dimension, then these.
TIES = ("tie", "row")


def describe(docs: DataFrame) -> DataFrame:
    """Size, checksum and dimensions of each document, with a number for each row: write the table before it is used twice."""
    digest = lambda c: F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long")
    code = lambda c: F.crc32(F.encode(F.coalesce(c, F.lit("")), "utf-8"))
    return docs.select(
        "doc_id", (size + 1).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.floor(F.log2(size + 1) * 1024).cast("long").alias("d0"),
        code("lang").alias("d1"), code("source").alias("d2"),
        F.floor(F.log2(F.length(text) + 1) * 1024).cast("long").alias("d3"),
        digest(F.coalesce("doc_id", F.lit(-1))).alias("tie"), F.monotonically_increasing_id().alias("row")).withColumn(
        "deal", digest(F.col("row")))


DIMENSIONS = ("d0", "d1", "d2", "d3")


@dataclass
class Cut:
    """Where a node is split: rows up to ``at`` along ``dim`` go left."""

    dim: str
    left: int  # shards on the left
    shards: int
    want: float  # bytes wanted on the left
    fixed: tuple = ()  # leading values of the cut that are settled
    low: int = 0
    high: int = 0
    below: int = 0  # bytes before the range that is searched
    at: tuple | None = None
    rows: int = field(default=0)


def _first_shards(docs: DataFrame, node: str = "node") -> dict[int, dict]:
    spans = [f(d).alias(f"{n}_{d}") for d in DIMENSIONS for f, n in ((F.min, "min"), (F.max, "max"))]
    return {r[node]: r.asDict() for r in docs.groupBy(node).agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), *spans).collect()}


def kd_shards(described: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds ``shard``, 0 to ``shards`` - 1. ``described`` is a written table as ``describe`` makes it.

    Nodes carry the first shard of their range as their number; at most ``shards`` of
    them exist, which bounds what the driver and broadcast tables hold.
    """
    rows = described.withColumn("node", F.lit(0))
    width = {0: shards}
    overall = None
    while any(w > 1 for w in width.values()):
        stats = _first_shards(rows)
        overall = overall or stats.get(0)
        cuts: dict[int, Cut] = {}
        for node, w in width.items():
            if w > 1 and node in stats:
                s = stats[node]
                spread = [(s[f"max_{d}"] - s[f"min_{d}"]) / max(1, overall[f"max_{d}"] - overall[f"min_{d}"]) for d in DIMENSIONS]
                dim = DIMENSIONS[spread.index(max(spread))]
                cuts[node] = Cut(dim, w // 2, w, s["bytes"] * (w // 2) / w, low=s[f"min_{dim}"], high=s[f"max_{dim}"], rows=s["rows"])
        if not cuts:
            break
        _find(rows, cuts)
        rows = _split(rows, cuts)
        width = {n: x for node, w in width.items() for n, x in
                 (((node, w // 2), (node + w // 2, w - w // 2)) if w > 1 else ((node, w),))}
    return rows.withColumnRenamed("node", "shard")


def _table(rows: DataFrame, values: list[tuple], schema: str) -> DataFrame:
    """A few values for each node that is being split, as a broadcast table."""
    return F.broadcast(rows.sparkSession.createDataFrame(values, schema))


def _keyed(rows: DataFrame, cuts: dict[int, Cut]) -> DataFrame:
    dims = _table(rows, [(n, DIMENSIONS.index(c.dim)) for n, c in cuts.items()], "node int, _dim int")
    value = F.element_at(F.array(*DIMENSIONS), F.col("_dim") + 1)
    return rows.join(dims, "node").withColumn("_v", value)


def _find(rows: DataFrame, cuts: dict[int, Cut]) -> None:
    """Sets ``at`` of every cut."""
    keyed = _keyed(rows, cuts)
    names = ("_v", *TIES)
    while open_ := {n: c for n, c in cuts.items() if c.at is None and c.rows > FEW}:
        live = [(n, len(c.fixed), *_padded(c.fixed), c.low, (c.high - c.low) // BINS + 1) for n, c in open_.items()]
        found = keyed.join(_table(rows, live, "node int, _k int, _f0 long, _f1 long, _low long, _step long"), "node")
        now = F.element_at(F.array(*names), F.col("_k") + 1)
        found = found.filter(_inside(names)).withColumn("_now", now).withColumn("_bin", F.floor((F.col("_now") - F.col("_low")) / F.col("_step")))
        found = found.filter(f"_bin between 0 and {BINS - 1}")
        bins: dict[int, list] = {}
        for r in found.groupBy("node", "_bin").agg(F.sum("size"), F.count(F.lit(1)), F.min("_now"), F.max("_now")).collect():
            bins.setdefault(r[0], []).append(tuple(r)[1:])
        for n, c in open_.items():
            for _, size, count, low, high in sorted(bins[n]):
                if c.below + size >= c.want:
                    break
                c.below += size
            c.rows, c.low, c.high = count, low, high
            if low == high:  # one value: go on with the next part of the order
                if len(c.fixed) == len(names) - 1:
                    c.at = (*c.fixed, low)
                else:
                    c.fixed, c.low, c.high = (*c.fixed, low), 0, (1 << 60)
                    if len(c.fixed) == 2:
                        c.low, c.high = -(1 << 62), (1 << 62)
    few = {n: c for n, c in cuts.items() if c.at is None}
    if few:
        live = [(n, len(c.fixed), *_padded(c.fixed), c.low, c.high) for n, c in few.items()]
        found = keyed.join(_table(rows, live, "node int, _k int, _f0 long, _f1 long, _low long, _high long"), "node")
        now = F.element_at(F.array(*names), F.col("_k") + 1)
        left: dict[int, list] = {}
        for r in found.filter(_inside(names)).filter(now.between(F.col("_low"), F.col("_high"))).select("node", *names, "size").collect():
            left.setdefault(r[0], []).append(tuple(r)[1:])
        for n, c in few.items():
            mine, so_far = sorted(left[n]), c.below
            for *place, size in mine:
                # the boundary before this row is nearer than the one behind it
                if so_far + size - c.want > c.want - so_far and so_far + size > c.want:
                    break
                so_far, c.at = so_far + size, tuple(place)
            if c.at is None:  # nothing of this range goes left
                c.at = (*mine[0][:-2], mine[0][-2] - 1)


def _padded(fixed: tuple) -> tuple[int, int]:
    return (*fixed, 0, 0)[:2]


def _inside(names: tuple[str, ...]) -> Column:
    """Rows that have the settled leading values of their node's cut."""
    first, second = F.col(names[0]) == F.col("_f0"), F.col(names[1]) == F.col("_f1")
    return (F.col("_k") < 1) | (first & ((F.col("_k") < 2) | second))


def _split(rows: DataFrame, cuts: dict[int, Cut]) -> DataFrame:
    values = [(n, DIMENSIONS.index(c.dim), c.left, *c.at) for n, c in cuts.items()]
    at = _table(rows, values, "node int, _dim int, _left int, _a long, _b long, _c long")
    value = F.element_at(F.array(*DIMENSIONS), F.col("_dim") + 1)
    right = (value > F.col("_a")) | ((value == F.col("_a")) & ((F.col("tie") > F.col("_b")) | (
        (F.col("tie") == F.col("_b")) & (F.col("row") > F.col("_c")))))
    moved = rows.join(at, "node", "left")
    return moved.withColumn("node", F.when(F.coalesce(right, F.lit(False)), F.col("node") + F.col("_left"))
                            .otherwise(F.col("node")).cast("int")).select(*rows.columns)


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard, in the order of the digest of the row number.

    Rows are numbered in ranges of the digest and the counts of the ranges before are added;
    no task sees a whole shard.
    """
    ranges = parts(rows.count(), SLOT_ROWS)
    rows = rows.withColumn("_range", F.floor(F.col("deal") / F.lit(-(-(1 << 60) // ranges))).cast("int"))
    counts = rows.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = _before(counts)
    numbered = rows.withColumn("_row", F.expr(
        "row_number() over (partition by shard, _range order by deal, row)"))
    return numbered.join(before, ["shard", "_range"]).withColumn("slot", F.col("_before") + F.col("_row") - 1)


def _before(counts: DataFrame) -> DataFrame:
    """Rows in the ranges before each range; a window over the ranges of one shard."""
    return counts.select("shard", "_range", F.expr(
        "sum(_n) over (partition by shard order by _range) - _n").alias("_before"))


def op2(docs: DataFrame) -> DataFrame:
    rows = cut_lineage(describe(docs))
    placed = cut_lineage(kd_shards(rows))
    return with_slots(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                     F.lit(None).cast("int").alias("grown_shard"))
