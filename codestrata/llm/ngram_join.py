"""Jaccard join of documents on their word shingles: size-banded tiles, bitmap signatures, exact intersections.

Words are runs of characters other than ASCII white space, with A-Z lower-cased. The set of
a document holds its distinct shingles of ``N`` words; with fewer words the whole sequence
is the one shingle, without words the set is empty and linked with nothing. Two documents
link when ``100 * intersection >= PERCENT * union``. Equal sets are one from the start.

1. A histogram of shingle hashes over all documents, in ``BUCKETS`` buckets, orders shingles
   from rare to frequent. Any order would give the same links; this one keeps tiles small.
2. Two sets that link share one of their first shingles in this order: one of the first
   ``n - ceil(0.85 n) + 1`` of both, and of still fewer of the smaller. Rows for these go to
   the tile of the shingle, in the order of set size, so that each meets only the band of
   sizes that it can link with. A row carries a bitmap of ``BITS`` bits, the parities of the
   set's hashes. The bits in which two bitmaps differ are at most the shingles that are in
   one set only; so their count bounds the overlap from above, and most pairs end here.
   A bitmap says little about a set much larger than itself. So a set of ``SECTION`` shingles
   or more is cut by hash into 2, 4, 8, ... sections of about that size, each with rows and a bitmap
   of its own: if two sets link, then the sections of one hash in both reach the bound too.
   Pairs that pass are joined into classes, by a spanning forest of each tile.
3. The hashes of the sets that are in a class, and of no others, are moved: each set once, to
   its class. There the bitmaps are compared again and what passes is intersected exactly,
   but for pairs that links already connect. Links join components.

Hot groups: equal sets are dropped where they are read before they are shuffled. A shingle
of so frequent a bucket that its tile could hold over a thousandth of all documents has no
tile: its rows name a node for the shingle and the band of sizes, which joins them into one
class (a set whose first shingles are that frequent consists of such shingles by 85 %). In a
tile of over ``TILE`` rows those beyond it are joined with their neighbours in size. Classes are only
candidates, so joining too many is harmless. A class of many members or bytes is cut into
blocks: first all blocks meet block 0; the members that then lie outside the largest
component meet all others, block by block. So no task holds more than two blocks.

Shingles are compared by 64-bit hashes within a pair (an error needs a collision between
these two documents), equal sets by a digest of 128 bits.

A null text has no words. A null doc_id takes part, but names a component only if no other row
of it has an id. Rows that repeat a doc_id or a text are a row each. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import attach, parts, segments, ship, slices
from codestrata.llm.components import components
from codestrata.session import cut_lineage, release

N = 4
PERCENT = 85

#: Buckets of the histogram of shingles: what is broadcast is 4 bytes for each, whatever the data.
BUCKETS = 1 << 18

#: Bits of a signature in tiles, and inside a class.
BITS, WIDE = 64, 2048

#: Least size, on average, of the sections of a large set; with twice as many shingles it has twice as many.
SECTION = 64

#: Rows of a tile, or members of a block, that are compared at a time; bytes of hashes of a block.
TILE, BLOCK, BLOCK_BYTES = 2048, 2048, 24 << 20

#: Tile rows and class members of one task, on average.
TASK_ROWS, TASK_MEMBERS = 500_000, 4_000

#: Digests of sets that a task remembers, to drop copies before they are shuffled.
SEEN = 200_000

#: Words that a task remembers the hash of, none longer than 64 bytes.
WORDS = 200_000

#: Bits of the filter that tells which sets are in a class.
FILTER = 1 << 23


class _Words(dict):
    """Hash of each word; bounded."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= WORDS:
                self.clear()
            self[word] = h
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(data: bytes | None, known: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    words = [np.fromiter(map(known.__getitem__, w), np.uint64, len(w)) for p in segments((data or b"").lower()) if (w := p.split())]
    if not words:
        return np.zeros(0, np.uint64)
    h = np.concatenate(words)
    width = min(N, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mixed(out + h[k:len(h) - width + 1 + k])
    return np.unique(out)


def signature(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parities of the hashes in so many places, as 64-bit numbers."""
    odd = np.bincount((hashes >> np.uint64(40)) % np.uint64(bits), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def _size_band(n: int) -> int:
    """Sizes that can link are in the same band or in neighbouring ones."""
    return int(math.log(n) / -math.log(PERCENT / 100) * (1 - 1e-12))


def _levels(n: int) -> list[int]:
    """Into 2**level sections a set is cut: by its size, and as the least sets that are cut once more if it can link with them."""
    level = max(0, (n // SECTION).bit_length() - 1)
    larger = SECTION << (level + 1)
    return [level, level + 1] if 100 * n >= PERCENT * larger else [level]


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    """The text in bytes, behind a hash of it and ``more`` columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("text_hash"), *[F.col(c).cast("long") for c in more], text.cast("binary").alias("text"))


def read_sets(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, text_hash, set, node, n)`` of all documents, and ``(bucket, times)`` of the histogram; the rest is null."""
    ship(docs.sparkSession)
    fields = {"doc_id": pa.int64(), "text_hash": pa.int64(), "set": pa.binary(), "node": pa.int64(), "n": pa.int64(), "bucket": pa.int32(), "times": pa.int64()}

    def filled(rows: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(rows, t)) for c, t in fields.items()], list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = _Words(), np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            sets, sizes = [], []
            for text in batch.column(2).to_pylist():
                h = shingles(text, known)
                np.add.at(times, _bucket(h), 1)
                sets.append(_digest(h) if len(h) else None)
                sizes.append(len(h))
            nodes = [s and _node(s) for s in sets]
            yield filled(len(sets), doc_id=batch.column(1), text_hash=batch.column(0), set=pa.array(sets, pa.binary()),
                         node=pa.array(nodes, pa.int64()), n=pa.array(sizes, pa.int64()))
        full = np.flatnonzero(times)
        for at in range(0, len(full), 1 << 15):
            b = full[at:at + (1 << 15)]
            yield filled(len(b), bucket=pa.array(b.astype(np.int32)), times=pa.array(times[b]))

    return _texts(docs, "doc_id").mapInArrow(run, "doc_id long, text_hash long, set binary, node long, n long, bucket int, times long")


def histogram(rows: DataFrame) -> np.ndarray:
    """Times that the shingles of each bucket occur: at most ``BUCKETS`` rows come to the driver."""
    found = rows.filter("bucket is not null").groupBy("bucket").agg(F.sum("times").alias("times")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy()] = found["times"].to_numpy()
    return out


def _first_rows(h: np.ndarray, node: int, times: np.ndarray, limit: int) -> Iterator[tuple]:
    """(token, node, n, size, lead, sig) of the rows of one set, section by section."""
    rank = times[_bucket(h)]
    for level in _levels(len(h)):
        section = (_mixed(h) >> np.uint64(64 - level)).astype(np.int64) if level else np.zeros(len(h), np.int64)
        order = np.lexsort((rank, section))  # hashes are sorted: they decide ties
        ends = np.cumsum(np.bincount(section, minlength=1 << level)).tolist()
        for start, end in zip([0, *ends], ends):
            n = end - start
            if not n:
                continue
            own = order[start:end]
            first = n - -(-PERCENT * n // 100) + 1
            lead = n - -(-2 * PERCENT * n // (100 + PERCENT)) + 1
            at = own[:first]
            token, cold = (h[at] + np.uint64(level)).view(np.int64), rank[at] <= limit
            size, leads = np.full(first, n), np.arange(first) < lead
            if not cold.all():
                band = _size_band(n)
                joins = [xxhash.xxh64_intdigest(f"{t} {b}") for t in token[~cold].tolist() for b in (band, band + 1)]
                token = np.concatenate([token[cold], np.array(joins, np.uint64).view(np.int64)])
                size = np.concatenate([size[cold], np.zeros(len(joins), np.int64)])
                leads = np.concatenate([leads[cold], np.zeros(len(joins), bool)])
            m = len(token)
            yield token, np.full(m, node), size, np.full(m, len(h)), leads, np.full(m, signature(h[own])[0])


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    """Rows as four numbers each. All are mixed with the token, so that rows take the same space in a shuffle between
    few tasks, where rows of one set lie side by side, as between many."""
    token, node, n, size, lead, sig = (np.concatenate(c) for c in zip(*rows))
    counts = size << 32 | n << 1 | lead
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (token, node ^ token, counts, sig.view(np.int64) ^ token)], ["token", "node", "counts", "sig"])


def _unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    """(token, node, n, size, lead, sig) of packed rows."""
    token, node, counts, sig = (batch.column(i).to_numpy() for i in range(4))
    return [token, node ^ token, (counts & 0xFFFFFFFF) >> 1, counts >> 32, (counts & 1).astype(bool), (sig ^ token).view(np.uint64)]


def tile_rows(docs: DataFrame, order: np.ndarray, hot: int) -> DataFrame:
    """A packed row for each of the first shingles of a set, or of its sections: token, node, n, size, lead, sig.

    ``n`` counts the section, ``size`` the set. ``lead`` says that a pair in which this
    section is the smaller has to meet here. Rows of hot shingles have ``n`` 0 and, instead
    of the shingle, a node that joins their class.
    """
    ship(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(order.clip(0, (1 << 31) - 1).astype(np.int32))
    limit = min(hot, (1 << 31) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, times = _Words(), set(), ranks.value
        for batch in slices(batches):
            rows, held = [], 0
            for text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text_hash in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(text_hash)
                h = shingles(text, known)
                if not len(h):
                    continue
                for row in _first_rows(h, _node(_digest(h)), times, limit):
                    rows.append(row)
                    held += len(row[0])
                    if held >= 1 << 16:
                        yield _packed(rows)
                        rows, held = [], 0
            if rows:
                yield _packed(rows)

    return _texts(docs).mapInArrow(run, "token long, node long, counts long, sig long")


def _near(n1, n2) -> np.ndarray:
    """Sizes allow a link."""
    return 100 * np.minimum(n1, n2) >= PERCENT * np.maximum(n1, n2)


def _possible(n1, s1, n2, s2) -> np.ndarray:
    """Sizes and bitmaps allow a link: the differing bits leave enough overlap."""
    differing = np.bitwise_count(s1 ^ s2).astype(np.int64)
    if differing.ndim > 1:
        differing = differing.sum(-1)
    return _near(n1, n2) & ((100 + PERCENT) * differing <= (100 - PERCENT) * (n1 + n2))


def _forest(n: np.ndarray, size: np.ndarray, sig: np.ndarray, lead: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the possible pairs of a tile; rows are in the order of n."""
    free = np.ones(len(n), bool)
    for root in range(len(n)):
        if not free[root]:
            continue
        free[root], border = False, [root]
        while border:
            i = border.pop()
            rest = np.flatnonzero(free)
            rest = rest[np.where(rest < i, lead[rest], lead[i])]
            met = rest[_near(size[i], size[rest]) & _possible(n[i], sig[i], n[rest], sig[rest])]
            free[met] = False
            border.extend(met.tolist())
            for j in met.tolist():
                yield i, j


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Possible pairs ``(a, b)`` of every tile. Rows come in the order of token, size and node."""
    held, last = None, None  # the tile that may go on; the row before it, if its tile has been cut
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _unpacked(batch)
        joined = rows[2] == 0
        if joined.any():
            yield _pairs(rows[0][joined], rows[1][joined])
        rows = [c[~joined] for c in rows]
        if held is not None:
            rows = [np.concatenate(c) for c in zip(held, rows)]
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if len(rows[0]) - cut > TILE:
            cut = len(rows[0])
        if cut:
            yield _tile_pairs([c[:cut] for c in rows], last)
            last = [c[-1] for c in rows[:3]] if cut == len(rows[0]) else None
        held = [c[cut:] for c in rows]
    if held is not None and len(held[0]):
        yield _tile_pairs(held, last)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _tile_pairs(rows: list[np.ndarray], last: list | None) -> pa.RecordBatch:
    """Possible pairs of whole tiles, or of parts of a long one; ``last`` is the row before, if a tile was cut there."""
    token, node, n, whole, lead, sig = rows
    starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    sizes = np.diff(np.append(starts, len(token)))
    goes_on = last is not None and last[0] == token[0]
    a, b = [], []
    # tiles of two, most of all, at once
    two = starts[(sizes == 2) & ~(goes_on & (starts == 0))]
    met = two[lead[two] & (node[two] != node[two + 1]) & _near(whole[two], whole[two + 1]) & _possible(n[two], sig[two], n[two + 1], sig[two + 1])]
    a.append(node[met])
    b.append(node[met + 1])
    for start, size in zip(starts.tolist(), sizes.tolist()):
        part = slice(start, start + size)
        if size > TILE or goes_on and not start:  # a long tile: neighbours in size are one class
            sizes_, nodes = n[part], node[part]
            if goes_on and not start:
                sizes_, nodes = np.append(last[2], sizes_), np.append(last[1], nodes)
            near = np.flatnonzero(100 * sizes_[:-1] >= PERCENT * sizes_[1:])
            a.append(nodes[near])
            b.append(nodes[near + 1])
        elif size > 2:
            edges = start + np.array(list(_forest(n[part], whole[part], sig[part], lead[part])), np.int64).reshape(-1, 2)
            a.append(node[edges[:, 0]])
            b.append(node[edges[:, 1]])
    a, b = np.concatenate(a), np.concatenate(b)
    return _pairs(a[a != b], b[a != b])


def possible_pairs(rows: DataFrame, tasks: int) -> DataFrame:
    """Pairs ``(a, b)`` of nodes that connect all that can link."""
    token, node, n = F.col("token"), F.col("node").bitwiseXOR(F.col("token")), F.shiftright(F.col("counts").bitwiseAND(F.lit(0xFFFFFFFF)), 1)
    dealt = rows.repartition(tasks, F.when(n == 0, node).otherwise(token)).sortWithinPartitions(token, n, node)
    return dealt.mapInArrow(_tiles, "a long, b long").distinct()


def members(docs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, set, hashes) of every distinct set that is in a class (node, component); ``rows`` as in ``read_sets``.

    A filter of fixed size tells most other texts by their hashes, where they are read; the join decides.
    """
    spark = docs.sparkSession
    ship(spark)
    one = rows.filter("set is not null").groupBy("set").agg(F.min("text_hash").alias("text_hash"), F.first("node").alias("node"))
    named = classes.select(F.col("node").alias("_node"), F.col("component").alias("class"))
    wanted = cut_lineage(one.join(named, F.col("node") == F.col("_node")).select(F.col("set").alias("_set"), "text_hash", "class"))
    place = F.pmod(F.xxhash64("text_hash"), F.lit(FILTER))
    bits = wanted.select(F.floor(place / 8).cast("int").alias("byte"), (place % 8).cast("int").alias("bit"))
    found = bits.groupBy("byte").agg(F.expr("bit_or(shiftleft(1, bit))").alias("bits")).toArrow()  # at most FILTER / 8 rows
    table = np.zeros(FILTER // 8, np.uint8)
    table[found["byte"].to_numpy()] = found["bits"].to_numpy()
    marked = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, may = _Words(), set(), marked.value
        for batch in slices(batches):
            sets, hashes = [], []
            for i, text_hash in enumerate(batch.column(0).to_pylist()):
                at = _spark_hash(text_hash) % FILTER
                if text_hash in seen or not may[at // 8] >> (at % 8) & 1:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(text_hash)
                h = shingles(batch.column(1)[i].as_py(), known)
                if len(h):
                    sets.append(_digest(h))
                    hashes.append(h.tobytes())
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), pa.array(hashes, pa.binary())], ["set", "hashes"])

    own = _texts(docs).mapInArrow(run, "set binary, hashes binary")
    met = own.join(wanted, F.col("set") == F.col("_set"))
    return met.groupBy("set").agg(F.first("class").alias("class"), F.first("hashes").alias("hashes"))


def _spark_hash(v: int) -> int:
    """xxhash64 of a long, as Spark computes it with its seed 42."""
    return int.from_bytes(xxhash.xxh64_digest(v.to_bytes(8, "little", signed=True), 42), "big", signed=True)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def links_of(label: np.ndarray, role: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that connect all linked members of one unit whose labels differ.

    Of a pair one has to be of role 1 or 2 and the other of role 0 or 2. The likeliest partners
    come first; a pair that links already connect is not intersected.
    """
    order = np.argsort(np.array([len(s) for s in sets]), kind="stable")
    n = np.array([len(sets[i]) for i in order], np.int64)
    sig = np.array([signature(sets[i], WIDE) for i in order])
    root, role = label[order].copy(), role[order]
    for i in range(1, len(order)):
        low = int(np.searchsorted(n, -(-PERCENT * n[i] // 100)))
        near = np.arange(low, i)
        if role[i] != 2:
            near = near[role[near] != role[i]]
        near = near[_possible(n[near], sig[near], n[i], sig[i])]
        near = near[np.argsort(np.bitwise_count(sig[near] ^ sig[i]).sum(-1), kind="stable")]
        while len(near := near[root[near] != root[i]]):
            j, near = int(near[0]), near[1:]
            both = _overlap(sets[order[j]], sets[order[i]])
            if 100 * both >= PERCENT * (n[i] + n[j] - both):
                yield int(order[j]), int(order[i])
                root[root == root[j]] = root[i]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every unit. Rows (unit, role, set, label, hashes) come in the order of units."""
    held, now = [], None

    def solve(rows: list) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        label = np.array([numbers.setdefault(r[2], len(numbers)) for r in rows])
        role = np.array([r[0] for r in rows])
        found = list(links_of(label, role, [np.frombuffer(r[3], np.uint64) for r in rows]))
        return pa.RecordBatch.from_arrays([pa.array([rows[e[k]][1] for e in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
            for unit, *row in zip(*(c.to_pylist() for c in part.columns)):
                if unit != now:
                    if held:
                        yield solve(held)
                    held, now = [], unit
                held.append(row)
    if held:
        yield solve(held)


def _solved(dealt: DataFrame, tasks: int) -> DataFrame:
    by_unit = dealt.repartition(tasks, "unit").sortWithinPartitions("unit")
    return cut_lineage(by_unit.select("unit", "role", "set", "label", "hashes").mapInArrow(_units, "a binary, b binary"))


def links(found: DataFrame) -> list[DataFrame]:
    """Tables of links ``(a, b)`` that connect all linked ``members``."""
    total = found.count()
    tasks = parts(total, TASK_MEMBERS)
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.octet_length("hashes")) / BLOCK_BYTES)).cast("int")
    sizes = cut_lineage(found.groupBy("class").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("_n")))
    named = attach(found, sizes, "class", "_n", total, F.col("set")).drop("_n")
    named = named.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    # block 0 meets itself in unit 0 and each other block in a unit of its own
    own = F.array(F.struct(F.col("block").alias("unit"), F.when(F.col("block") == 0, 2).otherwise(0).alias("role")))
    more = F.transform(F.sequence(F.lit(0), F.greatest(F.col("blocks") - 2, F.lit(0))), lambda k: F.struct((k + 1).alias("unit"), F.lit(1).alias("role")))
    placed = F.when((F.col("block") == 0) & (F.col("blocks") > 1), F.concat(own, more)).otherwise(own)
    dealt = named.select("class", "set", F.col("set").alias("label"), "hashes", F.inline(placed))
    out = [_solved(dealt.withColumn("unit", F.xxhash64("class", "unit")), tasks)]
    large = sizes.filter("blocks > 1")
    if large.isEmpty():
        return out
    # members outside the largest component of a class meet all others of it, block by block
    linked = components(out[0]).withColumnRenamed("node", "_set")
    many = named.filter("blocks > 1")
    many = cut_lineage(many.join(linked, F.col("set") == F.col("_set"), "left").select(
        "class", "set", "hashes", "blocks", "block", F.coalesce("component", "set").alias("label")))
    by_label = many.groupBy("class", "label").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("hashes")).alias("size"))
    mixed = by_label.groupBy("class").agg(F.expr("max_by(label, struct(m, label))").alias("main"), F.sum("m").alias("_n"), F.max("m").alias("most"),
                                          (F.sum("size") - F.expr("max_by(size, struct(m, label))")).alias("size"))
    few = F.greatest(F.ceil((F.col("_n") - F.col("most")) / BLOCK), F.ceil(F.col("size") / BLOCK_BYTES)).cast("int")
    mixed = cut_lineage(mixed.filter("_n > most").select("class", "main", "_n", few.alias("minors")))
    open_ = attach(many, mixed, "class", "_n", many.count(), F.col("set")).filter("main is not null")
    minor = F.pmod(F.xxhash64("set", F.lit(1)), F.col("minors")).cast("int")
    all_ = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda k: F.struct(F.col("block").alias("x"), k.alias("y"), F.lit(0).alias("role")))
    ones = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(k.alias("x"), minor.alias("y"), F.lit(1).alias("role")))
    dealt = open_.select("class", "set", "label", "hashes", F.inline(F.when(F.col("label") == F.col("main"), all_).otherwise(F.concat(all_, ones))))
    out.append(_solved(dealt.withColumn("unit", F.xxhash64("class", "x", "y")), parts(total, TASK_MEMBERS)))
    release(many, mixed)
    return out


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and component (the digest of one of its sets; null for empty sets): one row for each document."""
    read = cut_lineage(read_sets(docs))
    order = histogram(read)
    rows = read.filter("bucket is null")
    total, words = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = parts(total + words * (100 - PERCENT) // 100, TASK_ROWS)
    hot = max(TILE, total // 1000) + 2 * int(order.mean())
    pairs = cut_lineage(possible_pairs(tile_rows(docs, order, hot), tasks))
    classes = cut_lineage(components(pairs))
    found = cut_lineage(members(docs, rows, classes))
    release(pairs, classes)
    linked = links(found)
    edges = linked[0]
    for more in linked[1:]:
        edges = edges.union(more)
    roots = components(edges).withColumnRenamed("node", "_set")
    sets = rows.filter("set is not null").groupBy("set").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_rows"))
    named = cut_lineage(sets.join(roots, F.col("set") == F.col("_set"), "left").drop("_set"))
    many, alone = named.filter("component is not null"), named.filter("component is null")
    names = many.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    groups = attach(many, names, "component", "_n", many.count(), F.col("set")).select("set", "n_rows", "component_id", "component")
    groups = cut_lineage(groups.union(alone.select("set", "n_rows", "least", F.col("set").alias("component"))))
    release(named, found, *linked)
    out = attach(rows.select("doc_id", "set", "n"), groups, "set", "n_rows", total, F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component")


def op12(docs: DataFrame) -> DataFrame:
    return similar_documents(docs).select("doc_id", "n_shingles", "component_id")
