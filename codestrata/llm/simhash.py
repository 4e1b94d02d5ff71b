"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprint: words are runs of characters other than ASCII white space, with A-Z
lower-cased; every 3-word shingle, repeats included, votes with its XXH64 (seed 42).
A bit is set if it is set in over half of the votes. A text of one or two words has
one shingle, a text without words (or null) has fingerprint zero and is linked like
any other. Links join fingerprints that differ in at most 3 bits.

Every distinct fingerprint emits variants of itself, the variants are shuffled, and
fingerprints that meet in one are candidates. Two fingerprints that differ in three
bits have different parity of their bit count, and two of the three bits lie in the
same half of the word. So it is enough that fingerprints with an even bit count emit
the ball of radius 1 and those with an odd one add all pairs of flips within a half:
they meet where the even one has flipped the third bit. Differences of one or two bits
meet within radius 1. A variant receives at most one fingerprint for each flip, 1,057
in all, so no group is unbounded. In a group, all are linked to the smallest member
within radius 1, if there is one: these links span the links of the group without
listing its pairs, and every one is verified by its bit distance.

Copies are grouped before: variants are emitted once for each distinct fingerprint.
A null doc_id takes part, but names a component only if no other row of it has an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import ROW, attach, numbered, parts, segments, ship, slices, without
from codestrata.llm.components import components
from codestrata.session import cut_lineage, release

RADIUS = 3
WORDS = 3
SEED = 42

#: The variants are shuffled in so many rounds, each with its share of them, to bound the disk needed at a time.
ROUNDS = 4

#: Variants that a task sorts in memory, on average.
TASK_VARIANTS = 1_500_000


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of a whole text."""
    votes, n = np.zeros(64, np.int64), 0
    carried: list[bytes] = []
    data = (text or "").encode().lower()
    for piece in segments(data):
        words = carried + piece.split()
        if len(words) < WORDS:
            carried = words
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        n += _vote(votes, b" ".join(words), starts[:len(words) - WORDS + 1].tolist(), (ends[WORDS - 1:] - 1).tolist())
        carried = words[1 - WORDS:]
    if not n:
        if not carried:
            return 0
        joined = b" ".join(carried)
        n = _vote(votes, joined, [0], [len(joined)])
    return int(np.packbits(2 * votes > n).view(">u8")[0])


def _vote(votes: np.ndarray, joined: bytes, starts: list[int], ends: list[int]) -> int:
    h = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 16):
        hashes = np.array([h(joined[s:e], SEED) for s, e in zip(starts[at:at + (1 << 16)], ends[at:at + (1 << 16)])], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return len(starts)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, its fingerprint as a signed long, and the number of the row if it has one."""
    ship(docs.sparkSession)
    more = [c for c in docs.columns if c == ROW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *batch.columns[2:]], ["doc_id", "fp", *more])

    schema = ", ".join(["doc_id long", "fp long", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in more)])
    return docs.select(F.col("doc_id").cast("long"), "text", *more).mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def flips(odd: bool) -> list[int]:
    """Masks of the variants that a fingerprint emits, by the parity of its bit count."""
    near = [0, *(1 << i for i in range(64))]
    pairs = [1 << i | 1 << j for half in (0, 32) for i in range(half, half + 32) for j in range(half, i)]
    return [_signed(x) for x in near + pairs * odd]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of all fingerprints that meet in a variant, for the variants of one partition."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    z, fp = (np.concatenate(x) for x in zip(*held))
    del held
    order = np.argsort(z)
    z = z[order]
    same = z[1:] == z[:-1]
    met = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    z, fp = z[met], fp[order[met]]
    far = np.bitwise_count((z ^ fp).view(np.uint64)) > 1
    order = np.lexsort((fp, far, z))
    z, fp, far = z[order], fp[order], far[order]
    first = np.concatenate(([True], z[1:] != z[:-1])) if len(z) else np.zeros(0, bool)
    heads = np.flatnonzero(first)[np.cumsum(first) - 1] if len(z) else np.zeros(0, int)
    linked = ~first & ~far[heads]
    a, b = fp[heads][linked], fp[linked]
    assert not len(a) or np.bitwise_count((a ^ b).view(np.uint64)).max() <= RADIUS
    for at in range(0, len(a), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(a[at:at + (1 << 16)]), pa.array(b[at:at + (1 << 16)])], ["a", "b"])


def links(distinct: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``distinct(fp)``, each once, to links ``(a, b)`` that connect all within the radius."""
    ship(distinct.sparkSession)
    n = distinct.count()
    tasks = parts(n * 561 // rounds, TASK_VARIANTS)
    odd = F.bit_count("fp") % 2 == 1
    masks = F.when(odd, F.lit(flips(True))).otherwise(F.lit(flips(False)))
    found = []
    for k in range(rounds):
        variants = distinct.select("fp", F.explode(masks).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("z"), "fp")
        mine = variants.filter(F.pmod(F.col("z").bitwiseXOR(F.shiftrightunsigned("z", 29)), F.lit(rounds)) == k)
        found.append(cut_lineage(mine.repartition(tasks, "z").mapInArrow(_meet, "a long, b long").distinct()))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id, component: one row for each document, with the smallest doc_id and the least fingerprint that links reach.

    The number of the row is added if it has one.
    """
    rows = cut_lineage(fingerprints(docs))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    linked = components(links(distinct.select("fp")))
    named = distinct.join(linked, distinct["fp"] == linked["node"], "left").select(
        "fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    named = cut_lineage(named)
    names = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    total = named.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = cut_lineage(attach(named, names, "component", "_n", total[0], F.col("fp")).select("fp", "component_id", "component", "n"))
    release(named, distinct)
    return attach(rows, groups, "fp", "n", total[1], F.col("doc_id")).drop("n")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, one that has the smallest doc_id, with all its columns."""
    docs = numbered(docs)
    found = cut_lineage(near_duplicates(docs).select("doc_id", "component_id", "component", ROW))
    firsts = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min(ROW).alias("_first"))
    dropped = cut_lineage(found.join(firsts.select("_first"), F.col(ROW) == F.col("_first"), "left_anti").select(ROW))
    release(found)
    return without(docs, dropped)


def op9(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
