"""Benchmark decontamination by template canonicalisation.

Texts are tokens: numbers and words. A template replaces numbers, units behind a number
and names (capitalised words) by typed placeholders; everything else is compared without
case or punctuation. Every window of ``WINDOW`` template tokens of the benchmark is
hash-joined with those of all documents, in three forms: with names replaced, to catch
re-parameterised questions, with names as words, to catch copies in other case, and with
every token as it is, to catch copies that consist mostly of numbers. In the first two,
windows of which fewer than half are words are no evidence, and templates under ``LEAST``
tokens are not searched. An item shorter than the window is one window of its own length,
so a text that holds all words of a very short item in a row is contaminated by it.

A run of numbers, or of names that are replaced, is one placeholder, so that a value may have
any number of tokens. Matches of a document and an item at one offset, or at neighbouring
ones (each at most ``DRIFT`` from the next, as inserted words make them), must fill the
slots consistently: a value of the item always stands for the same value of the document,
and the other way round. A document is contaminated by an item if in some such group at
least ``CONSISTENT`` of the slots agree so and the windows cover ``ENOUGH`` template tokens
or ``SHARE`` of the item.

Items of equal text are searched once, under their smallest item_id. Null texts have no
tokens. Rows that repeat a doc_id count as one document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codestrata.llm.bpe import Shared, Store
from codestrata.llm.common import ROW, numbered, ship, slices, without
from codestrata.session import cut_lineage

WINDOW = 8
LEAST = 4
ENOUGH = 13
SHARE = 0.6
DRIFT = 8
CONSISTENT = 0.8

#: Hashes of benchmark windows that are sent to all tasks (8 bytes each); with more, all windows of the documents are shuffled.
SENT = 1 << 22

NUMBER_WORDS = frozenset("""zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen
    fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand
    million billion""".split())
UNITS = frozenset("""mm cm m km meter meters metre metres kilometer kilometers inch inches foot feet yard yards mile miles
    g kg mg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons
    s sec second seconds min minute minutes h hour hours day days week weeks month months year years
    dollar dollars cent cents euro euros percent degree degrees mph kmh watt watts volt volts""".split())

_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+")
_WORD, _NUMBER, _NAME, _UNIT = 0, 1, 2, 3
_MARKS = np.array([0x6A09E667F3BCC908, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B], np.uint64)
_FORMS = ("names as words", "names replaced", "literal")
_LITERAL = 2
_PRIME = 0x100000001B3 * 0x9E3779B97F4A7C15 & ((1 << 64) - 1) | 1

WINDOWS = "form int, pos int, n_tokens int, length int, hash long, slots array<string>"


def _code(token: str) -> int:
    """Hash of a token; its lowest bits say what it is."""
    low = token.lower()
    if token[0].isdigit() or low in NUMBER_WORDS:
        kind = _NUMBER
    elif low in UNITS:
        kind = _UNIT
    elif len(token) > 1 and token[0].isupper() and not token.isupper():
        kind = _NAME
    else:
        kind = _WORD
    return xxhash.xxh64_intdigest(low.encode()) & ~3 | kind


class Templates:
    """Windows of a slice of texts; remembers tokens."""

    def __init__(self) -> None:
        self.codes = Store(_code, 1 << 16)

    def windows(self, texts: list[str], shapes: list[tuple[int, int]], wanted: Wanted | None, whole_only: bool = False) -> list[tuple]:
        """(text, form, position, tokens of the text, length, hash, slots) of all windows whose hash is wanted.

        ``shapes`` are the pairs of form and length to make.
        ``whole_only`` makes windows shorter than WINDOW only of texts of just that length.
        """
        tokens = [_TOKEN.findall(t) for t in texts]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = [x for ts in tokens for x in ts]
        code = np.fromiter(map(self.codes.__getitem__, flat), np.uint64, len(flat))
        owner = np.repeat(np.arange(len(texts)), sizes)
        start = np.cumsum(sizes) - sizes
        kind = (code & np.uint64(3)).astype(np.int64)
        number = kind == _NUMBER
        unit = (kind == _UNIT) & np.concatenate(([False], number[:-1]))[:len(kind)] & (np.arange(len(flat)) != start[owner] if len(flat) else False)
        word = code & ~np.uint64(3)
        slot = number | unit
        plain = np.where(number, _MARKS[0], np.where(unit, _MARKS[1], word))
        found: list[tuple] = []
        for form in range(len(_FORMS)):
            holes = (slot | (kind == _NAME), slot)[form == 0] if form != _LITERAL else np.zeros(len(flat), bool)
            symbols = word if form == _LITERAL else np.where(holes & ~slot, _MARKS[2], plain)
            # the runs: a first token each, and the tokens up to the next first
            what = np.where(holes, kind, _WORD)
            what[holes & unit] = _UNIT
            more = np.zeros(len(flat), bool)
            more[1:] = (what[1:] == what[:-1]) & (owner[1:] == owner[:-1]) & ((what[1:] == _NUMBER) | (what[1:] == _NAME))
            first = np.flatnonzero(~more)
            until = np.append(first[1:], len(flat))
            symbols, holes, whose = symbols[first], holes[first], owner[first]
            count = np.bincount(whose, minlength=len(texts))
            begin = np.cumsum(count) - count
            words = np.concatenate(([0], np.cumsum(~holes)))
            for length in (n for f, n in shapes if f == form):
                n = len(symbols) - length + 1
                if n <= 0:
                    continue
                h = np.zeros(n, np.uint64)
                for j in range(length):
                    h = h * np.uint64(_PRIME) + symbols[j:j + n]
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(4 * length + form)
                ok = whose[:n] == whose[length - 1:]
                if form != _LITERAL:
                    ok &= 2 * (words[length:] - words[:n]) >= length
                if whole_only and length < WINDOW:
                    ok &= count[whose[:n]] == length
                if wanted is not None:
                    ok &= wanted.maybe(h)
                at = np.flatnonzero(ok)
                if wanted is not None:
                    at = at[wanted.has(h[at])]
                for i in at.tolist():
                    who = int(whose[i])
                    found.append((who, form, i - int(begin[who]), int(count[who]), length, int(h[i].astype(np.int64)),
                                  [" ".join(flat[first[j]:until[j]]).lower() for j in range(i, i + length) if holes[j]]))
        return found


class Wanted:
    """Hashes to look for: a packed table of bits first (at most 16 MB), then the hashes, sorted."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.sorted = hashes.view(np.uint64)
        bits = max(16, int(len(hashes)).bit_length() + 4)
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits - 3, np.uint8)
        at = self.sorted & self.mask
        np.bitwise_or.at(self.table, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def maybe(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        return (self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1

    def has(self, h: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return self.sorted[at] == h


def windows(rows: DataFrame, shapes: list[tuple[int, int]], wanted: Shared | None, whole_only: bool = False) -> DataFrame:
    """Template windows of ``rows(id, text)``; an id is a number or a string."""
    ship(rows.sparkSession)
    kind = rows.schema["id"].dataType
    arrow = pa.string() if isinstance(kind, StringType) else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Templates()
        look = Wanted(wanted.value) if wanted else None
        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            found = own.windows([x or "" for x in batch.column(1).to_pylist()], shapes, look, whole_only)
            cols = list(zip(*found)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in cols[0]], arrow), *[pa.array(c, pa.int32()) for c in cols[1:5]],
                 pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.list_(pa.string()))],
                ["id", "form", "pos", "n_tokens", "length", "hash", "slots"])

    return rows.mapInArrow(run, f"id {kind.simpleString()}, {WINDOWS}")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, covered (tokens), coverage (share of the item), consistency, kind: one row for each such pair."""
    spark = docs.sparkSession
    items = benchmark.filter(F.col("text").isNotNull()).groupBy("text").agg(F.min("item_id").alias("id")).select("id", "text")
    every = [(form, n) for form in range(len(_FORMS)) for n in range(1 if form == _LITERAL else LEAST, WINDOW + 1)]
    theirs = cut_lineage(windows(items, every, None, whole_only=True))
    shapes = sorted((r[0], r[1]) for r in theirs.select("form", "length").distinct().collect())
    hashes = theirs.select("hash").distinct()
    wanted = None
    if hashes.count() <= SENT:
        sent = hashes.toArrow().column(0).to_numpy().view(np.uint64)
        wanted = Shared(spark, np.sort(sent).view(np.int64))
    key = F.col("doc_id") if isinstance(docs.schema["doc_id"].dataType, StringType) else F.col("doc_id").cast("long")
    ours = windows(docs.select(key.alias("id"), "text"), shapes, wanted)
    hits = ours.select(F.col("id").alias("doc_id"), "form", "hash", F.col("pos").alias("at"), F.col("slots").alias("ours")).join(
        theirs.select(F.col("id").alias("item_id"), "form", "hash", "pos", "n_tokens", "length", F.col("slots").alias("theirs")),
        ["form", "hash"])
    hits = cut_lineage(_grouped(hits.withColumn("offset", F.col("at") - F.col("pos")).dropDuplicates(
        ["doc_id", "item_id", "form", "offset", "pos"])))
    place = ["doc_id", "item_id", "form", "span"]
    over = "over (partition by doc_id, item_id, form, span order by pos)"
    spans = hits.withColumn("_new", F.expr(f"least(length, coalesce(pos - lag(pos) {over}, length))")).groupBy(*place).agg(
        F.sum("_new").alias("covered"), F.max("n_tokens").alias("n_tokens"))
    pairs = hits.select(*place, F.explode(F.arrays_zip("ours", "theirs")).alias("_s")).groupBy(
        *place, F.col("_s.theirs").alias("theirs"), F.col("_s.ours").alias("ours")).count()
    forth = pairs.groupBy(*place, "theirs").agg(F.max("count").alias("most"), F.sum("count").alias("all"))
    back = pairs.groupBy(*place, "ours").agg(F.max("count").alias("most"), F.sum("count").alias("all"))
    share = lambda side, name: side.groupBy(*place).agg((F.sum("most") / F.sum("all")).alias(name))
    same = pairs.groupBy(*place).agg(F.min((F.col("theirs") == F.col("ours")).cast("int")).alias("same"))
    for side in (share(forth, "forth"), share(back, "back"), same):
        keys = side.select(*[F.col(c).alias(f"_{c}") for c in place], *[c for c in side.columns if c not in place])
        spans = spans.join(keys, F.expr(" and ".join(f"{c} <=> _{c}" for c in place)), "left").drop(*[f"_{c}" for c in place])
    spans = spans.withColumn("consistency", F.coalesce(F.least("forth", "back"), F.lit(1.0))).withColumn(
        "coverage", F.col("covered") / F.col("n_tokens"))
    good = spans.filter((F.col("consistency") >= CONSISTENT) & ((F.col("covered") >= ENOUGH) | (F.col("coverage") >= SHARE)))
    kind = F.when(F.coalesce("same", F.lit(1)) == 1, "copy").otherwise("reparameterised")
    best = good.withColumn("_rank", F.expr(
        "row_number() over (partition by doc_id, item_id order by coverage desc, covered desc, consistency desc, form, span)")).filter("_rank = 1")
    return best.select("doc_id", "item_id", F.col("covered").cast("long"), "coverage", "consistency", kind.alias("kind"))


def _grouped(hits: DataFrame) -> DataFrame:
    """Hits by groups (``span``): each offset for itself, and all neighbouring offsets together.

    In the latter a position of the item counts once, at the offset with the most hits.
    """
    pair = "partition by doc_id, item_id, form"
    near = hits.withColumn("_step", F.expr(f"offset - lag(offset) over ({pair} order by offset, pos)")).withColumn(
        "_run", F.expr(f"sum(if(_step > {DRIFT}, 1, 0)) over ({pair} order by offset, pos)")).withColumn(
        "_support", F.expr(f"count(1) over ({pair}, offset)"))
    near = near.withColumn("_all", F.expr(f"count(1) over ({pair}, _run)")).filter("_support < _all").withColumn(
        "_rank", F.expr(f"row_number() over ({pair}, _run, pos order by _support desc, offset)")).filter("_rank = 1")
    single = hits.withColumn("span", F.col("offset").cast("long") * 2)
    return single.unionByName(near.withColumn("span", F.col("_run") * 2 + 1).select(*single.columns))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows that no benchmark item contaminates, with all their columns; each is judged by itself, whatever its doc_id."""
    docs = numbered(docs)
    found = contaminated(docs.select(F.col(ROW).alias("doc_id"), "text"), benchmark)
    return without(docs, cut_lineage(found.select(F.col("doc_id").alias(ROW)).distinct()))
