"""Divergence of sources: how the term frequencies of each source of a language differ from the others and from the language.

Terms are runs of letters A to Z and of all characters beyond ASCII, only A-Z lower-cased.
Null text, language or source counts as ''. A language keeps the V terms that are in at least
``LEAST`` of its documents. A kept term that occurs c times in a group of N kept occurrences
has p = 1 + floor(10**9 * (c + 1) / (N + V)); the divergence of p from q is
floor((p - q)**2 / q). All arithmetic is in whole numbers.

Index, in a single pass over the texts: a task keeps postings (term, source, occurrences) of
its documents in memory. When a block reaches ``BLOCK_ENTRIES`` postings or ``BLOCK_BYTES``
it is spilled as a run: sorted by hash shard, language and term, postings of one term and
source added up, and cut into chunks. A shard receives its chunks of all runs in the order of their
first entries and merges them with a heap that holds one open chunk of each run; so the postings of
a term come together, in order, whatever their number, and become its frequencies.

Pairs: if no term of two groups occurred, their divergence would be V times the one of the
two smallest p. Corrections are streamed over the occurrences: for a term in one of the
groups, by the number of terms with the same p (all pairs of sources of a language are in the
result, so a row for each is the size of the result); for terms in both, summed up by
tasks that hold pairs of sources, not of documents.

A posting is one number a run for each source, so a hot term or source has as many as there
are runs. The frequencies of one term, a number for each source, are one row. The documents
of one text, however long, are read piece by piece; its distinct terms are held.

Rows that repeat are counted each; doc_id is not read. An empty table gives an empty result.
A language without kept terms has its pairs with value 0 and no terms.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import attach, parts, segments, ship, slices
from codestrata.session import cut_lineage, release

LEAST = 3
UNIT = 1_000_000_000
RANKS = 200

#: A block is spilled at so many postings (a number for each document and term in it), or about so many bytes.
BLOCK_ENTRIES, BLOCK_BYTES = 2_500_000, 128 << 20

#: Terms of a chunk of a run.
CHUNK = 2048

#: Bytes of text for each hash shard.
SHARD_BYTES = 8 << 20

#: Sums of pairs that a task holds before it passes them on.
HELD_PAIRS = 1 << 20

#: Pairs of entries that a task looks at together.
AT_A_TIME = 1 << 18

#: Bytes that are no part of a term become blanks, A-Z become lower case.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in several lists if it is long."""
    for piece in segments(data):
        yield piece.translate(_LETTERS).split()


class _Ids(dict):
    """Numbers of the terms of a language, given out in the order of ``words``, which all languages of a block share."""

    def __init__(self, lang: int, words: list[tuple[int, bytes]]):
        super().__init__()
        self.lang, self.words = lang, words

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self.words)
        self.words.append((self.lang, term))
        return n


class Block:
    """Postings (term, source, occurrences) of one document after the other, until it is full."""

    def __init__(self) -> None:
        self.langs: dict[bytes, _Ids] = {}
        self.sources: dict[bytes, int] = {}
        self.words: list[tuple[int, bytes]] = []
        self.postings: list[tuple[np.ndarray, np.ndarray]] = []
        self.entries = self.size = 0

    def add(self, lang: bytes, source: bytes, text: bytes) -> None:
        ids = self.langs.setdefault(lang, _Ids(len(self.langs), self.words))
        known = len(self.words)
        numbers = [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)) for words in terms(text)]
        found, times = np.unique(np.concatenate(numbers), return_counts=True)
        self.postings.append((found << 24 | self.sources.setdefault(source, len(self.sources)), times))
        self.entries += len(found)
        self.size += sum(len(w) + 150 for _, w in self.words[known:]) + 32 * len(found) + 200

    def full(self) -> bool:
        return self.entries >= BLOCK_ENTRIES or self.size >= BLOCK_BYTES or len(self.sources) >= 1 << 23

    def run(self, shards: int) -> Iterator[pa.RecordBatch]:
        """The block as a run: entries (term, its sources, occurrences, documents) by shard, language and term, cut into chunks."""
        if not self.entries:
            return
        langs, sources = list(self.langs), pa.array(list(self.sources), pa.binary())
        order = sorted(range(len(self.words)), key=lambda i: (langs[self.words[i][0]], self.words[i][1]))
        shard = np.fromiter((xxhash.xxh64_intdigest(self.words[i][1], 11) % shards for i in order), np.int64, len(order))
        order = np.array(order)[np.argsort(shard, kind="stable")]
        shard.sort()
        words = pa.array([self.words[i][1] for i in order], pa.binary())
        lang = np.array([self.words[i][0] for i in order])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # equal (term, source) become one posting
        keys, times = (np.concatenate(c) for c in zip(*self.postings))
        keys = place[keys >> 24] << 24 | keys & 0xFFFFFF
        by = np.argsort(keys, kind="stable")
        keys, times = keys[by], times[by]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, times, documents = keys[starts], np.add.reduceat(times, starts), np.diff(np.append(starts, len(keys)))
        term, source = keys >> 24, keys & 0xFFFFFF
        first = np.searchsorted(term, np.arange(len(order) + 1))
        documents = np.add.reduceat(documents, first[:-1])
        new = np.append(True, (shard[1:] != shard[:-1]) | (lang[1:] != lang[:-1]))
        cuts = [c for start, end in zip(np.flatnonzero(new).tolist(), [*np.flatnonzero(new)[1:].tolist(), len(order)]) for c in range(start, end, CHUNK)]
        for start, end in zip(cuts, [*cuts[1:], len(order)]):
            own = slice(int(first[start]), int(first[end]))
            lists = [words.slice(start, end - start), np.diff(first[start:end + 1]), documents[start:end], sources.take(pa.array(source[own])), times[own]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard[start]], pa.int32()), pa.array([langs[lang[start]]], pa.binary()), words.slice(start, 1),
                 *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x)) for x in lists)], RUN)


RUN = ["shard", "lang", "term", "terms", "sizes", "documents", "sources", "times"]


def runs(docs: DataFrame, shards: int) -> DataFrame:
    """Chunks of term-sorted runs, spilled whenever a block is full."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in slices(batches):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                block.add(lang, source, text)
                if block.full():
                    yield from block.run(shards)
                    block = Block()
        yield from block.run(shards)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c)
    return docs.select(text("lang"), text("source"), text("text")).mapInArrow(
        index, "shard int, lang binary, term binary, terms array<binary>, sizes array<long>, documents array<long>, sources array<binary>, times array<long>")


def entries(terms: list, sizes: list, documents: list, sources: list, times: list) -> Iterator[tuple]:
    """(term, sources, occurrences, documents) of a chunk, one after the other."""
    at = 0
    for term, size, n in zip(terms, sizes, documents):
        yield term, sources[at:at + size], times[at:at + size], n
        at += size


def merged(chunks: Iterator[tuple]) -> Iterator[tuple[bytes, bytes, dict[bytes, int], int]]:
    """(lang, term, occurrences by source, documents) of chunks ``(shard, lang, term, entries)`` in the order of their first terms."""
    heap: list = []
    term, lang, sources, documents = None, None, {}, 0
    number, at = 0, None

    def upto(limit: bytes | None) -> Iterator[tuple]:
        nonlocal term, sources, documents
        while heap and (limit is None or heap[0][0] < limit):
            now, no, (whose, times, n), rest = heap[0]
            following = next(rest, None)
            if following is None:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (following[0], no, following[1:], rest))
            if now != term:
                if term is not None:
                    yield lang, term, sources, documents
                term, sources, documents = now, dict(zip(whose, times)), n
            else:
                for s, t in zip(whose, times):
                    sources[s] = sources.get(s, 0) + t
                documents += n

    for shard, new, first, rows in chunks:
        if (shard, new) != at:  # the heap holds one language of one shard
            yield from upto(None)
            if term is not None:
                yield lang, term, sources, documents
            at, lang, term = (shard, new), new, None
        yield from upto(first)
        row = next(rows)
        heapq.heappush(heap, (row[0], number, row[1:], rows))
        number += 1
    yield from upto(None)
    if term is not None:
        yield lang, term, sources, documents


def frequencies(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, total, sources, times) of all kept terms: one pass over the texts, one merge for each shard."""
    ship(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    shards = parts(size, SHARD_BYTES)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    shard, lang, term, *columns = (c[i].as_py() for c in batch.columns)
                    yield shard, lang, term, entries(*columns)

        rows: list[tuple] = []
        for lang, term, sources, documents in merged(chunks()):
            if documents >= least:
                rows.append((lang, term, sum(sources.values()), list(sources), list(sources.values())))
                if len(rows) >= 4096:
                    yield _rows(rows)
                    rows = []
        if rows:
            yield _rows(rows)

    dealt = runs(docs, shards).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "lang", "term")
    found = dealt.mapInArrow(merge, "lang binary, term binary, total long, sources array<binary>, times array<long>")
    return found.select(F.col("lang").cast("string"), F.col("term").cast("string"), "total",
                        F.transform("sources", lambda s: s.cast("string")).alias("sources"), "times")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["lang", "term", "total", "sources", "times"])


def _share(times: Column, total: Column, n_terms: Column) -> Column:
    """1 + floor(10**9 * (times + 1) / (total + n_terms)), exact; a group without terms has none to ask for."""
    all_ = F.greatest(total.cast("decimal(19,0)") + n_terms.cast("decimal(19,0)"), F.lit(1).cast("decimal(20,0)"))
    asked = F.lit(UNIT).cast("decimal(10,0)") * (times.cast("decimal(18,0)") + F.lit(1).cast("decimal(1,0)"))
    return (F.call_function("div", asked, all_) + 1).cast("long")


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections for terms in both groups: (lang, source, item, value), summed up for the rows of a task."""
    names: dict[tuple, int] = {}
    sums: dict[int, int] = {}

    def out() -> pa.RecordBatch:
        known = list(names)
        rows = [(*known[k >> 32], known[k & 0xFFFFFFFF][1], v) for k, v in sums.items() if v]
        sums.clear()
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()])], ["lang", "source", "item", "value"])

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def add(i: np.ndarray, j: np.ndarray, group: np.ndarray, p: np.ndarray, base: np.ndarray) -> None:
        value = f(p[i], p[j]) - f(p[i], base[j]) - f(base[i], p[j]) + f(base[i], base[j])
        keys, at = np.unique(group[i] << 32 | group[j], return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, value)
        for k, v in zip(keys.tolist(), total.tolist()):
            sums[k] = sums.get(k, 0) + v

    for batch in batches:
        sizes = batch.column(1).value_lengths().to_numpy()
        flat = batch.column(1).flatten()
        p, base = (flat.field(k).to_numpy() for k in ("p", "base"))
        langs = np.repeat(batch.column(0).dictionary_encode().indices.to_numpy(), sizes)
        lang_names = batch.column(0).dictionary_encode().dictionary.to_pylist()
        sources = flat.field("source").dictionary_encode()
        source_names = sources.dictionary.to_pylist()
        pairs, at = np.unique(langs.astype(np.int64) << 32 | sources.indices.to_numpy(), return_inverse=True)
        group = np.array([names.setdefault((lang_names[x >> 32], source_names[x & 0xFFFFFFFF]), len(names)) for x in pairs.tolist()], np.int64)[at]
        # every entry with every other of its term: a block of entries at a time
        ends = np.cumsum(sizes)
        partners, firsts = np.repeat(sizes, sizes), np.repeat(ends - sizes, sizes)
        upto = np.cumsum(partners)
        start = 0
        while start < len(partners):
            end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + AT_A_TIME, side="right")))
            n = partners[start:end]
            i = np.repeat(np.arange(start, end), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(firsts[start:end], n)
            add(i[i != j], j[i != j], group, p, base)
            start = end
        if len(sums) >= HELD_PAIRS:
            yield out()
    yield out()


def audit(docs: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank: see the module."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = cut_lineage(frequencies(docs))
    each = found.select("lang", "term", "total", F.inline(F.arrays_zip("sources", "times"))).withColumnRenamed("sources", "source")
    sizes = each.groupBy("lang", "source").agg(F.sum("times").alias("size"), F.count(F.lit(1)).alias("occurring"))
    langs = found.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("total").alias("lang_size"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = docs.select(empty("lang"), empty("source")).distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", zero("size"), zero("occurring"), zero("n_terms"), zero("lang_size"))
    groups = cut_lineage(groups.withColumn("base", _share(F.lit(0), F.col("size"), F.col("n_terms"))))
    n_groups, postings = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("occurring"), F.lit(0))).first()
    key = F.struct("lang", "source").alias("group")
    facts = groups.select(key, "size", "occurring", "n_terms", "lang_size", "base")
    shares = attach(each.withColumn("group", F.struct("lang", "source")), facts, "group", "occurring", postings, F.col("term"), n_groups=n_groups)
    shares = cut_lineage(shares.select(
        "lang", "source", "term", "base", _share(F.col("times"), F.col("size"), F.col("n_terms")).alias("p"),
        _share(F.col("total"), F.col("lang_size"), F.col("n_terms")).alias("q")))
    result = [_terms(shares, ranks), _pairs(shares, groups)]
    out = cut_lineage(result[0].unionByName(result[1]))
    release(found, groups, shares)
    return out


def _terms(shares: DataFrame, ranks: int) -> DataFrame:
    """The terms of each source that are more frequent than in the language, the most divergent first."""
    more = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                         _divergence(F.col("p"), F.col("q")).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """Divergence of every source of a language from every other."""
    exact = lambda c: c.cast("decimal(38,0)")
    one = groups.select("lang", "source", "base", "n_terms")
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other_base"))
    base, theirs, p = F.col("base"), F.col("other_base"), F.col("p")
    flat = _divergence(base, theirs)
    # as if no term occurred
    pairs = one.join(other, "lang").filter("source <> item").select("lang", "source", "item", exact(F.col("n_terms")) * flat.cast("decimal(19,0)"))
    # terms of one group, by their number at each p
    alike = shares.groupBy("lang", "source", "base", "p").agg(F.count(F.lit(1)).alias("n"))
    met = alike.join(other, "lang").filter("source <> item")
    summed = lambda a, b: F.sum((a - b).cast("decimal(19,0)") * F.col("n").cast("decimal(18,0)"))
    changes = met.groupBy("lang", "source", "item").agg(
        summed(_divergence(p, theirs), flat).alias("there"), summed(_divergence(theirs, p), _divergence(theirs, base)).alias("back"))
    there = changes.select("lang", "source", "item", exact(F.col("there")))
    back = changes.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), exact(F.col("back")))
    # terms of both
    common = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "base")).alias("entries")).filter("size(entries) > 1")
    both = common.select("lang", "entries").mapInArrow(_both, "lang string, source string, item string, value long")
    parts_ = pairs.toDF("lang", "source", "item", "value")
    for more in (there, back, both.withColumn("value", exact(F.col("value")))):
        parts_ = parts_.union(more.toDF("lang", "source", "item", "value"))
    total = parts_.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return total.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


ORACLE_SQL = r"""
    WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row_no,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    words AS (SELECT lang, source, row_no, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    per_doc AS MATERIALIZED (SELECT lang, source, row_no, term, count(*) AS c FROM words GROUP BY ALL),
    kept AS MATERIALIZED (SELECT lang, term, CAST(sum(c) AS HUGEINT) AS total FROM per_doc GROUP BY ALL HAVING count(*) >= 3),
    counts AS MATERIALIZED (SELECT lang, source, term, CAST(sum(c) AS HUGEINT) AS c FROM per_doc SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    groups AS MATERIALIZED (
        SELECT lang, source, coalesce(n, 0) AS n, coalesce(v, 0) AS v, coalesce(nl, 0) AS nl FROM (SELECT DISTINCT lang, source FROM d)
        LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL) USING (lang, source)
        LEFT JOIN (SELECT lang, count(*) AS v, sum(total) AS nl FROM kept GROUP BY ALL) USING (lang)),
    p AS MATERIALIZED (
        SELECT lang, source, term, coalesce(c, 0) AS c,
               1 + CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 1) // CAST(n + v AS HUGEINT) AS p,
               1 + CAST(1000000000 AS HUGEINT) * (total + 1) // CAST(nl + v AS HUGEINT) AS q
        FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
    pairs AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    parts AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
           CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
    FROM parts QUALIFY part = 'pair' OR rank <= 200"""
