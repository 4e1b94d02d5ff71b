"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash over the last ``WINDOW`` bytes cuts the UTF-8 bytes of a text wherever it
falls below a bound, on average every ``MEAN`` bytes, and at latest ``LONGEST`` bytes
after the last cut. A cut depends on the bytes just before it only, so an insertion
moves no cut behind it, and a passage has the same chunks wherever it stands, apart
from its edges. Chunks are deduplicated by a 64-bit digest: one that occurs in two
documents or more is repeated, and the smallest doc_id that has it is its first place.

Neighbouring repeated chunks form a span. The passage behind it begins and ends within
the chunks beside the span. So a span with more words than asked for is reported at once,
one that has too few even with the chunks beside it is not, and of the others the edges
are read: the whole words beside the span that also stand there, in the same order,
beside the same chunk of another row. They are found by hashes of all such runs of words.
The extent of a reported span is that of its chunks, so it lies within its passage. The
digests are not compared byte by byte: a span is several chunks, which do not collide
together by chance.

Every row with a text is a document of its own, also without a doc_id or with one that
repeats; repeats within one row do not count. Of rows that share the smallest doc_id
one is the first place; rows without a doc_id come after the others. Null texts have no chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import ROW, attach, numbered, ship, slices, without_names
from codestrata.session import cut_lineage, release

WINDOW = 16
MEAN = 24
LONGEST = 256
WORDS = 51
SURE = 8

CHUNKS = "digest long, doc_id long, row_key long, start int, stop int, words int, beside int"
EDGES = "row_key long, side int, pos int, gain int, run long"

#: Random numbers for the 256 bytes, from a digest of each.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b])) & 0xFFFF for b in range(256)], np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the gears of the last WINDOW bytes, each shifted by its distance."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        later = h[width:] + (h[:-width] << np.uint16(width))
        h = np.concatenate((h[:width], later))
        width *= 2
    return h


def cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the chunks of texts that lie one after the other and end at ``ends``."""
    low = np.flatnonzero(gear_hashes(data) < np.uint16(65536 // MEAN)) + 1
    starts = np.concatenate(([0], ends[:-1]))
    low = low[low - starts[np.searchsorted(ends, low)] >= WINDOW]  # the hash must not reach into the text before
    at = np.unique(np.concatenate((low, ends)))
    begin = np.concatenate(([0], at[:-1]))
    more = [np.arange(begin[i] + LONGEST, at[i], LONGEST) for i in np.flatnonzero(at - begin > LONGEST)]
    return np.unique(np.concatenate((at, *more))) if more else at


def chunk_table(texts: list[bytes]) -> list[np.ndarray]:
    """Digest, number of the text, start, stop, words and ``beside`` of the chunks of some texts; none without bytes."""
    there = [i for i, t in enumerate(texts) if t]
    joined = b"".join(texts)
    if not joined:
        return [np.zeros(0, np.int64)] * 6
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(texts[i]) for i in there])
    stop = cuts(data, ends)
    start = np.concatenate(([0], stop[:-1]))
    owner = np.searchsorted(ends, stop)
    begin = np.concatenate(([0], ends[:-1]))
    white = (data == 32) | ((data >= 9) & (data <= 13))
    first = ~white & np.concatenate(([True], white[:-1]))
    first[begin] = ~white[begin]
    count = np.concatenate(([0], np.cumsum(first)))
    words = count[stop] - count[start]
    same = owner[1:] == owner[:-1]
    before, after = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    # a text that begins with the passage has no cut in its first WINDOW bytes, others may
    reach = np.maximum(start[:-1] - WINDOW, begin[owner[1:]])
    before[1:], after[:-1] = np.where(same, count[start[1:]] - count[np.minimum(reach, start[1:])], 0), np.where(same, words[1:], 0)
    h = xxhash.xxh3_64_intdigest
    digest = np.array([h(joined[a:b]) for a, b in zip(start.tolist(), stop.tolist())], np.uint64).view(np.int64)
    return [digest, np.array(there)[owner], start - begin[owner], stop - begin[owner], words, before << 16 | after]


def edge_runs(data: bytes, side: int, pos: int, least: int, most: int, digest: int) -> list[tuple[int, int | None]]:
    """(gain, hash) of the runs of ``least`` to ``most`` whole words before ``pos`` (side 0) or behind it (side 1).

    A word that ``pos`` cuts counts for the span, so behind it a run begins with the rest of that word and gains
    nothing by it; if no run is repeated the span loses it. The row without a hash says so.
    """
    h, out = xxhash.xxh3_64_intdigest, []
    seed = h(digest.to_bytes(8, "little", signed=True) + bytes([side]))
    if side == 0:
        low = max(0, pos - 2 * LONGEST)
        begin = pos
        for at, word in enumerate(reversed(data[low:pos].rsplit(None, most)[-most:] if most > 0 else ()), 1):
            begin = data.rfind(word, low, begin)
            if at >= least and (begin > low or not low or data[low - 1] in _WHITE):
                out.append((at, h(data[begin:pos], seed) - (1 << 63)))
        return out
    cut = 0 < pos < len(data) and data[pos - 1] not in _WHITE
    if cut and data[pos] not in _WHITE:
        out.append((-1, None))
    at, last = 0, min(len(data), pos + 2 * LONGEST)
    for m in _WORD.finditer(data, pos, last):
        begin, end = m.span()
        at += begin > pos or not cut
        if at > most:
            break
        if at >= least and (end < last or end == len(data) or data[end] in _WHITE):
            out.append((at, h(data[pos:end], seed) - (1 << 63)))
    return out


_WHITE = b" \t\n\v\f\r"
_WORD = re.compile(rb"[^ \t\n\v\f\r]+")


def named(docs: DataFrame, key: str | None) -> DataFrame:
    """doc_id, row_key and text of the rows that have a text."""
    rows, key = (numbered(docs), ROW) if key is None else (docs, key)
    return rows.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.xxhash64(key).alias("row_key"), "text")


def chunks(rows: DataFrame) -> DataFrame:
    """Chunks of all texts of ``named`` rows; ``beside`` holds the words of the chunk before and WINDOW bytes more (in its upper half) and of the one behind."""
    ship(rows.sparkSession)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digest, text, *rest = [pa.array(c.astype(np.int64)) for c in chunk_table([x.encode() for x in batch.column(2).to_pylist()])]
            cols = [digest, batch.column(0).take(text), batch.column(1).take(text), *rest]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, types)],
                                             ["digest", "doc_id", "row_key", "start", "stop", "words", "beside"])

    return rows.mapInArrow(run, CHUNKS)


def repeated_spans(docs: DataFrame, words: int = WORDS, sure: int = SURE, key: str | None = None) -> DataFrame:
    """doc_id, row_key, start, stop (bytes), n_words, first_doc_id, is_first and repeats: a row for each repeated span of each row.

    ``repeats`` are the ranges of at least ``sure`` words whose first place is another row; ``is_first`` if there
    are none. ``first_doc_id`` is that of the span's longest range. ``row_key`` tells rows apart: a digest of the
    column ``key``, or without one of the place in a plain Parquet table.
    """
    rows = named(docs, key)
    found = chunks(rows)
    twice = found.groupBy("digest").agg(
        F.min("doc_id").alias("first_doc"), F.coalesce(F.min_by("row_key", "doc_id"), F.min("row_key")).alias("first_row"),
        F.min("row_key").alias("low"), F.max("row_key").alias("high"), F.count(F.lit(1)).alias("n"))
    twice = cut_lineage(twice.filter("low <> high").select("digest", "first_doc", "first_row", "n"))
    repeated = twice.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    one = cut_lineage(attach(found, twice, "digest", "n", repeated, F.col("row_key")).filter("first_row is not null").select(
        "doc_id", "row_key", "start", "stop", "words", "beside", "digest", "first_doc", (F.col("first_row") == F.col("row_key")).alias("_own")))
    # islands of chunks that follow each other in a row, and their parts that are all at their first place or all not
    order = "over (partition by row_key order by start, stop)"
    isles = one.withColumn("_new", F.expr(f"start <> coalesce(lag(stop) {order}, -1)"))
    isles = isles.withColumn("_turn", F.expr(f"_new or _own <> lag(_own) {order}"))
    isles = isles.withColumn("_span", F.expr(f"sum(cast(_new as int)) {order}")).withColumn("_part", F.expr(f"sum(cast(_turn as int)) {order}"))
    parts = isles.groupBy("doc_id", "row_key", "_span", "_part").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("n_words"),
        F.min("first_doc").alias("first_doc_id"), F.min("_own").alias("is_first"),
        F.shiftright(F.min_by("beside", "start"), 16).alias("_before"),
        F.max_by("beside", "start").bitwiseAND(F.lit(0xFFFF)).alias("_after"),
        F.min_by("digest", "start").alias("_head"), F.max_by("digest", "start").alias("_tail"))
    spans = parts.groupBy("doc_id", "row_key", "_span").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n_words").alias("n_words"),
        F.max_by("first_doc_id", F.struct("n_words", "start")).alias("first_doc_id"),
        F.sort_array(F.collect_list(F.when(~F.col("is_first") & (F.col("n_words") >= sure), F.struct("start", "stop")))).alias("repeats"),
        *[F.min_by(c, "start").alias(c) for c in ("_before", "_head")], *[F.max_by(c, "start").alias(c) for c in ("_after", "_tail")])
    spans = cut_lineage(spans.withColumn("is_first", F.size("repeats") == 0).filter(
        (F.col("n_words") >= sure) & (F.col("n_words") + F.col("_before") + F.col("_after") >= words)))
    gains = edge_gains(rows, one, spans.filter(F.col("n_words") <= words), words)  # a span's last word may be cut
    release(one, twice)
    for side, pos in ((0, "start"), (1, "stop")):
        at = gains.filter(F.col("side") == side).select(F.col("row_key").alias("_row"), F.col("pos").alias("_pos"), F.col("gain").alias(f"_gain{side}"))
        spans = spans.join(at, (F.col("row_key") == F.col("_row")) & (F.col(pos) == F.col("_pos")), "left").drop("_row", "_pos")
    return spans.filter((F.col("n_words") > words) | (F.expr("n_words + coalesce(_gain0, 0) + coalesce(_gain1, 0)") >= words)).select(
        "doc_id", "row_key", "start", "stop", "n_words", "first_doc_id", "repeats", "is_first")


def edge_gains(rows: DataFrame, one: DataFrame, spans: DataFrame, words: int) -> DataFrame:
    """row_key, side, pos and gain: most whole words beside the edges of ``spans`` that another row has there too.

    All places of the chunks at those edges are read, in whatever span they lie; runs of words are counted by hash.
    Runs too short to bring a span of that chunk to ``words`` are left out.
    """
    side = lambda no, pos, digest, other: F.struct(
        F.lit(no).alias("side"), F.col(pos).alias("pos"), F.col(digest).alias("digest"), (F.lit(words) - F.col("n_words") - F.col(other)).alias("least"))
    own = spans.select("row_key", F.explode(F.array(side(0, "start", "_head", "_after"), side(1, "stop", "_tail", "_before"))).alias("e")).select("row_key", "e.*")
    asked = cut_lineage(own.groupBy("side", "digest").agg(F.min("least").cast("int").alias("least")))
    most = F.when(F.col("side") == 0, F.shiftright("beside", 16)).otherwise(F.col("beside").bitwiseAND(F.lit(0xFFFF)))
    places = one.join(asked, "digest").select(
        "row_key", "side", F.when(F.col("side") == 0, F.col("start")).otherwise(F.col("stop")).alias("pos"), "least", most.alias("most"), "digest")
    places = cut_lineage(places.filter("least <= most"))
    edges = _edges(rows, places)
    shared = edges.filter("run is not null").groupBy("run").agg(
        F.min("row_key").alias("low"), F.max("row_key").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high").select("run", "n")
    shared = cut_lineage(shared)
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    mine = _edges(rows, places.join(own.select("row_key", "side", "pos"), ["row_key", "side", "pos"], "left_semi"))
    met = attach(mine, shared, "run", "n", total, F.col("row_key")).filter("run is null or n is not null")
    gains = cut_lineage(met.groupBy("row_key", "side", "pos").agg(F.max("gain").alias("gain")))
    release(asked, places, shared)
    return gains


def _edges(rows: DataFrame, places: DataFrame) -> DataFrame:
    """EDGES: the runs of words at some places of some rows."""
    places = places.groupBy("row_key").agg(F.collect_list(F.struct("side", "pos", "least", "most", "digest")).alias("_places"))
    joined = rows.select(F.col("row_key").alias("_row"), "text").join(places, F.col("_row") == F.col("row_key")).select("row_key", "text", "_places")
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text, own = (batch.column(i).to_pylist() for i in (1, 2))
            places, n, out = [], [], []
            for i, (t, es) in enumerate(zip(text, own)):
                data = t.encode()
                for e in es:
                    runs = edge_runs(data, e["side"], e["pos"], e["least"], e["most"], e["digest"])
                    if runs:
                        places.append((i, e["side"], e["pos"]))
                        n.append(len(runs))
                        out += runs
            at = np.repeat(np.array(places, np.int64).reshape(-1, 3), n, axis=0)
            gain, run_ = zip(*out) if out else ((), ())
            cols = [batch.column(0).take(pa.array(at[:, 0])), at[:, 1].astype(np.int32), at[:, 2].astype(np.int32), gain, run_]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types)], ["row_key", "side", "pos", "gain", "run"])

    return joined.mapInArrow(run, EDGES)


def without_repeats(docs: DataFrame, spans: DataFrame, key: str | None = None) -> DataFrame:
    """Documents without the repeats of their spans; what is at its first place stays. A cut never splits a character.

    ``key`` as for ``repeated_spans``.
    """
    ship(docs.sparkSession)
    gone = spans.filter("not is_first").groupBy(F.col("row_key").alias("_gone_row")).agg(
        F.sort_array(F.flatten(F.collect_list("repeats"))).alias("_gone"))
    rows = numbered(docs) if key is None else docs
    joined = rows.join(gone, F.xxhash64(rows[ROW if key is None else key]) == gone["_gone_row"], "left").drop("_gone_row")
    if key is None:
        joined = without_names(joined)
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for text, spans_ in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if spans_ and text is not None:
                    data, kept, last = text.encode(), [], 0
                    for s in spans_:
                        kept.append(data[last:s["start"]])
                        last = s["stop"]
                    text = b"".join([*kept, data[last:]]).decode(errors="ignore")
                texts.append(text)
            cols = list(batch.columns[:-1])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])

    return joined.mapInArrow(run, schema)
