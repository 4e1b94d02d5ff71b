"""Token counts of a byte-level BPE vocabulary without materialising ids.

Documents become rows (document, pre-token, frequency). Every distinct pre-token is
given to the library once, for the whole corpus, and the number of its pieces is
joined to the frequencies and summed. The most frequent pre-tokens, at most ``HEAD`` with
keys of at most ``KEY_BYTES`` and two bytes, are joined by broadcast, so that none is left
that is hot; the others by a shuffle on the pre-token.

A special token's string inside a text is that token, as the library's default has it.
Null texts count as empty. Rows are counted one by one, also where a doc_id repeats.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.bpe import Shared
from codestrata.llm.common import ship, slices
from codestrata.llm.pretokens import Splitter
from codestrata.session import cut_lineage

HEAD = 1 << 18

#: A longer pre-token (in bytes) is joined by its digest.
KEY_BYTES = 64

#: The pattern of this kind of tokenizer; the library uses it, but does not expose it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def shared_file(spark: SparkSession, path: str) -> Shared:
    """The tokenizer's file and its special tokens; read on the driver, as large as a vocabulary."""
    from tokenizers import Tokenizer

    ship(spark)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    special = sorted((t.content for t in Tokenizer.from_str(text).get_added_tokens_decoder().values()), key=len, reverse=True)
    return Shared(spark, (text, special))


def _split(text: str, special: regex.Pattern | None) -> tuple[list[str], int]:
    """The parts of a text between special tokens, and how many of these there are."""
    parts = special.split(text) if special else [text]
    return parts, len(parts) - 1


def _key(piece: str) -> str:
    data = piece.encode()
    return piece if len(data) <= KEY_BYTES else "\0" + hashlib.sha256(data).hexdigest()


def _patterns(special: list[str]) -> tuple[Splitter, regex.Pattern | None]:
    return Splitter(PATTERN), regex.compile("|".join(map(regex.escape, special))) if special else None


def pretoken_counts(docs: DataFrame, tokenizer: Shared, head: Shared) -> DataFrame:
    """(row, doc_id, n_bytes, key, freq) for ``docs(row, doc_id, text)``, without the pre-tokens in ``head``.

    For every row there is one more with a null key: its special tokens and the tokens of
    the pre-tokens in ``head``. Only this one has doc_id and n_bytes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, special = _patterns(tokenizer.value[1])
        known = head.value
        for batch in slices(batches):
            rows, ids, sizes, keys, freqs = [], [], [], [], []
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                parts, n = _split(text or "", special)
                seen: Counter = Counter()
                for part in parts:
                    for found in splitter.blocks(part):
                        seen.update(found)
                for piece, freq in seen.items():
                    key = piece if len(piece) <= KEY_BYTES // 4 else _key(piece)
                    if each := known.get(key):
                        n += freq * each
                    else:
                        keys.append(key)
                        freqs.append(freq)
                more = len(keys) - len(rows)
                rows += [row] * (more + 1)
                ids += [None] * more + [doc_id]
                sizes += [None] * more + [len((text or "").encode())]
                keys.append(None)
                freqs.append(n)
            kinds = {"row": pa.int64(), "doc_id": pa.int64(), "n_bytes": pa.int64(), "key": pa.string(), "freq": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((rows, ids, sizes, keys, freqs), kinds.values())], list(kinds))

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, n_bytes long, key string, freq long")


def corpus_pieces(docs: DataFrame, tokenizer: Shared) -> DataFrame:
    """(key, piece, freq) over the corpus, piece null where it is the key; added up within each task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, special = _patterns(tokenizer.value[1])
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = [_key(x) for x in seen]
            pieces = [None if k == x else x for k, x in zip(keys, seen)]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(pieces, pa.string()), pa.array(list(seen.values()), pa.int64())], ["key", "piece", "freq"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                for part in _split(text or "", special)[0]:
                    for found in splitter.blocks(part):
                        seen.update(found)
            if len(seen) > HEAD:
                yield out()
                seen.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "key string, piece string, freq long").groupBy("key", "piece").agg(F.sum("freq").alias("freq"))


def piece_lengths(pieces: DataFrame, tokenizer: Shared) -> DataFrame:
    """(key, freq, n) with the number of tokens of each distinct pre-token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(tokenizer.value[0])
        for batch in slices(batches, 2048):
            n = [len(e.ids) for e in own.encode_batch(batch.column(2).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["key", "freq", "n"])

    return pieces.select("key", "freq", F.coalesce("piece", "key").alias("piece")).mapInArrow(run, "key string, freq long, n long")


def _head_threshold(counted: DataFrame) -> float:
    """A frequency that at most HEAD pre-tokens reach; found on a histogram of eighths of powers of two."""
    step = F.floor(F.log2("freq") * 8).cast("int")
    held, least = 0, math.inf
    for b, n in sorted(((r[0], r[1]) for r in counted.groupBy(step.alias("bin")).count().collect()), reverse=True):
        held += n
        if held > HEAD:
            break
        least = b
    return least


def token_counts(docs: DataFrame, tokenizer: Shared, limit: int = 1024) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, n_bytes, n_tokens and over_limit, a row for each row.

    Rows are numbered in the pass that cuts their texts, and only there: their facts travel with
    their pre-tokens, so that no other reading of the input has to number them alike.
    """
    ship(docs.sparkSession)
    counted = cut_lineage(piece_lengths(corpus_pieces(docs, tokenizer), tokenizer))
    in_head = F.floor(F.log2("freq") * 8).cast("int") >= F.lit(_head_threshold(counted))
    head = Shared(docs.sparkSession, {r[0]: r[1] for r in counted.filter(in_head).select("key", "n").collect()})
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    pairs = pretoken_counts(rows, tokenizer, head).withColumn("_salt", F.when(F.col("key").isNull(), F.col("row")).otherwise(0))
    tail = counted.filter(~in_head).select(F.col("key").alias("_key"), "n", F.lit(0).cast("long").alias("_salt0"))
    met = pairs.join(tail, (pairs["key"] == tail["_key"]) & (pairs["_salt"] == tail["_salt0"]), "left")
    lost = F.raise_error(F.concat(F.lit("pre-token without count: "), F.col("key"))).cast("long")
    n = F.when(F.col("key").isNull(), F.lit(1).cast("long")).when(F.col("n").isNull(), lost).otherwise(F.col("n"))
    return met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("freq") * n).alias("n_tokens")).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    return token_counts(docs.select("doc_id", "text"), shared_file(docs.sparkSession, path), limit)
