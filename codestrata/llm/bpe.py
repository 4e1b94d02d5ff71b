"""Byte-level BPE with given ranks: whole texts to token ids and back.

Encoding has two tiers. A minimal perfect hash over the vocabulary resolves a pre-token
that is a token already; the bytes in its slot are compared. Any other pre-token is
merged byte by byte: a heap holds the ranks of adjacent pairs, a linked list joins
neighbours. Results are remembered for each worker in a store of bounded size.

A null text is encoded as an empty one, and decodes to empty bytes.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.common import ship, slices
from codestrata.llm.mph import Mph, as_keys
from codestrata.llm.pretokens import Splitter

#: Pre-tokens that a worker remembers, twice at most.
REMEMBERED = 3 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _digest(token: bytes) -> bytes:
    return xxhash.xxh3_128_digest(token)


class Vocabulary:
    """Tokens by slot of a minimal perfect hash, and by id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        tokens = list(ranks)
        keys = as_keys([_digest(t) for t in tokens])
        self.mph = Mph.build(keys)
        self.held: list[tuple[bytes, int]] = [(b"", -1)] * len(tokens)
        for slot, token in zip(self.mph.slots(keys).tolist(), tokens):
            self.held[slot] = (token, ranks[token])
        size = max(ranks.values(), default=-1) + 1
        self.lengths = np.zeros(size, np.int64)
        by_id = [b""] * size
        for token, i in ranks.items():
            by_id[i], self.lengths[i] = token, len(token)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def find(self, token: bytes) -> int:
        """Id of a token, -1 if there is none."""
        key = _digest(token)
        slot = self.mph.slot(int.from_bytes(key[:8], "little"), int.from_bytes(key[8:], "little"))
        held = self.held[slot]
        return held[1] if slot >= 0 and held[0] == token else -1

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no token: always the adjacent pair of least rank, the leftmost of equals, is merged."""
        n, rank_of = len(piece), self.ranks.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))  # starts of the neighbours of a part
        stop = list(range(1, n + 1))  # its end, 0 once it was merged into the one before
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := rank_of(piece[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            j = after[i]
            if not stop[i] or j >= n or stop[j] != end:
                continue  # one of the two has changed since
            stop[i], stop[j] = end, 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of(piece[i:stop[k]])) is not None:
                    heappush(heap, (rank, i, stop[k]))
            p = before[i]
            if p >= 0 and (rank := rank_of(piece[p:end])) is not None:
                heappush(heap, (rank, p, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i:stop[i]]])
            i = after[i]
        return out

    def encode_piece(self, piece: str) -> bytes:
        """Ids of a pre-token as 4 bytes each."""
        data = piece.encode()
        whole = self.find(data)
        return array("i", [whole] if whole >= 0 else self.merge(data)).tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens, one after the other."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        shift = np.repeat(self.starts[ids] - ends + lengths, lengths)
        return self.bytes[shift + np.arange(ends[-1])].tobytes()


class Store(dict):
    """Results of a function by argument; the older half is forgotten when ``limit`` is reached twice."""

    def __init__(self, make, limit: int = REMEMBERED) -> None:
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Tokenizer:
    """Vocabulary and split pattern. A worker keeps one, from what the driver has read."""

    _made: tuple[str, Tokenizer] | None = None

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.vocabulary, self.splitter = Vocabulary(ranks), Splitter(pattern)
        self.pieces = Store(self.vocabulary.encode_piece)

    @classmethod
    def of(cls, shared) -> Tokenizer:
        if cls._made is None or cls._made[0] != shared.name:
            cls._made = None  # the store of another one goes first
            cls._made = shared.name, cls(*shared.value)
        return cls._made[1]

    def encode(self, text: str | None) -> np.ndarray:
        get = self.pieces.__getitem__
        return np.frombuffer(b"".join(b"".join(map(get, found)) for found in self.splitter.blocks(text or "")), "<i4")


class Shared:
    """A broadcast value; ``name`` tells values apart."""

    def __init__(self, spark: SparkSession, value, name: str = "") -> None:
        self.held, self.name = spark.sparkContext.broadcast(value), name

    @property
    def value(self):
        return self.held.value


def shared_tokenizer(spark: SparkSession, path: str, pattern: str) -> Shared:
    """The rank file is read on the driver; its size is that of a vocabulary, whatever the input."""
    ship(spark)
    ranks = read_ranks(path)
    name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    return Shared(spark, (ranks, pattern), name)


def encode(docs: DataFrame, tokenizer: Shared) -> DataFrame:
    """doc_id and ``ids``, the token ids of the whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tokenizer.of(tokenizer)
        for batch in slices(batches):
            ids = [own.encode(x) for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, tokenizer: Shared) -> DataFrame:
    """Adds to ``tokens(doc_id, ids)`` the bytes that the ids stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tokenizer.of(tokenizer).vocabulary
        for batch in slices(batches):
            ids = batch.column(1)
            flat, ends = ids.flatten().to_numpy(), np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy())))
            out = [own.decode(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, tokenizer: Shared) -> DataFrame:
    """doc_id, ``ids`` and ``decoded``, the bytes that the ids stand for, in one pass: a task needs one worker, not two."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tokenizer.of(tokenizer)
        for batch in slices(batches):
            ids = [own.encode(x) for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            decoded = pa.array([own.vocabulary.decode(x) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, decoded], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def listed(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")


def op3(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    shared = shared_tokenizer(docs.sparkSession, path, pattern)
    return round_trip(docs, shared).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
