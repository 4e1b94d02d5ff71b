"""Exact dedup against a history, by a minimal perfect hash over its distinct digests.

Two texts are equal when their normalised forms have the same SHA-256. The history's
distinct digests are dealt by their leading bytes into shards of bounded size. Each
shard is one table row: a minimal perfect hash whose slots hold the full digest, the
locator (doc_id) of the row that stays and the number of rows. A batch looks its
distinct digests up there; all 32 bytes are compared. Members repeat a row of the
history, the others are grouped among themselves.

Null texts count as empty. A null doc_id never names a group unless all its rows have
none. Rows that repeat both doc_id and text are copies of one row and share its fate in
``op1``; ``keep_first`` keeps one row of each text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import ROW, attach, numbered, parts, ship, without
from codestrata.llm.mph import Mph, as_keys
from codestrata.session import cut_lineage, release

#: Distinct digests in a shard of the index, on average.
SHARD_KEYS = 20_000

INDEX = "shard int, levels array<int>, bits binary, digests binary, winners binary, counts binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the number of the row if it has one, and the 32 bytes that stand for the text."""
    return docs.select("doc_id", *[c for c in docs.columns if c == ROW], F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"))


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row for each digest: the smallest doc_id and the number of rows; summed before the shuffle."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))


def _shard(shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def build_index(distinct: DataFrame, shards: int) -> DataFrame:
    """The index as a table, a row for each shard; keep it and look later batches up in it."""
    ship(distinct.sparkSession)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys = as_keys(list(rows["digest"]), 32)
        mph = Mph.build(keys)
        order = np.argsort(mph.slots(keys))
        ids = rows["winner"].astype("Int64")
        return pd.DataFrame([{
            "shard": rows["shard"].iloc[0], "levels": mph.sizes, "bits": mph.packed,
            "digests": b"".join(rows["digest"].iloc[order]),
            "winners": _pack(ids.iloc[order]), "counts": rows["n"].to_numpy(np.int64)[order].tobytes()}])

    return distinct.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(build, INDEX)


def _pack(ids: pd.Series) -> bytes:
    """Locators of 9 bytes: whether there is one, and the number."""
    out = np.zeros(len(ids), [("there", "u1"), ("id", "<i8")])
    out["there"], out["id"] = ids.notna(), ids.fillna(0).to_numpy(np.int64)
    return out.tobytes()


def look_up(distinct: DataFrame, index: DataFrame, shards: int, blocks: int = 1) -> DataFrame:
    """Adds to each distinct digest: member, and of members the history's winner and count.

    A shard meets its share of the batch in ``blocks`` groups, so that a large batch
    does not make large groups.
    """
    ship(distinct.sparkSession)

    def look(rows: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = rows[["digest", "winner", "n"]].copy()
        out["winner"] = out["winner"].astype("Int64")
        out["member"], out["old_winner"], out["old_n"] = False, pd.array([pd.NA] * len(out), "Int64"), 0
        if len(shard) and len(rows):
            one = shard.iloc[0]
            slots = Mph(one["levels"], one["bits"]).slots(as_keys(list(rows["digest"]), 32))
            held = np.frombuffer(one["digests"], "V32")
            mine = np.frombuffer(b"".join(rows["digest"]), "V32")
            member = (slots >= 0) & (held[np.maximum(slots, 0)] == mine)
            at = slots[member]
            old = np.frombuffer(one["winners"], [("there", "u1"), ("id", "<i8")])[at]
            out["member"] = member
            out.loc[member, "old_winner"] = pd.array(old["id"], "Int64")
            out.loc[np.flatnonzero(member)[old["there"] == 0], "old_winner"] = pd.NA
            out.loc[member, "old_n"] = np.frombuffer(one["counts"], np.int64)[at]
        return out

    block = F.pmod(F.conv(F.hex(F.substring("digest", 7, 6)), 16, 10).cast("long"), F.lit(blocks)).cast("int")
    batch = distinct.withColumn("shard", _shard(shards)).withColumn("block", block)
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return batch.groupBy("shard", "block").cogroup(spread.groupBy("shard", "block")).applyInPandas(
        look, "digest binary, winner long, n long, member boolean, old_winner long, old_n long")


def dedup(rows: DataFrame, is_history: Column) -> DataFrame:
    """``rows(doc_id, digest)`` to doc_id, digest, keep_id, group_size and kept.

    ``is_history`` says of each row whether it belongs to the history, whose rows win.
    """
    history, batch = rows.filter(is_history), rows.filter(~F.coalesce(is_history, F.lit(False)))
    old, new = cut_lineage(distinct_digests(history)), cut_lineage(distinct_digests(batch))
    n_old, n_new = old.count(), new.count()
    shards = parts(n_old, SHARD_KEYS)
    index = cut_lineage(build_index(old, shards))
    found = cut_lineage(look_up(new, index, shards, parts(n_new, SHARD_KEYS * shards)))
    repeats = found.filter("member").select("digest", F.col("old_winner").alias("keep_id"), F.col("n").alias("more"))
    fresh = found.filter("not member").select("digest", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"))
    settled = old.join(repeats.select("digest", "more"), "digest", "left").select(
        "digest", F.col("winner").alias("keep_id"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("group_size"))
    groups = cut_lineage(settled.unionByName(fresh))
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    out = attach(rows, groups, "digest", "group_size", total, F.col("doc_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def older_half(rows: DataFrame) -> Column:
    """History of a corpus whose ids grow with age: the lower half of the range of doc_id."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.lit(False) if low is None else F.coalesce(F.col("doc_id") <= F.lit((low + high) // 2), F.lit(False))


def op1(docs: DataFrame) -> DataFrame:
    rows = cut_lineage(digests(docs))
    return dedup(rows, older_half(rows)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of equal texts, one that has the smallest doc_id, with all its columns."""
    docs = numbered(docs)
    rows = cut_lineage(digests(docs))
    out = cut_lineage(dedup(rows, older_half(rows)).select("digest", "kept", ROW))
    firsts = out.filter("kept").groupBy("digest").agg(F.min(ROW).alias("_first"))
    dropped = cut_lineage(out.join(firsts.select("_first"), F.col(ROW) == F.col("_first"), "left_anti").select(ROW))
    release(rows, out)
    return without(docs, dropped)
