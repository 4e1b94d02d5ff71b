"""Greedy packing of lines into token-bounded chunks.

A fold over line lengths finds where chunks end; the text is cut once, afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codestrata.functions import fixed
from codestrata.functions.text import col, line_count, token_estimate, tokens_of_length

CHUNK = "struct<content:string,start_line:int,end_line:int,tokens:int>"
_SPAN = "struct<first:int,last:int,chars:int>"


def _chunk(text: Column, start: Column, end: Column, tokens: Column) -> Column:
    return F.struct(text.alias("content"), start.cast("int").alias("start_line"),
                    end.cast("int").alias("end_line"), tokens.cast("int").alias("tokens"))


def _spans(lines: Column, max_tokens: int) -> Column:
    """First line, last line and characters of each chunk; the state of the fold holds numbers only."""
    start = F.struct(F.lit(0).alias("chars"), F.lit(1).alias("first"), F.lit(0).alias("line"),
                     F.array().cast(f"array<{_SPAN}>").alias("done"))

    def span(s: Column) -> Column:
        return F.struct(s["first"].alias("first"), s["line"].alias("last"), s["chars"].alias("chars"))

    def add(s: Column, size: Column) -> Column:
        grown = s["chars"] + size
        full = (tokens_of_length(grown) > max_tokens) & (s["chars"] > 0)
        return F.struct(
            F.when(full, size).otherwise(grown).alias("chars"),
            F.when(full, s["line"] + 1).otherwise(s["first"]).alias("first"),
            (s["line"] + 1).alias("line"),
            F.when(full, F.array_append(s["done"], span(s))).otherwise(s["done"]).alias("done"))

    return F.aggregate(F.transform(lines, lambda line: F.length(line) + 1), start, add,
                       lambda s: F.array_append(s["done"], span(s)))


def _packed(content: Column, max_tokens: int) -> Column:
    def cut(p: Column) -> Column:
        return F.transform(_spans(p["lines"], max_tokens), lambda q: _chunk(
            F.concat(F.array_join(F.slice(p["lines"], q["first"], q["last"] - q["first"] + 1), "\n"), F.lit("\n")),
            q["first"], q["last"], tokens_of_length(q["chars"])))

    # bound to a variable, the lines are split once for the fold and for all chunks
    return F.transform(F.array(F.struct(F.split(content, "\n").alias("lines"))), cut)[0]


def chunks(content: Column | str, max_tokens: int = fixed.CHUNK_TOKENS) -> Column:
    """Array of chunks; text within the limit is one chunk and skips the fold."""
    c = col(content)
    whole = F.array(_chunk(c, F.lit(1), line_count(c), token_estimate(c)))
    return (F.when(c == "", F.array().cast(f"array<{CHUNK}>"))
            .when(token_estimate(c) <= max_tokens, whole)
            .otherwise(_packed(c, max_tokens)))
