"""Column expressions for paths, lines, tokens and text tests.

Everything here is built from native functions, so it stays inside generated
code and works alike in batch and streaming queries.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from codestrata.functions import fixed

WHITESPACE = " \t\n\r\x0b\x0c"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quote(token: str) -> str:
    """Literal text as a regular expression."""
    return re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", token)


def alternation(tokens: Iterable[str]) -> str:
    return "|".join(quote(t) for t in tokens)


def contains_any(c: Column | str, tokens: Iterable[str]) -> Column:
    """True when the text contains one of the literal tokens: one regex, one pass."""
    return col(c).rlike(alternation(tokens))


def ends_with_any(c: Column | str, suffixes: Iterable[str]) -> Column:
    return col(c).rlike(f"(?:{alternation(suffixes)})$")


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


# --- paths -----------------------------------------------------------------

def basename(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def dirname(path: Column | str) -> Column:
    """Parent folder; ``.`` for a top-level file."""
    p = col(path)
    return F.when(F.instr(p, "/") == 0, F.lit(".")).otherwise(
        F.left(p, F.length(p) - F.length(basename(p)) - 1))


def extension(path: Column | str) -> Column:
    """Lower-cased extension with its dot, empty when there is none."""
    return F.lower(F.regexp_extract(basename(path), r"\.[^.]*$", 0))


def slashes(path: Column | str) -> Column:
    p = col(path)
    return F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))


def segments(path: Column | str) -> Column:
    return F.split(col(path), "/")


def first_segment(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", 1)


def ancestors(path: Column | str) -> Column:
    """Every folder above a file, outermost first."""
    segs = segments(path)
    depth = slashes(path)
    return F.when(
        depth > 0,
        F.transform(F.sequence(F.lit(1), depth),
                    lambda i: F.array_join(F.slice(segs, F.lit(1), i), "/")),
    ).otherwise(F.array().cast("array<string>"))


def glob_regex(glob: str) -> str:
    return "^" + quote(glob).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + "$"


def join_path(*parts: Column | str) -> Column:
    return F.concat_ws("/", *parts)


def relative_path(path: Column | str, root: Column | str) -> Column:
    return F.regexp_replace(F.substring(col(path), F.length(col(root)) + 1, 2_147_483_647), "^/+", "")


# --- lines, tokens, hashes ---------------------------------------------------

def line_count(content: Column | str) -> Column:
    """Number of lines; a closing line break does not open another line."""
    c = col(content)
    breaks = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return F.when(c == "", F.lit(0)).otherwise(
        breaks + F.when(c.endswith("\n"), F.lit(0)).otherwise(F.lit(1)))


def tokens_of_length(chars: Column) -> Column:
    return F.floor(chars / fixed.CHARS_PER_TOKEN).cast("int") + fixed.TOKEN_PADDING


def token_estimate(content: Column | str) -> Column:
    return tokens_of_length(F.length(col(content)))


def content_hash(content: Column | str) -> Column:
    return F.md5(col(content).cast("binary"))


def key_prefix(path: Column | str) -> Column:
    return F.left(content_hash(path), F.lit(8))


def cache_key(path: Column | str, kind: Column | str) -> Column:
    base = basename(path)
    safe = F.when(base.isin("", "."), F.lit("root")).otherwise(base)
    return F.concat_ws("_", safe, col(kind), key_prefix(path))


def identifier(name: Column | str) -> Column:
    return F.translate(col(name), "-. ", "___")


def is_expired(ts: Column | str, now: Column, ttl_hours: int = fixed.CACHE_TTL_HOURS) -> Column:
    return col(ts) < now - F.expr(f"INTERVAL '{int(ttl_hours)}' HOUR")


def truncated(text: Column | str, chars: int) -> Column:
    t = col(text)
    return F.when(F.length(t) > chars, F.concat(F.left(t, F.lit(chars)), F.lit("..."))).otherwise(t)


def redacted(content: Column | str) -> Column:
    """Hide the value part of every line that names a secret.

    Lines are matched in place: the look-ahead finds a secret word on the line,
    the first pattern cuts after the first colon, the second one after the first
    equals sign of a line that has no colon.  (?d) makes the line feed the only
    line end.
    """
    words = alternation(fixed.REDACT_TOKENS)
    named = rf"(?dm)^(?=[^\n]*(?i:{words}))"
    out = F.regexp_replace(col(content), named + r"([^:\n]*):[^\n]*$", "$1: [REDACTED]")
    return F.regexp_replace(out, named + r"([^:=\n]*)=[^:\n]*$", "$1=[REDACTED]")


def json_encode(*cols: Column | str) -> Column:
    return F.to_json(F.struct(*cols))


def json_decode(c: Column | str, schema) -> Column:
    return F.from_json(col(c), schema)
