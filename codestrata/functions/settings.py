"""Columns about required configuration: placeholders, secret names, types and texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codestrata.functions import fixed
from codestrata.functions.text import col, contains_any, strip


def is_placeholder(value: Column | str) -> Column:
    """Empty, a pair of quotes, or a text that stands for a value still to be set."""
    v = col(value)
    return v.isin("", '""', "''") | contains_any(F.lower(strip(v)), fixed.PLACEHOLDERS)


def looks_secret(key: Column | str) -> Column:
    return contains_any(F.lower(col(key)), fixed.SECRET_KEY_TOKENS)


def is_service_folder(name: Column | str) -> Column:
    return contains_any(F.lower(col(name)), fixed.CONFIG_SERVICE_TOKENS)


def env_name(reference: Column | str) -> Column:
    """``X:default`` -> ``X``."""
    return F.substring_index(col(reference), ":", 1)


def config_type(key: Column | str) -> Column:
    low = F.lower(col(key))
    return (F.when(low.contains("api") & low.contains("key"), "api_key")
            .when(low.rlike("database|db"), "database_url")
            .when(low.rlike("secret|token"), "secret")
            .when(low.rlike("password|pwd"), "credential")
            .otherwise("config"))


def config_description(key: Column | str) -> Column:
    k = col(key)
    low = F.lower(k)
    out = F.when(F.lit(False), "")
    for word, sentence in sorted(fixed.CONFIG_DESCRIPTIONS, key=lambda d: -len(d[0])):
        out = out.when(low.contains(word), sentence)
    for word, before, suffix, after in fixed.CONFIG_GENERIC_DESCRIPTIONS:
        out = out.when(low.contains(word), F.concat(F.lit(before), F.replace(k, F.lit(suffix), F.lit("")), F.lit(after)))
    return out.otherwise(F.concat(F.lit(fixed.CONFIG_FALLBACK_DESCRIPTION), k))


def config_example(key: Column | str) -> Column:
    low = F.lower(col(key))
    out = F.when(F.lit(False), "")
    for words, example in fixed.CONFIG_EXAMPLES:
        test = F.lit(True)
        for word in words:
            test = test & low.rlike(word)
        out = out.when(test, example)
    return out.otherwise(fixed.CONFIG_FALLBACK_EXAMPLE)


def config_summary(total: Column | str, required: Column | str, n_services: Column | str) -> Column:
    t, r, s = col(total), col(required), col(n_services)
    some = F.concat(
        F.lit("Found "), t.cast("string"), F.lit(" environment variables"),
        F.when(r > 0, F.concat(F.lit(", "), r.cast("string"), F.lit(" of which are required to be configured"))).otherwise(""),
        F.when(s > 1, F.concat(F.lit(" across "), s.cast("string"), F.lit(" services"))).otherwise(""),
        F.lit(". Review each variable and provide appropriate values before running the project."))
    return F.when(t == 0, "No configuration secrets detected. This project may not require additional environment variables.").otherwise(some)
