"""Small constant tables as DataFrames.

Their size is fixed by the lists they are built from and never grows with the
input, which is what makes the broadcast hint safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from codestrata.functions import fixed


def constant(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def detection_rules(spark: SparkSession, rules=None) -> DataFrame:
    """``(type, rule, score, kind, token, pos, label)``, one row per token."""
    rows = []
    for kind_type, rule, score, exts, dirs, words in rules or fixed.DETECTION_RULES:
        tokens = ([("ext", t, t) for t in exts] + [("dir", t.lower(), t) for t in dirs]
                  + [("keyword", t.lower(), t) for t in words])
        rows += [(kind_type, rule, float(score), kind, token, pos, label)
                 for pos, (kind, token, label) in enumerate(tokens)]
    return constant(spark, rows, "type string, rule string, score double, kind string, "
                                 "token string, pos int, label string")


def tokens_of(rules, kind: str) -> list[str]:
    index = {"ext": 3, "dir": 4, "keyword": 5}[kind]
    seen: dict[str, None] = {}
    for rule in rules or fixed.DETECTION_RULES:
        for token in rule[index]:
            seen[token.lower()] = None
    return list(seen)
