"""Nulls, empty texts, ties, repeated rows, empty tables and columns with clashing names, for every operator and stage."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from codestrata.llm import (bpe, decontaminate, exact_dedup, kd_shards, langid, license_scan, line_dedup, simhash,
                            substring_dedup, token_counts)

LONG = "word " * 60_000
ROWS = [
    (1, "some plain words of a text that is long enough to be a text", "en", "s"), (2, None, "en", None),
    (3, "", None, "s"), (4, " \t\n ", "de", "s"), (5, "some plain  words of a text that is long enough to be a text", "en", "s"),
    (6, LONG, "en", "s"), (None, "a row without an id", "en", "s"), (7, "twice", "fr", "t"), (7, "twice", "fr", "t"),
    (8, "héé \N{GRINNING FACE} <|endoftext|> 'll 中文", "fr", "t"), (9, "12 !!", "fr", "t"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators use inside.
CLASH = ["digest", "fp", "component", "_salt", "_hot", "shard", "h", "place", "score", "rejected", "_gone", "row", "ids", "size", "n"]


def apply(docs, benchmark):
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return {
        "op1": lambda: exact_dedup.op1(docs), "op2": lambda: kd_shards.op2(docs), "op3": lambda: bpe.op3(docs, ranks, pattern),
        "op4": lambda: decontaminate.contaminated(docs, benchmark), "op5": lambda: line_dedup.decisions(docs),
        "op6": lambda: langid.op6(docs), "op7": lambda: token_counts.op7(docs, public_tokenizers.path("byte_bpe_50k.json")),
        "op8": lambda: substring_dedup.repeated_spans(docs), "op9": lambda: simhash.op9(docs), "op10": lambda: license_scan.op10(docs),
    }


NAMES = [f"op{i}" for i in range(1, 11)]
PER_ROW = {"op1", "op2", "op3", "op5", "op6", "op7", "op9", "op10"}


@pytest.fixture(scope="module")
def tables(spark):
    items = [(0, "which item holds these nine words and one more"), (1, None), (2, ""), (3, "which item holds these nine words and one more")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    full = spark.createDataFrame([(*r, *([1] * len(CLASH))) for r in ROWS], SCHEMA + "".join(f", {c} int" for c in CLASH))
    return full, spark.createDataFrame([], full.schema), benchmark


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(tables, name):
    out = apply(tables[0], tables[2])[name]().collect()
    if name in PER_ROW:
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ROWS)
    by_id = {r["doc_id"]: r for r in out}
    if name == "op1":
        assert by_id[5]["keep_id"] == 1 and not by_id[5]["kept"] and by_id[2]["group_size"] == 2 and by_id[3]["keep_id"] == 2
        assert by_id[7]["group_size"] == 2 and by_id[7]["kept"] and by_id[None]["kept"] and by_id[None]["keep_id"] is None
    if name == "op2":
        assert {r["law"] for r in out} == {"bytes"} and by_id[2]["size"] == 1 and by_id[2]["text_crc32"] == 0
    if name in ("op3", "op7"):
        assert by_id[2]["n_tokens"] == by_id[3]["n_tokens"] == 0
    if name == "op6":
        assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["rejected"] for i in (2, 3, 4, 9))
    if name == "op7":
        assert by_id[6]["n_bytes"] == len(LONG) and by_id[6]["over_limit"]
    if name == "op8":
        assert {r["doc_id"] for r in out} <= {1, 5, 6, 8, 9, 3, 4}
    if name == "op9":
        assert {by_id[i]["fingerprint"] for i in (2, 3, 4)} == {"0" * 16} and by_id[4]["component_id"] == 2
    if name == "op10":
        assert by_id[2]["n_words"] == 0 and by_id[2]["labels"] == "" and by_id[2]["first_word"] is None


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(tables, name):
    assert apply(tables[1], tables[2])[name]().count() == 0


def test_empty_benchmark(spark, tables):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(tables[0], none).count() == 0


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, tables, tmp_path, stage):
    tables[2].write.parquet(f"{tmp_path}/benchmark.parquet")
    f = corpus_pipeline.STAGES[stage][1]
    for docs in tables[:2]:
        out = f(spark, docs, str(tmp_path))
        if stage < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        kept = [r["doc_id"] for r in out.collect()]
        assert set(kept) <= {r[0] for r in ROWS}
        if docs is tables[0]:
            assert {1, 6} <= set(kept)


def test_stages_judge_rows_without_or_with_repeated_ids(spark, tmp_path):
    prose = [" ".join(f"{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i * i % 26)}word" for i in range(k, k + 40)) for k in range(8)]
    item = "which item holds these nine words and one more"
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = prose[0] + " end"
    rows = [(None, prose[0]), (None, prose[1]), (None, prose[2]), (1, prose[0]), (2, prose[3]), (2, prose[4]), (2, prose[3]),
            (3, prose[5]), (4, prose[5]), (4, prose[6]), (None, prose[7]), (None, prose[7])]
    _, exact, near_stage, clean, _ = [f for _, f in corpus_pipeline.STAGES]
    texts = lambda df: sorted((str(r["doc_id"]), r["text"]) for r in df.collect())
    want = sorted((str(i), t) for i, t in [(None, prose[1]), (None, prose[2]), (1, prose[0]), (2, prose[3]), (2, prose[4]), (3, prose[5]),
                                           (4, prose[6]), (None, prose[7])])
    make = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    assert texts(exact(spark, make(rows), str(tmp_path))) == want
    assert texts(near_stage(spark, make([*rows, (9, prose[1].upper())]), str(tmp_path))) == sorted(
        [x for x in want if x != ("None", prose[1])] + [("9", prose[1].upper())])
    leaks = [(None, near), (None, "so " + item), (None, prose[1]), (5, prose[2]), (5, item), (6, prose[3]), (6, prose[3])]
    assert texts(clean(spark, make(leaks), str(tmp_path))) == sorted((str(i), t) for i, t in leaks if item not in t)


def test_language_stage_keeps_the_values_of_clashing_columns(spark):
    """Columns named like those of the model come back as they were, for every row that stays."""
    words = {"en": "the house of the old man stands near the river and the wood", "de": "das alte haus steht neben dem fluss und dem wald der stadt"}
    rows = [(i, f"{words[lang]} {words[lang]} {i}", lang, i, f"s{i}") for i in range(40) for lang in words]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, rejected string")
    kept = langid.keep_known(docs)
    assert kept.schema == docs.schema and set(map(tuple, kept.collect())) <= set(rows) and kept.count() > 60


def test_counts_of_shuffled_input_belong_to_their_rows(spark):
    rows = [(None if i % 5 == 0 else i // 2, "word " * i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = token_counts.op7(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    n_tokens = {r["n_bytes"]: r["n_tokens"] for r in token_counts.op7(
        spark.createDataFrame([(i, x) for i, (_, x) in enumerate(rows)], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert sorted((str(r["doc_id"]), r["n_bytes"]) for r in out) == sorted((str(i), len(x)) for i, x in rows)
    assert all(r["n_tokens"] == n_tokens[r["n_bytes"]] for r in out)
    assert all(a < b for a, b in zip(sorted(n_tokens.values())[1:], sorted(n_tokens.values())[2:]))


def test_shards_of_repeated_rows_are_near_equal(spark):
    """Rows without a doc_id, or with one and the same, are dealt out like others."""
    rows = [(None, "one and the same text")] * 400 + [(7, "one and the same text")] * 400 + [(i, f"text {i}" * (i % 9)) for i in range(400)]
    out = kd_shards.op2(spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")).collect()
    sums = Counter()
    for r in out:
        sums[r["shard"]] += r["size"]
    slots = Counter((r["shard"], r["slot"]) for r in out)
    assert len(sums) == 16 and max(sums.values()) - min(sums.values()) <= 4 * max(r["size"] for r in out)
    assert len(slots) == len(rows) and all(slots[k, i] for k, n in Counter(k for k, _ in slots).items() for i in range(n))


def test_stages_over_tables_keep_columns_named_like_helpers(spark, tmp_path):
    """A table that is read as it is and the same rows from elsewhere give the same, whatever other columns are called."""
    prose = [" ".join(f"{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i * i % 26)}word" for i in range(k, k + 40)) for k in range(6)]
    spark.createDataFrame([(0, prose[5])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i if i % 3 else None, prose[i % 6], f"n{i % 6}") for i in range(24)]
    made = spark.createDataFrame(rows, "doc_id long, text string, _row_no string")
    made.write.parquet(f"{tmp_path}/docs")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        want, got = (sorted((str(r["doc_id"]), r["text"], r["_row_no"]) for r in stage(spark, d, str(tmp_path)).collect())
                     for d in (made, spark.read.parquet(f"{tmp_path}/docs")))
        assert got and got == want and set(got) <= {(str(a), b, c) for a, b, c in rows}
