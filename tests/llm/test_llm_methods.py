"""Each method against plain loops, the public libraries, or planted cases."""

import base64
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer as Library

import corpus_pipeline
from codestrata.llm import (bpe, decontaminate, exact_dedup, kd_shards, langid, license_scan, line_dedup, simhash,
                            substring_dedup, token_counts)
from codestrata.llm.components import components
from codestrata.llm.mph import Mph, as_keys
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
PIECES = ["a", "b", " ", "  ", "\n", "é", "ñ", "中", "\N{GRINNING FACE}", "'s", "'ll", "123", "!!", "the", "tion", " ", "\x1c", "ß",
          "<|endoftext|>", "<|endof", "=" * 70, "꟱", "\r\n", "ﬁ"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r["doc_id"]: r for r in docs.collect()}


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice([*PIECES, chr(rng.randrange(32, 0xD000))]) for _ in range(rng.randrange(60))) for _ in range(n)]


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# --- helpers ------------------------------------------------------------------------------

def test_mph_is_minimal_and_perfect():
    for n in (0, 1, 2, 5000):
        keys = as_keys([hashlib.sha256(str(i).encode()).digest() for i in range(n)], 32) if n else np.zeros((0, 2), np.uint64)
        mph = Mph.build(keys)
        slots = Mph(mph.sizes, mph.packed).slots(keys)
        assert sorted(slots.tolist()) == list(range(n))
        assert all(mph.slot(int(a), int(b)) == s for (a, b), s in zip(keys[:50], slots[:50]))
    with pytest.raises(ValueError):
        Mph.build(np.array([[1, 2], [1, 2]], np.uint64))


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    edges += [(5000, 5001 + i) for i in range(300)] + [(7, 7), (2, 1)]
    u = Union()
    for a, b in edges:
        if a != b:
            u.join(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: u.find(x) for x in u.up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 exact dedup ------------------------------------------------------------------------

def test_history_wins_and_members_are_found(spark):
    rows_ = [(i, f"text {i % 40}" if i % 3 else f"  text\t{i % 40}") for i in range(300)]
    df = exact_dedup.digests(spark.createDataFrame(rows_, "doc_id long, text string"))
    out = {r["doc_id"]: r for r in exact_dedup.dedup(df, F.col("doc_id") < 150).collect()}
    groups = defaultdict(list)
    for i, t in rows_:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    for ids in groups.values():
        assert all((out[i]["keep_id"], out[i]["group_size"], out[i]["kept"]) == (min(ids), len(ids), i == min(ids)) for i in ids)


# --- 2 sharding ---------------------------------------------------------------------------

def kd_loop(rows_, shards, first=0, spans=None):
    """The same tree, node by node."""
    dims = kd_shards.DIMENSIONS
    spans = spans or {d: max(r[d] for r in rows_) - min(r[d] for r in rows_) for d in dims}
    if shards == 1 or not rows_:
        return {r["doc_id"]: first for r in rows_}
    spread = [(max(r[d] for r in rows_) - min(r[d] for r in rows_)) / max(1, spans[d]) for d in dims]
    d = dims[spread.index(max(spread))]
    order, left = sorted(rows_, key=lambda r: (r[d], r["tie"], r["row"])), shards // 2
    want, so_far, cut = sum(r["size"] for r in rows_) * left / shards, 0, 0
    for r in order:
        if so_far + r["size"] > want and so_far + r["size"] - want > want - so_far:
            break
        so_far, cut = so_far + r["size"], cut + 1
    return kd_loop(order[:cut], left, first, spans) | kd_loop(order[cut:], shards - left, first + left, spans)


@pytest.mark.parametrize("few", [4096, 8])
def test_kd_tree_equals_loop(docs, few, monkeypatch):
    monkeypatch.setattr(kd_shards, "FEW", few)
    monkeypatch.setattr(kd_shards, "BINS", 16)
    monkeypatch.setattr(kd_shards, "SLOT_ROWS", 20)
    described = [r.asDict() for r in kd_shards.describe(docs).collect()]
    out = kd_shards.op2(docs).collect()
    assert {r["doc_id"]: r["shard"] for r in out} == kd_loop(described, 16)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = sum(r["size"] for r in out)
    sums = [sum(r["size"] for r in out if r["shard"] == k) for k in range(16)]
    assert sum(sums) == total and max(abs(s - total / 16) for s in sums) <= 2 * max(r["size"] for r in out)


# --- 3 and 7 tokenizers ---------------------------------------------------------------------

def test_bpe_equals_the_library_and_round_trips(spark, rows):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = odd_texts(800, 1) + [r["text"] for r in rows.values()] + ["x y " * 400_000, "a" * 3000]
    own = bpe.Tokenizer(ranks, P.PATTERN)
    own.pieces.limit = 50
    for t in texts:
        ids = own.encode(t)
        assert ids.tolist() == library.encode_ordinary(t)
        assert own.vocabulary.decode(ids) == t.encode()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.op3(df, path, P.PATTERN).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_counts_equal_the_library(spark, rows, monkeypatch):
    monkeypatch.setattr(token_counts, "HEAD", 100)
    path = P.path("byte_bpe_50k.json")
    library, texts = Library.from_file(path), odd_texts(800, 2) + [r["text"] for r in rows.values()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_counts.op7(df, path).collect():
        t = texts[r["doc_id"]]
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024)


# --- 4 decontamination ----------------------------------------------------------------------

def test_copies_and_new_parameters_are_caught(spark):
    q = "Alice has 5 apples and gives Bob 3 apples before walking 12 km to the market in Paris. How many apples does Alice have left?"
    items = spark.createDataFrame([(1, q), (2, "short item of six words here")], "item_id long, text string")
    new = q.replace("Alice", "Carol").replace("Bob", "Dave").replace(" 5 ", " 7 ").replace(" 3 ", " 4 ").replace("Paris", "London")
    mixed = "Carol has 7 apples and gives Dave 4 apples before Erin walking 3 km. How many apples does Peter have left?"
    cases = [(1, "before " + q), (2, "intro. " + new + " bye"), (3, q.upper()), (4, "an item. Short item of six words here!"),
             (5, "apples and gives Bob"), (6, "nothing of this kind is in the benchmark at all, is it"), (7, mixed)]
    found = decontaminate.contaminated(spark.createDataFrame(cases, "doc_id long, text string"), items).collect()
    kinds = {(r["doc_id"], r["item_id"]): r["kind"] for r in found}
    assert kinds == {(1, 1): "copy", (2, 1): "reparameterised", (3, 1): "copy", (4, 2): "copy"}


def test_copies_of_short_items_and_of_items_full_of_numbers_are_caught(spark):
    items = ["Sort 5 3 9 1 7 2 8 4 6", "Compute 12 + 34 - 5 + 7", "Define entropy.", "3 4 5"]
    cases = [f"Some words before it. {t.lower()} And words behind." for t in items] + ["Sort 6 4 8 2 7 1 9 3 5", "Compute 13 + 34 - 5 + 8", "entropy is to define"]
    found = decontaminate.contaminated(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string"),
                                       spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["kind"]) for r in found} == {(i, i, "copy") for i in range(4)}


def test_values_of_other_lengths_and_inserted_words_are_caught(spark):
    q = "Maria bought 30 red apples at the old market, then Maria gave away some of them to her kind neighbour next door"
    short = "the farmer counted 30 sheep near the river and sold a few of them"
    items = spark.createDataFrame([(1, q), (2, short)], "item_id long, text string")
    new = q.replace("Maria", "Anna Lopez").replace("30", "thirty five")
    cases = [(1, new), (2, short.replace("30", "one hundred twenty")), (3, q.replace("market,", "and busy market,")),
             (4, new.replace("then Anna Lopez", "then Peter Miller")), (5, new.replace("market, then", "market, but then"))]
    found = decontaminate.contaminated(spark.createDataFrame(cases, "doc_id long, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"]): r["kind"] for r in found} == {
        (1, 1): "reparameterised", (2, 2): "reparameterised", (3, 1): "copy", (4, 1): "reparameterised", (5, 1): "reparameterised"} or print(found)


def test_planted_passages_of_the_benchmark(spark, docs, rows):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [" ".join(words(r["text"])) for r in benchmark.collect()]
    want = {d for d, r in rows.items() if any(i in " ".join(words(r["text"])) for i in items)}
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, benchmark).collect()} == want


# --- 5 line dedup ---------------------------------------------------------------------------

def jaccard(a, b, q=line_dedup.Q):
    x, y = ({t[i:i + q] for i in range(max(1, len(t) - q + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_lines_against_all_pairs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(2, 9)))
    lines = []
    for _ in range(60):
        base = [word() for _ in range(40)]
        lines.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            base[rng.randrange(40)] = word()
            lines.append(" ".join(base))
    lines += ["", "  ", "x", "x", "same line", "same line"]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i:i + 7]) for i in range(0, len(lines), 7)]
    u, places = Union(), {}
    for d, t in enumerate(texts):
        for n, line in enumerate(t.split("\n")):
            if line.strip():
                places[d, n] = line
    for p, a in places.items():
        u.find(p)
        for r, b in places.items():
            if p < r and jaccard(a, b) >= line_dedup.SIMILAR:
                u.join(p, r)
    want = {p for p in places if u.find(p) != p}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    decided = line_dedup.decisions(df)
    got = {(r["doc_id"], n) for r in decided.collect() for n in r["dropped"]}
    assert got <= want and len(got) >= 0.97 * len(want)
    for r in line_dedup.without_duplicate_lines(df, decided).collect():
        assert r["text"] == "\n".join(x for n, x in enumerate(texts[r["doc_id"]].split("\n")) if (r["doc_id"], n) not in got)


@pytest.mark.parametrize("length", [18, 28, 60, 130])
def test_similar_lines_meet_as_often_as_independent_minima_do(spark, length):
    rng, pairs = random.Random(length), []
    while len(pairs) < 1500:  # a new start and a new end: a shift leaves n - 2k of n + 2k shingles or so
        n = length - line_dedup.Q + 1
        k = max(1, round(n / 9))
        both = "".join(chr(rng.randrange(97, 123)) for _ in range(length + k))
        pairs.append((both[k:], both[:-k]))
    ideal = np.mean([(1 - jaccard(a, b) ** line_dedup.ROWS) ** line_dedup.BANDS for a, b in pairs])
    lines = spark.createDataFrame([(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "h long, line string")
    keys = {r["h"]: r["keys"] for r in line_dedup.bands(lines).collect()}
    missed = np.mean([not any(x == y for x, y in zip(keys[2 * i], keys[2 * i + 1])) for i in range(len(pairs))])
    print(f"length {length}: Jaccard {np.mean([jaccard(*p) for p in pairs]):.3f}, missed {missed:.4f}, ideal {ideal:.4f}")
    assert missed <= ideal + 4 * (ideal * (1 - ideal) / len(pairs)) ** 0.5


def test_families_that_drift_by_small_edits_stay_whole(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(3, 9)))
    families = []
    for _ in range(40):
        base = [word() for _ in range(16)]
        families.append([" ".join(base)])
        for _ in range(39):
            base[rng.randrange(16)] = word()
            families[-1].append(" ".join(base))
    lines = sorted({x for f in families for x in f})
    df = spark.createDataFrame([(i, x, i) for i, x in enumerate(lines)], "h long, line string, place long")
    buckets = defaultdict(list)
    for r in line_dedup.bands(df).collect():
        for k in r["keys"]:
            buckets[k].append(r["h"])
    u, v = Union(), Union()
    pairs = {(a, b) for hs in buckets.values() for a in hs for b in hs if a < b}
    similar = [(a, b) for a, b in pairs if jaccard(lines[a], lines[b]) >= line_dedup.SIMILAR]
    for a, b in similar:
        u.join(a, b)
    for r in line_dedup.links(df).collect():
        assert jaccard(lines[r["a"]], lines[r["b"]]) >= line_dedup.SIMILAR
        v.join(r["a"], r["b"])
    recall = np.mean([v.find(a) == v.find(b) for a, b in similar])
    classes = [len({w.find(i) for i in range(len(lines))}) for w in (u, v)]
    print(f"pairs {len(similar)}, recall {recall:.4f}, classes by all pairs and by links {classes}")
    assert recall == 1 and classes[0] == classes[1]

def test_no_similar_pair_fails_by_its_bits(spark):
    rng = random.Random(8)
    pairs = [(a, b) for n in (1, 3, 12, 60, 400) for a, b in
             ((x, x[:len(x) - rng.randrange(len(x) // 9 + 1)]) for x in ("".join(rng.choice("abcd ") for _ in range(n + 7)) * rng.choice([1, 3]) for _ in range(40)))]
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    mark = {r["h"]: r["mark"] for r in line_dedup.marks(spark.createDataFrame(rows, "h long, line string")).collect()}
    for h, t in rows:
        assert mark[h]["n"] == len({t[i:i + line_dedup.Q] for i in range(max(1, len(t) - line_dedup.Q + 1))})
    for i, (a, b) in enumerate(pairs):
        x, y = mark[2 * i], mark[2 * i + 1]
        unlike = sum(((x[f"b{k}"] ^ y[f"b{k}"]) & (2 ** 64 - 1)).bit_count() for k in range(line_dedup.WORDS * line_dedup.BANDS))
        n = x["n"] + y["n"]
        j = jaccard(a, b)
        assert unlike <= (1 - j) / (1 + j) * n + 1e-6


def test_pairs_of_a_family_are_not_listed(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(3, 9)))
    base, rows = [word() for _ in range(60)], []
    for i in range(300):  # copies are at about 0.77 of each other and at 0.87 of the base, which comes last
        words = list(base)
        for _ in range(2 if i < 299 else 0):
            words[rng.randrange(60)] = word()
        rows.append((i, " ".join(words), i))
    listed, checked = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, facts, similar: listed.append(pairs.count()) or checked(pairs, facts, similar))
    found = line_dedup.links(spark.createDataFrame(rows, "h long, line string, place long"))
    u = Union()
    for r in found.collect():
        u.join(r["a"], r["b"])
    assert len({u.find(h) for h, _, _ in rows}) <= 3 and sum(listed) <= 8 * len(rows)


def test_line_dedup_runs_no_python(docs):
    plan = line_dedup.bands(line_dedup.distinct_lines(line_dedup.occurrences(docs)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# --- 6 language ID ---------------------------------------------------------------------------

def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op6(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n, rejected = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.sum(F.col("rejected").cast("int"))).first()
    assert right / n >= 0.98 and rejected <= 0.01 * n


def test_held_out_rows_teach_nothing(docs):
    changed = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert langid.op6(changed).filter("lang_pred = 'xx'").count() == 0


def test_foreign_text_is_rejected(rows):
    model = langid.train([(r["lang"], r["text"]) for r in rows.values()])
    text = "это совсем другой язык, которого модель никогда не видела, и написан он другими буквами. " * 3
    lang, score, rejected = model.predict([text, "", "12 !!", rows[0]["text"]])
    assert rejected.tolist() == [True, True, True, False] and lang[1:3] == ["und", "und"]


def test_an_unlearned_language_of_the_same_script_is_rejected(spark):
    texts = defaultdict(list)
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").collect():
        texts[r["lang"]].append(r["text"] or "")
    for out in ("en", "es"):
        model = langid.train([(lang, t[:8000]) for i in range(800) for lang in sorted(texts) if lang != out for t in texts[lang][i:i + 1]])
        refused = {lang: np.concatenate([model.predict(texts[lang][at:at + 128])[2] for at in range(800, min(1300, len(texts[lang])), 128)]).mean()
                   for lang in texts}
        print(f"without {out}: rejected {({k: round(float(v), 4) for k, v in refused.items()})}, least score {model.least_score}, known {model.least_known}")
        assert refused[out] >= 0.95 and all(v <= 0.01 for lang, v in refused.items() if lang != out)


# --- 8 substring dedup -------------------------------------------------------------------------

def test_passages_are_found_in_any_place(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 10))) for _ in range(n))
    passages = [prose(55) for _ in range(40)]
    texts, want = [], set()
    for d in range(120):
        t = prose(rng.randrange(80, 200))
        if d % 3 != 2:
            want.add(d)
            at = t.index(" ", rng.randrange(len(t) - 60))
            t = t[:at] + " " + passages[(d // 3) % 40] + t[at:]
        texts.append(t + " all rights reserved in this line")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = substring_dedup.repeated_spans(df)
    found = spans.collect()
    assert {r["doc_id"] for r in found} == want
    for r in found:
        assert r["is_first"] == (r["doc_id"] == r["first_doc_id"])
    after = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(df, spans).collect()}
    for r in found:
        cut = texts[r["doc_id"]].encode()[r["start"]:r["stop"]].decode()
        assert (cut in after[r["doc_id"]]) == r["is_first"]


def test_only_passages_of_over_fifty_words_are_reported(spark):
    """Exact extents by whole words: nothing of 50 words or fewer, everything of 51 or more."""
    rng, texts, want = random.Random(12), [], set()
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 11))) for _ in range(40_000)]
    fresh = iter(rng.sample(vocabulary, len(vocabulary)))
    words = lambda n: [next(fresh) for _ in range(n)]
    for n in [20, 30, 40, 45, 48, 49, 50, 51, 52, 53, 55, 60, 80] * 6:
        passage = words(n)
        for _ in range(rng.choice([2, 2, 3])):
            if n > 50:
                want.add(len(texts))
            texts.append(" ".join(words(rng.choice([0, 1, 40])) + passage + words(rng.choice([0, 2, 30]))))
    found = substring_dedup.repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == want


def test_rows_without_or_with_a_repeated_doc_id_are_documents(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = " ".join(word() for _ in range(70))
    alone = " ".join(word() for _ in range(90))
    rows = [(None, shared), (None, "x y " + shared), (7, shared + " z"), (7, alone), (7, "other words here " + shared), (3, alone[:40])]
    df = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, k int")
    spans = substring_dedup.repeated_spans(df, key="k")
    found = spans.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == [(False, 7), (False, 7), (True, 0), (True, 0)]
    assert sum(r["is_first"] for r in found) == 1 and all(r["first_doc_id"] == 7 for r in found)
    after = substring_dedup.without_repeats(df, spans, key="k").collect()
    assert sum(shared in r["text"] for r in after) == 1 and {r["text"] for r in after} >= {alone, alone[:40]}


def test_runs_of_words_at_an_edge():
    """Against a loop over the bytes."""
    white = b" \t\n\v\f\r"

    def plain(data, side, pos, least, most, digest):
        seed, out = xxhash.xxh3_64_intdigest(digest.to_bytes(8, "little", signed=True) + bytes([side])), []
        h = lambda x: xxhash.xxh3_64_intdigest(x, seed) - (1 << 63)
        at, reach = 0, 2 * substring_dedup.LONGEST
        if side == 0:
            for p in range(pos - 1, max(0, pos - reach) - 1, -1):
                if at < most and data[p] not in white and (p == 0 or data[p - 1] in white):
                    at += 1
                    out += [(at, h(data[p:pos]))] * (at >= least)
            return out
        if 0 < pos < len(data) and data[pos - 1] not in white and data[pos] not in white:
            out.append((-1, None))
        for q in range(pos, min(len(data), pos + reach)):
            if data[q] not in white:
                at += q == 0 or data[q - 1] in white
                if at > most:
                    break
                if at >= least and (q + 1 == len(data) or data[q + 1] in white):
                    out.append((at, h(data[pos:q + 1])))
        return out

    rng = random.Random(8)
    for _ in range(3000):
        data = bytes(rng.choice(b"ab \n\xc3" if rng.random() < 0.5 else b"abcdefghij\t ") for _ in range(rng.choice((0, 1, 5, 40, 700, 1500))))
        args = data, rng.randrange(2), rng.randint(0, len(data)), rng.randint(-2, 9), rng.randint(0, 60), rng.randrange(-1 << 63, 1 << 63)
        assert substring_dedup.edge_runs(*args) == plain(*args), args


def test_gear_hash_depends_on_the_window_only():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, 500, np.uint8), rng.integers(0, 256, 300, np.uint8)
    tail = rng.integers(0, 256, 400, np.uint8)
    x, y = (substring_dedup.gear_hashes(np.concatenate((head, tail)))[len(head) + substring_dedup.WINDOW - 1:] for head in (a, b))
    assert (x == y).all()


# --- 9 SimHash -----------------------------------------------------------------------------------

def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_loop(rows, monkeypatch):
    texts = [r["text"] for r in rows.values()][:60] + odd_texts(100, 5) + ["", "One", "one TWO", "É é x"]
    want = [slow_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == want
    monkeypatch.setattr("codestrata.llm.common.LONG", 40)
    monkeypatch.setattr(simhash, "segments", lambda data: __import__("codestrata.llm.common", fromlist=["segments"]).segments(data, 40))
    assert [simhash.fingerprint(t) for t in texts] == want


def test_links_span_all_near_fingerprints(spark):
    rng, seeds = random.Random(8), []
    for _ in range(150):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 5)):
            seeds.append(x)
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
    fps = np.unique(np.array(seeds, np.uint64))
    u = Union()
    for i, a in enumerate(fps):
        u.find(i)
        for j in np.flatnonzero(np.bitwise_count(fps ^ a) <= 3):
            u.join(i, int(j))
    signed = fps.view(np.int64)
    at = {int(x): i for i, x in enumerate(signed)}
    links = simhash.links(spark.createDataFrame([(int(x),) for x in signed], "fp long"), rounds=2)
    v = Union()
    for i in range(len(fps)):
        v.find(i)
    for r in links.collect():
        assert (int(r["a"]) ^ int(r["b"]) & (1 << 64) - 1) != 0
        v.join(at[r["a"]], at[r["b"]])
    assert [u.find(i) for i in range(len(fps))] == [v.find(i) for i in range(len(fps))]


# --- 10 license scan -------------------------------------------------------------------------------

def test_base_scan_equals_loop(spark):
    texts = ["Released under the MIT License, under-the-mit-license.", "CC BY-NC 4.0 and cc by nc", "Apache License, Version 2.0", "licence", "",
             "under the MIT  license" * 2, "nothing", "under the mit é license"]
    out = {r["doc_id"]: r for r in license_scan.op10(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for d, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        hits = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
        r = out[d]
        assert (r["n_words"], r["n_base"]) == (len(words), len(hits))
        assert (r["first_word"], r["last_word"]) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in hits})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_rules_find_their_own_licenses_and_containment_is_resolved():
    scanner = license_scan.Scanner()
    assert len(scanner.rules) >= 300
    cases = {"Licensed under CC BY-NC-SA 4.0": {"cc-by-nc-sa"}, "SPDX-License-Identifier: BSD-3-Clause": {"bsd-3-clause"},
             "This work is licensed under the GNU General Public License, version 3.": {"gpl-3"},
             "see https://www.apache.org/licenses/LICENSE-2.0": {"apache-2"}, "the Mozilla Public License 2.0": {"mpl-2"},
             "All rights reserved.": {"all-rights-reserved"}, "permitted with limits, we emit": set()}
    for text, want in cases.items():
        assert {x for x, _, _, _ in scanner.detections(text)} == want, text


def slow_detections(scanner, text):
    """Every rule on every text, and each hit against all of higher precedence."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    hits = sorted(((-license_scan.PRIORITY[r.kind], m.start() - m.end(), r.order, m.start(), m.end(), r.label, r.kind)
                   for r in scanner.rules for m in r.pattern.finditer(low)))
    kept = [h for i, h in enumerate(hits) if not any(k[3] <= h[3] and h[4] <= k[4] for k in hits[:i])]
    return [(h[5], h[6], h[3], h[4]) for h in sorted(kept, key=lambda h: h[3:5])]


def license_texts(rng, n):
    from codestrata.llm import license_rules

    bits = [*license_scan.BASE, "the", "license:", "licensed under", "terms of the", "version 2.0", "2.0", "3.0", "nc", "sa", ".", ",", "\n", "(", ")"]
    for _, tag, keyword, name, url in license_rules.LICENSES:
        plain = [re.sub(r"\\(.)", r"\1", x) for x in (tag, name, url or "")]
        bits += [re.sub(r"\[.*?\]\+?|\(\?.*?\)|[?*+()|]", " ", x.replace(license_rules._S, " ").replace("[sc]", "s")) for x in plain] + keyword.split("|")
        bits.append("SPDX-License-Identifier: " + plain[0])
    return ["".join(rng.choice(bits) + rng.choice([" ", " ", "-", "\n"]) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_scan_equals_all_rules_without_gates(rows):
    """Gates and sweep lose nothing: real texts, and texts made of pieces of names, tags and URLs."""
    scanner = license_scan.Scanner()
    texts = license_texts(random.Random(3), 300) + [r["text"] or "" for d, r in rows.items() if d % 50 == 0]
    found = [scanner.detections(t) for t in texts]
    assert sum(map(len, found)) > 300
    for text, own in zip(texts, found):
        assert own == slow_detections(scanner, text), text


def test_license_scan_is_linear_in_a_text_full_of_licenses():
    import time

    scanner, notice = license_scan.Scanner(), "Released under the MIT license. Apache License, Version 2.0, cc by nc. "
    took = []
    for n in (2000, 16000):
        start = time.perf_counter()
        found, (_, places) = scanner.detections(notice * n), scanner.places(notice * n)
        took.append(time.perf_counter() - start)
        assert len(places) == 3 * n and len(found) >= n
    assert took[1] < 24 * took[0]
    gap = scanner.detections("apache" + " " * 1_000_000 + "x")
    assert gap == []


# --- pipeline ----------------------------------------------------------------------------------------

def test_pipeline_equals_loops(spark, docs, rows):
    """Stage after stage in plain Python; only the language model's verdicts are taken from the operator."""
    gone = {r["doc_id"] for r in langid.predict(docs, langid.fit(docs, ~langid.held_out(F.col("doc_id")))).filter("rejected").collect()}
    kept = {d: r["text"] or "" for d, r in sorted(rows.items()) if d not in gone}
    first = {}
    for d, t in kept.items():
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), d)
    kept = {d: kept[d] for d in first.values()}
    u, fps = Union(), {d: slow_fingerprint(t) for d, t in kept.items()}
    for a in fps:
        u.find(a)
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                u.join(a, b)
    kept = {d: t for d, t in kept.items() if u.find(d) == d}
    words = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {d: t for d, t in kept.items() if not any(i in words(t) for i in items)}
    out = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert out == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in kept.items()}
