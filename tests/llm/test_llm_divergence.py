"""Divergence audit against plain loops, the merge of runs, spills, and odd inputs."""

import random
import re
from collections import Counter, defaultdict

from codestrata.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, ranks=200):
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = TERM.findall(lowered)
        counts[lang or "", source or ""].update(words)
        documents[lang or ""].update(set(words))
    out = set()
    f = lambda p, q: (p - q) ** 2 // q
    for lang, source in counts:
        kept = sorted(t for t, n in documents[lang].items() if n >= 3)
        whole = sum((c for (l, _), c in counts.items() if l == lang), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept))
        mine = {t: share(counts[lang, source], t) for t in kept}
        pairs = [(sum(f(mine[t], share(c, t)) for t in kept), s) for (l, s), c in counts.items() if l == lang and s != source]
        terms = [(f(mine[t], share(whole, t)), t) for t in kept if counts[lang, source][t] and mine[t] > share(whole, t)]
        for part, found, limit in (("pair", pairs, None), ("term", terms, ranks)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, value, i) for i, (value, item) in enumerate(found[:limit], 1)}
    return out


def run(spark, rows, **more):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string").repartition(5)
    found = [tuple(r) for r in divergence.audit(docs, **more).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_equals_loops(spark):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("Ab", "éÉ", "中", "z") for b in "klmnopqrstuv"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s", "t", "u", None, "é,"]),
             rng.choice(["", " 12 ", "\n"]).join(rng.choice([" ", "_", "7"]).join(rng.choices(words, k=rng.randrange(30))) for _ in range(2))) for _ in range(120)]
    rows += [("xx", "alone", "few words"), ("xx", "other", None), ("yy", "s", ""), ("yy", None, "one one one"), ("yy", "", "one"), ("yy", "t", "one two")]
    rows += [("en", "s", "Abk " * 80_000 + "ONLY only Only"), ("en", "s", "only"), ("en", "t", "only")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, ranks=3) == brute(rows, 3)


def test_repeated_rows_ties_and_no_rows(spark):
    rows = [("en", s, "same same words") for s in "abc"] * 3
    assert run(spark, rows) == brute(rows)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, term string, base int, value int")
    assert divergence.audit(empty).count() == 0


def test_spilled_runs_merge_to_the_same_frequencies(spark, monkeypatch):
    rng = random.Random(3)
    postings, documents = Counter(), Counter()
    chunks = []
    monkeypatch.setattr(divergence, "CHUNK", 7)
    for _ in range(20):
        block = divergence.Block()
        for _ in range(rng.randrange(9)):
            lang, source = rng.choice([(b"l", b"s"), (b"l", b"t"), (b"m", b"s")])
            times = Counter(rng.choices([b"%c%c" % (97 + i % 7, 100 + i // 7) for i in range(60)], k=rng.randrange(80)))
            block.add(lang, source, b"-".join(times.elements()))
            for t, n in times.items():
                postings[lang, t, source] += n
                documents[lang, t] += 1
        for batch in block.run(3):
            row = batch.to_pylist()[0]
            assert len(row["terms"]) <= 7 and row["term"] == row["terms"][0] and len(row["sources"]) == sum(row["sizes"]) == len(row["times"])
            chunks.append((row["shard"], row["lang"], row["term"], divergence.entries(*(row[k] for k in divergence.RUN[3:]))))
    chunks.sort(key=lambda c: c[:3])
    found = list(divergence.merged(iter(chunks)))
    assert len({x[:2] for x in found}) == len(found) == len(documents)
    assert {(lang, t, s): n for lang, t, sources, _ in found for s, n in sources.items()} == postings
    assert {(lang, t): n for lang, t, _, n in found} == documents
