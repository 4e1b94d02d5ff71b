"""Jaccard join against a comparison of all pairs: whole tables, hot tiles, large classes, odd inputs."""

import random

import pytest

from codestrata.llm import ngram_join


def sets_of(rows):
    out = []
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        out.append((doc_id, {b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set()))
    return out


def brute(rows):
    """Sorted (doc_id, n_shingles, component_id) by a comparison of all pairs."""
    sets = sets_of(rows)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = set()
    for group in holders.values():
        for at, i in enumerate(group):
            for j in group[:at]:
                if (i, j) in seen or find(i) == find(j):
                    continue
                seen.add((i, j))
                both = len(sets[i][1] & sets[j][1])
                if 100 * both >= 85 * len(sets[i][1] | sets[j][1]):
                    root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets)), key=str)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.op12(docs).collect()), key=str)


def family(seed, n, words=60, edits=2, drift=False):
    """Near copies of one text, or a chain of them."""
    rng = random.Random(seed)
    text = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(text)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        if drift:
            text = copy
        out.append(" ".join(copy))
    return out


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for k in range(12) for i, t in enumerate(family(k, 25, edits=3), 100 * k)]
    rows += [(20_000 + i, t) for k in range(6) for i, t in enumerate(family(50 + k, 30, edits=1, drift=True), 100 * k)]
    random.Random(5).shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one two three four"), (8, "é É"),
            (8, "é É"), (9, "é é"), (None, "same words in a row that has no id at all"), (10, "same words in a row  that has no id at all"),
            (None, "nobody has an id here"), (None, "nobody has an id here"), (11, "again " * 50_000), (12, "Again " * 7), (13, "x" * 300_000)]
    assert run(spark, rows) == brute(rows)
    got = {(a, c) for a, _, c in run(spark, rows)}
    assert (1, 1) in got and (2, 2) in got and (5, 4) in got and (None, 10) in got and (None, None) in got and (12, 11) in got
    assert run(spark, rows[:0] or [(1, None)]) == [(1, 0, 1)]
    assert ngram_join.op12(spark.createDataFrame([], "doc_id long, text string, component int, n int, node int")).count() == 0


@pytest.mark.parametrize(("tile", "block"), [(4, 8), (2048, 16)])
def test_hot_tiles_and_large_classes(spark, monkeypatch, tile, block):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = [(i, t) for i, t in enumerate(family(1, 120, edits=4) + family(2, 90, edits=1, drift=True) + family(3, 40, words=6, edits=1))]
    rows += [(1000 + i, t) for i, t in enumerate(family(4, 60, words=30, edits=1))]
    rng = random.Random(9)
    shared = " ".join(f"p{i}" for i in range(40))  # a passage in many unlike texts
    rows += [(2000 + i, shared + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 40)))) for i in range(80)]
    pairs = brute(rows)
    assert run(spark, rows) == pairs


def test_long_tiles_join_neighbours(monkeypatch):
    import numpy as np
    monkeypatch.setattr(ngram_join, "TILE", 4)
    known = ngram_join._Words()
    sets = sorted((ngram_join.shingles(t.encode(), known) for t in family(1, 30, edits=3)), key=len)
    n = np.array([len(s) for s in sets])
    sig = np.array([ngram_join.signature(s)[0] for s in sets])
    batch = ngram_join._packed([(np.full(30, 5), np.arange(30), n, n, np.ones(30, bool), sig)])
    for size in (3, 7, 30):
        cut = [batch.slice(at, size) for at in range(0, 30, size)]
        edges = sorted(tuple(e.values()) for out in ngram_join._tiles(iter(cut)) for e in out.to_pylist())
        assert edges == [(i, i + 1) for i in range(29)]
    monkeypatch.setattr(ngram_join, "TILE", 64)
    edges = [tuple(e.values()) for out in ngram_join._tiles(iter([batch.slice(0, 9), batch.slice(9)])) for e in out.to_pylist()]
    root = list(range(30))
    for a, b in edges:
        root = [root[b] if r == root[a] else r for r in root]
    possible = ngram_join._possible
    assert all(root[i] == root[j] for i in range(30) for j in range(i) if possible(n[i], sig[i], n[j], sig[j]))
    assert len(edges) <= 29


def test_rows_of_linked_sets_meet():
    """Whatever the order of shingles, sets that link have a row of one tile that the bitmaps pass: also at the sizes where sections double."""
    import numpy as np
    known, rng = ngram_join._Words(), np.random.default_rng(2)
    times = rng.integers(0, 50, ngram_join.BUCKETS).astype(np.int32)
    met = 0
    for words in (8, 40, 240, 480, 520, 560, 900, 1010, 1040, 1150, 2080, 5000):
        a, b = (ngram_join.shingles(t.encode(), known) for t in family(words, 2, words=words, edits=max(1, words // 45)))
        longer = np.union1d(a, rng.integers(0, 1 << 63, int(len(a) * 0.15)).astype(np.uint64))
        for other in (b, longer):
            both = ngram_join._overlap(a, other)
            if 100 * both < 85 * (len(a) + len(other) - both):
                continue
            met += 1
            rows = [[r for token, _, *columns in ngram_join._first_rows(h, 1, times, 1000)
                     for r in zip(token.tolist(), *(c.tolist() for c in columns[:3]), columns[3])] for h in (a, other)]
            theirs = {r[0]: r for r in rows[1]}
            assert any((x[3] if x[1] < y[1] else y[3] if y[1] < x[1] else x[3] or y[3]) and ngram_join._possible(x[1], x[4], y[1], y[4])
                       for x in rows[0] if (y := theirs.get(x[0])))
    assert met >= 15


def test_bound_never_rejects_a_link():
    import numpy as np
    known = ngram_join._Words()
    sets = [ngram_join.shingles(t.encode(), known) for k in range(5) for t in family(k, 12, words=20 + 60 * k, edits=3)]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            both = ngram_join._overlap(a, b)
            assert both == len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                for bits in (ngram_join.BITS, ngram_join.WIDE):
                    assert ngram_join._possible(len(a), ngram_join.signature(a, bits)[None], len(b), ngram_join.signature(b, bits)[None]).all()


def test_units_give_the_links_of_all_pairs():
    import numpy as np
    known = ngram_join._Words()
    texts = family(1, 40, edits=4) + family(2, 40, edits=1, drift=True)
    sets = [ngram_join.shingles(t.encode(), known) for t in texts]
    label = np.arange(len(sets))
    for role in (np.full(80, 2), np.arange(80) % 2):
        want, got = np.arange(80), np.arange(80)
        for i in range(80):
            for j in range(i):
                both = ngram_join._overlap(sets[i], sets[j])
                if (role[i] == 2 or role[i] != role[j]) and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    want[want == want[j]] = want[i]
        for i, j in ngram_join.links_of(label, role, sets):
            got[got == got[j]] = got[i]
        assert all((want[i] == want[j]) == (got[i] == got[j]) for i in range(80) for j in range(i))
