"""License scan by ordered signature rules.

Lower-cased whole texts are scanned for keywords in one automaton pass; a rule's pattern
runs only on texts that hold a keyword of each of its gates. Detections overlap, so they are
resolved by interval: one that lies within another of higher priority (then longer,
then of an earlier rule) is suppressed; others stay. What is left gives the labels.
The work is linear in the text, but for the sort of its detections.

Beside the rules stands the base scan: places where the words of a base phrase follow
each other, counted over the text's words. Its labels always stay. Only A-Z are
lower-cased; null texts count as empty: no words, no labels, score 0.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import ship, slices
from codestrata.llm.license_rules import PRIORITY, WEIGHT, Rule, all_rules

#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Bytes that are in no word become blanks, A-Z become lower case.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SCANNED = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
           "detections array<struct<label: string, kind: string, start: int, stop: int>>, score double")


class Scanner:
    def __init__(self, rules: list[Rule] | None = None, base: dict[str, str] | None = None) -> None:
        import ahocorasick

        self.rules = all_rules() if rules is None else rules
        self.base = {b" " + k.encode() + b" ": v for k, v in (BASE if base is None else base).items()}
        self.gate = ahocorasick.Automaton()
        for k in {k for rule in self.rules for gate in rule.gates for k in gate}:
            self.gate.add_word(k, k)
        self.gate.make_automaton()

    def places(self, text: str) -> tuple[int, list[tuple[int, str]]]:
        """Number of words, and (first word, label) of each base phrase."""
        words = text.encode().translate(_WORDS).split()
        joined = b" " + b" ".join(words) + b" "
        found = []
        for phrase, label in self.base.items():
            last = word = 0
            at = joined.find(phrase)
            while at >= 0:
                word, last = word + joined.count(b" ", last, at), at
                found.append((word, label))
                at = joined.find(phrase, at + 1)
        return len(words), found

    def detections(self, text: str) -> list[tuple[str, str, int, int]]:
        """(label, kind, start, stop) of what is left after suppression, in order; places are characters."""
        low = text.translate(_LOWER)
        seen = {k for _, k in self.gate.iter(low)}
        rules = [r for r in self.rules if r.opened_by(seen)]
        hits = [(-PRIORITY[r.kind], m.start() - m.end(), r.order, m.start(), m.end(), r)
                for r in rules for m in r.pattern.finditer(low)]
        kept = outermost(sorted(hits, key=lambda h: h[:4]))
        return [(h[5].label, h[5].kind, h[3], h[4]) for h in sorted(kept, key=lambda h: h[3:5])]


def outermost(hits: list[tuple]) -> list[tuple]:
    """Hits, in order of precedence, that lie within none before them; start and stop are at places 3 and 4.

    A prefix maximum over the starts tells the furthest stop of the hits so far that begin no later.
    """
    rank = {start: i for i, start in enumerate(sorted({h[3] for h in hits}), 1)}
    furthest = [-1] * (len(rank) + 1)
    kept = []
    for hit in hits:
        i, stop = rank[hit[3]], -1
        while i:
            stop = max(stop, furthest[i])
            i &= i - 1
        if stop >= hit[4]:
            continue
        kept.append(hit)
        i = rank[hit[3]]
        while i < len(furthest):
            furthest[i] = max(furthest[i], hit[4])
            i += i & -i
    return kept


def scan(docs: DataFrame) -> DataFrame:
    """What both scans find in each document."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner()
        types = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.struct(
            [("label", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])), pa.float64()]
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                n, places = own.places(text or "")
                found = own.detections(text or "")
                starts = [p for p, _ in places]
                score = max([WEIGHT[kind] for _, kind, _, _ in found] + [1.0] * bool(places), default=0.0)
                rows.append((n, len(places), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places}),
                             [dict(zip(("label", "kind", "start", "stop"), f)) for f in found], score))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]],
                                             ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "detections", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCANNED)


def op10(docs: DataFrame) -> DataFrame:
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.col("detections.label"))))
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word",
                             F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score")
