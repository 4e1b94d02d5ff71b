"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is a bag of character n-grams within its words, word ends marked; case, digits
and punctuation do not count. Each n-gram has an embedding by its hash; a text is the
mean of its embeddings, and a linear layer with softmax gives the languages. Embeddings
and layer are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows (``SAMPLE`` texts a language of at most ``SAMPLE_CHARS`` characters, the
first in an order that a digest of doc_id gives), whole and as short excerpts, so that
short texts are learned too. Prediction covers every whole text.

Scores are calibrated on a part of the sample that was not trained on: a temperature
makes them probabilities, and a text is rejected if its score lies below what all but
``REJECT`` of those texts reach, or if the share of its 4-grams that training saw in the
predicted language does, or if it has no letter. A language that was not learned may get a
high score, but shares few 4-grams with the one it is taken for. Texts of fewer than
``SHORT`` n-grams, about five words, give no ground for a rejection. A class of length with
fewer than ``LEAST_IN_CLASS`` texts to calibrate with rejects what lies below all of them, of any class; with fewer
than ``LEAST_HELD`` in all classes, only texts without letters are rejected.

Null text, or one without letters: ``und`` with score 0, rejected. If no row can be
learned from, every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.llm.common import ROW, numbered, ship, slices, without
from codestrata.llm.bpe import Shared
from codestrata.session import cut_lineage

NONE = "und"
BUCKETS = 1 << 17
WIDTH = 16
ORDERS = (2, 3, 4)
SAMPLE = 800
SAMPLE_CHARS = 8_000
#: Languages with the most labelled rows that are learned at most.
LANGUAGES = 200
EPOCHS = 4
RATE = 0.2
#: Part of the held-out texts of a class of length that each of the two tests may reject.
REJECT = 0.002
SHORT = 60
#: Classes of length, by n-grams: a few words tell less than a whole text, so each has its own thresholds.
CLASSES = (SHORT, 240)
#: Held-out texts of over SHORT n-grams for a rejection at all, and of a class for thresholds of its own.
LEAST_HELD = 50
LEAST_IN_CLASS = int(1 / REJECT)
#: Bits of the table of seen 4-grams for each that is in it, at least; so under one in so many unseen ones counts as seen.
SEEN_BITS = 32

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of the texts with a zero for each run of others, and the place of each text's last."""
    low = [t.lower() for t in texts]
    chars = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    owner_end = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1)
    letter = _is_letter()[chars]
    keep = letter | np.concatenate(([True], letter[:-1]))  # one mark for each run of other characters
    code = np.where(letter, chars, 0)[keep]
    return code, np.cumsum(keep)[owner_end - 1]  # of each text, among the kept


def fours(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 4-grams of the texts, text after text, and how many each has."""
    code, ends = _characters(texts)
    n = max(0, len(code) - 3)
    h = np.zeros(n, np.uint64)
    for j in range(4):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + code[j:j + n].astype(np.uint64)
    ok = (code[1:1 + n] != 0) & (code[2:2 + n] != 0)
    before = np.concatenate(([0], np.cumsum(ok)))[np.minimum(ends, n)]
    return h[ok], np.diff(np.concatenate(([0], before)))


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of the texts, text after text, and how many each has."""
    code, ends = _characters(texts)
    size = len(code)
    found, counts = [], []
    inside = code != 0
    h = code * np.uint32(0x9E3779B1)
    ok = np.ones(size, bool)
    for n in range(2, max(ORDERS) + 1):
        if n > 2 and size >= n - 1:  # the characters between the first and the last are letters
            ok = ok[:size - n + 1] & inside[n - 2:size - 1]
        else:
            ok = ok[:max(0, size - n + 1)]
        h = (h[:max(0, size - n + 1)] ^ (h[:max(0, size - n + 1)] >> np.uint32(15))) * np.uint32(0x85EBCA77) + code[n - 1:] * np.uint32(0xC2B2AE3D)
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F)
            mixed = (mixed >> np.uint32(15)) & np.uint32(BUCKETS - 1)
            found.append(mixed[ok])
            counts.append(np.diff(np.concatenate(([0], np.cumsum(ok)[np.minimum(ends, max(1, len(ok))) - 1] if len(ok) else np.zeros(len(ends), int)))))
    total = np.sum(counts, 0)
    if len(texts) == 1:
        return np.concatenate(found).astype(np.int64), total
    cuts = [np.split(f, np.cumsum(c)[:-1]) for f, c in zip(found, counts)]
    return np.concatenate([x for parts in zip(*cuts) for x in parts]).astype(np.int64), total


@dataclass
class Model:
    """Languages; for each bucket the layer's output for its embedding; a table of bits of the 4-grams seen in each language."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    seen: np.ndarray
    temperature: float = 1.0
    least_score: tuple[float, ...] = (0.0,) * (len(CLASSES) + 1)
    least_known: tuple[float, ...] = (0.0,) * (len(CLASSES) + 1)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, for each text."""
        buckets, counts = ngrams(texts)
        logits = self._logits(buckets, counts)
        p = _softmax(logits / self.temperature)
        best = p.argmax(1) if len(self.languages) else np.zeros(len(texts), int)
        letters = np.array([any(map(str.isalpha, t)) if not n else True for t, n in zip(texts, counts)]) & bool(self.languages)
        known = self.known(texts, best) if self.languages else np.zeros(len(texts))
        score = np.where(letters, p.max(1) if len(self.languages) else 0.0, 0.0)
        size = np.digitize(counts, CLASSES)
        rejected = ~letters | (score < np.array(self.least_score)[size]) | (known < np.array(self.least_known)[size])
        return [self.languages[b] if ok else NONE for b, ok in zip(best, letters)], score, rejected

    def known(self, texts: list[str], language: np.ndarray) -> np.ndarray:
        """Share of the 4-grams of each text that training saw in its language; 1 if it has none."""
        h, counts = fours(texts)
        at = _places(h, np.repeat(language, counts), 8 * len(self.seen))
        hit = np.concatenate(([0], np.cumsum(self.seen[at >> 3] >> (at & 7).astype(np.uint8) & 1, dtype=np.int64)))
        ends = np.cumsum(counts)
        return np.where(counts > 0, (hit[ends] - hit[ends - counts]) / np.maximum(counts, 1), 1.0)

    def _logits(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(counts), self.table.shape[1]), np.float64)
        has = counts > 0
        if has.any():
            starts = (np.cumsum(counts) - counts)[has]
            sums[has] = np.add.reduceat(self.table[buckets], starts, axis=0, dtype=np.float64)
        mean = sums / np.maximum(counts, 1)[:, None]
        return mean + self.bias


def _places(h: np.ndarray, language: np.ndarray, bits: int) -> np.ndarray:
    """Places of 4-grams of languages in a table of so many bits, a power of two."""
    x = (h + language.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(29))) & np.uint64(bits - 1)).astype(np.int64)


def _seen(rows: list[tuple[int, str]]) -> np.ndarray:
    """The table of bits of the 4-grams of ``(language, text)`` pairs."""
    grams: dict[int, list[np.ndarray]] = {}
    for y, text in rows:
        grams.setdefault(y, []).append(np.unique(fours([text])[0]))
    each = {y: np.unique(np.concatenate(g)) for y, g in grams.items()}
    bits = 1 << max(10, (SEEN_BITS * sum(map(len, each.values()))).bit_length())
    table = np.zeros(bits // 8, np.uint8)
    for y, g in each.items():
        at = _places(g, np.full(len(g), y), bits)
        np.bitwise_or.at(table, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return table


def _softmax(x: np.ndarray) -> np.ndarray:
    if not x.shape[1]:
        return x
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fits and calibrates a model on ``(lang, text)`` pairs."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in rows})
    index = {lang: i for i, lang in enumerate(languages)}
    examples: list[tuple[int, str, bool]] = []
    for k, (lang, text) in enumerate(rows):
        test = k % 5 == 4
        examples.append((index[lang], text, test))
        words = text.split()
        for size in (1, 2, 4, 8, 16):
            if len(words) > size:
                at = int(rng.integers(len(words) - size))
                examples.append((index[lang], " ".join(words[at:at + size]), test))
    fit = []
    for y, text, test in examples:
        if not test:
            b, c = np.unique(ngrams([text])[0], return_counts=True)
            if len(b):
                fit.append((y, b.astype(np.int32), (c / c.sum()).astype(np.float32)))
    k = len(languages)
    embed = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, k), np.float32), np.zeros(k, np.float32)
    step, steps = 0, max(1, EPOCHS * len(fit))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            y, b, w = fit[i]
            mean = w @ embed[b]
            p = _softmax((mean @ layer + bias)[None])[0]
            p[y] -= 1
            rate = RATE * (1 - step / steps)
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * p
            embed[b] -= (rate * WIDTH) * w[:, None] * back
            step += 1
    model = Model(languages, (embed @ layer).astype(np.float32), bias.astype(np.float64),
                  _seen([(y, text) for y, text, test in examples if not test]))
    _calibrate(model, [(y, text) for (y, text, test) in examples if test])
    return model


def _calibrate(model: Model, held: list[tuple[int, str]]) -> None:
    if not held:
        return
    parts = []
    for at in range(0, len(held), 64):
        buckets, n = ngrams([t for _, t in held[at:at + 64]])
        logits = model._logits(buckets, n)
        parts.append((logits, model.known([t for _, t in held[at:at + 64]], logits.argmax(1)), n))
    logits, known, counts = (np.concatenate(x) for x in zip(*parts))
    y = np.array([a for a, _ in held])
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
    model.temperature = min((2.0 ** (k / 2) for k in range(-8, 15)), key=loss)
    score = _softmax(logits / model.temperature).max(1)
    size = np.digitize(counts, CLASSES)
    least = [(0.0, 0.0)]
    for k in range(1, len(CLASSES) + 1):
        mine, at = (size == k, REJECT) if (size == k).sum() >= LEAST_IN_CLASS else (size > 0, 0.0)
        least.append((float(np.quantile(score[mine], at)), float(np.quantile(known[mine], at))) if mine.sum() >= LEAST_HELD else (0.0, 0.0))
    model.least_score, model.least_known = zip(*least)


def sample(rows: DataFrame, per_language: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """At most ``per_language`` labelled texts of each of at most ``LANGUAGES`` languages, from ``rows(doc_id, lang, text)``.

    A digest of doc_id orders the rows. A share of each language by that digest is cut
    out in the scan, so that what is shuffled stays near the bound whatever the input.
    """
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= chars))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return []
    spark = rows.sparkSession
    share = F.broadcast(spark.createDataFrame([(r[0], min(1.0, 2.0 * per_language / r[1])) for r in sizes], "_lang string, _share double"))
    place = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 12), 16, 10).cast("long")
    near = rows.join(share, rows["lang"] == share["_lang"]).withColumn("_place", place)
    near = near.filter(F.col("_place") < F.col("_share") * F.lit(float(1 << 48)))
    first = near.withColumn("_rank", F.expr("row_number() over (partition by lang order by _place, doc_id, text)")).filter(F.col("_rank") <= per_language)
    return sorted((r[0], r[1], r[2]) for r in first.select("lang", "_place", "text").collect())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, learn: Column) -> Model:
    """Trains on the rows of ``docs`` for which ``learn`` holds."""
    rows = sample(docs.filter(learn).select("doc_id", "lang", "text"))
    return train([(lang, text) for lang, _, text in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred``, ``score`` and ``rejected``; columns of these names are replaced."""
    ship(docs.sparkSession)
    shared = Shared(docs.sparkSession, model)
    added = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())]
    docs = docs.drop(*[c for c, _ in added])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pc.fill_null(batch.column(at).cast(pa.string()), "").to_pylist()
            lang, score, rejected = shared.value.predict(texts) if texts else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                [*batch.schema.names, *[c for c, _ in added]])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(c, t) for c, t in added]]))


def op6(docs: DataFrame) -> DataFrame:
    model = fit(docs, ~held_out(F.col("doc_id")))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """Documents that are not rejected, with all their columns; only texts and row numbers pass through Python."""
    docs = numbered(docs)
    model = fit(docs, ~held_out(F.col("doc_id")))
    return without(docs, cut_lineage(predict(docs.select(ROW, "text"), model).filter("rejected").select(ROW)))
