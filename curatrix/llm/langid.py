"""Language ID by bit-sliced Bloom filters of character n-grams.

All languages share one array of slots; a slot holds a bitmask with one bit for each language, so that the AND of an
n-gram's HASHES slots gives all languages whose filter contains it. A filter holds the n-grams that are common in the
language: at least LEAST occurrences, and a share of at least RATIO of that in the language where it is most common.
A text's hits are counted per language and corrected for the filter's rate of false positives; the most hits decide.
The score is that language's part of all corrected hits; the support, which tells whether the text is in any language
that was learned, is the part of the text's n-grams that they are.

Learns from rows with text and lang whose crc32(doc_id) mod 4 is not 2, at most TRAIN of them. Nulls: a null text, like
an empty one or one without a letter, is `und` with score 0, as is all if nothing could be learned; a null doc_id is never
held out and does not train. Whole texts count, repeated rows alike; very long texts and words are looked up in parts. An
empty table gives an empty result. Ties go to the name that is first in order. Columns named like results are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

FOLDS, HELD_OUT = 4, 2
GRAMS = (2, 3, 4)
SLOTS, HASHES = 1 << 20, 3
LEAST, RATIO = 3, 0.35
#: The bound of the rows that train.
TRAIN = 16_000
#: Languages in one mask.
BITS = 62
#: Words and n-grams whose hits a task remembers, and n-grams that it looks up at once; bytes of what it remembers of each.
MEMO, GRAM_MEMO, AT_ONCE = 300_000, 400_000, 200_000
MEMO_BYTES = 32 << 20
#: Longer words are not remembered, and are looked up in parts.
LONG = 10_000
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def grams_of(word: str) -> list[str]:
    """n-grams of a word with its ends."""
    return [g for part in grams_by_parts(word) for g in part]


def grams_by_parts(word: str) -> Iterator[list[str]]:
    w = f" {word} "
    for n in GRAMS:
        for at in range(0, len(w) - n + 1, LONG):
            yield [w[i : i + n] for i in range(at, min(at + LONG, len(w) - n + 1))]


def slots_of(gram: str) -> list[int]:
    raw = gram.encode("utf-8", "surrogatepass")
    a, b = crc32(raw), crc32(raw, 0x9E3779B9) | 1
    return [(a + i * b) % SLOTS for i in range(HASHES)]


@dataclass(frozen=True)
class Filters:
    """slots: (masks, SLOTS); rate: false positives of each language; docs: how many documents it was learned from."""

    names: list[str]
    slots: np.ndarray
    rate: np.ndarray
    docs: np.ndarray

    def decide(self, hits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language numbers, scores and supports (corrected hits of the language, as a part of the n-grams) of rows of hits among n grams each."""
        true = np.maximum(0, (hits - self.rate * n[:, None]) / (1 - np.minimum(self.rate, 0.99)))
        best, most = true.argmax(1), true.max(1)
        total = true.sum(1)
        return best, np.where(total > 0, most / np.maximum(total, 1e-9), 0.0), np.minimum(1.0, most / np.maximum(n, 1))


def fit(docs: DataFrame) -> Filters:
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (common.fold(F.col("doc_id"), FOLDS) != HELD_OUT)).select("doc_id", "text", "lang")
    known = common.bounded_sample(known, "doc_id", TRAIN)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, Counter] = {}
            for t, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, Counter()).update(words_of(t.as_py()))
            for lang, words in by.items():
                grams: Counter = Counter()
                for p, n in words.items():
                    for part in grams_by_parts(p):
                        for g in part:
                            grams[g] += n
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array([*grams], pa.string()), pa.array([*grams.values()], pa.int64())], ["lang", "gram", "n"])

    counts = common.written(known.select("text", "lang").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lang-grams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row a language
    names = sorted(totals)
    if not names:
        return Filters([], np.zeros((0, SLOTS), np.int64), np.zeros(0), np.zeros(0, np.int64))
    number = F.create_map(*[x for i, k in enumerate(names) for x in (F.lit(k), F.lit(i))])
    share = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(1.0 / totals[k]))])
    d = counts.withColumn("r", F.col("n") * share[F.col("lang")]).withColumn("most", F.max("r").over(Window.partitionBy("gram")))
    d = d.filter((F.col("n") >= LEAST) & (F.col("r") >= RATIO * F.col("most"))).select("gram", number[F.col("lang")].alias("k"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.array([slots_of(g) for g in b.column(0).to_pylist()], np.int64).reshape(-1)
            k = np.repeat(b.column(1).to_numpy().astype(np.int64), HASHES)
            yield pa.RecordBatch.from_arrays([pa.array(k // BITS, pa.int64()), pa.array(at), pa.array(np.int64(1) << (k % BITS))], ["m", "slot", "bits"])

    set_bits = d.mapInArrow(place, "m long, slot long, bits long").groupBy("m", "slot").agg(F.bit_or("bits").alias("bits"))
    slots = np.zeros((-(-len(names) // BITS), SLOTS), np.int64)
    found = set_bits.toArrow()  # at most SLOTS rows of three numbers a mask, whatever the input
    slots[found["m"].to_numpy(), found["slot"].to_numpy()] = found["bits"].to_numpy()
    fill = np.array([((slots[i // BITS] >> (i % BITS)) & 1).mean() for i in range(len(names))])
    from_docs = dict(known.groupBy("lang").count().collect())  # a row a language
    return Filters(names, slots, fill**HASHES, np.array([from_docs.get(k, 0) for k in names]))


def annotated(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs with lang_pred, score and support: one pass over whole texts, no shuffle. Columns of docs that have these names are replaced."""
    docs = common.short_batches(docs.drop("lang_pred", "score", "support"))
    # The filters, of a fixed size, go to executors once.
    shared = docs.sparkSession.sparkContext.broadcast((filters.names, np.flatnonzero(filters.slots.any(0)), filters.slots[:, filters.slots.any(0)], filters.rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, at, bits, rate = shared.value
        slots = np.zeros((len(bits), SLOTS), np.int64)
        slots[:, at] = bits
        f = Filters(names, slots, rate, np.zeros(0))
        seen = Seen(f)
        for b in batches:
            hits, letters = np.zeros((b.num_rows, len(names) + 1)), []
            for i, t in enumerate(b.column("text")):
                words = words_of(t.as_py() or "")
                letters.append(bool(names) and any(any(map(str.isalpha, w)) for w in words))
                if letters[-1]:
                    hits[i] = seen.hits(words)
            best, score, support = f.decide(hits[:, :-1], hits[:, -1]) if names else (None, np.zeros(b.num_rows), np.zeros(b.num_rows))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([names[best[i]] if x else "und" for i, x in enumerate(letters)], pa.string()), *(pa.array(np.where(letters, x, 0.0), pa.float64()) for x in (score, support))], [*b.schema.names, "lang_pred", "score", "support"])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("support", T.DoubleType())]))


def identified(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score, support."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(common.fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return annotated(d, filters).drop("text")


class Seen:
    """Hits of words, with what was looked up before, in bounded memory whatever the number of languages."""

    def __init__(self, f: Filters) -> None:
        self.f, self.words, self.grams, self.width = f, {}, {}, len(f.names) + 1
        self.most = max(4, min(MEMO, MEMO_BYTES // (8 * self.width)))
        self.most_grams = max(AT_ONCE, min(GRAM_MEMO, MEMO_BYTES // (8 * max(1, len(f.slots)))))
        self.table = np.zeros((self.most + 1, self.width))
        self.masks = np.zeros((len(f.slots), self.most_grams + 1), np.int64)

    def hits(self, words: list[str]) -> np.ndarray:
        """For each language the n-grams that its filter contains, and at last all n-grams."""
        out = np.zeros(self.width)
        for w in words:
            if len(w) > LONG:
                for part in grams_by_parts(w):
                    out += self._counted(part, np.zeros(len(part), np.int64), 1)[0]
        words = [w for w in words if len(w) <= LONG]
        for at in range(0, len(words), self.most // 4):
            part = words[at : at + self.most // 4]
            new = {w for w in part if w not in self.words}
            if len(self.words) + len(new) > self.most:
                self.words.clear()
                new = {*part}
            if new:
                self._look_up([*new])
            out += self.table[[*map(self.words.__getitem__, part)]].sum(0)
        return out

    def _counted(self, grams: list[str], row: np.ndarray, rows: int) -> np.ndarray:
        out = np.zeros((rows, self.width))
        out[:, -1] = np.bincount(row, minlength=rows)
        masks = self._masks(grams)
        for k in range(len(self.f.names)):
            out[:, k] = np.bincount(row, (masks[k // BITS] >> (k % BITS)) & 1, rows)
        return out

    def _look_up(self, words: list[str]) -> None:
        first, at = len(self.words), 0
        while at < len(words):
            own: list[list[str]] = []
            size = 0
            while at < len(words) and (not own or size < AT_ONCE - 3 * LONG):
                own.append(grams_of(words[at]))
                size += len(own[-1])
                at += 1
            row = np.repeat(np.arange(len(own)), [len(g) for g in own])
            self.table[first + at - len(own) : first + at] = self._counted([g for o in own for g in o], row, len(own))
        self.words.update(zip(words, range(first, first + len(words)), strict=True))

    def _masks(self, grams: list[str]) -> np.ndarray:
        new = {g for g in grams if g not in self.grams}
        if len(self.grams) + len(new) > self.most_grams:
            self.grams.clear()
            new = {*grams}
        if new:
            n = len(self.grams)
            self.masks[:, n : n + len(new)] = np.bitwise_and.reduce(self.f.slots[:, np.array([slots_of(g) for g in new])], axis=2)
            self.grams.update(zip(new, range(n, n + len(new)), strict=True))
        return self.masks[:, np.fromiter(map(self.grams.__getitem__, grams), np.int64, len(grams))]


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identified(docs, fit(docs))
