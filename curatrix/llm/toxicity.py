"""Toxicity: a factorization machine over hashed terms.

Terms are a text's words and the first PREFIX letters of longer words, hashed to SLOTS. The machine is of second order:
besides a weight, each term has a vector, and the product of two vectors weighs the pair, so that an insult next to the
mention of a group counts for more than both apart. It has all terms that tell the labels, however many: those whose own
chi-square over the training rows is at least TELLS, and, of the others, the members of pairs within WINDOW words whose
chi-square is (such a term may be as common in clean texts as in toxic ones). Pairs are counted in PAIRS hashed places
first, and exactly where a place tells. It is trained on labels of rows whose crc32(doc_id) mod 5 is not 0, at most TRAIN
of them.

Nulls: a null text counts as empty; rows without doc_id or label don't train; conflicting labels of one doc_id count as
toxic, of several texts of one doc_id the first in order trains. Without labels every score is 0. Whole texts are scored,
however long, repeated rows alike; an empty table gives an empty result. Terms of equal chi-square are in or out together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

FOLDS = 5
PREFIX = 4
SLOTS = 1 << 18
#: Chi-square of a term that tells: p is 1.2e-7, so that of SLOTS terms without meaning 0.03 are taken.
TELLS = 28.0
WINDOW, PAIRS = 8, 1 << 20
#: The bound of the labelled rows that train.
TRAIN = 20_000
FACTORS, STEPS, BATCH, RATE, DECAY = 8, 500, 1024, 0.02, 1e-3
MEMO = 250_000
#: Rows that a task works on at once.
ROWS = 256
_WORD = re.compile(r"\w+")


def slots_of(piece: str) -> tuple[int, ...]:
    """Hashed terms of a piece of text without white space."""
    out = set()
    for w in _WORD.findall(piece.lower()):
        out.add(crc32(w.encode("utf-8", "surrogatepass")) % SLOTS)
        if len(w) > PREFIX:
            out.add(crc32(b"^" + w[:PREFIX].encode("utf-8", "surrogatepass")) % SLOTS)
    return tuple(out)


@dataclass(frozen=True)
class Machine:
    """score = sigmoid(bias + sum of w + half of (|sum of v|^2 - sum of |v|^2)) over the selected slots present."""

    slots: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        n = np.array([len(x) for x in sets])
        z = np.full(len(sets), self.bias)
        if n.sum():
            at, row = np.concatenate(sets).astype(np.int64), np.repeat(np.arange(len(sets)), n)
            z += np.bincount(row, self.w[at], len(sets))
            for f in range(self.v.shape[1]):
                x = self.v[at, f]
                z += (np.bincount(row, x, len(sets)) ** 2 - np.bincount(row, x * x, len(sets))) / 2
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(sets: list[np.ndarray], y: np.ndarray, slots: np.ndarray, seed: int = 7) -> Machine:
    """Of rows' places in slots: Adam on the logistic loss in batches, classes weighed alike, with L2 and a falling rate."""
    rng, k = np.random.default_rng(seed), len(slots)
    p = [np.zeros(1), np.zeros(k), rng.normal(0, 0.01, (k, FACTORS))]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    pos = max(y.mean(), 1e-9)
    weight = np.where(y > 0, 0.5 / pos, 0.5 / max(1 - pos, 1e-9))
    order, at = rng.permutation(len(y)), 0
    for t in range(1, STEPS + 1):
        if at + BATCH > len(y):
            order, at = rng.permutation(len(y)), 0
        i = order[at : at + BATCH]
        at += BATCH
        n = np.array([len(sets[r]) for r in i])
        a, row = np.concatenate([sets[r] for r in i]), np.repeat(np.arange(len(i)), n)
        v = p[2][a]
        sums = np.stack([np.bincount(row, v[:, f], len(i)) for f in range(FACTORS)], 1)
        z = p[0] + np.bincount(row, p[1][a] - (v**2).sum(1) / 2, len(i)) + (sums**2).sum(1) / 2
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * weight[i] / len(i)
        gw, gs = np.bincount(a, g[row], k), (g[:, None] * sums)[row]
        gv = np.stack([np.bincount(a, gs[:, f], k) for f in range(FACTORS)], 1) - p[2] * gw[:, None]
        grads = [np.array([g.sum()]), gw + DECAY * p[1], gv + DECAY * p[2]]
        for j in range(3):
            m[j] = 0.9 * m[j] + 0.1 * grads[j]
            s[j] = 0.999 * s[j] + 0.001 * grads[j] ** 2
            p[j] = p[j] - RATE * (1.02 - t / STEPS) * (m[j] / (1 - 0.9**t)) / (np.sqrt(s[j] / (1 - 0.999**t)) + 1e-8)
    return Machine(slots, float(p[0][0]), p[1], p[2])


def _terms(docs: DataFrame) -> DataFrame:
    """y, terms (distinct hashed slots), words (slots of the words in order) of docs(text, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches, ROWS):
            sets, words = [], []
            for t in b.column(0):
                text = t.as_py() or ""
                sets.append(np.unique(np.fromiter((s for p in {*text.split()} for s in slots_of(p)), np.int32)))
                words.append(np.fromiter((crc32(m[0].encode("utf-8", "surrogatepass")) % SLOTS for m in _WORD.finditer(text.lower())), np.int32))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(sets, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.int32()))], ["y", "terms", "words"])

    return docs.select("text", "y").mapInArrow(run, "y int, terms array<int>, words array<int>")


def _telling(by: DataFrame, n1: int, n0: int) -> DataFrame:
    """Rows whose feature, in a toxic rows and b clean ones, tells."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    c, d = n1 - a, n0 - b
    return by.filter((n1 + n0) * (a * d - b * c) ** 2 >= TELLS * F.greatest(F.lit(1e-9), (a + b) * (c + d) * (a + c) * (b + d)))


def _counted(terms: DataFrame, column: str, size: int, places: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """place, a, b: in how many toxic rows and clean ones each of `size` places, of which `places` gives a row's distinct ones, is. A task counts in an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, size), np.int32)
        for b in common.sliced(batches, ROWS):
            for y, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seen[y, places(np.asarray(x.values, np.int64))] += 1
        at = np.flatnonzero(seen.any(0))
        for i in range(0, len(at), 1 << 16):
            x = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(seen[1, x], pa.int64()), pa.array(seen[0, x], pa.int64())], ["place", "a", "b"])

    return terms.select("y", column).mapInArrow(run, "place long, a long, b long").groupBy("place").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def near_pairs(words: np.ndarray) -> np.ndarray:
    """Pairs (lesser * SLOTS + greater) of different slots within WINDOW words, as often as they stand there; a negative slot is in none."""
    found = [np.zeros(0, np.int64)]
    for k in range(1, WINDOW + 1):
        x, y = words[:-k], words[k:]
        keep = (x != y) & (x >= 0) & (y >= 0)
        x, y = x[keep], y[keep]
        found.append(np.minimum(x, y) * SLOTS + np.maximum(x, y))
    return np.concatenate(found)


def place_of(pairs: np.ndarray) -> np.ndarray:
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64) % PAIRS


def _pair_slots(terms: DataFrame, known: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Members, not known, of pairs of such members that tell."""

    own = np.zeros(SLOTS, bool)
    own[known] = True

    def without(words: np.ndarray) -> np.ndarray:
        return np.where(own[words], -1, words)  # a known word keeps its place

    told = _counted(terms, "words", PAIRS, lambda w: np.unique(place_of(near_pairs(without(w)))))
    hits = _numbers(_telling(told, n1, n0).select("place"))  # at most PAIRS
    if not len(hits):
        return hits

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = np.zeros(PAIRS, bool)
        hit[hits] = True
        for b in common.sliced(batches, ROWS):
            for y, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                p = near_pairs(without(np.asarray(x.values, np.int64)))
                p = np.unique(p[hit[place_of(p)]])
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(np.full(len(p), y), pa.int64())], ["pair", "y"])

    by = terms.select("y", "words").mapInArrow(pairs, "pair long, y long").groupBy("pair").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    return _numbers(_telling(by, n1, n0).select(F.explode(F.array(F.floor(F.col("pair") / SLOTS), F.col("pair") % SLOTS)).alias("s")).distinct())  # at most SLOTS


def _numbers(df: DataFrame) -> np.ndarray:
    """The one column of a bounded result, in order."""
    return np.sort(df.toArrow().column(0).to_numpy().astype(np.int64))


def fit(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """From the labels of the training folds, at most about TRAIN rows."""
    y = labels.filter(F.col("toxic").isNotNull() & (common.fold(F.col("doc_id"), FOLDS) != 0)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    y = common.bounded_sample(y, "doc_id", TRAIN)
    known = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")  # at most TRAIN rows of two numbers
    known = common.short_batches(known.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")))
    terms = common.written(_terms(known), "toxic-terms")
    n = dict(terms.groupBy("y").count().collect())
    if not n:
        return None
    n1, n0 = n.get(1, 0), n.get(0, 0)
    slots = _numbers(_telling(_counted(terms, "terms", SLOTS, lambda x: x), n1, n0).select("place"))  # at most SLOTS
    slots = np.union1d(slots, _pair_slots(terms, slots, n1, n0)).astype(np.int64)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches, ROWS):
            own = [np.flatnonzero(np.isin(slots, np.asarray(t.values, np.int64))).astype(np.int32) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int32()))], ["y", "at"])

    rows = terms.select("y", "terms").mapInArrow(places, "y int, at array<int>").toArrow()  # at most TRAIN rows
    sets = sorted((y, x.values.to_numpy().astype(np.int64).tobytes()) for y, x in zip(rows["y"].to_pylist(), rows["at"], strict=True))
    return train([np.frombuffer(x, np.int64) for _, x in sets], np.array([y for y, _ in sets], np.float64), slots)


def annotated(docs: DataFrame, model: Machine | None) -> DataFrame:
    """docs with score and predicted (1: toxic): one pass over whole texts, no shuffle. Columns of docs that have these names are replaced."""
    docs = common.short_batches(docs.drop("score", "predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {int(s): i for i, s in enumerate(model.slots)} if model else {}
        memo: dict[str, tuple] = {}
        for b in batches:
            sets = []
            for t in b.column("text"):
                if len(memo) > MEMO:
                    memo.clear()
                pieces = {*(t.as_py() or "").split()}
                for p in [p for p in pieces if p not in memo]:
                    memo[p] = tuple(at[s] for s in slots_of(p) if s in at)
                sets.append(np.array([*set().union(*filter(None, map(memo.__getitem__, pieces)))], np.int64))
            s = model.scores(sets) if model else np.zeros(len(sets))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def scored(docs: DataFrame, model: Machine | None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(common.fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "text")
    return annotated(d, model).drop("text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, common.table(spark, sf_dir, "labels")))
