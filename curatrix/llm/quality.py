"""Quality classifier from weak labels.

Heuristic labellers vote over whole texts: good (1), bad (0), or abstaining (-1). They overlap and
err; expectation-maximisation over the counts of vote patterns of all documents (at most 3^labellers of them) estimates
each labeller's accuracy and how often it votes, without any label. The posterior of a pattern is the label on which a
linear scorer over hashed terms is trained, on at most TRAIN documents; it scores every whole text.

Votes are cast once for the label model, which needs all of them before any document can be scored, and again in the
scoring pass, where they cost a seventh of it and no shuffle. The sample that the scorer is trained on bears weak labels
only; TRAIN bounds it as it does labelled rows elsewhere, and the statistics of votes are of all documents.

Nulls: a null text is empty, on which every labeller abstains but that of length; rows without doc_id don't train the
scorer. Repeated rows are scored alike and train once. Very long texts are taken whole. A tie of the classes is a
posterior of a half, a score of a half is good. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise
from operator import and_, eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FOLDS = 5
SLOTS = 1 << 16
#: The bound of the documents that train the scorer.
TRAIN = 12_000
#: Documents of fewer words abstain in labellers of rates.
FEW = 8
MEMO = 400_000


LABELLERS = ("symbols", "capitals", "stutter", "marked", "triples", "lines", "sentences", "words", "length")
_SYMBOLS, _ENDS = b"#$%&*|!<>{}~^_=+@\\", b".!?"
_UPPER, _ASCII = bytes(range(65, 91)), bytes({*range(128)} - {*range(65, 91)} - {*range(97, 123)})
_MARK = re.compile(r"[#$%&*|<>{}~^_=+@\\]|!!")


def _vote(bad: bool, good: bool) -> int:
    return 0 if bad else 1 if good else -1


def votes_of(text: str) -> tuple[int, ...]:
    """Of each labeller: 1 good, 0 bad, -1 abstain."""
    pieces, raw = text.split(), text.encode("utf-8", "surrogatepass")
    n, n_words = len(raw), len(pieces)
    length = _vote(n_words == 0, n_words > 30)
    if n_words < FEW:
        return (-1,) * (len(LABELLERS) - 1) + (length,)
    without = lambda chars: n - len(raw.translate(None, chars))
    symbols, ends = without(_SYMBOLS) / n, without(_ENDS) / n
    letters = n - without(_ASCII)
    capitals = without(_UPPER) / max(letters, 1)
    same = [*map(eq, pieces, pieces[1:])]
    stutter, triples = sum(same) / n_words, sum(map(and_, same, same[1:])) / n_words
    marked = (sum(n for w, n in Counter(pieces).items() if _MARK.search(w)) if symbols else 0) / n_words
    lines = [x for x in text.split("\n") if len(x) > 20]
    unlike = len({*lines}) / max(len(lines), 1)
    mean = len(text) / n_words
    return (
        _vote(symbols > 0.05, symbols < 0.01),
        _vote(capitals > 0.3, capitals < 0.1),
        _vote(stutter > 0.2, stutter < 0.02),
        _vote(marked > 0.2, marked < 0.03),
        _vote(triples > 0.1, triples < 0.01),
        _vote(unlike < 0.5, unlike > 0.8) if len(lines) >= 3 else -1,
        _vote(ends < 0.002 or ends > 0.05, 0.005 < ends < 0.04),
        _vote(mean < 3 or mean > 14, 4 < mean < 10),
        length,
    )


#: What is believed of a labeller at first: the shares of abstaining, bad and good votes, on bad texts and on good ones. A
#: defect has one or two labellers that see it, so bad votes are rare on bad texts, but far rarer on good ones.
BELIEF = np.array([[0.12, 0.13, 0.75], [0.12, 0.003, 0.877]])
#: The weight of that belief, as a part of all documents.
TRUST = 0.02


class LabelModel:
    """Labellers vote independently of each other given the class: P(vote | class), and P(good), by maximum a posteriori."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> None:
        n, m = patterns.shape
        total = max(counts.sum(), 1)
        hot = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
        self.prior, self.p = 0.8, np.repeat(BELIEF[:, None], m, 1)
        for _ in range(rounds if n else 0):
            q = self.posterior(patterns)
            for c, w in ((1, q * counts), (0, (1 - q) * counts)):
                seen = np.einsum("n,nmv->mv", w, hot) + TRUST * total * BELIEF[c]
                self.p[c] = seen / seen.sum(1, keepdims=True)
            self.prior = float(np.clip((q * counts).sum() / total, 0.05, 0.98))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Abstaining tells nothing."""
        voted = self.p[:, :, 1:] / self.p[:, :, 1:].sum(2, keepdims=True)
        hot = np.stack([patterns == 0, patterns == 1], 2)
        one = np.log(self.prior) + (np.log(voted[1])[None] * hot).sum((1, 2))
        zero = np.log(1 - self.prior) + (np.log(voted[0])[None] * hot).sum((1, 2))
        return 1 / (1 + np.exp(np.clip(zero - one, -30, 30)))

    def accuracy(self) -> np.ndarray:
        """Of each labeller, where it votes."""
        right = self.prior * self.p[1, :, 2] + (1 - self.prior) * self.p[0, :, 1]
        votes = right + self.prior * self.p[1, :, 1] + (1 - self.prior) * self.p[0, :, 2]
        return right / np.maximum(votes, 1e-9)


_LETTERS, _CAPITALS = re.compile(r"[^\W\d_]+"), re.compile(r"^[^a-zß-öø-ÿ]*[A-ZÀ-Þ]{2,}[^a-zß-öø-ÿ]*$")


def _slot(term: str) -> int:
    return crc32(term.encode("utf-8", "surrogatepass")) % SLOTS


def terms_of(piece: str) -> tuple[int, ...]:
    """Hashed terms of a piece without white space: its letters, its other characters in order, its case."""
    low = piece.lower()
    marks = _LETTERS.sub("a", low)
    return (_slot("w" + low), _slot("m" + marks), _slot("c" + ("up" if _CAPITALS.match(piece) else "low")))


_AGAIN = _slot("again")


def vector_of(text: str, memo: dict[str, tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights: counts over the number of terms, square-rooted, so that length does not count."""
    pieces = text.split()
    if len(memo) > MEMO:
        memo.clear()
    count = Counter(pieces)
    at, n = [], []
    for p, k in count.items():
        if (t := memo.get(p)) is None:
            t = memo[p] = terms_of(p)
        at += t
        n += (k, k, k)
    again = sum(a == b for a, b in pairwise(pieces))
    if again:
        at.append(_AGAIN)
        n.append(again)
    if not at:
        return np.zeros(0, np.int64), np.zeros(0)
    slots, inverse = np.unique(np.array(at), return_inverse=True)
    return slots, np.sqrt(np.bincount(inverse, n) / len(pieces))


def train(vectors: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, rounds: int = 25, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer of soft labels q: AdaGrad in batches."""
    rng = np.random.default_rng(seed)
    w, bias, g2, b2 = np.zeros(SLOTS), 0.0, np.full(SLOTS, 1e-8), 1e-8
    for _ in range(rounds):
        order = rng.permutation(len(q))
        for s in range(0, len(order), 256):
            i = order[s : s + 256]
            n = np.array([len(vectors[k][0]) for k in i])
            at, x, row = np.concatenate([vectors[k][0] for k in i]), np.concatenate([vectors[k][1] for k in i]), np.repeat(np.arange(len(i)), n)
            z = bias + np.bincount(row, w[at] * x, len(i))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - q[i]) / len(i)
            gw = np.bincount(at, g[row] * x, SLOTS)
            g2 += gw**2
            b2 += g.sum() ** 2
            w -= 0.3 * gw / np.sqrt(g2)
            bias -= 0.3 * g.sum() / np.sqrt(b2)
    return w, float(bias)


def with_votes(docs: DataFrame) -> DataFrame:
    """doc_id, votes (joined by commas)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_said(votes_of(t.as_py() or "")) for t in b.column(1)], pa.string())], ["doc_id", "votes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, votes string")


def _said(votes: tuple[int, ...]) -> str:
    return ",".join(map(str, votes))


def label_model(votes: DataFrame) -> tuple[LabelModel, dict[str, float]]:
    """The model and the posterior of each vote pattern; patterns are bounded by the number of labellers."""
    by = {r.votes: r["count"] for r in votes.groupBy("votes").count().collect()}
    if not by:
        return LabelModel(np.zeros((0, len(LABELLERS)), np.int64), np.zeros(0)), {}
    patterns = np.array([[int(x) for x in k.split(",")] for k in by], np.int64)
    model = LabelModel(patterns, np.array([*by.values()], float))
    return model, dict(zip(by, model.posterior(patterns).tolist(), strict=True))


@dataclass(frozen=True)
class Scorer:
    """posterior of each vote pattern; weights and bias of the linear scorer."""

    posterior: dict[str, float]
    w: np.ndarray
    bias: float


def _held_out(c: Column) -> Column:
    return F.coalesce(common.fold(c, FOLDS) == 0, F.lit(False))


def fit(docs: DataFrame) -> Scorer:
    """The label model of all documents, and the scorer of a bounded sample of them."""
    voted = common.written(with_votes(docs), "quality-votes")
    _, posterior = label_model(voted)
    chosen = voted.filter(F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id"))).select("doc_id").distinct()
    chosen = common.bounded_sample(chosen, "doc_id", TRAIN)
    # At most TRAIN ids; of several texts of one id the first in order.
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple] = {}
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            found = [vector_of(t, memo) for t in texts]
            q = [posterior[_said(votes_of(t))] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(q, pa.float64()), pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32()))], ["doc_id", "q", "at", "x"])

    def fitted(pdf):  # on an executor: the sample is bounded
        import pandas as pd

        pdf = pdf.sort_values("doc_id")
        w, bias = train([(np.asarray(a, np.int64), np.asarray(x, float)) for a, x in zip(pdf["at"], pdf["x"], strict=True)], pdf["q"].to_numpy())
        return pd.DataFrame({"w": [w.astype(np.float32).tobytes()], "bias": [bias]})

    rows = known.mapInArrow(vectors, "doc_id long, q double, at array<int>, x array<float>").withColumn("one", F.lit(1))
    found = rows.groupBy("one").applyInPandas(fitted, "w binary, bias double").first()
    return Scorer(posterior, *((np.frombuffer(found.w, np.float32).astype(float), found.bias) if found else (np.zeros(SLOTS), 0.0)))


def scored(docs: DataFrame, model: Scorer) -> DataFrame:
    """doc_id, held_out, votes, posterior, score, predicted (1: keep): one pass over whole texts, no shuffle."""
    shared, posterior, bias = docs.sparkSession.sparkContext.broadcast(model.w), model.posterior, model.bias

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple] = {}
        w = shared.value
        for b in batches:
            z, votes = [], []
            for t in b.column(2):
                text = t.as_py() or ""
                at, x = vector_of(text, memo)
                z.append(bias + float(w[at] @ x))
                votes.append(_said(votes_of(text)))
            s = 1 / (1 + np.exp(-np.clip(np.array(z), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(votes, pa.string()), pa.array([posterior.get(v) for v in votes], pa.float64()), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "votes", "posterior", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out(F.col("doc_id")).alias("held_out"), "text")
    return d.mapInArrow(score, "doc_id long, held_out boolean, votes string, posterior double, score double, predicted int")


def classify(docs: DataFrame) -> DataFrame:
    return scored(docs, fit(docs))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"))
