import random
import re
from zlib import crc32

import numpy as np
import pytest

from curatrix.llm import toxicity as tx


@pytest.fixture(scope="module")
def labelled(spark):
    """Toxic is an insult next to a group; either alone is clean, so that only pairs can tell."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(200)]
    docs, labels = [], []
    for i in range(900):
        t = [rng.choice(words) for _ in range(30)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        t += ["scumlike"] * insult + ["neighbours"] * group
        rng.shuffle(t)
        docs.append((i, " ".join(t), "en"))
        labels.append((i, 1, int(insult and group)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_pairs_are_learned_and_held_out_rows_are_right(labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in tx.scored(docs, tx.fit(docs, labels)).collect()}
    y = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    held = [k for k, r in got.items() if r.held_out]
    assert np.mean([got[k].predicted == y[k] for k in held]) > 0.93
    assert all((r.score >= 0.5) == bool(r.predicted) and 0 <= r.score <= 1 for r in got.values())


@pytest.fixture(scope="module")
def paired(spark):
    """Four words, each as common in toxic texts as in others: only which two stand beside each other tells."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdef") for _ in range(6)) for _ in range(3000)]
    docs, labels = [], []
    for i in range(2500):
        t = [rng.choice(words) for _ in range(30)]
        a, b, at = rng.random() < 0.5, rng.random() < 0.5, rng.randrange(30)
        t[at:at] = [["goodly", "grubling"][a], ["strangers", "neighbours"][b]]
        docs.append((i, " ".join(t), "en"))
        labels.append((i, 1, int(a == b)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_terms_that_only_tell_in_pairs(paired):
    docs, labels = paired
    model = tx.fit(docs, labels)
    assert {crc32(w.encode()) % tx.SLOTS for w in ("goodly", "grubling", "strangers", "neighbours")} <= {*model.slots.tolist()}
    y = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in tx.scored(docs, model).collect() if r.held_out]
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.99


def chi_square(a, b, n1, n0):
    table = [(a, b), (n1 - a, n0 - b)]
    n, out = n1 + n0, 0.0
    for row in table:
        for k, total in enumerate((n1, n0)):
            want = sum(row) * total / n
            out += (row[k] - want) ** 2 / want if want else 0
    return out


def plain_terms(text):
    out = set()
    for w in re.findall(r"\w+", (text or "").lower()):
        out |= {crc32(w.encode()) % tx.SLOTS} | ({crc32(b"^" + w[:4].encode()) % tx.SLOTS} if len(w) > 4 else set())
    return out


@pytest.mark.parametrize("kind", ["labelled", "paired"])
def test_selection_against_brute_force(kind, request):
    docs, labels = request.getfixturevalue(kind)
    y = {r.doc_id: r.toxic for r in labels.collect() if crc32(str(r.doc_id).encode()) % 5}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in y}
    n1 = sum(y.values())

    def telling(sets):
        seen = {f: [0, 0] for s in sets.values() for f in s}
        for k, s in sets.items():
            for f in s:
                seen[f][y[k]] += 1
        return {f for f, (b, a) in seen.items() if chi_square(a, b, n1, len(y) - n1) >= tx.TELLS}

    own = telling({k: plain_terms(t) for k, t in texts.items()})
    pairs = {}
    for k, t in texts.items():
        w = [crc32(x.encode()) % tx.SLOTS for x in re.findall(r"\w+", t.lower())]
        pairs[k] = {(min(a, b), max(a, b)) for i, a in enumerate(w) for b in w[i + 1 : i + 1 + tx.WINDOW] if a != b and not {a, b} & own}
    assert {*tx.fit(docs, labels).slots.tolist()} == own | {x for p in telling(pairs) for x in p}


def test_held_out_labels_do_not_count(spark, labelled):
    from pyspark.sql import functions as F

    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = tx.fit(docs, labels), tx.fit(docs, turned)
    assert sorted(a.slots.tolist()) == sorted(b.slots.tolist())


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = tx.Machine(np.arange(6), 0.1, rng.normal(size=6), rng.normal(size=(6, 3)))
    s = np.array([0, 2, 5])
    z = 0.1 + m.w[s].sum() + sum(m.v[a] @ m.v[b] for i, a in enumerate(s) for b in s[:i])
    assert np.allclose(m.scores([s, np.zeros(0, int)]), [1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-0.1))])


def test_odd_rows(spark, docs, no_docs, rows):
    labels = spark.createDataFrame([(None, 1, 1), (3, 1, None), (6, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    d = docs
    many = labels.unionByName(labels.filter("doc_id = 6")).unionByName(spark.createDataFrame([(9, 1, 0)], labels.schema))
    assert tx.fit(d.unionByName(d).unionByName(d), many).bias == tx.fit(d, many).bias  # repeated rows train once
    got = tx.scored(d, tx.fit(d, labels)).collect()
    assert len(got) == len(rows)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    none = labels.filter("false")
    assert {r.score for r in tx.scored(d, tx.fit(d, none)).collect()} == {0.0}
    assert tx.scored(no_docs, tx.fit(no_docs, none)).count() == 0
    assert tx.annotated(docs, None).columns == [*docs.drop("score").columns, "score", "predicted"]
