import random
import re
from collections import Counter
from math import exp, log, prod
from zlib import crc32

import numpy as np
import pytest

from curatrix.llm import quality as q


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    out = []
    for i in range(400):
        s = [rng.choice(words) for _ in range(60)]
        kind = rng.choice(["good"] * 4 + ["marks", "caps", "stutter"])
        if kind == "marks":
            s = [w + rng.choice(["###", "&&&", "***"]) for w in s]
        elif kind == "caps":
            s = [w.upper() + "!!" for w in s]
        elif kind == "stutter":
            s = [w for w in s[:12] for _ in range(5)]
        else:
            s = [w + ("." if j % 9 == 8 else "") for j, w in enumerate(s)]
        out.append((i, " ".join(s), int(kind == "good")))
    return spark.createDataFrame(out, "doc_id long, text string, quality int")


def test_no_label_is_needed(mixed):
    y = {r.doc_id: r.quality for r in mixed.collect()}
    got = q.classify(mixed.drop("quality")).collect()
    assert np.mean([r.predicted == y[r.doc_id] for r in got]) > 0.97
    assert min(r.predicted for r in got if y[r.doc_id]) == 1 or np.mean([r.predicted for r in got if y[r.doc_id]]) > 0.99


def test_em_finds_accuracies():
    rng = np.random.default_rng(4)
    y = rng.random(20_000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.85, 0.97])
    votes = np.where(rng.random((len(y), 4)) < accuracy, y[:, None], ~y[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.1] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    m = q.LabelModel(patterns, counts.astype(float))
    post = {tuple(p): v for p, v in zip(patterns.tolist(), m.posterior(patterns), strict=True)}
    assert np.mean([(post[tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), y, strict=True)]) > 0.93


def test_odd_rows(docs, no_docs, rows):
    got = q.classify(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert q.votes_of("")[-1] == 0 and set(q.votes_of("")[:-1]) == {-1}
    assert q.classify(no_docs).count() == 0
    again = docs.unionByName(docs).unionByName(docs)
    assert {(r.doc_id, r.votes): r.score for r in q.classify(again).collect()}.keys() == {(r.doc_id, r.votes) for r in got}
    assert q.fit(again).bias == pytest.approx(q.fit(docs).bias, abs=0.2)  # repeated rows count in the statistics, but train once


def vote(bad, good):
    return 0 if bad else 1 if good else -1


def plain_votes(text):
    """Each labeller said plainly."""
    words, raw = text.split(), text.encode()
    length = vote(not words, len(words) > 30)
    if len(words) < 8:
        return [-1] * 8 + [length]
    share = lambda chars: sum(c in chars for c in raw) / len(raw)
    letters = sum(c >= 128 or chr(c).isalpha() for c in raw)
    upper = sum(65 <= c <= 90 for c in raw) / max(letters, 1)
    double = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
    triple = sum(a == b == c for a, b, c in zip(words, words[1:], words[2:], strict=False)) / len(words)
    marked = sum(bool(re.search(r"[#$%&*|<>{}~^_=+@\\]|!!", w)) for w in words) / len(words) if share(b"#$%&*|!<>{}~^_=+@\\") else 0
    lines = [x for x in text.split("\n") if len(x) > 20]
    unlike = len(set(lines)) / len(lines) if lines else 0
    symbols, ends, mean = share(b"#$%&*|!<>{}~^_=+@\\"), share(b".!?"), len(text) / len(words)
    return [vote(symbols > 0.05, symbols < 0.01), vote(upper > 0.3, upper < 0.1), vote(double > 0.2, double < 0.02), vote(marked > 0.2, marked < 0.03), vote(triple > 0.1, triple < 0.01), vote(unlike < 0.5, unlike > 0.8) if len(lines) >= 3 else -1, vote(ends < 0.002 or ends > 0.05, 0.005 < ends < 0.04), vote(mean < 3 or mean > 14, 4 < mean < 10), length]


def test_votes_against_plain_ones(mixed, rows):
    for text in [r.text for r in mixed.collect()] + [r[1] or "" for r in rows]:
        assert [*q.votes_of(text)] == plain_votes(text)


def plain_em(patterns, counts, rounds=100):
    """The label model with loops; the belief counts as a part of all documents."""
    m, total = len(patterns[0]), sum(counts)
    prior, p = 0.8, [[q.BELIEF[c].tolist() for _ in range(m)] for c in (0, 1)]

    def posterior(x):
        side = [w * prod(p[c][i][v + 1] / (p[c][i][1] + p[c][i][2]) for i, v in enumerate(x) if v >= 0) for c, w in ((0, 1 - prior), (1, prior))]
        return 1 / (1 + exp(max(-30, min(30, log(side[0]) - log(side[1])))))

    for _ in range(rounds):
        post = [posterior(x) for x in patterns]
        new = []
        for c in (0, 1):
            weight = [(g if c else 1 - g) * n for g, n in zip(post, counts, strict=True)]
            seen = [[sum(w for x, w in zip(patterns, weight, strict=True) if x[i] == v) + q.TRUST * total * q.BELIEF[c][v + 1] for v in (-1, 0, 1)] for i in range(m)]
            new.append([[s / sum(row) for s in row] for row in seen])
        p, prior = new, min(0.98, max(0.05, sum(g * n for g, n in zip(post, counts, strict=True)) / total))
    return [posterior(x) for x in patterns]


def test_posteriors_and_scores_against_loops(mixed):
    docs = mixed.drop("quality")
    texts = {r.doc_id: r.text for r in docs.collect()}
    by = Counter(tuple(plain_votes(x)) for x in texts.values())
    want = dict(zip(by, plain_em([*by], [*by.values()]), strict=True))
    model = q.fit(docs)
    assert {k: pytest.approx(v, abs=1e-6) for k, v in model.posterior.items()} == {",".join(map(str, k)): v for k, v in want.items()}
    for r in q.scored(docs, model).collect():
        words = texts[r.doc_id].split()
        weight = Counter()
        for w in words:
            low = w.lower()
            marks = re.sub(r"[^\W\d_]+", "a", low)
            upper = re.match(r"^[^a-zß-öø-ÿ]*[A-ZÀ-Þ]{2,}[^a-zß-öø-ÿ]*$", w)
            weight.update(crc32(x.encode()) % q.SLOTS for x in ("w" + low, "m" + marks, "cup" if upper else "clow"))
        weight[crc32(b"again") % q.SLOTS] += sum(a == b for a, b in zip(words, words[1:], strict=False))
        z = model.bias + sum(model.w[s] * (n / len(words)) ** 0.5 for s, n in weight.items())
        assert r.score == pytest.approx(1 / (1 + exp(-z)), abs=1e-9) and r.predicted == (r.score >= 0.5)
        assert r.posterior == pytest.approx(want[tuple(plain_votes(texts[r.doc_id]))], abs=1e-6)


def test_a_labeller_that_always_says_the_same_changes_no_verdict():
    rng = np.random.default_rng(2)
    y = rng.random(3000) < 0.8
    votes = np.where(rng.random((3000, 4)) < 0.95, y[:, None], ~y[:, None]).astype(int)
    same = np.c_[votes, np.ones(3000, int)]
    post = []
    for v in (votes, same):
        patterns, at, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
        post.append(q.LabelModel(patterns, counts.astype(float)).posterior(patterns)[at] > 0.5)
    assert np.mean(post[0] == post[1]) > 0.99
