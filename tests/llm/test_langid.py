import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from curatrix.llm import langid as li


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    syllables = {"aa": ["ka", "ti", "mo"], "bb": ["sch", "ein", "gen"], "cc": ["tion", "eau", "qu"]}
    out = []
    for i in range(300):
        lang = rng.choice(sorted(syllables))
        out.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(30)) + rng.choice(["", " 12 !"]), lang))
    return spark.createDataFrame(out, "doc_id long, text string, lang string")


def test_held_out_rows(texts):
    got = li.identified(texts, li.fit(texts)).collect()
    y = {r.doc_id: r.lang for r in texts.collect()}
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == y[r.doc_id] for r in got if r.held_out]) > 0.98


def test_filters_contain_all_that_was_put_in(texts, spark):
    f = li.fit(texts)
    grams = {g for r in texts.filter("lang = 'bb'").collect() if crc32(str(r.doc_id).encode()) % 4 != 2 for w in li.words_of(r.text) for g in li.grams_of(w)}
    own = [g for g in grams if not any(x in g for x in ("ka", "ti"))]
    k = f.names.index("bb")
    masks = np.bitwise_and.reduce(f.slots[0][np.array([li.slots_of(g) for g in own])], axis=1)
    assert ((masks >> k) & 1).mean() > 0.8


def plain_grams(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    return [f" {w} "[i : i + n] for w in words for n in li.GRAMS for i in range(len(w) + 3 - n)]


def test_hits_and_decisions_against_sets(texts, spark):
    """Each language's n-grams as a plain set: all are in its filter, and few others; hits, correction, decision and score follow from sets of what the filters contain."""
    rows = texts.collect()
    counts = {}
    for r in rows:
        if crc32(str(r.doc_id).encode()) % 4 != 2:
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    share = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    sets = {k: {g for g, n in c.items() if n >= li.LEAST and share[k][g] >= li.RATIO * max(s.get(g, 0) for s in share.values())} for k, c in counts.items()}
    f = li.fit(texts)
    assert f.names == sorted(sets)
    known = sorted({g for c in counts.values() for g in c})
    contained = {k: {g for g in known if all(int(f.slots[0][s]) >> i & 1 for s in li.slots_of(g))} for i, k in enumerate(f.names)}
    for i, k in enumerate(f.names):
        assert sets[k] <= contained[k] and len(contained[k] - sets[k]) <= 1 + 10 * f.rate[i] * len(known)
        ones = {s for g in sets[k] for s in li.slots_of(g)}
        assert abs(f.rate[i] - (len(ones) / li.SLOTS) ** li.HASHES) < 1e-12
    got = {r.doc_id: r for r in li.identified(texts, f).collect()}
    for r in rows:
        grams = plain_grams(r.text)
        true = [max(0.0, (sum(g in contained[k] for g in grams) - rate * len(grams)) / (1 - rate)) for k, rate in zip(f.names, f.rate, strict=True)]
        assert got[r.doc_id].lang_pred == f.names[true.index(max(true))]
        assert abs(got[r.doc_id].score - max(true) / sum(true)) < 1e-9
        assert abs(got[r.doc_id].support - min(1, max(true) / len(grams))) < 1e-9


def test_very_long_words(texts):
    f = li.fit(texts)
    word = "kati" * 50_000
    assert [g for part in li.grams_by_parts(word) for g in part] == plain_grams(word)
    got = li.Seen(f).hits([word, "ka"])
    own = [g for w in (word, "ka") for g in plain_grams(w)]
    assert got[-1] == len(own) and got[0] == sum(all(int(f.slots[0][s]) & 1 for s in li.slots_of(g)) for g in own)


def test_memo_overflow_changes_nothing(texts, monkeypatch):
    f = li.fit(texts)
    words = [w for r in texts.collect() for w in li.words_of(r.text)]
    a = li.Seen(f).hits(words)
    monkeypatch.setattr(li, "MEMO", 40)
    monkeypatch.setattr(li, "GRAM_MEMO", 900)
    monkeypatch.setattr(li, "AT_ONCE", 17)
    assert np.array_equal(li.Seen(f).hits(words), a)
    monkeypatch.setattr(li, "LONG", 4)
    assert np.array_equal(li.Seen(f).hits(words), a)
    monkeypatch.setattr(li, "MEMO_BYTES", 900)
    assert np.array_equal(li.Seen(f).hits(words), a)


def test_many_languages(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(chr(0x4E00 + 3 * (i % 70)) * 2 + chr(97 + rng.randint(0, 3)) for _ in range(20)), f"l{i % 70:02d}") for i in range(700)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in li.identified(d, li.fit(d)).collect()}
    assert np.mean([got[i] == x for i, _, x in rows]) > 0.95


def test_odd_rows(spark, docs, no_docs, rows, texts):
    d = docs
    assert li.annotated(d, li.fit(no_docs)).columns == [*d.drop("score").columns, "lang_pred", "score", "support"]
    got = li.identified(d, li.fit(texts)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert len(got) == len(rows)
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (0, 3, 6))
    assert by[12].lang_pred != "und" or by[9].lang_pred != "und"
    assert {r.lang_pred for r in li.identified(d, li.fit(no_docs)).collect()} == {"und"}
    marks = spark.createDataFrame([(1, "12 ½² ---"), (2, "½ ka")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in li.identified(marks, li.fit(texts)).orderBy("doc_id").collect()] == [True, False]
    assert li.identified(no_docs, li.fit(texts)).count() == 0
