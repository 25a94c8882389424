from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, h string"


@pytest.fixture(scope="session")
def rows():
    """Null, empty, very long, repeated and near-equal texts; repeated rows; a null id; columns whose names clash with results."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(300)
    texts = [None, "", " \t\n", "x", "Ein Σ<|endoftext|>ς", "don't  we'll\x0bgo!!", base, base, base + " tail", base.upper(), base.replace("a", "o", 1), text(30_000), "\n".join(text(12) for _ in range(9)), "a" * 5000, "😀 ☃ 123 ½"]
    texts += [text(rng.randint(1, 80)) for _ in range(40)]
    out = [(i * 3, t, "en" if i % 2 else "de", "s", len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    return [*out, out[7], (None, base, None, None, None, None, None), (999, base, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
