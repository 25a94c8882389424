import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from curatrix.llm import simhash as sh


def plain(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps, ids, bits):
    root = {i: i for i in range(len(fps))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(fps)):
        least[find(i)] = min([x for x in (ids[i], least.get(find(i))) if x is not None], default=None)
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprints_against_brute_force(rows):
    for r in rows:
        assert sh.fingerprint_of(r[1], 4) == plain(r[1])


def test_long_texts_are_summed_in_parts(monkeypatch, rows):
    monkeypatch.setattr(sh, "PART", 1000)
    assert sh.fingerprint_of(rows[11][1], 4) == plain(rows[11][1])


def test_rows_against_brute_force(docs, rows, no_docs):
    found = sh.near_duplicates(docs).collect()
    fps = [plain(r[1]) for r in rows]
    want = brute(fps, [r[0] for r in rows], 4)
    a = sorted((str(r.doc_id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in found)
    assert a == sorted((str(r[0]), f, str(c)) for r, f, c in zip(rows, fps, want, strict=True))
    assert sh.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("most", [2048, 8])
def test_links_of_dense_clusters(spark, monkeypatch, most):
    """With groups of 8 at most, hot groups are dealt anew by their other bits; no link may get lost."""
    monkeypatch.setattr(sh, "MOST", most)
    rng = random.Random(9)
    fps = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        for _ in range(40):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    classes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, id long")
    stars = {r.a: r.b for r in sh.components(sh.links(classes, 4)).collect()}
    assert [stars.get(i, i) for i in range(len(fps))] == brute(fps, list(range(len(fps))), 4)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(5, 5)]
    stars = {r.a: r.b for r in sh.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert stars == {**{i: 100 for i in range(101, 161)}, **{i: 0 for i in range(1, 50)}}


def test_query_has_hex_fingerprints(docs):
    d = sh.near_duplicates(docs).select(F.lpad(F.lower(F.hex("fp")), 16, "0").alias("f"))
    assert d.filter(~F.col("f").rlike("^[0-9a-f]{16}$")).count() == 0


def test_any_long_is_an_id_and_hot_fingerprints_keep_theirs(spark, monkeypatch):
    """Ids of 2^62 and more, negative ones and none; two thirds of the rows have one of two fingerprints."""
    from curatrix.llm import common

    monkeypatch.setattr(common, "HOT", 4)
    text = lambda s: " ".join(f"{s}{i}" for i in range(40))
    rows = [((1 << 62) + 5, text("a")), ((1 << 63) - 1, text("a")), (-(1 << 63), text("b")), (1 << 62, text("b")), (None, text("c")), (None, text("c")), (None, text("d")), ((1 << 62) + 9, text("d"))]
    rows += [(1000 + i, "hot words here") for i in range(60)] + [(2000 + i, None) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in sh.near_duplicates(d).collect())
    least = {text("a"): (1 << 62) + 5, text("b"): -(1 << 63), text("c"): None, text("d"): (1 << 62) + 9, "hot words here": 1000, None: 2000}
    assert got == sorted((str(k), str(least[x])) for k, x in rows)


def test_one_row_of_each_component_stays(spark, docs, rows):
    fps = [plain(r[1]) for r in rows]
    roots = brute(fps, list(range(len(rows))), 4)
    assert sh.first_of_each(docs).count() == len(set(roots))
    clash = docs.select("text", "doc_id", F.col("lang").alias("file"), F.lit(5).alias("row"), F.lit("b").alias("bucket"), "h")
    got = sh.first_of_each(clash)
    assert got.columns == clash.columns and {(r.row, r.bucket) for r in got.collect()} == {(5, "b")} and got.count() == len(set(roots))
    assert {r.file for r in got.collect()} <= {r.lang for r in docs.collect()}
