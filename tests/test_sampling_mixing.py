import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from curatrix.functions.keys import hkey
from curatrix.operators import dedup, mixing, ranking, sampling
from curatrix.plans import recipe, stage


def pools(spark, n=400):
    return spark.range(n).select(
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("sample_id"),
        F.when(F.col("id") % 3 == 0, "core_inner").when(F.col("id") % 3 == 1, "multi_frag").otherwise("empty_clear").alias("pool_id"),
        F.concat(F.lit("t"), (F.col("id") % 5).cast("string")).alias("template_stem"),
        F.when(F.col("id") % 2 == 0, "edge").otherwise("none").alias("chrome_family"),
        F.when(F.col("id") % 7 == 0, 0.9).when(F.col("id") % 7 == 1, 0.5).alias("text_occupancy"),
    )


def test_quota_sample(spark):
    got = Counter(r.pool_id for r in sampling.mixed_sample(pools(spark), "pool_id", {"core_inner": 0.8, "empty_clear": 0.2}, 10, "sample_id", 3).collect())
    assert got == {"core_inner": 8, "empty_clear": 2}


def test_boost(spark):
    rows = [(f"a{i}", "01" if i < 20 else "14" if i < 40 else "x") for i in range(70)]
    d = spark.createDataFrame(rows, "id string, stem string")
    got = Counter(r.stem for r in sampling.boosted_sample(d, "stem", ["01", "14"], 0.7, 20, "id", 1).collect())
    assert got["x"] == 6 and got["01"] == got["14"] == 7
    few = spark.createDataFrame([(f"a{i}", "01" if i < 4 else "x") for i in range(24)], "id string, stem string")
    got = Counter(r.stem for r in sampling.boosted_sample(few, "stem", ["01"], 0.5, 10, "id", 1).collect())
    assert got == {"01": 4, "x": 5}


def test_pages_come_once_first(spark):
    d = spark.createDataFrame([(i, f"p{i}") for i in range(5)] + [(10 + i, "p0") for i in range(5)], "id int, page string")
    assert {r.page for r in sampling.unique_page_first(d, "page", 5, "id", 1).collect()} == {f"p{i}" for i in range(5)}
    assert sampling.unique_page_first(d, "page", 8, "id", 1).count() == 8


def test_round_robin(spark):
    d = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "b"), (4, "a")], "pos int, k string")
    assert [r.pos for r in sampling.round_robin(d, "k", 4, "pos").collect()] == [0, 1, 2, 4]


def test_upsample(spark):
    d = spark.range(10).withColumnRenamed("id", "k")
    got = Counter(r.k for r in sampling.upsample(d, 1.35, 10, "k").collect())
    assert got.total() == 14 and sorted(got.values()) == [1] * 6 + [2] * 4
    assert sampling.upsample(d.limit(0), 1.35, 0, "k").count() == 0
    assert sampling.upsample(d, 2.5, 10, "k").filter("upsampled").count() == 15


def test_preferred_or_looser(spark):
    d = spark.range(20).withColumnRenamed("id", "k")
    assert sampling.preferred_or_looser(d, F.col("k") < 5, F.col("k") < 15, 4, "k", 1).filter("k >= 5").count() == 0
    assert sampling.preferred_or_looser(d, F.col("k") < 5, F.col("k") < 15, 9, "k", 1).count() == 9
    with pytest.raises(ValueError):
        sampling.preferred_or_looser(d, F.col("k") < 5, F.col("k") < 15, 16, "k", 1)


def test_capped_greedy(spark):
    rows = [("r", f"s{i:02d}", f"p{i % 10}", f"t{i % 5}", i % 3, 100 - i) for i in range(30)]
    d = spark.createDataFrame(rows, "reason string, id string, page string, template string, tertile int, score int")
    got = sampling.capped_greedy(d, "reason", [("score", False), ("id", True)], 12, "page", 2, "template", 5, "tertile", "reason string, id string, page string, template string, tertile int, score int").collect()
    assert len(got) == 12
    assert max(Counter(r.page for r in got).values()) <= 2 and max(Counter(r.tertile for r in got).values()) <= 5


def test_interleaved_and_runs(spark):
    d = mixing.interleaved(spark.range(60).selectExpr("id", "id % 3 AS k"), "k", "id", 5)
    ks = [r.k for r in d.orderBy("ord").collect()]
    assert all({*ks[i : i + 3]} == {0, 1, 2} for i in range(0, 60, 3))
    r = spark.createDataFrame([(i, k) for i, k in enumerate("aabbbacccc")], "o int, k string")
    assert mixing.longest_runs(r, ["k"], "o").first().max_run == 4
    for n in (1, 2, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        assert mixing.longest_run(r, "k", "o").first().max_run == 4
        assert mixing.longest_run(r.withColumn("k", F.lit("x")), "k", "o").first().max_run == 10
        assert mixing.longest_run(r.withColumn("k", F.col("o")), "k", "o").first().max_run == 1
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert mixing.longest_run(r.limit(0), "k", "o").first().max_run == 0


def test_rounds_mixed_locally_over_sampled_ranges(spark):
    n, w = 30000, 600
    h = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    at = {}
    for s in range(3):  # rounds over three strata
        at |= {i: (f"{rn:012d}|{h(42, rn, f'{s}|x')}", i) for rn, i in enumerate(sorted(range(s, n, 3), key=lambda i: (h(42, i), i)), 1)}
    rounds = sorted(at, key=at.get)

    def shuffled(ids, seed, half):  # within windows, the first of which may be half as wide
        cut = [ids[max(0, a) : a + w] for a in range(-half, n, w)]
        return [i for c in cut for i in sorted(c, key=lambda i: (h(seed, i), i))]

    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    old = {k: spark.conf.get(k) for k in conf}
    d = spark.range(n).select("id", (F.col("id") % 3).cast("string").alias("a"), F.lit("x").alias("b"), F.lit(1).alias("more"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        o = d.withColumn("o", F.md5(F.col("id").cast("string")))
        got = {r.id: r.position for r in mixing.positions(o, "o", "id").collect()}
        mixed = mixing.interleaved_locally(d, ["a", "b"], "id", 42, n)
        found = {r.id: r.ord for r in mixed.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {i: p for p, i in enumerate(sorted(range(n), key=lambda i: h(i)))}
    assert mixed.columns == ["id", "a", "b", "more", "ord"]
    assert found == {i: p for p, i in enumerate(shuffled(shuffled(rounds, "42a", 0), "42b", w // 2))}


def test_dedup(spark):
    d = spark.createDataFrame([("A  b", 1, 0), ("a B", 0, 1), ("c", 1, 2), ("d", 1, 3), ("e", 1, 4)], "t string, source int, line int").withColumn("k", dedup.pair_key(F.col("t")))
    assert sorted(r.t for r in dedup.capped_sources(d, "k", "source", "source", "line", 2).collect()) == ["a B", "c", "d"]


def test_hamming_pairs_against_brute_force(spark):
    import random

    rng = random.Random(1)
    v = [rng.getrandbits(63) for _ in range(60)]
    v += [x ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for x in v]
    d = spark.createDataFrame(list(enumerate(v)), "id int, h long")
    got = {(r.a, r.b, r.d) for r in dedup.hamming_pairs(d, "id", "h", 4, 63).collect()}
    assert got == {(i, j, (v[i] ^ v[j]).bit_count()) for i in range(120) for j in range(i + 1, 120) if (v[i] ^ v[j]).bit_count() <= 4}


def test_recipe_to_split(spark):
    r = recipe.parse({"name": "s", "mix": {"core_inner": 0.5, "multi_frag": 0.5}, "n": 60, "seed": 9, "stem_boost": {"core_inner": {"stems": ["t1.html"], "frac": 0.5}}})
    d = stage.composed(pools(spark), r).cache()
    assert d.count() == 60 and {x.stage for x in d.collect()} == {"s"}
    assert d.filter("text_occupancy > 0.7").count() == 0
    n = Counter(x.split for x in d.collect())
    assert n["train"] >= 48 and n["val"] and n["test"]
    for bad in ({}, {"mix": {"a": 1}, "chrome": {"x": 0.5}}, {"mix": {"a": 1}, "stem_boost": {"a": {"stems": [], "frac": 1}}}, {"mix": {"a": 1}, "stem_boost": {"a": {"stems": ["x"], "frac": 1.5}}}):
        with pytest.raises(ValueError):
            recipe.parse(bad)


def _rows(spark, n):
    return spark.range(n).select(F.col("id"), (F.col("id") % 3).cast("string").alias("b"), F.concat(F.lit("p"), (F.col("id") % 50).cast("string")).alias("page"), (F.col("id") % 4).cast("string").alias("tpl"), (F.col("id") % 5 % 3).cast("int").alias("ter"), ((F.col("id") * 7919) % 10007).alias("score")).repartition(6)


def test_quota_of_thousands_shuffles_only_what_may_be_chosen(spark):
    """The real quotas are beyond the limit up to which Spark cuts windows before a shuffle."""
    d = _rows(spark, 60_000)
    few = ranking.cut_by_hash(d, "b", spark.createDataFrame([("0", 7500), ("1", 30)], "b string, limit int"), "id", 5)
    sizes = {r.b: r["count"] for r in few.groupBy("b").count().collect()}
    assert set(sizes) == {"0", "1"} and 7500 <= sizes["0"] < 7600 and 30 <= sizes["1"] < 80
    got = sampling.quota_sample(d, "b", {"0": 7500, "1": 30, "none": 4}, "id", 5)
    order = {r.id: r.h for r in d.select("id", hkey(5, "id").alias("h")).collect()}
    by = {}
    for r in got.collect():
        by.setdefault(r.b, set()).add(r.id)
    for b, n in (("0", 7500), ("1", 30)):
        want = sorted((i for i in order if str(i % 3) == b), key=lambda i: (order[i], i))[:n]
        assert by[b] == set(want)


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_ranks_do_not_depend_on_the_number_of_slices(spark, monkeypatch, digits):
    monkeypatch.setattr(ranking, "digits_for", lambda df: digits)
    d = _rows(spark, 2000)
    got = {r.id: (r.rn, r.n) for r in ranking.hash_rank(d, ["b"], "id", 1, "rn", "n").collect()}
    order = {r.id: r.h for r in d.select("id", hkey(1, "id").alias("h")).collect()}
    for b in range(3):
        own = sorted((i for i in order if i % 3 == b), key=lambda i: (order[i], i))
        assert [got[i] for i in own] == [(k + 1, len(own)) for k in range(len(own))]


@pytest.mark.parametrize("few", [10, 100_000])
def test_places_are_exact_however_often_the_bracket_is_narrowed(spark, monkeypatch, few):
    monkeypatch.setattr(ranking, "FEW", few)
    for values in ([(i * 7919) % 10_007 for i in range(9000)], [5] * 3000 + [*range(3000)], [1.5, None, 1.5], list(range(40))):
        d = spark.createDataFrame([(v,) for v in values], "v double" if 1.5 in values else "v long")
        own = sorted(v for v in values if v is not None)
        r = ranking.nearest_rank(d, "v", {"a": 0.0, "b": 1 / 3, "c": 0.8, "d": 1.0}).first()
        assert tuple(r) == tuple(own[min(len(own) - 1, int(s * len(own) + 1e-9))] for s in (0.0, 1 / 3, 0.8, 1.0))


def test_capped_greedy_against_a_loop_over_all_rows(spark):
    d = _rows(spark, 3000)
    rows = sorted(d.collect(), key=lambda r: (-r.score, r.id))
    for n, page_cap, template_cap in ((40, 2, 14), (12, 1, 5), (7, 3, 2)):
        got = {r.id for r in sampling.capped_greedy(d, "b", [("score", False), ("id", True)], n, "page", page_cap, "tpl", template_cap, "ter", "id long, b string, page string, tpl string, ter int, score long").collect()}
        want = set()
        for b in "012":
            taken, pages, tpls, ters = [], {}, {}, {}
            for limit in (-(-n // 3), -(-n // 3) + 1, 10**9):
                for r in rows:
                    if r.b == b and r not in taken and len(taken) < n and pages.get(r.page, 0) < page_cap and tpls.get(r.tpl, 0) < template_cap and ters.get(r.ter, 0) < limit:
                        taken.append(r)
                        pages[r.page], tpls[r.tpl], ters[r.ter] = pages.get(r.page, 0) + 1, tpls.get(r.tpl, 0) + 1, ters.get(r.ter, 0) + 1
            want |= {r.id for r in taken}
        assert got == want


def test_longest_runs_of_parts_over_many_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["x", "y", None]), i, rng.choice(["a", "a", "b", None])) for i in range(500)] + [("z", 1000 + i, "c") for i in range(300)]
    d = spark.createDataFrame(rows, "p string, o long, k string").repartition(5)
    want = {}
    for p in {r[0] for r in rows}:
        best = n = 0
        last = object()
        for _, _, k in sorted((r for r in rows if r[0] == p), key=lambda r: r[1]):
            n, last = (n + 1 if k == last else 1), k
            best = max(best, n)
        want[p] = best
    assert {r.p: r.max_run for r in mixing.longest_runs(d, ["k"], "o", ["p"]).collect()} == want
    assert want["z"] == 300
