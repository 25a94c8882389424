import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curatrix.operators import quota, split


@pytest.mark.parametrize(
    ("mix", "n", "want"),
    [
        ([0.82, 0.18], 15000, [12300, 2700]),
        ([0.60, 0.25, 0.05, 0.05, 0.05], 20000, [12000, 5000, 1000, 1000, 1000]),
        ([0.40, 0.15, 0.15, 0.15, 0.15], 15000, [6000, 2250, 2250, 2250, 2250]),
        ([0.22, 0.08, 0.24, 0.24, 0.22], 16000, [3520, 1280, 3840, 3840, 3520]),
        ([0.60, 0.20, 0.05, 0.075, 0.075], 25000, [15000, 5000, 1250, 1875, 1875]),
        ([0.60, 0.15, 0.10, 0.075, 0.075], 25000, [15000, 3750, 2500, 1875, 1875]),
    ],
)
def test_quotas(spark, mix, n, want):
    keys = "abcde"
    assert list(quota.largest_remainder(dict(zip(keys, mix, strict=False)), n).values()) == want
    d = spark.createDataFrame(list(zip(keys, mix, strict=False)), "k string, share double")
    assert [r.quota for r in quota.quotas(d, "share", "k", n).orderBy("k").collect()] == want


@given(st.lists(st.floats(0.01, 1), min_size=1, max_size=7), st.integers(0, 1000))
def test_quotas_add_up(shares, n):
    got = quota.largest_remainder(dict(enumerate(shares)), n)
    total = sum(shares)
    assert sum(got.values()) == n
    assert all(abs(got[i] - s / total * n) < 1 + 1e-6 for i, s in enumerate(shares))


def test_bad_shares():
    with pytest.raises(ValueError):
        quota.largest_remainder({"a": 0.0}, 3)


@pytest.mark.parametrize(("n", "want"), [(15000, (13500, 750, 750)), (1526, (1374, 76, 76)), (3, (1, 1, 1)), (2, (2, 0, 0)), (0, (0, 0, 0))])
def test_split_counts(spark, n, want):
    assert quota.split_counts(n, 0.9, 0.05) == want
    a, b = quota.split_count_columns(F.lit(n), 0.9, 0.05)
    r = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert (r.a, r.b - r.a, n - r.b) == want


def test_small_split_has_all_parts():
    a, b, c = quota.split_counts(750, 0.9, 0.05)
    assert a + b + c == 750 and b >= 1 and c >= 1


def test_splits_are_whole_and_repeat(spark):
    d = spark.range(500).selectExpr("id", "id % 3 AS s")
    for how in (split.stratified, split.truncated):
        a = how(d, ["s"], "id", 0.8, 0.1, 1)
        b = how(d.repartition(7), ["s"], "id", 0.8, 0.1, 1)
        assert a.count() == 500 and a.exceptAll(b.select(a.columns)).count() == 0
        n = {r.split: r["count"] for r in a.groupBy("split").count().collect()}
        assert n["train"] >= 396 and n["val"] >= 48 and n["test"] >= 48
    assert split.stratified(d.limit(0), ["s"], "id", 0.8, 0.1, 1).count() == 0
