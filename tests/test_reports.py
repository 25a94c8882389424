import pytest
from pyspark.sql import functions as F

from curatrix.operators import metrics, probe, ranking

SCHEMA = "target string, prediction string, prediction_raw string, is_negative boolean"


def test_report_golden(spark):
    d = spark.createDataFrame([("hit me", "hit me", None, False), ("x", "y" * 1000, None, False), ("", "", None, True), ("", "oops", None, True)], SCHEMA)
    r = metrics.report(d).first()
    assert (r.n, r.n_pos, r.n_neg, r.block_hit_rate, r.empty_rate, r.leak_rate) == (4, 2, 2, 0.5, 0.5, 0.0) and r.over_rate > 0
    none = metrics.report(d.filter("false")).first()
    assert none.n == 0 and none.block_hit_rate == 0 and none.mean_edit_similarity == 0


def test_two_tag_report_golden(spark):
    good = "<source>\nHello\n</source>\n<translation>\n你好\n</translation>"
    half = "<source>\nOther words\n</source>\n<translation>\n你好\n</translation>"
    shell = "<source></source><translation></translation>"
    rows = [(good, good, False, 1.0), (good, half, False, 1.0), ("", "", True, 0.0), ("", shell, True, 0.0), ("", "<source>", True, 0.0), ("", "<source>made up</source><translation></translation>", True, 0.0)]
    r = metrics.two_tag_report(spark.createDataFrame(rows, "target string, prediction string, is_negative boolean, score double")).first()
    assert (r.n_pos, r.n_neg, r.pair_rate, r.source_hit_rate, r.both_hit_rate) == (2, 4, 1.0, 0.5, 0.5)
    assert (r.strict_empty_rate, r.effective_empty_rate, r.broken_empty_rate, r.hallucination_rate) == (0.25, 0.75, 0.5, 0.25)


def test_grouping_sets_are_one_scan(spark):
    d = spark.createDataFrame([("a", "a", None, False), ("b", "", None, False)], SCHEMA).withColumn("k", F.lit("x"))
    got = metrics.report_sets(d, [[], ["k"]])
    assert got.count() == 2 and got._jdf.queryExecution().optimizedPlan().toString().count("Expand") == 1


def test_probe_gate(spark):
    def group(k, n_good, neg=False):
        gt = "" if neg else "the target text"
        return [(k, "the target text" if i < n_good else "wrong", gt, neg) for i in range(8)]

    d = spark.createDataFrame(group("half", 4) + group("all", 8) + group("none", 0) + group("neg", 0, True) + group("one", 1), "sample_id string, completion string, target string, is_negative boolean")
    s = probe.scored(d)
    assert {r.sample_id for r in s.filter(probe.selectable()).collect()} == {"half", "one"}
    one = s.filter("sample_id = 'one'").first()
    assert one.reward_max == pytest.approx(1.0) and one.reward_std > 0.10 and s.filter(probe.selectable(least_max=0.95)).count() == 2
    v = {r.sample_id: r.verdict for r in s.collect()}
    assert v["half"] == "signal" and v["all"] == "saturated" and v["none"] == "collapsed"


def test_nearest_rank(spark):
    d = spark.createDataFrame([(x,) for x in [5, 1, 4, 2, 3, None]], "v int")
    r = ranking.nearest_rank(d, "v", {"p0": 0.0, "mid": 0.5, "p80": 0.8}).first()
    assert (r.p0, r.mid, r.p80) == (1, 3, 5)
    assert ranking.nearest_rank(d.filter("false"), "v", {"p": 0.5}).first().p is None
    big = spark.range(30_000).selectExpr("cast(pow(id % 7001, 1.5) as double) AS v")
    want = sorted(r.v for r in big.collect())
    r = ranking.nearest_rank(big, "v", {"a": 0.1, "b": 0.5, "c": 0.999}).first()
    assert [r.a, r.b, r.c] == [want[3000], want[15000], want[29970]]


def test_ranks_by_slices(spark):
    d = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE 'x' END AS g")
    got = ranking.hash_rank(d, ["g"], "id", 5, "rn", "n").collect()
    for g in (None, "x"):
        own = [r for r in got if r.g == g]
        assert sorted(r.rn for r in own) == list(range(1, len(own) + 1)) and {r.n for r in own} == {len(own)}
    assert ranking.hash_rank(d.limit(0), [], "id", 5).count() == 0


def test_pending_and_agreement(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, None)], "k int, v string")
    assert probe.pending(a, b.filter("k < 3"), "k").count() == 1
    assert tuple(probe.agreement(a, b, "k", "v").first()) == (3, 2)
