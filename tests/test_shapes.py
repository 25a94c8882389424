import pytest
from pyspark.sql import functions as F

from curatrix.functions import geometry as G
from curatrix.operators import documents, negatives, units


def box(*v):
    return G.box(*map(F.lit, v))


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_gaps_and_strips(spark):
    gap = lambda a, b: one(spark, G.facing_gap(box(*a), box(*b)))
    assert gap((0, 0, 10, 10), (0, 30, 10, 40)) == 20 and gap((0, 0, 10, 10), (25, 0, 40, 10)) == 15
    assert gap((0, 0, 10, 10), (5, 5, 15, 15)) == 0 and gap((0, 0, 10, 10), (20, 20, 30, 30)) is None
    s = one(spark, G.gap_strip(box(0, 0, 10, 10), box(0, 30, 10, 40)))
    assert tuple(s) == (0, 10, 10, 30)


def test_edges_of_boxes(spark):
    b = box(0, 0, 10, 10)
    assert not one(spark, G.contains(b, F.lit(10.0), F.lit(5.0))) and one(spark, G.inside(b, F.lit(10.0), F.lit(5.0)))
    assert one(spark, G.distance_outside(F.lit(13.0), F.lit(14.0), F.array(b))) == 5
    assert one(spark, G.distance_outside(F.lit(1.0), F.lit(1.0), F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))) == float("inf")
    assert tuple(one(spark, G.inner_area(box(0, 0, 1, 1)))) == (0, 0, 1, 1)


def test_occupancy_is_of_the_union(spark):
    r = F.array(box(0, 0, 100, 100), box(50, 0, 150, 100))
    assert 0.70 <= one(spark, G.occupied_share(r, F.lit(200.0), F.lit(100.0))) <= 0.80


def test_resize(spark):
    r = one(spark, G.smart_resize(F.lit(1000.0), F.lit(2000.0), 200704, 1003520))
    assert r.h % 28 == 0 and r.w % 28 == 0 and r.h * r.w <= 1003520
    assert one(spark, G.smart_resize(F.lit(1.0), F.lit(2000.0), 200704, 1003520)) is None
    assert one(spark, G.pixel_to_norm(F.lit(1000.0), F.lit(1000.0))) == 999 and one(spark, G.pixel_to_pct(F.lit(1000.0), F.lit(1000.0))) == 99.9


def test_sampled_points_stay_inside(spark):
    d = spark.createDataFrame([("p", "a")], "page_id string, id string").withColumn("b", box(80, 80, 280, 420))
    p = units.sampled_points(d, 40, 1).collect()
    assert len(p) == 40 and all(80 < r.x < 280 and 80 < r.y < 420 for r in p) and len({r.region for r in p}) >= 3


def test_short_clusters(spark):
    rows = [("p", "h2b", "h2", "Head", 40.0, 40.0, 220.0, 64.0), ("p", "li1", "li", "one", 40.0, 72.0, 320.0, 94.0), ("p", "li2", "li", "two", 40.0, 102.0, 320.0, 124.0), ("p", "para", "p", "long " * 60, 40.0, 148.0, 420.0, 520.0)]
    got = units.clusters(spark.createDataFrame(rows, "page_id string, id string, tag string, markdown string, x0 double, y0 double, x1 double, y1 double")).collect()
    assert {r.id for r in got} == {"h2b", "li1", "li2"}


def test_boundary_pairs(spark):
    d = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "c")], "page_id string, id string")
    d = d.withColumn("b", F.when(F.col("id") == "a", box(80, 80, 280, 420)).otherwise(box(310, 80, 510, 420)))
    assert [(r.i, r.j, r.gap) for r in units.boundary_pairs(d).collect()] == [("a", "b", 30.0)]


@pytest.mark.parametrize(
    ("region", "x", "y", "special", "neg", "want"),
    [("neg_clear", 50, 150, None, True, (True, "clear_on_ink", None)), ("neg_clear", 500, 10, None, True, (False, "clear_on_chrome", "chrome_head")), ("neg_clear", 500, 500, None, True, (False, "", None)), ("chrome_head", 500, 500, None, True, (True, "chrome_mislabel", None)), ("special_table", 1, 1, "gone", True, (True, "special_block_missing", None)), ("special_table", 1, 1, "long", True, (True, "special_prose", None)), ("special_table", 1, 1, "b", True, (False, "", None)), ("neg_clear", 50, 150, None, False, (False, "", None))],
)
def test_negative_rules(spark, region, x, y, special, neg, want):
    rects = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    blocks = spark.createDataFrame([("pool", "p", "b", "short"), ("pool", "p", "long", "w " * 20)], "pool_id string, page_id string, id string, markdown string").withColumn("bbox", box(0, 100, 200, 200)).withColumn("rects", F.array().cast(rects))
    bands = spark.createDataFrame([("pool", "p", 0, "head")], "pool_id string, page_id string, pos int, band string").withColumn("bbox", box(0, 0, 1000, 40))
    s = spark.createDataFrame([("s", "pool", "p", region, neg, "" if neg else "t", special)], "sample_id string, pool_id string, page_id string, region string, is_negative boolean, target string, special_block_id string")
    s = s.withColumn("point", F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))).withColumn("device_scale_factor", F.lit(None).cast("double"))
    assert tuple(negatives.with_geometry(s, blocks, bands).select(negatives.verdict().alias("v")).first().v) == want


def test_blocks_of_pages(spark):
    html = "<html><head><title>no</title><style>p{}</style></head><body><h1>Top  one</h1><p>Para<br>two &amp; three</p><ul><li>a<li>b</ul><pre>x\n y</pre><script>no()</script></body></html>"
    got = [(b["tag"], b["markdown"]) for b in documents.blocks_of(html)]
    assert got == [("h1", "# Top one"), ("p", "Para two & three"), ("li", "- a"), ("li", "- b"), ("pre", "```\nx\n y\n```")]
    named = documents.blocks_of('<p>skip</p><div data-block-id="k1" data-translation="t">kept</div>')
    assert [(b["id"], b["markdown"], b["translation"]) for b in named] == [("k1", "kept", "t")]
    assert documents.blocks_of(None) == [] and documents.blocks_of("<p>open") == [{"pos": 0, "id": "b0", "tag": "p", "markdown": "open", "translation": None, "domain": None}]
    d = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    assert documents.with_targets(documents.blocks(d)).filter("page_id = 1").count() == 5
    t = d.select(documents.tables(F.lit('<p>x</p><table class="c" data-x="1"><tr> <td colspan="2">a  b</td></tr></table>')).alias("t")).first().t
    assert t == ['<table><tr><td colspan="2">a b</td></tr></table>']


def test_groups_need_all_members(spark):
    d = spark.createDataFrame([("p", "g", 1, "b", True), ("p", "g", 0, "a", True), ("p", "h", 0, "x", False), ("p", "h", 1, "y", True)], "page_id string, group_id string, pos int, markdown string, in_frame boolean").withColumn("b", box(0, 0, 1, 1))
    assert [(r.group_id, r.markdown) for r in units.groups_in_frame(d).collect()] == [("g", "a\n\nb")]
