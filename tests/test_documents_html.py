from collections import Counter

from pyspark.sql import functions as F

from curatrix.functions import geometry as G
from curatrix.functions import html as H
from curatrix.operators import documents, mixing, pairs, units


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def box(*v):
    return G.box(*map(F.lit, v))


def test_edits(spark):
    page = F.lit("<html><head></head><body><p>$$x$$</p></body></html>")
    assert one(spark, H.with_math(page, "<m>")) == "<html><head><m></head><body><p>$$x$$</p></body></html>"
    assert one(spark, H.with_paragraphs(page, F.array(F.lit("a<b"), F.lit("c")))).endswith("<p>a&lt;b</p><p>c</p></body></html>")
    assert "margin:0 24px" in one(spark, H.with_occupancy(page, F.lit("dense"))) and one(spark, H.with_occupancy(page, F.lit("odd"))) == one(spark, page)
    assert '<body><div class="window" data-shell="edge">' in one(spark, H.framed(page, F.lit("edge"))) and one(spark, H.framed(page, F.lit("none"))) == one(spark, page)
    v = one(spark, H.viewport(F.lit('<html data-viewport="800x600" data-capture="full">')))
    assert tuple(v) == (800, 600, True) and tuple(one(spark, H.viewport(F.lit("x")))) == (None, None, None)
    c = one(spark, H.canvas(F.lit("<style>body{background:red;color:#111} .body{color:x} body { color: blue }</style>")))
    assert tuple(c) == ("red", "blue")


def test_groups(spark):
    html = '<section data-semantic-group="g1" data-group-kind="card"><h3 data-block-id="b1" data-group-role="seed">Head<span class="kind">tag</span></h3><div data-semantic-group="g2"><p data-block-id="b2">inner</p></div><p data-block-id="b3">Body</p></section><p data-block-id="b4">alone</p>'
    d = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    g = {r.group_id: r for r in documents.group_texts(documents.groups(d)).collect()}
    assert g["g1"].member_ids == ["b1", "b3"] and g["g1"].seed_ids == ["b1"] and g["g1"].markdown == "### Head\n\nBody" and g["g2"].member_ids == ["b2"]
    u = {r.id: r.unit_text for r in documents.unit_targets(documents.blocks(d), documents.group_texts(documents.groups(d))).collect()}
    assert u["b3"] == "### Head\n\nBody" and u["b4"] == "alone"


def test_points(spark):
    pages = spark.createDataFrame([("p", 400.0, 300.0), ("q", 100.0, 100.0)], "page_id string, w double, h double")
    boxes = spark.createDataFrame([("p", "a")], "page_id string, id string").withColumn("b", box(50, 50, 200, 250))
    got = units.empty_points(pages, boxes, 3, 10.0, 1).collect()
    assert Counter(r.page_id for r in got) == {"p": 3, "q": 3}
    assert all(not (40 < r.x < 210 and 40 < r.y < 260) for r in got if r.page_id == "p")
    bands = spark.createDataFrame([("p", "head"), ("p", "thin")], "page_id string, band string").withColumn("b", F.when(F.col("band") == "head", box(0, 0, 400, 30)).otherwise(box(0, 0, 400, 5)))
    assert all(r.band == "head" and r.y <= 30 for r in units.band_points(bands, 5, 1).collect())
    two = spark.createDataFrame([("p", "a"), ("p", "b")], "page_id string, id string").withColumn("b", F.when(F.col("id") == "a", box(80, 80, 280, 420)).otherwise(box(310, 80, 510, 420)))
    p = units.gap_points(units.boundary_pairs(two), 1).first()
    assert 280 <= p.x <= 310 and 80 <= p.y <= 420
    rows = units.point_rows(units.sampled_points(two, 2, 1), two.withColumn("markdown", F.lit("t")), 600, 500).collect()
    assert len(rows) == 4 and all(len(r.point_norm) == 2 and not r.is_negative for r in rows)


def test_fragments(spark):
    d = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c")], "page_id string, id string")
    d = d.withColumn("b", F.when(F.col("id") == "a", box(0, 0, 100, 10)).when(F.col("id") == "b", box(0, 15, 100, 25)).otherwise(box(0, 200, 100, 210)))
    assert {r.id: r.fragment for r in units.fragments(d).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_orders_and_slots(spark):
    d = spark.range(20).selectExpr("id", "id AS pos", "id % 4 AS s")
    w = [r.id // 5 for r in mixing.windowed(d, "pos", "id", 5, 1).orderBy("ord").collect()]
    assert w == sorted(w)
    assert Counter(r.s for r in mixing.unseen_rounds(d, ["s"], "id", 1, 8).collect()) == {0: 2, 1: 2, 2: 2, 3: 2}
    texts = spark.range(6).selectExpr("concat('t', id) AS en", "'z' AS zh", "'b' AS bucket")
    slots = spark.range(10).selectExpr("concat('p', id % 2) AS page_id", "id AS slot", "'b' AS bucket")
    got = pairs.picked(slots, texts, 1).collect()
    assert len(got) == 10 and all(len({r.en for r in got if r.page_id == p}) == 5 for p in ("p0", "p1"))
