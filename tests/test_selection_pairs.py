import json
from collections import Counter

from pyspark.sql import functions as F

from curatrix.functions import classify as C
from curatrix.functions import keys as K
from curatrix.functions import viewport as V
from curatrix.operators import annotations, pairs, selection


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_mix_with_fill(spark):
    d = spark.range(40).selectExpr("id", "CASE WHEN id < 4 THEN 'a' ELSE 'b' END AS k")
    got = Counter(r.k for r in selection.mixed_with_fill(d, "k", {"a": 0.5, "b": 0.5}, 20, "id", 1).collect())
    assert got == {"a": 4, "b": 16}
    got = selection.all_real_first(d, F.col("id") % 10 == 0, "k", {"a": 0.5, "b": 0.5}, 10, "id", 1).collect()
    assert len(got) == 10 and {0, 10, 20, 30} <= {r.id for r in got}
    assert Counter(r.k for r in selection.proportional_to_supply(d, "k", 10, "id", 1).collect()) == {"a": 1, "b": 9}
    assert selection.expanded_rounds(d, 95, "id").count() == 95


def test_gallery(spark):
    rows = [("p1", "core_inner", "t1", "none"), ("p0", "other", "t1", "none"), ("p2", "core_inner", "t1", "chrome"), ("p3", "core_inner", "t2", "none"), ("p4", "rare", "t2", "none"), ("p1", "core_inner", "t1", "none")]
    d = spark.createDataFrame(rows, "page_id string, pool_id string, template_stem string, chrome string")
    assert [r.page_id for r in selection.gallery_pages(d, 9).collect()] == ["p1", "p3", "p2", "p0", "p4"]
    assert [r.page_id for r in selection.gallery_pages(d, 2).collect()] == ["p1", "p3"]


def test_desktop_blocks(spark):
    rect = "array(struct(0D AS x0, 0D AS y0, cast(%s AS double) AS x1, 1D AS y1))"
    d = spark.createDataFrame([(i, i < 4, None if i else 0.5) for i in range(8)], "id int, window_focused boolean, visible_frac double").withColumn("page_id", F.lit("p")).withColumn("rects", F.expr(rect % "id + 1"))
    assert {r.id for r in selection.desktop_blocks(d, 3).collect()} == {3, 2, 7}


def test_core_points(spark):
    d = spark.createDataFrame([("p", "a", 1, "nw"), ("p", "a", 2, "se"), ("p", "a", 3, "diamond"), ("p", "b", 1, "nw"), ("p", "b", 2, "ne"), ("p", "b", 3, "sw")], "page_id string, id string, k int, region string")
    assert {(r.id, r.k) for r in selection.core_points(d).collect()} == {("a", 1), ("a", 3), ("b", 1), ("b", 2)}


def test_pairs_end_to_end(spark):
    raw = [json.dumps({"translation": {"en": "Hello big world", "zh": "你好大世界你好"}}), json.dumps({"source": "你好大世界再见", "target": "Goodbye <b>big</b> world"}), json.dumps({"en": "hello  BIG world", "zh": "你好大世界你好"}), json.dumps({"en": "no"})]
    d = pairs.extracted(spark.createDataFrame([(r, i) for i, r in enumerate(raw)], "raw string, line int"), "raw").withColumns({"domain": F.lit("d"), "source": F.lit("s"), "source_pos": F.lit(0)})
    got = sorted((r.en, r.zh, r.bucket) for r in pairs.harvested(d, 10).collect())
    assert got == [("Goodbye big world", "你好大世界再见", "headings"), ("Hello big world", "你好大世界你好", "headings")]
    assert pairs.harvested(d, 1).count() == 1 and pairs.summary(pairs.harvested(d, 9)).count() == 3
    assert sorted(r.page for r in pairs.allotted(pairs.harvested(d, 9), 1, 1).collect()) == [0, 1]
    item = lambda s: one(spark, pairs.normalized_item(F.lit(s)))
    assert item("text").en == "text" and item('{"source_text": "a", "translation": "b"}').zh == "b" and item("  ") is None


def test_annotations(spark):
    boxes = [([50, 60, 10, 20], "second", False, "u"), ([0, 0, 30, 10], "first", False, "u"), ([0, 0, 2, 2], "tiny", False, "v"), ([-5, 5, 900, 40], "hand", True, None)]
    d = spark.createDataFrame([("s.png", [100, 80], boxes)], "source_path string, image_wh array<int>, boxes array<struct<bbox:array<int>,text:string,manual:boolean,unit_id:string>>")
    got = {r.unit_id: r for r in annotations.units(d).collect()}
    assert got["u"].text == "first\n\nsecond" and got["u"].multi and got["u"].boxes == [[0, 0, 30, 10], [10, 20, 50, 60]]
    assert got["box3"].manual and got["box3"].boxes == [[0, 5, 100, 40]] and "v" not in got
    assert tuple(annotations.unit_stats(annotations.units(d)).first()) == (2, 0, 1, 1)


def test_slots_and_words(spark):
    s = lambda t, b, n: one(spark, C.slot_bucket(F.lit(t), F.lit(b), F.lit(n)))
    assert [s("h2", "x", 9), s("td", "x", 9), s("pre", "x", 99), s("li", "x", 20), s("li", "x", 90), s("span", "x", 90), s("p", "x", 90), s("p", "cmd1", 90)] == ["headings", "cells", "code_lines", "list_items", "paragraphs", "captions", "paragraphs", "code_lines"]
    assert one(spark, C.is_furniture(F.lit("This  Website uses cookies."))) and not one(spark, C.is_furniture(F.lit("plain")))
    assert one(spark, C.within_target(F.lit("some longer words"), F.lit("x some  longer WORDS y"))) and not one(spark, C.within_target(F.lit("short"), F.lit("short")))
    assert one(spark, C.is_desktop_shell(F.lit("23_ide_x"))) and one(spark, C.explicit_group(F.lit("None"))) is None
    p = spark.createDataFrame([('"plain"',), ('{"type":"text","text":"obj"}',), ('[{"text":"a"},{"content":"b"}]',), ("bare",)], "j string")
    assert [r.x for r in p.select(C.polymorphic_text("j").alias("x")).collect()] == ["plain", "obj", "ab", "bare"]
    assert one(spark, C.quadrant_color(F.lit(10.0), F.lit(10.0), True, ("r", "g", "b", "y"))) == "b"


def test_windows(spark):
    d = spark.range(300).select(V.sampled_window(1, {"16:9": 3, "4:3": 1}, 3e5, 2e6, "id").alias("w"), V.jittered_preset(1, [(1280, 720), (800, 600)], "id").alias("p"), V.sampled_dpr(2, {"1.0": 3, "2.0": 1}, "id").alias("d"), K.hint_between(3, 1, 4, "id").alias("k"))
    rows = d.collect()
    assert all(r.w.w % 8 == 0 and 2.5e5 < r.w.w * r.w.h < 2.2e6 and r.p.w % 8 == 0 for r in rows)
    assert 190 < sum(r.d == 1.0 for r in rows) < 260 and {r.k for r in rows} == {1, 2, 3, 4}
    assert tuple(one(spark, V.insets(*map(F.lit, (500, -3, 500, 10)), F.lit(600), F.lit(100)))) == (500, 0, 36, 10)
    assert tuple(one(spark, V.crop(F.lit(10.0), F.lit(95.0), F.lit(200.0), F.lit(100.0), 50))) == (0.0, 50.0, 10.0, 45.0)
    assert one(spark, V.pixel_prompt("at {x},{y}", F.lit(200.4), F.lit(-1.0), F.lit(200.0), F.lit(100.0))) == "at 199,0"
    c = one(spark, V.clamp_pixels(F.lit(4000), F.lit(2000), F.lit(2.0), 8e6))
    assert c.w * c.h * 4 <= 8e6 and tuple(one(spark, V.fit_aspect(F.lit(100), F.lit(1000)))) == (100.0, 100 / 0.75)
