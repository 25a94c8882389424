"""Records, slots, mixes, pages and files against brute force."""

import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from curatrix import __main__ as cli
from curatrix.functions import geometry as G
from curatrix.functions import records as R
from curatrix.functions.keys import hkey
from curatrix.operators import documents, mixing, pages, pairs, selection
from curatrix.queries import QUERIES
from curatrix.sources import samples as S

SF = "/root/testdata/sf0.001"


def test_texts_of_completions_however_deep():
    deep = "x"
    for _ in range(3000):
        deep = [deep]
    cases = [(None, ""), ("a", "a"), ({"type": "text", "text": "b"}, "b"), ({"content": [{"type": "text", "text": "c"}, {"text": "d"}, 5]}, "cd5"), ([["a", ["b"]], None, "c"], "abc"), ({"role": "x"}, ""), (deep, "x"), ({"type": "text", "content": "no"}, "")]
    for x, want in cases:
        assert R.text_of(x) == want


def test_records(spark):
    d = spark.createDataFrame([(["a", "b"], ["c"])], "a array<string>, b array<string>")
    with pytest.raises(Exception, match="different lengths"):
        d.select(R.zipped(F.col("a"), F.col("b"))).collect()
    with pytest.raises(Exception, match="no such file"):
        d.select(R.first_of_candidates(F.lit("x"), known=F.col("b"))).collect()
    assert R.prompt_for({"A": "read", "B": "look"}, {"a1": "A"}, "B", " a1 ") == "read" and R.prompt_for({"B": "look"}, {}, "B") == "look"
    with pytest.raises(KeyError):
        R.prompt_for({"A": "read"}, {}, "B")


def taken(rows, pages_, per_page):
    """By page and bucket: the English texts, and which round they are of."""
    out = {}
    for r in rows:
        out.setdefault((r.bucket, r.page), []).append((r.place, r.en, r.round))
    return out


def test_pairs_for_pages(spark):
    rows = [("p", f"para {i}", f"z{i}", "d", "s") for i in range(10)] + [("h", f"head {i}", "", "d", "s") for i in range(3)]
    d = spark.createDataFrame(rows, "bucket string, en string, zh string, domain string, source string")
    got = taken(pairs.taken_pages(d, 7, 4, 5).collect(), 7, 4)
    assert [len(got["p", k]) for k in range(7)] == [4, 4, 2, 4, 4, 2, 4]  # what is left goes to the last page of a round
    assert [len(got["h", k]) for k in range(7)] == [3] * 7
    for first in (0, 3):
        assert sorted(x[1] for k in range(first, first + 3) for x in got["p", k]) == sorted(r[1] for r in rows[:10])
    assert [x[1] for x in sorted(got["p", 0])] != [x[1] for x in sorted(got["p", 3])]


def test_slots_are_filled_without_repeats(spark):
    p = spark.createDataFrame([(0, "headings", 0, "One"), (0, "headings", 1, " one "), (0, "paragraphs", 0, "Two"), (0, "cells", 0, "Three"), (1, "cells", 0, "One")], "page long, bucket string, place int, en string").selectExpr("*", "'z' zh", "'d' domain", "'s' source")
    s = spark.createDataFrame([(0, i, "headings") for i in range(5)] + [(1, 9, "cells"), (2, 7, "headings")], "page long, slot long, bucket string")
    got = {(r.page, r.slot): (r.en, r.domain) for r in pairs.filled_slots(s, p).collect()}
    assert got == {(0, 0): ("One", "d"), (0, 1): ("Two", "d"), (0, 2): ("Three", "d"), (0, 3): ("Filler text 4 of this page.", "fallback"), (0, 4): ("Filler text 5 of this page.", "fallback"), (1, 9): ("One", "d"), (2, 7): ("Filler text 1 of this page.", "fallback")}
    b = spark.createDataFrame([(0, 0, "old", "text"), (0, 1, "x^2", "formula")], "page long, slot long, markdown string, kind string")
    f = spark.createDataFrame([(0, 0, "One", "z", "d"), (0, 1, "Two", "z", "d")], "page long, slot long, en string, zh string, domain string")
    assert {r.slot: (r.markdown, r.translation) for r in pairs.applied(b, f, F.col("kind") == "formula").collect()} == {0: ("One", "z"), 1: ("x^2", None)}


def test_no_text_comes_twice_on_a_page_of_the_query(spark):
    rows = QUERIES["filled_slots"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/part.parquet").count()
    assert all(n == 1 for n in Counter((r.page, r.en) for r in rows).values())


def test_scene_mix_by_the_rule(spark):
    d = spark.range(400).select(F.col("id").cast("string").alias("k"), (F.col("id") % 30).cast("string").alias("page"), F.when(F.col("id") % 10 == 0, "empty").when(F.col("id") % 10 < 7, "multi").when(F.col("id") % 10 == 7, "group").alias("scene"), F.when(F.col("id") % 20 == 0, "e1").otherwise("e2").alias("pool"), (F.col("id") % 40 == 1).alias("real"))
    rows = {r.k: r for r in d.collect()}
    mix = {"empty": 0.3, "multi": 0.4, "group": 0.3}

    def count(got):
        keys = [r.k for r in got]
        assert len(set(keys)) == len(keys) and all(rows[k].scene for k in keys)
        return Counter(rows[k].scene for k in keys)

    plain = selection.scene_mix(d, "scene", mix, 100, "page", "k", 3).collect()
    assert count(plain) == {"empty": 30, "multi": 40, "group": 30}
    by_pool = selection.scene_mix(d, "scene", mix, 100, "page", "k", 3, "pool", {"e1": 0.8, "e2": 0.2}).collect()
    # 24 of e1 and 6 of e2 are asked for; e1 has 20, so e2 makes up for four
    assert Counter(rows[r.k].pool for r in by_pool if rows[r.k].scene == "empty") == {"e1": 20, "e2": 10}
    short = count(selection.scene_mix(d, "scene", mix, 300, "page", "k", 3).collect())
    assert sum(short.values()) == 300 and short["empty"] == 40 and short["group"] == 40 and short["multi"] == 220
    real = selection.scene_mix(d, "scene", mix, 100, "page", "k", 3, real=F.col("real")).collect()
    assert len(real) == 100 and {k for k, r in rows.items() if r.real and r.scene} <= {r.k for r in real}
    only = selection.scene_mix(d, "scene", mix, 4, "page", "k", 3, real=F.col("real")).collect()
    assert len(only) == 4 and all(rows[r.k].real for r in only)
    first = {r.k for r in selection.scene_mix(d.filter("scene = 'multi'"), "scene", {"multi": 1.0}, 18, "page", "k", 3).collect()}
    assert len({rows[k].page for k in first}) == 18


def test_train_and_val_under_their_own_seeds(spark):
    d = spark.range(50).select(F.col("id").cast("string").alias("k"))
    got = selection.composed_split(d, d, lambda x, s: x.orderBy(hkey(s, "k")).limit(10), "k", 7).collect()
    order = lambda s: sorted(range(50), key=lambda i: hashlib.md5(f"{s}|{i}".encode()).hexdigest())[:10]
    assert {r.k for r in got if r.split == "train"} == set(map(str, order(7))) and {r.k for r in got if r.split == "val"} == set(map(str, order(8)))


def test_positions_and_overlapping_windows(spark):
    d = spark.range(500).select(F.col("id").alias("k"), ((F.col("id") * 7919) % 503).alias("o")).repartition(7)
    got = {r.k: r.position for r in mixing.positions(d, "o", "k").collect()}
    assert sorted(got, key=got.get) == sorted(range(500), key=lambda i: (i * 7919 % 503, i)) and sorted(got.values()) == list(range(500))
    for n, w in ((500, 20), (7, 8), (33, 5)):
        x = {r.k: r.ord for r in mixing.overlapping(spark.range(n).withColumnRenamed("id", "k"), "k", "k", w, 3).collect()}
        assert sorted(x.values()) == list(range(n)) and all(abs(k - p) < 2 * w for k, p in x.items())
        assert n < 10 or any(k // w != p // w for k, p in x.items())  # rows leave their first windows


def page_input(spark):
    box = lambda x0, y0, x1, y1: (float(x0), float(y0), float(x1), float(y1))
    text = "a block of text that is long enough to be asked for"
    blocks = [(1, 1, box(10, 60, 400, 160), [box(10, 60, 400, 160)], "p", "text", text), (1, 2, box(10, 180, 400, 300), [box(10, 180, 400, 300)], "p", "text", text), (1, 3, box(10, 320, 400, 420), [box(10, 320, 200, 420), box(210, 320, 400, 420)], "p", "text", text), (1, 4, box(500, 60, 700, 200), [box(500, 60, 700, 200)], "table", "table", text), (1, 5, box(500, 210, 790, 590), [box(500, 210, 790, 590)], "p", "text", text), (1, 6, box(700, 60, 900, 160), [box(700, 60, 900, 160)], "p", "text", text)]
    kind = "struct<x0: double, y0: double, x1: double, y1: double>"
    b = spark.createDataFrame(blocks, f"page_id long, id long, b {kind}, rects array<{kind}>, tag string, kind string, markdown string").withColumns({"visible_frac": F.lit(None).cast("double"), "in_viewport_frac": F.lit(None).cast("double")})
    p = spark.createDataFrame([(1, 800.0, 600.0)], "page_id long, w double, h double")
    bands = spark.createDataFrame([(1, "head", box(0, 0, 800, 40))], f"page_id long, band string, b {kind}")
    groups = spark.createDataFrame([(1, "g", 1, 0), (1, "g", 2, 1), (1, "out", 6, 0)], "page_id long, group_id string, id long, pos int")
    return p, b, bands, spark.createDataFrame([(1, 2)], "page_id long, id long"), groups, blocks


def test_pages_to_samples(spark):
    p, b, bands, clustered, groups, blocks = page_input(spark)
    rows = pages.samples(p, b, bands, clustered, groups, 9).collect()
    by = {}
    for r in rows:
        by.setdefault(r.pool_id, []).append(r)
    boxes = {x[1]: x[2] for x in blocks}
    inside = lambda r, i: boxes[i][0] <= r.x < boxes[i][2] and boxes[i][1] <= r.y < boxes[i][3]
    free = lambda r: not any(inside(r, i) for i in boxes)
    assert len({r.sample_id for r in rows}) == len(rows) and all(r.point_norm == [min(999, int(r.x / 800 * 1000)), min(999, int(r.y / 600 * 1000))] for r in rows)
    assert Counter(r.block_id for r in by["core_inner"]) == {"1": 10, "3": 10, "5": 10}  # 2 is in a unit, 4 a table, 6 beyond the frame
    assert all(inside(r, int(r.block_id)) and not r.is_negative and r.target for r in by["core_inner"])
    assert Counter(r.block_id for r in by["multi_frag"]) == {"3": 10} and all(inside(r, 3) and not 200 < r.x < 210 for r in by["multi_frag"])
    assert len(by["empty_clear"]) == 5 and [r.region for r in by["empty_clear"]].count("neg_clear") == 4 and all(free(r) and r.is_negative and r.target == "" for r in by["empty_clear"])
    assert by["empty_boundary"] and all(free(r) and r.region == "neg_boundary" for r in by["empty_boundary"])
    assert [r.region for r in by["chrome_empty"]] == ["chrome_head"] * 2 and all(r.y < 40 for r in by["chrome_empty"])
    assert len(by["semantic_group"]) == 1 and by["semantic_group"][0].target == "\n\n".join([blocks[0][6]] * 2)  # the other group is not wholly in the frame
    assert {r.pool_id for r in pages.samples(p, b, bands, clustered, groups, 9, ("multi_frag",)).collect()} == {"multi_frag"}
    with pytest.raises(KeyError):
        pages.samples(p, b, bands, clustered, groups, 9, ("nothing",))
    k = spark.createDataFrame([(1, 1, i, r) for i, r in enumerate(["nw", "diamond", "diamond", "se"])], "page_id long, id long, k int, region string")
    assert pages.half_or_all(k, True).count() == 4 and {r.k for r in pages.half_or_all(k, False).collect()} == {0, 1}


HTML = """<body><p data-block-id="a">one</p><table class="x"><tr><td data-block-id="b" id="q">two</td></tr><tr><td><table><tr><td data-block-id="c">in</td></tr></table></td></tr></table>
<section data-semantic-group="g" data-group-kind="card"><h2 data-block-id="h" data-group-role="seed">Head</h2><p data-block-id="i">Body</p></section><figure data-block-id="f">pic</figure></body>"""


def test_tables_around_blocks_and_targets(spark):
    d = spark.createDataFrame([(1, HTML), (2, None), (3, "<p>plain</p>")], "page_id long, html string")
    found = {r.id: r.html for r in documents.enclosing_tables(d).collect()}
    whole = "<table><tr><td>two</td></tr><tr><td><table><tr><td>in</td></tr></table></td></tr></table>"
    assert found == {"b": whole, "c": whole}
    groups = documents.group_texts(documents.groups(d))
    got = {r.id: (r.kind, r.target) for r in documents.trained_targets(documents.blocks(d).filter("page_id = 1"), documents.enclosing_tables(d), groups, F.when(F.col("id") == "f", "image").otherwise("text")).collect()}
    assert got == {"a": ("text", "one"), "b": ("table", whole), "c": ("table", whole), "h": ("semantic_group", "## Head\n\nBody"), "i": ("semantic_group", "## Head\n\nBody"), "f": ("image", "")}


def test_table_functions_say_what_the_operators_say(spark):
    a = {(r.page_id, r.pos, r.id, r.tag, hashlib.md5(r.markdown.encode()).hexdigest()) for r in QUERIES["html_blocks"](spark, SF).collect()}
    assert {tuple(r) for r in QUERIES["parsed_by_sql"](spark, SF).collect()} == a
    spark.createDataFrame([(HTML,)], "html string").createOrReplaceTempView("one_page")
    assert [r.block_id for r in spark.sql("SELECT g.* FROM one_page, LATERAL parse_groups(html) g").collect()] == ["h", "i"]


def test_manifests_digests_and_counts(spark, tmp_path):
    d = spark.createDataFrame([(1, "a\n"), (2, None)], "k long, t string")
    S.write_manifest(d, f"{tmp_path}/m")
    text = "".join(f.read_text() for f in (tmp_path / "m").glob("part-*"))
    assert json.loads(text) == [{"k": 1, "t": "a\n"}, {"k": 2}]
    assert S.read_manifest(spark, f"{tmp_path}/m", "k long, t string").orderBy("k").collect() == d.orderBy("k").collect()
    (tmp_path / "f.bin").write_bytes(b"abc" * 1000)
    assert S.file_digests(spark, f"{tmp_path}/f.bin").first().sha256 == hashlib.sha256(b"abc" * 1000).hexdigest()
    assert {tuple(r) for r in S.write_counted(d.withColumn("split", F.lit("train")), f"{tmp_path}/c", ["split"]).collect()} == {("train", 2)}


def test_images_that_are_not_there_are_left_out(spark):
    one = [{"role": "user", "content": "<image>q"}]
    d = spark.createDataFrame([(1, one, ["a", "b", "c"]), (2, one, ["x"]), (3, one, [])], "k long, messages array<struct<role: string, content: string>>, images array<string>")
    there = spark.createDataFrame([("a", True), ("c", True), ("b", False)], "path string, present boolean")
    got = {r.k: [(p.type, p.image or p.text) for p in r.messages[0].content] for r in S.staged(d, there).collect()}
    assert got == {1: [("image", "a"), ("image", "c"), ("text", "q")], 2: [("text", "q")], 3: [("text", "q")]}


def test_formulas_and_translations_of_blocks():
    page = f'<div data-block-id="a" data-latex="x^2" data-mt-zh="z">x</div><td data-block-id="b"> two\n words </td><p data-block-id="c" data-latex="{"y" * 41}">y</p>'
    assert [(b["id"], b["markdown"], b["translation"]) for b in documents.blocks_of(page)] == [("a", "$x^2$", "z"), ("b", "two words", None), ("c", f"$${'y' * 41}$$", None)]


def test_commands(spark, tmp_path):
    rows = [{"sample_id": "1", "target": "x", "prediction": "x", "grpo_scene": "a"}, {"sample_id": "2", "target": "", "prediction": "", "grpo_scene": "a"}, {"sample_id": "3", "target": "y", "prediction": "no", "grpo_scene": None}]
    (tmp_path / "p.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows) + "{bad\n")
    cli.main(["eval", f"{tmp_path}/p.jsonl", f"{tmp_path}/r", "--by", "grpo_scene"])
    got = {r.grpo_scene: (r.n, r.block_hit_rate) for r in spark.read.json(f"{tmp_path}/r").collect()}
    assert got == {"a": (2, 1.0), "unknown": (1, 0.0)}
    pool = tmp_path / "pools" / "core"
    pool.mkdir(parents=True)
    line = lambda i: json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "images": [], "metadata": {"sample_id": f"s{i}", "pool_id": "core", "template_stem": "t"}})
    (pool / "point.jsonl").write_text("\n".join(map(line, range(40))))
    (tmp_path / "recipe.yaml").write_text("name: st\nmix: {core: 1.0}\nn: 20\nsplit: {train: 0.8, val: 0.1}\n")
    cli.main(["build", f"{tmp_path}/pools", f"{tmp_path}/recipe.yaml", f"{tmp_path}/out"])
    assert Counter(r.split for r in spark.read.json(f"{tmp_path}/out").collect()) == {"train": 16, "val": 2, "test": 2}


def test_areas_of_missing_boxes(spark):
    r = spark.createDataFrame([(1.0,)], "x double").select(G.area_ratio(F.lit(None).cast("struct<x0: double, y0: double, x1: double, y1: double>"), F.lit(2.0), F.lit(3.0)).alias("a")).first()
    assert r.a is None
