import pytest
from pyspark.sql import functions as F

from curatrix.functions import classify as C
from curatrix.functions import rewards as R
from curatrix.functions import text as X


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def lit(s):
    return F.lit(s)


@pytest.mark.parametrize(("a", "b", "want"), [("Hello World", "hello   world", 1.0), ("", " \n", 1.0), ("x", "", 0.0), ("kitten", "sitting", 1 - 3 / 7), ("élan", "elan", 0.75), ("a b", "a b", 1.0)])
def test_edit_similarity(spark, a, b, want):
    assert one(spark, X.edit_similarity(lit(a), lit(b))) == pytest.approx(want)


def test_over_extraction(spark):
    over = lambda p, g: one(spark, X.over_extraction(lit(p), lit(g)))
    assert over("y" * 1000, "x") and not over("", "x") and not over("short", "short")
    assert over("# a\n# b\n# c\n" + "z" * 250, "q" * 60)
    assert over("\n\n".join(["block of text that is long enough to count here"] * 5), "q" * 90)
    assert not over("z" * 250, "q" * 100)


def test_chrf(spark):
    pairs = [("你好世界", "你好世界", 1.0), ("", "", 1.0), ("abc", "", 0.0), ("", "abc", 0.0)]
    for h, r, want in pairs:
        assert X.ngram_score(h, r) == want
    assert 0 < X.ngram_score("你好世界啊", "你好世界") < 1
    assert X.ngram_score("the same words", "the same words", words=2) == 1
    rows = [(i, h, r) for i, (h, r, _) in enumerate(pairs)] + [(9, "a  quick fox", "a quick dog jumps"), (10, "x", "xyz"), (11, None, "a")]
    d = spark.createDataFrame(rows, "k int, h string, r string")
    a = {r.k: r.s for r in X.chrf_grams(d, "k", "h", "r", "s").collect()}
    b = {r.k: r.s for r in d.select("k", X.chrf("h", "r").alias("s")).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_parse(spark):
    p = lambda s: one(spark, X.parse_target(lit(s)))
    r = p("<source>\nHello world.\n</source>\n<translation>\nBonjour\n</translation>")
    assert r.source == "Hello world." and r.well_formed and not r.truncated
    r = p("<source></source><translation></translation>")
    assert r.well_formed and r.empty_shell
    assert p("<source>").truncated and p("<source>").unclosed_source
    r = p("Sure! <SOURCE>a</SOURCE><translation>b</translation>")
    assert not r.well_formed and "Sure!" in r.stray and r.source == "a"
    r = p("<translation>b</translation><source>a</source>")
    assert not r.well_formed and not r.source_first
    assert not p(None).has_source


def test_leaks(spark):
    s = lambda x: one(spark, X.strip_format_leak(lit(x)))
    assert s("text<|im_end|>\nassistant\nmore") == "text"
    assert s("<think>\n\n</think>\n\nanswer") == "answer"
    assert s("plain answer") == "plain answer"
    assert s("a\nassistant\nb") == "a"
    assert s("<think>hm") == "" and s(None) == ""
    leak = lambda x: one(spark, X.has_format_leak(lit(x)))
    assert leak("x </THINK>") and leak("<|im_start|>") and not leak("<|IM_START|>") and not leak("my assistant said")


def test_small_functions(spark):
    assert one(spark, X.normalize_markdown(lit("a  \r\nb\n\n\n\nc "))) == "a\nb\n\nc"
    assert one(spark, X.safe_stem(lit("a b/c:é"))) == "a_b_c_é"
    assert one(spark, X.page_index(lit("x__y__12"))) == 12 and one(spark, X.page_index(lit("x"))) is None
    assert one(spark, X.html_escape(lit("<a & 'b'>"))) == "&lt;a &amp; &#x27;b&#x27;&gt;"
    assert one(spark, X.relocate(lit("/old/a/b.png"), "/old", "/new", F.lit(True))) == "/new/a/b.png"
    assert one(spark, X.relocate(lit("/older/a"), "/old", "/new", F.lit(True))) == "/older/a"
    assert one(spark, X.clip(lit("a  b  c d"), 4)) == "a b…"
    assert one(spark, X.point_json(F.lit(3), F.lit(4))) == '[{"point_2d": [3, 4]}]'
    assert one(spark, X.wrap_target(lit("md"), F.lit(True), lit("tr"), F.lit(False))) == "<source>\nmd\n</source>\n<translation>\ntr\n</translation>"
    assert one(spark, X.wrap_target(lit("md"), F.lit(True), lit("tr"), F.lit(True))) == ""


@pytest.mark.parametrize(("md", "tag", "want"), [("", None, "empty"), ("x", "td", "table"), ("<TABLE>", None, "table"), ("a $x$", None, "formula"), ("```py", None, "code"), ("x", "pre", "code"), ("# T", None, "heading"), ("tiny", None, "short"), ("w" * 801, None, "long"), ("w" * 100, None, "paragraph")])
def test_buckets(spark, md, tag, want):
    assert one(spark, C.bucket_for_block(lit(md), F.lit(tag).cast("string"))) == want


def test_label_reasons(spark):
    why = lambda s: one(spark, C.label_reason(lit(s), F.lit(None).cast("string")))
    assert why(" ") == "empty_label" and why("abcdefghij" * 6) == "repetition" and why("ok �") == "replacement_char"
    assert why("".join(f"<tag{i} " for i in range(25))) == "broken_html" and why("One plain varied sentence.") == "ok"


def test_scenes(spark):
    s = lambda pool, t, neg=False, frag=None: one(spark, C.scene(lit(pool), lit(t), F.lit(neg), F.lit(frag).cast("int"), F.lit(0)))
    assert s("real_labeled", "OK") == "semantic_group" and s("real_labeled", "x" * 120) is None
    assert s("core_inner", "text", frag=2) == "multi_frag" and s("core_inner", " ") == "empty" and s("core_inner", "t", neg=True) == "empty"


def test_pairs(spark):
    ok = lambda e, z: one(spark, C.ok_pair(lit(e), lit(z)))
    assert ok("Hello world again", "你好世界你好") and not ok("Hello world", "Hello world") and not ok("see http://x.y now please", "你好世界你好世界")
    assert not ok("x", "你好") and not ok("{a}{b}{c} words", "你好世界你好") and not ok(None, "你好")


def test_rewards(spark):
    w = R.TwoTagWeights()
    assert w.ceiling() == 2.0 and R.weights_from(None) == w
    assert R.weights_from("1.5,0.05,1.0,1.5,1.5,0.75,0.5").ceiling() == pytest.approx(2.55)
    with pytest.raises(ValueError):
        R.weights_from("1,2,3")
    t = lambda raw, gt, neg: one(spark, R.one_tag(lit(raw), lit(gt), F.lit(neg))).total
    assert t("same", "same", False) == 1.0 and t("", "same", False) == -1.5 and t("", "", True) == 2.5 and t("oops", "", True) == 0.0
    x = lambda s: one(spark, R.xml(lit(s)))
    assert [x(s) for s in ("", "<source>a</source><translation>b</translation>", "z<source>a</source><translation>b</translation>", "<source>a</source>", "plain")] == [0.0, 1.0, 0.4, 0.0, -0.5]
    v = lambda *a: one(spark, R.verdict(*map(F.lit, a)))
    assert [v(0.5, 0.1, 2), v(0.95, 0.0, 1), v(0.1, 0.0, 1), v(0.5, 0.0, 1)] == ["signal", "saturated", "collapsed", "flat"]
