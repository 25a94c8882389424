"""Scalar functions over whole tables: boxes, points, windows, forms of text, classes of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import geometry as G
from ..functions import rewards as R
from ..functions import text as X
from ..functions import viewport as V
from ..functions.keys import hint_between, huniform
from ..operators import metrics, units
from .base import BOXES, CJK_SQL, SAMPLES, TURNS, WS, boxes, norm_sql, query, samples, similarity_sql, strip_sql, t, turns, uniform_sql

W, H = 1216.0, 736.0
POINTS = f"p AS (SELECT *, {uniform_sql('px', 'id')} * 1200 AS x, {uniform_sql('py', 'id')} * 720 AS y, x1 - x0 AS w, y1 - y0 AS h FROM boxes)"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return boxes(spark, sf).withColumns({"x": huniform("px", "id") * 1200, "y": huniform("py", "id") * 720})


@query(f"""WITH {BOXES}, {POINTS} SELECT id, CAST(w * h AS DOUBLE) AS area, CAST((w + 10) * (h + 10) AS DOUBLE) AS expanded, round(least(greatest(x, x0 + 3), greatest(x0 + 3, x1 - 3)), 6)::DOUBLE AS clamped_x, round(least(greatest(y, y0 + 3), greatest(y0 + 3, y1 - 3)), 6)::DOUBLE AS clamped_y,
CAST((x0 + x1) / 2.0 - w * 0.25 AS DOUBLE) AS band_x0, CAST((y0 + y1) / 2.0 + h * 0.25 AS DOUBLE) AS band_y1, round(greatest(0, least(x1, 700) - greatest(x0, 300)) / least(w, 400)::DOUBLE, 9)::DOUBLE AS x_share,
round(sqrt(pow(greatest(x0 - x, 0, x - x1), 2) + pow(greatest(y0 - y, 0, y - y1), 2)), 6)::DOUBLE AS away, round(w * h / (1216.0 * 736.0)::DOUBLE, 9)::DOUBLE AS ratio, x <= 48 OR y <= 48 OR x >= 1168 OR y >= 688 AS near_edge FROM p""")
def box_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Areas, expanded and middle boxes, clamped points, overlaps, distances and edges."""
    b, x, y = F.col("b"), F.col("x"), F.col("y")
    wide = G.box(F.lit(300), F.lit(0), F.lit(700), F.lit(736))
    c, m = G.clamped_point(b, x, y, 3.0), G.center_band(b, 0.25)
    return _points(spark, sf).select("id", G.area(b).alias("area"), G.area(G.expand(b, 5.0)).alias("expanded"), F.round(c["x"], 6).alias("clamped_x"), F.round(c["y"], 6).alias("clamped_y"), m["x0"].alias("band_x0"), m["y1"].alias("band_y1"), F.round(G.x_overlap_share(b, wide), 9).alias("x_share"), F.round(G.distance_outside(x, y, F.array(b)), 6).alias("away"), F.round(G.area_ratio(b, F.lit(W), F.lit(H)), 9).alias("ratio"), G.near_edge(x, y, F.lit(W), F.lit(H)).alias("near_edge"))


@query(f"""WITH {BOXES}, {POINTS}, m AS (SELECT id, w, h, greatest(6, round_even(sqrt(w * h * 0.005 / 2), 0)) AS half, (id % 9) / 8.0::DOUBLE AS s FROM p)
SELECT id, round(w * h * 0.005, 6)::DOUBLE AS square, CAST(half AS DOUBLE) AS half, 2 * half >= 24 AND 2 * half <= least(w, h) AS fits, round(0.005 * greatest(0.05, s), 9)::DOUBLE AS share, round(greatest(0.05, s), 9)::DOUBLE AS scale, round(greatest(0.55, least(1.7, least(w, h) / 1080.0::DOUBLE)), 9)::DOUBLE AS dot, 255 AS opacity, round(CASE WHEN id % 3 = 0 THEN 0.002 WHEN id % 3 = 1 THEN 0.005 * greatest(0.05, s) ELSE 0.0008 + {uniform_sql('mk', 'id')} * 0.0012 END, 9)::DOUBLE AS chosen FROM m""")
def marker_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of markers on images as large as the boxes; shares that are given, follow from a scale, or are drawn."""
    d = boxes(spark, sf).withColumns({"w": G.width(F.col("b")), "h": G.height(F.col("b")), "s": (F.col("id") % 9) / 8.0})
    share = G.area_share_for_scale(F.col("s"))
    given = F.when(F.col("id") % 3 == 0, 0.002)
    chosen = C.area_fraction(given, F.when(F.col("id") % 3 == 1, F.col("s")), 0.0008 + huniform("mk", "id") * 0.0012)
    return d.select("id", F.round(F.col("w") * F.col("h") * G.MARKER_SHARE, 6).alias("square"), G.marker_half(F.col("w"), F.col("h")).alias("half"), G.marker_fits(F.col("w"), F.col("h")).alias("fits"), F.round(share, 9).alias("share"), F.round(share / G.MARKER_SHARE, 9).alias("scale"), F.round(G.dot_scale(F.col("w"), F.col("h")), 9).alias("dot"), F.lit(G.MARKER_OPACITY).alias("opacity"), F.round(chosen, 9).alias("chosen"))


@query(f"""WITH {BOXES}, {POINTS}, n AS (SELECT *, least(999, greatest(0, floor(x / 1216 * 1000))) AS nx, least(999, greatest(0, floor(y / 736 * 1000))) AS ny, least(99.9, greatest(0, round_even(x / 1216 * 100, 1))) AS px, least(99.9, greatest(0, round_even(y / 736 * 100, 1))) AS py, least(greatest(round_even(x, 0), 0), 1215) AS ix, least(greatest(round_even(y, 0), 0), 735) AS iy FROM p)
SELECT id, CAST(nx AS INT) AS norm_x, CAST(ny AS INT) AS norm_y, px::DOUBLE AS pct_x, '<point x=' || printf('%.1f', px) || ' y=' || printf('%.1f', py) || '>' AS tag, '[{{"point_2d": [' || CAST(CAST(ix AS INT) AS VARCHAR) || ', ' || CAST(CAST(iy AS INT) AS VARCHAR) || ']}}]' AS json, 'Read (' || CAST(CAST(ix AS INT) AS VARCHAR) || ', ' || CAST(CAST(iy AS INT) AS VARCHAR) || ') of the page' AS pixel_prompt, 'At ' || CAST(CAST(nx AS INT) AS VARCHAR) || '/' || CAST(CAST(ny AS INT) AS VARCHAR) AS grid_prompt, round(x - x0, 6)::DOUBLE AS remapped FROM n""")
def point_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Points on a grid, in percent, in pixels, as tags, JSON and in prompts, and moved to a box's corner."""
    x, y = F.col("x"), F.col("y")
    w, h = F.lit(W), F.lit(H)
    px, py = G.pixel_to_pct(x, w), G.pixel_to_pct(y, h)
    nx, ny = G.pixel_to_norm(x, w), G.pixel_to_norm(y, h)
    whole = lambda v, n: F.least(F.greatest(F.bround(v), F.lit(0.0)), n - 1.0)
    return _points(spark, sf).select("id", nx.alias("norm_x"), ny.alias("norm_y"), px.alias("pct_x"), X.point_tag(px, py).alias("tag"), X.point_json(whole(x, w), whole(y, h)).alias("json"), V.pixel_prompt("Read ({x}, {y}) of the page", x, y, w, h).alias("pixel_prompt"), V.with_coordinates(F.lit("At {x}/{y}"), nx, ny).alias("grid_prompt"), F.round(x - F.col("b.x0"), 6).alias("remapped"))


_U = lambda s: uniform_sql(s, "id")


@query(f"""WITH {BOXES}, p AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM boxes), a AS (SELECT *, CASE WHEN {_U('3a')} < 0.75 THEN 16.0 / 9 ELSE 4.0 / 3 END AS asp, exp(ln(300000.0::DOUBLE) + {_U('3s')} * (ln(900000.0::DOUBLE) - ln(300000.0::DOUBLE))) AS area, CASE WHEN {_U('3d')} < 0.5 THEN 1.0 WHEN {_U('3d')} < 0.8 THEN 1.5 ELSE 2.0 END AS dpr, floor({_U('3p')} * 2) AS pick, 0.94 + 0.12 * {_U('3j')} AS k FROM p),
b AS (SELECT *, sqrt(area * asp) AS sw, w / h::DOUBLE AS ratio FROM a), c AS (SELECT *, CASE WHEN ratio < 0.75 THEN w / 0.75 WHEN ratio > 16.0 / 9 THEN w / (16.0::DOUBLE / 9) ELSE h::DOUBLE END AS fh FROM b)
SELECT id, CAST(greatest(8, round_even(sw / 8, 0) * 8) AS INT) AS w, CAST(greatest(8, round_even(area / sw / 8, 0) * 8) AS INT) AS h, CAST(greatest(8, round_even((CASE WHEN pick = 0 THEN 1280 ELSE 390 END) * k / 8, 0) * 8) AS INT) AS preset_w, dpr::DOUBLE AS dpr, round(fh, 6)::DOUBLE AS fitted_h, CAST(floor(w * least(1, sqrt(5000.0::DOUBLE / (w * h * dpr * dpr)))) AS INT) AS clamped_w,
CAST(least(greatest(x0 / 4, 0), greatest(w - 64, 0)) AS DOUBLE) AS inset_left, CAST(least(40, greatest(w - least(greatest(x0 / 4, 0), greatest(w - 64, 0)) - 64, 0)) AS DOUBLE) AS inset_right, CAST(greatest(0, least((x0 + x1) / 2.0 - 100, 1216 - 200)) AS DOUBLE) AS crop_x0, CAST(least(greatest(x0 - 50, 0), 1000) AS INT) AS box_x0, CAST(least(greatest(x1, 0), 1000) AS INT) AS box_x1 FROM c""")
def window_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Drawn window sizes, presets and densities; aspects, pixels, insets, crops and boxes within bounds."""
    b = F.col("b")
    d = boxes(spark, sf).withColumns({"w": G.width(b), "h": G.height(b)}).withColumns({"win": V.sampled_window(3, {"16:9": 0.75, "4:3": 0.25}, 300_000.0, 900_000.0, "id"), "pre": V.jittered_preset(3, [(1280, 800), (390, 844)], "id"), "dpr": V.sampled_dpr(3, {"1.0": 0.5, "1.5": 0.3, "2.0": 0.2}, "id")})
    ins = V.insets(b["x0"] / 4, F.lit(0.0), F.lit(40.0), F.lit(0.0), F.col("w"), F.col("h"))
    crop = V.crop((b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2, F.lit(W), F.lit(H), 200)
    box = V.clamped_box(F.array(b["x1"], b["y1"], b["x0"] - 50, b["y0"] - 50), F.lit(1000), F.lit(700))
    return d.select("id", "win.w", "win.h", F.col("pre.w").alias("preset_w"), "dpr", F.round(V.fit_aspect(F.col("w"), F.col("h"))["h"], 6).alias("fitted_h"), V.clamp_pixels(F.col("w"), F.col("h"), F.col("dpr"), 5000.0)["w"].alias("clamped_w"), ins["left"].alias("inset_left"), ins["right"].alias("inset_right"), crop["x0"].alias("crop_x0"), box[0].alias("box_x0"), box[2].alias("box_x1"))


@query(f"""WITH {TURNS}, n AS (SELECT sample_id, target, {norm_sql('target')} AS nt, {strip_sql(f"regexp_replace(target, '{WS}+', ' ', 'g')")} AS one, {strip_sql("regexp_replace(regexp_replace(regexp_replace(target, '\\r\\n?', chr(10), 'g'), '(?m)[ \\t]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")} AS md FROM turns)
SELECT sample_id, md5(nt) AS normal, md5(md) AS markdown, md5(CASE WHEN length(one) > 40 THEN left(one, 39) || '…' ELSE one END) AS clipped, md5(left(regexp_replace(target, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}.\\-]+', '_', 'g'), 180)) AS stem, md5(replace(replace(replace(replace(replace(target, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped,
round(CASE WHEN length(target) = 0 THEN 0 ELSE len(regexp_extract_all(target, '{CJK_SQL}')) / length(target)::DOUBLE END, 9)::DOUBLE AS cjk, CASE WHEN length(target) = 0 THEN 1.0 ELSE round(least(10, length(target)) / length(target)::DOUBLE, 9) END::DOUBLE AS ratio, len(regexp_extract_all(target, '{CJK_SQL}')) >= greatest(2, len(regexp_extract_all(target, '[A-Za-z]'))) AS mostly_cjk, length(nt) > 0 AND length({norm_sql('left(target, 30)')}) >= 12 AND contains(nt, {norm_sql('left(target, 30)')}) AS within, round(1 - {similarity_sql('left(target, 200)', 'left(target, 100)')}, 9)::DOUBLE AS distance FROM n""")
def text_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Normal forms, clips, stems and escapes of whole texts; shares of scripts, lengths, containment and distance."""
    x = F.col("target")
    part = lambda n: F.left(x, F.lit(n))
    return turns(spark, sf).select("sample_id", F.md5(X.normalize_text(x)).alias("normal"), F.md5(X.normalize_markdown(x)).alias("markdown"), F.md5(X.clip(x, 40)).alias("clipped"), F.md5(X.safe_stem(x)).alias("stem"), F.md5(X.html_escape(x)).alias("escaped"), F.round(X.cjk_ratio(x), 9).alias("cjk"), F.round(X.length_ratio(part(10), x), 9).alias("ratio"), C.mostly_cjk(x).alias("mostly_cjk"), C.within_target(part(30), x).alias("within"), F.round(X.normalized_edit_distance(part(200), part(100)), 9).alias("distance"))


@query(f"""WITH {TURNS}, n AS (SELECT *, {norm_sql('target')} = '' AS blank, CASE WHEN conv_id % 3 = 0 THEN left(target, 20) ELSE '' END AS tr FROM turns)
SELECT sample_id, md5(CASE WHEN is_negative OR blank THEN '' WHEN turn % 2 = 0 THEN '<source>' || chr(10) || target || chr(10) || '</source>' || chr(10) || '<translation>' || chr(10) || tr || chr(10) || '</translation>' ELSE target END) AS wrapped, md5(CASE WHEN starts_with('<image>' || target, '<image>') THEN ltrim(target) ELSE target END) AS said FROM n""")
def wrapped_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Targets of negatives, of one text and of two tags; a user's text without the image's mark."""
    tr = F.when(F.col("conv_id") % 3 == 0, F.left("target", F.lit(20)))
    return turns(spark, sf).select("sample_id", F.md5(X.wrap_target(F.col("target"), F.col("turn") % 2 == 0, tr, F.col("is_negative"))).alias("wrapped"), F.md5(X.user_text(F.concat(F.lit("<image>"), "target"))).alias("said"))


@query(f"""WITH {TURNS}, x AS (SELECT sample_id, role, {norm_sql('target')} AS g, {strip_sql("split_part(prediction_raw, '<|im_e', 1)")} AS pred, {similarity_sql("split_part(prediction_raw, '<|im_e', 1)", 'target')} AS sim FROM turns), y AS (SELECT *, {norm_sql('pred')} AS p FROM x)
SELECT sample_id, round(sim, 4)::DOUBLE AS sim, sim >= 0.85 AS hit, sim >= 0.5 AS related, p = '' AS pred_empty, g = '' AS gt_empty, g <> '' AND (contains(p, 'arxiv q search') OR contains(p, '322 languages') OR contains(p, 'this website uses cookies')) AS furniture, length(p) >= 12 AND contains(g, p) AS in_gt FROM y""")
def row_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Each prediction against its target: similarity, hit, relation, blanks, page furniture, containment."""
    d = turns(spark, sf).withColumn("prediction", X.strip_format_leak(F.col("prediction_raw")))
    return metrics.row_scores(d).select("sample_id", "sim", "hit", "related", "pred_empty", "gt_empty", "furniture", "in_gt")


@query(f"""WITH {TURNS}, x AS (SELECT role, is_negative, {norm_sql('target')} AS g, {similarity_sql("split_part(prediction_raw, '<|im_e', 1)", 'target')} AS sim, {norm_sql("split_part(prediction_raw, '<|im_e', 1)")} AS p FROM turns), y AS (SELECT *, is_negative OR g = '' AS neg, sim >= 0.85 AS hit FROM x)
SELECT role, count(*) AS n, round(avg(CAST(hit AS INT)), 4)::DOUBLE AS hit_rate, round(avg(CASE WHEN NOT neg THEN CAST(hit AS INT) END), 4)::DOUBLE AS hit_rate_pos, round(avg(CASE WHEN neg THEN CAST(p = '' AS INT) END), 4)::DOUBLE AS empty_rate_neg FROM y GROUP BY role""")
def score_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of rows' scores, over all and by class; null where a class is empty."""
    d = turns(spark, sf).withColumn("prediction", X.strip_format_leak(F.col("prediction_raw")))
    return metrics.score_rates(metrics.row_scores(d), "role")


@query(f"""WITH {TURNS}, x AS (SELECT sample_id, prediction_raw, {similarity_sql("split_part(prediction_raw, '<|im_e', 1)", 'target')} AS sim, {norm_sql("split_part(prediction_raw, '<|im_e', 1)")} = '' AS blank, is_negative FROM turns)
SELECT sample_id, round(sim + CASE WHEN is_negative THEN CAST(blank AS INT) WHEN blank THEN -1 ELSE 0 END + 0.5 * CASE WHEN contains(prediction_raw, '<|im_end|>') THEN -0.5 ELSE 0 END, 6)::DOUBLE AS total, 2.55::DOUBLE AS ceiling FROM x""")
def legacy_reward(spark: SparkSession, sf: str) -> DataFrame:
    """The first set of rewards; beside it the ceiling of two-tag weights that are given as text."""
    w = R.weights_from("1.5,0.05,1.0,1.5,1.5,0.75,0.5")
    return turns(spark, sf).select("sample_id", F.round(R.reward_set("q1")(F.col("prediction_raw"), F.col("target"), F.col("is_negative")), 6).alias("total"), F.round(F.lit(w.ceiling()), 6).alias("ceiling"))


@query("""WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS m, count(*) AS n FROM conversations GROUP BY conv_id),
f AS (SELECT *, CASE conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN list_transform(range(0, n), lambda i: CASE WHEN i % 2 = 0 THEN 'yes' ELSE '0' END) WHEN 2 THEN ['True'] ELSE list_transform(range(0, n + 3), lambda i: 'no') END AS flags, list_transform(range(0, n), lambda i: CASE WHEN i % 3 = 0 THEN ' ' ELSE m[i + 1] END) AS targets FROM c),
u AS (SELECT conv_id, i.i AS pos, m[i.i + 1] AS prediction, targets[i.i + 1] AS target, flags FROM f, LATERAL (SELECT unnest(range(0, n)) AS i) i)
SELECT conv_id, CAST(pos AS INT) AS pos, CASE WHEN flags IS NULL THEN trim(target, ' ' || chr(9) || chr(10) || chr(13)) = '' ELSE coalesce(lower(flags[pos + 1]) IN ('1', 'true', 'yes'), false) END AS negative, CASE WHEN CASE WHEN flags IS NULL THEN trim(target, ' ' || chr(9) || chr(10) || chr(13)) = '' ELSE coalesce(lower(flags[pos + 1]) IN ('1', 'true', 'yes'), false) END THEN 0.0 ELSE 0.0 END::DOUBLE AS empty FROM u""")
def paired_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Completions paired with targets and flags: flags given, too few, too many, or inferred from blank targets; and the term for blanks."""
    d = t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m")).withColumn("m", F.transform("m", lambda x: x["text"]))
    k = F.col("conv_id") % 4
    flags = F.when(k == 1, F.transform("m", lambda _, i: F.when(i % 2 == 0, "yes").otherwise("0"))).when(k == 2, F.array(F.lit("True"))).when(k == 3, F.transform(F.sequence(F.lit(1), F.size("m") + 3), lambda _: F.lit("no")))
    targets = F.transform("m", lambda x, i: F.when(i % 3 == 0, " ").otherwise(x))
    d = d.select("conv_id", F.posexplode(R.paired(F.col("m"), targets, flags)).alias("pos", "p"))
    return d.select("conv_id", "pos", "p.negative", F.when(F.col("p.negative"), 0.0).otherwise(R.empty(F.col("p.prediction"), F.col("p.negative"))).alias("empty"))


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS md, p_size AS s, p_partkey % 8 AS g FROM part), a AS (SELECT *, CASE g WHEN 0 THEN 'Table ' WHEN 1 THEN 'image' ELSE '' END AS kind, CASE g WHEN 2 THEN 'table' WHEN 3 THEN 'pre' WHEN 4 THEN 'img' WHEN 7 THEN 'span' ELSE 'p' END AS tag, CASE WHEN g = 5 THEN 'x^2' END AS latex, CASE WHEN g = 6 THEN '```' || md WHEN g = 7 AND s % 2 = 0 THEN '$' || md || ' \\sum$' ELSE md END AS text FROM p),
c AS (SELECT *, CASE WHEN trim(lower(kind)) IN ('formula', 'code', 'image', 'chart', 'table') THEN trim(lower(kind)) WHEN tag = 'table' THEN 'table' WHEN tag IN ('pre', 'code') OR starts_with(text, '```') THEN 'code' WHEN tag = 'img' THEN 'image' WHEN latex IS NOT NULL OR (g = 7 AND s % 2 = 0 AND s % 4 = 0) THEN 'formula' ELSE 'text' END AS found FROM a)
SELECT k AS p_partkey, found AS kind, CASE WHEN found IN ('image', 'chart') THEN '' WHEN found = 'table' AND s % 3 = 0 THEN '<table>' || s || '</table>' ELSE text END AS target, found IN ('formula', 'image', 'chart') OR latex IS NOT NULL AS skipped, found IN ('table', 'image', 'chart') OR tag = 'table' AS special, s % 5 = 0 OR trim(CASE WHEN s % 7 = 0 THEN '' ELSE md END) <> '' AS manual, CASE WHEN s % 4 = 0 THEN NULL WHEN s % 4 = 1 THEN NULL ELSE 'g' || s END AS gid, s / 50.0::DOUBLE IS NULL OR (s / 50.0::DOUBLE BETWEEN 0.25 AND 0.70) AS occupancy FROM c""")
def content_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of blocks, their targets, which slots are skipped, which blocks are special or of hand, groups, occupancy."""
    g, s = F.col("p_partkey") % 8, F.col("p_size")
    kind = F.when(g == 0, "Table ").when(g == 1, "image").otherwise("")
    tag = F.when(g == 2, "table").when(g == 3, "pre").when(g == 4, "img").when(g == 7, "span").otherwise("p")
    latex = F.when(g == 5, "x^2")
    text = F.when(g == 6, F.concat(F.lit("```"), "p_name")).when((g == 7) & (s % 2 == 0), F.concat(F.lit("$"), "p_name", F.lit(" \\sum$"))).otherwise(F.col("p_name"))
    d = t(spark, sf, "part").withColumns({"text": text, "tag": tag, "latex": latex}).withColumn("kind", C.content_kind(kind, F.col("tag"), F.col("text"), F.col("latex"), F.when(s % 4 == 0, '<span class="Formula">').otherwise("<span>")))
    html = F.when(s % 3 == 0, F.concat(F.lit("<table>"), s.cast("string"), F.lit("</table>")))
    gid = F.when(s % 4 == 0, "null").when(s % 4 == 1, " ").otherwise(F.concat(F.lit("g"), s.cast("string")))
    return d.select("p_partkey", "kind", C.content_target(F.col("kind"), F.col("text"), html).alias("target"), C.skipped_slot(F.col("kind"), F.col("latex")).alias("skipped"), C.is_special_block(F.col("kind"), F.col("text"), F.col("tag")).alias("special"), C.is_manual(s % 5 == 0, F.when(s % 7 == 0, "").otherwise(F.col("p_name"))).alias("manual"), C.explicit_group(gid).alias("gid"), C.occupancy_ok(s / 50.0).alias("occupancy"))


@query(f"""WITH {BOXES}, p AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, {_U('vf')} AS v, {_U('fo')} < 0.3 AS focused FROM boxes), q AS (SELECT *, w >= 2 AND h >= 2 AND x0 >= -2 AND y0 >= -2 AND x1 <= 1150 + 2 AND y1 <= 700 + 2 AND (id % 4 = 0 OR 0.97 + v * 0.03 >= 0.98) AS framed FROM p)
SELECT id, framed, id % 6 = 0 OR 0.85 + v * 0.15 >= 0.9 AS clear, framed AND w * h / 894976.0 >= 0.015 AND length(p_name) >= 10 AS large, focused AND row_number() OVER (PARTITION BY page_id, focused ORDER BY w * h DESC, id) <= 3 AS top_focused FROM q""")
def block_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks within the frame, clear to see, large enough, and the largest ones of the focused window."""
    from pyspark.sql import Window

    from ..operators import selection

    d = boxes(spark, sf).withColumns({"v": huniform("vf", "id"), "focused": huniform("fo", "id") < 0.3, "rects": F.array("b")})
    vis = F.when(F.col("id") % 4 != 0, 0.97 + F.col("v") * 0.03)
    framed = G.fully_in_frame(F.col("rects"), F.lit(1150.0), F.lit(700.0), vis, F.lit(None).cast("double"))
    clear = F.coalesce(F.when(F.col("id") % 6 != 0, 0.85 + F.col("v") * 0.15) >= 0.9, F.lit(True))
    d = d.withColumns({"framed": framed, "clear": clear, "markdown": F.col("p_name")})
    large = selection.large_blocks(d, F.lit(False), F.lit(True), F.col("framed"), F.lit(894976.0), least_chars=10).select("id", F.lit(True).alias("l"))
    rank = F.row_number().over(Window.partitionBy("page_id", "focused").orderBy(F.desc(G.ink_area(F.col("rects"))), "id"))
    d = d.withColumn("rn", rank).join(large, "id", "left")
    return d.select("id", "framed", "clear", F.coalesce("l", F.lit(False)).alias("large"), (F.col("focused") & (F.col("rn") <= 3)).alias("top_focused"))


@query(f"""WITH {SAMPLES}, x AS (SELECT *, {strip_sql('target')} AS m FROM samples), c AS (SELECT max(CASE WHEN i = floor(n / 3.0 + 1e-9) THEN v END) AS lo, max(CASE WHEN i = floor(2 * n / 3.0 + 1e-9) THEN v END) AS hi FROM (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents)),
s AS (SELECT *, CASE WHEN doc_id % 11 = 0 OR length(m) = 0 THEN 'empty' WHEN doc_id % 5 = 0 THEN 'multi_frag' WHEN pool_id = 'de' THEN 'semantic_group' WHEN pool_id = 'es' AND length(m) < 80 THEN 'semantic_group' END AS scene FROM x)
SELECT sample_id, CASE WHEN doc_id % 13 = 0 THEN 'regular' ELSE coalesce(scene, CASE WHEN length(m) > 0 THEN 'regular' END) END AS slice, CASE WHEN pool_id = 'es' THEN 'real' ELSE coalesce(scene, 'other') END AS scene, CASE WHEN n_chars <= lo THEN 0 WHEN n_chars <= hi THEN 1 ELSE 2 END AS tertile, template_stem AS stem, doc_id % 11 = 0 OR length(m) = 0 AS negative, pool_id = 'es' AS is_real, template_stem LIKE 'src1%' AS shell FROM s, c""")
def sample_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Slices, scenes, tertiles, stems and flags of samples."""
    from ..operators import ranking

    d = samples(spark, sf)
    cuts = ranking.nearest_rank(t(spark, sf, "documents"), "n_chars", {"lo": 1 / 3, "hi": 2 / 3}).first()  # plan parameters
    pool = F.when(F.col("pool_id") == "de", "semantic_group").when(F.col("pool_id") == "es", "real_labeled").otherwise(F.col("pool_id"))
    flagged = F.when(F.col("doc_id") % 11 == 0, True)
    found = C.scene(pool, F.col("target"), flagged, F.when(F.col("doc_id") % 5 == 0, 2), F.lit(None).cast("int"))
    d = d.withColumns({"pool": pool, "found": found, "neg": F.coalesce(flagged, F.lit(False)) | X.is_blank(F.col("target"))})
    tagged = F.when(F.col("doc_id") % 13 == 0, "regular").otherwise("nothing")
    real = C.is_real(F.col("pool"))
    stem = C.template_stem(F.when(F.col("doc_id") % 2 == 0, F.concat("template_stem", F.lit(".html"))), F.concat(F.lit("p__"), "template_stem", F.lit("__3")), F.col("sample_id"))
    return d.select("sample_id", C.val_slice(tagged, F.col("found"), F.col("target")).alias("slice"), F.when(real, "real").otherwise(F.coalesce("found", F.lit("other"))).alias("scene"), C.tertile(F.col("n_chars"), F.lit(cuts.lo), F.lit(cuts.hi)).alias("tertile"), stem.alias("stem"), F.col("neg").alias("negative"), real.alias("is_real"), F.startswith("template_stem", F.lit("src1")).alias("shell"))


@query(f"""WITH {BOXES}, {POINTS}, q AS (SELECT id % 4 AS probe, x / 12.16 AS px, y / 7.36 AS py, CASE WHEN id % 4 = 1 THEN 100 - y / 7.36 ELSE y / 7.36 END AS seen FROM p),
e AS (SELECT probe, CASE WHEN py < 50 THEN CASE WHEN px < 50 THEN 'r' ELSE 'g' END ELSE CASE WHEN px < 50 THEN 'b' ELSE 'y' END END AS top, CASE WHEN 100 - py < 50 THEN CASE WHEN px < 50 THEN 'r' ELSE 'g' END ELSE CASE WHEN px < 50 THEN 'b' ELSE 'y' END END AS bottom, CASE WHEN seen < 50 THEN CASE WHEN px < 50 THEN 'r' ELSE 'g' END ELSE CASE WHEN px < 50 THEN 'b' ELSE 'y' END END AS answer FROM q)
SELECT probe, count(*) AS n, CAST(count_if(answer = top) AS BIGINT) AS as_top, CAST(count_if(answer = bottom) AS BIGINT) AS as_bottom, CASE WHEN count_if(answer = top) > count_if(answer = bottom) THEN 'top' WHEN count_if(answer = bottom) > count_if(answer = top) THEN 'bottom' ELSE 'undecided' END AS verdict FROM e GROUP BY probe""")
def origin_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Which of two conventions of the vertical axis explains the answers of a probe."""
    px, py = F.col("x") / 12.16, F.col("y") / 7.36
    colors = ("r", "g", "b", "y")
    seen = F.when(F.col("id") % 4 == 1, 100 - py).otherwise(py)
    d = _points(spark, sf).select((F.col("id") % 4).alias("probe"), C.quadrant_color(px, py, False, colors).alias("top"), C.quadrant_color(px, py, True, colors).alias("bottom"), C.quadrant_color(px, seen, False, colors).alias("answer"))
    return d.groupBy("probe").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("answer") == F.col("top")).alias("as_top"), F.count_if(F.col("answer") == F.col("bottom")).alias("as_bottom"), C.convention(F.col("answer"), F.col("top"), F.col("bottom")).alias("verdict"))


@query(f"""WITH {BOXES}, {POINTS} SELECT id, CASE WHEN {_U('9k')} < 0.5 THEN 'edge' WHEN {_U('9k')} < 0.8 THEN 'safari' ELSE 'none' END AS shell, CAST(floor({_U('9r')} * 4) + 2 AS INT) AS points, CASE id % 3 WHEN 0 THEN 28 WHEN 1 THEN 18 ELSE 10 END AS gap FROM p""")
def drawn_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """A shell by weight, points a block, and the gap of an occupancy band."""
    from ..functions import html as HT
    from ..functions.keys import categorical

    band = F.when(F.col("id") % 3 == 0, "sparse").when(F.col("id") % 3 == 1, "medium").otherwise("dense")
    gap = F.create_map(*[x for k, v in HT.BANDS.items() for x in (F.lit(k), F.lit(v[1]))])[band]
    return boxes(spark, sf).select("id", categorical("9k", {"edge": 0.5, "safari": 0.3, "none": 0.2}, "id").alias("shell"), hint_between("9r", 2, 5, "id").alias("points"), gap.alias("gap"))


@query(f"""WITH {BOXES}, e AS (SELECT page_id, k.k AS k, {uniform_sql('6ex', 'page_id', 'k.k')} * 1216 AS x, {uniform_sql('6ey', 'page_id', 'k.k')} * 736 AS y FROM (SELECT DISTINCT page_id FROM boxes), (SELECT unnest(range(1, 25)) AS k) k),
f AS (SELECT page_id, k, x, y, row_number() OVER (PARTITION BY page_id ORDER BY k) AS rn FROM e WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.page_id = e.page_id AND sqrt(pow(greatest(b.x0 - e.x, 0, e.x - b.x1), 2) + pow(greatest(b.y0 - e.y, 0, e.y - b.y1), 2)) < 6)) SELECT page_id, CAST(rn AS INT) AS rn, round(x, 6)::DOUBLE AS x, round(y, 6)::DOUBLE AS y FROM f WHERE rn <= 3""")
def empty_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points of pages away from all boxes: the first of the tries that qualify."""
    d = boxes(spark, sf)
    pages = d.select("page_id").distinct().withColumns({"w": F.lit(W), "h": F.lit(H)})
    return units.empty_points(pages, d.select("page_id", "b"), 3, 6.0, 6).select("page_id", "rn", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
