"""Geometry, page units, negatives by geometry, and resizing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.keys import huniform
from ..operators import negatives, units
from .base import BOXES, boxes, query, uniform_sql


@query(f"WITH {BOXES} SELECT page_id, count(*) AS n, CAST(sum((x1 - x0) * (y1 - y0)) AS DOUBLE) AS ink, CAST(min(x0) AS DOUBLE) AS x0, CAST(min(y0) AS DOUBLE) AS y0, CAST(max(x1) AS DOUBLE) AS x1, CAST(max(y1) AS DOUBLE) AS y1 FROM boxes GROUP BY page_id")
def page_unions(spark: SparkSession, sf: str) -> DataFrame:
    d = boxes(spark, sf).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.collect_list("b").alias("r"))  # a page's boxes
    d = d.withColumn("u", G.union_box(F.col("r")))
    return d.select("page_id", "n", G.ink_area(F.col("r")).alias("ink"), "u.x0", "u.y0", "u.x1", "u.y1")


GAPS = """j AS (SELECT a.page_id, a.id AS i, b.id AS j, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS ox, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS oy FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.id < b.id),
g AS (SELECT *, CAST(CASE WHEN ox > 4 AND oy > 4 THEN 0 WHEN ox > 4 THEN greatest(0, -oy) WHEN oy > 4 THEN greatest(0, -ox) END AS DOUBLE) AS gap FROM j)"""


@query(f"WITH {BOXES}, {GAPS} SELECT page_id, i, j, gap, (ox > 4 AND oy < 0) OR (oy > 4 AND ox < 0) AS has_strip FROM g WHERE gap <= 48")
def boundary_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return units.boundary_pairs(boxes(spark, sf)).select("page_id", "i", "j", "gap", F.col("strip").isNotNull().alias("has_strip"))


INNER = """n AS (SELECT *, greatest(1, (x1 - x0) * ((1 - sqrt(0.8)) / 2)) AS dx, greatest(1, (y1 - y0) * ((1 - sqrt(0.8)) / 2)) AS dy FROM boxes),
m AS (SELECT *, CASE WHEN ok THEN x0 + dx ELSE x0 END AS ix0, CASE WHEN ok THEN y0 + dy ELSE y0 END AS iy0, CASE WHEN ok THEN x1 - dx ELSE x1 END AS ix1, CASE WHEN ok THEN y1 - dy ELSE y1 END AS iy1 FROM (SELECT *, (x1 - x0) > 2 * dx AND (y1 - y0) > 2 * dy AS ok FROM n))"""


@query(f"WITH {BOXES}, {INNER} SELECT id, round(ix0, 6)::DOUBLE AS x0, round(iy0, 6)::DOUBLE AS y0, round(ix1, 6)::DOUBLE AS x1, round(iy1, 6)::DOUBLE AS y1 FROM m")
def inner_area(spark: SparkSession, sf: str) -> DataFrame:
    d = boxes(spark, sf).withColumn("i", G.inner_area(F.col("b")))
    return d.select("id", *[F.round(f"i.{k}", 6).alias(k) for k in ("x0", "y0", "x1", "y1")])


POINTS = f"""p AS (SELECT page_id, id, x0, y0, x1, y1, k.k AS k, ix0 + {uniform_sql('5x', 'page_id', 'id', 'k.k')} * (ix1 - ix0) AS x, iy0 + {uniform_sql('5y', 'page_id', 'id', 'k.k')} * (iy1 - iy0) AS y FROM m, (SELECT unnest(range(1, 4)) AS k) k)"""


@query(f"WITH {BOXES}, {INNER}, {POINTS}, r AS (SELECT *, abs(x - (x0 + x1) / 2) / ((x1 - x0) / 2) + abs(y - (y0 + y1) / 2) / ((y1 - y0) / 2) AS d FROM p) SELECT CASE WHEN d <= 1 THEN 'diamond' WHEN x < (x0 + x1) / 2 AND y < (y0 + y1) / 2 THEN 'nw' WHEN x >= (x0 + x1) / 2 AND y < (y0 + y1) / 2 THEN 'ne' WHEN x < (x0 + x1) / 2 THEN 'sw' ELSE 'se' END AS region, count(*) AS n, round(avg(x), 4)::DOUBLE AS mean_x FROM r GROUP BY 1")
def diamond_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Three hash-uniform points in the inner area of each box, by region."""
    p = units.sampled_points(boxes(spark, sf).select("page_id", "id", "b"), 3, 5)
    return p.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 4).alias("mean_x"))


CELLS = "c AS (SELECT DISTINCT page_id, i.i AS i, j.j AS j FROM boxes, LATERAL (SELECT unnest(range(CAST(floor(x0 / 8) AS BIGINT), CAST(ceil(x1 / 8) AS BIGINT))) AS i) i, LATERAL (SELECT unnest(range(CAST(floor(y0 / 8) AS BIGINT), CAST(ceil(y1 / 8) AS BIGINT))) AS j) j)"


@query(f"WITH {BOXES}, {CELLS} SELECT page_id, round(count(*) / (152 * 92)::DOUBLE, 9) AS occupied FROM c GROUP BY page_id")
def occupancy_union(spark: SparkSession, sf: str) -> DataFrame:
    d = boxes(spark, sf).groupBy("page_id").agg(F.collect_list("b").alias("r"))
    return d.select("page_id", F.round(G.occupied_share(F.col("r"), F.lit(1216.0), F.lit(736.0)), 9).alias("occupied"))


@query(f"WITH {BOXES}, q AS (SELECT id, page_id, {uniform_sql('px', 'id')} * 1200 AS x, {uniform_sql('py', 'id')} * 720 AS y FROM boxes) SELECT q.id, CAST(count_if(q.x BETWEEN b.x0 AND b.x1 AND q.y BETWEEN b.y0 AND b.y1) AS BIGINT) AS closed, CAST(count_if(q.x >= b.x0 AND q.x < b.x1 AND q.y >= b.y0 AND q.y < b.y1) AS BIGINT) AS half_open FROM q JOIN boxes b USING (page_id) GROUP BY q.id")
def point_in_rect(spark: SparkSession, sf: str) -> DataFrame:
    d = boxes(spark, sf)
    q = d.select("page_id", F.col("id").alias("q"), (huniform("px", "id") * 1200).alias("x"), (huniform("py", "id") * 720).alias("y"))
    j = units.boxes_at(q, d)
    return j.groupBy(F.col("q").alias("id")).agg(F.count_if(G.inside(F.col("b"), F.col("x"), F.col("y"))).alias("closed"), F.count_if(G.contains(F.col("b"), F.col("x"), F.col("y"))).alias("half_open"))


#: Samples over the boxes of parts: one a part, its point anywhere on the page.
REGIONS = "CASE id % 5 WHEN 0 THEN 'neg_clear' WHEN 1 THEN 'special_table' WHEN 2 THEN 'chrome_head' WHEN 3 THEN 'neg_boundary' ELSE 'core' END"
NEGATIVES = f"""WITH {BOXES}, s AS (SELECT id, page_id, {REGIONS} AS region, id % 5 <> 4 AS neg, {uniform_sql('px', 'id')} * 1200 AS x, {uniform_sql('py', 'id')} * 720 AS y, CASE WHEN id % 10 = 1 THEN id ELSE -1 END AS special FROM boxes),
v AS (SELECT s.*, b.p_type AS md, EXISTS (SELECT 1 FROM boxes r WHERE r.page_id = s.page_id AND s.x BETWEEN r.x0 AND r.x1 AND s.y BETWEEN r.y0 AND r.y1) AS ink, CASE WHEN y <= 40 THEN 'head' WHEN y >= 690 THEN 'foot' END AS band FROM s LEFT JOIN boxes b ON b.id = s.special AND b.page_id = s.page_id),
w AS (SELECT *, CASE WHEN NOT neg THEN '' WHEN region LIKE 'special_%' AND md IS NULL THEN 'special_block_missing' WHEN region LIKE 'special_%' AND length(md) > 7 THEN 'special_prose' WHEN region LIKE 'neg_%' AND ink THEN 'clear_on_ink' WHEN region LIKE 'neg_%' AND band IS NOT NULL THEN 'clear_on_chrome' WHEN region LIKE 'chrome_%' AND band IS NULL THEN 'chrome_mislabel' ELSE '' END AS reason FROM v)"""


def _negatives(spark: SparkSession, sf: str) -> tuple[DataFrame, negatives.Rules]:
    d = boxes(spark, sf)
    page, pool = F.col("page_id").cast("string"), F.lit("p")
    blocks = d.select(pool.alias("pool_id"), page.alias("page_id"), F.col("id").cast("string").alias("id"), "b", F.col("p_type").alias("markdown"))
    blocks = blocks.select("pool_id", "page_id", "id", "markdown", F.col("b").alias("bbox"), F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>").alias("rects"))
    band = lambda pos, name, y0, y1: d.select(page.alias("page_id")).distinct().select(F.lit("p").alias("pool_id"), "page_id", F.lit(pos).alias("pos"), F.lit(name).alias("band"), F.struct(F.lit(0.0).alias("x0"), F.lit(y0).alias("y0"), F.lit(1300.0).alias("x1"), F.lit(y1).alias("y1")).alias("bbox"))
    bands = band(0, "head", 0.0, 40.0).unionByName(band(1, "foot", 690.0, 2000.0))
    point = F.struct((huniform("px", "id") * 1200).alias("x"), (huniform("py", "id") * 720).alias("y"))
    k = F.col("id") % 5
    region = F.when(k == 0, "neg_clear").when(k == 1, "special_table").when(k == 2, "chrome_head").when(k == 3, "neg_boundary").otherwise("core")
    special = F.when(F.col("id") % 10 == 1, F.col("id")).otherwise(-1).cast("string")
    s = d.select(F.col("id").alias("sample_id"), pool.alias("pool_id"), page.alias("page_id"), region.alias("region"), (k != 4).alias("is_negative"), F.when(k == 4, "text").otherwise("").alias("target"), point.alias("point"), special.alias("special_block_id"), F.lit(None).cast("double").alias("device_scale_factor"))
    return negatives.with_geometry(s, blocks, bands), negatives.Rules(most_chars=7)


@query(NEGATIVES + " SELECT reason, reason NOT IN ('', 'clear_on_chrome') AS drop, count(*) AS n FROM w GROUP BY ALL")
def negative_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows, rules = _negatives(spark, sf)
    return negatives.filtered(rows, rules)[1]


@query(NEGATIVES + " SELECT id AS sample_id, CASE WHEN reason = 'clear_on_chrome' THEN 'chrome_' || band ELSE region END AS region, reason = 'clear_on_chrome' AS region_relabeled FROM w WHERE reason IN ('', 'clear_on_chrome')")
def negative_relabel(spark: SparkSession, sf: str) -> DataFrame:
    rows, rules = _negatives(spark, sf)
    return negatives.filtered(rows, rules)[0].select("sample_id", "region", "region_relabeled")


RESIZE = """WITH s AS (SELECT p_partkey, p_size * 37.0::DOUBLE + 11 AS h, (p_partkey % 97) * 29.0::DOUBLE + 13 AS w FROM part),
r AS (SELECT *, greatest(28, round_even(h / 28, 0) * 28) AS h0, greatest(28, round_even(w / 28, 0) * 28) AS w0, sqrt(h * w / 1003520.0::DOUBLE) AS down, sqrt(200704.0::DOUBLE / (h * w)) AS up FROM s),
z AS (SELECT p_partkey, CASE WHEN h0 * w0 > 1003520 THEN greatest(28, floor(h / down / 28) * 28) WHEN h0 * w0 < 200704 THEN ceil(h * up / 28) * 28 ELSE h0 END AS rh, CASE WHEN h0 * w0 > 1003520 THEN greatest(28, floor(w / down / 28) * 28) WHEN h0 * w0 < 200704 THEN ceil(w * up / 28) * 28 ELSE w0 END AS rw FROM r)"""


@query(RESIZE + " SELECT p_partkey, CAST(rh AS INT) AS h, CAST(rw AS INT) AS w, CAST(floor(rh / 32) * floor(rw / 32) AS BIGINT) AS tokens FROM z")
def smart_resize(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_size") * 37.0 + 11).alias("h0"), ((F.col("p_partkey") % 97) * 29.0 + 13).alias("w0"))
    r = G.smart_resize(F.col("h0"), F.col("w0"), 200704, 1003520)
    return d.select("p_partkey", r["h"].alias("h"), r["w"].alias("w"), G.vision_tokens(F.col("h0"), F.col("w0"), 200704, 1003520).cast("bigint").alias("tokens"))


@query(f"WITH {BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, id) AS k, count(*) OVER (PARTITION BY page_id) AS n FROM boxes), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY (x1 - x0) * (y1 - y0) DESC, id) AS rn FROM o WHERE k > floor(n * 0.2)) SELECT page_id, id FROM r WHERE rn <= 3")
def spread_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return units.spread(boxes(spark, sf), 3).select("page_id", "id")


@query(f"WITH {BOXES} SELECT page_id, id % 4 AS group_id, md5(string_agg(p_name, chr(10) || chr(10) ORDER BY id)) AS markdown, count(*) AS n FROM boxes GROUP BY ALL HAVING bool_and(x1 <= 1150)")
def groups_in_frame(spark: SparkSession, sf: str) -> DataFrame:
    d = boxes(spark, sf)
    m = d.select("page_id", (F.col("id") % 4).alias("group_id"), F.col("id").alias("pos"), F.col("p_name").alias("markdown"), "b", (F.col("b.x1") <= 1150).alias("in_frame"))
    g = units.groups_in_frame(m)
    n = m.groupBy("page_id", "group_id").agg(F.count(F.lit(1)).alias("n"))
    return g.join(n, ["page_id", "group_id"]).select("page_id", "group_id", F.md5("markdown").alias("markdown"), "n")


@query(f"""WITH {BOXES}, r AS (SELECT page_id, id, x0, y0, x1, y1, CASE WHEN p_size % 3 = 0 THEN 'h' WHEN p_size % 3 = 1 THEN 'li' WHEN length(p_name) <= 120 AND y1 - y0 <= 48 THEN 'dek' END AS role FROM boxes), o AS (SELECT *, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(role) OVER w AS was FROM r WHERE role IS NOT NULL WINDOW w AS (PARTITION BY page_id ORDER BY y0, x0, CAST(id AS VARCHAR))),
l AS (SELECT *, coalesce(y0 - py1 BETWEEN 0 AND 36 AND (least(px1, x1) - greatest(px0, x0)) / least(px1 - px0, x1 - x0)::DOUBLE >= 0.35 AND CASE role WHEN 'li' THEN true WHEN 'dek' THEN was = 'h' ELSE was = 'dek' END, false) AS link FROM o), c AS (SELECT *, sum(CAST(NOT link AS INT)) OVER (PARTITION BY page_id ORDER BY y0, x0, CAST(id AS VARCHAR)) AS chain FROM l),
g AS (SELECT page_id, chain, count(*) AS n, bool_or(role = 'li') AS li, bool_or(role = 'h') AS h, bool_or(role = 'dek') AS dek, first(CAST(id AS VARCHAR) ORDER BY y0, x0, CAST(id AS VARCHAR)) AS cluster FROM c GROUP BY page_id, chain) SELECT CAST(page_id AS VARCHAR) AS page_id, CAST(id AS VARCHAR) AS id, cluster FROM c JOIN g USING (page_id, chain) WHERE n >= 2 AND (li OR (n = 2 AND h AND dek))""")
def short_clusters(spark: SparkSession, sf: str) -> DataFrame:
    d = boxes(spark, sf)
    tag = F.when(F.col("p_size") % 3 == 0, "h2").when(F.col("p_size") % 3 == 1, "li").otherwise("p")
    return units.clusters(d.select(F.col("page_id").cast("string"), F.col("id").cast("string").alias("id"), tag.alias("tag"), F.col("p_name").alias("markdown"), "b.x0", "b.y0", "b.x1", "b.y1"))
