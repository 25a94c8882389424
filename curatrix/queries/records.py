"""Rows rewritten, joined, mixed and written: files go to the shared folder and are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import geometry as G
from ..functions import html as H
from ..functions import records as R
from ..functions import text as X
from ..functions.keys import huniform
from ..operators import annotations, documents, metrics, mixing, negatives, pages, pairs, quota, selection, split, units
from ..plans import stage
from ..session import shared_folder, spread
from ..sources import samples as S
from .base import BOXES, SAMPLES, TURNS, boxes, key_sql, norm_sql, query, samples, similarity_sql, strip_sql, t, turns, uniform_sql
from .shapes import _negatives

# Orders and mixes.


@query(f"""WITH a AS (SELECT doc_id, CAST(floor(doc_id / 20) AS BIGINT) * 20 + row_number() OVER (PARTITION BY CAST(floor(doc_id / 20) AS BIGINT) ORDER BY {key_sql("41a", "doc_id")}, doc_id) - 1 AS p FROM documents), b AS (SELECT *, CAST(floor((p + 10) / 20) AS BIGINT) AS w FROM a)
SELECT doc_id, greatest(0, w * 20 - 10) + row_number() OVER (PARTITION BY w ORDER BY {key_sql("41b", "doc_id")}, doc_id) - 1 AS ord FROM b""")
def overlapping_windows(spark: SparkSession, sf: str) -> DataFrame:
    """A local shuffle over windows that overlap by half."""
    return mixing.overlapping(t(spark, sf, "documents").select("doc_id"), "doc_id", "doc_id", 20, 41)


ROUNDS = f"r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY {key_sql(42, 'doc_id')}, doc_id) AS rn FROM (SELECT doc_id, concat_ws('|', lang, source) AS s FROM documents))"


@query(f"""WITH {ROUNDS}, o AS (SELECT *, lpad(CAST(rn AS VARCHAR), 12, '0') || '|' || md5(concat_ws('|', '42', CAST(rn AS VARCHAR), s)) AS o FROM r), n AS (SELECT greatest(8, count(*) // 50) AS w FROM documents), q AS (SELECT doc_id, row_number() OVER (ORDER BY o, doc_id) - 1 AS p, w FROM o, n),
a AS (SELECT *, CAST(floor(p / w) AS BIGINT) * w + row_number() OVER (PARTITION BY CAST(floor(p / w) AS BIGINT) ORDER BY {key_sql("42a", "doc_id")}, doc_id) - 1 AS f FROM q), b AS (SELECT *, CAST(floor((f + w // 2) / w) AS BIGINT) AS g FROM a)
SELECT doc_id, greatest(0, g * w - w // 2) + row_number() OVER (PARTITION BY g ORDER BY {key_sql("42b", "doc_id")}, doc_id) - 1 AS ord FROM b""")
def two_level_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds over slices and templates, then a local shuffle."""
    d = t(spark, sf, "documents").select("doc_id", "lang", "source")
    return mixing.interleaved_locally(d, ["lang", "source"], "doc_id", 42, d.count()).select("doc_id", "ord")


@query(f"""WITH {SAMPLES}, h AS (SELECT sample_id, page_id, chrome, {key_sql(43, 'sample_id')} AS h, row_number() OVER (PARTITION BY chrome, page_id ORDER BY {key_sql(43, 'sample_id')}, sample_id) > 1 AS again FROM samples WHERE pool_id = 'fr'), r AS (SELECT *, row_number() OVER (PARTITION BY chrome ORDER BY again, h, sample_id) AS rn FROM h),
n AS (SELECT count_if(chrome = 'chrome') AS a, count_if(chrome <> 'chrome') AS b FROM h), q AS (SELECT a, b, least(a, 27) AS wa, least(b, 60 - least(a, 27)) AS wb FROM n), z AS (SELECT CASE WHEN 60 - wa - wb > 0 AND a - wa >= 60 - wa - wb THEN 60 - wb ELSE wa END AS wa, CASE WHEN 60 - wa - wb > 0 AND a - wa < 60 - wa - wb THEN least(b, 60 - wa) ELSE wb END AS wb FROM q)
SELECT sample_id, page_id, chrome FROM r, z WHERE rn <= CASE WHEN chrome = 'chrome' THEN wa ELSE wb END""")
def chrome_page_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of distinct pages first, with a share of pages in a window."""
    d = samples(spark, sf).filter("pool_id = 'fr'").select("sample_id", "page_id", "chrome")
    return selection.by_chrome(d, "chrome", 0.45, "page_id", 60, "sample_id", 43)


@query()
def scene_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes by their shares, real rows first, empty ones by pools, shortfalls made up."""
    d = samples(spark, sf).withColumn("scene", F.when(F.col("doc_id") % 4 == 0, "empty").when(F.col("pool_id") == "de", "semantic_group").when(F.col("pool_id") == "fr", "multi_frag"))
    d = d.withColumn("pool", F.when(F.col("doc_id") % 3 == 0, "empty_clear").otherwise("chrome_empty")).select("sample_id", "page_id", "scene", "pool", (F.col("template_stem") == "src2").alias("real"))
    return selection.scene_mix(d, "scene", {"empty": 0.4, "semantic_group": 0.3, "multi_frag": 0.3}, 200, "page_id", "sample_id", 44, "pool", {"empty_clear": 0.7, "chrome_empty": 0.3}, F.col("real")).select("sample_id", "scene", "pool", "real")


@query(f"""WITH q(f, n) AS (VALUES ('2-HIGH', 2500), ('5-LOW', 1200), ('1-URGENT', 9000)), r AS (SELECT o_orderkey AS k, o_orderpriority AS slice, n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {key_sql(45, 'o_orderkey')}, o_orderkey) AS rn FROM orders JOIN q ON o_orderpriority = f), c AS (SELECT k, slice FROM r WHERE rn <= n)
SELECT k, slice, row_number() OVER (ORDER BY {key_sql("45t", 'k')}, k) AS turn FROM c""")
def scheduled_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Quotas of thousands, one larger than its slice, in the order in which a scheduler by deficit would make them."""
    d = t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("slice"))
    return selection.scheduled(d, "slice", {"2-HIGH": 2500, "5-LOW": 1200, "1-URGENT": 9000}, "k", 45).select("k", "slice", "turn")


@query(f"WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY {key_sql(46, 'doc_id')}, doc_id) AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN rn <= floor(n * 0.8 + 1e-9) THEN 'train' WHEN rn <= floor(n * 0.8 + 1e-9) + floor(n * 0.1 + 1e-9) THEN 'val' ELSE 'test' END AS split, {key_sql(46, 'doc_id')} AS ord FROM d")
def split_plain(spark: SparkSession, sf: str) -> DataFrame:
    """One shuffle of the whole table, cut in three; beside it the order of a stage, pools in proportion to what is left of them."""
    d = split.truncated(t(spark, sf, "documents").select("doc_id"), [], "doc_id", 0.8, 0.1, 46)
    return mixing.proportional(d, "doc_id", 46).select("doc_id", "split", "ord")


@query(f"""WITH d AS (SELECT DISTINCT {strip_sql('text')} AS text FROM conversations WHERE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 2), o AS (SELECT text FROM d ORDER BY {key_sql(47, 'text')}, text LIMIT 400) SELECT md5(text) AS text FROM o""")
def latin_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct texts in Latin letters, a bounded sample of them."""
    d = t(spark, sf, "conversations").filter(F.regexp_count("text", F.lit(X.LATIN)) >= 2).select(X.strip(F.col("text")).alias("text")).distinct()
    return units.in_hash_order(d, "text", 47).limit(400).select(F.md5("text").alias("text"))


@query(f"WITH p AS (SELECT page_id, row_number() OVER (ORDER BY {key_sql(0, 'page_id')}, page_id) AS i, count(*) OVER () AS n FROM pages), r AS (SELECT unnest(range(0, 4)) AS round) SELECT page_id, CAST(round AS INT) AS round FROM p, r WHERE round * n + i <= CAST(floor(2.6 * n) AS BIGINT)")
def expanded_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages in rounds up to a number of rows."""
    d = t(spark, sf, "pages").select("page_id")
    return selection.expanded_rounds(d, int(2.6 * d.count()), "page_id")


# Variants of the same rows.

VARIANTS = f"""{TURNS}, x AS (SELECT sample_id, role, is_negative, turn, target, prediction_raw FROM turns), v AS (SELECT sample_id, role, 'plain' AS variant, target, {strip_sql("split_part(prediction_raw, '<|im_e', 1)")} AS prediction FROM x UNION ALL SELECT sample_id, role, 'short', target, CASE WHEN turn % 2 = 0 THEN target ELSE left(target, 10) END FROM x WHERE turn < 5),
s AS (SELECT *, {similarity_sql('prediction', 'target')} AS raw, {norm_sql('prediction')} AS p, {norm_sql('target')} AS g FROM v)"""


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    d = turns(spark, sf)
    plain = d.select("sample_id", "role", F.lit("plain").alias("variant"), "target", X.strip_format_leak(F.col("prediction_raw")).alias("prediction"))
    short = d.filter("turn < 5").select("sample_id", "role", F.lit("short").alias("variant"), "target", F.when(F.col("turn") % 2 == 0, F.col("target")).otherwise(F.left("target", F.lit(10))).alias("prediction"))
    return metrics.row_scores(plain.unionByName(short))


@query(f"WITH {VARIANTS} SELECT a.sample_id, a.g = '' AS gt_empty, a.raw >= 0.85 AS hit_a, b.raw >= 0.85 AS hit_b, a.p = b.p AS agree, a.raw < 0.85 AND b.raw >= 0.85 AS improved, a.raw >= 0.85 AND b.raw < 0.85 AS regressed FROM s a JOIN s b USING (sample_id) WHERE a.variant = 'plain' AND b.variant = 'short'")
def variant_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Two variants of the same rows: whether they agree, and which is better."""
    return metrics.paired_variants(_variants(spark, sf), "sample_id", "plain", "short")


@query(f"WITH {VARIANTS} SELECT role, variant, CAST(grouping(role, variant) AS BIGINT) AS gid, count(*) AS n, round(avg(CAST(raw >= 0.85 AS INT)), 4)::DOUBLE AS hit_rate, round(avg(round(raw, 4)), 4)::DOUBLE AS mean_sim, round(avg(CAST(p = '' AS INT)), 4)::DOUBLE AS empty_rate, CAST(count_if(g <> '') AS BIGINT) AS n_pos, round(avg(CASE WHEN g <> '' THEN CAST(raw >= 0.85 AS INT) END), 4)::DOUBLE AS pos_hit_rate, round(avg(CASE WHEN g = '' THEN CAST(p = '' AS INT) END), 4)::DOUBLE AS neg_empty_rate FROM s GROUP BY GROUPING SETS ((variant), (role, variant))")
def variant_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rates by variant, and by pool and variant."""
    return metrics.variant_rates(_variants(spark, sf), "role")


# Fields of records.


@query("""SELECT p_partkey, p_brand AS brand, CASE WHEN p_partkey % 3 = 0 THEN 'size ' || p_size ELSE p_type END AS kind, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS size, p_name || '/' || p_brand AS pairs FROM part""")
def merged_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Maps of which the later wins by key, null ones empty; arrays paired by position."""
    row = F.create_map(F.lit("brand"), F.lit("x"), F.lit("kind"), "p_type")
    own = F.create_map(F.lit("brand"), "p_brand")
    more = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("kind"), F.concat(F.lit("size "), F.col("p_size").cast("string"))))
    size = F.when(F.col("p_partkey") % 5 != 0, F.create_map(F.lit("size"), F.col("p_size").cast("string")))
    d = t(spark, sf, "part").select("p_partkey", R.merged(row, own, more, size).alias("m"), R.zipped(F.array("p_name"), F.array("p_brand")).alias("z"))
    return d.select("p_partkey", F.col("m")["brand"].alias("brand"), F.col("m")["kind"].alias("kind"), F.try_element_at("m", F.lit("size")).alias("size"), F.concat(F.col("z")[0]["a"], F.lit("/"), F.col("z")[0]["b"]).alias("pairs"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'page' ELSE c_mktsegment END AS layout, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 0.5::DOUBLE END AS marker_area_frac, 'p' || c_nationkey AS page, 'stage_x' AS stage, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS translation FROM customer")
def stamped_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Fields that rows lack, from their page; the marker's size stays as it is."""
    own = lambda k, v: F.when(F.col("c_custkey") % k != 0, v)
    d = t(spark, sf, "customer").select("c_custkey", own(3, F.col("c_mktsegment")).alias("layout"), own(2, F.lit(0.5)).alias("marker_area_frac"), "c_nationkey", "c_name")
    d = R.stamped(d, {"layout": F.lit("page"), "marker_area_frac": F.lit(9.0), "page": F.concat(F.lit("p"), F.col("c_nationkey").cast("string")), "stage": F.lit("stage_x"), "translation": F.when(F.col("c_custkey") % 4 == 0, F.col("c_name"))})
    return d.drop("c_nationkey", "c_name")


@query(r"""WITH x AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '"D:\Data\' || c_name || '"' WHEN 1 THEN ' /srv/' || c_name || ' ' WHEN 2 THEN 'rel\' || c_name WHEN 3 THEN '  ' ELSE '''c:/x''' END AS raw FROM customer)
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '/mnt/d/Data/' || substr(raw, 10, length(raw) - 10) WHEN 1 THEN trim(raw) WHEN 2 THEN replace(raw, '\', '/') WHEN 3 THEN NULL ELSE '/mnt/c/x' END AS folder FROM x""")
def folders(spark: SparkSession, sf: str) -> DataFrame:
    """Folders as typed on several systems."""
    k, n = F.col("c_custkey") % 5, F.col("c_name")
    raw = F.when(k == 0, F.concat(F.lit('"D:\\Data\\'), n, F.lit('"'))).when(k == 1, F.concat(F.lit(" /srv/"), n, F.lit(" "))).when(k == 2, F.concat(F.lit("rel\\"), n)).when(k == 3, "  ").otherwise("'c:/x'")
    return t(spark, sf, "customer").select("c_custkey", R.directory(raw).alias("folder"))


@query("SELECT conv_id, turn, md5(CASE WHEN turn % 4 = 2 THEN text || text ELSE text END) AS said FROM conversations")
def completions(spark: SparkSession, sf: str) -> DataFrame:
    """Completions that are texts, objects, lists and lists of lists."""
    x, k = F.col("text"), F.col("turn") % 4
    part = F.to_json(F.struct(F.lit("text").alias("type"), x.alias("text")))
    obj = F.concat(F.lit('{"role":"assistant","content":['), part, F.lit("]}"))
    raw = F.when(k == 0, x).when(k == 1, obj).when(k == 2, F.concat(F.lit("[["), obj, F.lit("],"), part, F.lit("]"))).otherwise(F.concat(F.lit('{"content":'), obj, F.lit("}")))
    return t(spark, sf, "conversations").select("conv_id", "turn", F.md5(R.completion_text(raw)).alias("said"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a' WHEN p_partkey % 3 = 0 THEN 'b' ELSE 'c' END || p_partkey AS path FROM part")
def render_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The first candidate path that exists."""
    k = F.col("p_partkey").cast("string")
    of = lambda c: F.concat(F.lit(c), k)
    none = F.array().cast("array<string>")
    known = F.concat(F.array(of("c")), F.when(F.col("p_partkey") % 2 == 0, F.array(of("a"))).otherwise(none), F.when(F.col("p_partkey") % 3 == 0, F.array(of("b"))).otherwise(none))
    return t(spark, sf, "part").select("p_partkey", R.first_of_candidates(of("a"), of("b"), of("c"), known=known).alias("path"))


@query(f"WITH {BOXES} SELECT id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, id) AS INT) AS place FROM boxes")
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes from top to bottom, then left to right."""
    b = F.col("b")
    key = R.reading_key(F.array(b["x0"], b["y0"], b["x1"], b["y1"]))
    return boxes(spark, sf).select("id", F.row_number().over(Window.partitionBy("page_id").orderBy(key, "id")).alias("place"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY event_type")
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "events")
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct(F.to_date("ts")).alias("days"))


@query("""SELECT c_custkey, '/out/' || CASE WHEN c_custkey % 4 = 0 THEN 'misc' ELSE 'pool' END || '/' || replace(c_name, '#', '_') || '__a' || CASE WHEN c_custkey % 2 = 0 THEN '0p5' ELSE '1' END || '.jpg' AS image, 'x45' AS marker, CASE WHEN c_custkey % 2 = 0 THEN 0.0025 ELSE 0.005 END::DOUBLE AS share, 'src' || c_nationkey AS source, CAST(7 + 31 * CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_nationkey END AS INT) AS noise FROM customer""")
def remade_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Samples whose markers are made anew: places, scales, shares and seeds of noise."""
    meta = F.struct(F.col("c_name").alias("sample_id"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise("pool").alias("pool_id"), F.when(F.col("c_custkey") % 3 == 0, "page").otherwise(F.concat(F.lit("page__"), F.col("c_nationkey").cast("string"))).alias("page_id"))
    d = t(spark, sf, "customer").select("c_custkey", meta.alias("metadata"), F.array(F.concat(F.lit("src"), F.col("c_nationkey").cast("string"))).alias("images"))
    d = stage.remarked(d, F.when(F.col("c_custkey") % 2 == 0, 0.5).otherwise(1.0), "/out/", "x45", 7)
    return d.select("c_custkey", F.col("images")[0].alias("image"), "metadata.marker", F.col("metadata.marker_area_frac").alias("share"), F.col("marker_source_render").alias("source"), F.col("noise_seed").alias("noise"))


# Files.


def _chat(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as samples, some with images."""
    d = t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    messages = F.transform(F.slice("m", F.lit(1), (F.col("conv_id") % 7 + 1).cast("int")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    images = F.when(F.col("conv_id") % 3 == 0, F.array(F.concat(F.lit("img"), F.col("conv_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    return d.select("conv_id", messages.alias("messages"), images.alias("images"), F.struct(F.col("conv_id").cast("string").alias("sample_id"), F.lit("pool").alias("pool_id")).alias("metadata"))


CHAT = "d AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn)[1 : conv_id % 7 + 1] AS m FROM conversations GROUP BY conv_id)"


@query(f"WITH {CHAT} SELECT conv_id, len(m) AS n, md5(m[1].t) AS first, CAST(conv_id % 3 = 0 AS INT) + 1 AS n_parts FROM d WHERE len(m) >= 2 AND NOT (conv_id % 3 = 0 AND conv_id % 2 = 1)")
def chat_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Chat rows as parts: those of one message, or with an image that is not there, are dropped."""
    d = _chat(spark, sf)
    present = d.select(F.explode("images").alias("path"), (F.col("conv_id") % 2 == 0).alias("present"))
    d = S.trainable(d.withColumn("messages", F.transform("messages", lambda m, i: F.struct(F.when(i == 0, "user").otherwise(m["role"]).alias("role"), m["content"].alias("content")))), present)
    first = F.col("messages")[0]["content"]
    return d.select("conv_id", F.size("messages").cast("bigint").alias("n"), F.md5(F.element_at(first, -1)["text"]).alias("first"), F.size(first).alias("n_parts"))


@query(f"WITH {CHAT} SELECT CAST(conv_id AS VARCHAR) AS sample_id, 'pool' AS pool_id, len(m) AS n, md5(coalesce(list_filter(m, lambda x: x.r = 'assistant')[1].t, '')) AS target FROM d")
def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Samples written as JSON lines, read back with the explicit schema."""
    folder = shared_folder(spark, "jsonl")
    _chat(spark, sf).drop("conv_id").write.json(f"{folder}/lines")
    d = S.target_text(S.read_jsonl(spark, f"{folder}/lines"))
    return d.select("metadata.sample_id", "metadata.pool_id", F.size("messages").cast("bigint").alias("n"), F.md5(F.coalesce("target", F.lit(""))).alias("target"))


@query("SELECT c_mktsegment AS pool_id, count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS total FROM customer WHERE c_nationkey <> 3 GROUP BY c_mktsegment")
def malformed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written by pool, with malformed lines between, read back and counted."""
    folder = shared_folder(spark, "pools")
    d = t(spark, sf, "customer").select(F.col("c_mktsegment").alias("pool_id"), "c_nationkey")
    line = F.when(F.col("c_nationkey") == 3, "{broken").otherwise(F.to_json(F.struct("c_nationkey", F.col("pool_id").alias("pool"))))
    d.select("pool_id", line.alias("value")).write.partitionBy("pool_id").text(f"{folder}/text")
    back = S.read_jsonl(spark, f"{folder}/text", "pool STRING, c_nationkey BIGINT", "drop")
    return back.groupBy(F.col("pool").alias("pool_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_nationkey").alias("total"))


@query("SELECT o_orderstatus AS split, o_orderpriority AS pool_id, count(*) AS n FROM orders GROUP BY ALL")
def counted_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Splits written by split and pool, and counts of what was written."""
    d = t(spark, sf, "orders").select(F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("pool_id"), "o_orderkey")
    return S.write_counted(d, f"{shared_folder(spark, 'splits')}/t", ["split", "pool_id"])


@query(f"WITH {BOXES} SELECT CAST(page_id AS VARCHAR) AS page_id, count(*) AS n, CAST(count_if(x1 - x0 >= 60) AS BIGINT) AS n_rects, CAST(max(x1) AS DOUBLE) AS right_end FROM boxes GROUP BY page_id")
def page_block_files(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks written as an array a page, read back without narrow rectangles."""
    folder = shared_folder(spark, "blocks")
    b = F.col("b")
    side = F.array(b["x0"], b["y0"], F.when(b["x1"] - b["x0"] >= 60, b["x1"]).otherwise(b["x0"] + 1.0), b["y1"])
    d = boxes(spark, sf).select(F.col("page_id").cast("string").alias("page_id"), F.col("id").cast("string").alias("id"), F.array(b["x0"], b["y0"], b["x1"], b["y1"]).alias("bbox"), F.array(side).alias("rects"), F.lit("p").alias("tag"))
    S.write_blocks(d, folder + "/pages")
    back = S.read_page_blocks(spark, f"{folder}/pages/*/*")
    return back.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("rects")).alias("n_rects"), F.max(F.col("bbox")[2]).alias("right_end"))


@query("WITH o AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) - 1 AS line FROM orders) SELECT line, 'k' || o_orderkey AS en, o_orderpriority AS zh FROM o")
def bitext_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Two folders of parallel lines, joined by line number."""
    folder = shared_folder(spark, "bitext")
    d = t(spark, sf, "orders").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey")
    d.select(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("value")).write.text(f"{folder}/left")
    d.select(F.col("o_orderpriority").alias("value")).write.text(f"{folder}/right")
    return S.read_bitext(spark, f"{folder}/left", f"{folder}/right")


SCREENS = "s AS (SELECT p_partkey AS k, p_size * 20 + 100 AS width, p_partkey % 50 * 20 + 200 AS height, CASE p_partkey % 4 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' WHEN 2 THEN '' ELSE 'tablet' END AS viewport, p_partkey % 6 AS c FROM part)"


@query(f"""WITH {SCREENS}, a AS (SELECT 'screens' AS kind, k FROM s WHERE least(width, height) >= 400 AND c <> 0 ORDER BY k LIMIT 40), w AS (SELECT *, row_number() OVER (ORDER BY k) AS i FROM s), x AS (SELECT * FROM w WHERE i <= 800), y AS (SELECT *, coalesce(sum(CAST(viewport IN ('', 'desktop') AND least(width, height) >= 300 AS INT)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x),
b AS (SELECT 'web', k FROM y WHERE least(width, height) >= 300 AND (viewport IN ('', 'desktop') OR before >= 20) ORDER BY k LIMIT 40), c AS (SELECT 'laid', k FROM s WHERE c > 1 ORDER BY k LIMIT 40) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def gallery_scans(spark: SparkSession, sf: str) -> DataFrame:
    """First screens with text, first pages with desktops preferred, first layouts with cells."""
    k, c = F.col("p_partkey"), F.col("p_partkey") % 6
    empty = F.array().cast("array<int>")
    cells = F.transform(F.sequence(F.lit(0), c.cast("int")), lambda i: F.when(i > 1, F.array(i)).otherwise(empty))
    texts = F.when(c == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit(""), F.col("p_name")))
    viewport = F.when(k % 4 == 0, "desktop").when(k % 4 == 1, "mobile").when(k % 4 == 2, "").otherwise("tablet")
    d = t(spark, sf, "part").select(k.alias("k"), (F.col("p_size") * 20 + 100).alias("width"), (k % 50 * 20 + 200).alias("height"), viewport.alias("viewport"), texts.alias("texts"), cells.alias("cells"))
    of = lambda kind, x: x.select(F.lit(kind).alias("kind"), "k")
    return of("screens", S.screens(d, 40, "k")).unionByName(of("web", S.web_pages(d, 40, "k"))).unionByName(of("laid", S.laid_out(d, 40, "k")))


# Pages.


@query(f"""WITH {BOXES}, p AS (SELECT id, page_id, {uniform_sql('px', 'id')} * 1200 AS x, {uniform_sql('py', 'id')} * 720 AS y FROM boxes)
SELECT id AS sample_id, y <= 40 OR y >= 690 OR EXISTS (SELECT 1 FROM boxes r WHERE r.page_id = p.page_id AND p.x BETWEEN r.x0 AND r.x1 AND p.y BETWEEN r.y0 AND r.y1) AS taken FROM p""")
def taken_points(spark: SparkSession, sf: str) -> DataFrame:
    """Whether points are on text or on page furniture."""
    rows, _ = _negatives(spark, sf)
    return rows.select("sample_id", negatives.on_ink_or_chrome(F.col("point.x"), F.col("point.y")).alias("taken"))


@query(f"""WITH {BOXES} SELECT id, CAST(greatest(0, x0 - 2) AS INT) AS x0, CAST(greatest(0, y0 - 2) AS INT) AS y0, CAST(least(900, x1 + 2) AS INT) AS x1, CAST(least(500, y1 + 2) AS INT) AS y1 FROM boxes WHERE least(900, x1 + 2) > greatest(0, x0 - 2) AND least(500, y1 + 2) > greatest(0, y0 - 2)""")
def detected_crops(spark: SparkSession, sf: str) -> DataFrame:
    """Crops around detections, within the image."""
    b = F.col("b")
    d = boxes(spark, sf).select("id", F.array(b["x0"] + 0.4, b["y0"] + 0.4, b["x1"] + 0.4, b["y1"] + 0.4).alias("bbox"))
    return documents.detected(d, F.lit(900), F.lit(500)).select("id", "crop.x0", "crop.y0", "crop.x1", "crop.y1")


@query(f"""WITH {BOXES}, s AS (SELECT page_id, id, p_type, p_size FROM boxes WHERE id % 3 <> 0)
SELECT b.id, round((b.x1 - b.x0) * 0.25, 6)::DOUBLE AS w, CASE WHEN s.id IS NOT NULL AND s.p_size % 5 <> 0 THEN s.p_type ELSE b.p_name END AS markdown, CASE WHEN s.id IS NOT NULL THEN 'zh' || s.p_size END AS translation FROM boxes b LEFT JOIN s ON b.page_id = s.page_id AND b.id = s.id WHERE (b.x1 - b.x0) * 0.25 >= 8 AND (b.y1 - b.y0) * 0.25 >= 8""")
def dom_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """DOM blocks in image pixels, with the source's text where it has one."""
    d = boxes(spark, sf)
    b = F.col("b")
    at0 = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (b["x1"] - b["x0"]).alias("x1"), (b["y1"] - b["y0"]).alias("y1"))
    source = d.filter("id % 3 <> 0").select("page_id", "id", F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_type")).alias("markdown"), F.concat(F.lit("zh"), F.col("p_size").cast("string")).alias("translation"))
    found = documents.dom_annotations(d.select("page_id", "id", at0.alias("rect"), F.col("p_name").alias("text")), source, F.lit(0.25), 8.0)
    return found.select("id", F.round(G.width(F.col("bbox")), 6).alias("w"), "markdown", "translation")


@query(f"""WITH {BOXES}, a AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN 'u' || (id % 4) ELSE 'box' || (id - page_id * 40) END AS unit, CASE WHEN p_size % 4 = 0 THEN '  ' ELSE p_name || id END AS text, p_size % 10 = 0 AS manual FROM boxes WHERE least(x1, 1000) - least(x0, 1000) >= 4 AND least(y1, 600) - least(y0, 600) >= 4),
g AS (SELECT page_id, unit, count(*) AS n, coalesce(bool_or(manual AND trim(text) <> ''), false) AS manual, list_filter(list(CASE WHEN trim(text) <> '' THEN text END ORDER BY y0, x0, id), lambda x: x IS NOT NULL) AS texts, list_filter(list(CASE WHEN manual AND trim(text) <> '' THEN text END ORDER BY y0, x0, id), lambda x: x IS NOT NULL) AS hand FROM a GROUP BY page_id, unit)
SELECT page_id, unit AS unit_id, n > 1 AS multi, manual, CASE WHEN manual THEN hand[1] ELSE coalesce(array_to_string(texts, chr(10) || chr(10)), '') END AS text FROM g""")
def annotation_units(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled boxes joined to units, texts in reading order; those set by hand count first."""
    d = boxes(spark, sf)
    pos = F.col("id") - F.col("page_id") * 40
    unit = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("u"), (F.col("id") % 4).cast("string"))).otherwise(F.concat(F.lit("box"), pos.cast("string")))
    text = F.when(F.col("p_size") % 4 == 0, "  ").otherwise(F.concat("p_name", F.col("id").cast("string")))
    one = F.struct(F.array(*[F.col(f"b.{k}").cast("int") for k in ("x0", "y0", "x1", "y1")]).alias("bbox"), text.alias("text"), (F.col("p_size") % 10 == 0).alias("manual"), unit.alias("unit_id"))
    ann = d.groupBy(F.col("page_id").alias("source_path")).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("o"), one.alias("x")))), lambda c: c["x"]).alias("boxes")).withColumn("image_wh", F.array(F.lit(1000), F.lit(600)))
    return annotations.units(ann).select(F.col("source_path").alias("page_id"), "unit_id", "multi", "manual", "text")


@query()
def page_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Pages to rows of all pools."""
    d = boxes(spark, sf)
    rects = F.when(F.col("id") % 7 == 0, F.array("b", G.box(F.col("b.x0"), F.col("b.y1"), F.col("b.x1"), F.col("b.y1") + 20))).otherwise(F.array("b"))
    unknown = F.lit(None).cast("double")
    blocks = d.select("page_id", "id", "b", rects.alias("rects"), F.lit("p").alias("tag"), F.when(F.col("id") % 11 == 0, "table").otherwise("text").alias("kind"), F.concat_ws(" ", "p_name", "p_type", F.col("id").cast("string"), F.lit("of this page")).alias("markdown"), unknown.alias("visible_frac"), unknown.alias("in_viewport_frac"))
    pages_ = d.select("page_id").distinct().withColumns({"w": F.lit(1216.0), "h": F.lit(736.0)})
    band = lambda name, y0, y1: pages_.select("page_id", F.lit(name).alias("band"), G.box(F.lit(0), F.lit(y0), F.lit(1216), F.lit(y1)).alias("b"))
    groups = d.filter("id % 5 = 0").select("page_id", (F.col("id") % 15).alias("group_id"), "id", F.col("id").alias("pos"))
    out = pages.samples(pages_, blocks, band("head", 0, 40).unionByName(band("foot", 700, 736)), d.filter("id % 13 = 0").select("page_id", "id"), groups, 51)
    return out.select("sample_id", "pool_id", "page_id", "region", "is_negative", F.md5("target").alias("target"))


@query(f"""WITH p AS (SELECT page_id, html, {uniform_sql('61', 'page_id')} AS u, '<p data-block-id="extra_p0">a &lt; b</p><p data-block-id="extra_p1">c</p>' AS ps FROM pages), s AS (SELECT *, ps || CASE WHEN u < 0.7 THEN '<h2 data-block-id="extra_h">More</h2><p data-block-id="extra_h_p0">d</p><p data-block-id="extra_h_p1">e</p>' ELSE '' END AS snippet,
 CASE WHEN contains(lower(html), '</article>') THEN strpos(lower(html), '</article>') WHEN contains(lower(html), '</main>') THEN strpos(lower(html), '</main>') WHEN contains(lower(html), '</body>') THEN strpos(lower(html), '</body>') ELSE length(html) + 1 END AS place FROM p) SELECT page_id, md5(left(html, place - 1) || snippet || substr(html, place)) AS filled FROM s""")
def page_filler(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs and, on seven of ten pages, a heading with two more, at the end of a page's main part."""
    listed = lambda *x: F.array(*map(F.lit, x))
    return t(spark, sf, "pages").select("page_id", F.md5(H.with_filler(F.col("html"), listed("a < b", "c"), F.lit("More"), listed("d", "e"), huniform("61", "page_id"))).alias("filled"))


@query("""WITH m(mix, slice, share, i) AS (VALUES ('a1_v2', 'long_center', 0.82, 0), ('a1_v2', 'empty_neg', 0.18, 1), ('a2', 'replay', 0.22, 0), ('a2', 'adjacency', 0.14, 1), ('a2', 'multi_frag', 0.10, 2), ('a2', 'semantic_group', 0.14, 3), ('a2', 'corner_extreme', 0.06, 4), ('a2', 'special', 0.12, 5), ('a2', 'desktop', 0.14, 6), ('a2', 'near_edge', 0.08, 7),
 ('a2_v2', 'replay_long', 0.24, 0), ('a2_v2', 'adjacency', 0.16, 1), ('a2_v2', 'multi_frag', 0.16, 2), ('a2_v2', 'semantic_group', 0.20, 3), ('a2_v2', 'corner_extreme', 0.12, 4), ('a2_v2', 'empty_neg', 0.10, 5), ('a2_v2', 'special_light', 0.02, 6)), n AS (SELECT count(*) AS n FROM orders),
e AS (SELECT *, share::DOUBLE * n AS exact FROM m, n), b AS (SELECT *, floor(exact + 1e-9) AS base FROM e) SELECT mix, slice, CAST(base + CAST(row_number() OVER (PARTITION BY mix ORDER BY round(exact - base, 9) DESC, i) <= n - sum(base) OVER (PARTITION BY mix) AS INT) AS BIGINT) AS n FROM b""")
def curriculum_quotas(spark: SparkSession, sf: str) -> DataFrame:
    """The curricula's slices of as many rows as there are orders."""
    n = t(spark, sf, "orders").count()
    return spark.createDataFrame([(m, k, v) for m, mix in quota.MIXES.items() for k, v in quota.largest_remainder(mix, n).items()], "mix string, slice string, n long")


@query()
def parsed_by_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The registered table function, from SQL."""
    documents.register(spark)
    spread(t(spark, sf, "pages").select("page_id", "html")).createOrReplaceTempView("pages_to_parse")
    return spark.sql("SELECT p.page_id, b.pos, b.id, b.tag, md5(b.markdown) AS markdown FROM pages_to_parse p, LATERAL parse_blocks(p.html) b")


# Joins.


@query("""WITH p AS (SELECT conv_id, min_by(role, turn) AS scene FROM conversations GROUP BY conv_id), s AS (SELECT doc_id, lang, source FROM documents)
SELECT conv_id AS sample_id, coalesce(CASE WHEN conv_id % 3 = 0 THEN lang END, scene) AS scene, coalesce(source, '') AS stem, doc_id IS NULL AS unmatched FROM p LEFT JOIN s ON conv_id = doc_id""")
def probe_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Probe rows with the metadata of their samples: the sample's scene before the probe's own, none where there is no sample."""
    p = t(spark, sf, "conversations").groupBy(F.col("conv_id").alias("sample_id")).agg(F.min_by("role", "turn").alias("scene"))
    s = t(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("own"), F.col("source").alias("stem"), F.lit(True).alias("found"))
    d = p.join(s, "sample_id", "left")
    return d.select("sample_id", F.coalesce("own", "scene").alias("scene"), F.coalesce("stem", F.lit("")).alias("stem"), F.col("found").isNull().alias("unmatched"))


@query("""WITH m AS (SELECT text, min(conv_id) AS zh FROM conversations WHERE conv_id % 2 = 0 GROUP BY text) SELECT c.conv_id, c.turn, m.zh IS NOT NULL AS translated, CASE WHEN m.zh IS NOT NULL THEN 'zh' || m.zh END AS translation FROM conversations c LEFT JOIN m USING (text)""")
def translated_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with the translation of exactly their text, where there is one."""
    d = t(spark, sf, "conversations")
    m = d.filter("conv_id % 2 = 0").groupBy("text").agg(F.concat(F.lit("zh"), F.min("conv_id").cast("string")).alias("translation"))
    return d.join(m, "text", "left").select("conv_id", "turn", F.col("translation").isNotNull().alias("translated"), "translation")


@query()
def filled_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Slots of pages filled with pairs, no text twice on a page or, while they last, on two pages."""
    d = t(spark, sf, "conversations").select(X.clean_pair_text(F.col("text")).alias("en"), "conv_id")
    p = d.withColumn("bucket", C.length_bucket(F.col("en"), F.lit("chat"))).filter("bucket IS NOT NULL").groupBy("en", "bucket").agg(F.min("conv_id").alias("c"))
    p = p.select("bucket", "en", F.concat(F.lit("zh"), F.col("c").cast("string")).alias("zh"), F.lit("chat").alias("domain"), F.lit("conversations").alias("source"))
    k = F.col("p_partkey") % 4
    slots = t(spark, sf, "part").select(F.floor(F.col("p_partkey") / 20).cast("bigint").alias("page"), F.col("p_partkey").alias("slot"), F.when(k == 0, "headings").when(k == 1, "cells").when(k == 2, "paragraphs").otherwise("captions").alias("bucket"))
    n = slots.agg(F.max("page")).first()[0] + 1
    return pairs.filled_slots(slots, pairs.taken_pages(p, n, 8, 52)).select("page", "slot", "bucket", F.md5("en").alias("en"), "zh", "domain")


# Repeats.


@query(f"""WITH x AS (SELECT doc_id, {strip_sql('text')} AS m FROM documents), parts AS (SELECT doc_id, length(m) AS n, k.k AS k, substr(m, k.k * 1000 + 1, 1023) AS part FROM x, LATERAL (SELECT unnest(range(0, CAST(ceil(length(m) / 1000.0) AS BIGINT))) AS k) k),
grams AS (SELECT doc_id, substr(part, j.j, 24) AS g FROM parts, LATERAL (SELECT unnest(range(1, least(1000, n - 24 - k * 1000) + 1)) AS j) j), again AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) >= 3) WHERE len(list_distinct(list_filter(string_split(g, ''), lambda c: c NOT IN (' ', chr(9))))) >= 3),
l AS (SELECT doc_id, m, list_filter(list_transform(string_split(m, chr(10)), lambda l: {strip_sql('l')}), lambda l: l <> '') AS lines FROM x)
SELECT doc_id, coalesce(len(lines) <> len(list_distinct(lines)) OR length(m) - length(replace(m, '|', '')) >= 6 OR contains(m, '♫') OR doc_id IN (SELECT doc_id FROM again), false) AS risk FROM l""")
def repeat_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of any language with repeated lines or passages, notes or many bars."""
    return spread(t(spark, sf, "documents").select("doc_id", "text")).select("doc_id", C.repeat_risk(F.col("text")).alias("risk"))
