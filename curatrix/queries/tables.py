"""Pages, events and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import html as H
from ..functions import text as X
from ..operators import dedup, documents, sampling
from ..session import spread
from .base import CJK_SQL, TURNS, WS, query, strip_sql, t, turns


@query()
def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return documents.with_targets(documents.blocks(spread(t(spark, sf, "pages").select("page_id", "html"))))


@query()
def html_block_buckets(spark: SparkSession, sf: str) -> DataFrame:
    d = documents.with_targets(documents.blocks(spread(t(spark, sf, "pages").select("page_id", "html"))))
    return d.groupBy("tag", "bucket", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, length(html) AS n_chars, CAST(len(regexp_extract_all(html, '(?i)<h[1-6][ >]')) AS BIGINT) AS headings FROM pages")
def page_profile(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "pages")
    return d.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.length("html").cast("bigint").alias("n_chars"), F.regexp_count("html", F.lit("(?i)<h[1-6][ >]")).cast("bigint").alias("headings"))


BUCKET = f"""CASE WHEN m = '' THEN 'empty' WHEN contains(lower(m), '<table') THEN 'table' WHEN contains(m, '$') OR contains(m, '\\frac') OR contains(m, '\\sum') THEN 'formula' WHEN starts_with(m, '```') THEN 'code' WHEN starts_with(m, '#') THEN 'heading' WHEN length(m) < 40 THEN 'short' WHEN length(m) > 800 THEN 'long' ELSE 'paragraph' END"""


@query(f"SELECT doc_id, {BUCKET} AS bucket FROM (SELECT doc_id, {strip_sql('text')} AS m FROM documents)")
def bucket_for_block(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", C.bucket_for_block(F.col("text"), F.lit(None).cast("string")).alias("bucket"))


@query(f"""WITH x AS (SELECT item_id, {strip_sql('text')} AS m FROM benchmark), r AS (SELECT DISTINCT item_id FROM x, LATERAL (SELECT unnest(range(1, length(m) - 38)) AS i) i, (SELECT unnest(range(8, 81)) AS n) n WHERE 5 * n.n <= length(m) - i.i + 1 AND substr(m, i.i, 5 * n.n) = repeat(substr(m, i.i, n.n), 5))
SELECT item_id, CASE WHEN m = '' THEN 'empty_label' WHEN item_id IN (SELECT item_id FROM r) THEN 'repetition' WHEN contains(m, chr(65533)) THEN 'replacement_char' WHEN length(m) - length(replace(m, '<', '')) > 20 AND length(replace(m, '<', '')) <> length(replace(m, '>', '')) THEN 'broken_html' ELSE 'ok' END AS reason FROM x""")
def label_filter_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Reasons to drop a label."""
    return t(spark, sf, "benchmark").select("item_id", C.label_reason(F.col("text"), F.lit(None).cast("string")).alias("reason"))


@query(f"WITH {TURNS}, l AS (SELECT conv_id, turn, {strip_sql('target')} AS en FROM turns) SELECT CASE WHEN length(en) < 2 THEN NULL WHEN length(en) <= 14 THEN 'cells' WHEN length(en) <= 42 THEN 'headings' WHEN length(en) <= 52 THEN 'captions' WHEN length(en) <= 110 THEN 'list_items' WHEN length(en) <= 520 THEN 'paragraphs' END AS bucket, count(*) AS n FROM l GROUP BY 1")
def pair_length_bucket(spark: SparkSession, sf: str) -> DataFrame:
    d = turns(spark, sf).select(C.length_bucket(X.strip(F.col("target")), F.lit("chat")).alias("bucket"))
    return d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


#: A line of the other language for each user turn, in letters of its script, a third as long.
ZH = "repeat(chr(26032), CAST(floor(length(en) * 0.4) AS INT))"


@query(f"WITH {TURNS}, l AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(target, '<[^>]+>', ' ', 'g'), '{WS}+', ' ', 'g')) AS en FROM turns), p AS (SELECT *, CASE WHEN turn % 4 = 3 THEN en ELSE {ZH} END AS zh, length(regexp_replace(en, '[^A-Za-z]', '', 'g')) AS latin, len(regexp_extract_all(en, '{CJK_SQL}')) AS cjk FROM l) SELECT conv_id, turn, length(en) BETWEEN 2 AND 520 AND length(zh) BETWEEN 2 AND 700 AND latin >= 2 AND latin >= 2 * cjk AND NOT contains(lower(en), 'http://') AND NOT contains(lower(en), 'https://') AND turn % 4 <> 3 AND length(zh) / greatest(length(en), 1)::DOUBLE BETWEEN 0.28 AND 2.6 AND length(en) - length(replace(replace(en, '{{', ''), '}}', '')) <= 4 AS ok FROM p")
def pair_clean(spark: SparkSession, sf: str) -> DataFrame:
    d = turns(spark, sf).select("conv_id", "turn", X.clean_pair_text(F.col("target")).alias("en"))
    zh = F.when(F.col("turn") % 4 == 3, F.col("en")).otherwise(F.expr("repeat('新', cast(floor(length(en) * 0.4) as int))".replace("新", chr(26032))))
    return d.withColumn("zh", zh).select("conv_id", "turn", C.ok_pair(F.col("en"), F.col("zh")).alias("ok"))


@query("WITH s AS (SELECT user_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) SELECT user_id, count(k) AS n, CAST(min(k) AS DOUBLE) AS low, CAST(max(k) AS DOUBLE) AS high FROM s WHERE k IS NOT NULL AND NOT isnan(k) GROUP BY user_id")
def log_series(spark: SparkSession, sf: str) -> DataFrame:
    """A sparse metric of a log: rows without it, or with what is no number, do not count."""
    v = F.get_json_object("props", "$.k").try_cast("double")
    d = t(spark, sf, "events").select("user_id", v.alias("k")).filter(F.col("k").isNotNull() & ~F.isnan("k"))
    return d.groupBy("user_id").agg(F.count("k").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))


@query("SELECT r_name, n_name, CAST(grouping(r_name, n_name) AS BIGINT) AS gid, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ROLLUP (r_name, n_name)")
def star_agg_rollup(spark: SparkSession, sf: str) -> DataFrame:
    l, o, c, n, r = (t(spark, sf, x) for x in ("lineitem", "orders", "customer", "nation", "region"))
    d = l.filter("l_shipdate >= timestamp '1995-01-01'").join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return d.rollup("r_name", "n_name").agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("WITH d AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM d WHERE rn <= 3")
def topk_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.top_by(t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') AS urgent FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders")
    has = c.select("c_custkey").join(o, c.c_custkey == o.o_custkey, "left_semi")
    urgent = o.filter("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("u")).distinct()
    return has.join(urgent, "c_custkey", "left").select("c_custkey", F.coalesce("u", F.lit(False)).alias("urgent"))


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def keep_last(spark: SparkSession, sf: str) -> DataFrame:
    """The later row of a key wins."""
    return t(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))


@query("WITH v(variant, scale) AS (VALUES ('base', 1.0::DOUBLE), ('small', 0.5::DOUBLE), ('large', 2.0::DOUBLE)), x AS (SELECT vec_id, label, variant, label * scale AS s FROM embeddings, v) SELECT variant, label, count(*) AS n, CAST(count_if(s > b) AS BIGINT) AS above, CAST(sum(s) AS DOUBLE) AS total FROM (SELECT x.*, max(CASE WHEN variant = 'base' THEN s END) OVER (PARTITION BY vec_id) AS b FROM x) GROUP BY variant, label")
def variants_against_base(spark: SparkSession, sf: str) -> DataFrame:
    """Each row in three variants, each compared with the row's own base variant."""
    v = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), F.lit(s).alias("scale")) for k, s in (("base", 1.0), ("small", 0.5), ("large", 2.0))]))
    x = t(spark, sf, "embeddings").select("vec_id", "label", v.alias("v")).select("vec_id", "label", "v.variant", (F.col("label") * F.col("v.scale")).alias("s"))
    x = x.withColumn("b", F.max(F.when(F.col("variant") == "base", F.col("s"))).over(Window.partitionBy("vec_id")))
    return x.groupBy("variant", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s") > F.col("b")).alias("above"), F.sum("s").alias("total"))


@query("WITH u AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A') SELECT l.l_orderkey, l.l_linenumber FROM lineitem l WHERE l.l_orderkey IN (SELECT l_orderkey FROM u) AND NOT EXISTS (SELECT 1 FROM u WHERE u.l_orderkey = l.l_orderkey AND u.l_linenumber = l.l_linenumber)")
def alternate_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments of used groups that are not used themselves."""
    l = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    u = l.filter("l_returnflag = 'A'").select("l_orderkey", "l_linenumber")
    return l.select("l_orderkey", "l_linenumber").join(u.select("l_orderkey").distinct(), "l_orderkey", "left_semi").join(u, ["l_orderkey", "l_linenumber"], "left_anti")


@query("SELECT n_regionkey, string_agg(n_name, chr(10) || chr(10) ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def joined_texts(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), "\n\n").alias("names"))


@query("SELECT name, min(k) AS first FROM (SELECT lower(trim(p_name)) AS name, p_partkey AS k FROM part UNION ALL SELECT lower(trim(p_type)), 1000000 + p_partkey FROM part) GROUP BY name")
def merged_unique(spark: SparkSession, sf: str) -> DataFrame:
    """Union of two lists, each value once, at its first place."""
    p = t(spark, sf, "part")
    a = p.select(F.lower(F.trim("p_name")).alias("name"), F.col("p_partkey").alias("k"))
    b = p.select(F.lower(F.trim("p_type")).alias("name"), (F.col("p_partkey") + 1000000).alias("k"))
    return a.unionByName(b).groupBy("name").agg(F.min("k").alias("first"))


@query("WITH d AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id) SELECT conv_id, len(m) AS n_messages, md5(coalesce(list_filter(m, lambda x: x.r = 'assistant')[1].t, '')) AS target FROM d")
def chat_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Chat rows from turns, and the first assistant message of each."""
    d = t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    said = F.get(F.filter("m", lambda x: x["role"] == "assistant"), F.lit(0))["text"]
    return d.select("conv_id", F.size("m").cast("bigint").alias("n_messages"), F.md5(F.coalesce(said, F.lit(""))).alias("target"))


@query("SELECT c_custkey, CASE WHEN starts_with(c_name, 'Customer#0000001') AND c_acctbal > 0 THEN '/new' || substr(c_name, 9) ELSE c_name END AS path FROM customer")
def relocated_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Names as paths under an old root, moved where the new place exists."""
    d = t(spark, sf, "customer").withColumn("p", F.concat(F.lit("/old/"), F.col("c_name")))
    known = (F.col("c_acctbal") > 0) & F.startswith(F.col("c_name"), F.lit("Customer#0000001"))
    moved = X.relocate(F.col("p"), "/old", "/new", known)
    return d.select("c_custkey", F.when(F.startswith(moved, F.lit("/new/")), F.concat(F.lit("/new"), F.substring(moved, F.lit(14), F.length(moved)))).otherwise(F.substring(moved, F.lit(6), F.length(moved))).alias("path"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "lineitem").filter("l_shipdate <= timestamp '1998-09-02'")
    return d.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))), 2).alias("charge"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', '31', CAST(doc_id AS VARCHAR))), doc_id) AS rn FROM documents WHERE source IN ('src1', 'src2', 'src3')), daily AS (SELECT count(*) AS n FROM documents WHERE source NOT IN ('src1', 'src2', 'src3')), c AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', '31', CAST(doc_id AS VARCHAR))), doc_id) AS rn FROM d) SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2', 'src3') UNION ALL SELECT doc_id FROM c, daily WHERE rn <= greatest(100, CAST(round_even(n * 0.9 / 0.1, 0) AS BIGINT) // 81)")
def daily_spec_mix(spark: SparkSession, sf: str) -> DataFrame:
    """All everyday rows, and special ones up to their part of all but never under a floor."""
    d = t(spark, sf, "documents").select("doc_id", "source")
    spec = F.col("source").isin("src1", "src2", "src3")
    n = d.filter(~spec).count()
    cap = max(100, sampling.ratio_count(n, 0.9) // 81)
    from ..functions.keys import hkey

    return d.filter(~spec).select("doc_id").unionByName(d.filter(spec).orderBy(hkey(31, "doc_id"), "doc_id").limit(cap).select("doc_id"))


@query("SELECT p_partkey, CASE WHEN t IN ('h1','h2','h3','h4') OR regexp_matches(b, '^(h1|h2|h3|title|side_h)') THEN 'headings' WHEN t IN ('td','th') OR contains(b, 'cell') OR (regexp_matches(b, '^[cr]') AND n < 12) THEN 'cells' WHEN t IN ('code','pre') OR contains(b, 'code') OR starts_with(b, 'cmd') THEN 'code_lines' WHEN t = 'li' OR regexp_matches(b, '^(li|side_|nav)') THEN CASE WHEN n < 80 THEN 'list_items' ELSE 'paragraphs' END WHEN t IN ('span','small') OR contains(b, 'meta') OR contains(b, 'caption') OR n < 40 THEN 'captions' ELSE 'paragraphs' END AS bucket FROM (SELECT p_partkey, lower(p_name) AS b, p_size * 3 AS n, CASE p_partkey % 6 WHEN 0 THEN 'h2' WHEN 1 THEN 'td' WHEN 2 THEN 'li' WHEN 3 THEN 'span' WHEN 4 THEN 'pre' ELSE 'p' END AS t FROM part)")
def slot_buckets(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    tag = F.when(k == 0, "h2").when(k == 1, "td").when(k == 2, "li").when(k == 3, "span").when(k == 4, "pre").otherwise("p")
    return t(spark, sf, "part").select("p_partkey", C.slot_bucket(tag, F.col("p_name"), F.col("p_size") * 3).alias("bucket"))


@query("SELECT page_id, CAST(len(html) - len(replace(html, '<', '')) AS BIGINT) AS tags, md5(CASE WHEN strpos(lower(html), '</body>') > 0 THEN left(html, strpos(lower(html), '</body>') - 1) || '<p>a &amp; b</p>' || substr(html, strpos(lower(html), '</body>')) ELSE html || '<p>a &amp; b</p>' END) AS filled FROM pages")
def page_fill(spark: SparkSession, sf: str) -> DataFrame:
    """A paragraph at the end of each page's body."""
    return t(spark, sf, "pages").select("page_id", (F.length("html") - F.length(F.replace("html", F.lit("<"), F.lit("")))).cast("bigint").alias("tags"), F.md5(H.with_paragraphs(F.col("html"), F.array(F.lit("a & b")))).alias("filled"))


@query("SELECT c_custkey, CASE WHEN p = '' THEN 'unknown' ELSE p END AS doc_type, i AS page FROM (SELECT c_custkey, split_part(x, '__', 1) AS p, TRY_CAST(regexp_extract(x, '__(\\d+)$', 1) AS INT) AS i FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment || '__' || c_nationkey END AS x FROM customer))")
def page_names(spark: SparkSession, sf: str) -> DataFrame:
    x = F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.concat("c_mktsegment", F.lit("__"), F.col("c_nationkey").cast("string")))
    return t(spark, sf, "customer").select("c_custkey", C.doc_type(x).alias("doc_type"), X.page_index(x).alias("page"))
