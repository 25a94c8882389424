"""Allocation, sampling, mixing, splitting, dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.keys import hkey
from ..operators import dedup, mixing, probe, quota, ranking, sampling, selection, split
from .base import SAMPLES, key_sql, query, samples, t

QUOTAS = """shares AS (SELECT lang, count(*)::DOUBLE AS share FROM documents GROUP BY lang), e AS (SELECT *, share / sum(share) OVER () * 137 AS exact FROM shares), b AS (SELECT *, floor(exact + 1e-9) AS base FROM e)"""


@query(f"WITH {QUOTAS} SELECT lang, CAST(base + CASE WHEN row_number() OVER (ORDER BY round(exact - base, 9) DESC, lang) <= 137 - sum(base) OVER () THEN 1 ELSE 0 END AS INT) AS quota FROM b")
def quota_largest_remainder(spark: SparkSession, sf: str) -> DataFrame:
    shares = t(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("share"))
    return quota.quotas(shares, "share", "lang", 137).select("lang", "quota")


COUNTS = """c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), p AS (SELECT source, n, i, n * share AS e, floor(n * share + 1e-9) AS b FROM c, (VALUES (0, 0.9::DOUBLE), (1, 0.05::DOUBLE), (2, greatest(0::DOUBLE, 1::DOUBLE - 0.9::DOUBLE - 0.05::DOUBLE))) v(i, share)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(e - b, 9) DESC, i) AS rk, n - sum(b) OVER (PARTITION BY source) AS lft FROM p),
q AS (SELECT source, n, max(CASE WHEN i = 0 THEN b + CAST(rk <= lft AS INT) END) AS a, max(CASE WHEN i = 1 THEN b + CAST(rk <= lft AS INT) END) AS v, max(CASE WHEN i = 2 THEN b + CAST(rk <= lft AS INT) END) AS s FROM r GROUP BY source, n),
cuts AS (SELECT source, n, CAST(a - CAST(n >= 3 AND v = 0 AS INT) - CAST(n >= 3 AND s = 0 AS INT) AS BIGINT) AS n_train, CAST(CASE WHEN n >= 3 AND v = 0 THEN 1 ELSE v END AS BIGINT) AS n_val FROM q)"""


@query(f"WITH {COUNTS} SELECT source, n, n_train, n_val, n - n_train - n_val AS n_test FROM cuts")
def split_counts_stratified(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    a, b = quota.split_count_columns(F.col("n"), 0.9, 0.05)
    return d.select("source", "n", a.cast("bigint").alias("n_train"), (b - a).cast("bigint").alias("n_val"), (F.col("n") - b).cast("bigint").alias("n_test"))


@query(f"WITH {COUNTS}, d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {key_sql(7, 'doc_id')}, doc_id) AS rn FROM documents) SELECT doc_id, CASE WHEN rn <= n_train THEN 'train' WHEN rn <= n_train + n_val THEN 'val' ELSE 'test' END AS split FROM d JOIN cuts USING (source)")
def split_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return split.stratified(t(spark, sf, "documents").select("doc_id", "source"), ["source"], "doc_id", 0.9, 0.05, 7).select("doc_id", "split")


@query(f"WITH d AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {key_sql(8, 'doc_id')}, doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, CASE WHEN rn <= floor(n * 0.9 + 1e-9) THEN 'train' WHEN rn <= floor(n * 0.9 + 1e-9) + floor(n * 0.05 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM d")
def split_truncated(spark: SparkSession, sf: str) -> DataFrame:
    return split.truncated(t(spark, sf, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 0.9, 0.05, 8).select("doc_id", "split")


def _ranked(bucket: str, seed: int, limits: str, extra: str = "") -> str:
    return f"WITH {SAMPLES}, q(k, quota) AS (VALUES {limits}), r AS (SELECT *, row_number() OVER (PARTITION BY {bucket} ORDER BY {key_sql(seed, 'sample_id')}, sample_id) AS rn FROM samples {extra}) SELECT sample_id, pool_id, chrome FROM r JOIN q ON r.{bucket} = q.k WHERE rn <= quota"


@query(_ranked("pool_id", 11, "('en', 60), ('fr', 24), ('de', 18), ('es', 18)"))
def pool_quota_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.mixed_sample(samples(spark, sf), "pool_id", {"en": 0.5, "fr": 0.2, "de": 0.15, "es": 0.15}, 120, "sample_id", 11).select("sample_id", "pool_id", "chrome")


@query(_ranked("chrome", 12, "('chrome', 27), ('none', 18)", "WHERE pool_id = 'en'"))
def chrome_quota_sample(spark: SparkSession, sf: str) -> DataFrame:
    d = samples(spark, sf).filter("pool_id = 'en'")
    return sampling.mixed_sample(d, "chrome", {"chrome": 0.6, "none": 0.4}, 45, "sample_id", 12).select("sample_id", "pool_id", "chrome")


BOOST = f"""WITH {SAMPLES}, e(stem, quota) AS (VALUES ('src1', 14), ('src4', 14)),
d AS (SELECT s.*, e.quota IS NOT NULL AS boosted, row_number() OVER (PARTITION BY template_stem ORDER BY {key_sql(13, 'sample_id')}, sample_id) <= coalesce(e.quota, 0) AS inn FROM samples s LEFT JOIN e ON s.template_stem = e.stem),
r AS (SELECT *, row_number() OVER (PARTITION BY boosted ORDER BY inn DESC, {key_sql(13, 'sample_id')}, sample_id) AS rn FROM d) SELECT sample_id, template_stem FROM r WHERE rn <= CASE WHEN boosted THEN 28 ELSE 12 END"""


@query(BOOST)
def stem_boost_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.boosted_sample(samples(spark, sf), "template_stem", ["src1", "src4"], 0.7, 40, "sample_id", 13).select("sample_id", "template_stem")


@query(f"WITH {SAMPLES}, d AS (SELECT sample_id, page_id, {key_sql(14, 'sample_id')} AS h, row_number() OVER (PARTITION BY page_id ORDER BY {key_sql(14, 'sample_id')}, sample_id) > 1 AS again FROM samples) SELECT sample_id, page_id FROM d ORDER BY again, h, sample_id LIMIT 50")
def unique_page_first(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.unique_page_first(samples(spark, sf).select("sample_id", "page_id"), "page_id", 50, "sample_id", 14)


@query("WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, min(doc_id) OVER (PARTITION BY lang) AS f FROM documents) SELECT doc_id, lang FROM d ORDER BY k, f LIMIT 64")
def round_robin_eval(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.round_robin(t(spark, sf, "documents").select("doc_id", "lang"), "lang", 64, "doc_id")


@query("WITH d AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, source, n_chars FROM d WHERE rn = 1")
def first_per_template(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.first_of(t(spark, sf, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"])


ORDER = f"(lpad(CAST(rn AS VARCHAR), 12, '0') || '|' || md5(concat_ws('|', '15', CAST(rn AS VARCHAR), pool_id)))"


@query(f"WITH {SAMPLES}, d AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY {key_sql(15, 'sample_id')}, sample_id) AS rn FROM samples) SELECT sample_id, pool_id, {ORDER} AS ord FROM d")
def interleave_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.interleaved(samples(spark, sf).select("sample_id", "pool_id"), "pool_id", "sample_id", 15)


@query(f"WITH {SAMPLES}, s AS (SELECT *, coalesce(toxic, 0) = 1 AS is_negative FROM samples LEFT JOIN labels USING (doc_id)) SELECT pool_id, chrome, template_stem, CAST(grouping(pool_id, chrome, template_stem) AS BIGINT) AS gid, count(*) AS n, count_if(is_negative) AS n_negative FROM s GROUP BY GROUPING SETS ((), (pool_id), (chrome), (template_stem), (pool_id, chrome))".replace("count_if(is_negative)", "CAST(count_if(is_negative) AS BIGINT)"))
def mix_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = samples(spark, sf).join(t(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left").withColumn("is_negative", F.coalesce("toxic", F.lit(0)) == 1)
    return mixing.mix_summary(d, [[], ["pool_id"], ["chrome"], ["template_stem"], ["pool_id", "chrome"]])


@query("WITH d AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS i FROM documents), r AS (SELECT source, lang, i, count(*) AS n FROM d GROUP BY source, lang, i) SELECT source, max(n) AS max_run FROM r GROUP BY source")
def max_run(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.longest_runs(t(spark, sf, "documents").select("source", "lang", "doc_id"), ["lang"], "doc_id", ["source"])


@query("WITH d AS (SELECT lang, doc_id, row_number() OVER (ORDER BY doc_id) - row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents), r AS (SELECT lang, i, count(*) AS n FROM d GROUP BY lang, i) SELECT max(n) AS max_run FROM r")
def max_run_of_table(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.longest_run(t(spark, sf, "documents"), "lang", "doc_id")


@query("WITH n AS (SELECT count(*) AS n FROM labels WHERE toxic = 1), d AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', '0', CAST(doc_id AS VARCHAR))), doc_id) - 1 AS i, CAST(round_even(0.35 * n, 0) AS BIGINT) AS extra, n FROM labels, n WHERE toxic = 1) SELECT doc_id, k.k > 0 AS upsampled FROM d, (SELECT unnest(range(0, 3)) AS k) k WHERE k.k <= extra // n + CAST(i < extra % n AS INT)")
def blank_upsample(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return sampling.upsample(d, 1.35, d.count(), "doc_id")


@query(f"WITH p AS (SELECT doc_id, lang, row_number() OVER (ORDER BY {key_sql(16, 'doc_id')}, doc_id) AS i FROM documents WHERE lang = 'es'), n AS (SELECT count(*) AS n FROM p) SELECT doc_id, CAST(r.r AS INT) AS r FROM p, n, (SELECT unnest(range(1, 4)) AS r) r WHERE (r.r - 1) * n + i <= CAST(floor(2.5 * n) AS BIGINT)".replace(", CAST(r.r AS INT) AS r", ""))
def dual_task_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with replacement, in whole rounds, until they make up their part."""
    d = t(spark, sf, "documents").filter("lang = 'es'").select("doc_id")
    n = d.count()
    return sampling.repeated_to(d, int(2.5 * n), n, "doc_id", 16)


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn2 FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY md5(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))) ORDER BY source, doc_id) AS rn FROM documents WHERE lang = 'en') WHERE rn = 1) WHERE rn2 <= 20")
def pair_dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents").filter("lang = 'en'").withColumn("k", F.md5(dedup.pair_key(F.col("text"))))
    return dedup.capped_sources(d.select("doc_id", "lang", "source", "k"), "k", "source", "source", "doc_id", 20).select("doc_id", "lang", "source")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def probe_resume_anti(spark: SparkSession, sf: str) -> DataFrame:
    done = t(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return probe.pending(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


@query("WITH a AS (SELECT user_id, max(event_type) AS x FROM events WHERE event_id % 2 = 0 GROUP BY user_id), b AS (SELECT user_id, max(event_type) AS y FROM events WHERE event_id % 2 = 1 GROUP BY user_id) SELECT count(*) AS n, CAST(count_if(x IS NOT DISTINCT FROM y) AS BIGINT) AS same FROM a JOIN b USING (user_id)")
def baseline_agreement(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events")
    of = lambda k: e.filter(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.max("event_type").alias("v"))
    return probe.agreement(of(0), of(1), "user_id", "v")


@query("SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.h, b.h)) AS INT) AS d FROM (SELECT vec_id, CAST(list_sum(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS HUGEINT) << CAST(i AS INT) ELSE 0 END)) AS UBIGINT) AS h FROM embeddings) a JOIN (SELECT vec_id, CAST(list_sum(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS HUGEINT) << CAST(i AS INT) ELSE 0 END)) AS UBIGINT) AS h FROM embeddings) b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) <= 16")
def near_dup_hamming(spark: SparkSession, sf: str) -> DataFrame:
    """Sign bits of the 64 elements, pairs within 16 bits."""
    d = t(spark, sf, "embeddings").select("vec_id", dedup.sign_bits(F.col("embedding")).alias("h"))
    return dedup.hamming_pairs(d, "vec_id", "h", 16)


@query(f"WITH {SAMPLES}, s AS (SELECT *, row_number() OVER (PARTITION BY pool_id IN ('en', 'fr') ORDER BY {key_sql(17, 'sample_id')}, sample_id) AS rn, count(*) OVER (PARTITION BY pool_id IN ('en', 'fr')) AS n FROM samples) SELECT sample_id, CASE WHEN pool_id IN ('en', 'fr') AND rn <= round_even(n * 0.4, 0) THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM s")
def area_scales(spark: SparkSession, sf: str) -> DataFrame:
    """Of hard scenes a share gets the small marker, the others the large one."""
    d = ranking.hash_rank(samples(spark, sf).select("sample_id", F.col("pool_id").isin("en", "fr").alias("hard")), ["hard"], "sample_id", 17, "rn", "n")
    return d.withColumn("small", F.col("hard") & (F.col("rn") <= F.bround(F.col("n") * 0.4))).select("sample_id", F.when(F.col("small"), 0.5).otherwise(1.0).alias("scale"))


@query()
def hq_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy choice under page, template and tertile caps, of each pool."""
    d = samples(spark, sf).select("pool_id", "sample_id", "page_id", "template_stem", (F.col("n_chars") % 3).cast("int").alias("tertile"), "n_chars")
    return sampling.capped_greedy(d, "pool_id", [("n_chars", False), ("sample_id", True)], 40, "page_id", 2, "template_stem", 14, "tertile", "pool_id string, sample_id string, page_id string, template_stem string, tertile int, n_chars long")


@query(f"WITH {SAMPLES} SELECT sample_id, CASE WHEN pool_id = 'de' THEN 'semantic_group' WHEN length(regexp_replace(target, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')) = 0 THEN 'empty' WHEN doc_id % 5 = 0 THEN 'multi_frag' END AS scene FROM samples WHERE pool_id <> 'de' OR length(target) > 0")
def scenes(spark: SparkSession, sf: str) -> DataFrame:
    d = samples(spark, sf)
    pool = F.when(F.col("pool_id") == "de", "semantic_group").otherwise(F.col("pool_id"))
    frag = F.when((F.col("doc_id") % 5 == 0) & (F.col("pool_id") != "de"), 2)
    return d.select("sample_id", C.scene(pool, F.col("target"), F.lit(False), frag, F.lit(0)).alias("scene"))


@query(f"""WITH {SAMPLES}, q(k, quota) AS (VALUES ('de', 150), ('es', 150)), r AS (SELECT sample_id, pool_id, {key_sql(21, 'sample_id')} AS h, row_number() OVER (PARTITION BY pool_id ORDER BY {key_sql(21, 'sample_id')}, sample_id) AS rn, quota FROM samples JOIN q ON pool_id = k)
SELECT sample_id, pool_id FROM r ORDER BY CAST(rn > quota AS INT), h, sample_id LIMIT 300""")
def mix_with_fill(spark: SparkSession, sf: str) -> DataFrame:
    return selection.mixed_with_fill(samples(spark, sf).select("sample_id", "pool_id"), "pool_id", {"de": 0.5, "es": 0.5}, 300, "sample_id", 21)


@query(f"""WITH {SAMPLES}, c AS (SELECT pool_id AS k, count(*) AS n FROM samples GROUP BY pool_id), e AS (SELECT *, n / sum(n) OVER () * 90::DOUBLE AS exact FROM c), b AS (SELECT *, floor(exact + 1e-9) AS base FROM e), q AS (SELECT k, base + CAST(row_number() OVER (ORDER BY round(exact - base, 9) DESC, k) <= 90 - sum(base) OVER () AS INT) AS quota FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY {key_sql(22, 'sample_id')}, sample_id) AS rn FROM samples) SELECT sample_id, pool_id FROM r JOIN q ON pool_id = k WHERE rn <= quota""")
def supply_sample(spark: SparkSession, sf: str) -> DataFrame:
    return selection.proportional_to_supply(samples(spark, sf).select("sample_id", "pool_id"), "pool_id", 90, "sample_id", 22)


@query(f"SELECT doc_id, lpad(CAST(CAST(floor(doc_id / 50) AS BIGINT) AS VARCHAR), 12, '0') || '|' || {key_sql(23, 'doc_id')} AS ord FROM documents")
def windowed_order(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.windowed(t(spark, sf, "documents").select("doc_id"), "doc_id", "doc_id", 50, 23)


@query(f"""WITH {SAMPLES}, p AS (SELECT page_id, min(pool_id) AS pool_id, min(template_stem) AS template_stem, min(chrome) AS chrome FROM samples GROUP BY page_id),
a AS (SELECT *, row_number() OVER (PARTITION BY template_stem ORDER BY CAST(pool_id <> 'core_inner' AS INT), page_id) AS t, first_value(chrome) OVER (PARTITION BY template_stem ORDER BY CAST(pool_id <> 'core_inner' AS INT), page_id) AS c, row_number() OVER (PARTITION BY template_stem, chrome ORDER BY CAST(pool_id <> 'core_inner' AS INT), page_id) AS o FROM p),
b AS (SELECT *, CASE WHEN t = 1 THEN 1 WHEN chrome <> c AND o = 1 THEN 2 ELSE 3 END AS tier FROM a),
d AS (SELECT *, min(CASE WHEN tier < 3 THEN 1 END) OVER (PARTITION BY pool_id) AS seen, row_number() OVER (PARTITION BY pool_id ORDER BY tier, page_id) AS k FROM b)
SELECT page_id, pool_id, template_stem, chrome FROM d WHERE tier < 3 OR (seen IS NULL AND k = 1) ORDER BY tier, template_stem, page_id LIMIT 30""")
def gallery_pages(spark: SparkSession, sf: str) -> DataFrame:
    return selection.gallery_pages(samples(spark, sf).select("page_id", "pool_id", "template_stem", "chrome"), 30)


@query(f"""WITH {SAMPLES}, r AS (SELECT sample_id, template_stem, {key_sql(24, 'sample_id')} AS h, row_number() OVER (PARTITION BY template_stem ORDER BY {key_sql(24, 'sample_id')}, sample_id) AS rn FROM samples) SELECT sample_id, template_stem FROM r ORDER BY rn, {key_sql(24, 'template_stem')}, sample_id LIMIT 60""")
def stratified_review(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.unseen_rounds(samples(spark, sf).select("sample_id", "template_stem"), ["template_stem"], "sample_id", 24, 60)


@query("WITH o AS (SELECT o_orderkey AS k, o_orderpriority LIKE '1%' AS a, o_orderpriority < '4' AS b FROM orders), n AS (SELECT count_if(a) >= 300 AS enough FROM o) SELECT k FROM o, n WHERE CASE WHEN enough THEN a ELSE b END ORDER BY md5(concat_ws('|', '25', CAST(k AS VARCHAR))), k LIMIT 300")
def preferred_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The stricter choice if it has enough rows, else the looser one."""
    d = t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    return sampling.preferred_or_looser(d, F.col("o_orderpriority").like("1%"), F.col("o_orderpriority") < "4", 300, "k", 25).select("k")
