"""Text metrics, structured output, rewards, groups of rollouts, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import rewards as R
from ..functions import text as X
from ..operators import dedup, metrics, probe, ranking, sampling
from .base import CJK_SQL, SAMPLES, TURNS, WS, cleaned_sql, norm_sql, query, samples, similarity_sql, strip_sql, t, turns

NEG = f"(is_negative OR {norm_sql('target')} = '')"
CLEAN = cleaned_sql("prediction_raw")
#: Sections and lengths of a dump.
OVER = "(length(p) > 0 AND ((length(p) >= 400 AND (length(g) = 0 OR length(p) >= 3.0 * greatest(length(g), 1))) OR (length(g) > 0 AND length(p) > greatest(200, 2 * length(g)) AND (len(regexp_extract_all(p, '(?m)^#{1,6}[ \\t\\n\\r\\f\\v]')) >= 3 OR len(list_filter(regexp_split_to_array(p, '\\n[ \\t\\n\\r\\f\\v]*\\n'), lambda b: " + strip_sql("b") + " <> '')) >= 5))))"
EXAMPLES = f"""{TURNS}, e AS (SELECT *, {NEG} AS neg, {CLEAN} AS prediction FROM turns),
x AS (SELECT *, {similarity_sql('prediction', 'target')} AS sim, {norm_sql('prediction')} = '' AS empty_pred, {strip_sql('prediction')} AS p, {strip_sql('target')} AS g, contains(prediction_raw, '<|im_end|>') AS leak FROM e)"""
REPORT = f"""count(*) AS n, CAST(count_if(NOT neg) AS BIGINT) AS n_pos, CAST(count_if(neg) AS BIGINT) AS n_neg, coalesce(count_if(NOT neg AND sim >= 0.85) / nullif(count_if(NOT neg), 0)::DOUBLE, 0) AS block_hit_rate,
coalesce(round(avg(CASE WHEN NOT neg THEN sim END), 9), 0) AS mean_edit_similarity, coalesce(count_if(neg AND empty_pred) / nullif(count_if(neg), 0)::DOUBLE, 0) AS empty_rate,
coalesce(count_if(NOT neg AND empty_pred) / nullif(count_if(NOT neg), 0)::DOUBLE, 0) AS miss_rate, coalesce(count_if(NOT neg AND {OVER}) / nullif(count_if(NOT neg), 0)::DOUBLE, 0) AS over_rate, count_if(leak) / count(*)::DOUBLE AS leak_rate"""


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).withColumn("prediction", X.strip_format_leak(F.col("prediction_raw")))


@query(f"WITH {EXAMPLES} SELECT {REPORT} FROM x")
def eval_overall(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.report(_predictions(spark, sf))


@query(f"WITH {EXAMPLES} SELECT role, {REPORT} FROM x GROUP BY role")
def eval_by_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.report(_predictions(spark, sf), "role")


@query(f"WITH {EXAMPLES}, y AS (SELECT *, CAST(turn % 3 AS VARCHAR) AS slot FROM x) SELECT role, slot, CAST(grouping(role, slot) AS BIGINT) AS gid, {REPORT} FROM y GROUP BY GROUPING SETS ((), (role), (slot), (role, slot))")
def eval_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    d = _predictions(spark, sf).withColumn("slot", (F.col("turn") % 3).cast("string"))
    return metrics.report_sets(d, [[], ["role"], ["slot"], ["role", "slot"]])


PARSED = f"""{TURNS}, c AS (SELECT sample_id, target, is_negative, prediction_raw, {CLEAN} AS prediction FROM turns),
z AS (SELECT *, regexp_matches(prediction, '(?is)<source>.*?</source>') AS has_source, regexp_matches(prediction, '(?is)<translation>.*?</translation>') AS has_translation,
 {strip_sql("regexp_extract(prediction, '(?is)<source>(.*?)</source>', 1)")} AS source, {strip_sql("regexp_extract(prediction, '(?is)<translation>(.*?)</translation>', 1)")} AS translation,
 {norm_sql("regexp_replace(regexp_replace(prediction, '(?is)<source>.*?</source>', '', 'g'), '(?is)<translation>.*?</translation>', '', 'g')")} AS stray, contains(lower(prediction), '<source>') AS open_source FROM c)"""
VERDICTS = "(has_source AND has_translation AND stray = '') AS well_formed, (has_source AND has_translation AND source = '' AND translation = '') AS empty_shell, (open_source AND NOT has_source AND NOT has_translation) AS truncated"


@query(f"WITH {PARSED} SELECT sample_id, has_source, has_translation, length(source) AS n_source, length(translation) AS n_translation, {VERDICTS} FROM z")
def xml_parse(spark: SparkSession, sf: str) -> DataFrame:
    d = _predictions(spark, sf).withColumn("p", X.parse_target(F.col("prediction")))
    return d.select("sample_id", "p.has_source", "p.has_translation", F.length(X.strip(F.col("p.source"))).cast("bigint").alias("n_source"), F.length(X.strip(F.col("p.translation"))).cast("bigint").alias("n_translation"), "p.well_formed", "p.empty_shell", "p.truncated")


@query(f"WITH {TURNS} SELECT sample_id, contains(prediction_raw, '<|im_end|>') AS leak, md5({CLEAN}) AS cleaned FROM turns")
def strip_leak(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).select("sample_id", X.has_format_leak(F.col("prediction_raw")).alias("leak"), F.md5(X.strip_format_leak(F.col("prediction_raw"))).alias("cleaned"))


@query(f"WITH {PARSED}, v AS (SELECT *, {VERDICTS} FROM z) SELECT CASE WHEN {norm_sql('prediction')} = '' THEN 'empty' WHEN empty_shell THEN 'empty_xml_shell' WHEN truncated THEN 'trunc_source' WHEN NOT has_source AND NOT has_translation THEN 'plain_text' ELSE 'leak_xml' END AS category, count(*) AS n FROM v GROUP BY 1")
def output_categories(spark: SparkSession, sf: str) -> DataFrame:
    return _predictions(spark, sf).groupBy(C.output_category(F.col("prediction")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EXAMPLES} SELECT sample_id, round(sim, 9) AS similarity, {OVER} AS over FROM x")
def edit_similarity(spark: SparkSession, sf: str) -> DataFrame:
    d = _predictions(spark, sf)
    return d.select("sample_id", F.round(X.edit_similarity(F.col("prediction"), F.col("target")), 9).alias("similarity"), X.over_extraction(F.col("prediction"), F.col("target")).alias("over"))


#: Mean F-scores of characters (f), and of characters and words (fw), of h against r.
CHRF_CTES = f"""d AS (SELECT sample_id, trim(regexp_replace(translation, '{WS}+', ' ', 'g')) AS h, trim(regexp_replace(target, '{WS}+', ' ', 'g')) AS r FROM z),
o AS (SELECT *, unnest(range(1, least(6, length(h), length(r)) + 1)) AS n FROM d), ws AS (SELECT sample_id, string_split(h, ' ') AS h, string_split(r, ' ') AS r FROM d WHERE h <> '' AND r <> ''), ow AS (SELECT *, unnest(range(1, least(2, len(h), len(r)) + 1)) AS n FROM ws),
g AS (SELECT sample_id, n, substr(h, i.i, n) AS g, 1 AS a, 0 AS b FROM o, LATERAL (SELECT unnest(range(1, length(h) - n + 2)) AS i) i UNION ALL SELECT sample_id, n, substr(r, i.i, n), 0, 1 FROM o, LATERAL (SELECT unnest(range(1, length(r) - n + 2)) AS i) i
 UNION ALL SELECT sample_id, 10 + n, array_to_string(h[i.i : i.i + n - 1], ' '), 1, 0 FROM ow, LATERAL (SELECT unnest(range(1, len(h) - n + 2)) AS i) i UNION ALL SELECT sample_id, 10 + n, array_to_string(r[i.i : i.i + n - 1], ' '), 0, 1 FROM ow, LATERAL (SELECT unnest(range(1, len(r) - n + 2)) AS i) i),
k AS (SELECT sample_id, n, g, sum(a) AS a, sum(b) AS b FROM g GROUP BY ALL), f AS (SELECT sample_id, n, sum(least(a, b)) AS m, sum(a) AS h, sum(b) AS r FROM k GROUP BY ALL),
per AS (SELECT sample_id, n, CASE WHEN m = 0 THEN 0 ELSE 5.0 * (m / h) * (m / r) / (4.0 * (m / h) + (m / r)) END AS f FROM f), s AS (SELECT sample_id, avg(f) FILTER (WHERE n < 10) AS f, avg(f) AS fw FROM per GROUP BY sample_id)"""
CHRF = f"""WITH {PARSED}, {CHRF_CTES} SELECT d.sample_id, round(coalesce(s.f, CASE WHEN d.h = d.r THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS score FROM d LEFT JOIN s USING (sample_id)"""
#: Rows of the two-tag reports and rewards; sim is that of sources, score and plus that of translations.
TWO = f"""WITH {PARSED}, {CHRF_CTES}, score AS (SELECT d.sample_id, coalesce(s.f, CASE WHEN d.h = d.r THEN 1.0 ELSE 0.0 END)::DOUBLE AS score, coalesce(s.fw, CASE WHEN d.h = d.r THEN 1.0 ELSE 0.0 END)::DOUBLE AS plus FROM d LEFT JOIN s USING (sample_id)),
y AS (SELECT z.*, turns.conv_id, turns.role, score.score, score.plus, {VERDICTS}, {norm_sql('prediction')} = '' AS blank, {similarity_sql('z.source', 'z.target')} AS sim, {strip_sql('z.source')} AS p, {strip_sql('z.target')} AS g, {strip_sql('z.translation')} AS tr, z.source <> '' AS said,
 contains(lower(prediction), '<translation>') AND NOT contains(lower(prediction), '</translation>') AS unclosed, contains(z.prediction_raw, '<|im_end|>') AS leak FROM z JOIN turns USING (sample_id) JOIN score USING (sample_id)),
w AS (SELECT *, is_negative AS neg FROM y)"""


@query(CHRF)
def chrf_arrow(spark: SparkSession, sf: str) -> DataFrame:
    d = _predictions(spark, sf).withColumn("h", X.parse_target(F.col("prediction"))["translation"])
    return d.select("sample_id", F.round(X.chrf("h", "target"), 6).alias("score"))


@query(CHRF)
def chrf_grams(spark: SparkSession, sf: str) -> DataFrame:
    """The same score by joins and sums of n-grams."""
    d = _predictions(spark, sf).withColumn("h", X.parse_target(F.col("prediction"))["translation"])
    return X.chrf_grams(d, "sample_id", "h", "target", "score").withColumn("score", F.round("score", 6))


ROLL = f"""{TURNS}, c AS (SELECT conv_id, prediction_raw, {CLEAN} AS p0, is_negative FROM turns), f AS (SELECT conv_id, min_by(target, turn) AS target, min_by(is_negative, turn) AS neg FROM turns GROUP BY conv_id),
j AS (SELECT c.conv_id, c.prediction_raw, c.p0, f.target, f.neg, {similarity_sql('c.p0', 'f.target')} AS sim, {norm_sql('c.p0')} = '' AS blank, {strip_sql('c.p0')} AS p, {strip_sql('f.target')} AS g FROM c JOIN f USING (conv_id)),
s AS (SELECT *, CASE WHEN neg THEN CAST(blank AS INT)::DOUBLE WHEN blank THEN -1.0 ELSE 0.0 END AS empty, CASE WHEN NOT neg AND {OVER} THEN -1.0 ELSE 0.0 END AS over,
 CASE WHEN NOT neg AND NOT blank AND {norm_sql('target')} <> '' AND length(p0) < 0.65 * length(target) AND sim < 0.55 THEN -1.0 ELSE 0.0 END AS under, CASE WHEN contains(prediction_raw, '<|im_end|>') THEN -1.0 ELSE 0.0 END AS leak FROM j),
w AS (SELECT *, sim + 1.5 * empty + over + under + 0.5 * leak AS total FROM s)"""
GROUPS = """q AS (SELECT conv_id, neg, count(*) AS n, round(avg(total), 9) AS reward_mean, round(stddev_pop(total), 9) AS reward_std, round(min(total), 9) AS reward_min, round(max(total), 9) AS reward_max,
 avg(CAST(total >= 0.8 * CASE WHEN neg THEN 2.5 ELSE 1.0 END AS INT)) AS frac_good, avg(CAST(over < 0 AS INT)) AS frac_over, avg(CAST(under < 0 AS INT)) AS frac_under, avg(CAST(empty < 0 AS INT)) AS frac_miss, count(DISTINCT prediction_raw) AS n_unique FROM w GROUP BY conv_id, neg),
z AS (SELECT *, round(CASE WHEN neg THEN 1.0 - 2.0 * abs(frac_good - 0.5) ELSE frac_over + frac_under + 0.5 * frac_miss END, 9)::DOUBLE AS value, CASE WHEN reward_std >= 0.04 AND n_unique >= 2 THEN 'signal' WHEN reward_mean >= 0.92 THEN 'saturated' WHEN reward_mean <= 0.20 THEN 'collapsed' ELSE 'flat' END AS verdict FROM q)"""


def _rollouts(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation's turns as rollouts for its first turn's target."""
    d = turns(spark, sf)
    first = d.groupBy("conv_id").agg(F.min_by("target", "turn").alias("target"), F.min_by("is_negative", "turn").alias("is_negative"))
    return d.select("conv_id", "turn", F.col("prediction_raw").alias("completion")).join(first, "conv_id").withColumn("sample_id", F.col("conv_id"))


@query(f"WITH {ROLL} SELECT conv_id, CAST(count(*) AS BIGINT) AS n, round(sum(total), 6)::DOUBLE AS total, round(sum(sim), 6)::DOUBLE AS edit, CAST(sum(empty) AS DOUBLE) AS empty, CAST(sum(over) AS DOUBLE) AS over, CAST(sum(under) AS DOUBLE) AS under, CAST(sum(leak) AS DOUBLE) AS leak FROM w GROUP BY conv_id")
def reward_one_tag(spark: SparkSession, sf: str) -> DataFrame:
    d = _rollouts(spark, sf).withColumn("r", R.one_tag(F.col("completion"), F.col("target"), F.col("is_negative")))
    return d.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("r.total"), 6).alias("total"), F.round(F.sum("r.edit"), 6).alias("edit"), *[F.sum(f"r.{k}").alias(k) for k in ("empty", "over", "under", "leak")])


@query(f"WITH {ROLL}, {GROUPS} SELECT conv_id AS sample_id, n, round(reward_mean, 6)::DOUBLE AS reward_mean, round(reward_std, 6)::DOUBLE AS reward_std, round(reward_min, 6)::DOUBLE AS reward_min, round(reward_max, 6)::DOUBLE AS reward_max, round(frac_good, 6)::DOUBLE AS frac_good, round(value, 6)::DOUBLE AS value, verdict, n_unique FROM z")
def group_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = probe.scored(_rollouts(spark, sf))
    return s.select("sample_id", "n", *[F.round(c, 6).alias(c) for c in ("reward_mean", "reward_std", "reward_min", "reward_max", "frac_good", "value")], "verdict", "n_unique")


@query(f"WITH {ROLL}, {GROUPS} SELECT conv_id AS sample_id FROM z WHERE frac_good BETWEEN 0.125 AND 0.875 AND reward_std >= 0.03")
def signal_gate(spark: SparkSession, sf: str) -> DataFrame:
    return probe.scored(_rollouts(spark, sf)).filter(probe.selectable()).select("sample_id")


@query(f"WITH {ROLL}, {GROUPS} SELECT verdict, count(*) AS n, round(avg(reward_mean), 6)::DOUBLE AS mean_reward, round(avg(CAST(verdict = 'signal' AS INT)), 6)::DOUBLE AS frac_signal FROM z GROUP BY verdict")
def group_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    s = probe.scored(_rollouts(spark, sf))
    return s.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("reward_mean"), 6).alias("mean_reward"), F.round(F.avg((F.col("verdict") == "signal").cast("double")), 6).alias("frac_signal"))


@query(f"""WITH {ROLL}, {GROUPS}, y AS (SELECT z.*, CAST(conv_id % 5 AS VARCHAR) AS scene FROM z) SELECT scene, CAST(grouping(scene) AS BIGINT) AS gid, count(*) AS n, round(avg(CAST(verdict = 'signal' AS INT)), 6)::DOUBLE AS frac_signal, round(avg(reward_mean), 6)::DOUBLE AS mean_of_means, round(avg(reward_std), 6)::DOUBLE AS mean_of_stds, {", ".join(f"CAST(count_if(verdict = '{v}') AS BIGINT) AS {v}" for v in R.VERDICTS)} FROM y GROUP BY GROUPING SETS ((), (scene))""")
def probe_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Groups over all and by scene: the share that still teaches, means of means and deviations, verdicts."""
    s = probe.scored(_rollouts(spark, sf)).withColumn("scene", (F.col("sample_id") % 5).cast("string"))
    d = probe.summary(s, "scene")
    return d.select("scene", "gid", "n", *[F.round(c, 6).alias(c) for c in ("frac_signal", "mean_of_means", "mean_of_stds")], *R.VERDICTS)


@query(TWO + f""", r AS (SELECT sample_id, CASE WHEN neg THEN 0 ELSE sim END AS source, CASE WHEN neg OR NOT said THEN 0 ELSE score END AS translation, CASE WHEN blank THEN 0.0 WHEN well_formed THEN 1.0 WHEN has_source AND has_translation THEN 0.4 WHEN has_source OR has_translation THEN 0.0 ELSE -0.5 END::DOUBLE AS xml,
CASE WHEN neg THEN CASE WHEN blank THEN 1.0 WHEN empty_shell OR truncated THEN 0.5 ELSE 0.0 END WHEN blank THEN -1.0 ELSE 0.0 END::DOUBLE AS empty, CASE WHEN neg AND said THEN -1.0 ELSE 0.0 END::DOUBLE AS hallucination, CASE WHEN NOT neg AND {OVER} THEN -1.0 ELSE 0.0 END::DOUBLE AS over, CASE WHEN contains(prediction_raw, '<|im_end|>') THEN -1.0 ELSE 0.0 END::DOUBLE AS leak FROM w)
SELECT sample_id, round(source, 6)::DOUBLE AS source, round(translation, 6)::DOUBLE AS translation, xml, empty, hallucination, over, leak, round(0.5 * source + translation + 0.5 * xml + 1.5 * empty + 1.5 * hallucination + 0.5 * over + 0.5 * leak, 6)::DOUBLE AS total FROM r""")
def reward_two_tags(spark: SparkSession, sf: str) -> DataFrame:
    """The two-tag set, its translation term by the Arrow n-gram score."""
    d = _predictions(spark, sf).withColumn("gt", X.format_target(F.col("target"), F.col("target")))
    score = X.chrf(X.parse_target(F.col("prediction"))["translation"], X.parse_target(F.col("gt"))["translation"])
    d = d.withColumn("score", score).withColumn("r", R.two_tags(F.col("prediction_raw"), F.col("gt"), F.col("is_negative"), F.col("score")))
    return d.select("sample_id", *[F.round(f"r.{k}", 6).alias(k) for k in ("source", "translation", "xml", "empty", "hallucination", "over", "leak", "total")])


def _rate(hit: str, of: str) -> str:
    return f"coalesce(count_if({of} AND {hit}) / nullif(count_if({of}), 0)::DOUBLE, 0)"


_RATES = {
    "strict_empty_rate": ("blank", "neg"),
    "effective_empty_rate": ("(blank OR empty_shell OR truncated)", "neg"),
    "broken_empty_rate": ("(NOT blank AND (empty_shell OR truncated))", "neg"),
    "hallucination_rate": ("said", "neg"),
    "plain_rate": ("NOT blank AND NOT has_source AND NOT has_translation", "neg"),
    "negative_over_rate": ("length(p) >= 400", "neg"),
    "pair_rate": ("has_source", "NOT neg"),
    "well_formed_rate": ("well_formed", "NOT neg"),
    "source_hit_rate": ("sim >= 0.85", "NOT neg"),
    "translation_hit_rate": ("score >= 0.6", "NOT neg"),
    "both_hit_rate": ("sim >= 0.85 AND score >= 0.6", "NOT neg"),
    "translation_empty_rate": ("tr = ''", "NOT neg"),
    "unclosed_rate": ("unclosed", "NOT neg"),
    "positive_over_rate": (OVER, "NOT neg"),
    "leak_rate": ("leak", "true"),
}
_MEANS = {
    "mean_source_similarity": "sim",
    "mean_score": "score",
    "mean_score_with_words": "plus",
    "mean_cjk_ratio": f"CASE WHEN tr = '' THEN 0 ELSE len(regexp_extract_all(tr, '{CJK_SQL}')) / length(tr)::DOUBLE END",
    "mean_length_ratio": "CASE WHEN g <> '' THEN length(tr) / length(g)::DOUBLE WHEN tr = '' THEN 1 ELSE 0 END",
}
TWO_TAG = "count(*) AS n, CAST(count_if(NOT neg) AS BIGINT) AS n_pos, CAST(count_if(neg) AS BIGINT) AS n_neg, " + ", ".join([*(f"{_rate(*v)} AS {k}" for k, v in _RATES.items()), *(f"round(coalesce(avg(CASE WHEN NOT neg THEN {v} END), 0), 6)::DOUBLE AS {k}" for k, v in _MEANS.items())])


def _two_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _predictions(spark, sf).withColumn("target", F.when(F.col("is_negative"), "").otherwise(X.format_target(F.col("target"), F.col("target"))))


@query(f"{TWO} SELECT role, {TWO_TAG} FROM w GROUP BY role")
def two_tag_report(spark: SparkSession, sf: str) -> DataFrame:
    """All metrics of the two-tag task by bucket."""
    d = metrics.two_tag_report(_two_tags(spark, sf), "role")
    return d.select("role", "n", "n_pos", "n_neg", *_RATES, *[F.round(k, 6).alias(k) for k in _MEANS])


@query(f"{TWO} SELECT {TWO_TAG} FROM w")
def two_tag_overall(spark: SparkSession, sf: str) -> DataFrame:
    d = metrics.two_tag_report(_two_tags(spark, sf))
    return d.select("n", "n_pos", "n_neg", *_RATES, *[F.round(k, 6).alias(k) for k in _MEANS])


@query(f"""{TWO}, first AS (SELECT conv_id, min_by(target, turn) AS gt, min_by(is_negative, turn) AS no FROM turns GROUP BY conv_id),
rr AS (SELECT w.conv_id, no, CASE WHEN blank THEN 0.0 WHEN well_formed THEN 1.0 WHEN has_source AND has_translation THEN 0.4 WHEN has_source OR has_translation THEN 0.0 ELSE -0.5 END::DOUBLE AS xml, CASE WHEN blank THEN -1.0 ELSE 0.0 END::DOUBLE AS empty, CASE WHEN {OVER} THEN -1.0 ELSE 0.0 END::DOUBLE AS over,
 CASE WHEN said THEN score ELSE 0 END AS translation, sim, CASE WHEN leak THEN -1.0 ELSE 0.0 END AS leak FROM w JOIN first USING (conv_id)),
qq AS (SELECT *, 0.5 * sim + translation + 0.5 * xml + 1.5 * empty + 0.5 * over + 0.5 * leak AS total FROM rr),
ss AS (SELECT conv_id, count(*) AS n, NOT any_value(no) AS selectable, avg(CAST(total >= 1.6 AS INT)) AS frac_good, avg(CAST(over < 0 AS INT)) AS frac_over, avg(CAST(empty < 0 AS INT)) AS frac_miss, avg(CAST(xml <= 0 AS INT)) AS frac_bad_xml, avg(total) AS mean, stddev_pop(total) AS std, max(total) / 2.0 AS top FROM qq GROUP BY conv_id)
SELECT conv_id AS sample_id, n, selectable, {", ".join(f"round(CASE WHEN selectable THEN {v} ELSE 0 END, 6)::DOUBLE AS {k}" for k, v in {"frac_good": "frac_good", "frac_over": "frac_over", "frac_miss": "frac_miss", "frac_bad_xml": "frac_bad_xml", "reward_mean": "mean", "reward_std": "std", "reward_max_frac": "top", "value": "frac_over + 0.5 * frac_miss + 0.5 * frac_bad_xml"}.items())} FROM ss""")
def two_tag_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of two-tag rollouts, each turn's against its own text: rates of failures, spread and value; negatives teach nothing."""
    d = _predictions(spark, sf)
    first = d.groupBy("conv_id").agg(F.min_by("is_negative", "turn").alias("no"))
    d = d.withColumn("gt", X.format_target(F.col("target"), F.col("target"))).join(first, "conv_id")
    d = d.withColumn("score", X.chrf(X.parse_target(F.col("prediction"))["translation"], X.parse_target(F.col("gt"))["translation"]))
    s = probe.scored_two_tags(d.select(F.col("conv_id").alias("sample_id"), F.col("prediction_raw").alias("completion"), F.col("gt").alias("target"), F.col("no").alias("is_negative"), "score"))
    return s.select("sample_id", "n", "selectable", *[F.round(c, 6).alias(c) for c in ("frac_good", "frac_over", "frac_miss", "frac_bad_xml", "reward_mean", "reward_std", "reward_max_frac", "value")])


RANKS = "WITH r AS (SELECT {v} AS v, row_number() OVER (ORDER BY {v}) - 1 AS i, count(*) OVER () AS n FROM {t}) SELECT "


@query(RANKS.format(v="n_chars", t="documents") + "max(CASE WHEN i = floor(n * (1.0::DOUBLE / 3) + 1e-9) THEN v END) AS low, max(CASE WHEN i = floor(n * (2.0::DOUBLE / 3) + 1e-9) THEN v END) AS high FROM r")
def tertile_cuts(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.nearest_rank(t(spark, sf, "documents"), "n_chars", {"low": 1 / 3, "high": 2 / 3})


@query(RANKS.format(v="n_chars", t="documents WHERE lang = 'en'") + "max(CASE WHEN i = floor(0.8 * n + 1e-9) THEN v END) AS p80 FROM r")
def p80_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.nearest_rank(t(spark, sf, "documents").filter("lang = 'en'"), "n_chars", {"p80": 0.8})


@query(RANKS.format(v="l_quantity", t="lineitem") + "max(CASE WHEN i = floor(0.5 * n + 1e-9) THEN v END) AS p50, max(CASE WHEN i = floor(0.9 * n + 1e-9) THEN v END) AS p90 FROM r")
def token_budget_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.nearest_rank(t(spark, sf, "lineitem"), "l_quantity", {"p50": 0.5, "p90": 0.9})


REASONS = f"""WITH {SAMPLES}, p AS (SELECT v AS p80 FROM (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents WHERE lang = 'en') WHERE i = floor(0.8 * n + 1e-9)),
x AS (SELECT *, {strip_sql('target')} AS m FROM samples),
parts AS (SELECT sample_id, length(m) AS n, k.k AS k, substr(m, k.k * 1000 + 1, 1023) AS part FROM x, LATERAL (SELECT unnest(range(0, CAST(ceil(length(m) / 1000.0) AS BIGINT))) AS k) k WHERE pool_id = 'en'),
grams AS (SELECT sample_id, substr(part, j.j, 24) AS g FROM parts, LATERAL (SELECT unnest(range(1, least(1000, n - 24 - k * 1000) + 1)) AS j) j),
again AS (SELECT DISTINCT sample_id FROM (SELECT sample_id, g FROM grams GROUP BY ALL HAVING count(*) >= 3) WHERE len(list_distinct(list_filter(string_split(g, ''), lambda c: c NOT IN (' ', chr(9))))) >= 3),
r AS (SELECT sample_id, chrome, m, CASE WHEN length(m) = 0 THEN NULL WHEN pool_id = 'de' THEN 'real' WHEN pool_id = 'fr' THEN 'multi_frag' WHEN pool_id = 'es' THEN 'semantic_group' WHEN len(list_filter(list_transform(string_split(m, chr(10)), lambda l: {strip_sql('l')}), lambda l: l <> '')) <> len(list_distinct(list_filter(list_transform(string_split(m, chr(10)), lambda l: {strip_sql('l')}), lambda l: l <> ''))) OR length(m) - length(replace(m, '|', '')) >= 6 OR contains(m, '♫') OR sample_id IN (SELECT sample_id FROM again) THEN 'repeat_risk' WHEN length(m) >= p80 THEN 'long_block' END AS reason FROM x, p)
SELECT sample_id, reason, CAST(floor(round((CASE reason WHEN 'real' THEN 1.0::DOUBLE WHEN 'multi_frag' THEN 0.9::DOUBLE WHEN 'semantic_group' THEN 0.7::DOUBLE WHEN 'repeat_risk' THEN 0.6::DOUBLE WHEN 'long_block' THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END + 0.15 * least(1.0, length(m) / 800.0::DOUBLE) + CASE WHEN chrome = 'chrome' THEN 0.15::DOUBLE ELSE 0 END), 4) * 1000 + 1e-6) AS BIGINT) AS score_milli FROM r"""


def _reasoned(spark: SparkSession, sf: str) -> DataFrame:
    d = samples(spark, sf)
    pool = F.element_at(F.create_map(*[F.lit(x) for x in ("en", "core_inner", "fr", "multi_frag", "de", "real_labeled", "es", "semantic_group")]), F.col("pool_id"))
    p80 = ranking.nearest_rank(t(spark, sf, "documents").filter("lang = 'en'"), "n_chars", {"p80": 0.8}).first().p80  # one number, a plan parameter
    return d.withColumn("reason", C.reason(pool, F.col("target"), F.lit(1), F.lit(0), C.repeat_risk(F.when(pool == "core_inner", F.col("target"))), F.lit(p80)))


@query(REASONS)
def candidate_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why a sample is a candidate, and how hard it is; the long ones from the 80th percentile of English lengths on."""
    d = _reasoned(spark, sf)
    return d.select("sample_id", "reason", C.hard_score(F.col("reason"), F.col("target"), F.lit(1), F.col("chrome"), F.lit(1)).alias("score")).select("sample_id", "reason", F.floor(F.col("score") * 1000 + 1e-6).alias("score_milli"))


#: Shares of reasons in the pool.
POOL_MIX = {"multi_frag": 0.30, "real": 0.26, "semantic_group": 0.16, "long_block": 0.16, "repeat_risk": 0.12}


@query()
def candidate_pool(spark: SparkSession, sf: str) -> DataFrame:
    """A pool of 400 candidates by reason, under caps and without near copies of texts."""
    cuts = ranking.nearest_rank(t(spark, sf, "documents"), "n_chars", {"low": 1 / 3, "high": 2 / 3}).first()  # plan parameters
    d = _reasoned(spark, sf).withColumn("tertile", C.tertile(F.col("n_chars"), F.lit(cuts.low), F.lit(cuts.high)))
    d = d.withColumn("score", C.hard_score(F.col("reason"), F.col("target"), F.lit(1), F.col("chrome"), F.col("tertile"))).withColumn("bits", dedup.text_bits(F.col("target")))
    return sampling.candidate_pool(d, 400, POOL_MIX, 7, "sample_id", "reason", "score", "page_id", "template_stem", "tertile", "bits")
