"""Reports: conditional aggregates in one pass, over any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X


def rate(hit: Column, of: Column) -> Column:
    """Share of the rows of a class that hit; 0 for an empty class."""
    return F.coalesce(F.try_divide(F.count_if(of & hit), F.count_if(of)), F.lit(0.0))


def mean_of(v: Column, of: Column) -> Column:
    return F.coalesce(F.avg(F.when(of, v)), F.lit(0.0))


def examples(df: DataFrame) -> DataFrame:
    """Adds to (target, prediction, prediction_raw, is_negative) what the reports need."""
    neg = F.coalesce("is_negative", F.lit(False)) | X.is_blank(F.col("target"))
    sim = X.edit_similarity(F.col("prediction"), F.col("target"))
    return df.withColumns({"neg": neg, "sim": sim, "empty_pred": X.is_blank(F.col("prediction")), "over": X.over_extraction(F.col("prediction"), F.col("target")), "leak": X.has_format_leak(F.coalesce("prediction_raw", "prediction"))})


def report_columns(hit_at: float = 0.85) -> list[Column]:
    pos, neg = ~F.col("neg"), F.col("neg")
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(pos).alias("n_pos"),
        F.count_if(neg).alias("n_neg"),
        rate(F.col("sim") >= hit_at, pos).alias("block_hit_rate"),
        F.round(mean_of(F.col("sim"), pos), 9).alias("mean_edit_similarity"),
        rate(F.col("empty_pred"), neg).alias("empty_rate"),
        rate(F.col("empty_pred"), pos).alias("miss_rate"),
        rate(F.col("over"), pos).alias("over_rate"),
        rate(F.col("leak"), F.lit(True)).alias("leak_rate"),
    ]


def report(df: DataFrame, *by: str, hit_at: float = 0.85) -> DataFrame:
    """By buckets, blank ones named unknown; one row without."""
    d = examples(df)
    if not by:
        return d.agg(*report_columns(hit_at))
    return d.groupBy(*[F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")).alias(c) for c in by]).agg(*report_columns(hit_at))


def report_sets(df: DataFrame, sets: list[list[str]], hit_at: float = 0.85) -> DataFrame:
    """All groupings in one scan."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    d = examples(df).withColumns({c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")) for c in names})
    return d.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(F.grouping_id().alias("gid"), *report_columns(hit_at))


def row_scores(df: DataFrame, hit_at: float = 0.85, related_at: float = 0.5) -> DataFrame:
    """Adds to (target, prediction) what a probe asks of each row."""
    p, g = F.col("prediction"), F.col("target")
    d = df.withColumns({"__sim": X.edit_similarity(p, g), "pred_empty": X.is_blank(p), "gt_empty": X.is_blank(g), "furniture": C.is_furniture(p) & ~X.is_blank(g), "in_gt": C.within_target(p, g)})
    return d.withColumns({"sim": F.round("__sim", 4), "hit": F.col("__sim") >= hit_at, "related": F.col("__sim") >= related_at}).drop("__sim")


def score_rates(scored: DataFrame, *by: str) -> DataFrame:
    """Of row_scores with is_negative: rates to four places, null where a class is empty."""
    neg = F.coalesce("is_negative", F.lit(False)) | F.col("gt_empty")
    share = lambda c, of=None: F.round(F.avg((c if of is None else F.when(of, c)).cast("int")), 4)
    columns = [F.count(F.lit(1)).alias("n"), share(F.col("hit")).alias("hit_rate"), share(F.col("hit"), ~neg).alias("hit_rate_pos"), share(F.col("pred_empty"), neg).alias("empty_rate_neg")]
    return scored.groupBy(*by).agg(*columns) if by else scored.agg(*columns)


def two_tag_examples(df: DataFrame) -> DataFrame:
    """Adds p and g, the parsed prediction and target, and the classes of rows."""
    d = df.withColumn("p", X.parse_target(F.col("prediction"))).withColumn("g", X.parse_target(F.col("target")))
    neg = F.coalesce("is_negative", F.lit(False)) | X.is_blank(F.col("target"))
    strict = X.is_blank(F.col("prediction"))
    return d.withColumns({"neg": neg, "strict": strict, "effective": strict | F.col("p.empty_shell") | F.col("p.truncated"), "source_sim": X.edit_similarity(F.col("p.source"), F.col("g.source"))})


def two_tag_report(df: DataFrame, *by: str, source_at: float = 0.85, score_at: float = 0.60) -> DataFrame:
    """df: target, prediction, is_negative, and prediction_raw if it differs. By buckets, blank ones named unknown; one row without."""
    d = two_tag_examples(df)
    pos, neg, said, meant = ~F.col("neg"), F.col("neg"), X.strip(F.col("p.translation")), X.strip(F.col("g.translation"))
    over = lambda gt: X.over_extraction(F.col("p.source"), gt)
    d = d.withColumns({"score": X.chrf("p.translation", "g.translation"), "with_words": X.chrf_plus("p.translation", "g.translation"), "said": said, "cjk": X.cjk_ratio(said), "length_ratio": X.length_ratio(said, meant), "over": F.when(neg, over(F.lit(""))).otherwise(over(F.col("g.source"))), "leak": X.has_format_leak(F.coalesce("prediction_raw", "prediction") if "prediction_raw" in df.columns else F.col("prediction"))})
    source, translation = F.col("source_sim") >= source_at, F.col("score") >= score_at
    hits = {
        "strict_empty_rate": (F.col("strict"), neg),
        "effective_empty_rate": (F.col("effective"), neg),
        "broken_empty_rate": (F.col("effective") & ~F.col("strict"), neg),
        "hallucination_rate": (~X.is_blank(F.col("p.source")), neg),
        "plain_rate": (~F.col("strict") & ~F.col("p.has_source") & ~F.col("p.has_translation"), neg),
        "negative_over_rate": (F.col("over"), neg),
        "pair_rate": (F.col("p.has_source"), pos),
        "well_formed_rate": (F.col("p.well_formed"), pos),
        "source_hit_rate": (source, pos),
        "translation_hit_rate": (translation, pos),
        "both_hit_rate": (source & translation, pos),
        "translation_empty_rate": (F.col("said") == "", pos),
        "unclosed_rate": (F.col("p.unclosed_translation"), pos),
        "positive_over_rate": (F.col("over"), pos),
        "leak_rate": (F.col("leak"), F.lit(True)),
    }
    means = {"mean_source_similarity": "source_sim", "mean_score": "score", "mean_score_with_words": "with_words", "mean_cjk_ratio": "cjk", "mean_length_ratio": "length_ratio"}
    columns = [F.count(F.lit(1)).alias("n"), F.count_if(pos).alias("n_pos"), F.count_if(neg).alias("n_neg"), *[rate(*v).alias(k) for k, v in hits.items()], *[F.round(mean_of(F.col(v), pos), 9).alias(k) for k, v in means.items()]]
    return d.groupBy(*[F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")).alias(c) for c in by]).agg(*columns) if by else d.agg(*columns)


def paired_variants(scored: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Of row_scores with variant: rows that have both variants, whether they agree, and whether b is better or worse than a."""
    side = lambda v, name: scored.filter(F.col("variant") == v).select(key, F.struct("prediction", "hit", "pred_empty", "gt_empty").alias(name))
    j = side(a, "x").join(side(b, "y"), key)
    same = X.normalize_text(F.coalesce("x.prediction", F.lit(""))) == X.normalize_text(F.coalesce("y.prediction", F.lit("")))
    return j.select(key, "x.gt_empty", F.col("x.hit").alias("hit_a"), F.col("y.hit").alias("hit_b"), same.alias("agree"), (~F.col("x.hit") & F.col("y.hit")).alias("improved"), (F.col("x.hit") & ~F.col("y.hit")).alias("regressed"))


def variant_rates(scored: DataFrame, pool: str) -> DataFrame:
    """Of row_scores with variant: by variant, and by pool and variant, in one scan; null rates where a class is empty."""
    share = lambda c, of=None: F.round(F.avg((c if of is None else F.when(of, c)).cast("double")), 4)
    pos = ~F.col("gt_empty")
    columns = [F.count(F.lit(1)).alias("n"), share(F.col("hit")).alias("hit_rate"), share(F.col("sim")).alias("mean_sim"), share(F.col("pred_empty")).alias("empty_rate"), F.count_if(pos).alias("n_pos"), share(F.col("hit"), pos).alias("pos_hit_rate"), share(F.col("pred_empty"), ~pos).alias("neg_empty_rate")]
    return scored.groupingSets([[F.col("variant")], [F.col(pool), F.col("variant")]], F.col(pool), F.col("variant")).agg(F.grouping_id().alias("gid"), *columns)
