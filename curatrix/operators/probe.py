"""Groups of rollouts: score, summarise, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rewards as R

ONE_TAG_CEILING = {"positive": 1.0, "negative": 2.5}


def group_stats(df: DataFrame, key: list[str], reward: Column, extra: list[Column] | None = None) -> DataFrame:
    """n, mean, population deviation, min, max and range of a group's rewards."""
    stats = [F.count(F.lit(1)).alias("n"), F.round(F.avg(reward), 9).alias("reward_mean"), F.round(F.stddev_pop(reward), 9).alias("reward_std"), F.round(F.min(reward), 9).alias("reward_min"), F.round(F.max(reward), 9).alias("reward_max"), F.round(F.max(reward) - F.min(reward), 9).alias("reward_range")]
    return df.groupBy(*key).agg(*stats, *(extra or []))


def scored(rollouts: DataFrame) -> DataFrame:
    """rollouts (sample_id, completion, target, is_negative): one row a group, with rates of failures, value and verdict."""
    d = rollouts.withColumn("r", R.one_tag(F.col("completion"), F.col("target"), F.col("is_negative")))
    good = F.col("r.total") >= 0.8 * F.when(F.col("is_negative"), ONE_TAG_CEILING["negative"]).otherwise(ONE_TAG_CEILING["positive"])
    share = lambda c: F.avg(c.cast("double"))
    extra = [share(good).alias("frac_good"), share(F.col("r.over") < 0).alias("frac_over"), share(F.col("r.under") < 0).alias("frac_under"), share(F.col("r.empty") < 0).alias("frac_empty_miss"), F.count_distinct("completion").alias("n_unique")]
    s = group_stats(d, ["sample_id", "is_negative"], F.col("r.total"), extra)
    value = F.when(F.col("is_negative"), 1.0 - 2.0 * F.abs(F.col("frac_good") - 0.5)).otherwise(F.col("frac_over") + F.col("frac_under") + 0.5 * F.col("frac_empty_miss"))
    return s.withColumn("value", F.round(value, 9)).withColumn("verdict", R.verdict(F.col("reward_mean"), F.col("reward_std"), F.col("n_unique")))


def scored_two_tags(rollouts: DataFrame, w: R.TwoTagWeights = R.TwoTagWeights(), good: float = 0.8) -> DataFrame:
    """rollouts (sample_id, completion, target, is_negative, score: the n-gram score of the translations): one row a group, valued by dumps, misses and broken tags; groups of negatives are not selectable, and all their numbers are 0."""
    top = w.ceiling()
    d = rollouts.withColumn("r", R.two_tags(F.col("completion"), F.col("target"), F.lit(False), F.col("score"), w)).withColumn("total", F.col("r.total"))
    share = lambda c: F.avg(c.cast("double"))
    s = d.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"),
        (~F.bool_or(F.coalesce("is_negative", F.lit(False)))).alias("selectable"),
        share(F.col("total") >= good * top).alias("frac_good"),
        share(F.col("r.over") < 0).alias("frac_over"),
        share(F.col("r.empty") < 0).alias("frac_miss"),
        share(F.col("r.xml") <= 0).alias("frac_bad_xml"),
        F.avg("total").alias("reward_mean"),
        F.stddev_pop("total").alias("reward_std"),
        (F.max("total") / top).alias("reward_max_frac"),
    )
    s = s.withColumn("value", F.col("frac_over") + 0.5 * F.col("frac_miss") + 0.5 * F.col("frac_bad_xml"))
    return s.select("sample_id", "n", "selectable", *[F.when(F.col("selectable"), F.col(c)).otherwise(0.0).alias(c) for c in s.columns[3:]])


def selectable(least_good: float = 0.125, most_good: float = 0.875, least_std: float = 0.03, least_max: float = 0.0) -> Column:
    """A group that still teaches: some good, some bad, spread, and for positives a near-perfect one."""
    top = F.col("reward_max") / F.when(F.col("is_negative"), ONE_TAG_CEILING["negative"]).otherwise(ONE_TAG_CEILING["positive"])
    return F.col("frac_good").between(least_good, most_good) & (F.col("reward_std") >= least_std) & (top >= least_max)


def high_value(least_max: float) -> Column:
    return ~F.col("is_negative") & (F.coalesce("scene", F.lit("")) != "empty") & (F.col("verdict") == "signal") & (F.col("reward_max") >= least_max)


def summary(groups: DataFrame, *by: str) -> DataFrame:
    """Of scored groups, over all and by the given columns in one scan: counts, the share that still teaches, means of means and of deviations, and counts of verdicts."""
    columns = [F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("verdict") == "signal").cast("double")), 9).alias("frac_signal"), F.round(F.avg("reward_mean"), 9).alias("mean_of_means"), F.round(F.avg("reward_std"), 9).alias("mean_of_stds"), *[F.count_if(F.col("verdict") == v).alias(v) for v in R.VERDICTS]]
    return groups.groupingSets([[], *[[F.col(c)] for c in by]], *[F.col(c) for c in by]).agg(F.grouping_id().alias("gid"), *columns)


def n_scored(groups: DataFrame, known: int | None = None) -> int:
    """How many groups are scored: what a summary says, else their count."""
    return known if known is not None else groups.count()


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What has no result yet."""
    return rows.join(done.select(key), key, "left_anti")


def agreement(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """How far two sets of predictions agree on the rows that both have."""
    j = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").eqNullSafe(F.col("y"))).alias("same"))
