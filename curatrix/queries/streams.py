"""Streams over the test tables, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import resume
from .base import query, t


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.readStream.schema(t(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(event_id) AS last FROM events GROUP BY event_type")
def stream_rolling_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A rolling summary of an append-only source, after its last batch."""
    folder = shared_folder(spark, "summary")
    resume.rolling_summary(_events(spark, sf), "event_type", "value", "event_id", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return resume.latest_summary(spark, f"{folder}/out").withColumn("mean", F.round("mean", 6))


@query("SELECT user_id, min(event_id) > -1 AS done FROM events GROUP BY user_id")
def stream_resumed_work(spark: SparkSession, sf: str) -> DataFrame:
    """Each key is worked on once, however often the source is read."""
    folder = shared_folder(spark, "resumed")
    for k in range(2):
        keys = _events(spark, sf).select("user_id", "event_id")
        resume.pending_batch(keys, f"{folder}/done", "user_id", lambda d: d.select("user_id", (F.col("event_id") > -1).alias("done")), f"{folder}/checkpoint{k}").awaitTermination()
    return spark.read.parquet(f"{folder}/done").drop("part")


@query("SELECT event_type AS scene, count(*) AS n, round(avg(CAST(value >= 50 AS INT)), 6)::DOUBLE AS frac_signal, round(avg(value), 6)::DOUBLE AS mean_of_means, round(avg(value / 2), 6)::DOUBLE AS mean_of_stds FROM events GROUP BY event_type")
def stream_probe_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Scored groups as they come: by scene the share that still teaches, and means of means and deviations."""
    folder = shared_folder(spark, "probe")
    d = _events(spark, sf).select(F.col("event_type").alias("scene"), F.col("value").alias("reward_mean"), (F.col("value") / 2).alias("reward_std"), F.when(F.col("value") >= 50, "signal").otherwise("flat").alias("verdict"))
    by = d.groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("verdict") == "signal").cast("double")).alias("frac_signal"), F.avg("reward_mean").alias("mean_of_means"), F.avg("reward_std").alias("mean_of_stds"))
    resume.rolling(by, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return resume.latest_summary(spark, f"{folder}/out").select("scene", "n", *[F.round(c, 6).alias(c) for c in ("frac_signal", "mean_of_means", "mean_of_stds")])
