"""Append-only results: resume by key, rolling summaries, a trigger at a threshold.

What a batch writes goes to a folder named by the batch, so a batch that is run anew replaces only its own part.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_rows(spark: SparkSession, path: str, schema: str, files_a_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)


def _batches(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the batches whose summary is whole."""
    fs, at = _fs(spark, f"{out}/batch=*/_SUCCESS")
    return sorted(int(f.getPath().getParent().getName().removeprefix("batch=")) for f in fs.globStatus(at) or [])


def rolling_summary(stream: DataFrame, key: str, value: str, at: str, out: str, checkpoint: str):
    """Per key: count and mean so far; see rolling."""
    return rolling(stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(at).alias("last")), out, checkpoint)


def rolling(by: DataFrame, out: str, checkpoint: str):
    """A streaming aggregate, written anew with each batch; ends when all files are read. An older one goes only after a newer one is whole."""

    def step(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        for old in _batches(df.sparkSession, out)[:-1]:
            fs, at = _fs(df.sparkSession, f"{out}/batch={old}")
            fs.delete(at, True)

    return by.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()


def latest_summary(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/batch={_batches(spark, out)[-1]}")


def pending_batch(stream: DataFrame, done_path: str, key: str, work, checkpoint: str):
    """Runs `work` on the rows of each batch whose key has no result yet, and writes what it returns as a part of its own."""

    def step(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        own = f"{zlib.crc32(checkpoint.encode())}-{batch}"
        left = df.dropDuplicates([key])
        fs, at = _fs(spark, f"{done_path}/part=*")
        if any(f.getPath().getName() != f"part={own}" for f in fs.globStatus(at) or []):
            left = left.join(spark.read.parquet(done_path).filter(F.col("part") != own).select(key), key, "left_anti")
        work(left).write.mode("overwrite").parquet(f"{done_path}/part={own}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()


def reached(df: DataFrame, n: int) -> bool:
    """Whether there are n rows; stops reading when there are."""
    return df.limit(n).count() >= n
