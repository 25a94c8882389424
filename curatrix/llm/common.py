"""Helpers that the corpus operators share: tables, the shared folder, written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from collections.abc import Iterator

    import pyarrow as pa
    from pyarrow.fs import FileSystem

#: A key of over 1 / HOT of all rows is joined by broadcast: there are fewer than HOT of them.
HOT = 2_000
#: Rows of an Arrow batch of whole texts, at most.
BATCH = 1_000
#: Marks in a bucket of a list of them, about.
BUCKET = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir, with its scheme. Where that is unset: a temporary one, if all runs in this process, as in tests; else an error, as executors could not read what others write."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        sc = spark.sparkContext  # the setting itself can't be changed in a running session
        found = sc._curatrix_folder = getattr(sc, "_curatrix_folder", None) or "file://" + tempfile.mkdtemp(prefix="curatrix-")
    fs, at = _fs(spark, found)
    return fs.makeQualified(at).toString().rstrip("/")


def arrow_uri(uri: str) -> str:
    """A folder as Hadoop names it, as Arrow does."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file" and not rest.startswith("//"):
        rest = "//" + rest
    return ("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest


def filesystem(uri: str) -> tuple[FileSystem, str]:
    """Arrow's file system and path for a folder with its scheme (see shared_dir)."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(arrow_uri(uri))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder name in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    fs, at = _fs(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def written(df: DataFrame, kind: str) -> DataFrame:
    """df as a table in the shared folder: computed once, lineage cut, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{new_folder(spark, kind)}/t"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop_written(df: DataFrame) -> None:
    if path := getattr(df, "_written_at", None):
        remove(df.sparkSession, path)


def short_batches(df: DataFrame) -> DataFrame:
    """df, in whose session Arrow batches have BATCH rows at most from now on: rows hold whole texts, and batches of them stand in an executor's memory beside its heap several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH:
        df.sparkSession.conf.set(key, str(BATCH))
    return df


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, for work that takes much more memory than its input."""
    import pyarrow as pa

    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        del b
        pa.default_memory_pool().release_unused()


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """All rows if there are at most `bound`; else those whose key hashes under the share that leaves about 95 % of `bound`."""
    n = df.count()
    if n <= bound:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) < int((1 << 30) * 0.95 * bound / n))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_join(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """Inner join of rows to `of`: one row a key, with n, how many rows have it. Rows of hot keys don't move; the others are shuffled."""
    total = of.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT > total
    few, rest = of.filter(hot).drop("n"), of.filter(~hot).drop("n")  # fewer than HOT rows; no key of the rest can fill a task
    cold = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(cold.join(rest, key))


def _is_scan(df: DataFrame) -> bool:
    """Whether df is rows of Parquet files, each at most once, so that file and row number name it whenever it is read."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation" and "Parquet" in plan.relation().fileFormat().getClass().getSimpleName()


def located(df: DataFrame, kind: str) -> DataFrame:
    """df with the place of each row, file and row, under names that df does not have; written first, if it isn't rows of Parquet files."""
    df = df.drop("file", "row")
    df = df if _is_scan(df) else written(df, kind)
    return df.withColumn("file", F.col("_metadata.file_path")).withColumn("row", F.col("_metadata.row_index"))


@dataclass(frozen=True)
class Marks:
    """A list of places with a number each, in the shared folder, by bucket of the file; folder is "" if there is none."""

    folder: str
    buckets: int

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("file"), F.lit(self.buckets)).alias("bucket")


def mark(places: DataFrame, kind: str) -> Marks:
    """Of places (a written table of file, row, value): what tasks need to look up rows that they read, so that big rows need not be joined."""
    n = places.count()
    marks = Marks(f"{new_folder(places.sparkSession, kind)}/t" if n else "", max(1, -(-n // BUCKET)))
    if n:
        places.select(marks.bucket(), "file", "row", "value").repartition("bucket").sortWithinPartitions("bucket", "file", "row").write.partitionBy("bucket").parquet(marks.folder)
    return marks


class Lookup:
    """Values of marked rows, in a task. Holds the marks of one file at a time."""

    def __init__(self, marks: Marks) -> None:
        self.folder, self.file, self.rows, self.values = marks.folder, None, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, file: str, row: int, bucket: int) -> int | None:
        if not self.folder:
            return None
        if file != self.file:
            self._open(file, bucket)
        at = int(np.searchsorted(self.rows, row))
        return int(self.values[at]) if at < len(self.rows) and self.rows[at] == row else None

    def _open(self, file: str, bucket: int) -> None:
        from pyarrow import dataset
        from pyarrow.fs import FileType

        fs, base = filesystem(f"{self.folder}/bucket={bucket}")
        if fs.get_file_info(base).type == FileType.NotFound:
            found = np.zeros((2, 0), np.int64)
        else:
            t = dataset.dataset(base, filesystem=fs, format="parquet").to_table(["row", "value"], filter=dataset.field("file") == file)
            found = np.stack([t["row"].to_numpy(), t["value"].to_numpy()])
            found = found[:, np.argsort(found[0])]
        self.file, self.rows, self.values = file, *found
