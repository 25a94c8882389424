"""Token counts by separator scan of flat token files without an index.

A flat file holds documents' token ids as 16-bit little-endian numbers, each document ended by the end-of-document id. A
file is cut into byte blocks; a task reads one block as an array and finds all separators in one vectorised comparison.
Blocks are stitched by a prefix scan: the exclusive running maximum of the last separator's place gives the tokens that a
block's first document has in earlier blocks, the running sum of separators that document's number in its file.

Nulls: a null text is an empty document of 0 tokens. The separator's own string in a text is ordinary text. Repeated rows
count on their own; very long texts span blocks. An empty table writes no file. A file that does not end in a separator
has one more document. Only doc_id and text are read, whatever other columns are called. A vocabulary of over 65,536 ids,
or a separator that is no special token of it, is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common

#: Bytes of a block and, at most about, of a file.
BLOCK, FILE = 8 << 20, 256 << 20
END = 49407
ORDER = "file string, ordinal long, doc_id long"


def write(docs: DataFrame, folder: str, path: str, end: int = END) -> DataFrame:
    """Flat token files; returns which document (doc_id) is which in them (file, ordinal), a table that lists the files that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = common.filesystem(folder)
        coder, out, name, size, n = bpe.load(path), None, "", 0, 0
        if len(coder.tokens) > 1 << 16 or end not in coder.special.values():
            raise ValueError(f"ids must fit 16 bits, and {end} must be a special token of {path}")
        for b in batches:
            names, numbers = [], []
            for t in b.column(1):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.u16", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                ids = np.frombuffer(coder.encode_ordinary(t.as_py()), "<u4").astype("<u2").tobytes() + end.to_bytes(2, "little")
                out.write(ids)
                names.append(name)
                numbers.append(n)
                size, n = size + len(ids), n + 1
                if size >= FILE:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int64()), b.column(0)], ["file", "ordinal", "doc_id"])
        if out is not None:
            out.close()

    return common.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ORDER), "token-order")


def blocks(spark: SparkSession, folder: str, files: DataFrame, size: int = BLOCK) -> DataFrame:
    """file, at (first byte), n (bytes) of each block of the files (file, bytes)."""
    return files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(size).cast("long"))).alias("at"), "bytes").select("file", "at", F.least(F.lit(size).cast("long"), F.col("bytes") - F.col("at")).alias("n"), "bytes").filter("n > 0")


def sizes(files: DataFrame, folder: str) -> DataFrame:
    """bytes of each file, asked of the store by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = common.filesystem(folder)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.size for x in fs.get_file_info([f"{base}/{f}" for f in b.column(0).to_pylist()])], pa.int64())], ["file", "bytes"])

    return files.select("file").mapInArrow(run, "file string, bytes long")


def scanned(parts: DataFrame, folder: str, end: int = END) -> DataFrame:
    """Of each block: places (in ids, from the file's start) of its separators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = common.filesystem(folder)
        for b in batches:
            for file, at, n, total in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_input_file(f"{base}/{file}") as f:
                    f.seek(at)
                    found = np.flatnonzero(np.frombuffer(f.read(n), "<u2") == end) + at // 2
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([at], pa.int64()), pa.array([at + n == total]), pa.array([total // 2], pa.int64()), pa.array([found], pa.list_(pa.int64()))], ["file", "at", "final", "total", "ends"])

    return parts.mapInArrow(run, "file string, at long, final boolean, total long, ends array<bigint>")


def stitched(found: DataFrame) -> DataFrame:
    """file, ordinal, n_tokens: the prefix scan over blocks of a file (at most FILE / BLOCK and one), then differences."""
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.when(F.col("final") & (F.col("total") - 1 > F.greatest(F.coalesce(F.array_max("ends"), F.lit(-1)), F.col("last"))), F.array_append("ends", F.col("total"))).otherwise(F.col("ends"))
    d = found.withColumn("last", F.coalesce(F.max(F.array_max("ends")).over(w), F.lit(-1))).withColumn("before", F.coalesce(F.sum(F.size("ends")).over(w), F.lit(0)))
    d = d.withColumn("ends", ends)
    counts = F.zip_with("ends", F.concat(F.array("last"), F.slice("ends", F.lit(1), F.greatest(F.size("ends") - 1, F.lit(0)))), lambda e, p: e - p - 1)
    return d.filter(F.size("ends") > 0).select("file", "before", F.posexplode(counts).alias("i", "n_tokens")).select("file", (F.col("before") + F.col("i")).alias("ordinal"), "n_tokens")


def count(spark: SparkSession, folder: str, order: DataFrame, end: int = END, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens of each document of the order table."""
    files = sizes(order.select("file").distinct(), folder)
    return order.join(stitched(scanned(blocks(spark, folder, files, block).repartition(common.tasks(spark), "file", "at"), folder, end)).hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "tokens")
    order = write(common.table(spark, sf_dir, "documents"), folder, bpe.default_path())
    return count(spark, folder, order)
