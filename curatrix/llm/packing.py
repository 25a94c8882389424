"""Best-fit packing by sum of squares.

Pieces go one by one, long ones first, into the open sequence (or a new one) that makes the sum over gaps g of the squared
number of open sequences with gap g least; ties go to the smaller gap. Only documents of over LENGTH tokens are cut. The
rule keeps gaps of all kinds open, which pays if some mix of lengths fills them; where none does (say, all pieces have 500
tokens), gaps that hardly any piece fits count as full.

The job is dealt: each piece has a number of its own, and goes by its hash to one of the groups of about GROUP, each
packed by a task of its own from lengths alone; repeated rows, too, spread evenly. What groups leave in sequences that
are less than FULL full is packed again, in groups of about GROUP pieces, so the loss is a few sequences a group of the
second round rather than of each first one.

Nulls: a null text is empty, one separator long; a null doc_id is packed like any other. Repeated rows are documents of
their own. Very long texts are cut, ties of length go by crc32, doc_id, piece and number. An empty table gives an empty
result. Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

LENGTH = 4096
SEPARATOR = 1
GROUP = 40_000
FULL = 0.98
#: What may be wasted before other bins count as full, and the parts of all tokens that pieces under the gap then have.
WASTE, PARTS = 0.005, (0.001, 0.01, 0.1)
OUT = ("doc_id", "piece", "start", "length", "ids_crc32")


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece: one pass over whole texts."""
    end = SEPARATOR.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        for b in batches:
            rows = []
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = coder.encode(t.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return common.short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, size: int = LENGTH, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the given order; and what each bin holds. A bin with a gap under `least` counts as full until only shorter pieces are left."""
    n = np.zeros(size + 1, np.int64)  # open bins by gap
    by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    to, at, held = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    last = max((i for i, a in enumerate(lengths.tolist()) if a >= least), default=-1)
    never = np.iinfo(np.int64).max
    for i, a in enumerate(lengths.tolist()):
        if least > 1 and i > last:
            least = 1
            n = np.array([len(x) for x in by_gap], np.int64)
        # A bin of gap g becomes one of g - a: 2 (n[g-a] - n[g]) + 2, but 1 - 2 n[g] if that fills it.
        gain = 2 * (n[: size + 1 - a] - n[a:]) + 2
        gain[:least] = 1 - 2 * n[a : a + least]
        gain[n[a:] == 0] = never
        new = 2 * n[size - a] + 1 if size - a >= least else 0
        k = int(gain.argmin())
        if gain[k] <= new and gain[k] != never:
            b = by_gap[k + a].pop()
            n[k + a] -= 1
        else:
            b, k = len(held), size - a
            held.append(0)
        to[i], at[i] = b, held[b]
        held[b] += a
        if k:
            by_gap[k].append(b)
            n[k] += k >= least
    return to, at, np.array(held, np.int64)


def fewest(lengths: np.ndarray, size: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sum_of_squares with all gaps open. Where that wastes over WASTE, as it does if no mix of lengths fills a bin, also with gaps as full that only a small part of all tokens could go into; the fewest bins count."""
    best = sum_of_squares(lengths, size)
    total = int(lengths.sum())
    in_order = np.sort(lengths)
    upto = np.cumsum(in_order)
    for part in PARTS:
        if len(best[2]) <= -(-total // size) * (1 + WASTE) + 1:
            break
        found = sum_of_squares(lengths, size, int(in_order[np.searchsorted(upto, total * part, "right")]))
        best = min(best, found, key=lambda x: len(x[2]))
    return best


def _packed(df: DataFrame, groups: int, size: int) -> DataFrame:
    """Adds g, bin, offset and held to each row, group by group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "ids_crc32", "doc_id", "piece", "number"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        to, at, held = fewest(pdf["length"].to_numpy(), size)
        return pdf.assign(bin=to, offset=at, held=held[to] if len(held) else to)

    d = df.withColumn("g", F.pmod(F.xxhash64("number"), F.lit(groups)))
    schema = ", ".join(f"{c} {t}" for c, t in d.dtypes) + ", bin long, offset long, held long"
    return d.groupBy("g").applyInPandas(run, schema)


def pack(found: DataFrame, size: int = LENGTH, group: int = GROUP) -> DataFrame:
    """pieces() with sequence_id and offset."""
    rows = common.written(found.withColumn("number", F.monotonically_increasing_id()), "pack-pieces")  # numbers are fixed once written
    short = rows.filter(F.col("length") < size)
    groups = max(1, -(-short.count() // group))
    first = common.written(_packed(short, groups, size), "pack-first")
    loose = first.filter(F.col("held") < FULL * size).drop("g", "bin", "offset", "held")
    second = _packed(loose, max(1, -(-loose.count() // group)), size)
    # A bin, a group and a round, whose numbers are below `groups` and 2, make a number; whole pieces have negative ones.
    of = lambda d, k: d.select(*OUT, ((F.col("bin") * groups + F.col("g")) * 2 + k).alias("sequence_id"), "offset")
    alone = rows.filter(F.col("length") >= size).select(*OUT, (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return of(first.filter(F.col("held") >= FULL * size), 0).unionByName(of(second, 1)).unionByName(alone)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(common.table(spark, sf_dir, "documents"), bpe.default_path()))
