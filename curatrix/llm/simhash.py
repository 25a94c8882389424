"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at few differing bits through pivot distance tables.

Fingerprints are made in one pass over whole texts; equal ones collapse to one class before any search. Two classes
within D bits agree wholly on one of D + 1 disjoint bit blocks, so classes are dealt by block value. In a group, a table
of Hamming distances to the PIVOTS reference fingerprints discards each pair whose coordinates differ by more than D
somewhere (the triangle inequality), and survivors are verified by exact distance. A group gives the links of a spanning
forest only, so output is linear in its size. Groups of over MOST classes are dealt anew by blocks of their other bits,
so no task gets one whole; no pair within D bits is lost, nothing is capped or sampled. Components come from repeated
large-star and small-star steps on the links, in tables in the shared folder.

Nulls: a null text has no words, like an empty one: fingerprint zero, linked like any other. Repeated rows stay; a null
doc_id takes part, and its component is the smallest non-null id of it, null if there is none. Very long texts are summed
in parts. An empty table gives an empty result. Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED = 42
PIVOTS = 24
#: Classes that one group task compares at once.
MOST = 2048
#: After so many levels members of a group differ in 11 bits at most (for links at 4), so there are 2048 classes at most.
DEPTH = 9
#: Words above which hashes are summed in parts.
PART = 1 << 16

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint_of(text: str | None, words: int) -> int:
    """Unsigned. A bit is 1 if set in over half of the shingles' hashes."""
    import xxhash

    h64, w = xxhash.xxh64_intdigest, (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return h64(b" ".join(w), SEED)
    n = len(w) - words + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PART):
        part = w[at : min(n, at + PART) + words - 1]
        shingles = part[: len(part) - words + 1]
        for k in range(1, words):
            shingles = [a + b" " + b for a, b in zip(shingles, part[k:])]
        h = np.fromiter([h64(s, SEED) for s in shingles], np.uint64, len(shingles))
        if len(h) < 1500:
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        else:
            b = h.view(np.uint8).reshape(-1, 8)
            ones += np.concatenate([np.bincount(b[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a long), and the columns named in `also`."""
    d = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), *also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint_of(t.as_py(), words) for t in b.column(0)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(fps, pa.int64()), *b.columns[2:]], ["doc_id", "fp", *also])

    return d.mapInArrow(run, ", ".join(["doc_id long", "fp long", *(f"{c} {t}" for c, t in d.dtypes[2:])]))


@lru_cache
def _pivots() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, PIVOTS, np.uint64) << np.uint64(1) ^ np.arange(PIVOTS, dtype=np.uint64)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@lru_cache(maxsize=100_000)
def _finer(mask: int, parts: int) -> tuple[int, ...]:
    """The mask with each of `parts` runs of the bits that it leaves."""
    free = [i for i in range(64) if not mask >> i & 1]
    return tuple(mask | sum(1 << i for i in run.tolist()) for run in np.array_split(np.array(free, np.int64), min(parts, len(free))) if len(run))


def dealt(df: DataFrame, bits: int) -> DataFrame:
    """(mask, fp, id) rows to (mask, value, fp, id): one row for each finer mask; value is what of fp the mask keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks, fps, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for m in np.unique(masks):
                at = masks == m
                for x in _finer(int(m) & (1 << 64) - 1, bits + 1):
                    s = np.uint64(x).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(at.sum()), s)), pa.array(fps[at] & s), pa.array(fps[at]), pa.array(ids[at])], ["mask", "value", "fp", "id"])

    return df.select("mask", "fp", "id").mapInArrow(run, "mask long, value long, fp long, id long")


def forest(fps: np.ndarray, ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of a spanning forest of the classes within `bits` of each other: each id with the least of its tree."""
    n = len(fps)
    table = np.stack([_distance(fps.view(np.uint64), p) for p in _pivots()], 1).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    u, ids, table = fps.view(np.uint64)[order], ids[order], table[order]
    root, first = np.arange(n), table[:, 0].astype(np.int64)
    ends = np.searchsorted(first, first + bits, "right")
    for i in range(n - 1):
        j = np.arange(i + 1, ends[i])
        j = j[(root[j] != root[i]) & (np.abs(table[j, 1:9] - table[i, 1:9]) <= bits).all(1)]  # else in one tree already, or too far
        if len(j) > 8:
            j = j[(np.abs(table[j, 9:] - table[i, 9:]) <= bits).all(1)]
        if not len(j):
            continue
        for x in np.unique(root[j[_distance(u[j], u[i]) <= bits]]):
            root[root == x] = root[i]
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    least = least[root]
    return ids[ids != least], least[ids != least]


def _grouped(rows: DataFrame, bits: int) -> DataFrame:
    """forest() of each (mask, value) group; rows come sorted, so a task holds one batch and one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: np.ndarray | None = None
        for b in batches:
            new = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            kept = new if kept is None else np.concatenate([kept, new], 1)
            starts = np.flatnonzero(np.r_[True, (kept[:2, 1:] != kept[:2, :-1]).any(0)]) if kept.shape[1] else np.zeros(0, np.int64)
            if len(starts) > 1:
                yield from found(kept[:, : starts[-1]], starts)
                kept = kept[:, starts[-1] :]
        if kept is not None and kept.shape[1]:
            yield from found(kept, np.array([0, kept.shape[1]]))

    def found(x: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        many = np.flatnonzero(np.diff(starts) > 1)
        if pairs := [p for k in many if len((p := forest(x[2, starts[k] : starts[k + 1]].copy(), x[3, starts[k] : starts[k + 1]], bits))[0])]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in pairs])) for i in (0, 1)], ["a", "b"])

    n = common.tasks(rows.sparkSession)
    return rows.repartition(n, "mask", "value").sortWithinPartitions("mask", "value").mapInArrow(run, "a long, b long")


def links(classes: DataFrame, bits: int) -> DataFrame:
    """classes: distinct fp and id (longs). Links (a, b), a > b, between ids that connect whatever is within `bits`."""
    out, left = None, classes.select(F.lit(0).cast("long").alias("mask"), "fp", "id")
    for depth in range(DEPTH):
        rows = common.written(dealt(left, bits), "simhash-blocks")
        hot = common.written(rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST).select("mask", "value"), "simhash-hot")
        ends = depth == DEPTH - 1 or hot.isEmpty()
        found = _grouped(rows if ends else rows.join(hot, ["mask", "value"], "left_anti"), bits)
        out = found if out is None else out.unionByName(found)
        if ends:
            break
        left = rows.join(hot, ["mask", "value"], "left_semi")
    return out.distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Stars (a, b) of links (a, b): b is the least id that a reaches. Large-star and small-star steps until nothing changes."""
    now = common.written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    was = _state(now)
    while was[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-least")
        large = common.written(now.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least.withColumnRenamed("a", "u"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "cc-large")
        below = common.written(large.groupBy("a").agg(F.min("b").alias("m")), "cc-below")
        small = large.join(below, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        new = common.written(small.filter("a != b").distinct(), "cc")
        for x in (now, least, large, below):
            common.drop_written(x)
        now, state = new, _state(new)
        if state == was:
            break
        was = state
    return now


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fp, component_id for each row of docs."""
    return labelled(common.written(fingerprints(docs, words), "simhash-fp"), bits).drop("root")


def labelled(fps: DataFrame, bits: int) -> DataFrame:
    """fps (a written table with doc_id and fp) with component_id, and root, the least fingerprint of the component. Any long may be a doc_id: classes are named by fingerprint."""
    classes = common.written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-class")
    stars = components(links(classes.select("fp", F.col("fp").alias("id")), bits)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = common.written(classes.join(stars, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "simhash-root")
    least = common.written(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "simhash-least")
    of = common.written(common.hot_join(rooted.withColumnRenamed("n", "copies"), least, "root").select("fp", "root", "component_id", F.col("copies").alias("n")), "simhash-of")
    return common.hot_join(fps, of, "fp").select(*fps.columns, "component_id", "root")


def first_of_each(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """docs without the rows that are near-duplicates of another: of each component the row of the least doc_id stays, of several such rows, or rows without doc_id, one. Texts are not shuffled."""
    columns = docs.columns
    own = [f"__own_{c}" if c in ("file", "row", "bucket") else c for c in columns]
    d = common.short_batches(common.located(docs.toDF(*own), "dedup-docs"))
    fps = common.written(fingerprints(d, words, ("file", "row")), "dedup-fp")
    found = common.written(labelled(fps, bits), "dedup-component")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")
    first = common.written(found.groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "dedup-first")
    gone = common.hot_join(found, first, "root").filter(F.col("first") != place).select("file", "row", F.lit(0).cast("long").alias("value"))
    marks = common.mark(common.written(gone, "dedup-gone"), "dedup-marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = common.Lookup(marks)
        for b in batches:
            where = zip(*(b.column(c).to_pylist() for c in ("file", "row", "bucket")), strict=True)
            kept = b.select(own).filter(pa.array([look.of(*x) is None for x in where], pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, columns)

    return d.select(*own, "file", "row", marks.bucket()).mapInArrow(run, docs.schema)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
