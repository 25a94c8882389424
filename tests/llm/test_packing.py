import zlib

import numpy as np
from pyspark.sql import functions as F

from curatrix.llm import bpe, packing


def slow(lengths, size):
    """The rule said plainly: the choice that makes the sum of squares least; ties as the operator's."""
    bins, out = [], []
    for a in lengths:
        best = None
        options = sorted({size - b for b in bins if a <= size - b < size or (a <= size - b and b)}) + [None]
        for g in options:
            gaps = [size - b for b in bins if b < size]
            if g is not None:
                gaps.remove(g)
            left = (g if g is not None else size) - a
            if left:
                gaps.append(left)
            score = sum(gaps.count(x) ** 2 for x in set(gaps))
            if best is None or score < best[0]:
                best = (score, g)
        if best[1] is None:
            bins.append(a)
        else:
            i = max(i for i, b in enumerate(bins) if size - b == best[1])
            bins[i] += a
        out.append(best[0])
    return len(bins), out


def test_rule_against_the_plain_one():
    rng = np.random.default_rng(1)
    for size in (7, 20, 50):
        lengths = rng.integers(1, size, 60)
        to, at, held = packing.sum_of_squares(lengths, size)
        assert len(held) == slow(lengths.tolist(), size)[0]
        assert held.max() <= size and held.sum() == lengths.sum()
        for b in range(len(held)):
            i = np.flatnonzero(to == b)
            assert (at[i] == np.r_[0, np.cumsum(lengths[i])[:-1]]).all()


def test_rows(docs, rows, no_docs):
    path, own = bpe.default_path(), bpe.load(bpe.default_path())
    got = packing.pack(packing.pieces(docs, path, 256), 256, group=10).collect()
    want = []
    for r in rows:
        ids = own.encode(r[1]) + (1).to_bytes(4, "little")
        want += [(r[0], k, a // 4, len(p) // 4, zlib.crc32(p)) for k, (a, p) in enumerate((a, ids[a : a + 1024]) for a in range(0, len(ids), 1024))]
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(map(str, want))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(x[-1]) <= 256
    assert packing.pack(packing.pieces(no_docs, path)).count() == 0


def test_few_sequences():
    rng = np.random.default_rng(3)
    lengths = np.sort(np.minimum(4095, rng.lognormal(6.5, 1.0, 20_000).astype(int) + 1))[::-1]
    _, _, held = packing.sum_of_squares(lengths)
    assert len(held) <= -(-lengths.sum() // 4096) * 1.002 + 1


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def checked(out):
    """Each sequence is gapless from 0 and not too long; their number."""
    by = out.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("x"))
    held = F.aggregate("x", F.lit(0).cast("long"), lambda at, p: F.when(at == p["offset"], at + p["length"]).otherwise(-1_000_000))
    n, least, most = by.agg(F.count(F.lit(1)), F.min(held), F.max(held)).first()
    assert 0 < least and most <= 4096
    return n


def test_repeated_rows_spread_over_groups(spark):
    d = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(500).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    rows = d.withColumn("number", F.monotonically_increasing_id())
    sizes = [r["count"] for r in rows.groupBy(F.pmod(F.xxhash64("number"), F.lit(100)).alias("g")).count().collect()]
    assert len(sizes) == 100 and max(sizes) < 1200  # what a task holds
    out = packing.pack(d, group=1000)
    assert out.count() == 100_000 and checked(out) <= -(-100_000 // 8) * 1.01


def test_many_groups_cost_few_sequences(spark):
    rng = np.random.default_rng(5)
    lengths = np.minimum(4096, rng.lognormal(6.5, 1.0, 30_000).astype(int) + 1)
    d = spark.createDataFrame([(i, 0, 0, int(n), i % 97) for i, n in enumerate(lengths)], PIECES).repartition(6)
    least = -(-int(lengths.sum()) // 4096)
    for group, loss in ((500, 1.01), (3000, 1.003)):
        assert checked(packing.pack(d, group=group)) <= least * loss + 2


def test_lengths_that_fill_no_sequence():
    """The plain rule keeps all gaps open; the fewest sequences are those of whole multiples."""
    for lengths, want in ((np.full(4000, 500), 500), (np.r_[np.full(4000, 500), [1, 2, 3]], 500), (np.r_[np.full(3000, 1500), np.full(10, 40)], 1500), (np.full(100, 4095), 100)):
        to, at, held = packing.fewest(lengths)
        assert len(held) <= want * 1.03 + 1 and held.max() <= 4096 and held.sum() == lengths.sum()
        for b in range(0, len(held), 50):
            i = np.flatnonzero(to == b)
            assert (at[i] == np.r_[0, np.cumsum(lengths[i])[:-1]]).all()


def test_closed_gaps_open_for_short_pieces():
    to, _, held = packing.sum_of_squares(np.array([60, 60, 35, 35, 5, 5]), 100, 10)
    assert sorted(held.tolist()) == [100, 100] and set(to[:2]) == set(to[4:]) == {0, 1}


def test_a_group_that_packs_well_is_packed_once(monkeypatch):
    lengths = np.sort(np.random.default_rng(3).integers(1, 2000, 5000))[::-1]
    a = packing.sum_of_squares(lengths)
    b = packing.fewest(lengths)
    assert all((x == y).all() for x, y in zip(a, b, strict=True))
