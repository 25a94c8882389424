"""Orders of mixed rows, runs in them, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hkey
from .ranking import hash_rank


def interleaved(df: DataFrame, bucket: str, key: str, seed: int, out: str = "ord") -> DataFrame:
    """Adds a sort key: one row of each bucket in each round, buckets in a new order each round. Sorting by it needs no single task."""
    return hash_rank(df, [bucket], key, seed, "__rn").withColumn(out, F.concat(F.lpad(F.col("__rn").cast("string"), 12, "0"), F.lit("|"), hkey(seed, "__rn", bucket))).drop("__rn")


def proportional(df: DataFrame, key: str, seed: int, out: str = "ord") -> DataFrame:
    """Drawing buckets in proportion to what is left of them is one uniform shuffle of all rows."""
    return df.withColumn(out, hkey(seed, key))


def longest_runs(df: DataFrame, run: list[str], order: str, parts: list[str] | None = None) -> DataFrame:
    """max_run: the longest run of rows, in order, with equal values of `run`; of each part.

    Ranges of parts and order are scanned side by side; of a part that reaches over several ranges their first, last and
    longest runs, a row a range, are stitched. So no task holds a whole part.
    """
    parts = parts or []

    def scan(batches):
        import pandas as pd
        from pyspark import TaskContext

        at, rows, part, first, most, value, n = TaskContext.get().partitionId(), [], None, None, 0, None, 0

        def closed() -> list:
            return [*part, at, (first or [value, n])[0], (first or [value, n])[1], value, n, max(most, n), first is None]

        for pdf in batches:
            for *own, v in zip(*(pdf[c] for c in (*parts, "__v")), strict=True):
                if own != part or not n:
                    if n:
                        rows.append(closed())
                    part, first, most, value, n = own, None, 0, v, 1
                elif v == value:
                    n += 1
                else:
                    first, most, value, n = first or [value, n], max(most, n), v, 1
            yield pd.DataFrame(rows, columns=names)
            rows = []
        if n:
            yield pd.DataFrame([closed()], columns=names)

    def stitch(pdf):
        import pandas as pd

        best, value, n = 0, None, 0
        for r in pdf.sort_values("__at").itertuples():
            joined = r.a_n + (n if n and r.a == value else 0)
            best = max(best, joined, r.most)
            value, n = r.z, joined if r.one else r.z_n
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in parts), best]], columns=[*parts, "max_run"])

    names = [*parts, "__at", "a", "a_n", "z", "z_n", "most", "one"]
    kinds = dict(df.dtypes)
    keys = [f"{c} string" for c in parts]
    text = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c) for c in parts]  # as text, so that nulls are values like others
    v = F.to_json(F.struct(*run)).alias("__v")
    d = df.select(*text, v, F.col(order).alias("__o"))
    d = d.repartitionByRange(*parts, "__o").sortWithinPartitions(*parts, "__o").drop("__o")
    found = d.mapInPandas(scan, ", ".join([*keys, "__at int, a string, a_n long, z string, z_n long, most long, one boolean"]))
    if not parts:
        found = found.withColumn("__all", F.lit(""))
        parts, keys = ["__all"], ["__all string"]
    out = found.groupBy(*parts).applyInPandas(stitch, ", ".join([*keys, "max_run long"]))
    return out.select(*[F.when(F.col(c) != "", F.substring(F.col(c), F.lit(2), F.length(c))).cast(kinds[c]).alias(c) for c in parts if c in kinds], "max_run")


def longest_run(df: DataFrame, run: str, order: str) -> DataFrame:
    """max_run of the whole table."""
    return longest_runs(df, [run], order).agg(F.coalesce(F.max("max_run"), F.lit(0).cast("long")).alias("max_run"))


def mix_summary(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Counts by each set of columns, and of negatives, in one scan (grouping sets)."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_negative")).alias("n_negative"))


def windowed(df: DataFrame, order: str, key: str, window: int, seed: int, out: str = "ord") -> DataFrame:
    """A local shuffle: rows stay in their window of the order (a position from 0), in hash order within it."""
    return df.withColumn(out, F.concat(F.lpad(F.floor(F.col(order) / window).cast("string"), 12, "0"), F.lit("|"), hkey(seed, key)))


def overlapping(df: DataFrame, order: str, key: str, window: int, seed: int, out: str = "ord") -> DataFrame:
    """A local shuffle over two sets of windows that overlap by half (order: a position from 0): in hash order within windows, then, of the places so found, within windows half a width on. Adds the new place."""
    half = max(1, window // 2)
    first = F.floor(F.col(order) / window)
    at = first * window + F.row_number().over(Window.partitionBy(first).orderBy(hkey(f"{seed}a", key), key)) - 1
    d = df.withColumn("__at", at).withColumn("__w", F.floor((F.col("__at") + half) / window))
    place = F.greatest(F.lit(0), F.col("__w") * window - half) + F.row_number().over(Window.partitionBy("__w").orderBy(hkey(f"{seed}b", key), key)) - 1
    return d.withColumn(out, place).drop("__at", "__w")


def positions(df: DataFrame, order: str, key: str, out: str = "position") -> DataFrame:
    """Adds the place, from 0, of each row in the order of two columns (in the first one's stead if out names it): ranges are counted side by side, and the counts before a range are its offset.

    Bounds of ranges are sampled anew wherever a plan ranges rows, so counts and rows would not agree on them: ranged rows are written, and both read that.
    """
    from ..session import as_written

    d = df.repartitionByRange(order, key).sortWithinPartitions(order, key).withColumn("__m", F.monotonically_increasing_id())
    d = as_written(d.drop(order) if out == order else d, "ranges")
    d = d.withColumn("__p", F.shiftright("__m", 33)).withColumn("__i", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = d.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # a row a range
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).drop("__n")
    return d.join(F.broadcast(before), "__p").withColumn(out, F.col("__before") + F.col("__i")).drop("__m", "__p", "__i", "__before")


def interleaved_locally(df: DataFrame, strata: list[str], key: str, seed: int, n: int, out: str = "ord") -> DataFrame:
    """Rounds over the strata, then a local shuffle in windows of a fiftieth of the n rows, 8 at least."""
    d = interleaved(df.withColumn("__strata", F.concat_ws("|", *strata)), "__strata", key, seed, "__place").drop("__strata")
    return overlapping(positions(d, "__place", key, "__place"), "__place", key, max(8, n // 50), seed, out).drop("__place")


def unseen_rounds(df: DataFrame, strata: list[str], key: str, seed: int, n: int) -> DataFrame:
    """Round-robin over strata, rows in hash order within each: the first n."""
    d = hash_rank(df, strata, key, seed, "__rn")
    return d.orderBy("__rn", *[hkey(seed, s) for s in strata], key).limit(n).drop("__rn")
