"""Exact ranks without a task that holds a whole group.

A row's hash order is uniform, so the first hex digits of its hash cut each group into even slices that follow each
other. Slices are counted (a partial aggregate), the counts before a slice are its offset, and rows are ranked within
their slice. There are as many slices as the size of the input, which Spark knows without a job, asks for; ranks do not
depend on their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hkey

#: Bytes of a slice, about; hex digits of slices at least and at most.
SLICE, DIGITS = 32 << 20, (1, 5)
#: Distinct values that one task puts in order.
FEW = 100_000


def digits_for(df: DataFrame) -> int:
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    low, high = DIGITS
    return next((d for d in range(low, high) if 16**d * SLICE >= size), high)


def hash_rank(df: DataFrame, parts: list[str], key: str, seed: int | str, out: str = "rn", total: str | None = None) -> DataFrame:
    """Adds the rank, from 1, by hkey(seed, key) and key within each group of parts (none: the whole table), and its number of rows. Null parts are a group."""
    names = [f"__g{i}" for i in range(len(parts))]
    d = df.withColumn("__h", hkey(seed, key)).withColumn("__s", F.substring("__h", 1, digits_for(df)))
    for g, p in zip(names, parts, strict=True):
        d = d.withColumn(g, F.coalesce(F.concat(F.lit("="), F.col(p).cast("string")), F.lit("")))
    counts = d.groupBy(*names, "__s").agg(F.count(F.lit(1)).alias("__n"))  # a row a slice of a group
    w = Window.partitionBy(*names)
    counts = counts.withColumn("__before", F.sum("__n").over(w.orderBy("__s")) - F.col("__n")).withColumn("__all", F.sum("__n").over(w))
    j = d.join(counts.drop("__n"), [*names, "__s"])
    rank = F.col("__before") + F.row_number().over(Window.partitionBy(*names, "__s").orderBy("__h", key))
    j = j.withColumn(out, rank)
    if total:
        j = j.withColumn(total, F.col("__all"))
    return j.drop(*names, "__h", "__s", "__before", "__all")


def cut_by_hash(df: DataFrame, group: str, limits: DataFrame, key: str, seed: int | str) -> DataFrame:
    """Rows of the groups in limits (a small table: group, limit) that may be among the first `limit` by hkey(seed, key): all of those, and at most a slice more of each group. Nothing is shuffled but counts."""
    d = df.withColumn("__s", F.substring(hkey(seed, key), 1, 3))
    counts = d.groupBy(group, "__s").agg(F.count(F.lit(1)).alias("__n"))  # at most 4096 rows a group
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__s")) - F.col("__n")
    last = counts.join(F.broadcast(limits), group).filter(F.col("limit") > 0).withColumn("__before", before).filter(F.col("__before") < F.col("limit")).groupBy(group).agg(F.max("__s").alias("__last"))
    return d.join(F.broadcast(last), group).filter(F.col("__s") <= F.col("__last")).drop("__s", "__last")  # a row a limit


def nearest_rank(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each name the value at the 0-based place floor(share n) in order, exactly.

    Approximate quantiles on both sides of a place bracket it, again and again until at most FEW distinct values are left
    in the bracket; those are counted and put in order.
    """
    spark = df.sparkSession
    d = df.select(F.col(value).alias("v")).filter("v IS NOT NULL")
    n, distinct, low, high = d.agg(F.count(F.lit(1)), F.approx_count_distinct("v"), F.min("v"), F.max("v")).first()
    schema = ", ".join(f"{k} {d.dtypes[0][1]}" for k in shares)
    if not n:
        return spark.createDataFrame([tuple(None for _ in shares)], schema)
    out = None
    for k, s in shares.items():
        one = _at_place(d, min(n - 1, int(s * n + 1e-9)), n, distinct, low, high).select(F.lit(k).alias("k"), "v")
        out = one if out is None else out.unionByName(one)
    return out.agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in shares])


def _at_place(d: DataFrame, at: int, n: int, distinct: int, low, high, near: float = 0.002) -> DataFrame:
    part = d
    while distinct > FEW and low < high:
        share = at / n
        a, b = part.agg(F.percentile_approx("v", [max(0.0, share - near), min(1.0, share + near)], F.lit(5000))).first()[0]
        a, b = (low if share <= near else a), (high if share >= 1 - near else b)
        inner = part.filter(F.col("v").between(F.lit(a), F.lit(b)))
        below, left, distinct_left = part.agg(F.count_if(F.col("v") < F.lit(a)), F.count_if(F.col("v").between(F.lit(a), F.lit(b))), F.approx_count_distinct(F.when(F.col("v").between(F.lit(a), F.lit(b)), F.col("v")))).first()
        if not below <= at < below + left or (a, b) == (low, high):
            break  # the quantiles were off, or cut nothing away: what there is gets ordered
        part, at, n, distinct, low, high = inner, at - below, left, distinct_left, a, b
    by = part.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    return by.withColumn("upto", F.sum("c").over(Window.orderBy("v"))).filter(F.col("upto") > at).agg(F.min("v").alias("v"))


def split_ends(n: Column, train: float, val: float) -> tuple[Column, Column]:
    """Ends of train and of train plus val, rounded down."""
    a = F.floor(n * train + 1e-9)
    return a, a + F.floor(n * val + 1e-9)
