"""Exact allocation of n over keys by largest remainder, and train/val/test counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Slices of the curricula and their shares.
MIXES = {
    "a1_v2": {"long_center": 0.82, "empty_neg": 0.18},
    "a2": {"replay": 0.22, "adjacency": 0.14, "multi_frag": 0.10, "semantic_group": 0.14, "corner_extreme": 0.06, "special": 0.12, "desktop": 0.14, "near_edge": 0.08},
    "a2_v2": {"replay_long": 0.24, "adjacency": 0.16, "multi_frag": 0.16, "semantic_group": 0.20, "corner_extreme": 0.12, "empty_neg": 0.10, "special_light": 0.02},
}


def largest_remainder(mix: dict[str, float], n: int) -> dict[str, int]:
    """Of plan parameters, on the driver. Shares are normalised, so counts add up to n; ties go to the earlier key."""
    total = sum(mix.values())
    if total <= 0 or n < 0:
        raise ValueError("shares must be positive and n not negative")
    exact = {k: v / total * n for k, v in mix.items()}
    out = {k: int(v + 1e-9) for k, v in exact.items()}
    short = n - sum(out.values())
    for k in sorted(exact, key=lambda k: -round(exact[k] - out[k], 9))[:short]:
        out[k] += 1
    return out


def quotas(df: DataFrame, share: str, position: str, n: int) -> DataFrame:
    """Adds quota to a small table of shares (one row a key): the same rule as a query."""
    exact = F.col(share) / F.sum(share).over(Window.partitionBy()) * n
    base = F.floor(exact + 1e-9)
    d = df.withColumn("__exact", exact).withColumn("__base", base)
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("__exact") - F.col("__base"), 9)), position))
    short = F.lit(n) - F.sum("__base").over(Window.partitionBy())
    return d.withColumn("quota", (F.col("__base") + (rank <= short).cast("int")).cast("int")).drop("__exact", "__base")


def split_counts(n: int, train: float, val: float) -> tuple[int, int, int]:
    """Largest remainder over three parts; from three rows on, val and test get one at least, from train."""
    a, b, c = largest_remainder({"train": train, "val": val, "test": max(0.0, 1 - train - val)}, n).values()
    if n >= 3:
        if b == 0:
            a, b = a - 1, 1
        if c == 0:
            a, c = a - 1, 1
    return a, b, c


def split_count_columns(n: Column, train: float, val: float) -> tuple[Column, Column]:
    """Ends of train and of train plus val, for split_counts of a column."""
    shares = (train, val, max(0.0, 1 - train - val))
    exact = [n * s for s in shares]
    base = [F.floor(e + 1e-9) for e in exact]
    left = n - base[0] - base[1] - base[2]
    rest = [F.round(e - b, 9) for e, b in zip(exact, base, strict=True)]
    before = [sum(((rest[j] > rest[i]) | ((rest[j] == rest[i]) & F.lit(j < i))).cast("int") for j in range(3) if j != i) for i in range(3)]
    a, b, c = (base[i] + (before[i] < left).cast("int") for i in range(3))
    low_b, low_c = ((n >= 3) & (x == 0) for x in (b, c))
    a = a - low_b.cast("int") - low_c.cast("int")
    b = F.when(low_b, 1).otherwise(b)
    return a, a + b


def as_table(spark: SparkSession, counts: dict[str, int], key: str) -> DataFrame:
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(counts.items())], f"{key} string, quota int, position int")
