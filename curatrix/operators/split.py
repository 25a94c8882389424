"""Train, val and test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quota import split_count_columns
from .ranking import hash_rank, split_ends


def _named(rank: Column, train_end: Column, val_end: Column) -> Column:
    return F.when(rank <= train_end, "train").when(rank <= val_end, "val").otherwise("test")


def stratified(df: DataFrame, strata: list[str], key: str, train: float, val: float, seed: int) -> DataFrame:
    """Adds split: in each stratum by largest remainder, with a row of val and test where there are three."""
    d = hash_rank(df, strata, key, seed, "__rn", "__n")
    return d.withColumn("split", _named(F.col("__rn"), *split_count_columns(F.col("__n"), train, val))).drop("__rn", "__n")


def truncated(df: DataFrame, strata: list[str], key: str, train: float, val: float, seed: int) -> DataFrame:
    """Adds split: counts of train and val are rounded down, what is left is test. Without strata, of the whole table."""
    d = hash_rank(df, strata, key, seed, "__rn", "__n")
    return d.withColumn("split", _named(F.col("__rn"), *split_ends(F.col("__n"), train, val))).drop("__rn", "__n")
