"""Probe results to a training set: join to the source rows, gate, pick."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import probe, sampling


def chosen(rows: DataFrame, scored: DataFrame, n: int, seed: int, least_max: float = 0.0) -> DataFrame:
    """Rows whose group still teaches, n at most in hash order."""
    good = scored.filter(probe.selectable(least_max=least_max)).select("sample_id", "value", "verdict", "frac_good")
    return sampling.unique_page_first(rows.join(good, "sample_id"), "page_id", n, "sample_id", seed)


def unmatched(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """How many scored groups have no source row."""
    return scored.join(rows.select("sample_id"), "sample_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
