"""Queries over the test tables, by family, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import curation, measures, records, scoring, shapes, streams, tables  # noqa: F401  they register their queries
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts scored, summarised by group, with a verdict for each."""
    return scoring.group_verdicts(spark, sf_dir)
