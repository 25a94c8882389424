"""The corpus pipeline: toxicity, language ID, SimHash near-dedup, best-fit packing.

Each stage takes what its predecessor has kept, as a table, and returns the rows that it keeps, with the columns of
documents; the last one returns packed pieces. Each stage decides on rows: columns beyond those of documents, whatever
their names, are dropped first. Null and empty texts are clean; the language stage rejects them, having no letter. Very
long texts count whole. Of repeated rows, or rows of one doc_id or of none, each is judged by its text; the near-duplicate
stage keeps one of a group, also where none has a doc_id. Ties go as the operators' docstrings say. Empty tables pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import bpe, common, langid, packing, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text of whose n-grams, corrected for false positives, less than this part is in the filter of its language is in none that was learned.
SUPPORT = 0.45
#: A language learned from fewer documents is not known well enough to reject by that.
ENOUGH = 100


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the factorization machine calls toxic."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.annotated(docs.select(COLUMNS), model).filter("predicted = 0").select(COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those in no language that was learned; nothing if none can be learned."""
    filters = langid.fit(docs)
    if not filters.names:
        return docs.select(COLUMNS)
    hardly_known = [k for k, n in zip(filters.names, filters.docs, strict=True) if n < ENOUGH]
    found = langid.annotated(docs.select(COLUMNS), filters)
    return found.filter((F.col("lang_pred") != "und") & ((F.col("support") >= SUPPORT) | F.col("lang_pred").isin(hardly_known))).select(COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least doc_id stays, once."""
    return simhash.first_of_each(docs.select(COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, bpe.default_path()))


STAGES = [("toxicity", toxicity_stage), ("language", language_stage), ("near_dedup", near_dedup_stage), ("packing", packing_stage)]
#: No stage can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
