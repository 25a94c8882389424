"""Dedup by key, first come, and near-duplicates by Hamming distance."""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions import text as X


def pair_key(en: Column) -> Column:
    return X.strip(X.collapse(F.lower(en)))


def first_of(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__rn = 1").drop("__rn")


def capped_sources(df: DataFrame, key: str, source: str, source_order: str, line: str, cap: int) -> DataFrame:
    """Distinct by key over all sources, first come, then at most cap rows of each source in its order."""
    d = first_of(df, [key], [source_order, line])
    return d.withColumn("__rn", F.row_number().over(Window.partitionBy(source).orderBy(line))).filter(F.col("__rn") <= cap).drop("__rn")


def hamming_pairs(df: DataFrame, key: str, bits: str, most: int, width: int = 64) -> DataFrame:
    """Pairs (a < b) within `most` bits, d bits apart: rows that share one of most + 1 bit blocks are compared, which misses none; a pair is found at the first block that it shares. For small radii: blocks of few bits select little."""
    n = most + 1
    edges = [round(i * width / n) for i in range(n + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    blocks = F.array(*[F.struct(F.lit(i).alias("i"), F.col(bits).bitwiseAND(F.lit(m).cast("long")).alias("v")) for i, m in enumerate(signed)])
    e = df.select(key, bits, F.explode(blocks).alias("k")).select(key, bits, "k.i", "k.v")
    a, b = e.alias("a"), e.alias("b")
    x = F.col(f"a.{bits}").bitwiseXOR(F.col(f"b.{bits}"))
    shared = F.coalesce(*[F.when(x.bitwiseAND(F.lit(m).cast("long")) == 0, i) for i, m in enumerate(signed)])
    j = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.v") == F.col("b.v")) & (F.col(f"a.{key}") < F.col(f"b.{key}")) & (F.bit_count(x) <= most) & (shared == F.col("a.i")))
    return j.select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), F.bit_count(x).alias("d"))


def sign_bits(vector: Column, width: int = 64) -> Column:
    """A long with bit i set where the vector's element i is positive."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.when(F.get(vector, i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))


@lru_cache(maxsize=200_000)
def _word_bits(word: str) -> np.ndarray:
    return np.unpackbits(np.frombuffer(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.uint8))


def text_hash(text: str) -> int | None:
    """A 64-bit SimHash of the text's words, as a signed long; None without words."""
    words = Counter((text or "").lower().split())
    if not words:
        return None
    ones = np.fromiter(words.values(), np.int64, len(words)) @ np.stack([*map(_word_bits, words)]).astype(np.int64)
    return int.from_bytes(np.packbits(2 * ones > words.total()).tobytes(), "big", signed=True)


@pandas_udf(T.LongType())
def text_bits(text: pd.Series) -> pd.Series:
    return pd.Series([text_hash(x) for x in text], dtype="Int64")
