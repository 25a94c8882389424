"""Seeded order without shared random state: every draw is a hash of the seed and the row's key, so it is the same on
any cluster, at any partitioning, and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "|"


def hkey(seed: int | str, *cols: Column | str) -> Column:
    """Hex digest that orders rows as a seeded shuffle does."""
    return F.md5(F.concat_ws(SEP, F.lit(str(seed)), *[_c(c).cast("string") for c in cols]))


def huniform(seed: int | str, *cols: Column | str) -> Column:
    """Uniform in [0, 1) from the first 32 bits of hkey."""
    return F.conv(F.substring(hkey(seed, *cols), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hint_between(seed: int | str, low: int, high: int, *cols: Column | str) -> Column:
    """Integer from low to high, both included."""
    return (F.floor(huniform(seed, *cols) * (high - low + 1)) + low).cast("int")


def categorical(seed: int | str, weights: dict[str, float], *cols: Column | str) -> Column:
    """A key with probability in proportion to its weight: the first whose cumulative share passes the draw."""
    u, total, at, out = huniform(seed, *cols), sum(weights.values()), 0.0, None
    for k, w in list(weights.items())[:-1]:
        at += w / total
        out = F.when(u < at, k) if out is None else out.when(u < at, k)
    last = F.lit(list(weights)[-1])
    return last if out is None else out.otherwise(last)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
