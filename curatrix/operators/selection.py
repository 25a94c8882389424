"""Choices for training, galleries and probes: tiers, mixes with leftovers, blocks of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.keys import hkey
from . import sampling
from .quota import largest_remainder
from .ranking import hash_rank


def mixed_with_fill(df: DataFrame, bucket: str, mix: dict[str, float], n: int, key: str, seed: int) -> DataFrame:
    """Each bucket's quota, and what buckets lack from leftover rows of any of them, n rows at most."""
    d = df.filter(F.col(bucket).isin(*mix))
    first = sampling.mixed_sample(d, bucket, mix, n, key, seed).withColumn("__fill", F.lit(0))
    rest = d.join(first.select(key), key, "left_anti").withColumn("__fill", F.lit(1))
    more = rest.orderBy(hkey(seed, key), key).limit(n)
    return first.unionByName(more).orderBy("__fill", hkey(seed, key), key).limit(n).drop("__fill")


def all_real_first(df: DataFrame, real: Column, bucket: str, mix: dict[str, float], n: int, key: str, seed: int) -> DataFrame:
    """All real rows (n at most), then the mix from the others for what is left."""
    kept = df.filter(real).orderBy(hkey(seed, key), key).limit(n)
    have = kept.count()
    return kept.unionByName(mixed_with_fill(df.filter(~real), bucket, mix, n - have, key, seed)) if n > have else kept


def proportional_to_supply(df: DataFrame, bucket: str, n: int, key: str, seed: int) -> DataFrame:
    """n rows, each bucket in proportion to what it has."""
    have = {r[0]: r[1] for r in df.groupBy(bucket).count().collect()}  # a row a bucket
    return sampling.quota_sample(df, bucket, largest_remainder(have, min(n, sum(have.values()))), key, seed) if have else df


def gallery_pages(df: DataFrame, n: int) -> DataFrame:
    """df: page_id, pool_id, template_stem, chrome. A page of each template (core pages first), then for each template a page in the other chrome state, then pages of pools not seen; n at most."""
    pages = df.filter("page_id <> ''").groupBy("page_id").agg(*[F.min(c).alias(c) for c in ("pool_id", "template_stem", "chrome")])
    core = (F.col("pool_id") != "core_inner").cast("int")
    w = Window.partitionBy("template_stem").orderBy(core, "page_id")
    d = pages.withColumn("__t", F.row_number().over(w)).withColumn("__c", F.first("chrome").over(w))
    other = F.row_number().over(Window.partitionBy("template_stem", "chrome").orderBy(core, "page_id")) == 1
    d = d.withColumn("__tier", F.when(F.col("__t") == 1, 1).when((F.col("chrome") != F.col("__c")) & other, 2).otherwise(3))
    seen = F.min(F.when(F.col("__tier") < 3, 1)).over(Window.partitionBy("pool_id"))
    d = d.withColumn("__new", F.row_number().over(Window.partitionBy("pool_id").orderBy("__tier", "page_id"))).withColumn("__seen", seen)
    d = d.filter((F.col("__tier") < 3) | (F.col("__seen").isNull() & (F.col("__new") == 1)))
    return d.orderBy("__tier", "template_stem", "page_id").limit(n).drop("__t", "__c", "__new", "__seen", "__tier")


def desktop_blocks(blocks: DataFrame, n: int, focused_share: float = 0.75, visible: float = 0.9) -> DataFrame:
    """Of each page the n largest visible blocks: up to a share on the focused window first, then others."""
    d = blocks.filter(F.coalesce(F.col("visible_frac") >= visible, F.lit(True))).withColumn("__f", F.coalesce("window_focused", F.lit(False)))
    page = Window.partitionBy("page_id", "__f")
    d = d.withColumn("__rn", F.row_number().over(page.orderBy(F.desc(G.ink_area(F.col("rects"))), "id")))
    keep = max(1, round(n * focused_share))
    first = d.filter(~F.col("__f") | (F.col("__rn") <= keep))
    order = Window.partitionBy("page_id").orderBy(F.desc("__f"), "__rn")
    return first.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= n).drop("__f", "__rn", "__k")


def large_blocks(blocks: DataFrame, special: Column, label_ok: Column, in_frame: Column, page_area: Column, least_share: float = 0.015, least_chars: int = 40) -> DataFrame:
    ink = G.ink_area(F.col("rects"))
    return blocks.filter(~special & label_ok & in_frame & (ink / page_area >= least_share) & (F.length("markdown") >= least_chars)).withColumn("ink", ink)


def multi_fragment_blocks(blocks: DataFrame, in_frame: Column, least_chars: int = 30) -> DataFrame:
    return blocks.filter((F.size("rects") > 1) & (F.length("markdown") >= least_chars) & in_frame).withColumn("ink", G.ink_area(F.col("rects")))


def core_points(points: DataFrame) -> DataFrame:
    """Of each block (page_id, id, k, region) the first point in the diamond and the first in a corner; else the first two."""
    w = Window.partitionBy("page_id", "id")
    diamond = F.col("region") == "diamond"
    d = points.withColumn("__rn", F.row_number().over(Window.partitionBy("page_id", "id", diamond).orderBy("k"))).withColumn("__both", F.size(F.collect_set(diamond).over(w)))
    d = d.withColumn("__k", F.row_number().over(w.orderBy("k")))
    return d.filter(((F.col("__both") == 2) & (F.col("__rn") == 1)) | ((F.col("__both") == 1) & (F.col("__k") <= 2))).drop("__rn", "__both", "__k")


def allocated_scales(df: DataFrame, hard: Column, large: float, small: float, small_share: float, key: str, seed: int) -> DataFrame:
    """Of hard rows a share, by hash, gets the small scale; all others the large one."""
    d = hash_rank(df.withColumn("__hard", hard), ["__hard"], key, seed, "__rn", "__n")
    return d.withColumn("scale", F.when(F.col("__hard") & (F.col("__rn") <= F.bround(F.col("__n") * small_share)), small).otherwise(large)).drop("__hard", "__rn", "__n")


def expanded_rounds(pages: DataFrame, n: int, key: str) -> DataFrame:
    """Pages repeated in rounds up to n rows, each with its round."""
    have = pages.count()
    d = hash_rank(pages, [], key, 0, "__i").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-n // max(have, 1)) - 1)))))
    return d.filter(F.col("round") * have + F.col("__i") <= n).drop("__i")


def by_chrome(df: DataFrame, chrome: str, share: float, page: str, n: int, key: str, seed: int) -> DataFrame:
    """n rows, one of each page before a second of any, of which a share (rounded half to even) has a window around it; where one side is short the other fills in."""
    have, others = df.agg(F.count_if(F.col(chrome) == "chrome"), F.count_if(F.col(chrome) != "chrome")).first()
    want = min(have, round(n * share))
    rest = min(others, n - want)
    short = n - want - rest
    if short > 0:
        want, rest = (want + short, rest) if have - want >= short else (want, min(others, rest + short))
    a = sampling.unique_page_first(df.filter(F.col(chrome) == "chrome"), page, want, key, seed)
    return a.unionByName(sampling.unique_page_first(df.filter(F.col(chrome) != "chrome"), page, rest, key, seed))


def scene_mix(df: DataFrame, scene: str, mix: dict[str, float], n: int, page: str, key: str, seed: int, pool: str | None = None, empty_pools: dict[str, float] | None = None, real: Column | None = None) -> DataFrame:
    """n rows by scene, one of each page before a second of any; scenes that are short are made up from what is left of any.

    empty_pools: the scene "empty" is itself a mix of pools, made up from its other rows. real: all real rows first, n at
    most, and the others by what the mix still lacks.
    """
    d = df.filter(F.col(scene).isNotNull())
    if real is not None:
        reals = d.filter(real)
        have = {r[0]: r[1] for r in reals.groupBy(scene).count().collect()}  # a row a scene
        n_real = sum(have.values())
        if n_real >= n:
            return reals.orderBy(hkey(seed, key), key).limit(n)
        lack = {s: max(0, q - have.get(s, 0)) for s, q in largest_remainder(mix, n).items()}
        need = largest_remainder(lack if sum(lack.values()) else mix, n - n_real)
        return reals.unionByName(scene_mix(d.filter(~real), scene, {s: float(q) for s, q in need.items()}, n - n_real, page, key, seed, pool, empty_pools))
    supply = {r[0]: r[1] for r in d.groupBy(scene).count().collect()}  # a row a scene
    parts = []
    for s, q in largest_remainder(mix, n).items():
        rows, take = d.filter(F.col(scene) == s), min(q, supply.get(s, 0))
        if not take:
            continue
        if s == "empty" and empty_pools and pool:
            subs = [sampling.unique_page_first(rows.filter(F.col(pool) == p), page, m, key, seed) for p, m in largest_remainder(empty_pools, take).items() if m]
            some = subs[0]
            for x in subs[1:]:
                some = some.unionByName(x)
            more = rows.join(some.select(key), key, "left_anti").orderBy(hkey(seed, key), key).limit(take).withColumn("__late", F.lit(1))
            parts.append(some.withColumn("__late", F.lit(0)).unionByName(more).orderBy("__late", hkey(seed, key), key).limit(take).drop("__late"))
        else:
            parts.append(sampling.unique_page_first(rows, page, take, key, seed))
    if not parts:
        return d.limit(0)
    picked = parts[0]
    for x in parts[1:]:
        picked = picked.unionByName(x)
    rest = d.join(picked.select(key), key, "left_anti")
    again = F.row_number().over(Window.partitionBy(page).orderBy(hkey(seed, key), key)) > 1
    rest = rest.withColumn("__again", again).orderBy("__again", hkey(seed, key), key).limit(n).withColumn("__late", F.col("__again").cast("int") + 1).drop("__again")
    return picked.withColumn("__late", F.lit(0)).unionByName(rest).orderBy("__late", hkey(seed, key), key).limit(n).drop("__late")


def scheduled(df: DataFrame, bucket: str, quotas: dict[str, int], key: str, seed: int) -> DataFrame:
    """Each slice's quota, and turn: the order in which a scheduler that always draws in proportion to what slices still lack would make them, which is one uniform shuffle of all that is made."""
    d = sampling.quota_sample(df, bucket, quotas, key, seed)
    return hash_rank(d, [], key, f"{seed}t", "turn")


def composed_split(train: DataFrame, val: DataFrame, choose, key: str, seed: int) -> DataFrame:
    """choose(rows, seed) of the train rows and, under the next seed, of the val rows, with split and ord (each split shuffled under its own seed)."""
    a = choose(train, seed).withColumn("split", F.lit("train")).withColumn("ord", hkey(seed, key))
    return a.unionByName(choose(val, seed + 1).withColumn("split", F.lit("val")).withColumn("ord", hkey(seed + 2, key)))
