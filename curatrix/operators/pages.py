"""Pages to samples: which points of a page make rows of which pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import geometry as G
from ..functions.keys import huniform
from . import selection, units
from .sampling import top_by

POOLS = ("core_inner", "multi_frag", "empty_clear", "empty_boundary", "chrome_empty", "semantic_group")
#: Blocks of a page, points of a block, points of a boundary and of a clear page, and groups of a page.
BLOCKS_A_PAGE, POINTS_A_BLOCK, BOUNDARY_POINTS, CLEAR_POINTS, GROUPS_A_PAGE, CLEARANCE = 5, 10, 8, 4, 3, 12.0

def _none() -> Column:
    return F.lit(None).cast("string")


def _rows(df: DataFrame, pool: str, block: Column, region: Column, target: Column, negative: bool) -> DataFrame:
    norm = F.array(G.pixel_to_norm(F.col("x"), F.col("w")), G.pixel_to_norm(F.col("y"), F.col("h")))
    key = F.concat_ws("__", F.col("page_id").cast("string"), F.lit(pool), F.coalesce(block, F.lit("")), F.col("k").cast("string"))
    return df.select(key.alias("sample_id"), F.lit(pool).alias("pool_id"), "page_id", block.alias("block_id"), region.alias("region"), "x", "y", norm.alias("point_norm"), (F.lit("") if negative else target).alias("target"), F.lit(negative).alias("is_negative"))


def _drawn(df: DataFrame, box: str, seed: str, *key: str) -> DataFrame:
    """Adds x and y, uniform in the box."""
    at = lambda s, lo, hi: F.col(f"{box}.{lo}") + huniform(f"{seed}{s}", *key) * (F.col(f"{box}.{hi}") - F.col(f"{box}.{lo}"))
    return df.withColumns({"x": at("x", "x0", "x1"), "y": at("y", "y0", "y1")})


def samples(pages: DataFrame, blocks: DataFrame, bands: DataFrame, clustered: DataFrame, groups: DataFrame, seed: int, pools: tuple[str, ...] = POOLS) -> DataFrame:
    """Rows of the pools asked for, from all pages at once; an error for an unknown pool.

    pages: page_id, w, h. blocks: page_id, id, b (box), rects, tag, kind, markdown, visible_frac, in_viewport_frac. bands:
    page_id, band, b. clustered: page_id, id of blocks that are part of a larger unit. groups: page_id, group_id, id, pos.

    core_inner: ten points in each of the five largest plain blocks beyond a page's head. multi_frag: ten points over the
    fragments of blocks of several. empty_clear: points away from all text, and one in a band. empty_boundary: points
    between blocks that face each other. chrome_empty: points in bands. semantic_group: a point in a member of each of up
    to three groups that are wholly in the frame, with the text of all members.
    """
    if unknown := set(pools) - set(POOLS):
        raise KeyError(f"unknown pools {sorted(unknown)}")
    d = blocks.join(pages, "page_id")
    in_frame = G.fully_in_frame(F.col("rects"), F.col("w"), F.col("h"), F.col("visible_frac"), F.col("in_viewport_frac"))
    special = C.is_special_block(F.col("kind"), F.col("markdown"), F.col("tag"))
    ok = C.label_reason(F.col("markdown"), F.col("tag")) == "ok"
    sides = pages.select("page_id", "w", "h")
    ink = d.select("page_id", F.explode(F.when(F.size("rects") > 0, F.col("rects")).otherwise(F.array("b"))).alias("b"))
    make = {
        "core_inner": lambda: _core(d, clustered, special, ok, in_frame, sides, seed),
        "multi_frag": lambda: _fragments(d, in_frame, seed),
        "empty_clear": lambda: _clear(pages, ink, bands, sides, seed),
        "empty_boundary": lambda: _boundary(d.filter(~special), ink, sides, seed),
        "chrome_empty": lambda: _rows(units.band_points(bands, 2, seed).join(sides, "page_id"), "chrome_empty", _none(), F.concat(F.lit("chrome_"), "band"), _none(), True),
        "semantic_group": lambda: _groups(d, groups, in_frame, sides, seed),
    }
    out = None
    for p in pools:
        out = make[p]() if out is None else out.unionByName(make[p]())
    return out


def _core(d: DataFrame, clustered: DataFrame, special: Column, ok: Column, in_frame: Column, sides: DataFrame, seed: int) -> DataFrame:
    large = selection.large_blocks(d, special, ok, in_frame, F.col("w") * F.col("h")).join(clustered, ["page_id", "id"], "left_anti")
    kept = units.spread(large, BLOCKS_A_PAGE)
    p = units.sampled_points(kept.select("page_id", "id", "b"), POINTS_A_BLOCK, seed).join(kept.select("page_id", "id", "markdown"), ["page_id", "id"])
    return _rows(p.join(sides, "page_id"), "core_inner", F.col("id").cast("string"), F.col("region"), F.col("markdown"), False)


def _fragments(d: DataFrame, in_frame: Column, seed: int) -> DataFrame:
    """Points go to a block's fragments in turn."""
    kept = top_by(selection.multi_fragment_blocks(d, in_frame), ["page_id"], [F.desc("ink"), F.col("id")], BLOCKS_A_PAGE)
    one = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(POINTS_A_BLOCK)))).withColumn("r", F.get("rects", (F.col("k") - 1) % F.size("rects")))
    p = _drawn(one.withColumn("inner", G.inner_area(F.col("r"))), "inner", f"{seed}f", "page_id", "id", "k")
    return _rows(p, "multi_frag", F.col("id").cast("string"), G.diamond_region(F.col("r"), F.col("x"), F.col("y")), F.col("markdown"), False)


def _clear(pages: DataFrame, ink: DataFrame, bands: DataFrame, sides: DataFrame, seed: int) -> DataFrame:
    p = units.empty_points(pages, ink, CLEAR_POINTS, CLEARANCE, seed).withColumnRenamed("rn", "k").join(sides, "page_id")
    b = units.band_points(bands, 1, seed + 1).withColumn("k", F.col("k") + CLEAR_POINTS).join(sides, "page_id")
    return _rows(p, "empty_clear", _none(), F.lit("neg_clear"), _none(), True).unionByName(_rows(b, "empty_clear", _none(), F.concat(F.lit("chrome_"), "band"), _none(), True))


def _boundary(d: DataFrame, ink: DataFrame, sides: DataFrame, seed: int) -> DataFrame:
    p = units.gap_points(units.boundary_pairs(d.select("page_id", "id", "b")), seed).withColumn("h", huniform(f"{seed}b", "page_id", "i", "j"))
    p = top_by(p, ["page_id"], [F.col("h"), F.col("i"), F.col("j")], BOUNDARY_POINTS).withColumn("k", F.concat_ws("_", F.col("i").cast("string"), F.col("j").cast("string"))).drop("h")
    free = units.boxes_at(p, ink).groupBy("page_id", "k", "x", "y").agg(F.bool_or(F.coalesce(G.contains(F.col("b"), F.col("x"), F.col("y")), F.lit(False))).alias("on")).filter("NOT on")
    return _rows(free.join(sides, "page_id"), "empty_boundary", _none(), F.lit("neg_boundary"), _none(), True)


def _groups(d: DataFrame, groups: DataFrame, in_frame: Column, sides: DataFrame, seed: int) -> DataFrame:
    m = groups.join(d.withColumn("in_frame", in_frame).select("page_id", "id", "b", "markdown", "in_frame"), ["page_id", "id"])
    whole = units.groups_in_frame(m).select("page_id", "group_id", F.col("markdown").alias("target"))
    whole = top_by(whole, ["page_id"], [huniform(f"{seed}g", "page_id", "group_id"), F.col("group_id")], GROUPS_A_PAGE)
    one = top_by(m.join(whole, ["page_id", "group_id"]), ["page_id", "group_id"], [huniform(f"{seed}m", "page_id", "group_id", "id"), F.col("id")], 1)
    p = _drawn(one.withColumn("inner", G.inner_area(F.col("b"))).withColumn("k", F.lit(1)), "inner", f"{seed}s", "page_id", "id").join(sides, "page_id")
    return _rows(p, "semantic_group", F.col("id").cast("string"), G.diamond_region(F.col("b"), F.col("x"), F.col("y")), F.col("target"), False)


def half_or_all(points: DataFrame, all_points: bool) -> DataFrame:
    """Of each block all of its points, or the first in the diamond and the first in a corner."""
    return points if all_points else selection.core_points(points)
