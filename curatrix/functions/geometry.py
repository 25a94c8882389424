"""Boxes (structs x0, y0, x1, y1) and points as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pixel limits and shares of the sampling rules.
FACING_GAP, OVERLAP_LEAST, EDGE, INNER_SHARE = 48.0, 4.0, 48.0, 0.80
PATCH, MERGED_PATCH, MOST_ASPECT = 28, 32, 200
MARKER_SHARE = 0.005


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])


def width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def area(b: Column) -> Column:
    return width(b) * height(b)


def expand(b: Column, pad: float) -> Column:
    return box(b["x0"] - pad, b["y0"] - pad, b["x1"] + pad, b["y1"] + pad)


def contains(b: Column, x: Column, y: Column, margin: float = 0.0) -> Column:
    """Half-open: the right and bottom edges are outside."""
    return (x >= b["x0"] + margin) & (x < b["x1"] - margin) & (y >= b["y0"] + margin) & (y < b["y1"] - margin)


def inside(b: Column, x: Column, y: Column) -> Column:
    """Closed: all edges are inside."""
    return x.between(b["x0"], b["x1"]) & y.between(b["y0"], b["y1"])


def inner_area(b: Column, share: float = INNER_SHARE) -> Column:
    """The middle of a box that holds the share of its area, at least a pixel of inset and never inside out."""
    f = (1.0 - min(0.98, max(0.05, share)) ** 0.5) / 2
    dx, dy = F.greatest(F.lit(1.0), width(b) * f), F.greatest(F.lit(1.0), height(b) * f)
    fits = (width(b) > 2 * dx) & (height(b) > 2 * dy)
    return F.when(fits, box(b["x0"] + dx, b["y0"] + dy, b["x1"] - dx, b["y1"] - dy)).otherwise(b)


def center_band(b: Column, half: float) -> Column:
    h = min(0.49, max(0.05, half))
    cx, cy = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
    return box(cx - width(b) * h, cy - height(b) * h, cx + width(b) * h, cy + height(b) * h)


def clamped_point(b: Column, x: Column, y: Column, inset: float = 1.0) -> Column:
    """struct(x, y): the point moved into the box, `inset` from its sides; a box too small for that has its first corner and the inset."""
    side = lambda v, lo, hi: F.least(F.greatest(v, b[lo] + inset), F.greatest(b[lo] + inset, b[hi] - inset))
    return F.struct(side(x, "x0", "x1").alias("x"), side(y, "y0", "y1").alias("y"))


def area_ratio(b: Column, w: Column, h: Column) -> Column:
    """Null without a box or a page."""
    return F.when(b.isNotNull(), F.try_divide(area(b), w * h))


def overlap(a: Column, b: Column, axis: str) -> Column:
    return F.least(a[f"{axis}1"], b[f"{axis}1"]) - F.greatest(a[f"{axis}0"], b[f"{axis}0"])


def x_overlap_share(a: Column, b: Column) -> Column:
    w = F.least(width(a), width(b))
    return F.when(w <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), overlap(a, b, "x")) / w)


def facing_gap(a: Column, b: Column) -> Column:
    """Distance of two boxes that face each other: 0 if they overlap, null if they lie diagonally."""
    ox, oy = overlap(a, b, "x"), overlap(a, b, "y")
    return F.when((ox > OVERLAP_LEAST) & (oy > OVERLAP_LEAST), 0.0).when(ox > OVERLAP_LEAST, F.greatest(F.lit(0.0), -oy)).when(oy > OVERLAP_LEAST, F.greatest(F.lit(0.0), -ox))


def gap_strip(a: Column, b: Column) -> Column:
    """The rectangle between two facing boxes, or null."""
    ox, oy = overlap(a, b, "x"), overlap(a, b, "y")
    x0, x1 = F.greatest(a["x0"], b["x0"]), F.least(a["x1"], b["x1"])
    y0, y1 = F.greatest(a["y0"], b["y0"]), F.least(a["y1"], b["y1"])
    return F.when((ox > OVERLAP_LEAST) & (oy < 0), box(x0, y1, x1, y0)).when((oy > OVERLAP_LEAST) & (ox < 0), box(x1, y0, x0, y1))


def distance_outside(x: Column, y: Column, boxes: Column) -> Column:
    """0 inside a box, else the distance to the nearest; infinite without boxes."""
    away = F.transform(boxes, lambda b: F.hypot(F.greatest(b["x0"] - x, F.lit(0.0), x - b["x1"]), F.greatest(b["y0"] - y, F.lit(0.0), y - b["y1"])))
    return F.coalesce(F.array_min(away), F.lit(float("inf")))


def union_box(boxes: Column) -> Column:
    kept = F.filter(boxes, lambda b: (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]))
    side = lambda f, n: f(F.transform(kept, lambda b: b[n]))
    return F.when(F.size(kept) > 0, box(side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1")))


def ink_area(rects: Column) -> Column:
    return F.aggregate(rects, F.lit(0.0), lambda s, r: s + area(r))


def near_edge(x: Column, y: Column, w: Column, h: Column, margin: float = EDGE) -> Column:
    return (x <= margin) | (y <= margin) | (x >= w - margin) | (y >= h - margin)


def diamond_region(b: Column, x: Column, y: Column) -> Column:
    """diamond within half the half-sides in Manhattan distance, else the quadrant."""
    cx, cy = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
    d = F.abs(x - cx) / F.greatest(width(b) / 2, F.lit(1e-6)) + F.abs(y - cy) / F.greatest(height(b) / 2, F.lit(1e-6))
    return F.when(d <= 1.0, "diamond").when((x < cx) & (y < cy), "nw").when((x >= cx) & (y < cy), "ne").when(x < cx, "sw").otherwise("se")


def pixel_to_norm(v: Column, side: Column, grid: int = 1000) -> Column:
    return F.least(F.lit(grid - 1), F.greatest(F.lit(0), F.floor(v / side * grid))).cast("int")


def pixel_to_pct(v: Column, side: Column) -> Column:
    return F.least(F.lit(99.9), F.greatest(F.lit(0.0), F.bround(v / side * 100.0, 1)))


def smart_resize(h: Column, w: Column, least: int, most: int, factor: int = PATCH) -> Column:
    """struct(h, w): multiples of the factor, nearest to the sides, with a number of pixels between the bounds."""
    f = float(factor)
    h0, w0 = (F.greatest(F.lit(f), F.bround(v / f) * f) for v in (h, w))
    down, up = F.sqrt(h * w / float(most)), F.sqrt(F.lit(float(least)) / (h * w))
    small = lambda v: F.greatest(F.lit(f), F.floor(v / down / f) * f)
    large = lambda v: F.ceil(v * up / f) * f
    fit = lambda v, v0: F.when(h0 * w0 > most, small(v)).when(h0 * w0 < least, large(v)).otherwise(v0).cast("int")
    ok = F.greatest(h, w) / F.least(h, w) <= MOST_ASPECT
    return F.when(ok, F.struct(fit(h, h0).alias("h"), fit(w, w0).alias("w")))


def vision_tokens(h: Column, w: Column, least: int, most: int) -> Column:
    r = smart_resize(h, w, least, most)
    return F.floor(r["h"] / MERGED_PATCH) * F.floor(r["w"] / MERGED_PATCH)


def marker_half(w: Column, h: Column, share: float = MARKER_SHARE) -> Column:
    return F.greatest(F.lit(6.0), F.bround(F.sqrt(w * h * share / 2)))


# The marker's opacity at any size; the short side that a dot is made for, and the bounds of its scale.
MARKER_OPACITY, DOT_SIDE, DOT_SCALE = 255, 1080.0, (0.55, 1.7)


def dot_scale(w: Column, h: Column) -> Column:
    """By how much a dot grows with the short side of its image."""
    low, high = DOT_SCALE
    return F.greatest(F.lit(low), F.least(F.lit(high), F.least(F.greatest(w, F.lit(1.0)), F.greatest(h, F.lit(1.0))) / DOT_SIDE))


def marker_fits(w: Column, h: Column, share: float = MARKER_SHARE, least: float = 24.0) -> Column:
    """Whether a marker of its share of the image is at least so wide, and no wider than the image."""
    side = 2 * marker_half(w, h, share)
    return (side >= least) & (side <= F.least(w, h))


def area_share_for_scale(scale: Column) -> Column:
    return MARKER_SHARE * F.greatest(F.lit(0.05), scale)


def fully_in_frame(rects: Column, w: Column, h: Column, visible: Column, in_viewport: Column, outside: float = 2.0) -> Column:
    """Every rectangle at least two pixels and within the frame; visibility, where known, at least 0.98."""
    ok = F.forall(rects, lambda r: (width(r) >= 2) & (height(r) >= 2) & (r["x0"] >= -outside) & (r["y0"] >= -outside) & (r["x1"] <= w + outside) & (r["y1"] <= h + outside))
    return ok & ((F.size(rects) > 1) | F.coalesce(visible >= 0.98, F.lit(True))) & F.coalesce(in_viewport >= 0.98, F.lit(True))


def occupied_share(rects: Column, w: Column, h: Column, cell: int = 8) -> Column:
    """Share of a page's cells, of `cell` pixels a side, that rectangles cover: overlaps count once."""
    span = lambda a, b: F.when(F.ceil(b / cell) > F.floor(a / cell), F.sequence(F.floor(a / cell), F.ceil(b / cell) - 1)).otherwise(F.array().cast("array<bigint>"))
    cells = F.transform(rects, lambda r: F.flatten(F.transform(span(r["x0"], r["x1"]), lambda i: F.transform(span(r["y0"], r["y1"]), lambda j: i * 1_000_000 + j))))
    return F.size(F.array_distinct(F.flatten(cells))) / (F.ceil(w / cell) * F.ceil(h / cell))
