"""Window sizes, insets, crops, and coordinates in prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import categorical, hint_between, huniform

# Narrowest and widest aspect, grid of sizes, least side that insets leave.
NARROW, WIDE, GRID, LEAST_REMAIN = 3 / 4, 16 / 9, 8, 64


def snap(v: Column, multiple: int = GRID) -> Column:
    return F.greatest(F.lit(float(multiple)), F.bround(v / multiple) * multiple).cast("int")


def fit_aspect(w: Column, h: Column) -> Column:
    """struct(w, h): the height changed so that the aspect is neither too narrow nor too wide."""
    a = w / h
    return F.struct(w.cast("double").alias("w"), F.when(a < NARROW, w / NARROW).when(a > WIDE, w / WIDE).otherwise(h.cast("double")).alias("h"))


def clamp_pixels(w: Column, h: Column, dpr: Column, most: float) -> Column:
    """struct(w, h) shrunk by the same factor until the device pixels fit."""
    k = F.least(F.lit(1.0), F.sqrt(most / (w * h * dpr * dpr)))
    return F.struct(F.floor(w * k).cast("int").alias("w"), F.floor(h * k).cast("int").alias("h"))


def sampled_window(seed: int, aspects: dict[str, float], least: float, most: float, *key: Column | str) -> Column:
    """struct(w, h): an aspect by weight ("16:9"), an area log-uniform between two bounds, sides on the grid."""
    name = categorical(f"{seed}a", aspects, *key)
    part = lambda i: F.split(name, ":")[i].cast("double")
    area = F.exp(F.log(F.lit(least)) + huniform(f"{seed}s", *key) * (F.log(F.lit(most)) - F.log(F.lit(least))))
    w = F.sqrt(area * part(0) / part(1))
    return F.struct(snap(w).alias("w"), snap(area / w).alias("h"))


def jittered_preset(seed: int, presets: list[tuple[int, int]], *key: Column | str) -> Column:
    """struct(w, h): a preset, up to 6 % larger or smaller, on the grid."""
    p = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in presets])
    one = F.get(p, hint_between(f"{seed}p", 0, len(presets) - 1, *key))
    k = 0.94 + 0.12 * huniform(f"{seed}j", *key)
    return F.struct(snap(one["w"] * k).alias("w"), snap(one["h"] * k).alias("h"))


def sampled_dpr(seed: int, weights: dict[str, float], *key: Column | str) -> Column:
    return categorical(f"{seed}d", weights, *key).cast("double")


def insets(left: Column, top: Column, right: Column, bottom: Column, w: Column, h: Column) -> Column:
    """struct of insets cut so that LEAST_REMAIN pixels stay on each axis."""
    x0 = F.least(F.greatest(left, F.lit(0)), F.greatest(w - LEAST_REMAIN, F.lit(0)))
    y0 = F.least(F.greatest(top, F.lit(0)), F.greatest(h - LEAST_REMAIN, F.lit(0)))
    x1 = F.least(F.greatest(right, F.lit(0)), F.greatest(w - x0 - LEAST_REMAIN, F.lit(0)))
    y1 = F.least(F.greatest(bottom, F.lit(0)), F.greatest(h - y0 - LEAST_REMAIN, F.lit(0)))
    return F.struct(x0.alias("left"), y0.alias("top"), x1.alias("right"), y1.alias("bottom"))


def crop(x: Column, y: Column, w: Column, h: Column, side: int) -> Column:
    """struct of a square crop around a point, kept in the image: its origin, and the point within it."""
    origin = lambda v, n: F.greatest(F.lit(0.0), F.least(v - side / 2, n - F.least(F.lit(float(side)), n)))
    return F.struct(origin(x, w).alias("x0"), origin(y, h).alias("y0"), (x - origin(x, w)).alias("x"), (y - origin(y, h)).alias("y"))


def clamped_box(b: Column, w: Column, h: Column) -> Column:
    """An array of four numbers as whole pixels within the image, corners in order."""
    c = lambda v, n: F.least(F.greatest(v.cast("int"), F.lit(0)), n)
    xs, ys = (c(b[0], w), c(b[2], w)), (c(b[1], h), c(b[3], h))
    return F.array(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def with_coordinates(prompt: Column, x: Column, y: Column) -> Column:
    return F.replace(F.replace(prompt, F.lit("{x}"), x.cast("string")), F.lit("{y}"), y.cast("string"))


def pixel_prompt(template: str, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Whole pixels within the image."""
    c = lambda v, n: F.least(F.greatest(F.bround(v), F.lit(0.0)), n - 1.0).cast("int")
    return with_coordinates(F.lit(template), c(x, w), c(y, h))
