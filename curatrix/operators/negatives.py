"""Misleading negatives: drop, relabel, upsample, by page geometry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X


@dataclass(frozen=True)
class Rules:
    most_chars: int = 120
    most_words: int = 12
    drop_clear_on_ink: bool = True
    drop_clear_on_chrome: bool = False
    drop_mislabel: bool = True
    relabel: bool = True
    scale_rects: bool = False


def with_geometry(samples: DataFrame, blocks: DataFrame, bands: DataFrame) -> DataFrame:
    """samples (pool_id, page_id, special_block_id, ...) with their page's ink rects and bands and their block's text."""
    page = ["pool_id", "page_id"]
    ink = blocks.groupBy(page).agg(F.flatten(F.collect_list(F.when(F.size("rects") > 0, F.col("rects")).otherwise(F.array("bbox")))).alias("ink"))
    ordered = bands.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("pos", "band", "bbox"))).alias("bands"))
    own = blocks.select(*page, F.col("id").alias("special_block_id"), F.col("markdown").alias("special_markdown"))
    return samples.join(own, [*page, "special_block_id"], "left").join(ink, page, "left").join(ordered, page, "left")


def verdict(rules: Rules = Rules()) -> Column:
    """struct(drop, reason, new_region) of rows that with_geometry has made. Positives are never dropped."""
    point, region = F.col("point"), F.coalesce("region", F.lit(""))
    k = F.coalesce("device_scale_factor", F.lit(1.0)) if rules.scale_rects else F.lit(1.0)
    x, y = point["x"] / k, point["y"] / k
    none = F.lit(None).cast("string")
    out = lambda drop, why, new=none: F.struct(F.lit(drop).alias("drop"), F.lit(why).alias("reason"), new.alias("new_region"))
    positive = ~F.coalesce("is_negative", F.lit(False)) & ~X.is_blank(F.col("target"))
    unknown = (F.coalesce("pool_id", F.lit("")) == "") | (F.coalesce("page_id", F.lit("")) == "") | point.isNull()
    special = F.startswith(region, F.lit("special_"))
    md = F.col("special_markdown")
    prose = (F.length(md) > rules.most_chars) | (F.size(F.filter(F.split(md, r"\s+"), lambda w: w != "")) >= rules.most_words)
    clear = region.isin("neg_clear", "neg_boundary", "")
    on_ink = F.coalesce(F.exists("ink", lambda r: G.inside(r, x, y)), F.lit(False))
    band = F.get(F.filter("bands", lambda b: G.inside(b["bbox"], x, y)), F.lit(0))["band"]
    e = F.when(positive | unknown, out(False, "")).when(special & md.isNull(), out(True, "special_block_missing")).when(special & prose, out(True, "special_prose"))
    if rules.drop_clear_on_ink:
        e = e.when(clear & on_ink, out(True, "clear_on_ink"))
    if rules.drop_clear_on_chrome:
        e = e.when(clear & band.isNotNull(), out(True, "clear_on_chrome"))
    elif rules.relabel:
        e = e.when(clear & band.isNotNull(), out(False, "clear_on_chrome", F.concat(F.lit("chrome_"), band)))
    if rules.drop_mislabel:
        e = e.when(F.startswith(region, F.lit("chrome_")) & band.isNull(), out(True, "chrome_mislabel"))
    return e.otherwise(out(False, ""))


def filtered(rows: DataFrame, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    """Kept rows, relabelled, and the report of reasons."""
    d = rows.withColumn("verdict", verdict(rules))
    report = d.groupBy(F.col("verdict.reason").alias("reason"), F.col("verdict.drop").alias("drop")).agg(F.count(F.lit(1)).alias("n"))
    kept = d.filter("NOT verdict.drop").withColumn("region_relabeled", F.col("verdict.new_region").isNotNull()).withColumn("region", F.coalesce("verdict.new_region", "region"))
    return kept.drop("verdict", "ink", "bands", "special_markdown"), report


def on_ink_or_chrome(x: Column, y: Column) -> Column:
    """Whether a point of a row that with_geometry has made is on any text or page furniture."""
    ink = F.exists("ink", lambda r: G.inside(r, x, y))
    return F.coalesce(ink, F.lit(False)) | F.coalesce(F.exists("bands", lambda b: G.inside(b["bbox"], x, y)), F.lit(False))
