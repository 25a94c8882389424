"""Label annotations: boxes to units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import viewport as V


def units(ann: DataFrame) -> DataFrame:
    """ann: source_path, image_wh array<int>, boxes array<struct<bbox array<int>, text, manual, unit_id>>.

    A row a unit: its boxes within the image in reading order (those under four pixels are dropped), the first text that
    is not blank, or all of them joined where none was set by hand, and whether any was.
    """
    d = ann.select("source_path", "image_wh", F.posexplode("boxes").alias("pos", "x"))
    d = d.withColumn("box", V.clamped_box(F.col("x.bbox"), F.col("image_wh")[0], F.col("image_wh")[1])).filter((F.col("box")[2] - F.col("box")[0] >= 4) & (F.col("box")[3] - F.col("box")[1] >= 4))
    d = d.withColumn("unit_id", F.coalesce(F.nullif("x.unit_id", F.lit("")), F.concat(F.lit("box"), F.col("pos").cast("string"))))
    in_order = F.array_sort(F.collect_list(F.struct(F.col("box")[1].alias("y"), F.col("box")[0].alias("x"), "pos", "box", F.col("x.text").alias("text"), F.coalesce("x.manual", F.lit(False)).alias("manual"))))
    g = d.groupBy("source_path", "unit_id").agg(in_order.alias("b"))
    texts = F.filter(F.transform("b", lambda b: X.strip(F.coalesce(b["text"], F.lit("")))), lambda t: t != "")
    by_hand = F.filter("b", lambda b: b["manual"] & ~X.is_blank(b["text"]))
    text = F.when(F.size(by_hand) > 0, F.get(by_hand, F.lit(0))["text"]).otherwise(F.array_join(F.array_distinct(texts), "\n\n"))
    return g.select("source_path", "unit_id", F.transform("b", lambda b: b["box"]).alias("boxes"), text.alias("text"), (F.size(by_hand) > 0).alias("manual"), (F.size("b") > 1).alias("multi"))


def unit_stats(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("units"), F.count_if(X.is_blank(F.col("text"))).alias("skipped"), F.count_if("multi").alias("multi"), F.count_if("manual").alias("manual"))
