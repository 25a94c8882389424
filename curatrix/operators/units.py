"""Units of a page: groups of blocks, short clusters in reading order, boundary pairs, sampled points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.keys import hkey, huniform

# Limits of a short cluster.
CLUSTER_GAP, CLUSTER_OVERLAP, DEK_CHARS, DEK_HEIGHT = 36.0, 0.35, 120, 48.0
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def role_of(tag: Column, n_chars: Column, height: Column) -> Column:
    """h, li, dek (a short lead), or null."""
    return F.when(tag.isin(*HEADINGS), "h").when(tag == "li", "li").when((tag == "p") & (n_chars <= DEK_CHARS) & (height <= DEK_HEIGHT), "dek")


def may_follow(role: Column, before: Column) -> Column:
    return F.when(role == "li", before.isin("h", "dek", "li")).when(role == "dek", before == "h").when(role == "h", before == "dek")


def clusters(blocks: DataFrame) -> DataFrame:
    """(page_id, id, cluster): blocks (page_id, id, tag, markdown, x0, y0, x1, y1) chained in reading order, each to the block with a role just before it.

    Chains of one block, and those without a list item that are not a heading with its lead, are dropped; the others are
    named by their first block.
    """
    d = blocks.withColumn("role", role_of(F.col("tag"), F.length(F.coalesce("markdown", F.lit(""))), F.col("y1") - F.col("y0"))).filter("role IS NOT NULL")
    w = Window.partitionBy("page_id").orderBy("y0", "x0", "id")
    was = {c: F.lag(c).over(w) for c in ("x0", "x1", "y1", "role")}
    shared = F.least(was["x1"], F.col("x1")) - F.greatest(was["x0"], F.col("x0"))
    near = (F.col("y0") - was["y1"]).between(0, CLUSTER_GAP) & (shared / F.greatest(F.lit(1e-6), F.least(was["x1"] - was["x0"], F.col("x1") - F.col("x0"))) >= CLUSTER_OVERLAP)
    d = d.withColumn("new", F.when(near & may_follow(F.col("role"), was["role"]), 0).otherwise(1))
    d = d.withColumn("chain", F.sum("new").over(w))
    own = Window.partitionBy("page_id", "chain")
    has = lambda r: F.max((F.col("role") == r).cast("int")).over(own) == 1
    n = F.count(F.lit(1)).over(own)
    d = d.withColumns({"keep": (n >= 2) & (has("li") | ((n == 2) & has("h") & has("dek"))), "cluster": F.first("id").over(own.orderBy("y0", "x0", "id"))})
    return d.filter("keep").select("page_id", "id", "cluster")


#: Side of the cells by which boxes of a page meet.
CELL = 256


def in_cells(df: DataFrame, b: str = "b", pad: float = 0.0, cell: int = CELL) -> DataFrame:
    """df with a row (cx, cy) for each cell of the page that its box, wider by pad on all sides, touches."""
    span = lambda lo, hi: F.sequence(F.floor((F.col(f"{b}.{lo}") - pad) / cell), F.greatest(F.floor((F.col(f"{b}.{lo}") - pad) / cell), F.floor((F.col(f"{b}.{hi}") + pad) / cell)))
    return df.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))


def boundary_pairs(boxes: DataFrame, most: float = G.FACING_GAP) -> DataFrame:
    """Pairs of boxes (page_id, id, b) of a page that face each other within `most` pixels, with the strip between. Only boxes that share a cell are compared, each pair in its first one, so a page of many boxes is no whole join."""
    a = in_cells(boxes.select("page_id", F.col("id").alias("i"), F.col("b").alias("a")), "a", most)
    b = in_cells(boxes.select("page_id", F.col("id").alias("j"), "b"), "b")
    first = lambda side: F.greatest(F.floor((F.col(f"a.{side}") - most) / CELL), F.floor(F.col(f"b.{side}") / CELL))
    j = a.join(b, ["page_id", "cx", "cy"]).filter((F.col("i") < F.col("j")) & (F.col("cx") == first("x0")) & (F.col("cy") == first("y0")))
    gap = G.facing_gap(F.col("a"), F.col("b"))
    return j.withColumn("gap", gap).filter(F.col("gap") <= most).select("page_id", "i", "j", "gap", G.gap_strip(F.col("a"), F.col("b")).alias("strip"))


def boxes_at(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """points (page_id, x, y and others) with each box b of the page whose cell they are in; null for none."""
    at = points.withColumn("cx", F.floor(F.col("x") / CELL)).withColumn("cy", F.floor(F.col("y") / CELL))
    return at.join(in_cells(boxes.select("page_id", "b")), ["page_id", "cx", "cy"], "left").drop("cx", "cy")


def sampled_points(boxes: DataFrame, per_box: int, seed: int, share: float = G.INNER_SHARE) -> DataFrame:
    """per_box points uniform in the inner part of each box, with their region: no rejection is needed."""
    d = boxes.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_box)))).withColumn("inner", G.inner_area(F.col("b"), share))
    x = F.col("inner.x0") + huniform(f"{seed}x", "page_id", "id", "k") * (F.col("inner.x1") - F.col("inner.x0"))
    y = F.col("inner.y0") + huniform(f"{seed}y", "page_id", "id", "k") * (F.col("inner.y1") - F.col("inner.y0"))
    d = d.withColumns({"x": x, "y": y})
    return d.select("page_id", "id", "k", "x", "y", G.diamond_region(F.col("b"), F.col("x"), F.col("y")).alias("region"))


def spread(boxes: DataFrame, n: int, page: str = "page_id") -> DataFrame:
    """The n largest boxes of each page that are not in the first fifth in reading order."""
    w = Window.partitionBy(page)
    d = boxes.withColumn("__at", F.row_number().over(w.orderBy("b.y0", "b.x0", "id"))).withColumn("__n", F.count(F.lit(1)).over(w))
    d = d.filter(F.col("__at") > F.floor(F.col("__n") * 0.2))
    return d.withColumn("__rn", F.row_number().over(w.orderBy(F.desc(G.area(F.col("b"))), "id"))).filter(F.col("__rn") <= n).drop("__at", "__n", "__rn")


def groups_in_frame(members: DataFrame) -> DataFrame:
    """Groups (page_id, group_id) all of whose members are in the frame, with their texts in order and their union box."""
    g = members.groupBy("page_id", "group_id").agg(F.bool_and("in_frame").alias("ok"), F.array_sort(F.collect_list(F.struct("pos", "markdown", "b"))).alias("m"))
    texts = F.filter(F.transform("m", lambda x: x["markdown"]), lambda t: F.trim(t) != "")
    return g.filter("ok").select("page_id", "group_id", F.array_join(texts, "\n\n").alias("markdown"), G.union_box(F.transform("m", lambda x: x["b"])).alias("b"))


def in_hash_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(hkey(seed, key), key)


def empty_points(pages: DataFrame, boxes: DataFrame, n: int, margin: float, seed: int, tries: int = 24) -> DataFrame:
    """Up to n points of each page (page_id, w, h) at least margin from every box: the first of `tries` hash-uniform candidates that qualify."""
    own = boxes.groupBy("page_id").agg(F.collect_list("b").alias("boxes"))
    d = pages.join(own, "page_id", "left").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    d = d.withColumns({"x": huniform(f"{seed}ex", "page_id", "k") * F.col("w"), "y": huniform(f"{seed}ey", "page_id", "k") * F.col("h")})
    d = d.filter(F.coalesce(G.distance_outside(F.col("x"), F.col("y"), F.col("boxes")) >= margin, F.lit(True)))
    return d.withColumn("rn", F.row_number().over(Window.partitionBy("page_id").orderBy("k"))).filter(F.col("rn") <= n).select("page_id", "rn", "x", "y")


def gap_points(pairs: DataFrame, seed: int) -> DataFrame:
    """A point in the strip of each boundary pair: negatives close to text."""
    u = lambda s: huniform(f"{seed}{s}", "page_id", "i", "j")
    s = F.col("strip")
    return pairs.filter(s.isNotNull()).select("page_id", "i", "j", (s["x0"] + u("gx") * (s["x1"] - s["x0"])).alias("x"), (s["y0"] + u("gy") * (s["y1"] - s["y0"])).alias("y"))


def band_points(bands: DataFrame, n: int, seed: int) -> DataFrame:
    """n points in bands (page_id, band, b) of a page that are at least 20 by 10 pixels, each in a band of its own draw."""
    usable = bands.filter((G.width(F.col("b")) >= 20) & (G.height(F.col("b")) >= 10))
    d = usable.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("band", "b"))).alias("bs")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    u = lambda s: huniform(f"{seed}{s}", "page_id", "k")
    d = d.withColumn("one", F.get("bs", F.floor(u("b") * F.size("bs")).cast("int")))
    b = F.col("one.b")
    return d.select("page_id", "k", "one.band", (b["x0"] + u("x") * G.width(b)).alias("x"), (b["y0"] + u("y") * G.height(b)).alias("y"))


def fragments(boxes: DataFrame, near: float = 12.0) -> DataFrame:
    """(page_id, id, fragment): line boxes (page_id, id, b) whose expanded boxes meet, joined to fragments, page by page."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        b = [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in pdf["b"]]
        root = list(range(len(b)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(len(b)):
            for j in range(i):
                if b[i][0] <= b[j][2] + near and b[j][0] <= b[i][2] + near and b[i][1] <= b[j][3] + near and b[j][1] <= b[i][3] + near:
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
        return pd.DataFrame({"page_id": pdf["page_id"], "id": pdf["id"], "fragment": [pdf["id"][find(i)] for i in range(len(b))]})

    return boxes.select("page_id", "id", "b").groupBy("page_id").applyInPandas(run, "page_id string, id string, fragment string")


def point_rows(points: DataFrame, blocks: DataFrame, image_w: int, image_h: int) -> DataFrame:
    """Sample rows of points on blocks: pixel and grid coordinates, region and target."""
    d = points.join(blocks.select("page_id", "id", F.col("markdown").alias("target")), ["page_id", "id"])
    norm = F.array(G.pixel_to_norm(F.col("x"), F.lit(float(image_w))), G.pixel_to_norm(F.col("y"), F.lit(float(image_h))))
    return d.select(F.concat_ws("__", "page_id", "id", F.col("k").cast("string")).alias("sample_id"), "page_id", F.col("id").alias("block_id"), "region", F.array("x", "y").alias("point"), norm.alias("point_norm"), "target", (F.trim(F.coalesce("target", F.lit(""))) == "").alias("is_negative"))
