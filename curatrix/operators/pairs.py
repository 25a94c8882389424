"""Parallel text: read in any shape, clean, swap, filter, bucket, dedup, cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from . import dedup


def extracted(df: DataFrame, raw: str) -> DataFrame:
    """en, zh of JSON rows: a translation object, or source and target under one of their names."""
    v = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object(raw, p), F.lit("")) for p in paths])
    return df.withColumn("en", v("$.translation.en", "$.en", "$.source", "$.src", "$.english")).withColumn("zh", v("$.translation.zh", "$.zh", "$.target", "$.tgt", "$.chinese"))


def cleaned(df: DataFrame) -> DataFrame:
    """en and zh cleaned, swapped where the sides are the other way round."""
    d = df.withColumn("en", X.clean_pair_text(F.col("en"))).withColumn("zh", X.clean_pair_text(F.col("zh")))
    turned = X.looks_zh(F.col("en")) & ~X.looks_en(F.col("en")) & X.looks_en(F.col("zh"))
    return d.withColumn("__t", turned).withColumns({"en": F.when(F.col("__t"), F.col("zh")).otherwise(F.col("en")), "zh": F.when(F.col("__t"), F.col("en")).otherwise(F.col("zh"))}).drop("__t")


def harvested(df: DataFrame, cap: int) -> DataFrame:
    """df: en, zh, domain, source, source_pos, line. Good pairs with a bucket, the first of each text over all sources, cap a source."""
    d = cleaned(df).filter(C.ok_pair(F.col("en"), F.col("zh"))).withColumn("bucket", C.length_bucket(F.col("en"), F.col("domain"))).filter("bucket IS NOT NULL")
    return dedup.capped_sources(d.withColumn("k", dedup.pair_key(F.col("en"))), "k", "source", "source_pos", "line", cap).drop("k")


def summary(pairs: DataFrame) -> DataFrame:
    """Counts by domain, bucket and source in one scan."""
    return pairs.groupingSets([[F.col("domain")], [F.col("bucket")], [F.col("source")]], "domain", "bucket", "source").agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"))


def allotted(pairs: DataFrame, per_page: int, seed: int) -> DataFrame:
    """Pages that take per_page pairs of each bucket without repeating any: adds page, from 0."""
    from .ranking import hash_rank

    return hash_rank(pairs, ["bucket"], "en", seed, "__rn").withColumn("page", F.floor((F.col("__rn") - 1) / per_page)).drop("__rn")


def normalized_item(item: Column) -> Column:
    """struct(en, zh, domain, source) of a JSON item that is a text or an object with names of either kind; null without en."""
    v = lambda *p: F.coalesce(*[F.nullif(F.trim(F.get_json_object(item, x)), F.lit("")) for x in p])
    plain = F.when(~F.startswith(F.ltrim(item), F.lit("{")), F.nullif(F.trim(item), F.lit("")))
    en = F.coalesce(v("$.en", "$.source_text", "$.text"), plain)
    return F.when(en.isNotNull(), F.struct(en.alias("en"), F.coalesce(v("$.zh", "$.translation"), F.lit("")).alias("zh"), F.coalesce(v("$.domain"), F.lit("general")).alias("domain"), F.coalesce(v("$.source"), F.lit("")).alias("source")))


def picked(slots: DataFrame, pairs: DataFrame, seed: int) -> DataFrame:
    """slots: page_id, slot, bucket. A pair for each slot, none twice on a page while the bucket lasts: each page starts at a place of its own in the bucket's order."""
    from pyspark.sql import Window

    from ..functions.keys import huniform
    from .ranking import hash_rank

    p = hash_rank(pairs, ["bucket"], "en", seed, "__i", "__n")
    n = p.groupBy("bucket").agg(F.max("__n").alias("__m"))  # a row a bucket
    s = slots.withColumn("__k", F.row_number().over(Window.partitionBy("page_id", "bucket").orderBy("slot")) - 1).join(n, "bucket")
    s = s.withColumn("__i", (F.floor(huniform(seed, "page_id", "bucket") * F.col("__m")) + F.col("__k")) % F.col("__m") + 1)
    return s.join(p.drop("__n"), ["bucket", "__i"]).drop("__i", "__k", "__m")


#: Where a bucket that has nothing left is filled from, in this order.
FALLBACK = ("paragraphs", "list_items", "captions", "headings", "code_lines", "cells")


def taken_pages(pairs: DataFrame, pages: int, per_page: int, seed: int) -> DataFrame:
    """For each page, from 0, per_page pairs of each bucket: none twice until the bucket is used up, what is left of it on the last page before that, then the bucket anew in another order. pairs: bucket, en and others."""
    from .ranking import hash_rank

    sizes = pairs.groupBy("bucket").agg(F.count(F.lit(1)).alias("__n"))  # a row a bucket
    rounds = F.ceil(F.lit(pages) / F.ceil(F.col("__n") / per_page))
    d = pairs.join(F.broadcast(sizes), "bucket").withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), rounds - 1)))
    d = hash_rank(d.withColumn("__k", F.concat_ws("|", F.col("round").cast("string"), "en")), ["bucket", "round"], "__k", seed, "__i")
    d = d.withColumn("page", F.col("round") * F.ceil(F.col("__n") / per_page) + F.floor((F.col("__i") - 1) / per_page))
    return d.filter(F.col("page") < pages).withColumn("place", (F.col("__i") - 1) % per_page).drop("__n", "__k", "__i")


def filled_slots(slots: DataFrame, taken: DataFrame) -> DataFrame:
    """slots: page, slot, bucket; taken: page, bucket, place, en, zh, domain, source. A pair for each slot, no English text twice on a page: of its bucket, else of the others in order, else a numbered filler.

    What a slot gets depends on those before it, so a page goes through one loop, over its own slots and the pairs that
    taken_pages has given it.
    """
    import pandas as pd

    def fill(s: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        bags = {b: g.sort_values("place").to_dict("records") for b, g in p.groupby("bucket")}
        used: set[str] = set()
        rows = []
        for r in s.sort_values("slot").itertuples():
            found = None
            for b in dict.fromkeys((r.bucket, *FALLBACK)):
                bag = bags.get(b, [])
                while bag and found is None:
                    x = bag.pop(0)
                    k = " ".join((x["en"] or "").lower().split())
                    if k and k not in used:
                        used.add(k)
                        found = (x["en"], x["zh"], x["domain"], x["source"])
                if found:
                    break
            if found is None:
                text = f"Filler text {len(used) + 1} of this page."
                used.add(text.lower())
                found = (text, "", "fallback", "fallback")
            rows.append((r.page, r.slot, r.bucket, *found))
        return pd.DataFrame(rows, columns=["page", "slot", "bucket", "en", "zh", "domain", "source"])

    p = taken.select("page", "bucket", "place", "en", "zh", "domain", "source")
    return slots.select(F.col("page").cast("long").alias("page"), "slot", "bucket").groupBy("page").cogroup(p.groupBy("page")).applyInPandas(fill, "page long, slot long, bucket string, en string, zh string, domain string, source string")


def applied(blocks: DataFrame, filled: DataFrame, skipped: Column) -> DataFrame:
    """blocks (page, slot, markdown, ...) with the text of their pair, its translation and domain; skipped ones keep their own."""
    f = filled.select("page", "slot", F.col("en").alias("__en"), F.col("zh").alias("__zh"), F.col("domain").alias("__domain"))
    new = F.col("__en").isNotNull() & ~F.coalesce(skipped, F.lit(False))
    d = blocks.join(f, ["page", "slot"], "left")
    return d.withColumns({"markdown": F.when(new, F.col("__en")).otherwise(F.col("markdown")), "translation": F.when(new, F.col("__zh")), "mt_domain": F.when(new, F.col("__domain"))}).drop("__en", "__zh", "__domain")
