"""A recipe applied to pools: sample, split, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import geometry as G
from ..functions import text as X
from ..operators import mixing, quota, sampling, split
from .recipe import Recipe


def sampled(pools: DataFrame, r: Recipe) -> DataFrame:
    """pools: sample_id, pool_id, template_stem, chrome_family, text_occupancy. Each pool's quota, by chrome and boost where the recipe says so."""
    counts = quota.largest_remainder(r.mix, r.n)
    d = pools.filter(C.occupancy_ok(F.col("text_occupancy"))).withColumn("chrome", C.chrome_bucket(F.col("chrome_family")))
    plain = {k: n for k, n in counts.items() if k not in r.boost and not r.chrome}
    parts = [sampling.quota_sample(d, "pool_id", plain, "sample_id", r.seed)] if plain else []
    for pool, n in counts.items():
        if pool in r.boost:
            parts.append(sampling.boosted_sample(d.filter(F.col("pool_id") == pool), "template_stem", r.boost[pool].stems, r.boost[pool].share, n, "sample_id", r.seed))
        elif r.chrome:
            parts.append(sampling.quota_sample(d.filter(F.col("pool_id") == pool), "chrome", quota.largest_remainder(r.chrome, n), "sample_id", r.seed))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def composed(pools: DataFrame, r: Recipe) -> DataFrame:
    """Sampled rows with stage, split and ord."""
    d = split.stratified(sampled(pools, r), ["pool_id", "chrome"], "sample_id", r.split["train"], r.split["val"], r.seed)
    return mixing.proportional(d.withColumn("stage", F.lit(r.name)), "sample_id", r.seed)


def rewritten_prompts(df: DataFrame, prompts: dict[str, str], key: str) -> DataFrame:
    """The first user message becomes the prompt of the key, with its image mark."""
    if key not in prompts:
        raise KeyError(key)
    mark = lambda m: F.when(F.startswith(m["content"], F.lit("<image>")), "<image>\n").otherwise("")
    new = F.transform("messages", lambda m, i: F.when((i == 0) & (m["role"] == "user"), F.struct(m["role"].alias("role"), F.concat(mark(m), F.lit(prompts[key])).alias("content"))).otherwise(m))
    return df.withColumn("messages", new).withColumn("metadata", F.col("metadata").withField("prompt_key", F.lit(key)))


def remarked(df: DataFrame, scale: Column, root: str, tag: str, seed: int) -> DataFrame:
    """Samples that point to pictures with a marker made anew: the picture's new place, the marker's name, scale and share of the area, the render it is made from, and the seed of its noise, which follows from the page's number."""
    m = F.col("metadata")
    name = F.concat(F.lit(root.rstrip("/") + "/"), F.coalesce(F.nullif(m["pool_id"], F.lit("")), F.lit("misc")), F.lit("/"), X.safe_stem(m["sample_id"]), F.lit("__a"), F.replace(F.regexp_replace(F.call_function("format_number", scale, F.lit("0.####")), ",", "."), F.lit("."), F.lit("p")), F.lit(".jpg"))
    noise = F.lit(seed) + 31 * F.coalesce(X.page_index(m["page_id"]), F.lit(0))
    new = m.withField("marker", F.lit(tag)).withField("marker_area_scale", scale).withField("marker_area_frac", G.MARKER_SHARE * scale)
    return df.withColumns({"metadata": new, "marker_source_render": F.get("images", F.lit(0)), "images": F.array(name), "noise_seed": noise})
