"""Reproducible samples: each is a ranking by hash within a bucket, cut at the bucket's quota.

Counts of hash slices tell which rows can be within a quota, whatever its size, so only those are shuffled and ranked.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hkey
from .quota import as_table, largest_remainder
from .ranking import cut_by_hash, hash_rank


# Fixed values of candidate_pool: page caps, the share of one template, near hashes, and the overflow of a reason.
PAGE_CAPS, TEMPLATE_SHARE, NEAR_BITS, OVERFLOW = (2, 8), 0.35, 4, 1.25


def top_by(df: DataFrame, bucket: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*bucket).orderBy(*order))).filter(F.col("__rn") <= n).drop("__rn")


def quota_sample(df: DataFrame, bucket: str, counts: dict[str, int], key: str, seed: int) -> DataFrame:
    """counts[b] rows of each bucket b, or all it has."""
    q = F.broadcast(as_table(df.sparkSession, counts, bucket).drop("position"))  # plan parameters
    few = cut_by_hash(df, bucket, q.withColumnRenamed("quota", "limit"), key, seed)
    return hash_rank(few, [bucket], key, seed, "__rn").join(q, bucket).filter(F.col("__rn") <= F.col("quota")).drop("__rn", "quota")


def mixed_sample(df: DataFrame, bucket: str, mix: dict[str, float], n: int, key: str, seed: int) -> DataFrame:
    return quota_sample(df, bucket, largest_remainder(mix, n), key, seed)


def boosted_sample(df: DataFrame, stem: str, boost: list[str], share: float, n: int, key: str, seed: int) -> DataFrame:
    """round(n share) rows of the boosted stems, dealt evenly over them and topped up among them, the others from the rest."""
    want = round(n * share)
    each = largest_remainder({s: 1.0 for s in boost}, want)
    # No more than `want` rows of a boosted stem, and n - want of all others together, can be chosen.
    d = df.withColumn("__g", F.when(F.col(stem).isin(boost), F.concat(F.lit("="), stem)).otherwise(""))
    limits = df.sparkSession.createDataFrame([("", n - want), *[(f"={s}", want) for s in boost]], "__g string, limit int")
    d = hash_rank(cut_by_hash(d, "__g", limits, key, seed), ["__g"], key, seed, "__i")
    q = F.broadcast(df.sparkSession.createDataFrame([(f"={s}", k) for s, k in each.items()], "__g string, quota int"))
    d = d.join(q, "__g", "left").withColumn("__boost", F.col("quota").isNotNull()).withColumn("__in", F.col("__i") <= F.coalesce("quota", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("__boost").orderBy(F.desc("__in"), hkey(seed, key), key))  # of the rows that are left, a few n
    return d.withColumn("__rn", rank).filter(F.col("__rn") <= F.when(F.col("__boost"), want).otherwise(n - want)).drop("__g", "__i", "__boost", "__in", "__rn", "quota")


def unique_page_first(df: DataFrame, page: str, n: int, key: str, seed: int) -> DataFrame:
    """n rows: one of each page before a second of any."""
    again = F.row_number().over(Window.partitionBy(page).orderBy(hkey(seed, key), key))
    return df.withColumn("__again", again > 1).orderBy("__again", hkey(seed, key), key).limit(n).drop("__again")


def round_robin(df: DataFrame, bucket: str, n: int, position: str) -> DataFrame:
    """n rows: the first of each bucket, then the second of each, in order of the buckets' first rows."""
    w = Window.partitionBy(bucket)
    d = df.withColumn("__round", F.row_number().over(w.orderBy(position))).filter(F.col("__round") <= n)  # cut before the shuffle
    d = d.withColumn("__first", F.min(position).over(w))
    return d.orderBy("__round", "__first").limit(n).drop("__round", "__first")


def upsample(df: DataFrame, factor: float, n: int, key: str, seed: int = 0, flag: str = "upsampled") -> DataFrame:
    """The n rows and round((factor - 1) n) copies, dealt over them in hash order and flagged."""
    extra = round((factor - 1) * n) if n else 0
    copies = F.lit(extra // max(n, 1)) + (F.col("__i") < extra % max(n, 1)).cast("int")
    d = hash_rank(df, [], key, seed, "__r").withColumn("__i", F.col("__r") - 1).withColumn("__copy", F.explode(F.sequence(F.lit(0), copies)))
    return d.withColumn(flag, F.col("__copy") > 0).drop("__r", "__i", "__copy")


def ratio_count(points: int, ratio: float) -> int:
    """How many rows of a second kind make up the ratio of all."""
    return round(points * ratio / (1 - ratio))


def repeated_to(df: DataFrame, n: int, have: int, key: str, seed: int) -> DataFrame:
    """n of the `have` rows in rounds, each a whole pass in hash order but the last."""
    rounds = -(-n // max(have, 1))
    d = hash_rank(df, [], key, seed, "__i").withColumn("__r", F.explode(F.sequence(F.lit(1), F.lit(max(rounds, 1)))))
    return d.filter((F.col("__r") - 1) * have + F.col("__i") <= n).drop("__i", "__r")


def preferred_or_looser(df: DataFrame, preferred: Column, looser: Column, n: int, key: str, seed: int) -> DataFrame:
    """n rows of the preferred ones if there are so many, else of the looser ones; an error if those are too few."""
    have, more = df.agg(F.count_if(preferred), F.count_if(looser)).first()
    if have < n and more < n:
        raise ValueError(f"{n} rows are wanted; {max(have, more)} qualify")
    return df.filter(preferred if have >= n else looser).orderBy(hkey(seed, key), key).limit(n)


def capped_greedy(df: DataFrame, bucket: str, order: list[tuple[str, bool]], n: int, page: str, page_cap: int, template: str, template_cap: int, tertile: str, schema: str) -> DataFrame:
    """Of each bucket up to n rows in the given order (name, ascending), under caps by page, template and tertile that a rejected row does not use up.

    The caps depend on each other, so a bucket goes through one loop, over as many rows as n and the caps allow, whatever
    the bucket's size. A row is taken if nothing before it that shares template and tertile could be but is not: those
    before it are taken (n at most) or on full pages (n / page_cap pages at most, with page_cap rows each that get here).
    So of template and tertile the first 2 n + 1 suffice; and of a tertile 2 n + 1 and those of full templates.
    """
    import pandas as pd

    by = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    rank = F.row_number().over(Window.partitionBy(bucket, page, template, tertile).orderBy(*by))
    few = df.withColumn("__p", rank).filter(F.col("__p") <= page_cap).drop("__p")
    few = top_by(few, [bucket, template, tertile], by, 2 * n + 1)
    few = top_by(few, [bucket, tertile], by, (2 * n + 1) * (2 + n // max(template_cap, 1)))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c, _ in order], ascending=[up for _, up in order], kind="stable").reset_index(drop=True)
        taken: set[int] = set()
        pages: dict = {}
        templates: dict = {}
        tertiles: dict = {}
        for limit in (-(-n // 3), -(-n // 3) + 1, None):
            for i, (p, t, k) in enumerate(zip(pdf[page], pdf[template], pdf[tertile], strict=True)):
                if len(taken) >= n:
                    break
                if i in taken or pages.get(p, 0) >= page_cap or templates.get(t, 0) >= template_cap or (limit is not None and tertiles.get(k, 0) >= limit):
                    continue
                taken.add(i)
                pages[p], templates[t], tertiles[k] = pages.get(p, 0) + 1, templates.get(t, 0) + 1, tertiles.get(k, 0) + 1
        return pdf.iloc[sorted(taken)]

    return few.groupBy(bucket).applyInPandas(pick, schema)


def _blocks(bits: int) -> list[tuple[int, int]]:
    """NEAR_BITS + 1 blocks of 64 bits; two hashes within NEAR_BITS share one."""
    edges = [round(i * 64 / (NEAR_BITS + 1)) for i in range(NEAR_BITS + 2)]
    return [(lo, (bits >> lo) & ((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]


def candidate_pool(df: DataFrame, target: int, mix: dict[str, float], seed: int, key: str, reason: str, score: str, page: str, template: str, tertile: str, bits: str, depth: int = 64) -> DataFrame:
    """Up to target rows: key, reason and place (from 1, in order of acceptance). Keys must be unique; rows without a reason are no candidates.

    Rows are tried by descending score (ties by hash), under caps of their reason by page, template and tertile; one whose
    hash (a long, null if it has none) is within NEAR_BITS of an accepted one of its reason is rejected. A rejected row uses
    up no cap. Pass 1: each reason's quota, from its shortlist of three times as many. Pass 2, if rows are missing: each
    reason up to its quota times OVERFLOW and 2. Pass 3: what is left of any reason, without tertiles. An empty page has no cap.

    Caps and choices depend on each other over all reasons, so one task runs the loop, on narrow rows. Of rows that share
    reason, page, template, tertile and hash only the first comes there: a later one is near it or meets the same caps.
    Of those that share all but the hash the first `depth` come; where the loop could have taken one after them, it is run
    anew with a greater depth, so the result is that of all rows. The pool, target rows at most, passes the driver.
    """
    import pandas as pd

    want = {r: round(f * target) for r, f in mix.items()}
    template_cap = max(4, int(TEMPLATE_SHARE * target))
    d = df.filter(F.col(reason).isNotNull()).select(
        F.col(key).alias("k"), F.col(reason).alias("r"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("s"), F.coalesce(page, F.lit("")).alias("p"), F.coalesce(template, F.lit("unknown")).alias("t"), F.col(tertile).alias("c"), F.col(bits).alias("b"), hkey(seed, key).alias("h")
    )
    d = d.withColumn("h", F.concat_ws("|", "h", F.col("k").cast("string"))).persist(StorageLevel.DISK_ONLY)  # read three times
    order = [F.desc("s"), F.col("h")]
    # A row for each reason of the mix: its pages, and the last row of its shortlist.
    pages = {x.r: x.n for x in d.filter(F.col("r").isin(list(mix))).groupBy("r").agg(F.count_distinct("p").alias("n")).collect()}
    short = {r: max(3 * n, 20) for r, n in want.items()}
    top = d.filter(F.col("r").isin(list(mix))).select("r", "s", "h").withColumn("i", F.row_number().over(Window.partitionBy("r").orderBy(*order))).filter(F.col("i") <= max(short.values(), default=0))
    in_short = F.col("i") <= F.create_map(*[F.lit(v) for kv in short.items() for v in kv])[F.col("r")]
    last = {x.r: (-x.e.s, x.e.h) for x in top.filter(in_short).groupBy("r").agg(F.max_by(F.struct("s", "h"), "i").alias("e")).collect()} if mix else {}
    kept, d = d, d.withColumn("b", F.col("b").cast("string"))
    first = top_by(d.withColumn("__b", F.coalesce("b", F.concat(F.lit("k"), "h"))), ["r", "p", "t", "c", "__b"], order, 1).drop("__b")
    ranked = first.withColumn("i", F.row_number().over(Window.partitionBy("r", "p", "t", "c").orderBy(*order)))
    lo, hi = PAGE_CAPS
    kind = df.schema[key].dataType.simpleString()

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "h"], ascending=[False, True], kind="stable")
        hashes = [None if pd.isna(b) else int(b) & (2**64 - 1) for b in pdf["b"]]  # strings, so that longs with nulls stay exact
        beyond = list(pdf["i"] > depth)
        cands = list(zip(pdf["k"], pdf["r"], pdf["s"], pdf["h"], pdf["p"], pdf["t"], pdf["c"], hashes, strict=True))
        by: dict = {}
        for i, x in enumerate(cands):
            by.setdefault(x[1], []).append(i)
        used: dict = {}
        near: dict = {}
        taken: dict[int, int] = {}
        short_of = False

        def accept(i: int, per_tertile: int | None, page_cap: int) -> bool:
            nonlocal short_of
            _, r, _, _, p, t, c, b = cands[i]
            at = [("c", r, c), ("p", r, p), ("t", r, t)]
            if i in taken or (per_tertile is not None and used.get(at[0], 0) >= per_tertile) or (p and used.get(at[1], 0) >= page_cap) or used.get(at[2], 0) >= template_cap:
                return False
            if beyond[i]:
                short_of = True
                return False
            if b is not None:
                blocks = [(r, *x) for x in _blocks(b)]
                if any((b ^ o).bit_count() <= NEAR_BITS for x in blocks for o in near.get(x, ())):
                    return False
                for x in blocks:
                    near.setdefault(x, []).append(b)
            for x in at:
                used[x] = used.get(x, 0) + 1
            taken[i] = len(taken) + 1
            return True

        got = dict.fromkeys(want, 0)
        for r, n in want.items():
            cap = max(lo, min(hi, -(-n // max(pages.get(r, 1), 1))))
            for i in by.get(r, []):
                if got[r] >= n or (-cands[i][2], cands[i][3]) > last[r]:
                    break
                got[r] += accept(i, max(1, n // 3), cap)
        for r, n in want.items():
            for i in by.get(r, []):
                if got[r] >= int(n * OVERFLOW) + 2 or len(taken) >= target:
                    break
                got[r] += accept(i, max(1, n // 2), hi)
        for i in range(len(cands)):
            if len(taken) >= target:
                break
            accept(i, None, 2 * hi)
        rows = [(cands[i][0], cands[i][1], n) for i, n in taken.items()]
        return pd.DataFrame([(None, None, 0)] if short_of else rows, columns=[key, reason, "place"])

    schema = f"`{key}` {kind}, `{reason}` string, place int"
    while True:
        pool = ranked.filter(F.col("i") <= depth + 1).groupBy(F.lit(0).alias("__all")).applyInPandas(choose, schema).collect()
        if not any(x.place == 0 for x in pool):
            kept.unpersist()
            return df.sparkSession.createDataFrame(pool, schema)
        depth *= 4
