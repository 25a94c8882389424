"""Document fingerprints: a Merkle tree over sections, paragraphs and spans, in DataFrame functions only.

A text is cut after blank lines into sections, at line ends into paragraphs, and a paragraph after sentence marks (or
each SPAN characters, HEAD_SPAN in its head) into spans, the leaves. A section keeps the blank lines and the indent after
it, so no character is left out: sections give the text, a section is its paragraphs joined by line ends, a paragraph its
spans. A leaf's digest is SHA-256 of its text, a paragraph's that of its leaves' digests, a section's that of its
paragraphs', the root that of the sections'. The fingerprint names all of them:
root "/" sections joined by ";", a section being paragraphs joined by ",", a paragraph "digest.spans" (16 and 8 hex
digits each). Equal texts, and no others, have equal roots; unequal branches locate edits (`differing`).

Likeness goes down both trees where they differ: equal sections match with all their leaves; of the others, equal
paragraphs do; of those that are left, equal leaves. Branches that stand several times at a level count once there. With
M leaves matched and U left over on either side, likeness is 2 M / (2 M + U); without any leaf, 1 for equal roots, else 0.

Nulls: a null text counts as an empty one, one section of one paragraph without spans. Very long texts are taken whole.
Repeated rows stay; rows of one doc_id, or of none, stand in order of their text and are spread by it if they are many.
An empty table gives an empty result. Columns other than the key and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SPAN = 48
SECTION = r"(?s).+?(?:\n[ \t\r]*\n\s*|\z)"
#: The first HEAD characters of a paragraph have spans of HEAD_SPAN, so that short texts have enough of them to be compared.
HEAD, HEAD_SPAN = 60, 12
SPANS, HEAD_SPANS = (rf"[^.!?]{{1,{n}}}[.!?]*\s*|[.!?]+\s*" for n in (SPAN, HEAD_SPAN))
#: Most buckets that the key range is cut into; each costs one boundary value on the driver.
MOST_BUCKETS = 65_536


def _sha(x: Column) -> Column:
    return F.sha2(x, 256)


def _sha_of(digests: Column) -> Column:
    return _sha(F.array_join(digests, ""))


def _tree(text: Column) -> Column:
    """array<section struct<digest d, array p<paragraph struct<digest d, spans x (8 hex digits of each leaf)>>>>"""
    cut = lambda p, pattern: F.transform(F.regexp_extract_all(p, F.lit(pattern), F.lit(0)), _sha)
    leaves = lambda p: F.concat(cut(F.left(p, F.lit(HEAD)), HEAD_SPANS), cut(F.substring(p, F.lit(HEAD + 1), F.length(p)), SPANS))
    sections = F.when(text == "", F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(SECTION), F.lit(0)))
    paragraph = lambda x: F.struct(_sha_of(x).alias("d"), F.array_join(F.transform(x, lambda y: F.left(y, F.lit(8))), "").alias("x"))
    digested = F.transform(F.transform(sections, lambda s: F.transform(F.split(s, "\n"), leaves)), lambda s: F.transform(s, paragraph))
    return F.transform(digested, lambda s: F.struct(_sha_of(F.transform(s, lambda p: p["d"])).alias("d"), s.alias("p")))


def _root(tree: Column) -> Column:
    return _sha_of(F.transform(tree, lambda s: s["d"]))


def _said(tree: Column) -> Column:
    paragraph = lambda p: F.concat(F.substring(p["d"], 1, 16), F.lit("."), p["x"])
    return F.concat(_root(tree), F.lit("/"), F.array_join(F.transform(tree, lambda s: F.array_join(F.transform(s["p"], paragraph), ",")), ";"))


def _n_leaves(parts: Column) -> Column:
    """Leaves of branches as the fingerprint has them: 17 characters stand before the leaves of a paragraph, one between paragraphs."""
    one = lambda s: F.length(s) - 18 * F.size(F.split(s, ",")) + 1
    return F.floor(F.aggregate(parts, F.lit(0), lambda n, s: n + one(s).cast("int")) / 8)


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with the likeness of its fingerprint columns a and b."""
    body = lambda c: F.substring_index(F.col(c), "/", -1)
    finer = {"s": lambda x: F.split(x, ";"), "p": lambda x: F.flatten(F.transform(x, lambda s: F.split(s, ","))), "x": lambda x: F.flatten(F.transform(x, lambda p: F.regexp_extract_all(F.substring_index(p, ".", -1), F.lit(".{8}"), F.lit(0))))}
    d = df.withColumn("__a", body(a)).withColumn("__b", body(b)).withColumn("__m", F.lit(0).cast("long"))
    for level, cut in finer.items():
        d = d.withColumn("__a", cut(F.col("__a"))).withColumn("__b", cut(F.col("__b")))
        both = F.array_intersect("__a", "__b")
        d = d.withColumn("__m", F.col("__m") + (F.size(both) if level == "x" else _n_leaves(both)))
        d = d.withColumn("__c", F.array_except("__a", "__b")).withColumn("__b", F.array_except("__b", "__a")).withColumn("__a", F.col("__c"))
    n = 2 * F.col("__m") + F.size("__a") + F.size("__b")
    return d.withColumn(out, F.when(n > 0, 2.0 * F.col("__m") / n).otherwise((F.col(a) == F.col(b)).cast("double"))).drop("__a", "__b", "__c", "__m")


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of its text column."""
    return df.withColumn("__tree", _tree(F.coalesce(F.col(text), F.lit("")))).withColumn(out, _said(F.col("__tree"))).drop("__tree")


def differing(a: str, b: str) -> Column:
    """Of two fingerprint columns: the places [section, paragraph], from 0, at which paragraphs of a and b differ; empty if the roots are equal."""
    part = lambda c: F.split(F.substring_index(F.col(c), "/", -1), ";")
    both = lambda x, y, f: F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1), f))
    places = both(part(a), part(b), lambda i: _differ_in(i, F.get(part(a), i), F.get(part(b), i)))
    return F.when(F.substring_index(F.col(a), "/", 1) == F.substring_index(F.col(b), "/", 1), F.array().cast("array<array<int>>")).otherwise(places)


def _differ_in(i: Column, s: Column, t: Column) -> Column:
    x, y = F.split(F.coalesce(s, F.lit("")), ","), F.split(F.coalesce(t, F.lit("")), ",")
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1), lambda j: ~F.get(x, j).eqNullSafe(F.get(y, j)))
    return F.transform(at, lambda j: F.array(i, j))


#: Above the place of any row, in an edge that is above all rows of its key.
ANY = 1


def _place(key: Column, text: Column) -> tuple[Column, Column]:
    """Two numbers by which rows stand in ascending order: the key, and, the other way round, the first six bytes of the text; null keys are below all others."""
    q = -F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("long")
    return F.coalesce(key, F.lit(-(1 << 63))), F.when(key.isNull(), q - (1 << 49)).otherwise(q)


def _edges(df: DataFrame, k: Column, q: Column, n: int) -> list[tuple[int, int]]:
    """At most 2 n ascending edges, each the place of a range's top row, the last one of all rows. Where a key is frequent, its rows are cut by the second number."""
    at, exactness = [i / n for i in range(1, n)], F.lit(max(10_000, 10 * n))
    count = Counter(df.agg(F.percentile_approx(k, at, exactness)).first()[0] or [])
    edges, hot = {(e, ANY) for e in count}, [e for e, c in count.items() if c > 1]
    for r in df.filter(k.isin(hot)).groupBy(k.alias("k")).agg(F.percentile_approx(q, at, exactness).alias("at")).collect() if hot else ():  # fewer than n rows
        edges |= {(r.k, r["at"][i * (n - 1) // count[r.k]]) for i in range(1, count[r.k])}
    # Quantiles are exact to 53 bits only, so each range's top is looked up.
    tops = df.groupBy(_bucket(k, q, sorted(edges))).agg(F.max(F.struct(k.alias("k"), (q if hot else F.lit(ANY)).alias("q"))).alias("t")).collect()
    return sorted((r.t.k, r.t.q) for r in tops)


def _listed(numbers: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _bucket(k: Column, q: Column, edges: list[tuple[int, int]]) -> Column:
    """How many edges are below the place, by binary search."""
    if not edges:
        return F.lit(0).cast("int")
    ks, qs = (_listed([e[i] for e in edges]) for i in (0, 1))
    below = lambda i: (F.get(ks, i) < k) | ((F.get(ks, i) == k) & (F.get(qs, i) < q))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(edges).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(edges)) & below(at + step - 1), at + step).otherwise(at))


def with_next(df: DataFrame, key: str, text: str, value: str, out: str) -> DataFrame:
    """Adds `out`: the value of the next row in descending order of the key, for the last one that of the first.

    Rows are cut into ranges at quantiles, which are places of rows; the row at a range's top also goes, as a ghost,
    to the range above, and the topmost one to the lowest range. So no task sees more than a range, and rows move once.
    Null keys come last; equal keys stand in order of their text, and are cut by its beginning if they are many.
    """
    n = min(MOST_BUCKETS, 8 * common.tasks(df.sparkSession))
    k, q = _place(F.col(key).cast("long"), F.col(text))
    edges = _edges(df, k, q, n)
    top = edges.pop() if edges else None
    k, q = F.col("__k"), F.col("__q")
    df = df.withColumn("__k", _place(F.col(key).cast("long"), F.col(text))[0]).withColumn("__q", _place(F.col(key).cast("long"), F.col(text))[1])
    df = df.withColumn("__b", _bucket(k, q, edges))
    at = lambda i: F.get(_listed([e[i] for e in edges] or [0]), F.col("__b"))
    is_edge = (at(0) == k) & ((at(1) == ANY) | (at(1) == q)) if edges else F.lit(False)
    is_top = (k == top[0]) & ((F.lit(top[1]) == ANY) | (q == top[1])) if top else F.lit(False)
    to = F.concat(
        F.array(F.struct(F.col("__b").alias("b"), F.lit(0).alias("g"))),
        F.when(F.coalesce(is_edge, F.lit(False)), F.array(F.struct((F.col("__b") + 1).alias("b"), F.lit(1).alias("g")))).otherwise(F.array()),
        F.when(is_top, F.array(F.struct(F.lit(0).alias("b"), F.lit(2).alias("g")))).otherwise(F.array()),
    )
    w = Window.partitionBy("__at.b").orderBy(F.col("__at.g"), F.col(key).cast("long").desc_nulls_last(), F.col(text))
    return df.withColumn("__at", F.explode(to)).withColumn(out, F.lead(value).over(w)).filter("__at.g = 0").drop("__at", "__k", "__q", "__b")


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text (see the query's contract), with both likenesses."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("tree", _tree(F.col("t")))
    d = d.select("doc_id", F.struct("t", _said(F.col("tree")).alias("f")).alias("own"))
    d = with_next(d, "doc_id", "own.t", "own", "nxt")
    n = F.length("own.t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("own.t"), F.lit(1), n - half), F.substring(F.col("nxt.t"), F.lit(1), half))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), F.col("own.f").alias("fingerprint"), F.col("nxt.f").alias("nf"), edited.alias("e"))
    d = d.withColumn("etree", _tree(F.col("e")))
    d = d.select("doc_id", "n_chars", _sha(F.col("e")).alias("edited_sha256"), "fingerprint", _said(F.col("etree")).alias("edited_fingerprint"), "nf")
    d = with_likeness(with_likeness(d, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "nf", "near_next")
    return d.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(common.table(spark, sf_dir, "documents"))
