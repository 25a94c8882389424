"""Derived dimensions of samples and blocks: ladders of conditions, the first that holds decides."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from . import text as X

# Names of pools, base scores of reasons, and lengths.
EMPTY_POOLS = ("empty_clear", "empty_boundary", "chrome_empty", "special_empty")
SHORT_REAL = 80
REASON_BASE = {"real": 1.00, "multi_frag": 0.90, "semantic_group": 0.70, "repeat_risk": 0.60, "long_block": 0.50}
OCCUPANCY = (0.25, 0.70)
GRAM, GRAM_KINDS, GRAM_TIMES = 24, 3, 3
REPEATED = r"(?s)(.{8,80}?)\1{4,}"


def bucket_for_block(markdown: Column, tag: Column) -> Column:
    t, md = F.lower(F.coalesce(tag, F.lit(""))), X.strip(F.coalesce(markdown, F.lit("")))
    has = lambda s: F.contains(md, F.lit(s))
    return (
        F.when(md == "", "empty")
        .when(t.isin("table", "td", "th") | F.contains(F.lower(md), F.lit("<table")), "table")
        .when(has("$") | has("\\frac") | has("\\sum"), "formula")
        .when(F.startswith(md, F.lit("```")) | t.isin("pre", "code"), "code")
        .when(F.startswith(md, F.lit("#")), "heading")
        .when(F.length(md) < 40, "short")
        .when(F.length(md) > 800, "long")
        .otherwise("paragraph")
    )


def label_reason(markdown: Column, tag: Column) -> Column:
    """ok, or why a block's label must not be trained on."""
    md = X.strip(F.coalesce(markdown, F.lit("")))
    count = lambda s: F.regexp_count(md, F.lit(s))
    return (
        F.when(bucket_for_block(markdown, tag) == "empty", "empty_label")
        .when(md.rlike(REPEATED), "repetition")
        .when(F.contains(md, F.lit("�")), "replacement_char")
        .when((count("<") > 20) & (count("<") != count(">")), "broken_html")
        .otherwise("ok")
    )


def pair_reason(other: Column, gt: Column, least: float = 0.35) -> Column:
    sim = X.edit_similarity(other, gt)
    return F.when(X.is_blank(gt), "empty_gt").when(sim < least, F.concat(F.lit("low_consistency:"), F.format_string("%.2f", sim))).otherwise("ok")


def content_kind(kind: Column, tag: Column, markdown: Column, latex: Column, html: Column | None = None) -> Column:
    """Of a block: the kind that it is given, else by its tag, its fences and its formula; html is its own source, where known."""
    k, t, md = F.lower(X.strip(F.coalesce(kind, F.lit("")))), F.lower(F.coalesce(tag, F.lit(""))), X.strip(F.coalesce(markdown, F.lit("")))
    own = F.lower(F.coalesce(F.lit("") if html is None else html, F.lit("")))
    has = lambda c, *marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(c, m))
    marked = has(F.left(md, F.lit(80)), "$") & has(md, "\\", "sum", "frac")  # reads like a formula, in an element that says it is one
    return (
        F.when(k.isin("formula", "code", "image", "chart", "table"), k)
        .when(t == "table", "table")
        .when(t.isin("pre", "code") | F.startswith(md, F.lit("```")), "code")
        .when(t == "img", "image")
        .when((F.coalesce(latex, F.lit("")) != "") | (marked & t.isin("div", "span") & has(own, "latex", "formula")), "formula")
        .otherwise("text")
    )


def content_target(kind: Column, markdown: Column, html: Column) -> Column:
    return F.when(kind.isin("image", "chart"), "").when((kind == "table") & (F.coalesce(html, F.lit("")) != ""), html).otherwise(F.coalesce(markdown, F.lit("")))


def scene(pool: Column, target: Column, negative: Column, n_fragments: Column, n_boxes: Column) -> Column:
    """The hard scene of a sample, or null."""
    n = F.length(X.strip(F.coalesce(target, F.lit(""))))
    return (
        F.when(F.coalesce(negative, F.lit(False)) | (n == 0) | pool.isin(*EMPTY_POOLS), "empty")
        .when((pool == "multi_frag") | (X.or_default(n_fragments, 1, 0) > 1) | (F.coalesce(n_boxes, F.lit(0)) > 1), "multi_frag")
        .when(pool == "semantic_group", "semantic_group")
        .when((pool == "real_labeled") & (n < SHORT_REAL), "semantic_group")
    )


def val_slice(tagged: Column, found: Column, target: Column) -> Column:
    return F.when(tagged.isin("empty", "multi_frag", "semantic_group", "regular"), tagged).otherwise(F.coalesce(found, F.when(~X.is_blank(target), "regular")))


def repeat_risk_light(target: Column) -> Column:
    """Repeated lines, notes, or many bars: the part of repeat risk that needs no n-grams."""
    md = X.strip(target)
    lines = F.filter(F.transform(F.split(md, r"\r?\n"), lambda x: X.strip(x)), lambda x: x != "")
    return F.contains(md, F.lit("♫")) | (F.size(lines) != F.size(F.array_distinct(lines))) | (F.regexp_count(md, F.lit(r"\|")) >= 6)


#: Odd factors that join hashes of neighbouring windows.
_JOIN = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _gram_hashes(text: str) -> np.ndarray:
    """A hash of each window of GRAM characters: those of 2, 4, 8 and 16 by halves, then 16 and 8 together."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    eight = h
    for k, factor in zip((1, 2, 4, 8), _JOIN, strict=False):
        eight, h = (h if k == 8 else eight), h[:-k] * factor + h[k:]
    return h[: len(h) - 8] * _JOIN[4] + eight[16:]


def has_repeated_gram(text: str) -> bool:
    """Does a gram of GRAM characters with GRAM_KINDS different ones besides space and tab come GRAM_TIMES times? The last window is left out, as in the reference."""
    n = len(text) - GRAM
    if n < GRAM_TIMES:
        return False
    h = _gram_hashes(text)[:n]
    order = np.sort(h)
    often = order[GRAM_TIMES - 1 :][order[GRAM_TIMES - 1 :] == order[: 1 - GRAM_TIMES]]
    if not len(often):
        return False
    seen: Counter = Counter()
    for i in np.flatnonzero(np.isin(h, often)).tolist():  # equal grams have equal hashes; the grams themselves decide
        g = text[i : i + GRAM]
        seen[g] += 1
        if seen[g] == GRAM_TIMES and len({*g} - {" ", "\t"}) >= GRAM_KINDS:
            return True
    return False


@pandas_udf(T.BooleanType())
def _repeated_gram(text: pd.Series) -> pd.Series:
    return pd.Series([x is not None and has_repeated_gram(x) for x in text], dtype=bool)


def repeat_risk(target: Column) -> Column:
    """Repeated lines, notes, many bars, or a passage repeated within lines, of the whole text."""
    light = F.coalesce(repeat_risk_light(target), F.lit(False))
    return light | _repeated_gram(F.when(~light, X.strip(target)))


def reason(pool: Column, target: Column, n_fragments: Column, n_boxes: Column, risk: Column, long_from: Column) -> Column:
    """Why a sample is a candidate, or null."""
    n = F.length(X.strip(F.coalesce(target, F.lit(""))))
    return (
        F.when(n == 0, None)
        .when(pool == "real_labeled", "real")
        .when((pool == "multi_frag") | (X.or_default(n_fragments, 1, 0) > 1) | (F.coalesce(n_boxes, F.lit(0)) > 1), "multi_frag")
        .when(pool == "semantic_group", "semantic_group")
        .when((pool == "core_inner") & risk, "repeat_risk")
        .when((pool == "core_inner") & (n >= long_from), "long_block")
    )


def hard_score(why: Column, target: Column, n_fragments: Column, chrome: Column, tertile: Column) -> Column:
    base = F.coalesce(F.create_map(*[x for k, v in REASON_BASE.items() for x in (F.lit(k), F.lit(v))])[why], F.lit(0.4))
    fragments = 0.10 * F.greatest(F.lit(0), X.or_default(n_fragments, 1, 0) - 1)
    length = 0.15 * F.least(F.lit(1.0), F.length(X.strip(target)) / 800.0)
    return F.bround(base + fragments + length + F.when(chrome_bucket(chrome) == "chrome", 0.15).otherwise(0.0) + F.when(tertile == 0, 0.10).otherwise(0.0), 4)


def chrome_bucket(family: Column) -> Column:
    return F.when(F.lower(F.trim(F.coalesce(family, F.lit("none")))).isin("", "none"), "none").otherwise("chrome")


def tertile(v: Column, low: Column, high: Column) -> Column:
    return F.when(v <= low, 0).when(v <= high, 1).otherwise(2)


def length_bucket(en: Column, domain: Column) -> Column:
    """The content bucket of a line by its length; null if too short or too long."""
    n = F.length(en)
    return (
        F.when(n < 2, None)
        .when(n <= 14, "cells")
        .when(F.startswith(domain, F.lit("spec_software")) & n.between(12, 90), "code_lines")
        .when(n <= 42, "headings")
        .when(n <= 52, "captions")
        .when(n <= 110, "list_items")
        .when(n <= 520, "paragraphs")
    )


def ok_pair(en: Column, zh: Column) -> Column:
    n, m = F.length(en), F.length(zh)
    low = F.lower(en)
    braces = F.regexp_count(en, F.lit(r"[{}]"))
    ok = n.between(2, 520) & m.between(2, 700) & X.looks_en(en) & X.looks_zh(zh) & (m / F.greatest(n, F.lit(1))).between(0.28, 2.6)
    return F.coalesce(ok & (low != F.lower(zh)) & ~F.contains(low, F.lit("http://")) & ~F.contains(low, F.lit("https://")) & (braces <= 4), F.lit(False))


def occupancy_ok(v: Column) -> Column:
    """Unknown occupancy passes."""
    return v.isNull() | v.between(*OCCUPANCY)


def output_category(pred: Column) -> Column:
    """What a model said where it should have said nothing."""
    p = X.parse_target(pred)
    return F.when(X.is_blank(pred), "empty").when(p["empty_shell"], "empty_xml_shell").when(p["truncated"], "trunc_source").when(~p["has_source"] & ~p["has_translation"], "plain_text").otherwise("leak_xml")


def doc_type(page_id: Column) -> Column:
    x = F.split(F.coalesce(page_id, F.lit("")), "__")[0]
    return F.when(x == "", "unknown").otherwise(x)


def template_stem(stem: Column, page_id: Column, sample_id: Column) -> Column:
    part = lambda c: F.nullif(F.get(F.split(c, "__"), F.lit(1)), F.lit(""))
    return F.coalesce(F.nullif(F.regexp_replace(stem, r"\.html$", ""), F.lit("")), part(page_id), part(sample_id), F.lit("unknown"))


# Marks of page furniture in an answer, and stems of desktop templates.
FURNITURE = ("arxiv q search", "search submit donate", "free distribution service and an open-access", "this website uses cookies", "a 322 languages", "322 languages", "donate create account", "subject search and browse")
DESKTOP = ("21_desktop_", "22_desktop_", "23_ide_")


def slot_bucket(tag: Column, block_id: Column, n: Column) -> Column:
    """The content bucket that fills a template's slot."""
    t, b = F.lower(F.coalesce(tag, F.lit(""))), F.lower(F.coalesce(block_id, F.lit("")))
    begins = lambda *s: b.rlike("^(?:" + "|".join(s) + ")")
    return (
        F.when(t.isin("h1", "h2", "h3", "h4") | begins("h1", "h2", "h3", "title", "side_h"), "headings")
        .when(t.isin("td", "th") | F.contains(b, F.lit("cell")) | (begins("c", "r") & (n < 12)), "cells")
        .when(t.isin("code", "pre") | F.contains(b, F.lit("code")) | begins("cmd"), "code_lines")
        .when((t == "li") | begins("li", "side_", "nav"), F.when(n < 80, "list_items").otherwise("paragraphs"))
        .when(t.isin("span", "small") | F.contains(b, F.lit("meta")) | F.contains(b, F.lit("caption")) | (n < 40), "captions")
        .otherwise("paragraphs")
    )


def is_furniture(pred: Column, needles: tuple[str, ...] = FURNITURE) -> Column:
    p = X.normalize_text(F.coalesce(pred, F.lit("")))
    return F.exists(F.array(*map(F.lit, needles)), lambda s: F.contains(p, s))


def within_target(pred: Column, gt: Column, least: int = 12) -> Column:
    p, g = X.normalize_text(F.coalesce(pred, F.lit(""))), X.normalize_text(F.coalesce(gt, F.lit("")))
    return (F.length(p) >= least) & F.contains(g, p)


def skipped_slot(kind: Column, latex: Column) -> Column:
    """Slots that are not filled with text."""
    return kind.isin("formula", "image", "chart") | (F.coalesce(latex, F.lit("")) != "")


def is_real(pool: Column) -> Column:
    return F.coalesce(pool == "real_labeled", F.lit(False))


def is_desktop_shell(stem: Column) -> Column:
    return F.coalesce(stem.rlike("^(?:" + "|".join(DESKTOP) + ")"), F.lit(False))


def mostly_cjk(c: Column) -> Column:
    cjk = F.regexp_count(c, F.lit(X.CJK))
    return cjk >= F.greatest(F.lit(2), F.regexp_count(c, F.lit(X.LATIN)))


def explicit_group(c: Column) -> Column:
    """Null for what stands for no group."""
    x = X.strip(c)
    return F.when(~x.isin("", "null", "None"), x)


def is_manual(flag: Column, text: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | ~X.is_blank(text)


def is_special_block(kind: Column, markdown: Column, tag: Column) -> Column:
    return kind.isin("table", "image", "chart") | (bucket_for_block(markdown, tag) == "table")


def quadrant_color(x_pct: Column, y_pct: Column, bottom_origin: bool, colors: tuple[str, str, str, str]) -> Column:
    """Colors of top left, top right, bottom left, bottom right; y counts from the bottom in the second convention."""
    y = 100.0 - y_pct if bottom_origin else y_pct
    a, b, c, d = colors
    return F.when(y < 50, F.when(x_pct < 50, a).otherwise(b)).otherwise(F.when(x_pct < 50, c).otherwise(d))


def convention(answers: Column, under_top: Column, under_bottom: Column) -> Column:
    """Aggregate: which of two conventions explains more of the answers."""
    a, b = F.count_if(answers == under_top), F.count_if(answers == under_bottom)
    return F.when(a > b, "top").when(b > a, "bottom").otherwise("undecided")


def area_fraction(explicit: Column, scale: Column, drawn: Column, base: float = 0.005) -> Column:
    """The explicit share, else that of the older scale, else the draw."""
    return F.coalesce(explicit, F.when(scale.isNotNull(), base * F.greatest(F.lit(0.05), scale)), drawn)


def polymorphic_text(column: str) -> Column:
    """Of JSON text that is a string, an object with text or content, or an array of such: the texts joined."""
    j = F.col(column)
    items = F.from_json(j, "array<struct<text: string, content: string>>")
    one = F.from_json(j, "struct<text: string, content: string>")
    return (
        F.when(F.startswith(F.ltrim(j), F.lit("[")), F.array_join(F.transform(items, lambda x: F.coalesce(x["text"], x["content"], F.lit(""))), ""))
        .when(F.startswith(F.ltrim(j), F.lit("{")), F.coalesce(one["text"], one["content"], F.lit("")))
        .otherwise(F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), j, F.lit("}")), "$.v"), j))
    )
