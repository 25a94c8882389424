"""HTML pages: blocks, groups, tables and Markdown, as table functions over whole pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

# Elements that are blocks of text, that never close, and whose text is not shown.
BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "pre", "blockquote", "figcaption", "caption", "dt", "dd")
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
HIDDEN = frozenset(("script", "style", "head", "noscript", "template"))


class _Blocks(HTMLParser):
    """Blocks in document order: those with data-block-id where a page has any, else the elements in BLOCKS."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.out: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.handle_data("\n")
        if tag in VOID:
            return
        a = dict(attrs)
        if tag in ("p", "li", "td", "th", "dt", "dd") and self.stack and self.stack[-1]["tag"] == tag:
            self._pop()
        top = {"tag": tag, "id": a.get("data-block-id"), "group": a.get("data-semantic-group"), "translation": a.get("data-mt-zh") or a.get("data-translation"), "latex": a.get("data-latex"), "domain": a.get("data-mt-domain"), "text": [], "pos": -1}
        if top["id"] is not None or tag in BLOCKS:
            top["pos"] = len(self.out)
            self.out.append(top)
        self.stack.append(top)

    def handle_endtag(self, tag: str) -> None:
        if any(x["tag"] == tag for x in self.stack):
            while self._pop() != tag:
                pass

    def _pop(self) -> str:
        return self.stack.pop()["tag"]

    def handle_data(self, data: str) -> None:
        if any(x["tag"] in HIDDEN for x in self.stack):
            return
        for x in reversed(self.stack):
            if x["pos"] >= 0:
                x["text"].append(data)
                return


def _markdown(tag: str, text: str, latex: str | None = None) -> str:
    if latex:
        return f"$${latex}$$" if "\n" in latex or len(latex) > 40 else f"${latex}$"
    text = text.strip("\n") if tag == "pre" else " ".join(text.split())
    if not text:
        return ""
    if tag[0] == "h" and tag[1:].isdigit():
        return "#" * int(tag[1:]) + " " + text
    return {"li": f"- {text}", "pre": f"```\n{text}\n```", "blockquote": f"> {text}"}.get(tag, text)


def blocks_of(html: str | None) -> list[dict]:
    p = _Blocks()
    p.feed(html or "")
    p.close()
    named = [x for x in p.out if x["id"] is not None]
    return [{"pos": i, "id": x["id"] or f"b{i}", "tag": x["tag"], "markdown": _markdown(x["tag"], "".join(x["text"]), x["latex"]), "translation": x["translation"], "domain": x["domain"]} for i, x in enumerate(named or p.out)]


BLOCK_ROWS = "page_id long, pos int, id string, tag string, markdown string, translation string, domain string"


def blocks(pages: DataFrame) -> DataFrame:
    """A row for each block of pages (page_id, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"page_id": k, **b} for k, h in zip(pdf["page_id"], pdf["html"], strict=True) for b in blocks_of(h)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCK_ROWS.split(", ")])

    return pages.select("page_id", "html").mapInPandas(run, BLOCK_ROWS)


class _Tables(HTMLParser):
    """Tables as compact HTML: no classes, styles, ids, roles or data attributes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.depth, self.held, self.out = 0, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag == "table"
        if self.depth:
            kept = "".join(f' {k}="{v or ""}"' for k, v in attrs if k not in ("class", "style", "id", "role") and not k.startswith("data-"))
            self.held.append(f"<{tag}{kept}>")

    def handle_endtag(self, tag: str) -> None:
        if not self.depth:
            return
        self.held.append(f"</{tag}>")
        if tag == "table":
            self.depth -= 1
            if not self.depth:
                self.out.append(" ".join("".join(self.held).split()).replace("> <", "><"))
                self.held = []

    def handle_data(self, data: str) -> None:
        if self.depth:
            self.held.append(data)

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name};")


@pandas_udf(T.ArrayType(T.StringType()))
def tables(html: pd.Series) -> pd.Series:
    out = []
    for h in html:
        p = _Tables()
        p.feed(h or "")
        p.close()
        out.append(p.out)
    return pd.Series(out)


def with_targets(found: DataFrame) -> DataFrame:
    """Blocks with their bucket and whether their label may be trained on."""
    from ..functions import classify as C

    return found.withColumn("bucket", C.bucket_for_block(F.col("markdown"), F.col("tag"))).withColumn("reason", C.label_reason(F.col("markdown"), F.col("tag")))


class _Groups(HTMLParser):
    """Semantic groups: sections with data-semantic-group, and the blocks that are theirs and not those of a group within."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.out: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        a = dict(attrs)
        top = {"tag": tag, "group": None, "member": None, "kind": "kind" in (a.get("class") or "").split()}
        if a.get("data-semantic-group") is not None:
            top["group"] = {"group_id": a["data-semantic-group"], "kind": a.get("data-group-kind") or "", "members": []}
            self.out.append(top["group"])
        own = next((x["group"] for x in reversed(self.stack) if x["group"]), None)
        if own is not None and a.get("data-block-id") is not None:
            top["member"] = {"id": a["data-block-id"], "role": a.get("data-group-role") or "", "tag": tag, "text": []}
            own["members"].append(top["member"])
        self.stack.append(top)

    def handle_endtag(self, tag: str) -> None:
        if any(x["tag"] == tag for x in self.stack):
            while self.stack.pop()["tag"] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if any(x["kind"] or x["tag"] in HIDDEN for x in self.stack):
            return
        for x in reversed(self.stack):
            if x["member"] is not None:
                x["member"]["text"].append(data)
                return


GROUP_ROWS = "page_id long, group_id string, kind string, pos int, block_id string, role string, markdown string"


def groups_of(html: str | None) -> list[dict]:
    p = _Groups()
    p.feed(html or "")
    p.close()
    return [{"group_id": g["group_id"], "kind": g["kind"], "pos": i, "block_id": m["id"], "role": m["role"], "markdown": _markdown(m["tag"], "".join(m["text"]))} for g in p.out for i, m in enumerate(g["members"])]


def groups(pages: DataFrame) -> DataFrame:
    """A row for each member of each group of pages (page_id, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"page_id": k, **g} for k, h in zip(pdf["page_id"], pdf["html"], strict=True) for g in groups_of(h)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in GROUP_ROWS.split(", ")])

    return pages.select("page_id", "html").mapInPandas(run, GROUP_ROWS)


def group_texts(members: DataFrame) -> DataFrame:
    """A group's texts in order, its member ids, and those of its seeds."""
    in_order = F.array_sort(F.collect_list(F.struct("pos", "block_id", "role", "markdown")))
    g = members.groupBy("page_id", "group_id").agg(F.first("kind").alias("kind"), in_order.alias("m"))
    texts = F.filter(F.transform("m", lambda x: x["markdown"]), lambda t: F.trim(t) != "")
    ids = lambda kept: F.transform(kept, lambda x: x["block_id"])
    return g.select("page_id", "group_id", "kind", ids(F.col("m")).alias("member_ids"), ids(F.filter("m", lambda x: x["role"] == "seed")).alias("seed_ids"), F.array_join(texts, "\n\n").alias("markdown"))


def unit_targets(found: DataFrame, group_rows: DataFrame) -> DataFrame:
    """Blocks with the text that stands for them: their group's, else their own. Of two groups with a block the later wins."""
    of = group_rows.select("page_id", F.explode("member_ids").alias("id"), "group_id", F.col("markdown").alias("group_markdown"))
    of = of.groupBy("page_id", "id").agg(F.max("group_id").alias("group_id"), F.max_by("group_markdown", "group_id").alias("group_markdown"))
    return found.join(of, ["page_id", "id"], "left").withColumn("unit_text", F.coalesce("group_markdown", "markdown")).drop("group_markdown")


class _Enclosing(_Tables):
    """For each block id within a table, that table."""

    def __init__(self) -> None:
        super().__init__()
        self.ids: list[str] = []
        self.found: dict[str, str] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        super().handle_starttag(tag, attrs)
        block = dict(attrs).get("data-block-id")
        if self.depth and block is not None:
            self.ids.append(block)

    def handle_endtag(self, tag: str) -> None:
        n = len(self.out)
        super().handle_endtag(tag)
        if len(self.out) > n:
            self.found |= {k: self.out[-1] for k in self.ids if k not in self.found}
            self.ids = []


def enclosing_tables(pages: DataFrame) -> DataFrame:
    """page_id, id, html: the outermost table around each block of pages (page_id, html) that is in one, or is one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, h in zip(pdf["page_id"], pdf["html"], strict=True):
                p = _Enclosing()
                p.feed(h or "")
                p.close()
                rows += [(k, b, t) for b, t in p.found.items()]
            yield pd.DataFrame(rows, columns=["page_id", "id", "html"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, id string, html string")


def trained_targets(found: DataFrame, tables_of: DataFrame, group_rows: DataFrame, kind: Column) -> DataFrame:
    """Blocks with kind and target: the table around them, else their group's text, else by kind (none of images and charts)."""
    from ..functions import classify as C

    d = unit_targets(found.withColumn("__kind", kind), group_rows).join(tables_of.select("page_id", "id", F.col("html").alias("__table")), ["page_id", "id"], "left")
    grouped = F.col("group_id").isNotNull() & (F.trim("unit_text") != "")
    d = d.withColumn("target", F.when(F.col("__table").isNotNull(), F.col("__table")).when(grouped, F.col("unit_text")).otherwise(C.content_target(F.col("__kind"), F.col("markdown"), F.lit(None).cast("string"))))
    return d.withColumn("kind", F.when(F.col("__table").isNotNull(), "table").when(grouped, "semantic_group").otherwise(F.col("__kind"))).drop("__kind", "__table", "unit_text")


@udtf(returnType="pos int, id string, tag string, markdown string, translation string, domain string")
class ParseBlocks:
    """parse_blocks(html): the blocks of a page."""

    def eval(self, html: str):
        for b in blocks_of(html):
            yield b["pos"], b["id"], b["tag"], b["markdown"], b["translation"], b["domain"]


@udtf(returnType="group_id string, kind string, pos int, block_id string, role string, markdown string")
class ParseGroups:
    """parse_groups(html): the members of a page's semantic groups."""

    def eval(self, html: str):
        for g in groups_of(html):
            yield g["group_id"], g["kind"], g["pos"], g["block_id"], g["role"], g["markdown"]


def register(spark) -> None:
    """Makes the table functions known to SQL: SELECT ... FROM pages, LATERAL parse_blocks(html)."""
    spark.udtf.register("parse_blocks", ParseBlocks)
    spark.udtf.register("parse_groups", ParseGroups)


def detected(df: DataFrame, w: Column, h: Column, pad: int = 2) -> DataFrame:
    """Detections (bbox array<double>) with the crop around them, in whole pixels and within the image; those without any are dropped."""
    b = [F.col("bbox")[i].cast("int") for i in range(4)]
    low, high = (lambda v: F.greatest(F.lit(0), v - pad)), (lambda v, n: F.least(n.cast("int"), v + pad))
    d = df.withColumn("crop", F.struct(low(b[0]).alias("x0"), low(b[1]).alias("y0"), high(b[2], w).alias("x1"), high(b[3], h).alias("y1")))
    return d.filter("crop.x1 > crop.x0 AND crop.y1 > crop.y0")


def dom_annotations(dom: DataFrame, source: DataFrame, scale: Column, least: float = 2.0) -> DataFrame:
    """DOM blocks (page_id, id, rect struct in CSS pixels, text) as annotations in image pixels, those under `least` dropped, with the source's Markdown and translation where it has them."""
    from ..functions import geometry as G

    r = F.col("rect")
    d = dom.withColumn("bbox", G.box(*(r[k] * scale for k in ("x0", "y0", "x1", "y1")))).filter((G.width(F.col("bbox")) >= least) & (G.height(F.col("bbox")) >= least))
    s = source.select("page_id", "id", F.col("markdown").alias("__md"), F.col("translation").alias("__tr"))
    return d.join(s, ["page_id", "id"], "left").withColumns({"markdown": F.coalesce(F.nullif("__md", F.lit("")), "text"), "translation": F.col("__tr")}).drop("__md", "__tr", "rect", "text")
