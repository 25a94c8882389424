"""Edits of HTML as text, and what can be read off it with patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import html_escape

# Style of each occupancy band (side margin, gap, font size), and delimiters of formulas.
BANDS = {"sparse": (96, 28, 18), "medium": (56, 18, 16), "dense": (24, 10, 14)}
MATH = ("$$", "\\(", "\\[", "data-latex")


def inserted_before(html: Column, mark: str, snippet: Column) -> Column:
    """The snippet before the first `mark` of any case, or at the end without one."""
    at = F.locate(mark.lower(), F.lower(html))
    return F.when(at > 0, F.concat(F.left(html, at - 1), snippet, F.substring(html, at, F.length(html)))).otherwise(F.concat(html, snippet))


def needs_math(html: Column) -> Column:
    out = F.contains(html, F.lit(MATH[0]))
    for m in MATH[1:]:
        out = out | F.contains(html, F.lit(m))
    return out


def with_math(html: Column, assets: str) -> Column:
    return F.when(needs_math(html), inserted_before(html, "</head>", F.lit(assets))).otherwise(html)


def with_occupancy(html: Column, band: Column) -> Column:
    """Style of the band in the head; an unknown band changes nothing."""
    css = {k: f"<style>body{{margin:0 {m}px;font-size:{s}px}}p,li{{margin:{g}px 0}}</style>" for k, (m, g, s) in BANDS.items()}
    snippet = F.create_map(*[x for k, v in css.items() for x in (F.lit(k), F.lit(v))])[band]
    return F.when(snippet.isNotNull(), inserted_before(html, "</head>", snippet)).otherwise(html)


def with_paragraphs(html: Column, texts: Column) -> Column:
    """Each text of the array as a paragraph at the body's end."""
    return inserted_before(html, "</body>", F.array_join(F.transform(texts, lambda x: F.concat(F.lit("<p>"), html_escape(x), F.lit("</p>"))), ""))


def with_filler(html: Column, texts: Column, heading: Column, more: Column, draw: Column, share: float = 0.7) -> Column:
    """A paragraph for each of the texts, and, where the draw is under the share, a heading and the first two of `more`, at the end of the article, else of the main part, else of the body."""
    p = lambda x, name: F.concat(F.lit(f'<p data-block-id="{name}'), F.lit('">'), html_escape(x), F.lit("</p>"))
    numbered = F.transform(texts, lambda x, i: F.concat(F.lit('<p data-block-id="extra_p'), i.cast("string"), F.lit('">'), html_escape(x), F.lit("</p>")))
    extra = F.when(draw < share, F.concat(F.lit('<h2 data-block-id="extra_h">'), html_escape(heading), F.lit("</h2>"), p(F.get(more, F.lit(0)), "extra_h_p0"), p(F.get(more, F.lit(1)), "extra_h_p1"))).otherwise("")
    snippet = F.concat(F.array_join(numbered, ""), extra)
    low = F.lower(html)
    out = F.when(F.size(texts) == 0, html)
    for end in ("</article>", "</main>"):
        out = out.when(F.contains(low, F.lit(end)), inserted_before(html, end, snippet))
    return out.otherwise(inserted_before(html, "</body>", snippet))


def framed(html: Column, shell: Column) -> Column:
    """The body within a window of the shell's name; unchanged for none."""
    none = F.lower(F.coalesce(shell, F.lit("none"))).isin("", "none")
    head = F.concat(F.lit('<div class="window" data-shell="'), html_escape(shell), F.lit('"><div class="bar"></div>'))
    start = F.regexp_replace(html, r"(?i)(<body[^>]*>)", "$1\u0001")
    return F.when(none | ~F.contains(start, F.lit("\u0001")), html).otherwise(inserted_before(F.replace(start, F.lit("\u0001"), head), "</body>", F.lit("</div>")))


def viewport(html: Column) -> Column:
    """struct(w, h, full_page) that a page asks for, parts null where it does not."""
    found = lambda i: F.regexp_extract(html, r"(?i)data-viewport\s*=\s*[\"'](\d+)x(\d+)[\"']", i).try_cast("int")
    capture = F.lower(F.regexp_extract(html, r"(?i)data-capture\s*=\s*[\"'](\w+)[\"']", 1))
    return F.struct(found(1).alias("w"), found(2).alias("h"), F.when(capture != "", capture == "full").alias("full_page"))


def canvas(html: Column) -> Column:
    """struct(background, color): the last of each in rules of body."""
    rules = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)(?:^|[}\s,>])body\s*\{([^}]*)\}"), F.lit(1)), ";")
    last = lambda name: F.nullif(F.trim(F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(rules, F.lit(rf"(?i)(?<![\w-]){name}\s*:\s*([^;]+)"), F.lit(1))), -1)), F.lit(""))
    return F.struct(F.coalesce(last("background"), last("background-color")).alias("background"), last("color").alias("color"))


def ink_rects(rects: Column, box: Column) -> Column:
    return F.when(F.size(rects) > 0, rects).otherwise(F.array(box))
