"""Main text of HTML pages: markup blocks, and differencing against the page with the nearest URL.

Each page is cut into lines (block texts). Pages are ordered by host and path, a page is paired with the neighbour
whose path shares the longer start, and the lines both pages share along a longest common subsequence are template, not
text. Where a page marks its article, the mark decides and differencing is not needed to find it: shared lines inside it
(copied articles, common paragraphs) stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, written

TOKEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
#: What can follow the last > of a page: an unclosed comment, CDATA section, declaration or tag.
TAIL = re.compile(r"<!--.*|<!\[CDATA\[(.*)|<[!?].*|<[/a-zA-Z][^<]*\Z", re.DOTALL)
QUOTE_OR_END = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements by role.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NEVER = {"nav", "aside", "form", "button", "select", "template", "svg", "canvas", "audio", "video", "object", "dialog", "menu", "head", "math"}
EDGE = {"header", "footer"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
         "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend",
         "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
         "thead", "title", "tr", "ul"}
CLOSES_P = BLOCK - {"html", "body", "head", "title", "option", "optgroup", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar"}
TEMPLATE_WORDS = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
                  "cookie", "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
                  "notice", "pager", "pagination", "popup", "promo", "promotion", "related", "replies", "respond", "share", "sharing", "sidebar",
                  "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget"}
#: What else names of furniture are put together from, so that "share-buttons" is one and "share-price" is not.
PARTS = {"area", "bar", "block", "box", "button", "buttons", "container", "content", "form", "group", "icons", "inner", "item", "items", "label", "left",
         "link", "links", "list", "main", "outer", "panel", "right", "section", "slot", "thread", "title", "top", "unit", "wrap", "wrapper"}
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
TEMPLATE, NEUTRAL, CONTENT = 0, 1, 2


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(value.strip("\"'")))
    return found


def is_template(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element is furniture of the site by its name, role, class or id."""
    if tag in NEVER or (tag in EDGE and not inside):
        return True
    if not attrs:
        return False
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    if tag in ("body", "html", "article", "main"):
        return False
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    if inside:  # an article keeps its blocks unless a whole name says that they are none of its text
        named = [{w.lower() for w in WORD.findall(name)} for name in names.split()]
        return any(words & TEMPLATE_WORDS and words <= TEMPLATE_WORDS | PARTS for words in named)
    words = {w.lower() for w in WORD.findall(names)}
    return bool(words & TEMPLATE_WORDS) or "header" in words


def marks_article(tag: str, attrs: dict[str, str]) -> bool:
    return tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article") or attrs.get("itemprop") == "articleBody"


def tag_end(html: str, at: int, dead: set[int]) -> int:
    """Where the tag that is open at ``at`` ends, behind the first > outside quotes; -1 if there is none.

    ``dead`` keeps the quotes from which a search has run to the end of the page, so that none runs there twice.
    """
    passed = []
    while m := QUOTE_OR_END.search(html, at):
        if m.group() == ">":
            return m.end()
        if m.start() in dead:
            break
        passed.append(m.start())
        close = html.find(m.group(), m.end())
        if close < 0:
            break
        at = close + 1
    dead.update(passed)
    return -1


def page_lines(html: str | None) -> list[tuple[str, int]]:
    """(text, kind) of every block in page order, with references decoded and white space joined.

    The page is read once from front to back; a hostile page takes time in proportion to its length and depth.
    """
    html = html or ""
    lines: list[tuple[str, int]] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, template, article
    opened: Counter[str] = Counter()  # names on the stack
    dead: set[int] = set()
    at, end, last = 0, len(html), html.rfind(">")

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            template, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            lines.append((text, TEMPLATE if template else CONTENT if article else NEUTRAL))

    def close_from(i: int) -> None:
        opened.subtract(s[0] for s in stack[i:])
        del stack[i:]

    while at < end:
        m = (TOKEN if at <= last else TAIL).search(html, at)
        stop = m.start() if m else end
        if stop > at:
            buffer.append(unescape(html[at:stop]))
        if not m:
            break
        if at > last:
            buffer.append(m.group(1) or "")
            break
        at = m.end()
        if m.group(1):
            close = html.find("-->", at)
            at = close + 3 if close >= 0 else end
            continue
        if m.group(2):
            close = html.find("]]>", at)
            buffer.append(html[at:close if close >= 0 else end])
            at = close + 3 if close >= 0 else end
            continue
        close = html.find(">", at)
        if m.group(3) or close < 0:
            if close < 0 and not m.group(3) and html.find("<", at) >= 0:  # not a tag: its < is text
                buffer.append("<")
                at = m.start() + 1
            else:
                at = close + 1 if close >= 0 else end
            continue
        inner, at = at, tag_end(html, at, dead)
        if at < 0:  # its quotes do not close: what reaches to the next > is left out
            at = close + 1
            continue
        tag = m.group(5).lower()
        if tag == "br":
            buffer.append(" ")
            continue
        if m.group(4):
            if tag in BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1) if opened[tag] > 0 else ():
                if stack[i][0] == tag:
                    flush() if any(s[1] != stack[i][1] for s in stack[i:]) else None
                    close_from(i)
                    break
                if tag == "p" and stack[i][0] in ("article", "div", "section", "main", "td", "body"):
                    break
            continue
        inside = html[inner:at - 1]
        attrs = attributes(inside) if inside.strip(" /") else {}
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(html, at)
            at = close.end() if close else end
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P and opened["p"] > 0:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        close_from(i)
                        break
                    if stack[i][0] in BLOCK:
                        break
        if tag in VOID:
            continue
        if tag == "body":  # a head that was not closed ends here
            stack[:] = [s for s in stack if s[0] == "html"]
            opened = Counter(s[0] for s in stack)
        template, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        hides = template or is_template(tag, attrs, article)
        if hides and not template and tag not in BLOCK:
            flush()
        stack.append((tag, hides, article or marks_article(tag, attrs)))
        opened[tag] += 1
    flush()
    return lines


def common_positions(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b`` (shared ends first, then Hunt and Szymanski)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    where: dict[int, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple | None] = []
    for i in range(head, len(a) - tail):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


def shared_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def with_lines(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with ``host``, ``path`` and ``lines``, without the html."""
    @F.pandas_udf("array<struct<text:string,kind:int>>")
    def lines(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in series:
            yield pd.Series([[{"text": t, "kind": k} for t, k in page_lines(html)] for html in pages])

    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.select("page_id", "url",
                        F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)).alias("host"),
                        F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"), lines("html").alias("lines"))


def neighbours(rows: DataFrame) -> DataFrame:
    """(rid, hashes, before, after): each page with its neighbours in the order of host and path.

    The order is cut into ranges of rows, not hosts: lag and lead run inside a range, and the rows at the edges of
    ranges get theirs from the edges of the next ones.
    """
    spread = written(rows.repartitionByRange("host", "path", "rid").withColumn("range", F.spark_partition_id()), "page-order")
    mine = F.struct("host", "path", "rid", "hashes")
    inside = Window.partitionBy("range").orderBy("host", "path", "rid")
    edges = spread.groupBy("range").agg(F.min(mine).alias("first"), F.max(mine).alias("last"))
    over = Window.orderBy("range")
    edges = edges.select(F.col("range").alias("r"), F.lag("last").over(over).alias("previous"), F.lead("first").over(over).alias("next"))
    near = spread.withColumn("b", F.lag(mine).over(inside)).withColumn("a", F.lead(mine).over(inside)).join(edges, F.col("range") == F.col("r"))
    return near.select("host", "path", "rid", "hashes", F.coalesce("b", "previous").alias("before"), F.coalesce("a", "next").alias("after"))


def shared_lines(near: DataFrame) -> DataFrame:
    """(rid, shared): per line of a page whether it shares it with a neighbour of the same host.

    The neighbour with the nearer path is taken, unless it holds all lines of the page: it is a copy then and says
    nothing about which lines are the site's. If both neighbours do, the page shares nothing.
    """
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                same = [n for n in (row.before, row.after) if n is not None and n["host"] == row.host]
                own = list(row.hashes)
                for partner in sorted(same, key=lambda n: -shared_start(n["path"], row.path)):
                    found = common_positions(own, list(partner["hashes"]))
                    if len(found) < len(own):
                        flags = np.zeros(len(own), dtype=bool)
                        flags[found] = True
                        rows.append((row.rid, flags))
                        break
            yield pd.DataFrame(rows, columns=["rid", "shared"])

    return near.mapInPandas(compare, "rid long, shared array<boolean>")


def extract(pages: DataFrame) -> DataFrame:
    """Per row of (page_id, url, html): page_id, url, ``text`` and ``n_shared``, the template lines found by pairing.

    Null html is an empty page; a null or relative URL has the empty host. Repeated rows are extracted alike. A page
    that marks no article keeps the blocks that are not furniture and not shared with its pair; a host's only page has
    no pair, and pages of a host with the same lines are one page when pairs are sought. Other columns are ignored; an
    empty table gives no rows.
    """
    lined = with_lines(only(pages, "page_id", "url", "html"))
    light = lined.select("host", "path", F.transform("lines", lambda x: F.xxhash64(x["text"])).alias("hashes"))
    light = light.withColumn("rid", F.xxhash64("host", "hashes")).groupBy("host", "rid").agg(
        F.min("path").alias("path"), F.any_value("hashes").alias("hashes"))
    shared = shared_lines(neighbours(light)).withColumnRenamed("rid", "of")
    joined = lined.withColumn("rid", F.xxhash64("host", F.transform("lines", lambda x: F.xxhash64(x["text"])))).join(shared, F.col("rid") == F.col("of"), "left")
    marked = F.exists("lines", lambda x: x["kind"] == CONTENT)
    gone = F.coalesce("shared", F.array().cast("array<boolean>"))
    own = F.filter("lines", lambda x, i: (x["kind"] == NEUTRAL) & ~F.coalesce(F.get(gone, i), F.lit(False)))
    kept = F.when(marked, F.filter("lines", lambda x: x["kind"] == CONTENT)).otherwise(own)
    return joined.select("page_id", "url", F.array_join(F.transform(kept, lambda x: x["text"]), "\n").alias("text"),
                         F.size(F.filter(gone, lambda x: x)).cast("int").alias("n_shared"))
