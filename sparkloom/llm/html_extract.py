"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. Words score above zero, tags below; what a tag costs is learned from labelled
pages, those that mark their own content by `article` or `main`: the rarer a tag is inside of content than outside of it,
the more it costs. A linear scan finds the contiguous region with the greatest sum. Parts that are no article wherever
they stand (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) keep their tags'
costs but their words score nothing, and they are left out of the region's text.

Text: character references are decoded, white space within a block becomes one space, blocks are trimmed and joined in
page order by one space; tags inside a line join without one.

Cases: null or empty html, or a page without words outside of such parts, gives an empty text and 0 characters. Elements
left open are closed where an element around them is, or at the end; a menu, header or advert left open ends where an
`article` or `main` begins. Repeated rows are extracted alike. Without labelled pages fixed costs are used. An empty table
gives an empty result. Pages are parsed as a whole, whatever their length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings

SAMPLE_PAGES = 400  # most labelled pages that costs are learned from
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "svg", "title", "noembed", "xmp"}
RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
OTHER = {"nav", "header", "footer", "aside", "form", "head", "button", "select", "menu", "dialog"}
CONTENT = {"article", "main"}
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|comments?|comment-\w+|disqus|cookies?|consent|notice|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|widget|skip)(?:$|[\s_-])",
    re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-hidden|hidden)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu"}
WORD = 1.0
DEFAULT_COSTS = {"p": -0.3, "br": -0.2, "b": -0.2, "i": -0.2, "em": -0.2, "strong": -0.2, "span": -0.3, "h1": -0.5, "h2": -0.5, "h3": -0.5}
UNSEEN = -3.0
SPACE = re.compile(r"[ \t\n\r\f\v]+")


def other_part(name: str, attributes: str) -> bool:
    """Whether an element is none of an article's text, by its name or what it calls itself."""
    if name in OTHER:
        return True
    if not attributes or name in CONTENT or name in ("body", "html"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id") and NAMED.search(value) or key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
    return False


def tokens(page: str):
    """(kind, value, left_out): kind is `text`, or `tag` with its name, a slash before closing ones."""
    at, n = 0, len(page)
    stack: list[str] = []
    out_from = -1  # depth of the outermost part that is left out
    lower = None
    while at < n:
        cut = page.find("<", at)
        if cut < 0:
            cut = n
        if cut > at:
            yield "text", page[at:cut], out_from >= 0
        if cut == n:
            return
        m = TOKEN.match(page, cut)
        if not m:
            yield "text", "<", out_from >= 0
            at = cut + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in stack:
                k = len(stack) - 1 - stack[::-1].index(name)
                del stack[k:]
                if out_from >= len(stack):
                    out_from = -1
            yield "tag", "/" + name, out_from >= 0
            continue
        if name in CONTENT and out_from >= 0:  # a part that was left open
            del stack[out_from:]
            out_from = -1
        yield "tag", name, out_from >= 0
        if name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else (n if name in ("script", "style", "title", "textarea") else at)
        elif name not in VOID and not m[3].rstrip().endswith("/"):
            if name == "p" and stack and stack[-1] == "p":
                stack.pop()
                if out_from >= len(stack):
                    out_from = -1
            stack.append(name)
            if out_from < 0 and other_part(name, m[3]):
                out_from = len(stack) - 1


def learn(pages: list[str | None]) -> dict[str, float]:
    """Costs of tags from pages that mark their content."""
    inside, outside = Counter(), Counter()
    words = [0, 0]
    for page in pages:
        depth, seen, held = 0, False, []
        for kind, value, left_out in tokens(page or ""):
            if kind == "tag" and value.lstrip("/") in CONTENT:
                depth += -1 if value[0] == "/" and depth else value[0] != "/"
                seen = True
                held.append((kind, value, False))
            else:
                held.append((kind, value, depth > 0 and not left_out))
        if seen:
            for kind, value, good in held:
                if kind == "text":
                    words[good] += len(value.split())
                else:
                    (inside if good else outside)[value.lstrip("/")] += 1
    if not inside and not outside:
        return dict(DEFAULT_COSTS)
    all_in, all_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    return {t: -0.1 - max(0.0, 2 * math.log((outside[t] + 0.5) / all_out / ((inside[t] + 0.5) / all_in))) for t in {*inside, *outside}}


def blocks_text(parts) -> str:
    return SPACE.sub(" ", html.unescape("".join(parts))).strip(" ")


def extract(page: str | None, costs: dict[str, float]) -> str:
    """The text of the best region of one page."""
    seq = list(tokens(page or ""))
    best, best_at, total, begin = 0.0, (0, 0), 0.0, 0
    for k, (kind, value, left_out) in enumerate(seq):
        if kind == "text":
            score = 0.0 if left_out else WORD * len(value.split())
        else:
            score = costs.get(value.lstrip("/"), UNSEEN)
        if total <= 0:
            total, begin = 0.0, k
        total += score
        if total > best:
            best, best_at = total, (begin, k + 1)
    out = []
    for kind, value, left_out in seq[slice(*best_at)]:
        if kind == "tag":
            if value.lstrip("/") not in INLINE:
                out.append("\n")
        elif not left_out:
            out.append(value)
    return blocks_text(out)


def visible_text(page: str | None) -> str:
    """All text that a page shows, for plain-text conversion."""
    return blocks_text([v if k == "text" else "" if v.lstrip("/") in INLINE else "\n" for k, v, _ in tokens(page or "")])


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Costs from at most sample_pages pages that mark their content, those whose number's digest comes first."""
    marked = pages.where(F.lower("html").rlike("<(article|main)[ >]") & F.col("page_id").isNotNull())
    ids = [r[0] for r in marked.select("page_id").distinct().orderBy(F.crc32(F.col("page_id").cast("string").cast("binary")), "page_id").limit(sample_pages).collect()]
    rows = marked.where(F.col("page_id").isin(ids)).select("page_id", "html").collect() if ids else []
    return learn([r["html"] for r in sorted(rows, key=lambda r: r["page_id"])[:sample_pages]])


def main_text(pages: DataFrame, costs: dict[str, float]) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [extract(p, costs) for p in strings(batch.column(2))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return main_text(pages, train(pages))
