"""Main-text extraction from web pages by two-pass block rules.

Pass 1 weighs what speaks for and against each block: length, stop-word density
and link density against the names of the elements around it; an article element
counts for what is in it, as long as the page's dense text is not elsewhere.
Pass 2 gives every ambiguous short block the label of its nearest decided neighbours.
Only what no reader sees as text (scripts, hidden elements) and the kinds of elements
that are made for furniture (nav, footer, aside, form) is out whatever it says.

Stop words are those of English, French, German and Spanish.  Text mostly in letters
other than Latin is judged by length and links alone; prose of other languages in Latin letters
passes only inside an article or main element, or beside other text that passes.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.quality import STOP_WORDS
from corpusloom.session import ship_code

# Nothing that is matched is given back, so no page makes the scan quadratic.
MARKUP = re.compile(
    r"""<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*+>?|<(/?)([a-zA-Z][a-zA-Z0-9:\-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:\-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Their content is no text of the page.
RAW = frozenset({"script", "style", "noscript", "template", "title", "textarea", "select", "svg", "math", "iframe", "object", "canvas", "audio", "video", "button"})
# Where these are never closed, only the tag is skipped.
OPEN_RAW = frozenset({"select", "button", "svg", "math", "iframe", "object", "canvas", "audio", "video"})
# Elements that hold blocks; an end tag closes everything opened inside.
CONTAINERS = frozenset({
    "html", "head", "body", "main", "article", "section", "div", "nav", "header", "footer", "aside", "form", "fieldset", "dialog", "menu",
    "ul", "ol", "dl", "table", "figure", "details", "blockquote",
})
BLOCKS = CONTAINERS | frozenset({
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "pre", "hr", "address",
    "figcaption", "summary", "legend", "option", "center",
})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
OUTSIDE = frozenset({"nav", "footer", "aside", "form", "menu", "dialog", "head"})
NAMED_OUTSIDE = frozenset({
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "sidebar", "sidebox",
    "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "masthead", "topbar", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "comment", "comments", "disqus", "replies", "share", "sharing",
    "social", "related", "recommended", "subscribe", "subscription", "newsletter", "signup", "login", "search", "widget", "toolbar", "copyright",
    "legal", "tags", "author-bio", "trending", "paywall", "toc",
})
NAMED_HEADER = frozenset({"header", "heading-bar", "site-header", "page-header", "topnav"})
ROLES_OUTSIDE = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "tablist"})
NEGATED = frozenset({"no", "with", "has", "without", "hide", "is"})
STOPS = frozenset(STOP_WORDS)


OTHER_SCRIPT = re.compile(r"[\u0370-\u1fff\u2c00-\ud7ff\uf900-\ufdff\ufe70-\ufeff\U00010000-\U0003ffff]")
PLAIN, PART_NAMED, NAMED, FURNITURE = 0, 1, 2, 3


@dataclass(frozen=True)
class Limits:
    short: int = 70            # fewer characters: too short to decide alone
    long: int = 200            # from here on a block with enough stop words is dense text
    stop_low: float = 0.15
    stop_high: float = 0.30
    link_max: float = 0.5      # share of characters inside links
    article_link_max: float = 0.8
    dense_link_max: float = 0.2
    named_long: int = 1500     # dense text of this length outweighs a furniture name
    elsewhere: float = 4.0     # so many times the article's text outside of it: the article element says nothing


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    against: int               # what the elements around it say: PLAIN, PART_NAMED, NAMED or FURNITURE
    scope: int                 # number of the enclosing article, 0 outside of any
    label: str = ""


def _against(tag: str, attributes: str, in_article: bool) -> int:
    """What the kind, role and names of an element say against the text in it."""
    if tag in OUTSIDE or (tag == "header" and not in_article):
        return FURNITURE
    if not attributes.strip() or tag in ("html", "body", "article", "main"):
        return PLAIN
    worst = PLAIN
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return FURNITURE
        if name == "role" and value in ROLES_OUTSIDE:
            return FURNITURE
        if name in ("class", "id"):
            for word in value.split():
                parts = [p for p in re.split(r"[^a-z]+", word) if p]
                if not parts or parts[0] in NEGATED:
                    continue
                if word in NAMED_OUTSIDE or parts[0] in NAMED_OUTSIDE and len(parts) == 1 or all(p in NAMED_OUTSIDE for p in parts):
                    worst = max(worst, NAMED)
                elif any(p in NAMED_OUTSIDE for p in parts):
                    worst = max(worst, PART_NAMED)
                if not in_article and (word in NAMED_HEADER or parts[:1] == ["header"] or parts[-1:] == ["header"]):
                    return FURNITURE
    return worst


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; malformed markup is taken as browsers mostly do."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []
    opened: Counter = Counter()
    unclosed: set[str] = set()
    parts: list[str] = []
    links, in_link, heading, own, articles, at = 0, False, False, PLAIN, 0, 0
    last = page.rfind(">")

    def close() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, min(links, len(text)), heading, max(own, stack[-1][1] if stack else PLAIN), stack[-1][2] if stack else 0))
            parts.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        text = html_lib.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            links += len(" ".join(text.split()))

    while at < len(page):
        # Behind the last ">" there is no tag any more.
        m = MARKUP.search(page, at) if at <= last or page.find("<!", at) >= 0 else None
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        if m.group(2) is None:
            if m.group().startswith("<![CDATA["):
                parts.append(m.group()[9:].removesuffix("]]>"))
            continue
        tag, ending, attributes = m.group(2).lower(), bool(m.group(1)), m.group(3)
        if tag in RAW:
            if not ending and not attributes.endswith("/"):
                end = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in OPEN_RAW:
                    unclosed.add(tag)
                else:
                    at = len(page)
            continue
        if tag == "a":
            in_link = not ending
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in BLOCKS:
            continue
        close()
        in_link = False
        heading, own = tag in HEADINGS and not ending, PLAIN
        if tag in CONTAINERS:
            if not ending:
                outer = stack[-1] if stack else ("", PLAIN, 0)
                scope = outer[2]
                if tag in ("article", "main") and outer[1] < NAMED:
                    articles += 1
                    scope = scope or articles
                stack.append((tag, max(outer[1], _against(tag, attributes, bool(scope))), scope))
                opened[tag] += 1
            elif opened[tag]:
                while True:
                    name = stack.pop()[0]
                    opened[name] -= 1
                    if name == tag:
                        break
        elif not ending and attributes and (own := _against(tag, attributes, bool(stack and stack[-1][2]))) >= NAMED:
            # A single paragraph or list item named as furniture goes.
            own = PLAIN
            end = re.compile(rf"</{tag}\s*>|<(?:{'|'.join(sorted(BLOCKS))})\b", re.I).search(page, at)
            at = end.start() if end else len(page)
    close()
    return out


def stop_density(text: str) -> float | None:
    """Share of stop words; None for text that is mostly in letters other than Latin."""
    if not text.isascii() and 2 * len(OTHER_SCRIPT.findall(text)) > sum(c.isalpha() for c in text):
        return None
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOPS for w in words) / len(words)


def _weight(b: Block, limits: Limits) -> str:
    """What a block's own text says: dense, near, thin (long without stop words), linked or short."""
    n, link = len(b.text), b.linked / len(b.text)
    if link > (limits.article_link_max if b.scope else limits.link_max):
        return "linked"
    if n < limits.short:
        return "short"
    stop = stop_density(b.text)
    if stop is None:
        return "dense" if n > limits.long and link <= limits.dense_link_max else "near"
    if stop >= limits.stop_high and n > limits.long:
        return "dense" if link <= limits.dense_link_max else "near"
    return "near" if stop >= limits.stop_low else "thin"


def classify(found: list[Block], limits: Limits = Limits()) -> list[Block]:
    """Labels all blocks ``good`` or ``bad`` (two passes)."""
    weights = [_weight(b, limits) if b.against < FURNITURE else "" for b in found]

    def outweighed(b: Block, weight: str) -> bool:
        """Whether its names decide against a block: a part of a name only where the text is not dense."""
        if b.against in (PLAIN, FURNITURE):
            return b.against == FURNITURE
        return weight != "dense" or b.against == NAMED and len(b.text) < limits.named_long

    inside = sum(len(b.text) for b, w in zip(found, weights) if b.scope and not outweighed(b, w))
    dense_outside = sum(len(b.text) for b, w in zip(found, weights) if not b.scope and b.against == PLAIN and w == "dense")
    has_article = inside > 0 and dense_outside <= limits.elsewhere * inside
    for b, weight in zip(found, weights):
        if outweighed(b, weight) or (has_article and not b.scope) or weight == "linked":
            b.label = "bad"
        elif weight == "dense":
            b.label = "good"
        elif weight == "thin":
            # Inside an article low density alone does not decide, the neighbours do.
            b.label = "short" if b.scope else "bad"
        else:
            b.label = weight
    # Pass 2: ambiguous blocks take the label of the nearest decided blocks of their own scope.
    result = [b.label for b in found]
    for scope in {b.scope for b in found}:
        mine = [k for k, b in enumerate(found) if b.scope == scope and (not scope or b.label != "bad" or weights[k] == "linked")]
        before: dict[int, str] = {}
        after: dict[int, str] = {}
        for order, into in ((mine, before), (mine[::-1], after)):
            last = "good" if scope else "bad"
            for k in order:
                into[k] = last
                if found[k].label in ("good", "bad"):
                    last = found[k].label
        for k in mine:
            label, left, right = found[k].label, before[k], after[k]
            if label == "near":
                result[k] = "bad" if left == right == "bad" and len(found[k].text) < limits.long else "good"
            elif label == "short":
                if left == right:
                    result[k] = left
                elif found[k].heading:
                    result[k] = right
                else:
                    near = [j for j in (k - 1, k + 1) if 0 <= j < len(found) and found[j].scope == scope and found[j].label == "near"]
                    result[k] = "good" if near or scope and weights[k] == "short" else "bad"
    for b, label in zip(found, result, strict=True):
        b.label = label
    return found


def main_text(page: str, limits: Limits = Limits()) -> str:
    return "\n".join(b.text for b in classify(blocks(page), limits) if b.label == "good")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", limits: Limits = Limits()) -> DataFrame:
    """One row per input row: id, url, ``text`` (main text), ``n_blocks``, ``n_good``.

    Null or empty html gives an empty text; repeated rows each get a row; a
    page of any length is read whole.  Pages are independent: no shuffle.
    """
    ship_code()
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    types = dict(rows.dtypes)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, n_blocks, n_good = [], [], []
            for page in batch.column("_html"):
                found = classify(blocks(page.as_py()), limits)
                good = [b.text for b in found if b.label == "good"]
                texts.append("\n".join(good)), n_blocks.append(len(found)), n_good.append(len(good))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()), pa.array(n_blocks, pa.int32()), pa.array(n_good, pa.int32())],
                ["_id", "_url", "text", "n_blocks", "n_good"])

    out = rows.mapInArrow(run, f"_id {types['_id']}, _url {types['_url']}, text string, n_blocks int, n_good int")
    return out.withColumnRenamed("_id", id_col).withColumnRenamed("_url", url_col)
