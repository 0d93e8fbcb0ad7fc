"""Main text of web pages by line-block distribution.

Markup becomes lines: block elements break lines, inline ones vanish, and what a
page says of itself by element, role or class to be no article (menus, adverts, forms, comments, ...) leaves a stretch
of empty lines.  Text lengths are summed over sliding windows of lines.  The sum surges from nothing where
a body of text begins and dives to nothing where a whole window is empty; the text between such points is kept
if its densest window is dense enough.  Where a page marks its article, only lines in it have a
length, so that its short lines count as well.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import col, ship_with_tasks

WINDOW = 3
#: Characters outside links that the densest window of a body has where no article is marked.
DENSE = 80

# Element names and the words that name page furniture in classes, ids and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
                  "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
FURNITURE = frozenset("head title nav footer aside form button select option fieldset iframe object noscript template dialog menu svg canvas audio video".split())
FURNITURE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner banners promo promotion promoted sponsor sponsored sponsors nav navbar navigation "
                            "menu menus sidebar sidebars aside footer header masthead topbar breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert alerts popup "
                            "modal overlay newsletter subscribe subscription signup login signin share sharing social related recommended recommendations comment comments "
                            "disqus respond reply replies pagination pager widget widgets toolbar copyright complementary contentinfo search".split())
FURNITURE_STARTS = ("comment", "sidebar", "advert", "cookie", "breadcrumb", "newsletter", "sponsor", "banner", "navbar", "navigation", "footer")
ARTICLE_ROLES = frozenset(["article", "main"])

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>", re.S | re.I)
_HOLDS_ARTICLES = re.compile(r"comment|repl|respond|disqus|related|recommend", re.I)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


@dataclass
class Line:
    raw: list[str] = field(default_factory=list)
    linked: int = 0
    inside: bool = False


def is_furniture(name: str, attrs: str, in_article: bool) -> bool:
    """True for an element that holds no article text."""
    if name in FURNITURE or name == "header" and not in_article:
        return True
    if name in ("html", "body", "main", "header") or not attrs.strip():
        return False
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id", "role"):
            if any(w in FURNITURE_WORDS or w.startswith(FURNITURE_STARTS) for w in re.split(r"[^a-z]+", value)):
                return True
    return False


def lines_of(page: str) -> tuple[list[Line], bool]:
    """Lines of a page, empty ones where furniture stood, and whether it marks an article."""
    lines, current = [], Line()
    # Element being skipped, how deep it's nested in itself, and whether it may hold articles of its own.
    skip, depth, others = "", 0, False
    articles, seen, links, at = 0, False, 0, 0

    def end_line(gap: int = 0):
        nonlocal current
        lines.append(current)
        lines.extend(Line() for _ in range(gap))
        current = Line()

    def text(piece: str):
        if piece and not skip:
            current.raw.append(piece)
            current.inside = current.inside or articles > 0
            current.linked += len(piece) if links else 0

    for token in _TOKEN.finditer(page):
        text(page[at:token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            continue
        closing, attrs = bool(token["close"]), token["attrs"] or ""
        whole = name in VOID or attrs.endswith("/") and not closing
        marks = name in ("article", "main") or not closing and name in ("div", "section") and any(
            k.lower() == "role" and "".join(v).lower() in ARTICLE_ROLES for k, *v in _ATTR.findall(attrs))
        if skip:
            unclosed = marks and not seen and not others and not is_furniture(name, attrs, False) or skip == "p" and name in BLOCK
            if unclosed and not closing:
                skip, depth = "", 0
            elif name == skip:
                depth += 0 if whole else -1 if closing else 1
                if not depth:
                    skip = ""
                continue
            else:
                continue
        if not closing and not whole and is_furniture(name, attrs, articles > 0):
            end_line(WINDOW)
            skip, depth, others = name, 1, bool(_HOLDS_ARTICLES.search(attrs))
            continue
        if name in ("article", "main"):
            # What is marked and what isn't are bodies of their own.
            end_line(WINDOW)
            articles = max(0, articles + (-1 if closing else 1))
            seen = seen or not closing
        elif name == "a":
            links = max(0, links + (-1 if closing else 1))
        if name == "br":
            text(" ")
        elif name in BLOCK:
            links = 0 if name not in ("li", "td") else links
            end_line()
    text(page[at:])
    lines.append(current)
    return lines, seen


def bodies(lengths: list[int], window: int) -> list[tuple[int, int, int]]:
    """(surge, dive, densest window) of each body of text in a list of line lengths.

    A body begins where the sum over the next ``window`` lines rises from nothing and ends where it falls back to nothing.
    """
    sums = [sum(lengths[i:i + window]) for i in range(len(lengths))]
    found, surge = [], None
    for i, total in enumerate(sums + [0]):
        if total and surge is None:
            surge = i
        elif not total and surge is not None:
            found.append((surge, i, max(sums[surge:i])))
            surge = None
    return found


def main_text(page: str | None, window: int = WINDOW, dense: int = DENSE) -> str:
    """The article of a whole page: its blocks in page order, one newline between them."""
    lines, marked = lines_of(page or "")
    texts = [" ".join(entities.unescape("".join(line.raw)).split()) for line in lines]
    # Short lines and links count where an article is marked, so that it stays whole.
    lengths = [len(t) if line.inside else max(0, len(t) - line.linked) for t, line in zip(texts, lines)]
    found = bodies(lengths, window)
    own = [any(line.inside for line in lines[lo:hi]) for lo, hi, _ in found]
    sizes = [sum(lengths[lo:hi]) for lo, hi, _ in found]
    enough = min(dense, max((peak for _, _, peak in found), default=0))
    # The marked part is the article unless another dense body is larger than all of it.
    main = sum(n for n, o in zip(sizes, own) if o)
    rest = max((n for n, o, (_, _, peak) in zip(sizes, own, found) if not o and peak >= enough), default=0)
    whole = marked and main >= rest
    keep = []
    for (lo, hi, peak), o in zip(found, own):
        if o if whole else peak >= enough:
            keep += [t for t in texts[lo:hi] if t]
    return "\n".join(keep)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = WINDOW, dense: int = DENSE) -> DataFrame:
    """One row for each page: ``page_id, url, text, n_chars``.

    Null html counts as an empty page: empty text.  Unclosed or cut-off markup is read as far as it goes; a page
    without markup is text.  Nulls in id and url and repeated rows pass through.  An empty table gives an empty result; further
    columns are ignored.
    """
    def run(batches):
        for batch in batches:
            found = [main_text(h.as_py(), window, dense) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    rows = df.select(col(id_col).alias("page_id"), col(url_col).cast("string").alias("url"), col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {df.schema[id_col].dataType.simpleString()}, url string, text string, n_chars bigint")


ship_with_tasks(__name__)
