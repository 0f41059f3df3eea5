"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page, in page order. A line counts the characters of its
text; lines of menus, headers, footers, sidebars, notices, adverts, forms and comments, and lines of little else than
links (in lists, next to each other, or of several links outside a paragraph), count 0, and so does what lies outside the article where the page marks one. A class or id tells such a block if
it holds the name of one, alone or after the last dash; paragraphs, headings and the article are never judged by name, nor
is a container around the marked articles if without them the page would have no marked text. The counts are summed over a
sliding window of ``WINDOW`` lines. The text begins where the sums surge from 0 and ends where they dive to 0 again.
Of several such stretches, those in a marked article are all kept; on pages that mark none, the largest is kept,
all others with lines in the container that holds it, and others of at least ``SHARE`` of its size.

Character references are decoded, white space inside a block becomes one blank, blocks are joined by an empty line.
Nothing else is dropped; a line inside the stretch stays however short it is.

Defined results: null or empty html, and pages without text, give ''; html may be cut off anywhere; plain text without
tags is one block; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate
from math import inf
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from salmoura.llm.common import batched, slices
from salmoura.names import col

WINDOW = 3
SHARE = 0.25
LINKED = 0.6  # share of linked characters from which on a line outside a marked article is a menu

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|canvas|textarea|select|title)\b[^>]*>"
    r".*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)

# elements that part blocks; of these, the containers have end tags that are not left out
_CONTAINERS = frozenset(
    "html body head div section article main nav header footer aside form fieldset ul ol dl table figure menu "
    "dialog details blockquote pre center button".split()
)
_BLOCKS = _CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption figcaption address hr summary legend option".split()
)
_NOISE = frozenset("head nav footer aside form fieldset menu dialog button".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu".split())
_NOISE_NAMES = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice notification popup modal newsletter "
    "subscribe share sharing social related comment comments disqus reply replies widget toolbar login signup "
    "pagination skip".split()
)
_ARTICLE = frozenset(["article", "main"])
_LISTS = frozenset("ul ol dl menu".split())
# containers that are parts of a text, not its frame
_PARTS = frozenset("ul ol dl table figure blockquote pre center section details".split())
_TEXTS = frozenset("p h1 h2 h3 h4 h5 h6".split())  # often named after what they tell


class Box(NamedTuple):
    """A container: its tag, the one around it, and the numbers of those inside (from its own to ``end``, exclusive)."""

    tag: str
    outer: int
    end: float


def _is_noise(tag: str, rest: str, in_article: bool, named: bool) -> bool:
    """``named``: whether a class or id may tell."""
    if tag in _NOISE or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "main") or not rest.strip("/> \t\r\n"):
        return False
    for name, *values in _ATTRIBUTE.findall(rest):
        value = "".join(values).lower()
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in _NOISE_ROLES:
            return True
        if name in ("class", "id") and named and not (tag == "header" and in_article):
            if any(n in _NOISE_NAMES or re.split(r"[_-]+", n)[-1] in _NOISE_NAMES for n in value.split()):
                return True
    return False


def lines(html: str) -> list[tuple[str, int, bool, int]]:
    """Blocks of a page: (text, characters that count, inside a marked article, number of the innermost container)."""
    return _page(html)[0]


def _page(html: str) -> tuple[list[tuple[str, int, bool, int]], list[Box]]:
    found, boxes, wrappers = _lines(html, frozenset())
    if wrappers and not any(article and count for _, count, article, _ in found):
        again, same, _ = _lines(html, wrappers)
        if any(article and count for _, count, article, _ in again):
            return again, same
    return found, boxes


def _lines(html: str, wrappers: frozenset[int]) -> tuple[list[tuple[str, int, bool, int]], list[Box], frozenset[int]]:
    """The blocks, where the names of the containers ``wrappers`` (by number) say nothing; all containers, the page as
    number 0; and those that are noise by name alone around the marked articles with the fewest such."""
    out: list[tuple[str, int, bool, int]] = []
    menus: list[bool | None] = []  # of each line: a menu, or (None) one if a line of links is next to it
    boxes = [Box("", 0, inf)]
    parts: list[str] = []
    linked = links = at_box = listed = 0
    block = ""
    # open containers: tag, its number, noise here or outside, in an article, in an article element, noise other than by name, names
    stack: list[tuple] = []
    noise = article = inner = hard = loose = link = False  # loose: a noisy block without an end tag of its own
    names: tuple | None = None  # containers that are noise by name: number, those outside, how many
    wrapped: list[tuple] = []

    def close() -> None:
        nonlocal linked, links, parts
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                menu = not article and linked >= LINKED * len(text)
                menus.append((listed > 0 or (links > 1 and block not in _TEXTS) or None) if menu else False)
                out.append((text, 0 if noise or loose else len(text), article, at_box))
        parts, linked, links = [], 0, 0

    def gap() -> None:
        out.extend([("", 0, False, at_box)] * WINDOW)
        menus.extend([False] * WINDOW)

    def chunk(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if link:
            linked += len(text.strip())

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            chunk(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            link = not m["end"]
            links += link
        elif tag == "br":
            parts.append(" ")
        elif tag in _BLOCKS:
            close()
            loose = link = False
            block = "" if m["end"] else tag
            if tag not in _CONTAINERS:
                loose = not m["end"] and _is_noise(tag, m["rest"], article, tag not in _TEXTS)
            elif not m["end"]:
                if m["rest"].endswith("/>"):
                    continue
                opened = len(boxes)
                # an article inside another is a comment or a teaser if its name says so
                by_name = (tag != "article" or inner) and opened not in wrappers
                noisy = noise or _is_noise(tag, m["rest"], article, by_name)
                if noisy and not noise:
                    gap()
                stack.append((tag, opened, noise, article, inner, hard, names))
                boxes.append(Box(tag, at_box, inf))
                at_box = opened
                listed += tag in _LISTS
                if noisy and not article and not hard:
                    hard = _is_noise(tag, m["rest"], article, False)
                    if not hard and tag in _ARTICLE:
                        wrapped.append(names)
                    elif not hard and _is_noise(tag, m["rest"], article, by_name):
                        names = (opened, names, names[2] + 1 if names else 1)
                noise, article = noisy, article or (tag in _ARTICLE and not noisy)
                inner = inner or tag == "article"
            else:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == tag:
                        was = noise
                        for kind, number, *_ in stack[depth:]:
                            boxes[number] = boxes[number]._replace(end=len(boxes))
                            listed -= kind in _LISTS
                        _, number, noise, article, inner, hard, names = stack[depth]
                        at_box = boxes[number].outer
                        del stack[depth:]
                        if was and not noise:
                            gap()
                        break
    if at < len(html):
        chunk(html[at:])
    close()
    for i, menu in enumerate(menus):
        if menu or (menu is None and (menus[i - 1 : i] not in ([], [False]) or menus[i + 1 : i + 2] not in ([], [False]))):
            out[i] = (out[i][0], 0, *out[i][2:])
    found = set()
    fewest = min((n[2] for n in wrapped), default=0)
    for around in {n[0]: n for n in wrapped if n[2] == fewest}.values():
        while around and around[0] not in found:
            found.add(around[0])
            around = around[1]
    return out, boxes, frozenset(found)


def stretches(counts: list[int]) -> list[tuple[int, int]]:
    """From each surge of the window sums to the next dive, as (first, end) of lines that count."""
    sums = [0, *accumulate(counts)]
    window = [sums[min(len(counts), i + WINDOW)] - sums[i] for i in range(len(counts))]
    out, start = [], None
    for i, total in enumerate([*window, 0]):
        if total and start is None:
            start = i
        elif not total and start is not None:
            first = next(k for k in range(start, i) if counts[k])
            last = next(k for k in range(i - 1, start - 1, -1) if counts[k])
            out.append((first, last + 1))
            start = None
    return out


def main_text(html: str | None) -> str:
    found, boxes = _page(html or "")
    marked = any(article and count for _, count, article, _ in found)
    counts = [count if article or not marked else 0 for _, count, article, _ in found]
    kept = stretches(counts)
    if not marked and kept:
        sizes = [sum(counts[a:b]) for a, b in kept]
        inside = [[found[i][3] for i in range(a, b) if counts[i]] for a, b in kept]
        largest = inside[sizes.index(max(sizes))]
        frame = min(largest)
        while boxes[frame].end <= max(largest) or boxes[frame].tag in _PARTS:
            frame = boxes[frame].outer
        kept = [s for s, size, held in zip(kept, sizes, inside) if size >= SHARE * max(sizes)
                or any(frame <= box < boxes[frame].end for box in held)]
    return "\n\n".join(
        found[i][0] for a, b in kept for i in range(a, b) if counts[i]
    )


def extracted(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: id, url, main text and its length in code points."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[page_id, url, "text", "n_chars"],
            )

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (page_id, url)}
    schema = ", ".join(f"`{c}` {kind}" for c, kind in kinds.items()) + ", text string, n_chars bigint"
    return batched(pages.select(col(page_id), col(url), col(html))).mapInArrow(extract, schema)
