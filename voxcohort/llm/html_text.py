"""Main text of web pages by two passes of block rules.

The markup is cut into blocks at block-level tags. The first pass decides blocks by where they stand (menus, footers, forms and
such are boilerplate; if the page marks an article, so is all else), by link density, length and the share of stop words. What
only a class, id or role around an article or main calls boilerplate does not count inside of it, and neither does a form around
the page or a menu that is never closed. Blocks that stay ambiguous, mostly short ones, take the label of the nearest decided block of the
same container in the second pass.

If that finds nothing at all, the page is read once more without such doubtful marks, and then, for languages whose stop words are not
known, by length and link density alone.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcohort.llm.common import prepare

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset((
    "a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their they this to was we were "
    "which with you aber als am auf aus bei das dem den der des die du ein eine einer er es für ich im ist mit nach nicht oder sich sie sind und "
    "von war wie wir zu zum au aux avec ce ces dans de elle en est et il ils la le les leur mais ne nous ou par pas plus pour que qui sa se ses "
    "son sont sur un une vous al como con del el ella entre era ha lo los las más muy no o para pero por su sus también y"
).split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<raw>script|style|noscript|template|textarea|svg|math|iframe|object|canvas|audio|video|select|title)\b"
    r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_AWAY = frozenset("nav footer aside form button dialog menu label fieldset".split())
_LISTS = frozenset("li ul ol dl dt dd".split())
#: Scripts that write words without spaces between them; two characters count as a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_HINT = re.compile(
    r"^(ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|sidebar|side|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|"
    r"footer|comment|comments|reply|replies|disqus|cookie|cookies|consent|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"share|sharing|social|related|recommended|widget|toolbar|pagination|pager|legal|copyright|complementary|contentinfo|search|form)$")
#: Names with such a part tell how the page around is laid out: has-sidebar, content-with-nav; and so do first parts before the others: nav-layout.
_ABOUT, _LAID = frozenset("has with without no".split()), frozenset("layout page theme grid".split())


@dataclass
class Block:
    text: str
    links: float
    words: int
    stops: float
    away: bool
    doubtful: bool
    container: int
    main: bool
    heading: bool
    listed: bool
    good: bool | None = None


def _names_away(name: str) -> bool:
    """Whether a class, id or role names boilerplate by its last part, or by its first; what follows -- is a variant."""
    parts = [x for x in re.split("[_-]+", name.partition("--")[0]) if x]
    if not parts or not _ABOUT.isdisjoint(parts):
        return False
    return bool(_HINT.match(parts[-1]) or (_HINT.match(parts[0]) and parts[-1] not in _LAID))


def _hinted(rest: str) -> bool:
    return any(_names_away(name) for found in _ATTRIBUTE.finditer(rest) for value in found.groups() if value for name in value.lower().split())


def _unclosed(tokens: list[re.Match]) -> set[int]:
    """Where the boilerplate tags begin that no end tag closes."""
    stack: list[tuple[str, int]] = []
    lost: set[int] = set()
    for token in tokens:
        tag = (token["tag"] or "").lower()
        if not tag or tag in _INLINE or tag in _VOID or token["rest"].endswith("/"):
            continue
        if not token["close"]:
            stack.append((tag, token.start()))
        elif any(tag == t for t, _ in stack):
            while stack[-1][0] != tag:
                lost.add(stack.pop()[1])
            stack.pop()
    return lost | {at for _, at in stack}


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with what the rules look at."""
    out: list[Block] = []
    tokens = list(_TOKEN.finditer(page))
    unclosed = _unclosed(tokens)
    stack: list[tuple[str, bool, bool, bool, int]] = []  # tag, away by tags, away by hints, forms or unclosed tags, main, container
    pieces: list[str] = []
    linked = link = containers = 0
    heading = False

    def close() -> None:
        nonlocal linked
        text = re.sub(r"\s+", " ", html.unescape("".join(pieces))).strip()
        if text:
            words = text.split(" ")
            tag, away, hint, main, container = stack[-1] if stack else ("", False, False, False, 0)
            stops = sum(w.strip(".,;:!?\"'()").lower() in STOP_WORDS for w in words) / len(words)
            size = len(words) + len(_UNSPACED.findall(text)) // 2
            out.append(Block(text, linked / max(1, len(text)), size, stops, away or hint, hint and not away, container, main, heading, tag in _LISTS))
        pieces.clear()
        linked = 0

    at = 0
    for token in tokens:
        text = page[at: token.start()]
        if text:
            pieces.append(text)
            linked += len(text.strip()) if link else 0
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if tag in _INLINE:
            if tag == "a":
                link = max(0, link + (-1 if token["close"] else 1)) if token["close"] or not link else link
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        close()
        link = 0
        heading = not token["close"] and re.fullmatch("h[1-6]", tag) is not None
        if tag in _VOID or token["rest"].endswith("/"):
            continue
        if not token["close"]:
            if tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            _, away, hint, main, container = stack[-1] if stack else ("", False, False, False, 0)
            inside = main or tag in ("article", "main")
            marked = tag in _AWAY or (tag == "header" and not main)
            weak = tag == "form" or token.start() in unclosed
            gone = away or (marked and not weak)
            named = (marked and weak) or (tag not in ("html", "body", "main") and _hinted(token["rest"]))
            # an article stands against the hints around it, unless it is a comment or the like itself
            doubt = (hint and named) if tag == "article" else tag != "main" and (hint or named)
            if (gone or doubt) != (away or hint) or inside != main:
                containers += 1
                container = containers
            stack.append((tag, gone, doubt, inside, container))
        elif any(tag == s[0] for s in stack):
            while stack.pop()[0] != tag:
                pass
    text = page[at:]
    if text:
        pieces.append(text)
    close()
    return out


def decide(found: list[Block], known: bool = True) -> None:
    """First pass: clear cases. Second pass: the others follow the nearest decided block of their container.

    ``known`` asks for stop words of the known languages.
    """
    marked = any(b.main and not b.away for b in found)
    for b in found:
        b.good = None
        # inside a marked article only lists of links are menus
        if b.away or (marked and not b.main) or (b.links > 0.5 and b.words < 40 and (b.listed or not b.main)):
            b.good = False
        elif b.words >= 10 and b.links < 0.3 and (b.stops >= 0.15 or not known):
            b.good = True
        elif b.words >= 40 and b.links < 0.2 and (b.main or b.stops >= 0.05):
            b.good = True
    by: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        if b.good is not None:
            by.setdefault(b.container, []).append(i)
    for i, b in enumerate(found):
        if b.good is None:
            near = min(by.get(b.container, []), key=lambda j: (abs(i - j), -j if b.heading else j), default=None)
            b.good = found[near].good if near is not None else b.main


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    decide(found)
    if not any(b.good for b in found):
        for b in found:
            b.away = b.away and not b.doubtful
        decide(found)
    if not any(b.good for b in found):
        decide(found, known=False)
    return "\n".join(b.text for b in found if b.good)


def extract_text(pages: DataFrame, source: str = "html", into: str = "text") -> DataFrame:
    """All columns of ``pages`` and ``into``: the main text, one block a line. Null pages give the empty text; a column that is
    named like ``into`` is replaced; truncated and unbalanced markup is read as far as it goes.
    """
    prepare(pages.sparkSession)
    return pages.withColumn(into, F.pandas_udf(lambda s: pd.Series([main_text(p) for p in s], dtype=object), "string")(F.col(source)))
