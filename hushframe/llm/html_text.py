"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window, and the characters of a window that a surge must reach somewhere before it dives.
WINDOW = 3
SURGE = 60

# Elements of HTML. A head holds no text but in these, and its end tag may be left out.
UNSEEN = ("script", "style", "noscript", "template", "svg", "textarea", "select", "iframe", "object", "title", "canvas", "audio", "video")
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav aside footer form menu dialog button fieldset".split())
#: These end with the next block where their end tag is left out.
OPEN_ENDED = frozenset("p li dt dd td th tr option".split())

#: Names, within class and id, of what surrounds an article, and of what holds it.
AROUND = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side|nav\w*|menu|breadcrumbs?|footer|foot|header|masthead|topbar|toolbar|"
    r"cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommend\w*|"
    r"comments?|commentlist|respond|reply|replies|disqus|pagination|pager|widget|tags?|copyright|legal|skip)(?:$|[\s_-])",
    re.I,
)
#: Of these, what is left out of an article too, whatever it holds: adverts, menus, sidebars, notices, forms, comments. All
#: others are left out of an article only where most of their text is links.
WITHIN = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|sidebar|nav\w*|menu|breadcrumbs?|footer|cookies?|consent|gdpr|notice|newsletter|subscribe|"
    r"comments?|commentlist|respond|reply|replies|disqus)(?:$|[\s_-])",
    re.I,
)
HOLDS = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text)(?:$|[\s_-])", re.I)

_UNSEEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(" + "|".join(UNSEEN) + r")(?=[\s>/])[^>]*+(?:(?<=/)>|>.*?(?:</\1\s*+>|\Z))|<[!?][^>]*+>",
    re.I | re.S,
)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)


def _names(attributes: str) -> str:
    return " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if "=" in attributes else ""


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """The blocks of a page without the markup around it: text, characters outside links, whether an article holds it.

    Elements for navigation, forms, asides and footers, those whose class or id names such a thing, and headers
    outside an article are stripped with all they hold. One that is never closed is read as if it held nothing. A
    name does not strip what holds an article or, on a page without one outside it, most of the page's text. Inside an
    article only names of WITHIN strip whatever they hold, others what is mostly links.
    """
    page = _UNSEEN.sub(" ", page)
    pieces: list[tuple[int, int, str, str, str]] = []  # text before, then the tag: kind 1 opens, -1 closes
    last = 0
    for m in _TAG.finditer(page):
        name = (m[2] or m[5]).lower()
        pieces.append((last, m.start(), "/" if m[1] or m[4] else "", name, m[3] if m[2] else m[6]))
        last = m.end()
    pieces.append((last, len(page), "", "", ""))

    # Where each element ends, by the nearest end tag of its name.
    ends: dict[int, int] = {}
    waiting: dict[str, list[int]] = {}
    for i, (_, _, close, name, attributes) in enumerate(pieces):
        if not name or name in VOID or attributes.endswith("/"):
            continue
        if not close:
            if name in OPEN_ENDED and waiting.get(name) and name == "p":
                ends[waiting[name].pop()] = i
            waiting.setdefault(name, []).append(i)
        elif waiting.get(name):
            ends[waiting[name].pop()] = i

    # Characters before each piece's tag, and articles opened before it.
    chars, linked, articles = [0], [0], [0]
    depth = 0
    for start, end, close, name, _ in pieces:
        n = len(page[start:end].strip())
        chars.append(chars[-1] + n)
        linked.append(linked[-1] + (n if depth else 0))
        if name == "a":
            depth = max(0, depth + (-1 if close else 1))
        articles.append(articles[-1] + (name in ("article", "main") and not close))

    def wraps(i: int) -> bool:
        inside = articles[ends[i]] - articles[i + 1]
        return inside > 0 or (not articles[-1] and 2 * (chars[ends[i] + 1] - chars[i + 1]) > chars[-1])

    def links_only(i: int) -> bool:
        return 2 * (linked[ends[i] + 1] - linked[i + 1]) > chars[ends[i] + 1] - chars[i + 1]

    out: list[tuple[str, int, bool]] = []
    text: list[str] = []
    plain = 0
    links = 0
    held_until = skip_until = -1
    block_held = False

    def flush() -> None:
        nonlocal text, plain, block_held
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            out.append((whole, plain, block_held))
        text, plain, block_held = [], 0, False

    for i, (start, end, close, name, attributes) in enumerate(pieces):
        if i > skip_until:
            if part := page[start:end]:
                text.append(part)
                if part.strip():
                    plain += 0 if links else len(part)
                    block_held |= i <= held_until
            if name in BLOCK:
                flush()
            elif name in ("br", "img", "wbr"):
                text.append(" ")
            if name == "a":
                links = max(0, links + (-1 if close else 1))
            if name and not close and i in ends:
                named = _names(attributes)
                holds = name in ("article", "main") or (name in ("div", "section", "td") and bool(HOLDS.search(named)))
                around = bool(named) and name not in ("article", "main", "body", "html") and bool(AROUND.search(named)) and not wraps(i)
                if around and i <= held_until:
                    around = bool(WITHIN.search(named)) or links_only(i)
                if name in ASIDE or around or (name == "header" and i > held_until):
                    skip_until = ends[i]
                elif holds:
                    held_until = max(held_until, ends[i])
    flush()
    return out


def surges(weights: list[int]) -> list[tuple[int, int, int]]:
    """From where the sums of WINDOW lines rise from nothing to where they fall back: first line, end, highest sum."""
    out, k = [], 0
    while k < len(weights):
        if not weights[k]:
            k += 1
            continue
        start = last = k
        while k < len(weights) and k - last <= WINDOW:
            last = k if weights[k] else last
            k += 1
        sums = [sum(weights[i : i + WINDOW]) for i in range(start, last + 1)]
        out.append((start, last + 1, max(sums)))
    return out


def main_text(page: str | None) -> str:
    """The lines between surge and dive points, joined by an empty line.

    A line weighs its characters outside links, or nothing where most of it is links; one that an article element
    holds weighs SURGE at least. Text surges where the sums of windows of WINDOW lines rise from nothing and dives where
    they fall back to nothing; all lines from surge to dive are kept whole if a window between reaches SURGE (or none
    on the page does). Where an article element begins or ends a surge ends too, and what surges outside is kept only
    if it has as much text as all that surges inside together: the mark is then on a teaser, not on the text.
    """
    lines = lines_of(page or "")
    parts: list[tuple[bool, int, list[int]]] = []  # held, first line, weights
    for k, (s, plain, held) in enumerate(lines):
        if not parts or parts[-1][0] != held:
            parts.append((held, k, []))
        own = plain if 2 * plain >= len(s) else 0
        parts[-1][2].append(max(plain, SURGE) if held else own)
    found = [(held, first + a, first + b, peak) for held, first, weights in parts for a, b, peak in surges(weights)]
    least = min(SURGE, max((peak for *_, peak in found), default=0))
    mass = lambda a, b: sum(plain for _, plain, _ in lines[a:b])
    inside = sum(mass(a, b) for held, a, b, _ in found if held)
    stands = lambda held, a, b, peak: held or (peak >= least and mass(a, b) >= inside)
    return "\n\n".join(s for held, a, b, peak in found if stands(held, a, b, peak) for s, _, _ in lines[a:b])


def with_main_text(pages: DataFrame) -> DataFrame:
    """Adds text to each row of pages from its whole html: empty for null, empty or wordless pages. Columns stay.

    A pages column named text is replaced. Repeated rows are read each; an empty table gives no rows.
    """

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return pages.withColumn("text", extract("html"))


def text_of_pages(pages: DataFrame) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars."""
    out = with_main_text(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
