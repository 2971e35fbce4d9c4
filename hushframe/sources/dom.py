"""Elements of stored HTML as rows, with the interval that each spans in its page."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML that have no end tag, whose content is no markup, that stand in lines of their own, and
# what a start tag ends where the end tag was left out (up to elements that keep it open).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe".split())
TEXT_ONLY = frozenset("textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre"
    " section table ul".split()
)
_CELL, _ROW, _GROUP = frozenset(("td", "th")), frozenset(("tr", "td", "th")), frozenset(("thead", "tbody", "tfoot", "tr", "td", "th"))
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (_CELL, frozenset(("tr", "table"))),
    "th": (_CELL, frozenset(("tr", "table"))),
    "tr": (_ROW, frozenset(("table",))),
    "thead": (_GROUP, frozenset(("table",))),
    "tbody": (_GROUP, frozenset(("table",))),
    "tfoot": (_GROUP, frozenset(("table",))),
}
_PARAGRAPH = (frozenset(("p",)), frozenset("table caption td th button object template".split()))
#: Where these begin or end, words end.
_APART = BLOCK | frozenset("br td th tr caption option select textarea button legend".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
#: A tag whose quotes don't pair ends at the next angle; without one, at the end of the page.
_UNPAIRED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
#: Characters of text that are kept of an element, own and inner.
MOST_TEXT = 600

ELEMENT = "start int, end int, depth int, parent int, prev int, children int, tag string, attrs map<string,string>, own string, inner string"
_FIELDS = [c.split()[0] for c in ELEMENT.split(", ")]


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def scan(page: str | None) -> list[list]:
    """The elements of a page in document order, in one pass with a stack: the fields of ELEMENT.

    start and end number the page's tags as they open and close (an end tag that was left out closes where its parent
    does, or a sibling begins), so that an element stands inside another if its interval does, and its first child
    opens at start + 1. parent and prev are the starts of the parent and of the element before under the same parent,
    -1 for none. Attributes have lower-case names; the first of a name counts; one without a value has an empty one.
    own is the element's own text, inner all text in it, white space made one space, cut at MOST_TEXT characters; blocks,
    cells and line breaks part words. Scripts, styles, templates and comments hold no text and no elements. End tags
    that nothing opened are ignored, and formatting elements that a block cut short are not opened again.
    """
    rows: list[list] = []
    stack: list[list] = []  # row, its parts of own text, and the start of its last child
    opened: Counter[str] = Counter()
    parts, length, spaced, clock, top = [], 0, True, 0, -1

    def text(raw: str) -> None:
        nonlocal length, spaced
        if not raw:
            return
        raw = html.unescape(raw) if "&" in raw else raw
        if stack:
            stack[-1][1].append(raw)
        words = " ".join(raw.split())
        if raw[0].isspace() and not spaced:
            words = " " + words
        if words and words != " " and raw[-1].isspace():
            words += " "
        if words:
            parts.append(words)
            length, spaced = length + len(words), words[-1] == " "

    def apart() -> None:
        nonlocal length, spaced
        if not spaced:
            parts.append(" ")
            length, spaced = length + 1, True

    def close() -> None:
        nonlocal clock
        row, own, _ = stack.pop()
        opened[row[6]] -= 1
        row[1], row[8], clock = clock, " ".join("".join(own).split())[:MOST_TEXT].rstrip(), clock + 1
        if row[6] in _APART:
            apart()
        row.append(length)

    def close_any(ended: frozenset, barrier: frozenset) -> None:
        if not any(opened[t] for t in ended):
            return
        for k in range(len(stack) - 1, -1, -1):
            tag = stack[k][0][6]
            if tag in barrier:
                return
            if tag in ended:
                # A row ends its cells too: the outermost of what is to end.
                while k and stack[k - 1][0][6] in ended:
                    k -= 1
                while len(stack) > k:
                    close()
                return

    page = page or ""
    at, n, missing = 0, len(page), set()
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        after = page[lt + 1 : lt + 4]
        if after == "!--":
            text(page[at:lt])
            stop = page.find("-->", lt + 4)
            at = n if stop < 0 else stop + 3
            continue
        if after[:1] in ("!", "?"):
            text(page[at:lt])
            stop = page.find(">", lt)
            at = n if stop < 0 else stop + 1
            continue
        m = _TAG.match(page, lt) or _UNPAIRED.match(page, lt)
        if m is None:
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if opened[tag]:
                while stack[-1][0][6] != tag:
                    close()
                close()
            continue
        if tag in BLOCK:
            close_any(*_PARAGRAPH)
        if tag in ENDS:
            close_any(*ENDS[tag])
        if tag in _APART:
            apart()
        parent, prev, top = -1, top, clock if not stack else top
        if stack:
            parent, prev = stack[-1][0][0], stack[-1][2]
            stack[-1][0][5] += 1
            stack[-1][2] = clock
        row = [clock, clock + 1, len(stack), parent, prev, 0, tag, _attributes(m[3]) if m[3] else {}, "", ""]
        rows.append(row)
        row.append(length)
        clock += 1
        if tag in VOID:
            clock += 1
            row.append(length)
            continue
        stack.append([row, [], -1])
        opened[tag] += 1
        if tag in RAW or tag in TEXT_ONLY:
            end = None if tag in missing else re.compile(f"</{tag}(?=[\\s/>])[^>]*+>", re.I).search(page, at)
            if end is None:
                missing.add(tag)
            if tag in TEXT_ONLY:
                text(page[at : end.start() if end else n])
            at = end.end() if end else n
            close()
    while stack:
        close()
    whole = "".join(parts)
    for row in rows:
        b, a = row.pop(), row.pop()
        row[9] = whole[a : min(b, a + MOST_TEXT + 1)].strip()[:MOST_TEXT].rstrip()
    return rows


def elements_of_html(pages: DataFrame, rows: int = 20_000) -> DataFrame:
    """page_id, url and the fields of ``scan`` for each element of pages (page_id, url, html). A null page has none."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[list] = []
        for b in batches:
            for page, url, text in zip(b["page_id"], b["url"], b["html"]):
                out += [[page, url, *r] for r in scan(text)]
                if len(out) > rows:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        yield pd.DataFrame(out, columns=names)

    names = ["page_id", "url", *_FIELDS]
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), "html").mapInPandas(emit, f"page_id {kind}, url string, {ELEMENT}")
