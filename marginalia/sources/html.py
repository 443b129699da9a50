"""HTML to title and text: markup is cut into events, and one walk over them collects what a reader sees."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: tags that break lines, and tags whose content is not text
BLOCK_TAGS = frozenset(
    "p div br li ul ol h1 h2 h3 h4 h5 h6 tr td th table caption thead tbody tfoot section article header footer nav aside main blockquote pre dd dt dl figure figcaption".split()
)
SILENT_TAGS = frozenset(("script", "style", "noscript", "template"))
#: Silent tags with markup inside; of those opened more often than closed, the last one holds nothing.
MARKUP_TAGS = ("noscript", "template")
#: Tags whose content runs to their own end, whatever it looks like.
RAW_TAGS = ("script", "style", "textarea")
_MARKUP = re.compile(
    r"<!--.*?-->|<!--"  # a comment without an end is an empty one
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)[^>]*>"  # a quote that nothing closes
    r"|<[!?/][^>]*>|<[!?/A-Za-z][^>]*\Z",
    re.DOTALL,
)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE) for tag in RAW_TAGS}
OPEN, CLOSE, TEXT = "open", "close", "text"


def events(html: str) -> Iterator[tuple[str, str]]:
    """(kind, tag or text) through a page; tags in small letters, character references resolved in texts."""
    at = 0
    while found := _MARKUP.search(html, at):
        if found.start() > at:
            yield TEXT, unescape(html[at : found.start()])
        at = found.end()
        tag = (found["name"] or found["name2"] or "").lower()
        if not tag:
            continue
        if found["end"] or found["end2"]:
            yield CLOSE, tag
            continue
        yield OPEN, tag
        if found[0].endswith("/>"):
            yield CLOSE, tag
        elif tag in RAW_TAGS:
            over = _RAW_END[tag].search(html, at)
            yield TEXT, html[at : over.start() if over else len(html)] if tag in SILENT_TAGS else unescape(html[at : over.start() if over else len(html)])
            at = over.end() if over else len(html)
            if over:
                yield CLOSE, tag
    if at < len(html):
        yield TEXT, unescape(html[at:])


def hollow(page: list[tuple[str, str]]) -> set[int]:
    """Events that open an element which must not swallow the rest of the page."""
    seen, out = Counter(page), set()
    for tag in MARKUP_TAGS:
        if seen[OPEN, tag] > seen[CLOSE, tag]:
            out.add(max(i for i, event in enumerate(page) if event == (OPEN, tag)))
    return out


def html_text(html: str) -> tuple[str, str]:
    """(title, text): lines without outer white space, blank ones left out."""
    page = list(events(html))
    empty = hollow(page)
    silent: list[str] = []
    title, body, into_title = [], [], False
    for i, (kind, what) in enumerate(page):
        if kind == TEXT:
            if not silent:
                (title if into_title else body).append(what)
        elif what in SILENT_TAGS:
            if kind == CLOSE:
                silent[-1:] = []
            elif i not in empty:
                silent.append(what)
        elif what == "title":
            into_title = kind == OPEN and (into_title or not silent)
        elif what == "head" and kind == CLOSE:  # nothing that a head left open reaches into the body
            silent, into_title = [], False
        elif what in BLOCK_TAGS:
            body.append("\n")
            into_title &= kind == CLOSE  # a title that nothing closed ends where a block begins
        elif kind == OPEN and what in ("html", "body"):
            into_title = False
    rows = (row.strip() for row in "".join(body).splitlines())
    return "".join(title).strip(), "\n".join(filter(None, rows))


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
def extract_html(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([html_text(h or "") for h in html], columns=["title", "text"])
