"""Web pages as articles."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# Tags without text, where a page's article begins, a paragraph's start and a tag, as loose as pages are.
_SKIPPED = {"script", "style", "iframe"}
_POST_BODY = re.compile(r'class="post_body"[^>]*>(.*?)</div>', re.S)
_PARAGRAPH = re.compile(r"<p[^>]*>")
_TAG = re.compile(r"<[^>]+>")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Paragraphs(HTMLParser):
    """Pieces of the texts of <p>, by the container they stand in: the first of each rank; the best is that of the lowest rank."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: dict[int, list[list[str]]] = {}
        self.open: list[tuple[str, int | None]] = []
        self.paragraph: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _VOID:
            return
        if tag == "p":
            self.paragraph = []
            for rank in {r for _, r in self.open if r is not None}:
                self.found[rank].append(self.paragraph)
        a = {k: v or "" for k, v in attrs}
        rank = 0 if "post_body" in a.get("class", "").split() else 1 if a.get("id") == "content" else 2 if tag == "article" else None
        if rank in self.found:
            rank = None
        elif rank is not None:
            self.found[rank] = []
        self.open.append((tag, rank))

    def handle_endtag(self, tag: str) -> None:
        if tag == "p":
            self.paragraph = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.paragraph is not None and data.strip() and not {t for t, _ in self.open} & _SKIPPED:
            self.paragraph.append(data.strip())


def _loose_paragraphs(page: str) -> Iterator[str]:
    """Texts between each paragraph's start and the next end tag, without markup, in the first post_body div up to its first end tag, or in the whole page."""
    div = _POST_BODY.search(page)
    for piece in (div[1] if div else page).split("</p>")[:-1]:
        if start := _PARAGRAPH.search(piece):
            yield " ".join(_TAG.sub("", piece[start.end() :]).split())


def _article(page: str | None) -> tuple[str, str]:
    page = page or ""
    parser = _Paragraphs()
    parser.feed(page)
    parser.close()
    best = parser.found[min(parser.found)] if parser.found else []
    texts = [" ".join(pieces) for pieces in best if pieces] or [t for t in _loose_paragraphs(page) if t]
    title, end, _ = page.partition("<title>")[2].partition("</title>")
    return title.strip().split("_")[0] if end else "", "\n".join(texts)


@F.pandas_udf(StructType().add("title", StringType()).add("body", StringType()))
def extract_article(pages: pd.Series) -> pd.DataFrame:
    """Title as it is written, up to its first underscore, and the paragraphs, their pieces joined by spaces, of the page's main container: class post_body, else id content, else <article>. Without a container, or if it has no text in paragraphs, see _loose_paragraphs."""
    return pd.DataFrame([_article(p) for p in pages], columns=["title", "body"])
