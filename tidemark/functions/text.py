"""HTML to text, term counting."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements that begin and end a line, and elements whose text is not shown.
LINE_ELEMENTS = frozenset(("address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tr", "ul"))
UNSEEN_ELEMENTS = frozenset(("script", "style", "ix:hidden"))


class _Lines(HTMLParser):
    """Collects the visible words of a page line by line; the parser decodes all character references."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list[str]] = [[]]
        self.unseen: list[str] = []

    def _tag(self, name: str) -> None:
        if name in LINE_ELEMENTS and self.lines[-1]:
            self.lines.append([])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._tag(tag)
        if tag in UNSEEN_ELEMENTS:
            self.unseen.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._tag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._tag(tag)
        if tag in self.unseen:
            del self.unseen[self.unseen.index(tag) :]

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.lines[-1] += data.split()


def visible_text(html: str) -> str:
    """Words of a page, single-spaced, a line for each block; empty lines left out."""
    page = _Lines()
    page.feed(html)
    page.close()
    return "\n".join(" ".join(words) for words in page.lines if words)


@F.arrow_udf(StringType())
def _visible(pages: pa.Array) -> pa.Array:
    return pa.array([visible_text(p.as_py()) if p.is_valid else None for p in pages], pa.string())


def html_to_text(html: Column) -> Column:
    """Visible text: scripts, styles and hidden facts dropped, blocks as lines, all character references decoded."""
    return _visible(html)


def count_hits(text: Column, term: Column | str) -> Column:
    """Non-overlapping occurrences of a non-empty term."""
    term = F.lit(term) if isinstance(term, str) else term
    gone = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return (gone / F.length(term)).cast("long")
