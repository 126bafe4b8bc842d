"""HTML to Markdown that keeps everything a reader can see. Spark has no HTML parser: Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIDDEN = frozenset(("script", "style", "head", "template", "noscript"))
BLOCKS = frozenset("address article aside blockquote body dd div dl dt fieldset figure footer form header html main nav ol p pre section table tbody thead ul".split())
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}


class _Markdown(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.hidden, self.links, self.lists, self.cells, self.literal = base, [], [], [], [], 0, 0

    def _address(self, url: str | None) -> str:
        try:
            return urljoin(self.base, url or "")
        except ValueError:  # a malformed address stays as it is
            return url or ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag in HIDDEN:
            self.hidden.append(tag)
        elif tag == "body":  # an unclosed head ends here
            self.hidden.clear()
        if self.hidden:
            return
        if tag == "link" and "Category" in (a.get("rel") or ""):
            self.out.append(f"\nCategory: {a.get('href') or ''}\n")
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n")
        elif tag == "li":
            if self.lists:
                self.lists[-1][1] += 1
            mark = f"{self.lists[-1][1]}." if self.lists and self.lists[-1][0] == "ol" else "-"
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + mark + " ")
        elif tag == "a":
            self.links.append(self._address(a.get("href")) if a.get("href") else "")
            self.out.append("[" if self.links[-1] else "")
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]({self._address(a.get('src'))})")
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "tr":
            self.cells = 0
            self.out.append("\n|")
        elif tag in ("td", "th"):
            self.cells += 1
            self.out.append(" ")
        elif tag in MARKS and not self.literal:
            self.out.append(MARKS[tag])
        elif tag in BLOCKS:
            self.literal += tag == "pre"
            self.out.append("\n\n```\n" if tag == "pre" else "\n\n")

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag) :]
            return
        if tag == "a" and self.links:
            url = self.links.pop()
            self.out.append(f"]({url})" if url else "")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" |")
        elif tag in MARKS and not self.literal:
            self.out.append(MARKS[tag])
        elif tag in BLOCKS or tag[:1] == "h" and tag[1:] in tuple("123456"):
            closes = tag == "pre" and self.literal
            self.literal -= bool(closes)
            self.out.append("\n```\n\n" if closes else "\n\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data if self.literal else re.sub(r"[ \t\r\n]+", " ", data))


def markdown(html: str | None, base: str | None = None) -> str:
    """Scripts, styles and the head go; category links stay as lines; addresses become absolute against base. Null gives
    an empty text; unclosed tags don't lose text."""
    parser = _Markdown(base or "")
    parser.feed(html or "")
    parser.close()
    text = "".join(parser.out).replace("\xa0", " ")
    text = re.sub(r"(?m)^[ \t]+(?=[^\s\-0-9])", "", re.sub(r"[ \t]+\n", "\n", text))
    return re.sub(r"\n{4,}", "\n\n\n", text).strip()


def to_markdown(html: Column, base: Column) -> Column:
    return F.pandas_udf(lambda h, b: pd.Series([markdown(x, y) for x, y in zip(h, b)], dtype=object), T.StringType())(html, base)
