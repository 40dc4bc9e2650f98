"""HTML to markdown: a page's text with its headings, lists, links, emphasis, quotes, tables and code.

Tags are read in order against a stack of open ones, so that what stands in what is known at any depth; what a tag leaves
open is closed with it.  Navigation, scripts, styles, forms and advertisements are left out with all
that they hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPED = {"script", "style", "nav", "form", "noscript", "template", "iframe", "svg", "head", "button"}
BLOCKS = {"p", "div", "article", "section", "main", "header", "footer", "aside", "figure", "figcaption", "address", "dl", "dt", "dd", "body", "html", "details", "summary", "tr", "table", "ul", "ol", "li", "blockquote", "pre", "hr", *(f"h{n}" for n in range(1, 7))}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~"}
#: An open tag ends where one of these begins.
ENDED_BY = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, **dict.fromkeys(MARKS, BLOCKS)}
_ADVERT = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|sponsored|banner)(?:$|[\s_-])", re.IGNORECASE)
_ESCAPED = re.compile(r"([\\`*_\[\]])")


class _Node:
    """An open tag and the markdown of what it holds so far: finished blocks, and the line that goes on."""

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes = tag, attributes
        self.blocks: list[str] = []
        self.line: list[str] = []
        self.cells: list[str] = []
        self.rows: list[tuple[bool, list[str]]] = []

    def end_line(self) -> None:
        text = "\n".join(x.strip() for x in re.sub(r"[ \t\r\f]+", " ", "".join(self.line)).split("\n"))
        if text.strip():
            self.blocks.append(text.strip())
        self.line = []

    def text(self, gap: str = "\n\n") -> str:
        self.end_line()
        return gap.join(self.blocks)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [_Node("", {})]
        self.skipped = 0

    @property
    def top(self) -> _Node:
        return self.open[-1]

    def _within(self, *tags: str) -> bool:
        return any(n.tag in tags for n in self.open)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        attributes = {k: v or "" for k, v in attrs}
        if self.skipped:
            if tag not in VOID:
                self.open.append(_Node(tag, attributes))
                self.skipped += 1
            return
        while self.top.tag in ENDED_BY and tag in ENDED_BY[self.top.tag]:
            self._close()
        if tag == "br":
            self.top.line.append("\n")
        elif tag == "hr":
            self.top.end_line()
            self.top.blocks.append("---")
        elif tag == "img":
            if attributes.get("src"):
                self.top.line.append(f"![{attributes.get('alt', '')}]({attributes['src']})")
        elif tag not in VOID:
            if tag in BLOCKS:
                self.top.end_line()
            self.open.append(_Node(tag, attributes))
            if tag in SKIPPED or _ADVERT.search(f"{attributes.get('class', '')} {attributes.get('id', '')}"):
                self.skipped = 1

    def handle_endtag(self, tag: str) -> None:
        if any(n.tag == tag for n in self.open[1:]):
            while self.top.tag != tag:
                self._close()
            self._close()

    def handle_data(self, data: str) -> None:
        if self.skipped:
            return
        if self._within("pre"):
            self.top.line.append(data)
        elif self._within("code"):
            self.top.line.append(re.sub(r"\s+", " ", data))
        else:
            self.top.line.append(_ESCAPED.sub(r"\\\1", re.sub(r"\s+", " ", data)))

    def _close(self) -> None:
        node = self.open.pop()
        if self.skipped:
            self.skipped -= 1
            return
        tag, up = node.tag, self.top
        if tag == "pre":
            code = "".join(node.line).strip("\n")
            up.blocks.append(f"```\n{code}\n```")
        elif tag == "code" and not self._within("pre"):
            up.line.append(f"`{''.join(node.line).strip()}`")
        elif tag in MARKS and not self._within("pre", "code"):
            self._inline(node, MARKS[tag])
        elif tag == "a" and not self._within("pre", "code") and node.attributes.get("href"):
            text = node.text(" ")
            up.line.append(f"[{text}]({node.attributes['href'].replace(' ', '%20')})" if text else "")
        elif re.fullmatch("h[1-6]", tag):
            if text := node.text(" ").replace("\n", " "):
                up.blocks.append(f"{'#' * int(tag[1])} {text}")
        elif tag == "li":
            up.blocks.append(node.text("\n"))
        elif tag in ("ul", "ol"):
            node.end_line()
            marks = [f"{k}. " if tag == "ol" else "- " for k in range(1, len(node.blocks) + 1)]
            items = [m + b.replace("\n", "\n" + " " * len(m)) for m, b in zip(marks, node.blocks, strict=True)]
            if items:
                up.blocks.append("\n".join(items))
        elif tag == "blockquote":
            if text := node.text():
                up.blocks.append("\n".join(f"> {x}".rstrip() for x in text.split("\n")))
        elif tag in ("td", "th"):
            up.cells.append(node.text(" ").replace("\n", " ").replace("|", "\\|"))
            up.rows.append((tag == "th", []))
        elif tag == "tr":
            up.rows.append((any(head for head, _ in node.rows), node.cells))
        elif tag in ("thead", "tbody", "tfoot"):
            up.rows += node.rows
        elif tag == "table":
            up.blocks += [_table(node.rows)] if node.rows else node.blocks
        elif tag in BLOCKS:
            up.end_line()
            up.blocks += [node.text()] if node.text() else []
        else:
            up.line += node.line
            if node.blocks:
                up.end_line()
                up.blocks += node.blocks

    def _inline(self, node: _Node, mark: str) -> None:
        text = node.text(" ")
        held = "".join(node.line) or text
        self.top.line.append(f" {mark}{text}{mark} " if text else " " if held else "")

    def markdown(self) -> str:
        self.close()
        while len(self.open) > 1:
            self._close()
        text = re.sub(r"(\*\*|\*|~~) ([.,;:!?)])", r"\1\2", self.open[0].text())
        return text.strip()


def _table(rows: list[tuple[bool, list[str]]]) -> str:
    width = max(len(cells) for _, cells in rows)
    lines = ["| " + " | ".join(cells + [""] * (width - len(cells))) + " |" for _, cells in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def to_markdown(html: str | None) -> str | None:
    if html is None:
        return None
    reader = _Reader()
    reader.feed(html)
    return reader.markdown()


def markdown(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """key, markdown of each page; a null page stays null."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "markdown": [to_markdown(h) for h in batch[column]]})

    rows = pages.select(key, column)
    return rows.mapInPandas(task, f"{key} {rows.schema[key].dataType.simpleString()}, markdown string")
