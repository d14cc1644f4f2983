"""HTML to Markdown: a tree built by the standard library's parser, written out by one walk; an Arrow UDF round it.

The converter never raises: unclosed and stray tags are closed or dropped as the tree is built.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that are dropped whole.
CRUFT = {"script", "style", "svg", "iframe", "button", "noscript", "head", "picture", "template"}
#: Elements that stand on lines of their own.
BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "nav", "figure", "aside", "body", "html", "table", "tr", "blockquote", "ul", "ol", "pre", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption"}
#: An opening tag closes an open element of these kinds.
CLOSES = {"p": {"p"}, "li": {"li"}, **{b: {"p"} for b in BLOCKS - {"p"}}}
#: Words in the class of a div that make it chrome.
CHROME = ("youtube-wrap", "subscribe-widget", "subscription-widget", "paywall", "like-button", "share-dialog")
#: Lines that are a newsletter's chrome, not text.
CHROME_LINE = re.compile(r"\s*(?:Subscribe now\s*|Thanks for reading.*|Share this post\s*)", re.I)
#: Round the number of a picture's place; HTML can't hold it, as it is removed before parsing.
MARK = "\x00"


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("root", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in CLOSES.get(tag, ()):
                del self.open[k:]
                break
            if self.open[k].tag in BLOCKS or self.open[k].tag == "li":
                break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < 400:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def plain(node: Node | str) -> str:
    if isinstance(node, str):
        return node
    return "\n" if node.tag == "br" else "".join(map(plain, node.children))


def captions(node: Node) -> list[Node]:
    found = []
    for c in node.children:
        if isinstance(c, Node):
            found += [c] if c.tag == "figcaption" else captions(c)
    return found


class Writer:
    """images: keep pictures, as Markdown; else only their captions. With numbered a picture is a mark, in order from 1."""

    def __init__(self, images: bool = False, numbered: bool = False):
        self.images, self.numbered, self.seen = images or numbered, numbered, 0

    def inline(self, nodes: list) -> str:
        out = []
        for n in nodes:
            if isinstance(n, str):
                out.append(re.sub(r"\s+", " ", n))
            elif n.tag in CRUFT:
                continue
            elif n.tag == "br":
                out.append("\n")
            elif n.tag == "img":
                if self.numbered:
                    self.seen += 1
                    out.append(f"{MARK}IMG{self.seen}{MARK}")
                elif self.images and n.attrs.get("src"):
                    out.append(f"![{n.attrs.get('alt', '')}]({n.attrs['src']})")
            elif n.tag in ("strong", "b", "em", "i"):
                mark, text = "**" if n.tag in ("strong", "b") else "*", self.inline(n.children)
                out.append(self.around(text, lambda t, m=mark: f"{m}{t}{m}"))
            elif n.tag == "code":
                out.append(f"`{plain(n)}`")
            elif n.tag == "a":
                text = re.sub(r"[ \t]{2,}", " ", self.inline(n.children).replace("\n", " "))
                href = n.attrs.get("href")
                if "image-link" in n.attrs.get("class", "") and not self.images:
                    continue
                out.append(self.around(text, lambda t, h=href: f"[{t}]({h})" if h is not None else t))
            else:
                out.append(self.inline(n.children))
        return "".join(out)

    @staticmethod
    def around(text: str, wrap) -> str:
        """Wraps the text; the space at its ends stays outside."""
        core = text.strip()
        if not core:
            return text
        return text[: len(text) - len(text.lstrip())] + wrap(core) + text[len(text.rstrip()) :]

    def items(self, node: Node, ordered: bool) -> str:
        lines, k = [], 0
        for c in node.children:
            if not isinstance(c, Node) or c.tag != "li":
                continue
            own = [x for x in c.children if not (isinstance(x, Node) and x.tag in ("ul", "ol"))]
            text = self.inline(own).strip()
            nested = [self.items(x, x.tag == "ol") for x in c.children if isinstance(x, Node) and x.tag in ("ul", "ol")]
            if not text and not any(nested):
                continue
            k += 1
            rows = [r for part in [text, *nested] for r in part.split("\n")]
            lines.append((f"{k}. " if ordered else "- ") + rows[0])
            lines += [f"  {r}" for r in rows[1:]]
        return "\n".join(lines)

    def blocks(self, nodes: list) -> list[str]:
        out: list[str] = []
        run: list = []

        def flush() -> None:
            text = self.inline(run).strip()
            run.clear()
            if text:
                out.append("\n".join(line.strip() for line in text.split("\n")))

        for n in nodes:
            if isinstance(n, str) or n.tag not in BLOCKS and n.tag not in CRUFT and not self.holds_block(n):
                run.append(n)
                continue
            if n.tag in CRUFT:
                continue
            flush()
            if n.tag == "hr":
                out.append("---")
            elif n.tag == "pre":
                code = plain(n).strip("\n")
                if code.strip():
                    out.append(f"```\n{code}\n```")
            elif n.tag in ("ul", "ol"):
                out.append(self.items(n, n.tag == "ol"))
            elif n.tag == "blockquote":
                out.append("\n".join(f"> {line}" if line.strip() else ">" for line in "\n\n".join(self.blocks(n.children)).split("\n")))
            elif re.fullmatch("h[1-6]", n.tag):
                text = self.inline(n.children).replace("\n", " ").strip()
                if text:
                    out.append(f"{'#' * int(n.tag[1])} {text}")
            elif n.tag == "div" and any(c in n.attrs.get("class", "") for c in CHROME):
                continue
            elif not self.images and (n.tag == "figure" or "captioned-image-container" in n.attrs.get("class", "")):
                out += [f"*{t}*" for t in (self.inline(c.children).strip() for c in captions(n)) if t]
            else:
                out += self.blocks(n.children)
        flush()
        return [b for b in out if b]

    def holds_block(self, node: Node) -> bool:
        return any(isinstance(c, Node) and (c.tag in BLOCKS or self.holds_block(c)) for c in node.children)


def to_markdown(html: str | None, images: bool = False) -> str | None:
    if html is None:
        return None
    text = "\n\n".join(Writer(images).blocks(parse(html.replace("\x00", "")).children))
    text = "\n".join(line.rstrip(" \t") for line in text.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip() + "\n"


def to_numbered(html: str | None) -> str | None:
    """Markdown with a mark for each picture, without chrome lines, zero-width spaces and byte order marks."""
    if html is None:
        return None
    clean = re.sub("[\u200b\ufeff]", "", html.replace(MARK, ""))
    text = "\n\n".join(Writer(numbered=True).blocks(parse(clean).children))
    text = "\n".join(line.rstrip(" \t") for line in text.split("\n") if not CHROME_LINE.fullmatch(line))
    return re.sub(r"\n{3,}", "\n\n", text).strip() + "\n"


def html_to_numbered_markdown(html: Column) -> Column:
    """Markdown of each row's HTML with marks for its pictures; null stays null."""

    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(to_numbered, na_action="ignore")

    return F.pandas_udf(convert, "string")(html)


def place_images(markdown: Column, images: Column) -> Column:
    """The marks replaced by Markdown of images, an array in order; marks beyond it, or of null elements, are removed."""
    shown = F.transform(images, lambda x, i: F.struct(F.concat(F.lit(f"{MARK}IMG"), (i + 1).cast("string"), F.lit(MARK)).alias("mark"), F.coalesce(x, F.lit("")).alias("md")))
    filled = F.aggregate(shown, markdown, lambda text, s: F.replace(text, s["mark"], s["md"]))
    return F.regexp_replace(filled, f"{MARK}IMG[0-9]+{MARK}", "")


def html_to_markdown(html: Column, images: bool = False) -> Column:
    """Markdown of each row's HTML; null stays null."""

    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda h: to_markdown(h, images), na_action="ignore")

    return F.pandas_udf(convert, "string")(html)


def decode_numeric_entities(text: Column) -> Column:
    """Decimal and hexadecimal character references; those that are no code point stay."""

    def one(m: re.Match) -> str:
        n = int(m[1][1:], 16) if m[1][0] in "xX" else int(m[1])
        return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]

    def decode(batch: pd.Series) -> pd.Series:
        return batch.map(lambda s: re.sub(r"&#([xX][0-9a-fA-F]{1,8}|[0-9]{1,9});", one, s), na_action="ignore")

    decode.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(decode, "string")(text)
