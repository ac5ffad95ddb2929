"""Text blocks of HTML pages: block tags, links of pages of contents, or the loose text of bodies without blocks.

Unclosed tags are closed as HTML says: a paragraph by any block, a list item by the next one, both by the end of what holds them.
Blocks stand in the order of their start tags; the text of a nested block belongs to the outer block too.

Nodes and texts know their places in the page. So a plan of what is to be translated names places, and what is written back changes
these only: everything else of the page stays as it was, character by character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape, unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.blocks import frames as small
from lexweave.functions.text import is_translatable

# Tags of blocks, tags without visible text, tags that end a loose paragraph; links of a page of contents at
# least, and characters of a body from which too few blocks count as none.
BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote")
HIDDEN = ("rt", "rp", "script", "style", "noscript")
SPLITS = ("address", "article", "aside", "div", "dl", "figure", "footer", "header", "main", "nav", "ol", "section", "table", "ul")
LINKS, SPARSE, COVERED = 3, 200, 0.2

#: Start tags that end an open paragraph.
_ENDS = (*SPLITS, *BLOCKS, "dt", "dd", "fieldset", "figcaption", "form", "hr", "pre", "tr", "td", "th")
_VOID = ("br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr")
_JAPANESE = re.compile("[\\u3040-\\u30ff\\u3400-\\u9fff]")


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)
    #: Where the start tag begins, where it ends, where the content ends, and where the end tag does.
    start: int = 0
    inner: int = 0
    end: int = 0
    after: int = 0

    def walk(self) -> Iterator[Node]:
        """This node and those below it, in the order of their start tags; a stack, since pages may nest very deeply."""
        stack: list[Node] = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def inside(self, others: set[int]) -> bool:
        up = self.parent
        while up and id(up) not in others:
            up = up.parent
        return up is not None


class Text(str):
    """A text of a page, and its place there."""

    start = end = 0


class _Tree(HTMLParser):
    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.html, self.root = html, Node("")
        self.at, self.text = self.root, None
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.feed(html)
        self.close()
        self._mark(len(html))
        self._ended(None, self.at, len(html))

    def _mark(self, at: int | None = None) -> int:
        """The place the parser has come to, where an open text ends."""
        if at is None:
            line, column = self.getpos()
            at = self.lines[line - 1] + column
        if self.text is not None:
            self.text.end, self.text = at, None
        return at

    def _ended(self, top: Node | None, node: Node | None, at: int, after: int = 0) -> None:
        """The contents of `node` and what is above it, up to but not `top`, end at `at`; the uppermost's end tag ends at `after`."""
        last = None
        while node is not top and node is not None:
            node.end = node.after = at
            last, node = node, node.parent
        if last is not None:
            last.after = max(at, after)

    def _close(self, tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        """Close the innermost open node of these tags, unless a node of `within` stands between."""
        node = self.at
        while node.parent and node.tag not in tags:
            if node.tag in within:
                return
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at, before = self._mark(), self.at
        if tag in _ENDS:
            self._close(("p",), ("td", "th", "div", "section", "blockquote", "li", "body"))
        if tag == "li":
            self._close(("li",), ("ul", "ol"))
        if tag in ("dt", "dd"):
            self._close(("dt", "dd"), ("dl",))
        self._ended(self.at, before, at)
        node = self._added(tag, attrs, at)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._added(tag, attrs, self._mark())

    def _added(self, tag: str, attrs: list, at: int) -> Node:
        past = at + len(self.get_starttag_text() or "")
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at, [], at, past, past, past)
        self.at.children.append(node)
        return node

    def handle_endtag(self, tag: str) -> None:
        at, before = self._mark(), self.at
        self._close((tag,), ("body",) if tag != "html" and tag != "body" else ())
        self._ended(self.at, before, at, self.html.find(">", at) + 1)

    def handle_data(self, data: str) -> None:
        at = self._mark()
        self.text = Text(data)
        self.text.start = self.text.end = at
        self.at.children.append(self.text)

    def handle_comment(self, data: str) -> None:
        self._mark()

    handle_decl = handle_pi = unknown_decl = handle_comment


def parsed(html: str) -> Node:
    return _Tree(html or "").root


def clean(value: str) -> str:
    """Spaces collapsed, none around line ends."""
    value = re.sub("[ \\t\\r\\f\\v]+", " ", value.replace("\xa0", " "))
    return re.sub(" *\\n+ *", "\n", value).strip()


def _pieces(top: Node | str, marked: bool) -> Iterator[str]:
    stack: list[Node | str] = [top]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            yield node
        elif node.tag in HIDDEN:
            continue
        elif marked and (node.attrs.get("lang") or node.attrs.get("xml:lang") or "").lower().startswith("ja"):
            own = "".join(p for c in node.children for p in _pieces(c, False)).strip()
            if own:
                yield f"[[ja:{own}]]"
        else:
            stack += reversed(node.children)


def visible_text(node: Node | str) -> str:
    """What a reader sees: no ruby readings or scripts, what is marked as Japanese in [[ja:...]]."""
    return clean("".join(_pieces(node, True)))


def compact(value: str) -> int:
    return len(re.sub("\\s+", "", value))


def _anchor(node: Node) -> str:
    """The first id, or name of a link, in a node."""
    return next((a for n in node.walk() if (a := n.attrs.get("id") or (n.attrs.get("name") if n.tag == "a" else ""))), "")


def contents_links(body: Node, tags: list[Node]) -> list[Node]:
    """Links of a page of contents: three or more with Japanese text, with more characters than the blocks; those in blocks left out."""
    links = [n for n in body.walk() if n.tag == "a" and "href" in n.attrs]
    texts = [(n, t) for n in links if compact(t := visible_text(n)) and _JAPANESE.search(t)]
    if len(texts) < LINKS or sum(compact(visible_text(t)) for t in tags) >= sum(compact(t) for _, t in texts):
        return []
    held = {id(t) for t in tags}
    return [n for n, _ in texts if not n.inside(held)]


def loose(body: Node, tags: list[Node]) -> bool:
    """A Japanese body whose blocks hold nothing, or next to nothing of it."""
    text = visible_text(body)
    n = compact(text)
    if not n or not _JAPANESE.search(text):
        return False
    covered = sum(compact(visible_text(t)) for t in tags)
    return not covered or n >= SPARSE and covered < COVERED * n and n - covered >= SPARSE


def segments(body: Node) -> list[tuple[str, str, str, int, int, str]]:
    """(tag, anchor, text, start, end, mode) of a body's loose text, cut at line breaks and blocks; images as rows without text.

    The mode is loose where the text has no element of its own, plain where it has one, image for images.
    """
    out: list[tuple[str, str, str, int, int, str]] = []
    parts: list[str] = []
    anchor, start, past = "", 0, 0

    def end() -> None:
        nonlocal parts, anchor
        if compact(text := clean("".join(parts))):
            out.append(("p", anchor, text, start, past, "loose"))
        parts, anchor = [], ""

    for child in body.children:
        if not isinstance(child, str) and child.tag == "br":
            end()
        elif not isinstance(child, str) and child.tag == "img":
            end()
            out.append(("img", child.attrs.get("id", ""), "", child.start, child.after, "image"))
        elif not isinstance(child, str) and child.tag in SPLITS:
            end()
            if compact(text := visible_text(child)):
                out.append(("p", _anchor(child), text, child.inner, child.end, "plain"))
            elif any(n.tag == "img" for n in child.walk()):
                out.append(("img", _anchor(child), "", child.start, child.after, "image"))
        elif isinstance(child, str) or child.tag not in HIDDEN:
            if not parts:
                start = child.start
            past = child.end if isinstance(child, str) else child.after
            if isinstance(child, str):
                parts.append(child)
            else:
                anchor = anchor or _anchor(child)
                parts.append(visible_text(child))
    end()
    return out


#: What the scanner takes for markup: comments, scripts and styles that are closed, declarations, tags; and tags that end a text.
_MARKUP = re.compile("<!--.*?-->|<(script|style)\\b[^>]*>.*?</\\1\\s*>|<[!?/a-zA-Z][^>]*>", re.S | re.I)
_BREAKS = re.compile(f"</?(?:br|{'|'.join((*SPLITS, *BLOCKS, 'body', 'html', 'head', 'title', 'td', 'th', 'tr', 'dt', 'dd'))})\\b", re.I)
_BODY = re.compile("<body\\b[^>]*>", re.I)


def scanned(html: str) -> list[tuple[str, str, str, int, int, str]]:
    """segments() of a page's texts read without a tree: all that is no markup, after the start of the body if there is one."""
    found = _BODY.search(html)
    at = start = past = found.end() if found else 0
    out: list[tuple[str, str, str, int, int, str]] = []
    parts: list[str] = []

    def end() -> None:
        if compact(text := clean("".join(parts))):
            out.append(("p", "", text, start, past, "loose"))
        parts.clear()

    for m in [*_MARKUP.finditer(html, at), None]:
        upto = m.start() if m else len(html)
        if upto > at:
            start = start if parts else at
            parts.append(unescape(html[at:upto]))
            past = upto
        if m is None or _BREAKS.match(m.group()):
            end()
        at = m.end() if m else upto
    end()
    return out


def lost(html: str, root: Node) -> list[tuple[str, str, str, int, int, str]]:
    """What scanned() finds where the tree has no visible text at all: an element that nobody closed has swallowed the page."""
    body = next((n for n in root.walk() if n.tag == "body"), root)
    return [] if compact(visible_text(body)) else scanned(html)


def page_blocks(html: str) -> list[tuple[str, str, str]]:
    """(tag, anchor, text) of a page's blocks in order; empty blocks are left out."""
    if not (html or "").strip():
        return []
    root = parsed(html)
    if rest := lost(html, root):
        return [s[:3] for s in rest]
    body = next((n for n in root.walk() if n.tag == "body"), root)
    tags = [n for n in root.walk() if n.tag in BLOCKS]
    links = contents_links(body, tags)
    if not links and loose(body, tags):
        return [s[:3] for s in segments(body) if s[2]]
    found = [(n.tag, _anchor(n), visible_text(n)) for n in [*tags, *links]]
    if not any(t for _, _, t in found):
        # a page without blocks, in whatever language: its lines
        return [s[:3] for s in segments(body) if s[2]]
    return [f for f in found if f[2]]


def blocks(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, tag, anchor, text) of each page's blocks."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in small(parts, "html"):
            rows = [(i, pos, tag, anchor, value) for i, html in part.itertuples(index=False) for pos, (tag, anchor, value) in enumerate(page_blocks(html))]
            yield pd.DataFrame(rows, columns=["id", "pos", "tag", "anchor", "text"])

    own = df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return own.mapInPandas(run, f"id {own.schema['id'].dataType.simpleString()}, pos int, tag string, anchor string, text string")


# --- plans and writing back --------------------------------------------------------------------------------------------

PLAN = "pos int, mode string, tag string, head string, start int, end int, text string"


def _texts(node: Node) -> Iterator[Text]:
    """All texts below a node, readings of ruby included, scripts and styles not."""
    stack: list[Node | str] = [node]
    while stack:
        top = stack.pop()
        if isinstance(top, Text):
            yield top
        elif top.tag not in ("script", "style"):
            stack += reversed(top.children)


def planned(html: str) -> list[tuple[str, str, str, int, int, str]]:
    """(mode, tag, head, start, end, text) of what a page offers for translation, in order.

    A block with several links gives a row for each of its texts (multi_anchor), one with one link keeps that link's start tag as head
    (single_anchor), any other is plain; pages without blocks give their loose texts and images. start and end are the place that a
    translation takes. Texts come without spaces around them; those that are blank are left out, images have none.
    """
    if not (html or "").strip():
        return []
    root = parsed(html)
    if rest := lost(html, root):
        return [(mode, tag, "", start, end, own) for tag, _, own, start, end, mode in rest]
    body = next((n for n in root.walk() if n.tag == "body"), root)
    tags = [n for n in root.walk() if n.tag in BLOCKS]
    links = contents_links(body, tags)
    out: list[tuple[str, str, str, int, int, str]] = []
    if links or not loose(body, tags):
        for node in [*tags, *links]:
            anchors = [n for n in node.walk() if n.tag == "a" and n is not node]
            if len(anchors) > 1:
                out += [("multi_anchor", node.tag, "", t.start, t.end, own) for t in _texts(node) if (own := t.strip())]
            elif own := visible_text(node):
                head = html[anchors[0].start : anchors[0].inner] if anchors else ""
                out.append(("single_anchor" if anchors else "plain", node.tag, head, node.inner, node.end, own))
    return out or [(mode, tag, "", start, end, own) for tag, _, own, start, end, mode in segments(body)]


def plan(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, mode, tag, head, start, end, text) of each page: planned() as rows. Null and blank pages have none."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in small(parts, "html"):
            rows = [(i, pos, *row) for i, html in part.itertuples(index=False) for pos, row in enumerate(planned(html))]
            yield pd.DataFrame(rows, columns=["id", *(c.split()[0] for c in PLAN.split(", "))])

    own = df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return own.mapInPandas(run, f"id {own.schema['id'].dataType.simpleString()}, {PLAN}")


def text_plan(found: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(id, seq, mode, tag, head, start, end, text): the translatable rows of plan() in order, then titles of contents (id, ord, title), unfiltered, as mode toc."""
    from pyspark.sql import Window

    own = found.where(is_translatable(F.col("text"))).select("id", F.struct(F.lit(0).alias("k"), F.col("pos").alias("p")).alias("o"), "mode", "tag", "head", "start", "end", "text")
    if titles is not None:
        nothing = [F.lit("").alias("tag"), F.lit("").alias("head"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")]
        own = own.unionByName(titles.select("id", F.struct(F.lit(1).alias("k"), F.col("ord").cast("int").alias("p")).alias("o"), F.lit("toc").alias("mode"), *nothing, F.col("title").alias("text")))
    return own.withColumn("seq", F.row_number().over(Window.partitionBy("id").orderBy("o")) - 1).select("id", "seq", "mode", "tag", "head", "start", "end", "text")


def estimate(found: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(texts, chars) of all visible blocks and titles, whether they need translation or not."""
    own = found.where("text <> ''").select("text")
    if titles is not None:
        own = own.union(titles.select("title"))
    return own.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


def replaced(html: str, edits: list[tuple[int, int, str, str, str]]) -> str:
    """The page with edits (start, end, mode, head, translation) in their places; what no edit names stays character by character.

    An edit of a whole block stands for all that is within: of such edits the outermost counts, and those of texts within it don't.
    Of edits of the same place the last counts.
    """
    whole = sorted((e for e in edits if e[2] != "multi_anchor"), key=lambda e: (e[0], -e[1]))
    nodes = sorted({(e[0], e[1]): e for e in edits if e[2] == "multi_anchor"}.values())
    kept: list[tuple[int, int, str, str, str]] = []
    for e in whole:
        if not kept or e[0] >= kept[-1][1]:
            kept.append(e)
        elif (e[0], e[1]) == kept[-1][:2]:
            kept[-1] = e
    out, at, free = [], 0, 0
    for start, end, mode, head, text in sorted([*kept, *nodes], key=lambda e: (e[0], -e[1], e[2] == "multi_anchor")):
        if start < free or start < at:
            continue
        own = escape(text, quote=False)
        own = f"{head}{own}</a>" if mode == "single_anchor" else f"<p>{own}</p>" if mode == "loose" else own
        out += [html[at:start], own]
        at = end
        free = max(free, end) if mode != "multi_anchor" else free
    return "".join([*out, html[at:]])


def written(pages: DataFrame, done: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, html): pages with the translations of done (id, seq, mode, head, start, end, text, translation) written into them.

    Rows without a translation, or with the text itself as one, change nothing; a page without others is passed on as it is. Titles of
    contents (mode toc) and images have no place in a page. A page's edits meet in one row with it, as many as it has texts.
    """
    own = done.where("mode not in ('toc', 'image') and translation <> '' and translation <> text")
    edits = own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "mode", "head", "translation"))).alias("edits"))
    met = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).join(edits, "id", "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("start", "end", "mode", "head", "translation")
        for part in small(parts, "html"):
            html = [h if h is None or e is None else replaced(h, [tuple(x[n] for n in names) for x in e]) for h, e in zip(part["html"], part["edits"], strict=True)]
            yield part[["id"]].assign(html=html)

    return met.mapInPandas(run, met.select("id", "html").schema)
