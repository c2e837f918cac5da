"""Visible text of HTML pages, laid out as lines.

A page is cut into tags and text, a tree is built with the end tags that HTML implies, and the tree
is rendered: blocks start new lines, paragraphs, headings, lists and tables stand apart by a blank
line, list items get markers and indentation, cells of a table row stand side by side in
aligned columns, preformatted text keeps its spaces. All visible text is emitted, navigation and
footers included. Not visible are the head, scripts, styles, templates and the like, elements
with ``hidden`` or ``display: none``, text under ``visibility: hidden``, closed dialogs, and
closed details but for their summary.

Results for odd input: a null page has a null text, an empty one or one without visible text the
empty text; unclosed tags, stray end tags and broken markup never fail; depth is not limited, as
nothing recurses; rows are rendered one by one, so repeated rows and null keys make no difference;
an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes datalist object audio video canvas".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr menu dir xmp".split())
BLOCK = SPACED | frozenset(
    "html body div section article aside nav header footer main address form li dt dd tr td th caption thead tbody tfoot "
    "details summary dialog figcaption legend center option optgroup textarea search".split())
CLOSES_P = SPACED | frozenset("div section article aside nav header footer main address form li dt dd details summary center "
                              "figcaption dialog".split())
# Tags that a start tag closes, and those beyond which it does not look.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
# What an end tag may not close across.
BARRIER = {"li": {"ul", "ol", "table"}, "p": {"table", "td", "th"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}}
# A cell is padded to the width of its column, up to this width.
COLUMN = 60
GAP = "  "

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*+>?|</([A-Za-z][^\s/>]*+)[^>]*+>"
    r"|<([A-Za-z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>|<([A-Za-z][^\s/<>]*+)([^<>]*+)>", re.DOTALL)
# What hides the rest of a page in which no tag ends any more.
_OPEN_END = re.compile(r"<[!?]")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDES = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_VISIBILITY = re.compile(r"visibility\s*:\s*(\w+)", re.IGNORECASE)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if source and not source.isspace():
        for name, a, b, c in _ATTRIBUTE.findall(source):
            found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


class _Tree:
    """Open elements, with a count per tag so that absent ones are not searched for."""

    def __init__(self):
        self.root = Node("", {})
        self.open = [self.root]
        self.count: dict[str, int] = {}

    def pop(self) -> None:
        self.count[self.open.pop().tag] -= 1

    def close(self, tags, barrier) -> None:
        """Close up to the outermost of ``tags`` that lies before a barrier."""
        if not any(self.count.get(tag) for tag in tags):
            return
        at, found = len(self.open) - 1, None
        while at > 0 and self.open[at].tag not in barrier:
            if self.open[at].tag in tags:
                found = at
            at -= 1
        if found is not None:
            while len(self.open) > found:
                self.pop()

    def start(self, tag: str, attributes: dict[str, str], closed: bool) -> None:
        if tag in CLOSES_P:
            self.close({"p"}, {"table", "td", "th", "caption", "button"})
        if tag in CLOSED_BY:
            self.close(*CLOSED_BY[tag])
        node = Node(tag, attributes)
        self.open[-1].children.append(node)
        if not closed:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if not self.count.get(tag):
            return
        barrier, at = BARRIER.get(tag, ()), len(self.open) - 1
        while self.open[at].tag != tag:
            if self.open[at].tag in barrier:
                return
            at -= 1
        while len(self.open) > at:
            self.pop()


def build(source: str) -> Node:
    """The tree of a page; children are nodes and texts."""
    tree, at = _Tree(), 0
    # Beyond the last ">" no tag ends, so none is looked for: each search ends where its tag does.
    last = source.rfind(">") + 1
    while at < len(source):
        match = _TOKEN.search(source, at, last) if at < last else None
        hidden = match or _OPEN_END.search(source, max(at, last))
        if hidden is None or hidden.start() > at:
            tree.open[-1].children.append(html.unescape(source[at:hidden.start() if hidden else len(source)]))
        if match is None or match[0].startswith("<!--") and not match[0].endswith("-->"):
            break
        at = match.end()
        ended, name, attributes, loose, rest = match.groups()
        if ended:
            if ended.lower() == "br":
                tree.start("br", {}, True)
            else:
                tree.end(ended.lower())
        elif name or loose:
            tag, attributes = (name or loose).lower(), attributes if name else rest
            tree.start(tag, _attributes(attributes), tag in VOID)
            if tag in ("pre", "textarea"):  # a line end right after the tag does not count
                at += 2 if source.startswith("\r\n", at) else source.startswith("\n", at)
            if tag in RAW:
                stop = _RAW_END[tag].search(source, at)
                end = stop.start() if stop else len(source)
                text = source[at:end]
                tree.open[-1].children.append(html.unescape(text) if tag in ("textarea", "title") else text)
                at = end
                if not stop:
                    break
    return tree.root


class _Flow:
    """Text laid out as lines."""

    def __init__(self):
        self.out: list[str] = []
        self.breaks, self.space, self.indent, self.marker = 0, False, "", ""

    def break_(self, lines: int) -> None:
        self.space = False
        if self.out:
            self.breaks = max(self.breaks, lines)

    def put(self, text: str) -> None:
        if self.breaks or not self.out:
            self.out.append("\n" * self.breaks)
            self.out.append(self.indent[:len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent)
            self.breaks, self.marker = 0, ""
        elif self.space:
            self.out.append(" ")
        self.space = False
        self.out.append(text)

    def words(self, text: str) -> None:
        """Text with runs of white space as one space, and none at the edges of lines."""
        text = _SPACE.sub(" ", text)
        inside = text.strip(" ")
        if not inside:
            self.space = self.space or bool(text and self.out and not self.breaks)
            return
        if text[0] == " " and self.out and not self.breaks:
            self.space = True
        self.put(inside)
        self.space = text[-1] == " "

    def lines(self, text: str) -> None:
        """Preformatted text."""
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i and self.out:
                self.breaks += 1
            if line.strip():
                self.put(line)

    def text(self) -> str:
        return "".join(self.out)


def _number(value: str | None, otherwise: int) -> int:
    """A written whole number of less than ten digits."""
    return int(value) if value and re.fullmatch(r"-?[0-9]{1,9}", value.strip()) else otherwise


def _span(node: Node, name: str) -> int:
    value = node.attributes.get(name, "")
    return max(1, min(int(value), 1000)) if value.isdecimal() and len(value) < 10 else 1


def table_lines(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Rows of (text, columns, rows) as lines with the columns aligned."""
    placed, widths, taken = [], {}, {}
    for row in rows:
        column, cells = 0, []
        for text, wide, tall in row:
            while taken.get(column):
                taken[column] -= 1
                column += 1
            cells.append((column, text.split("\n")))
            if wide == 1:
                widths[column] = max(widths.get(column, 0), min(COLUMN, max(map(len, cells[-1][1]))))
            for c in range(column, column + wide):
                if tall > 1:
                    taken[c] = tall
            column += wide
        for c in list(taken):
            if c >= column or any(c == at for at, _ in cells):
                taken[c] = max(0, taken[c] - 1)
        placed.append(cells)
    starts, at = {}, 0
    for column in range(max((c for cells in placed for c, _ in cells), default=-1) + 1):
        starts[column] = at
        at += widths[column] + len(GAP) if widths.get(column) else 0
    made = []
    for cells in placed:
        for i in range(max((len(lines) for _, lines in cells), default=0)):
            line = ""
            for column, lines in cells:
                if i < len(lines) and lines[i]:
                    if line and len(line) + len(GAP) > starts[column]:
                        line += GAP
                    line = line.ljust(starts[column]) + lines[i]
            if line.strip():
                made.append(line.rstrip())
    return made


def _enters(node: Node, parent: Node) -> bool:
    if node.tag in HIDDEN or "hidden" in node.attributes:
        return False
    if node.tag == "dialog" and "open" not in node.attributes:
        return False
    if parent.tag == "details" and "open" not in parent.attributes and node.tag != "summary":
        return False
    return not _HIDES.search(node.attributes.get("style", ""))


class _Renderer:
    def __init__(self):
        self.flows, self.tables, self.lists = [_Flow()], [], []

    def enter(self, node: Node) -> None:
        flow, tag = self.flows[-1], node.tag
        if tag == "br":
            flow.space = False
            flow.breaks = min(flow.breaks + 1, 2) if flow.out else 0
            return
        if tag in BLOCK:
            flow.break_(2 if tag in SPACED and not (tag in ("ul", "ol") and self.lists) else 1)
        if tag in ("ul", "ol", "menu", "dir"):
            down = tag == "ol" and "reversed" in node.attributes
            first = sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if down else 1
            self.lists.append([tag, _number(node.attributes.get("start"), first), -1 if down else 1])
        elif tag == "li":
            mark = "- "
            if self.lists and self.lists[-1][0] == "ol":
                number = _number(node.attributes.get("value"), self.lists[-1][1])
                mark = f"{number}. "
                self.lists[-1][1] = number + self.lists[-1][2]
            flow.marker += mark
            flow.indent += " " * len(mark)
            self.lists.append(["li", len(mark)])
        elif tag in ("blockquote", "dd"):
            flow.indent += "  "
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.flows.append(_Flow())
            # A cell starts its own lists, and tables inside it are its own.
            self.lists.append(["cell", 0])

    def leave(self, node: Node) -> None:
        tag = node.tag
        if tag in ("td", "th") and self.tables:
            text = self.flows.pop().text()
            self.lists.pop()
            self.tables[-1][-1].append((text, _span(node, "colspan"), _span(node, "rowspan")))
            return
        flow = self.flows[-1]
        if tag in ("ul", "ol", "menu", "dir"):
            self.lists.pop()
        elif tag == "li":
            size = self.lists.pop()[1]
            flow.indent = flow.indent[:-size]
            flow.marker = flow.marker[:-size] if flow.marker else ""
        elif tag in ("blockquote", "dd"):
            flow.indent = flow.indent[:-2]
        elif tag == "table" and self.tables:
            for line in table_lines(self.tables.pop()):
                flow.break_(1)
                flow.put(line)
        if tag in BLOCK:
            flow.break_(2 if tag in SPACED and not (tag in ("ul", "ol") and self.lists) else 1)


def render(source: str) -> str:
    """The visible text of a page."""
    made = _Renderer()
    root = build(source)
    # (node, next child, shown, preformatted)
    stack = [[root, 0, True, False]]
    while stack:
        node, at, shown, pre = top = stack[-1]
        if at == len(node.children):
            stack.pop()
            if stack:
                made.leave(node)
            continue
        top[1] += 1
        child = node.children[at]
        if isinstance(child, str):
            if shown and not (node.tag == "details" and "open" not in node.attributes):
                (made.flows[-1].lines if pre else made.flows[-1].words)(child)
        elif _enters(child, node):
            style = child.attributes.get("style", "")
            visibility = _VISIBILITY.search(style) if style else None
            made.enter(child)
            stack.append([child, 0, shown if not visibility else visibility[1].lower() == "visible",
                          pre or child.tag in ("pre", "textarea", "xmp")])
    return made.flows[0].text()


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` as one struct ``row``, and the visible text of its column ``html`` as ``visible``."""
    packed = pages.select(F.struct(*pages.columns).alias("row"))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [None if s is None else render(s) for s in part.column(0).field(column).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], names=["row", "visible"])

    return packed.mapInArrow(run, T.StructType([*packed.schema.fields, T.StructField("visible", T.StringType())]))
