"""HTML to text by layout-aware rendering of whole pages.

A tokenizer feeds a tree builder that supplies implied tags (an open ``p`` ends before a block, ``li``, ``dd``, ``tr``,
``td`` and their like end each other, a cell outside a row opens one, content ends ``head``); a renderer walks the tree
with an explicit stack and emits all visible text: blocks on lines of their own, paragraphs and headings apart by an
empty line, lists with bullets or numbers and indentation, ``pre`` as it stands, tables with aligned columns.  Text in
a cell of more than ``FIELD`` characters a line is no field of a column: its row is printed without padding, the cells two
spaces apart or, if one has several lines, below each other, and so is a row whose columns reach beyond ``LINE``
characters.  Neither depends on the number of rows, and a line of a table has at most ``LINE`` characters of padding.

Invisible are ``head``, scripts, styles and other elements without a box, elements with ``hidden`` or ``display:none``,
closed ``details`` and ``dialog``, and text under ``visibility:hidden`` or ``collapse`` (a descendant may turn it
visible again).  Of ``display`` and ``visibility`` the last valid declaration counts, an important one before the others.

Of inline SVG the ``text`` elements are rendered, each on a line of its own, as are ``tspan`` placed by x or y and HTML
in ``foreignObject``; titles, descriptions, metadata and templates (``defs``, ``symbol``, ``marker``, ...) are not.

Each page is rendered by itself inside its Arrow batch; nothing is shuffled.

Defined cases: a null or empty page renders to the empty text; unclosed or stray tags, unclosed comments and
unfinished tags at the end are repaired as browsers do; elements nested deeper than ``DEPTH`` become siblings, so no
text is lost and no recursion overflows; an input column named ``text`` is replaced.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from roadtrace.llm.common import pieces, with_columns

DEPTH = 512
FIELD, LINE = 200, 1000
_SPACES = re.compile(r"[ \t\n\f\r]+")
_TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))",
                  re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

#: Parts of a style attribute: comments, strings, brackets, semicolons, the rest.
_CSS = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?|[()\[\]{};/]|[^()\[\]{};/\"']+", re.S)
_IMPORTANT = re.compile(r"\s*!\s*important\Z")
_VISIBILITY = re.compile(r"hidden|collapse|visible|initial|inherit|unset|revert|revert-layer|var\(.*\)", re.S)

#: A value without quotes at the end of a tag takes the slash with it.
_UNQUOTED_END = re.compile(r"=\s*[^\s\"'>]+\Z")


def _set(names: str) -> frozenset[str]:
    return frozenset(names.split())


# Element classes of the HTML standard.
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style xmp iframe noembed noframes textarea title")
HEAD_CONTENT = _set("base link meta noscript script style template title")
NO_BOX = _set("area audio base canvas col colgroup datalist embed head iframe link meta noembed noframes noscript object "
              "param script source style template title track video")
APART = _set("address blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul")
BLOCK = APART | _set("article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup "
                     "html legend li main menu nav optgroup option search section summary tbody tfoot thead tr")
ENDS_P = (BLOCK | _set("plaintext xmp")) - _set("body caption html legend optgroup option tbody tfoot thead tr")
CELL = _set("td th")
WALL = _set("button caption foreignobject html object table td template th")
#: In SVG: elements that draw nothing themselves, those that hold HTML, and the HTML tags that end it.
SVG_NO_BOX = _set("clippath defs desc filter lineargradient marker mask metadata pattern radialgradient script style symbol title")
SVG_HTML = _set("foreignobject desc title")
ENDS_SVG = _set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta "
                "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var")
#: Start tag: the open elements that it ends, and those at which the search stops.
ENDS = {
    "li": (_set("li"), _set("ol ul menu dir") | WALL), "option": (_set("option"), _set("select datalist") | WALL),
    "optgroup": (_set("option optgroup"), _set("select") | WALL), "tr": (_set("tr caption colgroup"), _set("table")),
    "tbody": (_set("tbody thead tfoot caption colgroup"), _set("table")), "rt": (_set("rt rp"), _set("ruby") | WALL),
} | dict.fromkeys(("dd", "dt"), (_set("dd dt"), _set("dl") | WALL)) | dict.fromkeys(("td", "th"), (CELL, _set("tr table")))
ENDS |= {"thead": ENDS["tbody"], "tfoot": ENDS["tbody"], "rp": ENDS["rt"]}


# Keywords of the display property besides ``none``.
DISPLAY = _set("block inline run-in flow flow-root table flex grid ruby math contents list-item inline-block inline-table "
               "inline-flex inline-grid table-row-group table-header-group table-footer-group table-row table-cell "
               "table-column-group table-column table-caption ruby-base ruby-text ruby-base-container ruby-text-container "
               "-webkit-box -webkit-inline-box -webkit-flex -webkit-inline-flex initial inherit unset revert revert-layer")


class Node:
    __slots__ = ("tag", "attrs", "children", "svg")

    def __init__(self, tag: str, attrs: dict[str, str], svg: int = 0):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.svg = svg  # 0: HTML, 1: in SVG, 2: in a text element of SVG


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(next(filter(None, values), "")))
    return out


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("html", {})
    stack = [root]

    def close(names: frozenset[str], walls: frozenset[str]) -> bool:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return True
            if stack[i].tag in walls:
                return False
        return False

    def open_(tag: str, attrs: dict[str, str], leaf: bool = False) -> Node:
        up = stack[-1].svg
        svg = (0 if tag in SVG_HTML else 2 if tag == "text" else up) if up else int(tag == "svg")
        node = Node(tag, attrs, svg)
        stack[-1].children.append(node)
        if not leaf and (len(stack) < DEPTH or (up == 1 and svg != 1)):
            stack.append(node)
        return node

    def text(raw: str) -> None:
        if raw:
            if stack[-1].tag == "head" and not raw.isspace():
                stack.pop()
            stack[-1].children.append(html.unescape(raw) if "&" in raw else raw)

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            return root
        text(page[at: m.start()])
        at = m.end()
        end, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if stack[-1].svg and page.startswith("<![CDATA[", m.start()):
                stop = page.find("]]>", m.start() + 9)
                stack[-1].children.append(page[m.start() + 9: stop if stop >= 0 else len(page)])
                at = stop + 3 if stop >= 0 else len(page)
            continue
        tag = tag.lower()
        if end:
            while tag in ("p", "br") and stack[-1].svg:
                stack.pop()
            if tag in ("p", "br"):  # without a start they make an empty paragraph and a line break
                if not (tag == "p" and close(_set("p"), WALL)):
                    open_(tag, {}, leaf=True)
            elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                close(_set("h1 h2 h3 h4 h5 h6"), WALL)
            elif tag not in ("html", "body"):
                close(frozenset((tag,)), frozenset() if tag in ("table", "tr", "tbody", "thead", "tfoot") else
                      _set("table") if tag in CELL else WALL - {tag})
            continue
        if tag == "html" or (tag == "body" and any(x.tag == "body" for x in stack)):
            root.attrs = root.attrs | _attributes(rest) if tag == "html" else root.attrs
            continue
        if stack[-1].tag == "head" and tag not in HEAD_CONTENT:
            stack.pop()
        if stack[-1].svg or tag == "svg":
            attrs = _attributes(rest)
            if tag in ENDS_SVG or (tag == "font" and not attrs.keys().isdisjoint(("color", "face", "size"))):
                while stack[-1].svg:
                    stack.pop()
            else:
                open_(tag, attrs, leaf=rest.endswith("/") and not _UNQUOTED_END.search(rest))
                continue
        if tag in ENDS_P:
            close(_set("p"), WALL)
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in CELL and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            open_("tr", {})
        attrs = _attributes(rest) if rest.strip(" /\n\t") else {}
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            node = open_(tag, attrs, leaf=True)
            raw = page[at: stop.start() if stop else len(page)]
            node.children.append(html.unescape(raw) if tag in ("textarea", "title") else raw)
            at = stop.start() if stop else len(page)
            if stop:
                at = _TAG.match(page, at).end()
        else:
            open_(tag, attrs, leaf=tag in VOID)


def _boxless(node: Node, parent: Node) -> bool:
    a = node.attrs
    display = _displayed(a["style"]) if a and "style" in a else None
    if parent.svg and (node.tag in SVG_NO_BOX or (node.svg and display is None
                                                  and a.get("display", "").strip().lower() == "none")):
        return True
    if node.tag in NO_BOX or (a and ("hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden"))):
        return True
    if display is False:
        return True
    return (node.tag == "dialog" and "open" not in a) or (parent.tag == "details" and "open" not in parent.attrs
                                                            and node.tag != "summary")


def _declared(style: str, name: str, valid) -> str | None:
    """The value of a property that counts in a style attribute: the last valid one, important ones first."""
    if name not in style.lower():
        return None
    declarations, depth = [[]], 0
    for t in _CSS.findall(style):
        depth = depth + 1 if t in "([{" else max(0, depth - 1) if t in ")]}" else depth
        if t == ";" and not depth:
            declarations.append([])
        else:
            declarations[-1].append(" " if t.startswith("/*") else t)
    found, fixed = None, False
    for d in declarations:
        mine, _, value = "".join(d).lower().partition(":")
        if mine.strip(" \t\n\f\r") != name:
            continue
        value = value.strip(" \t\n\f\r")
        m = _IMPORTANT.search(value)
        value = value[: m.start()] if m else value
        if (m or not fixed) and valid(value):
            found, fixed = value, bool(m)
    return found


def _visible(style: str, inherited: bool) -> bool:
    """Whether text shows under an element with this style attribute."""
    value = _declared(style, "visibility", _VISIBILITY.fullmatch)
    if value is None:
        return inherited
    return value not in ("hidden", "collapse") and (value in ("visible", "initial") or inherited)


def _is_display(value: str) -> bool:
    return value == "none" or value.startswith("var(") or (value != "" and all(x in DISPLAY for x in value.split()))


def _displayed(style: str) -> bool | None:
    """Whether a style attribute gives its element a box; None if it doesn't say."""
    value = _declared(style, "display", _is_display)
    return None if value is None else value != "none"


class Lines:
    """Text under construction: lines, indentation and the space and line breaks that still have to come."""

    def __init__(self):
        self.lines, self.line, self.breaks, self.space, self.indent, self.mark = [], [], 0, False, 0, ""

    def flush(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []

    def block(self, apart: int) -> None:
        """What follows starts a line, after ``apart`` - 1 empty ones."""
        self.flush()
        self.breaks, self.space = max(self.breaks, apart), False

    def put(self, s: str) -> None:
        if not self.line:
            if self.lines:
                self.lines += [""] * (self.breaks - 1)
            self.line.append(" " * max(0, self.indent - len(self.mark)) + self.mark)
            self.mark = ""
        elif self.space:
            self.line.append(" ")
        self.breaks, self.space = 0, False
        self.line.append(s)

    def text(self, s: str) -> None:
        words = _SPACES.sub(" ", s)
        if words.startswith(" "):
            self.space = bool(self.line)
        inner = words.strip(" ")
        if inner:
            self.put(inner)
            self.space = words.endswith(" ")

    def rows(self, rows: list[str]) -> None:
        for r in rows:
            if r:
                self.put(r)
                self.flush()
            else:
                self.flush()
                self.lines.append("")

    def done(self) -> list[str]:
        self.flush()
        return self.lines


def _grid(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (lines, columns, rows spanned) as lines with aligned columns."""
    placed, busy = [], {}
    for row in rows:
        out, col = {}, 0
        for lines, wide, high in row:
            while busy.get(col, 0):
                col += 1
            out[col] = lines
            for c in range(col, col + wide):
                busy[c] = high
            col += wide
        busy = {c: n - 1 for c, n in busy.items() if n > 1}
        placed.append(out)
    fields = [all(len(x) <= FIELD for lines in r.values() for x in lines) for r in placed]
    width: dict[int, int] = {}
    for r, ok in zip(placed, fields):
        for c, lines in r.items() if ok else ():
            width[c] = max(width.get(c, 0), *map(len, lines), 0)
    columns = [c for c in sorted(width) if width[c]]
    ends, at = {}, 0    # where a column ends
    for c in columns:
        ends[c] = at + width[c]
        at = ends[c] + 2
    out = []
    for r, ok in zip(placed, fields):
        held = [c for c in r if any(r[c])]
        if not ok or (held and ends[max(held)] > LINE):
            out += _unpadded(r)
            continue
        upto = columns[: bisect_right(columns, max(held))] if held else []
        for i in range(max((len(x) for x in r.values()), default=0)):
            cells = [(r.get(c) or [])[i: i + 1] or [""] for c in upto]
            out.append("  ".join(x[0].ljust(width[c]) for x, c in zip(cells, upto)).rstrip(" "))
    return out


def _unpadded(row: dict[int, list[str]]) -> list[str]:
    """A row without columns."""
    cells = [row[c] for c in sorted(row) if any(row[c])]
    return ["  ".join(c[0] for c in cells)] if all(len(c) == 1 for c in cells) else [x for c in cells for x in c]


def _span(node: Node, name: str) -> int:
    value = node.attrs.get(name, "1")
    return min(1000, max(1, int(value))) if value.isascii() and value.isdigit() else 1


def render(page: str | None) -> str:
    """All visible text of a page."""
    root = parse(page or "")
    out, tables, counters = [Lines()], [], []
    visible, pre = [True], [0]
    todo: list[tuple] = [(root, None, False)]
    while todo:
        node, parent, leaving = todo.pop()
        here = out[-1]
        if isinstance(node, str):
            if visible[-1] and parent.svg != 1 and (parent.tag != "details" or "open" in parent.attrs):
                if pre[-1]:
                    raw = node.replace("\r\n", "\n")
                    if parent.children[0] is node and parent.tag in ("pre", "textarea", "listing"):
                        raw = raw.removeprefix("\n")  # the first line break of the element is none of its text
                    first, *more = raw.split("\n")
                    if first:
                        here.put(first)
                    for x in more:
                        if here.line:
                            here.flush()
                        elif here.lines:
                            here.lines.append("")
                        if x:
                            here.put(x)
                else:
                    here.text(node)
            continue
        tag = f"svg:{node.tag}" if node.svg else node.tag
        placed = tag == "svg:text" or (tag == "svg:tspan" and ("x" in node.attrs or "y" in node.attrs)) or tag == "foreignobject"
        if leaving:
            visible.pop()
            if placed:
                here.block(1)
            pre.pop()
            if tag in ("ul", "ol", "menu", "dir"):
                counters.pop()
            if tag in ("li", "dd", "blockquote"):
                here.flush()
                here.indent -= node.attrs["\0"]
                here.mark = ""
            if tag in CELL and len(tables) and node.attrs.get("\0cell"):
                lines = out.pop().done()
                tables[-1][-1].append((lines, _span(node, "colspan"), _span(node, "rowspan")))
            elif tag == "table":
                grid = _grid(tables.pop())
                here.block(2)
                here.rows(grid)
                here.block(2)
            elif tag in BLOCK:
                here.block(2 if tag in APART and not (tag in ("ul", "ol") and counters) else 1)
            continue
        if parent is not None and _boxless(node, parent):
            continue
        style = node.attrs.get("style", "")
        if node.svg and "visibility" in node.attrs:
            style = f"visibility:{node.attrs['visibility']};{style}"
        visible.append(_visible(style, visible[-1]) if style else visible[-1])
        if placed:
            here.block(1)
        pre.append(1 if tag in ("pre", "textarea", "xmp", "listing") else pre[-1])
        todo.append((node, parent, True))
        if tag == "br":
            here.flush() if here.line else here.block(1)
            here.breaks = max(here.breaks, 1)
        elif tag == "table":
            here.block(2)
            tables.append([])
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag in CELL and tables:
            if not tables[-1]:
                tables[-1].append([])
            node.attrs = node.attrs | {"\0cell": "1"}
            out.append(Lines())
        elif tag in BLOCK:
            here.block(2 if tag in APART and not (tag in ("ul", "ol") and counters) else 1)
        if tag in ("ul", "ol", "menu", "dir"):
            start = node.attrs.get("start", "1")
            counters.append(int(start) if tag == "ol" and start.isascii() and start.isdigit() else 1 if tag == "ol" else None)
        elif tag in ("li", "dd", "blockquote"):
            mark = ""
            if tag == "li":
                mark = "- "
                if counters and counters[-1] is not None:
                    mark = f"{counters[-1]}. "
                    counters[-1] += 1
            deep = len(mark) or 2
            node.attrs = node.attrs | {"\0": deep}
            here.indent += deep
            here.mark = mark
        todo.extend((c, node, False) for c in reversed(node.children))
    lines = out[0].done()
    return "\n".join(lines).strip("\n")


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of every page with ``text``, all its visible text as laid out."""
    keep = pages.columns if keep is None else keep
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(html_col).alias("html"))
    result = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(result)

    def run(batches):
        for b in pieces(batches, 64):
            text = pa.array([render(x) for x in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type), text], schema=arrow)

    out = rows.mapInArrow(run, result)
    return out.select(*with_columns(out, {"text": F.col("text")}))
