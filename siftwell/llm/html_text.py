"""HTML extraction by layout-aware rendering.

A linear scanner splits a page into tags and text; a builder keeps the stack of open elements with
implied end tags and void elements; as elements open and close, a writer emits all visible text:
blocks on lines of their own, list items with their marks and indents, table cells aligned in
columns, ``pre`` kept as it is.

Invisible are head parts other than the title (returned apart), scripts, styles, templates,
comments, ``noscript`` (as in a browser that runs scripts), ``hidden`` elements, definitions and
descriptions in svg and math, and inline styles ``display:none`` or ``visibility:hidden`` (which a
descendant's ``visibility:visible`` ends).

Layout rules: lines are indented by at most ``MOST_INDENT`` blanks; a column is padded to at most
``WIDEST`` characters; a table with far more places than cells is not padded; a cell's own blocks
and tables become running text; a cell that spans rows holds its column in them. None of these
drops text.

A null page gives a null text and title; an empty one an empty text. Broken markup never fails:
an unmatched end tag is skipped, open elements close at the end, a lone ``<`` is text, and so is
what follows a ``<`` that no ``>`` ends. Repeated rows are repeated; extra columns are ignored. Work
is a page at a time and linear in it, so memory follows the largest page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.pages import attributes, scan

# Element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head script style template noscript title meta link base iframe object canvas audio video datalist noembed noframes".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split())
#: Parts of a drawing or formula that browsers do not show.
UNDRAWN = {"svg": set("title desc defs metadata symbol clippath mask marker pattern".split()), "math": {"annotation", "annotation-xml"}}
#: What leaves an open head open; other tags and text end it.
HEAD_PARTS = set("title meta link base style script noscript template".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure article section".split())
SECTIONS = {"thead", "tbody", "tfoot"}
#: An opening tag closes these when they are open inside the given scope.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    **dict.fromkeys(SECTIONS, (SECTIONS | {"tr", "td", "th", "caption", "colgroup"}, {"table"})),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "legend", "dialog", "li", "dd", "dt"}
SCOPE = {"table", "td", "th", "caption", "button", "html"}
#: End tags that reach through cells and tables.
FAR = SCOPE | SECTIONS | {"tr", "body"}
NOT_EMPTY = BLOCK | {"a", "span", "td", "th", "tr", "b", "i", "em", "strong"}
MOST_INDENT, WIDEST = 80, 60

GAPS = re.compile(r"[ \t\n\f\r]+")
WHITE = " \t\n\f\r"


class Writer:
    """Lines of text; a block asks for a fresh line, a spaced block for a blank one."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False
        self.indent = 0
        self.mark = self.pending = ""
        self.exact = False

    def text(self, value: str) -> None:
        value = GAPS.sub(" ", value)
        if self.pending and value != " ":  # what parts cells, once the next one has text
            value, self.pending = self.pending + value.lstrip(" "), ""
        if not self.line or self.line[-1].endswith((" ", "\n")):
            value = value.lstrip(" ")
        if value:
            self.line.append(value)

    def raw(self, value: str) -> None:
        for k, part in enumerate(value.split("\n")):
            if k:
                self.flush(keep=True)
            if part:
                self.line.append(part)
                self.exact = True

    def flush(self, keep: bool = False) -> None:
        text = "".join(self.line)
        text = text if keep or self.exact else text.strip(" ")
        self.line, self.exact = [], False
        if text or keep:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines.append(" " * (min(self.indent, MOST_INDENT) - len(self.mark)) + self.mark + text)
            self.mark = ""

    def space(self) -> None:
        self.flush()
        self.blank = True


def number(text: str | None, most: int) -> int | None:
    """A span: a whole number of any length, cut to ``most``."""
    return min(int(text.lstrip("0")[:9] or "0"), most) if text and text.isascii() and text.isdigit() else None


class Table:
    """Cells by row and column; a cell that spans rows keeps its columns from those below."""

    def __init__(self, flat: bool) -> None:
        self.flat, self.in_cell, self.any_cell = flat, False, False
        self.rows: list[list[tuple[int, str]]] = []
        self.column, self.outer = 0, None
        self.busy: dict[int, tuple[int, int]] = {}  # first column of a run: its end, the row that is free again
        self.last: tuple[int, int] = (-1, -1)  # first column and free row of the run that the last cell is in

    def new_row(self) -> None:
        self.rows.append([])
        self.column, self.last = 0, (-1, -1)

    def add(self, text: str, columns: int, rows: int | None) -> None:
        if not self.rows:
            self.new_row()
        row = len(self.rows) - 1
        while self.column in self.busy and self.busy[self.column][1] > row:
            self.column, self.last = self.busy[self.column][0], (-1, -1)
        self.rows[-1].append((self.column, text))
        free = row + rows if rows else 1 << 30
        begin, end = self.column, self.column + columns
        if free > row + 1:
            first = self.last[0] if self.last[0] >= 0 and self.last[1] == free and self.busy[self.last[0]][0] == begin else begin
            self.busy[first], self.last = (end, free), (first, free)
        self.column = end

    def lines(self) -> Iterator[str]:
        place = {c: k for k, c in enumerate(sorted({c for row in self.rows for c, _ in row}))}
        widths = [0] * len(place)
        for row in self.rows:
            for c, text in row:
                widths[place[c]] = max(widths[place[c]], min(WIDEST, len(text)))
        padded = sum(place[row[-1][0]] + 1 for row in self.rows if row) <= 8 * sum(map(len, self.rows)) + 64
        for row in self.rows:
            if not any(text for _, text in row):
                continue
            if padded:
                own = dict(row)
                line = " | ".join(own.get(c, "").ljust(w) for (c, k), w in zip(place.items(), widths, strict=True) if k <= place[row[-1][0]])
            else:
                line = " | ".join(text for _, text in row)
            yield line.rstrip(" |") if not row[-1][1] else line.rstrip()


class Open:
    """An open element and what its end has to restore."""

    __slots__ = ("name", "attrs", "gone", "veiled", "pre", "count", "indent", "cell")

    def __init__(self, name: str, attrs: dict[str, str]) -> None:
        self.name, self.attrs = name, attrs
        self.gone = self.veiled = self.pre = self.cell = False
        self.count = self.indent = 0


def styles(element: Open) -> dict[str, str]:
    parts = (d.partition(":") for d in element.attrs.get("style", "").lower().split(";"))
    return {k.strip(): v.replace("!important", "").strip() for k, _, v in parts}


class Page:
    """The stack of open elements, where each name is open, and the writer of the text."""

    def __init__(self) -> None:
        self.stack = [Open("#root", {})]
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.tables: list[Table] = []
        self.out = Writer()
        self.title: str | None = None

    # the builder
    def last(self, name: str) -> int:
        """Depth of the innermost open element of a name; 0 for none."""
        return self.at[name][-1] if self.at.get(name) else 0

    def push(self, name: str, attrs: dict[str, str]) -> None:
        element = self.entered(name, attrs)
        depth = len(self.stack)
        self.stack.append(element)
        self.at.setdefault(name, []).append(depth)
        if name in SCOPE:
            self.scopes.append(depth)

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            element = self.stack.pop()
            self.at[element.name].pop()
            if element.name in SCOPE:
                self.scopes.pop()
            self.left(element)

    def close(self, names: set[str], outer: int) -> None:
        """Close the outermost open element of the names deeper than ``outer``."""
        lowest = len(self.stack)
        for name in names:
            places = self.at.get(name, [])
            k = bisect_right(places, outer)
            if k < len(places):
                lowest = min(lowest, places[k])
        self.pop_to(lowest)

    def leave_head(self) -> None:
        """The implied end of head, unless a template or noscript in it is open."""
        head = self.last("head")
        if 0 < head < 4 and self.stack[-1].name not in ("template", "noscript"):
            self.pop_to(head)

    def text(self, value: str) -> None:
        if value.strip(WHITE):
            self.leave_head()
        self.show(html.unescape(value))

    def end(self, name: str) -> None:
        depth = self.last(name)
        if name == "p" and not depth:
            self.left(self.entered("p", {}))
        elif depth and (name in FAR or depth > (self.scopes[-1] if self.scopes else 0)):
            self.pop_to(depth)

    def start(self, name: str, inside: str) -> bool:
        """Open an element; whether its content is raw text."""
        if name not in HEAD_PARTS:
            self.leave_head()
        if name in CLOSES_P:
            self.close({"p"}, self.scopes[-1] if self.scopes else 0)
        if name in CLOSES:
            names, scope = CLOSES[name]
            self.close(names, max(map(self.last, scope)))
        attrs = attributes(inside) if inside else {}
        if any(name in names and self.last(of) for of, names in UNDRAWN.items()):
            attrs["hidden"] = ""
        if name in VOID or (inside.rstrip().endswith("/") and name not in NOT_EMPTY | RAW):
            self.left(self.entered(name, attrs))
            return False
        self.push(name, attrs)
        return name in RAW

    # the renderer
    def show(self, value: str) -> None:
        top = self.stack[-1]
        if top.gone or top.veiled:
            return
        if top.pre:
            self.out.raw(value)
        elif self.tables and not self.tables[-1].in_cell and top.name in SECTIONS | {"table", "tr", "colgroup"}:
            if value.strip(WHITE):  # text between cells comes before the table
                self.out.text(value)
                self.out.flush()
        else:
            self.out.text(value)

    def entered(self, name: str, attrs: dict[str, str]) -> Open:
        element, parent, out = Open(name, attrs), self.stack[-1], self.out
        element.gone, element.veiled, element.pre = parent.gone, parent.veiled, parent.pre or name in ("pre", "textarea")
        if "style" in attrs:
            style = styles(element)
            element.gone |= style.get("display") == "none"
            if "visibility" in style:
                element.veiled = style["visibility"] in ("hidden", "collapse")
        element.gone |= name in UNSEEN or "hidden" in attrs or (name == "input" and attrs.get("type", "").lower() == "hidden")
        if element.gone:
            return element
        element.indent = out.indent
        if name == "br":
            out.flush(keep=True)
        elif name == "hr":
            out.space()
        elif name == "img":
            if not element.veiled:
                out.text(attrs.get("alt", ""))
        elif name == "table":
            flat = bool(self.tables) and (self.tables[-1].in_cell or self.tables[-1].flat)
            self.tables.append(Table(flat))
            out.text(" ") if flat else out.space()
        elif name == "tr" and self.tables and not self.tables[-1].in_cell:
            self.tables[-1].new_row()
            self.tables[-1].any_cell = False
            if self.tables[-1].flat:
                out.pending = ""
                out.text(" ")
        elif name in ("td", "th") and self.tables and not self.tables[-1].in_cell:
            table = self.tables[-1]
            element.cell = table.in_cell = True
            if not table.flat:
                table.outer, self.out = out, Writer()
            elif table.any_cell:
                out.pending = " | "
            table.any_cell = True
        elif name == "li":
            out.flush()
            out.mark = "- "
            if parent.name == "ol":
                asked = attrs.get("value") if re.fullmatch(r"-?\d{1,9}", attrs.get("value", "")) else None
                parent.count = int(asked) if asked else parent.count + 1
                out.mark = f"{parent.count}. "
            out.indent += len(out.mark)
        elif name in BLOCK:
            if name == "ol":
                element.count = (int(attrs["start"]) if re.fullmatch(r"-?\d{1,9}", attrs.get("start", "")) else 1) - 1
            # a block that opens a list item stays on the item's line
            (out.space if name in SPACED and not out.mark and parent.name != "li" else out.flush)()
            if name in ("blockquote", "dd"):
                out.indent += 2
        return element

    def left(self, element: Open) -> None:
        name, out = element.name, self.out
        if element.gone:
            return
        if name == "table":
            table = self.tables.pop()
            if table.flat:
                out.pending = ""
                out.text(" ")
                return
            for line in table.lines():
                out.flush()
                out.line.append(line)
                out.exact = True
            out.space()
        elif element.cell:
            table = self.tables[-1]
            table.in_cell = False
            if table.flat:
                return
            out.flush()
            self.out = table.outer
            columns, rows = element.attrs.get("colspan"), element.attrs.get("rowspan")
            text = GAPS.sub(" ", " ".join(out.lines)).strip()
            spans = number(rows, 65534)
            table.add(text, number(columns, 1000) or 1, 1 if spans is None else spans)
        elif name == "li":
            out.flush()
            out.indent, out.mark = element.indent, ""
        elif name in BLOCK and name != "hr":
            (out.space if name in SPACED and self.stack[-1].name != "li" else out.flush)()
            out.indent = element.indent


def extract(text: str) -> tuple[str, str]:
    """(title, visible text) of a page."""
    page, parts = Page(), scan(text)
    for kind, value, inside, end in parts:
        if kind == "text":
            page.text(value)
        elif kind == "/":
            page.end(value)
        elif kind == "<" and page.start(value, inside):
            close = re.compile(rf"</{value}[\s/>]", re.I).search(text, end)
            stop = close.start() if close else len(text)
            raw = text[end:stop] if value in ("script", "style") else html.unescape(text[end:stop])
            if value == "title" and page.title is None and not page.last("svg"):
                page.title = GAPS.sub(" ", raw).strip()
            page.show(raw)
            page.pop_to(page.last(value))
            parts.send(stop)
    page.pop_to(1)
    page.out.flush()
    return page.title or "", "\n".join(line.rstrip() for line in page.out.lines).strip("\n")


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, title, text: a row for each page. Bytes that are no UTF-8 are read as U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                found = [(None, None) if page is None else extract(page) for page in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.string()) for x in zip(*found, strict=True))], names=["id", "title", "text"])

    source = pages.select(F.col(id_col).cast("long").alias("id"), F.make_valid_utf8(F.col(html_col).cast("string")).alias("html"))
    return source.mapInArrow(run, "id long, title string, text string").withColumnRenamed("id", id_col)
