"""HTML extraction: layout-aware rendering of all visible text.

A tree builder keeps the stack of open elements, closing those that a new tag implies to end. Each element
inherits its visibility; text of visible ones flows into lines. Blocks keep their spacing, list items get
markers and indents, preformatted text keeps its white space, and the cells of a table are aligned in
columns. One pass over the source, without recursion; the places of open elements are kept by tag, so that
deep nesting costs no more than wide. Layout is bounded, text is not: beyond the indents, widths and depths
below, text is set apart by a plain separator, so that the output grows with the source alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A comment, a declaration, or a tag; quotes count after an equals sign only, and an open tag runs to the end.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+(?:>|\Z))", re.DOTALL
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag; the first are never shown.
RAW_HIDDEN = frozenset("script style noscript iframe noembed noframes xmp-hidden".split())
RAW_SHOWN = frozenset(("textarea", "title"))
HIDDEN = frozenset("head template datalist object audio video canvas".split()) | RAW_HIDDEN
#: Blocks with a blank line before and after, and those with a line break only.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure hr fieldset".split())
BROKEN = frozenset(
    "html body div section article header footer nav aside main address li dt dd tr caption center details summary form figcaption"
    " hgroup search legend dialog option optgroup listing xmp thead tbody tfoot".split()
)
CLOSES_P = (SPACED | BROKEN) - frozenset("html body li dt dd tr caption option optgroup thead tbody tfoot".split()) | {"li", "dt", "dd"}
#: A start tag ends the nearest open element of the first set, unless one of the second lies between.
IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir", "table"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "table"))),
    "optgroup": (frozenset(("optgroup", "option")), frozenset(("select", "table"))),
    "td": (frozenset(("td", "th", "caption")), frozenset(("table",))),
    "th": (frozenset(("td", "th", "caption")), frozenset(("table",))),
    "tr": (frozenset(("tr", "caption")), frozenset(("table",))),
    "thead": (frozenset(("thead", "tbody", "tfoot", "caption")), frozenset(("table",))),
    "tbody": (frozenset(("thead", "tbody", "tfoot", "caption")), frozenset(("table",))),
    "tfoot": (frozenset(("thead", "tbody", "tfoot", "caption")), frozenset(("table",))),
    "body": (frozenset(("head",)), frozenset()),
}
#: End tags don't reach beyond these.
BARRIERS = frozenset(("td", "th", "table", "caption"))
#: End tags of a table's parts stop at the table alone.
PARTS = frozenset("table tr td th thead tbody tfoot".split())
LISTS = frozenset("ul ol menu dir".split())

#: Bounds of the layout: characters of indent, of an aligned column and of a line's aligned part, and tables within tables.
MOST_INDENT, MOST_COLUMN, MOST_ALIGNED, MOST_NESTED = 64, 48, 240, 8
#: An aligned column takes two characters at least; those beyond can't be aligned.
MOST_COLUMNS = MOST_ALIGNED // 2


@dataclass
class Flow:
    """Lines of text in the making."""

    lines: list[str] = field(default_factory=list)
    indent: str = ""
    marker: str | None = None
    now: list[str] = field(default_factory=list)
    space: bool = False
    blank: bool = False

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if not s:
            return
        if s == " ":
            self.space = bool(self.now)
            return
        if self.now and (self.space or s[0] == " "):
            self.now.append(" ")
        self.space = s[-1] == " "
        self.now.append(s.strip(" "))

    def preformatted(self, s: str) -> None:
        first, *others = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.now.append(first)
        for line in others:
            self.end_line(True)
            self.now.append(line)

    def end_line(self, even_empty: bool = False) -> None:
        line = "".join(self.now).rstrip(" ")
        self.now, self.space = [], False
        if not line and not even_empty:
            return
        self.put(line)

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        lead = self.indent
        if self.marker is not None:
            lead, self.marker = lead[: max(0, len(lead) - len(self.marker))] + self.marker, None
        self.lines.append((lead + line).rstrip(" "))

    def apart(self) -> None:
        """Two spaces between what comes and what the line holds already."""
        if self.now:
            self.now.append("  ")
            self.space = False

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.blank = self.blank or spaced


@dataclass
class Cell:
    lines: list[str]
    across: int
    down: int


@dataclass
class Table:
    rows: list[list[Cell]] = field(default_factory=list)

    def placed(self) -> list[list[tuple[int, Cell]]]:
        """The rows with their cells' columns; columns that a cell above covers are passed over."""
        grid, until = [], {}  # by column: the first row that no cell from above covers
        for i, row in enumerate(self.rows):
            col, out = 0, []
            for cell in row:
                while until.get(col, 0) > i:
                    col += 1
                out.append((col, cell))
                if cell.down > 1:
                    until |= dict.fromkeys(range(col, min(col + cell.across, MOST_COLUMNS)), i + cell.down)
                col += cell.across
            grid.append(out)
        return grid

    def starts(self, grid: list[list[tuple[int, Cell]]]) -> list[int]:
        """Where columns start: as wide as their widest line, up to a bound; spanning cells widen the last they cover."""
        width, wide = {}, []
        for col, cell in (x for row in grid for x in row if x[0] < MOST_COLUMNS):
            need = max(map(len, cell.lines), default=0)
            if cell.across == 1:
                width[col] = min(max(width.get(col, 0), need), MOST_COLUMN)
            else:
                wide.append((col, min(col + cell.across, MOST_COLUMNS), need))
        for col, end, need in wide:
            have = sum(width.get(c, 0) + 2 for c in range(col, end)) - 2
            if need > have:
                width[end - 1] = min(width.get(end - 1, 0) + need - have, MOST_COLUMN)
        out, at = [], 0
        for c in range(max(width, default=-1) + 1):
            out.append(at)
            at += width[c] + 2 if c in width else 0
        return [x for x in out if x <= MOST_ALIGNED]

    def rendered(self) -> list[str]:
        """Rows of cells in columns; where a line has outgrown a column's start, two spaces stand between."""
        grid = self.placed()
        starts, lines = self.starts(grid), []
        for row in grid:
            made = [([], [0]) for _ in range(max((len(cell.lines) for _, cell in row), default=0))]
            for col, cell in row:
                for (parts, length), text in zip(made, cell.lines, strict=False):
                    if text:
                        gap = 2 if length[0] else 0
                        if col < len(starts):
                            gap = max(starts[col] - length[0], gap)
                        parts += (" " * gap, text)
                        length[0] += gap + len(text)
            lines += ["".join(parts).rstrip() for parts, _ in made]
        return lines


@dataclass
class Open:
    """An open element: what it hides, and what its end restores."""

    tag: str
    shown: bool = True
    visible: bool = True
    indent: str | None = None
    flow: bool = False
    table: Table | None = None
    count: int = 0
    ordered: bool = False
    cell: tuple[int, int] = (1, 1)
    closed_details: bool = False


def _span(value: str | None) -> int:
    m = re.match(r"\s*(\d{1,4})", value or "")
    return min(max(int(m[1]) if m else 1, 1), 1000)


class Renderer:
    def __init__(self) -> None:
        self.stack = [Open("")]
        #: By tag, the places of its open elements in the stack, rising.
        self.at: dict[str, list[int]] = {}
        self.flows = [Flow()]
        #: Shown open tables; None where tables are nested too deeply to be laid out.
        self.tables: list[Table | None] = []
        self.pre = 0
        self.blocks = 0

    @property
    def flow(self) -> Flow:
        return self.flows[-1]

    def nearest(self, tags: frozenset[str]) -> int:
        """The place of the innermost open element of some tags; 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def text(self, s: str) -> None:
        top = self.stack[-1]
        if not s or not top.shown or not top.visible:
            return
        if "&" in s:
            s = unescape(s)
        if top.tag in ("table", "tr", "thead", "tbody", "tfoot") and not s.strip():
            return
        if self.pre:
            self.flow.preformatted(s)
        else:
            self.flow.text(s)

    def implied(self, tag: str) -> None:
        """Close what a start tag implies to end."""
        if tag in IMPLIED:
            ended, stops = IMPLIED[tag]
            k = self.nearest(ended)
            if k > self.nearest(stops):
                self.pop_to(k)
        elif self.stack[-1].tag == "head" and tag not in HIDDEN | RAW_SHOWN | VOID - {"br", "hr", "img", "input"}:
            self.pop_to(len(self.stack) - 1)
        if tag in CLOSES_P and self.at.get("p"):
            k = self.at["p"][-1]
            if k > self.nearest(BARRIERS):
                self.pop_to(k)

    def start(self, tag: str, attributes: str) -> None:
        if tag == "html" or tag == "body" and self.at.get("body"):
            return
        self.implied(tag)
        up = self.stack[-1]
        found = {}
        if attributes.strip("/> \n"):
            for m in _ATTRIBUTE.finditer(attributes.rstrip(">")):
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        style = _SPACE.sub("", found.get("style", "").lower())
        shown = up.shown and tag not in HIDDEN and "hidden" not in found and "display:none" not in style
        if up.tag == "details" and up.closed_details and tag != "summary" or tag == "dialog" and "open" not in found:
            shown = False
        if tag == "title" and up.tag not in ("svg", ""):
            shown = False
        visible = up.visible
        if "visibility:" in style:
            visible = not re.search(r"visibility:(hidden|collapse)", style)
        if tag in VOID:
            if shown and visible:
                if tag == "br":
                    self.flow.end_line(bool(self.flow.now) or bool(self.flow.lines))
                elif tag == "hr":
                    self.flow.block(True)
                elif tag == "input" and found.get("type", "").lower() in ("submit", "button", "reset"):
                    self.flow.text(unescape(found.get("value", "")))
            return
        here = Open(tag, shown, visible, closed_details=tag == "details" and "open" not in found)
        inner = bool(self.nearest(LISTS))
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append(here)
        if shown:
            self.opened(here, found, inner)

    def opened(self, here: Open, found: dict[str, str], inner: bool) -> None:
        """The layout of a shown element's start."""
        tag = here.tag
        if tag in ("td", "th"):
            if self.tables and self.tables[-1] is None:
                self.flow.apart()
                return
            here.flow, here.cell = True, (_span(found.get("colspan")), _span(found.get("rowspan")))
            self.flows.append(Flow())
            return
        if tag in SPACED or tag in BROKEN:
            self.flow.block(tag in SPACED and not (tag in LISTS and inner))
            self.blocks += 1
        if tag == "table":
            here.table = Table() if len(self.tables) < MOST_NESTED else None
            self.tables.append(here.table)
        elif tag == "tr":
            if self.tables and self.tables[-1] is not None:
                self.tables[-1].rows.append([])
        elif tag in LISTS:
            here.ordered = tag == "ol"
            here.count = int(found["start"]) - 1 if re.fullmatch(r"-?\d{1,9}", found.get("start", "")) else 0
        elif tag == "li":
            lists, marker = self.stack[self.nearest(LISTS)], "- "
            if lists.ordered:
                lists.count = int(found["value"]) if re.fullmatch(r"-?\d{1,9}", found.get("value", "")) else lists.count + 1
                marker = f"{lists.count}. "
            self.indented(here, len(marker))
            self.flow.marker = marker
        elif tag in ("blockquote", "dd"):
            self.indented(here, 4)
        elif tag in ("pre", "textarea", "listing", "xmp"):
            self.pre += 1

    def indented(self, here: Open, by: int) -> None:
        here.indent = self.flow.indent
        self.flow.indent += " " * min(by, MOST_INDENT - len(self.flow.indent))

    def end(self, tag: str) -> None:
        if tag == "br":
            return self.start("br", "")
        if tag in ("html", "body"):
            return None
        own, stop = self.nearest(frozenset((tag,))), self.nearest(frozenset(("table",)) if tag in PARTS else BARRIERS)
        if own and own >= stop:
            return self.pop_to(own)
        if tag == "p" and not stop:
            self.flow.block(True)
        return None

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            here = self.stack.pop()
            tag = here.tag
            self.at[tag].pop()
            if here.shown:
                self.closed(here)

    def closed(self, here: Open) -> None:
        """The layout of a shown element's end."""
        tag = here.tag
        if here.flow:
            flow = self.flows.pop()
            flow.end_line()
            if not self.tables:
                for line in flow.lines:
                    self.flow.text(line + " ")
            else:
                t = self.tables[-1]
                if not t.rows:
                    t.rows.append([])
                t.rows[-1].append(Cell(flow.lines, *here.cell))
            return
        if tag in ("pre", "textarea", "listing", "xmp"):
            self.pre -= 1
        if tag in SPACED or tag in BROKEN:
            self.flow.end_line()
            if tag == "table":
                self.tables.pop()
                for line in here.table.rendered() if here.table else ():
                    self.flow.put(line)
            if tag == "li" and self.flow.marker is not None:
                self.flow.put("")
            self.flow.block(tag in SPACED and not (tag in LISTS and self.nearest(LISTS)))
        if here.indent is not None:
            self.flow.indent = here.indent


def rendered(html: str) -> tuple[str, int]:
    """The visible text, and the number of blocks in it."""
    r, at = Renderer(), 0
    find = _TAG.search
    while m := find(html, at):
        if m.start() > at:
            r.text(html[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            r.end(name)
            continue
        attributes = m[3]
        r.start(name, attributes)
        if name in RAW_HIDDEN or name in RAW_SHOWN:
            close = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(html, at)
            stop = close.start() if close else len(html)
            if name in RAW_SHOWN:
                r.text(html[at:stop])
            at = stop
    r.text(html[at:])
    r.pop_to(1)
    r.flow.end_line()
    return "\n".join(r.flow.lines), r.blocks


def extracted(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Every page's visible text: page_id, text, n_chars, n_lines, n_blocks.

    Null and empty pages have empty text. Broken markup never fails: unknown tags are inline, stray end tags
    are passed over, and an open comment, tag or script runs to the end. No depth, width or length of a page
    makes its text incomplete or its layout longer than a fixed multiple of the source. Repeated rows are
    rendered each. Extra columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [rendered(h) for h in pdf["html"]]
            yield pd.DataFrame({
                "page_id": pdf["page_id"].to_numpy(), "text": [g[0] for g in got], "n_chars": [len(g[0]) for g in got],
                "n_lines": [g[0].count("\n") + bool(g[0]) for g in got], "n_blocks": [g[1] for g in got],
            })

    rows = pages.select(F.col(key).alias("page_id"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return rows.mapInPandas(run, f"page_id {dict(rows.dtypes)['page_id']}, text string, n_chars long, n_lines long, n_blocks long")
