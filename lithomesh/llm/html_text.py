"""Visible text of HTML pages, laid out as blocks, lists and aligned tables.

``Builder`` reads tags and text and keeps the stack of open elements, closing
and opening those that tags imply, so that what it tells the layout is a
well-formed tree, start by start and end by end. ``Layout`` applies the
visibility rules and writes lines. Neither recurses, and open elements are found
by name, so both are linear in the page but for a logarithm of its depth. Output
is bounded by the page too: lines are indented by ``MOST_INDENT`` columns at most,
however deep they are, and a table's padding by ``PADDING`` times its own text; only
where columns as wide as their widest cells would take more, the widest cells do
not count for the width of their column.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithomesh.plans.session import prepare_workers

#: Columns that lines are indented by at most.
MOST_INDENT = 40
#: Padding of a table's cells, as a multiple of its text, beside a free part.
PADDING, FREE_PADDING = 16, 1 << 16

_TAG = re.compile(
    r"""<!--(?:.*?(?:-->|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_DECLARATION = re.compile(r"""([-\w]+)\s*+:((?:[^;"']++|"[^"]*+"?+|'[^']*+'?+)*+)""")

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("head script style noscript template iframe noembed noframes title audio video canvas datalist area rp desc metadata defs annotation annotation-xml".split())
BLOCK = frozenset("address article aside body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table ul blockquote caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table menu fieldset".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
#: End tags look for their element no further out than these.
SCOPE = ("td", "th", "caption", "table")
SCOPES = {name: ("table",) for name in "td th tr tbody thead tfoot caption".split()} | {"table": (), "li": ("ul", "ol", "menu", *SCOPE), "p": ("button", *SCOPE)}
#: A start tag ends the open elements on the left, up to the boundaries on the right.
IMPLIED_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select", "datalist")),
    "body": (("head",), ()),
}
HEAD_ONLY = frozenset("title meta link base style script noscript template".split())


def attributes(rest: str) -> dict[str, str]:
    """The first value of each attribute, with lower-case names."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return out


def declarations(style: str) -> dict[str, str]:
    """Properties of a style attribute in lower case, the last value of each."""
    out = {}
    for name, value in _DECLARATION.findall(_COMMENT.sub(" ", style)):
        out[name.lower()] = value.lower().replace("!important", "").strip()
    return out


class Flow:
    """Lines of one block container (the page, or a table cell)."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.indent = 0
        self.markers: list[tuple[int, str]] = []  # of list items without a line so far: column and marker
        self.gap = 0  # blank lines wanted before the next line
        self.spaced = True  # the line so far ends in a space or is empty
        self.exactly = False  # the line holds preformatted text

    def text(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if self.spaced:
            text = text.lstrip(" ")
        if text:
            self.line.append(text)
            self.spaced = text.endswith(" ")

    def exact(self, text: str) -> None:
        """Preformatted text: line breaks and spaces stay."""
        first, *more = text.split("\n")
        self.line.append(first)
        self.exactly = True
        for part in more:
            self.end_line(keep=True)
            self.line.append(part)
            self.exactly = True
        self.spaced = False

    def end_line(self, keep: bool = False) -> None:
        text = "".join(self.line)
        text = text.rstrip() if self.exactly else text.strip(" ")
        self.exactly = False
        self.line.clear()
        self.spaced = True
        if not text and not (keep and self.lines):
            return
        self.put(text)

    def put(self, text: str) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        prefix, beyond = " " * min(self.indent, MOST_INDENT), []
        for column, marker in self.markers:
            if column + len(marker) <= len(prefix):
                prefix = prefix[:column] + marker + prefix[column + len(marker) :]
            else:
                beyond.append(marker)
        self.markers.clear()
        self.lines.append((prefix + "".join(beyond) + text).rstrip())

    def item(self, marker: str) -> None:
        """Begin a list item: its marker goes before its first line, and its lines are indented by the marker's length."""
        self.markers.append((self.indent, marker))
        self.indent += len(marker)

    def space(self, lines: int) -> None:
        self.end_line()
        self.gap = max(self.gap, lines)

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Cells (lines, columns and rows spanned) as lines with columns aligned."""
    grid: list[tuple[dict[int, list[str]], set[int]]] = []  # cells with text by column, and those over several columns
    below: dict[int, int] = {}  # column: rows that a cell above still covers
    for row in rows:
        cells: dict[int, list[str]] = {}
        wide: set[int] = set()
        covered, below = below, {}
        at = 0
        for lines, columns, height in row:
            while at in covered:
                at += 1
            if lines:
                cells[at] = lines
            if columns > 1:
                wide.add(at)
            if height > 1:
                below |= dict.fromkeys(range(at, at + columns), height - 1)
            at += columns
        below |= {c: n - 1 for c, n in covered.items() if n > 1 and below.get(c, 0) < n - 1}
        if cells:
            grid.append((cells, wide))
    place = {c: k for k, c in enumerate(sorted({c for cells, _ in grid for c in cells}))}
    texts = sum(len(x) for cells, _ in grid for lines in cells.values() for x in lines)
    limit = max((len(x) for cells, _ in grid for lines in cells.values() for x in lines), default=0)
    ends = [(place[max(cells)], max(map(len, cells.values()))) for cells, _ in grid]
    while True:
        widths = [0] * len(place)
        for cells, wide in grid:
            for c, lines in cells.items():
                if c not in wide:
                    widths[place[c]] = max(widths[place[c]], *(len(x) for x in lines if len(x) <= limit), 0)
        before = [0]
        for w in widths:
            before.append(before[-1] + w + 3)
        if not limit or sum(before[end] * n for end, n in ends) <= FREE_PADDING + PADDING * texts:
            break
        limit //= 2
    out = []
    for cells, _ in grid:
        for k in range(max(map(len, cells.values()))):
            line, at = [], 0
            for c in sorted(c for c, lines in cells.items() if k < len(lines) and lines[k]):
                if limit:
                    line += [" " * widths[i] + " | " for i in range(at, place[c])]
                elif place[c]:
                    line.append(" | ")
                line.append(cells[c][k].ljust(widths[place[c]]))
                if place[c] + 1 < len(place):
                    line.append(" | ")
                at = place[c] + 1
            text = "".join(line)
            out.append(text[:-3].rstrip() if text.endswith(" | ") else text.rstrip())
    return out


class Layout:
    """Visible text of a tree told by starts, texts and ends."""

    def __init__(self):
        self.flows = [Flow()]
        self.tables: list[list[list]] = []
        self.open: list[dict] = [{"name": "", "seen": True, "shown": True, "pre": False, "list": None, "indent": 0}]

    def start(self, name: str, given: dict[str, str]) -> None:
        up, flow = self.open[-1], self.flows[-1]
        style = declarations(given["style"]) if given.get("style") else {}
        seen = up["seen"] and name not in UNSEEN and "hidden" not in given and style.get("display") != "none" and not (name == "dialog" and "open" not in given) and not (name == "object" and "data" in given)
        if up.get("closed") and name != "summary":
            seen = False  # of a closed details element only the summary shows
        shown = {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility"), up["shown"])
        own = {"name": name, "seen": seen, "shown": shown, "pre": up["pre"] or name in ("pre", "textarea", "xmp", "listing"), "list": up["list"], "indent": flow.indent, "given": given}
        if name == "details" and "open" not in given:
            own["closed"] = True
        self.open.append(own)
        if not seen:
            return
        if name == "br":
            flow.end_line(keep=True)
        elif name == "hr":
            flow.space(0)
        elif name == "table":
            flow.space(1)
            self.tables.append([])
        elif name == "tr" and self.tables:
            self.tables[-1].append([])
        elif name in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.flows.append(Flow())
            own["cell"] = True
        elif name in BLOCK:
            flow.space(1 if name in SPACED and not (name in ("ul", "ol") and up["list"]) else 0)
            if name in ("ul", "ol", "menu"):
                start = given.get("start", "1")
                own["list"] = {"next": (int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1) if name == "ol" else None}
            elif name == "li":
                kind = up["list"]
                if kind and kind["next"] is not None:
                    flow.item(f"{kind['next']}. ")
                    kind["next"] += 1
                else:
                    flow.item("- ")
            elif name in ("blockquote", "dd"):
                flow.indent += 2

    def text(self, text: str) -> None:
        top = self.open[-1]
        if top["seen"] and top["shown"] and not top.get("closed"):
            if top["name"] in ("table", "tr", "tbody", "thead", "tfoot") and not text.strip():
                return
            if top["pre"]:
                self.flows[-1].exact(text)
            else:
                self.flows[-1].text(text)

    def end(self) -> None:
        own = self.open.pop()
        name, flow = own["name"], self.flows[-1]
        if not own["seen"]:
            return
        if own.get("cell"):
            flow = self.flows.pop()
            span = [int(x) if (x := own["given"].get(k, "1")).isascii() and x.isdigit() and 0 < int(x[:9]) else 1 for k in ("colspan", "rowspan")]
            self.tables[-1][-1].append((flow.done(), min(span[0], 1000), min(span[1], 65534)))
        elif name == "table" and self.tables:
            for line in table_lines(self.tables.pop()):
                flow.put(line)
            flow.space(1)
        elif name in BLOCK:
            flow.space(1 if name in SPACED and not (name in ("ul", "ol") and self.open[-1]["list"]) else 0)
            flow.indent = own["indent"]
            while flow.markers and flow.markers[-1][0] >= flow.indent:
                flow.markers.pop()

    def done(self) -> str:
        while len(self.open) > 1:
            self.end()
        return "\n".join(self.flows[0].done())


class Builder:
    """Start and end tags in any order to a well-formed tree."""

    def __init__(self, layout: Layout):
        self.layout = layout
        self.open: list[str] = []
        self.at: dict[str, list[int]] = {}  # where in ``open`` each name is, outermost first

    def push(self, name: str, given: dict[str, str]) -> None:
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append(name)
        self.layout.start(name, given)

    def pop(self) -> None:
        self.at[self.open.pop()].pop()
        self.layout.end()

    def pop_to(self, place: int | None) -> None:
        """End the element at a place and what it holds."""
        while place is not None and len(self.open) > place:
            self.pop()

    def near(self, names: tuple, bounds: tuple) -> int | None:
        """Where the outermost open element of ``names`` is that no element of ``bounds`` holds apart."""
        floor = max((self.at[x][-1] for x in bounds if self.at.get(x)), default=-1)
        return min((own[bisect_right(own, floor)] for x in names if (own := self.at.get(x)) and own[-1] > floor), default=None)

    def start(self, name: str, given: dict[str, str]) -> None:
        if name in ("html", "body") and self.at.get(name):
            return
        if self.at.get("head") and name not in HEAD_ONLY and name not in ("head", "html"):
            self.pop_to(self.near(("head",), ()))
        if name in CLOSES_P and self.at.get("p"):
            self.pop_to(self.near(("p",), SCOPES["p"]))
        if name in IMPLIED_ENDS:
            self.pop_to(self.near(*IMPLIED_ENDS[name]))
        if name in ("td", "th") and self.at.get("table") and self.near(("tr",), ("table",)) is None:
            self.push("tr", {})
        self.push(name, given)
        if name in VOID:
            self.pop()

    def end(self, name: str) -> None:
        if name == "p" and self.near(("p",), SCOPES["p"]) is None:
            self.start("p", {})
        if name == "br":
            self.start("br", {})
        elif self.at.get(name) and name not in ("html", "body") and self.near((name,), SCOPES.get(name, SCOPE)) is not None:
            self.pop_to(self.at[name][-1])


def render(page: str | None) -> str:
    """All visible text of a page; null and empty pages give an empty text."""
    if not page:
        return ""
    layout = Layout()
    builder = Builder(layout)
    at, low = 0, None
    while (match := _TAG.search(page, at)) is not None:
        if match.start() > at:
            layout.text(html.unescape(page[at : match.start()]))
        at = match.end()
        name = match["name"]
        if name is None:
            if match[0].startswith("<![CDATA["):
                layout.text(match[0][9:-3])
            continue
        name = name.lower()
        if match["close"]:
            builder.end(name)
            continue
        rest = match["rest"]
        builder.start(name, attributes(rest) if rest.strip(" /\n\t") else {})
        if name in RAW and builder.open and builder.open[-1] == name:
            low = page.lower() if low is None else low
            stop = low.find(f"</{name}", at) if len(low) == len(page) else page.find(f"</{name}", at)
            stop = len(page) if stop < 0 else stop
            layout.text(html.unescape(page[at:stop]) if name in ("textarea", "title") else page[at:stop])
            at = stop
    if at < len(page):
        layout.text(html.unescape(page[at:]))
    return layout.done()


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id and ``text`` of each row.

    A null or empty page, or one without visible text, gives an empty text.
    Repeated rows and null ids stay as they are; an empty table gives an empty
    result; other columns are ignored. Markup that is not well-formed is never an
    error. Very long and very deep pages are rendered whole.
    """
    prepare_workers(pages.sparkSession, 256)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([render(x) for x in batch.column("html").to_pylist()], pa.string())], names=["id", "text"])

    named = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return named.mapInArrow(run, f"id {named.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_lines", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long"))
