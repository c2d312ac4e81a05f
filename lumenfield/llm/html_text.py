"""Text of HTML pages as a reader would see it.

A lexer feeds a tree builder, which keeps the stack of open elements, adds the tags that a page may leave out (an open
paragraph ends where a block begins, a row or cell where the next one does, a cell gets its row) and drops end tags that
match nothing. The elements are laid out as they open and close: invisible subtrees are skipped, white space collapses
except in preformatted text, blocks begin on a line of their own, paragraphs and the like with a blank line, list items
get their marker and indentation, and the cells of a table are padded to the width of their column.

All visible text is kept, navigation and the like included. Nothing recurses, so nesting may be as deep as a page wants.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import with_arrow

# HTML's element names by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes xmp textarea title".split())
INVISIBLE = frozenset("head script style title template noscript iframe noembed noframes datalist object audio video canvas".split())
#: What a head may hold; any other start tag, or text, ends an open one.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Inside svg and math: what isn't drawn where it stands, where HTML begins again, and the HTML tags that end both.
UNDRAWN = frozenset("annotation annotation-xml clippath defs desc filter lineargradient marker mask metadata pattern radialgradient symbol".split())
INTEGRATION = frozenset("annotation-xml desc foreignobject mi mn mo ms mtext title".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section summary table tbody tfoot thead tr ul".split())
MARGIN = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 menu ol p pre table ul".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("table td th caption html template button object".split())
#: Opening the key ends the innermost open one of the first set, unless one of the second set is nearer.
ENDS = {
    "li": (frozenset(["li"]), SCOPE | {"ul", "ol", "menu", "dir"}),
    "dt": (frozenset(["dt", "dd"]), SCOPE | {"dl"}),
    "dd": (frozenset(["dt", "dd"]), SCOPE | {"dl"}),
    "option": (frozenset(["option"]), SCOPE | {"select", "datalist"}),
    "optgroup": (frozenset(["option", "optgroup"]), SCOPE | {"select"}),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr", "html", "template"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr", "html", "template"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table", "html", "template"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table", "html", "template"])),
} | {h: (HEADINGS, SCOPE | {"div", "section", "article"}) for h in HEADINGS}
ENDS |= {"thead": ENDS["tbody"], "tfoot": ENDS["tbody"], "caption": ENDS["tbody"]}

#: A column is padded to its widest line, but to no more than this; longer lines stick out.
PAD = 40

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)>""")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_SPACES = re.compile(r"[ \t\n\f\r]+")
_FOUND = re.compile(r"(?i)hidden|style|colspan|rowspan|start|type|display")
_HIDDEN = re.compile(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))")


class Writer:
    """Lays out text: pending gaps, collapsed spaces, indentation and markers."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.gap, self.space, self.indent, self.marker = 0, False, "", ""
        self.fresh = True  # nothing on this line yet

    def brk(self, lines: int) -> None:
        """At least so many line ends before what comes next."""
        self.space = False
        if self.parts:
            self.gap = max(self.gap, lines)
            self.fresh = True

    def hard(self) -> None:
        self.space = False
        if self.parts:
            self.gap += 1
            self.fresh = True

    def _open(self) -> None:
        if self.fresh:
            self.parts.append("\n" * self.gap + (self.marker or self.indent))
            self.gap, self.fresh, self.marker = 0, False, ""

    def text(self, s: str) -> None:
        s = _SPACES.sub(" ", s)
        if s == " " or not s:
            self.space = self.space or bool(s) and not self.fresh
            return
        glue = (self.space or s[0] == " ") and not self.fresh
        self._open()
        self.parts.append((" " if glue else "") + s.strip(" "))
        self.space = s[-1] == " "

    def raw(self, s: str) -> None:
        for k, line in enumerate(s.replace("\r\n", "\n").split("\n")):
            if k:
                self.hard()
            if line:
                self._open()
                self.parts.append(line)

    def lines(self, some: list[str]) -> None:
        for line in some:
            self.brk(1)
            self._open()
            self.parts.append(line)
        self.brk(1)

    def result(self) -> str:
        return "".join(self.parts)


class Table:
    """Cells by row and column, as colspan and rowspan place them."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.busy: list[tuple[int, int, int]] = []  # columns [from, to) that cells above reach into, and for how many rows
        self.below: list[tuple[int, int, int]] = []
        self.at, self.passed = 0, 0  # next column, and how many of busy end before it

    def row(self) -> None:
        self.busy = sorted([(a, b, n - 1) for a, b, n in self.busy if n > 1] + self.below)
        self.below, self.at, self.passed = [], 0, 0
        self.rows.append([])

    def cell(self, text: str, span: int, down: int) -> None:
        if not self.rows:
            self.row()
        while self.passed < len(self.busy) and self.busy[self.passed][0] <= self.at:
            self.at = max(self.at, self.busy[self.passed][1])
            self.passed += 1
        if down > 1:
            self.below.append((self.at, self.at + span, down - 1))
        self.rows[-1].append((self.at, span, text.split("\n") if text else []))
        self.at += span

    def result(self) -> list[str]:
        """Lines in which a column begins at the same place in every row; a column that no cell begins has no width."""
        width = {at: 0 for row in self.rows for at, _, _ in row}
        for row in self.rows:
            for at, span, lines in row:
                if span == 1:
                    width[at] = max(width[at], min(PAD, max(map(len, lines), default=0)))
        begin, total = {}, 0
        for at in sorted(width):
            begin[at] = total
            total += width[at] + 2
        out = []
        for row in self.rows:
            for k in range(max((len(c[2]) for c in row), default=0)):
                parts, size = [], 0
                for at, _, lines in row:
                    if k < len(lines) and lines[k]:
                        gap = max(begin[at] - size, 2 if size else 0)
                        parts.append(" " * gap + lines[k])
                        size += gap + len(lines[k])
                out.append("".join(parts).rstrip())
        return out


class Page:
    """The tree builder, and what it lays out."""

    def __init__(self) -> None:
        self.stack: list[str] = []
        self.open: Counter[str] = Counter()
        self.foreign: list[bool] = []  # for each open element: whether its children are svg's or math's own
        self.hidden = -1  # stack size at which an invisible subtree began
        self.writers = [Writer()]
        self.tables: list[Table] = []
        self.spans: list[tuple[int, int]] = []
        self.lists: list[int | None] = []  # the next number, None: bullets
        self.pre = 0

    def _end_nearest(self, some: frozenset[str], stop: frozenset[str]) -> None:
        if not any(self.open[t] for t in some):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i] in some:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i] in stop:
                return

    def _end_head(self) -> None:
        while self.stack and self.stack[-1] == "head":
            self._pop()

    def start(self, tag: str, attributes: str) -> bool:
        """Opens an element; whether what follows is raw text."""
        if tag in ("html", "head") and len(self.stack) > (self.open["html"] if tag == "head" else 0):
            return False  # a page has one of each
        if tag not in HEAD:
            self._end_head()
        if tag in BREAKOUT:
            while self.foreign and self.foreign[-1]:
                self._pop()
        if self.foreign and self.foreign[-1]:
            self._push(tag, attributes)
            piece = attributes.rsplit(None, 1)[-1] if attributes.endswith("/") else ""
            if piece and ("=" not in piece or piece[-2:-1] in "\"'="):
                self._pop()
            return False
        if tag in ENDS_P and self.open["p"]:
            self._end_nearest(frozenset(["p"]), SCOPE)
        if tag in ENDS:
            self._end_nearest(*ENDS[tag])
        if tag in ("td", "th") and self.open["table"] and not self._inside("tr"):
            self._push("tr", "")
        self._push(tag, attributes)
        if tag in VOID:
            self._pop()
        return tag in RAW

    def _inside(self, tag: str) -> bool:
        for t in reversed(self.stack):
            if t == tag:
                return True
            if t == "table":
                return False
        return False

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif tag not in VOID and self.open[tag]:
            barrier = frozenset() if tag in SCOPE | {"tr", "tbody", "thead", "tfoot", "body"} else frozenset(["table", "td", "th", "caption"])
            self._end_nearest(frozenset([tag]), barrier)

    def text(self, s: str) -> None:
        if self.stack and self.stack[-1] == "head" and s.strip(" \t\n\f\r"):
            self._end_head()
        if self.hidden < 0 and s:
            w = self.writers[-1]
            w.raw(s) if self.pre else w.text(s)

    def _push(self, tag: str, attributes: str) -> None:
        inner = bool(self.foreign) and self.foreign[-1]
        self.stack.append(tag)
        self.foreign.append(tag in ("svg", "math") or inner and tag not in INTEGRATION)
        self.open[tag] += 1
        if self.hidden >= 0:
            return
        found = {}
        if attributes and _FOUND.search(attributes):
            for m in _ATTRIBUTE.finditer(attributes):
                found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        if tag in INVISIBLE or ("hidden" in found and found["hidden"].lower() != "until-found") or _HIDDEN.search(found.get("style", "")) or inner and (tag in UNDRAWN or found.get("display") == "none" or found.get("visibility") in ("hidden", "collapse")):
            self.hidden = len(self.stack)
            return
        w = self.writers[-1]
        if inner:
            if tag == "text":
                w.brk(1)  # drawn at a place of its own
            return
        if tag == "br":
            w.hard()
        elif tag == "table":
            w.brk(2)
            self.tables.append(Table())
        elif tag == "tr" and self.tables:
            self.tables[-1].row()
        elif tag in ("td", "th") and self.tables:
            span, down = (found.get(name, "1").strip() for name in ("colspan", "rowspan"))
            down = int(down) if down.isdecimal() and down.isascii() else 1
            # a rowspan of 0 reaches to the end of the table
            self.spans.append((max(1, min(1000, int(span))) if span.isdecimal() and span.isascii() else 1, min(down or 65534, 65534)))
            self.writers.append(Writer())
            self.lists.append(None)  # a cell's lists begin anew
        elif tag in BLOCK:
            w.brk(2 if tag in MARGIN and not (tag in ("ul", "ol", "menu") and self._in_list()) else 1)
        if tag in ("ul", "ol", "menu", "dir"):
            first = found.get("start", "1").strip()
            self.lists.append((int(first) if first.removeprefix("-").isdecimal() else 1) if tag == "ol" else None)
        elif tag == "li":
            number = self.lists[-1] if self.lists else None
            mark = "- " if number is None else f"{number}. "
            if number is not None:
                self.lists[-1] = number + 1
            w.marker = w.indent + mark
            w.indent += " " * len(mark)
        elif tag in ("dd", "blockquote"):
            w.indent += "  "
        elif tag == "pre":
            self.pre += 1

    def _in_list(self) -> bool:
        return any(t == "li" for t in reversed(self.stack[:-1][-3:]))

    def _pop(self) -> None:
        tag = self.stack.pop()
        self.foreign.pop()
        self.open[tag] -= 1
        if self.hidden >= 0:
            if len(self.stack) < self.hidden:
                self.hidden = -1
            return
        w = self.writers[-1]
        if self.foreign and self.foreign[-1]:
            if tag == "text":
                w.brk(1)
            return
        if tag in ("td", "th") and len(self.writers) > 1:
            self.lists.pop()
            self.writers.pop()
            self.tables[-1].cell(w.result(), *self.spans.pop())
        elif tag == "table" and self.tables:
            w.lines(self.tables.pop().result())
            w.brk(2)
        elif tag in BLOCK and tag != "tr":
            if tag == "li":
                # a marker that nothing followed is dropped
                w.marker = ""
                mark = self.lists[-1] if self.lists else None
                width = 2 if mark is None else len(f"{mark - 1}. ")
                w.indent = w.indent[: max(0, len(w.indent) - width)]
            elif tag in ("dd", "blockquote"):
                w.indent = w.indent[:-2]
            elif tag == "pre":
                self.pre -= 1
            if tag in ("ul", "ol", "menu", "dir") and self.lists:
                self.lists.pop()
            w.brk(2 if tag in MARGIN and not (tag in ("ul", "ol", "menu") and "li" in self.stack[-3:]) else 1)

    def result(self) -> str:
        while self.stack:
            self._pop()
        return self.writers[0].result()


def render(source: str | None) -> str:
    """The visible text of a page."""
    source = source or ""
    page, at, tag, last = Page(), 0, _TAG, source.rfind(">")
    while at < len(source):
        i = source.find("<", at)
        if i < 0:
            i = len(source)
        if i > at:
            page.text(html.unescape(source[at:i]))
        if i == len(source):
            break
        if source.startswith("<!--", i):
            j = source.find("-->", i + 4)
            at = len(source) if j < 0 else j + 3
            continue
        if page.foreign and page.foreign[-1] and source.startswith("<![CDATA[", i):
            j = source.find("]]>", i + 9)
            page.text(source[i + 9 : len(source) if j < 0 else j])
            at = len(source) if j < 0 else j + 3
            continue
        if source[i + 1 : i + 2] in ("!", "?"):
            j = source.find(">", i)
            at = len(source) if j < 0 else j + 1
            continue
        m = tag.match(source, i) if i < last else None
        if not m and i < last and tag is _TAG and _PLAIN.match(source, i):
            tag = _PLAIN  # a quote that nothing closes: from here on quotes mean nothing, so that no search is repeated
            m = tag.match(source, i)
        if not m:
            page.text("<")
            at = i + 1
            continue
        name, at = m[2].lower(), m.end()
        if m[1]:
            page.end(name)
            continue
        if page.start(name, m[3]):
            close = re.compile(f"(?i)</{name}(?=[\\s/>])").search(source, at)
            stop = close.start() if close else len(source)
            if name == "textarea":
                page.text(html.unescape(source[at:stop]))
            at = stop
            if not close:
                break
    return page.result()


def extract_text(pages: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """pages with the visible text of every whole page; null and empty pages have an empty text. Rows don't move, so
    repeated rows and empty tables are nothing special; a column named ``out`` is replaced."""

    def start() -> Callable[[pa.Array], pa.Array]:
        return lambda source: pa.array([render(s) for s in source.to_pylist()], pa.string())

    return with_arrow(pages, [column], out, "string", start)
