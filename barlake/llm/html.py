"""Layout-aware rendering of web pages: the visible text with block spacing, lists and aligned table cells."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from barlake.llm.common import table

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?>\"[^\"]*\"|'[^']*'|[^\"'>]+)*)>", re.S)
#: Without regard to quotes, from the first tag on whose quotes do not end.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANKS = re.compile(r"[ \t\n\r\f]+")
#: What a style may hold besides declarations: comments, strings, brackets.
_NO_DECLARATION = re.compile(r"/\*.*?(?:\*/|$)|\"[^\"]*\"|'[^']*'|\([^()]*\)", re.S)
_VALUE = re.compile(r"([a-z-]+(?:[ \t\n\r\f]+[a-z-]+)*)[ \t\n\r\f]*(![ \t\n\r\f]*important)?")
#: Known values; a declaration with another one counts as not made.
VALUES = {
    "display": frozenset(
        "none block inline inline-block flow-root contents flex inline-flex grid inline-grid table inline-table table-row table-cell table-caption table-column "
        "table-column-group table-row-group table-header-group table-footer-group list-item run-in ruby math inherit initial unset revert revert-layer -webkit-box -webkit-inline-box -webkit-flex -ms-flexbox".split()
    ),
    "visibility": frozenset("visible hidden collapse inherit initial unset revert revert-layer".split()),
    "white-space": frozenset("normal nowrap pre pre-wrap pre-line break-spaces inherit initial unset revert revert-layer".split()),
}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements whose content no browser shows.
UNSEEN = frozenset("head script style template title iframe noembed noframes noscript datalist audio video canvas object rp".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
#: Line feeds around a block: two leave an empty line.
MARGIN = dict.fromkeys("address article aside body center dd details dialog div dt fieldset figcaption footer form header hgroup html legend li main nav optgroup option search section summary tr caption".split(), 1) | dict.fromkeys("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp".split(), 2)
#: An opening tag of these ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul xmp li dd dt".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Open elements that an opening tag ends, and those where the search stops.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    **dict.fromkeys(("thead", "tbody", "tfoot", "caption", "colgroup"), ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"})),
}
#: No end tag of an element outside closes these, and no implied end reaches past them.
WALLS = frozenset("td th caption table html template".split())
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption".split())
#: Lines of a cell up to this width are always padded to; beyond it, those up to OUTLIER times the mean of their column.
USUAL, OUTLIER = 60, 64
MAX_SPAN = 1000
#: Elements nested deeper close the one before them, as browsers do.
MAX_DEPTH = 512
_ESCAPES = re.compile("[\ud800-\udfff\x00]")


def _declarations(style: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of the known declarations of `VALUES`' properties, in order."""
    found = []
    for declaration in _NO_DECLARATION.sub(" ", style.lower()).split(";"):
        name, _, value = declaration.partition(":")
        name, m = name.strip(), _VALUE.fullmatch(value.strip())
        if m is not None and name in VALUES and (m[1] in VALUES[name] or (name == "display" and " " in m[1] and "none" not in m[1].split())):
            found.append((name, m[1], bool(m[2])))
    return found


#: A simple selector: a tag, classes and ids of one element. Others (of several elements, attributes, states) are not followed.
_SIMPLE = re.compile(r"(?:([a-zA-Z][a-zA-Z0-9-]*)|\*)?((?:[.#][\w-]+)*)")
_SCREEN = re.compile(r"(?:only )?(?:screen|all)")


class _Sheet:
    """Rules of a page's <style> elements that say whether and how text is shown."""

    def __init__(self):
        self.by: dict[str, list[tuple]] = {}
        self.made = 0

    def add(self, css: str) -> None:
        """Rules for any screen; blocks for other media or under a condition are left out, with all in them."""
        css, at = re.sub(r"/\*.*?(?:\*/|$)|<!--|-->", " ", css, flags=re.S), 0
        while (start := css.find("{", at)) >= 0:
            prelude = css[at:start].rpartition(";")[2].strip()
            depth, stop = 1, start + 1
            while depth and (m := re.compile("[{}]").search(css, stop)):
                depth, stop = depth + (1 if m[0] == "{" else -1), m.end()
            body = css[start + 1 : stop - 1 if not depth else len(css)]
            at = stop if not depth else len(css)
            if prelude[:6].lower() == "@media":
                if any(_SCREEN.fullmatch(q.strip()) for q in prelude[6:].lower().split(",")):
                    self.add(body)
            elif not prelude.startswith("@") and (declared := _declarations(body)):
                for selector in prelude.split(","):
                    self._rule(selector.strip(), declared)

    def _rule(self, selector: str, declared: list[tuple[str, str, bool]]) -> None:
        m = _SIMPLE.fullmatch(selector)
        if m is None or not selector:
            return
        parts = re.findall(r"([.#])([\w-]+)", m[2])
        classes, ids = {x for k, x in parts if k == "."}, {x for k, x in parts if k == "#"}
        tag = (m[1] or "").lower()
        weight = sum(k == "#" for k, _ in parts), sum(k == "." for k, _ in parts), bool(tag)
        key = f"#{min(ids)}" if ids else f".{min(classes)}" if classes else tag or "*"
        self.made += 1
        self.by.setdefault(key, []).append((tag, classes, ids, (*weight, self.made), declared))

    def style(self, tag: str, own: dict[str, str]) -> dict[str, str]:
        """The values that hold for an element: important before others, its own style before rules, then by weight and order."""
        found: list[tuple] = []
        if self.by:
            classes, ids = set(unescape(own.get("class", "")).split()), {unescape(own.get("id", ""))}
            for key in (*[f".{c}" for c in classes], *[f"#{i}" for i in ids], tag, "*"):
                for need, some, named, weight, declared in self.by.get(key, ()):
                    if need in ("", tag) and some <= classes and named <= ids:
                        found += [(important, False, weight, i, name, value) for i, (name, value, important) in enumerate(declared)]
        if "style" in own:
            found += [(important, True, (), i, name, value) for i, (name, value, important) in enumerate(_declarations(unescape(own["style"])))]
        return {name: value for *_, name, value in sorted(found)}


class _Out:
    """Text of a page or a table cell: collapses blanks and puts line feeds between blocks when the next text comes."""

    __slots__ = ("parts", "feeds", "blank", "marker", "indent")

    def __init__(self):
        self.parts: list[str] = []
        self.feeds, self.blank, self.marker, self.indent = 0, False, "", ""

    def block(self, feeds: int) -> None:
        if self.parts:
            self.feeds = max(self.feeds, feeds)
        self.blank = False

    def write(self, text: str) -> None:
        if not self.parts or self.feeds:
            self.parts.append("\n" * self.feeds + self.indent + self.marker)
            self.marker = ""
        elif self.blank:
            self.parts.append(" ")
        self.feeds, self.blank = 0, False
        self.parts.append(text)

    def flow(self, text: str) -> None:
        text = _BLANKS.sub(" ", text)
        body = text.strip(" ")
        if text[:1] == " ":
            self.blank = True
        if body:
            self.write(body)
            self.blank = text[-1] == " "

    def kept(self, text: str) -> None:
        """Text whose blanks and line feeds count."""
        for i, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                self.feeds += 1 if self.parts else 0
            if line:
                self.write(line)

    def text(self) -> str:
        return "".join(self.parts)


class _Element:
    __slots__ = ("tag", "shown", "seen", "pre", "count", "indent", "closed")

    def __init__(self, tag: str, above: _Element | None):
        self.tag = tag
        self.shown = above is None or above.shown  # false below display:none
        self.seen = above is None or above.seen  # visibility, which an element inside may set again
        self.pre = above is not None and above.pre
        self.count, self.indent, self.closed = 0, "", False


class _Table:
    __slots__ = ("rows", "row", "next", "pending", "caption")

    def __init__(self):
        self.rows: list[dict[int, tuple[list[str], int]]] = []
        self.row: dict[int, tuple[list[str], int]] | None = None
        self.pending: dict[int, int] = {}  # rows that a cell above still covers, by column
        self.caption, self.next = "", 0

    def end_row(self) -> None:
        self.rows.append(self.row or {})
        self.row, self.next = None, 0
        self.pending = {c: n - 1 for c, n in self.pending.items() if n > 1}


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _column_widths(grid: _Table) -> dict[int, int]:
    """A column is as wide as its widest line, but for lines over `USUAL` and over `OUTLIER` times what its cells hold on average:
    padding all rows to such a line would write far more than the table holds. A cell over several columns widens the last
    of them, by `USUAL` in all."""
    found: dict[int, list[int]] = {}
    spans: list[tuple[int, int, int]] = []
    for row in grid.rows:
        for column, (lines, span) in row.items():
            if span == 1:
                found.setdefault(column, []).extend(map(_width, lines))
            else:
                spans.append((column, span, max(map(_width, lines), default=0)))
    widths = {}
    for column, sizes in found.items():
        most = max(USUAL, OUTLIER * sum(sizes) // len(grid.rows))
        widths[column] = max((w for w in sizes if w <= most), default=0)
    grown: dict[int, int] = {}
    for column, span, wide in sorted(spans, key=lambda s: (s[1], s[0])):
        end = column + span - 1
        lacking = wide - sum(widths.get(c, 0) for c in range(column, end + 1)) - 3 * (span - 1)
        if 0 < lacking <= USUAL - grown.get(end, 0):
            widths[end], grown[end] = widths.get(end, 0) + lacking, grown.get(end, 0) + lacking
    return widths


def _laid_out(grid: _Table) -> str:
    """Rows of a table, cells padded to the width of their column. After a line wider than its column the rest of the row goes on in the next line, in its place."""
    widths = _column_widths(grid)
    out = [grid.caption] if grid.caption else []
    for row in grid.rows:
        if not any(any(lines) for lines, _ in row.values()):
            continue
        last = max(row)
        for i in range(max(len(lines) for lines, _ in row.values())):
            filled = max((c for c, (lines, _) in row.items() if i < len(lines) and lines[i]), default=-1)
            cells, column, blank = [], 0, []
            while column <= last:
                lines, span = row.get(column, ([], 1))
                wide = sum(widths.get(c, 0) for c in range(column, column + span)) + 3 * (span - 1)
                line = lines[i] if i < len(lines) else ""
                cells.append(line + " " * max(0, wide - _width(line)))
                blank.append(wide)
                if _width(line) > wide and column < filled:
                    out.append(" | ".join(cells).rstrip())
                    cells = [" " * w for w in blank]
                column += span
            out.append(" | ".join(cells).rstrip())
    return "\n".join(out)


class _Page:
    """Tree builder and renderer in one: a stack of open elements, and one of outputs, of which each open table cell is one."""

    def __init__(self, sheet: _Sheet | None = None):
        self.sheet = sheet or _Sheet()
        self.stack: list[_Element] = [_Element("html", None)]
        self.outs = [_Out()]
        self.tables: list[_Table] = []
        self.opened: dict[str, int] = {}  # open elements by tag

    def _inside(self, *tags: str) -> bool:
        return any(self.opened.get(t) for t in tags)

    def text(self, raw: str) -> None:
        top = self.stack[-1]
        if top.tag == "head" and raw.strip():
            self._pop_to(len(self.stack) - 1)
            top = self.stack[-1]
        if top.tag in ("table", "thead", "tbody", "tfoot", "tr", "colgroup") and not raw.strip():
            return
        if top.shown and top.seen and not top.closed:
            text = unescape(raw) if "&" in raw else raw
            if top.pre:
                self.outs[-1].kept(text)
            else:
                self.outs[-1].flow(text)

    def _find(self, tags: Iterable[str], walls: Iterable[str]) -> int | None:
        if not self._inside(*tags):
            return None
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                return i
            if self.stack[i].tag in walls:
                return None
        return None

    def open(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            if (at := self._find(("head",), ())) is not None:
                self._pop_to(at)
            if tag == "html" or self._inside("body"):
                return
        if tag == "head" and self._inside("head"):
            return
        if self.stack[-1].tag == "head" and tag not in HEAD_ONLY:
            self._pop_to(len(self.stack) - 1)
        if tag in ENDS_P and (at := self._find(("p",), WALLS | {"button"})) is not None:
            self._pop_to(at)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self._pop_to(len(self.stack) - 1)
        if tag in IMPLIED_END:
            ends, walls = IMPLIED_END[tag]
            stop = walls if tag in TABLE_PARTS or tag == "colgroup" else walls | WALLS
            while (at := self._find(ends, stop)) is not None:
                self._pop_to(at)
        if tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") and not self.tables:
            tag = "div" if tag == "tr" else "span"  # a part without its table
        elif tag in ("td", "th"):
            if (at := self._find(("tr",), {"table"})) is None:
                self._push("tr", "")
            else:
                self._pop_to(at + 1)  # what stands between the cells of a row ends, the row goes on
        self._push(tag, attributes)

    def _push(self, tag: str, attributes: str) -> None:
        if len(self.stack) >= MAX_DEPTH:
            self._pop_to(len(self.stack) - 1)
        above, e = self.stack[-1], _Element(tag, self.stack[-1])
        own = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes and not attributes.isspace() else {}
        style = self.sheet.style(tag, own) if self.sheet.by or "style" in own else {}
        display = style.get("display", "revert")
        # a display of its own shows what the hidden attribute or a closed dialog would hide
        hides = ("hidden" in own and own["hidden"].lower() != "until-found") or (tag == "dialog" and "open" not in own)
        if tag in UNSEEN or display == "none" or (hides and display in ("revert", "revert-layer")):
            e.shown = False
        if above.tag == "details" and above.closed and tag != "summary":
            e.shown = False
        if (value := style.get("visibility")) in ("visible", "hidden", "collapse", "initial"):
            e.seen = value in ("visible", "initial")
        if (value := style.get("white-space")) in ("pre", "pre-wrap", "break-spaces", "normal", "nowrap", "pre-line", "initial"):
            e.pre = value in ("pre", "pre-wrap", "break-spaces")
        e.closed = tag == "details" and "open" not in own
        visible, out = e.shown and e.seen, self.outs[-1]
        if tag in ("pre", "xmp", "textarea"):
            e.pre = True
        if e.shown and (feeds := MARGIN.get(tag)):
            nested = tag in ("ul", "ol", "menu", "dl") and self._inside("li", "dd")
            out.block(1 if nested else feeds)
        if tag in VOID:
            if visible and tag == "br":
                out.feeds += 1 if out.parts else 0
                out.blank = False
            elif visible and tag == "input" and own.get("type", "").lower() in ("submit", "button", "reset"):
                out.flow(unescape(own.get("value", "")))
            return
        e.indent = out.indent
        if e.shown:
            if tag in ("ul", "ol", "menu"):
                e.count = int(own["start"]) - 1 if tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", own.get("start", "")) else 0
                out.indent += "  " if self._inside("ul", "ol", "menu") else ""
            elif tag == "li":
                at = next((x for x in reversed(self.stack) if x.tag in ("ul", "ol", "menu")), None)
                if at is not None:
                    at.count = int(own["value"]) if re.fullmatch(r"-?[0-9]{1,9}", own.get("value", "")) else at.count + 1
                out.marker = f"{at.count}. " if at is not None and at.tag == "ol" else "- "
            elif tag in ("dd", "blockquote"):
                out.indent += "  "
            elif tag == "table":
                self.tables.append(_Table())
            elif tag == "tr" and self.tables:
                if self.tables[-1].row:
                    self.tables[-1].end_row()
                self.tables[-1].row = {}
            elif tag in ("td", "th") and self.tables:
                span = [int(own[x]) if re.fullmatch("[0-9]{1,6}", own.get(x, "")) else 1 for x in ("colspan", "rowspan")]
                self.outs.append(_Out())
                e.count = min(max(span[0], 1), MAX_SPAN) * (MAX_SPAN + 1) + min(max(span[1], 1), MAX_SPAN)
            elif tag == "caption" and self.tables:
                self.outs.append(_Out())
        self.stack.append(e)
        self.opened[tag] = self.opened.get(tag, 0) + 1

    def close(self, tag: str) -> None:
        if tag == "br":
            self._push("br", "")
        elif tag == "p" and self._find(("p",), WALLS | {"button"}) is None:
            self.outs[-1].block(2)
        elif tag in ("html", "body"):
            return
        else:
            tags = HEADINGS if tag in HEADINGS else (tag,)
            if (at := self._find(tags, {"table"} if tag in TABLE_PARTS and tag != "table" else () if tag == "table" else WALLS)) is not None:
                self._pop_to(at)

    def _pop_to(self, at: int) -> None:
        """Close the elements from `at` up."""
        while len(self.stack) > at:
            e = self.stack.pop()
            self.opened[e.tag] -= 1
            if not e.shown:
                continue
            if e.tag in ("td", "th") and self.tables and len(self.outs) > 1:
                self._cell(self.outs.pop().text(), *divmod(e.count, MAX_SPAN + 1))
            elif e.tag == "caption" and self.tables and len(self.outs) > 1:
                grid, text = self.tables[-1], self.outs.pop().text()
                grid.caption += "\n" * bool(grid.caption and text) + text
            elif e.tag == "tr" and self.tables:
                self.tables[-1].end_row()
            elif e.tag == "table" and self.tables:
                if self.tables[-1].row:
                    self.tables[-1].end_row()
                made = _laid_out(self.tables.pop())
                out = self.outs[-1]
                if made:
                    out.block(2)
                    for line in made.split("\n"):
                        out.write(line)
                        out.feeds = 1
            out = self.outs[-1]
            if e.tag in ("ul", "ol", "menu", "dd", "blockquote"):
                out.indent = e.indent
            elif e.tag == "li":
                out.marker = ""
            if feeds := MARGIN.get(e.tag):
                nested = e.tag in ("ul", "ol", "menu", "dl") and self._inside("li", "dd")
                out.block(1 if nested else feeds)

    def _cell(self, text: str, columns: int, rows: int) -> None:
        grid = self.tables[-1]
        if grid.row is None:
            grid.row = {}
        column = grid.next
        while grid.pending.get(column):
            column += 1
        grid.row[column], grid.next = (text.split("\n"), columns), column + columns
        if rows > 1:
            grid.pending |= dict.fromkeys(range(column, column + columns), rows)

    def end(self) -> str:
        self._pop_to(1)
        return self.outs[0].text().replace("\xa0", " ")


def render(html: str | None) -> str:
    """The visible text of a page; null and empty pages give the empty text. Broken markup is read as browsers do: missing tags are implied, stray ones dropped.

    Rules of <style> elements hold for the whole page, so a page that has any which matter here is read twice.
    """
    text, sheet = _rendered(html or "", None)
    return _rendered(html or "", sheet)[0] if sheet.by else text


def _rendered(html: str, sheet: _Sheet | None) -> tuple[str, _Sheet]:
    """Text of the page under the rules of `sheet`, and the rules that its own <style> elements hold."""
    page, rules = _Page(sheet), _Sheet()
    at, end, tag_of, lowered = 0, len(html), _TAG, None
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            page.text(html[at:])
            break
        nxt = html[lt + 1 : lt + 2]
        if not (nxt.isascii() and (nxt.isalpha() or nxt in ("/", "!", "?"))) or not nxt:
            page.text(html[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            page.text(html[at:lt])
        if nxt in "!?":
            if html.startswith("<!--", lt):
                stop = html.find("-->", lt + 2 if html.startswith("<!-->", lt) else lt + 4)
                at = end if stop < 0 else stop + 3
            else:
                stop = html.find(">", lt)
                at = end if stop < 0 else stop + 1
            continue
        found = tag_of.match(html, lt)
        if found is None and tag_of is _TAG and html.find(">", lt) >= 0 and html[lt + 1 : lt + 3].strip("/")[:1].isalpha():
            tag_of = _PLAIN_TAG
            found = tag_of.match(html, lt)
        if found is None:
            stop = html.find(">", lt)  # "</ ...>" is a comment; a tag that never ends drops what follows
            at = end if stop < 0 else stop + 1
            continue
        closing, tag, attributes = found[1], found[2].lower(), found[3]
        at = found.end()
        if closing:
            page.close(tag)
            continue
        page.open(tag, attributes)
        if tag in RAW:
            if lowered is None:
                lowered = html.lower() if len(html.lower()) == len(html) else re.sub("[A-Z]", lambda m: m[0].lower(), html)
            stop = lowered.find(f"</{tag}", at)
            if tag == "textarea":
                page.text(html[at : end if stop < 0 else stop])
            elif tag == "style" and sheet is None:
                own = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
                media, kind = own.get("media", "").strip().lower(), own.get("type", "").strip().lower()
                if kind in ("", "text/css") and (not media or any(_SCREEN.fullmatch(q.strip()) for q in media.split(","))):
                    rules.add(html[at : end if stop < 0 else stop])
            page.close(tag)
            stop = end if stop < 0 else html.find(">", stop)
            at = end if stop < 0 else stop + 1
    return page.end(), rules


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text): the rendered page of every row. Null and empty pages give the empty text, null keys stay null, repeated rows give the same twice, other columns are not looked at. One pass, no shuffle."""
    rows = pages.select(pages[f"`{key}`"].alias("key"), pages[f"`{html}`"].alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            texts = [_ESCAPES.sub("�", render(h.as_py())) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", key)


def op10_html_layout(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))
