"""Visible text of HTML pages, laid out as blocks, lists and tables."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import pieces_of

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("head script style template noscript noframes title datalist iframe object audio video canvas annotation annotation-xml rp".split())
# of a drawing browsers show the texts, but not what it only defines or describes
_DRAWN = frozenset(("text", "foreignobject"))
_UNDRAWN = frozenset("defs symbol desc metadata clippath mask marker pattern".split())
_CHOICES = frozenset(("option", "optgroup"))
# what may stand in a head; any other tag, or text, ends a head that is open
_HEAD = frozenset("head html base basefont bgsound link meta title style script noscript noframes template".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre xmp figure hr".split())
_LINES = frozenset(
    "address article aside body caption center dd details dialog div dt fieldset figcaption footer form header html "
    "legend li main menu nav option optgroup search section summary tr thead tbody tfoot".split()
)
_LISTS = frozenset(("ul", "ol", "menu"))
# an opening tag ends these open elements, unless one of the second set lies in between
_ENDS = {
    "li": (frozenset(("li",)), _LISTS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "td": (frozenset(("td", "th")), frozenset(("table",))),
    "th": (frozenset(("td", "th")), frozenset(("table",))),
    "tr": (frozenset(("tr", "td", "th", "caption")), frozenset(("table",))),
    **{t: (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption")), frozenset(("table",))) for t in ("thead", "tbody", "tfoot")},
    "body": (frozenset(("head",)), frozenset()),
    "optgroup": (_CHOICES, frozenset(("select", "datalist"))),
    **{t: (frozenset(("select",)), frozenset(("table", "td", "th"))) for t in ("select", "input", "textarea")},
}
_SCOPE = frozenset(("table", "td", "th", "caption", "html", "button"))
_SPACES = re.compile(r"[ \t\n\r\f]+")
# what these hold is text up to their end tag; only in the second set references to characters count
_RAW = frozenset("script style iframe noframes noembed xmp".split())
_RAW_WITH_REFERENCES = frozenset(("title", "textarea"))
_TAG_NAME = re.compile(r"[a-zA-Z][^\t\n\f />]*+")
_BETWEEN = re.compile(r"[\t\n\f /]*+")
_ATTRIBUTE = re.compile(r"=?[^\t\n\f />=]*+")
_EQUALS = re.compile(r"[\t\n\f ]*+=[\t\n\f ]*+")
_UNQUOTED = re.compile(r"[^\t\n\f >]*+")
_COMMENT_END = re.compile(r"--!?>")
_LONG_NUMBER = re.compile(r"&#(?:0*+[1-9][0-9]{7,}|[xX]0*+[1-9a-fA-F][0-9a-fA-F]{6,});?")
_ZEROS = re.compile(r"&#([xX]?)0{8,}")
# bounds of the layout: levels of indent and of aligned tables, blanks before a column, and blanks against text
_LEVELS = 20
_WIDE = 60
_BLANKS = 16
_BUTTONS = frozenset(("submit", "reset", "button"))
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)


def _number(value: str | None, otherwise: int) -> int:
    value = (value or "").strip()
    digits = value.removeprefix("-")
    return int(value) if digits.isascii() and digits.isdigit() and len(digits) < 10 else otherwise


def _counter(number: int, kind: str) -> str:
    """A list number in letters where the list asks for them."""
    if kind not in ("a", "A") or number < 1:
        return str(number)
    letters = ""
    while number:
        number, rest = divmod(number - 1, 26)
        letters = chr(ord(kind) + rest) + letters
    return letters


class _Page:
    """Lines of a block; a table cell has one of its own."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.indent: list[str] = []
        self.mark = ""  # of a list item, for its first line
        self.gap = 0

    def text(self, raw: str, as_is: bool) -> None:
        if as_is:
            first, *others = raw.split("\n")
            self._add(first)
            for line in others:
                self.end_line()
                self._add(line)
            return
        shown = _SPACES.sub(" ", raw)
        if not self.parts or self.parts[-1].endswith(" "):
            shown = shown.lstrip(" ")
        self._add(shown)

    def _add(self, shown: str) -> None:
        if shown:
            self.parts.append(shown)

    def end_line(self) -> None:
        line = "".join(self.parts).rstrip(" ")
        self.parts = []
        lead = "".join(self.indent[:_LEVELS])
        if self.mark and line:
            lead = lead[: max(0, len(lead) - len(self.mark))] + self.mark
            self.mark = ""
        if line and self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        if line:
            self.gap = 0
        self.lines.append(lead + line if line else "")

    def block(self, gap: int) -> None:
        if self.parts:
            self.end_line()
        self.gap = max(self.gap, gap)

    def rows(self, rows: list[list[tuple[str, int, int]]]) -> None:
        """Cells (text, columns, rows they span) on a grid: those that begin in one column begin at the same place.

        A cell of several lines makes its row as high. Text wider than the bound pushes aside what follows it in its line.
        A table that would be mostly blanks is set without alignment: cells of one line two blanks apart, others below each other.
        """
        split = [[(at, end, text.split("\n")) for at, end, text in row if text] for row in _on_grid(rows)]
        starts = sorted({at for row in split for at, _, _ in row})
        widths = dict.fromkeys(starts, 0)
        for row in split:
            for at, end, lines in row:
                following = bisect_right(starts, at)
                if following == len(starts) or starts[following] >= end:  # nothing begins under a cell that spans one column
                    widths[at] = min(_WIDE, max(widths[at], *map(len, lines)))
        offsets, place = {}, 0
        for at in starts:
            offsets[at] = place
            place += widths[at] + 2
        heights = [max((len(lines) for _, _, lines in row), default=0) for row in split]
        blanks = sum(height * (offsets[row[-1][0]] + len(row)) for row, height in zip(split, heights) if row)
        text = sum(len(line) + 2 for row in split for _, _, lines in row for line in lines)
        aligned = blanks <= _BLANKS * text + 4096
        for row, height in zip(split, heights):
            if not aligned and height > 1:
                for _, _, lines in row:
                    for line in lines:
                        self.parts.append(line or " ")
                        self.end_line()
                continue
            for k in range(height):
                shown: list[str] = []
                length = 0
                for at, _, lines in row:
                    if k < len(lines) and lines[k]:
                        lead = max(offsets[at] - length if aligned else 0, 2 if length else 0)
                        shown += [" " * lead, lines[k]]
                        length += lead + len(lines[k])
                self.parts.append("".join(shown).rstrip() or " ")
                self.end_line()

    def result(self) -> str:
        self.block(0)
        lines = [line.rstrip(" ") for line in self.lines]
        kept = [line for i, line in enumerate(lines) if line or (i and lines[i - 1])]
        return "\n".join(kept).strip("\n")


def _on_grid(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, int, str]]]:
    """First column, column after the last, and text of every cell; cells that reach down push later rows' cells aside.

    Where following the spans down would cost far more than there are cells, every cell is one row high.
    """
    reach = sum(min(down, len(rows) - i) - 1 for i, row in enumerate(rows) for _, _, down in row)
    flat = reach > _BLANKS * sum(map(len, rows)) + 4096
    placed, taken = [], []  # taken: first column, column after the last, rows left
    for row in rows:
        out, column, k = [], 0, 0
        begun = []
        for text, across, down in row:
            while k < len(taken) and taken[k][0] <= column:
                column = max(column, taken[k][1])
                k += 1
            out.append((column, column + across, text))
            if down > 1 and not flat:
                begun.append((column, column + across, down))
            column += across
        placed.append(out)
        taken = sorted((at, end, left - 1) for at, end, left in taken + begun if left > 1)
    return placed


def _span(value: str | None, most: int) -> int:
    """Browsers bound spans too; what is no number counts as one, zero rows as all that follow."""
    value = (value or "1").strip()
    if not (value.isascii() and value.isdigit()):
        return 1
    number = most if len(value) > 8 else int(value)
    return min(most, number) or (1 if most == 1000 else most)


def _characters(text: str) -> str:
    """Text with its references to characters resolved; numbers beyond all characters are none."""
    if "&" not in text:
        return text
    return unescape(_LONG_NUMBER.sub("\ufffd", _ZEROS.sub(r"&#\g<1>0", text)))


class _Renderer:
    """Reads tags and text once from left to right, builds the open-element stack with implied tags, and lays out visible text.

    The stack is explicit, so depth is bounded by memory only. No place is read twice: a comment, tag or quoted value that
    does not end takes the rest of the page with it, as in browsers.
    """

    def __init__(self) -> None:
        self.open: list[str] = []
        self.at: dict[str, list[int]] = {}  # depths of the open elements of each name
        self.hidden_from: int | None = None  # depth of the outermost hidden element
        self.pages = [_Page()]
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.deep = 0  # tables open below the last aligned level
        self.spans: list[tuple[int, int]] = []
        self.lists: list[list] = []
        self.pre = 0
        self.selects: list[dict] = []
        self.muted: list[bool] = []  # inside a drawing: is plain text left out
        self.closed: list[list] = []  # details that show their summary only: depth, and whether it has come
        self.fresh = False  # a text area or preformatted text has just begun

    def read(self, html: str) -> None:
        html = html.replace("\r\n", "\n").replace("\r", "\n")
        at, n = 0, len(html)
        while at < n:
            begin = html.find("<", at)
            if begin != at:
                self.handle_data(_characters(html[at : begin if begin >= 0 else n]))
                if begin < 0:
                    return
            at = self._markup(html, begin)

    def _markup(self, html: str, begin: int) -> int:
        """Handle what begins with the bracket at ``begin``; where to read on."""
        second = html[begin + 1 : begin + 2]
        if second == "!" and html.startswith("--", begin + 2):
            for short in (">", "->"):
                if html.startswith(short, begin + 4):
                    return begin + 4 + len(short)
            end = _COMMENT_END.search(html, begin + 4)
            return end.end() if end else len(html)
        if second == "!" and html.startswith("[CDATA[", begin + 2) and (self.at.get("svg") or self.at.get("math")):
            end = html.find("]]>", begin + 9)
            self.handle_data(html[begin + 9 : end if end >= 0 else len(html)])
            return end + 3 if end >= 0 else len(html)
        name = _TAG_NAME.match(html, begin + (2 if second == "/" else 1))
        if name:
            return self._tag(html, name.group().lower(), name.end(), second == "/")
        if second in ("!", "?") and second or second == "/" and begin + 2 < len(html):
            end = html.find(">", begin + 2)
            return end + 1 if end >= 0 else len(html)
        self.handle_data("</" if second == "/" else "<")
        return begin + (2 if second == "/" else 1)

    def _tag(self, html: str, tag: str, at: int, ends: bool) -> int:
        """A tag from behind its name on, and the text of an element that holds text only."""
        n, attrs, slash = len(html), {}, False
        while True:
            between = _BETWEEN.match(html, at)
            at, slash = between.end(), between.group().endswith("/")
            if at >= n:
                return n
            if html[at] == ">":
                at += 1
                break
            name = _ATTRIBUTE.match(html, at)
            at, value = name.end(), ""
            equals = _EQUALS.match(html, at)
            if equals:
                at = equals.end()
                quote = html[at : at + 1]
                if quote in ('"', "'") and quote:
                    end = html.find(quote, at + 1)
                    if end < 0:
                        return n
                    value, at = html[at + 1 : end], end + 1
                else:
                    plain = _UNQUOTED.match(html, at)
                    value, at = plain.group(), plain.end()
            attrs.setdefault(name.group().lower(), value)
        if ends:
            self.handle_endtag(tag)
            return at
        drawn = self.at.get("svg") or self.at.get("math")
        self.handle_starttag(tag, {k: _characters(v) for k, v in attrs.items()})
        if drawn or tag in ("svg", "math"):
            if slash and self.open and self.open[-1] == tag:  # HTML gives the slash no meaning, but drawings and formulas do
                self._pop()
        elif tag in _RAW or tag in _RAW_WITH_REFERENCES:
            end = re.compile(rf"</{tag}(?=[\t\n\f />])", re.I).search(html, at)
            held = html[at : end.start() if end else n]
            self.handle_data(_characters(held) if tag in _RAW_WITH_REFERENCES else held)
            return end.start() if end else n
        return at

    def handle_starttag(self, tag: str, attrs: dict[str, str]) -> None:
        self.fresh = False
        if tag not in _HEAD:
            self._end_head()
        ended = _ENDS.get(tag)
        if ended and any(self.at.get(t) for t in ended[0]):
            self._end_implied(*ended)
        elif self.at.get("p") and tag not in _CHOICES and (tag in _PARAGRAPHS or tag in _LINES):
            self._end_implied(frozenset(("p",)), _SCOPE)
        shown = self.hidden_from is None and not self._is_folded(tag)
        if tag in _VOID:
            if shown and tag == "br":
                self.pages[-1].end_line()
            elif shown and tag == "hr":
                self.pages[-1].block(1)
            elif shown and tag == "input" and (attrs.get("type") or "").lower() in _BUTTONS and not self._is_hidden(tag, attrs):
                self.pages[-1].text(attrs.get("value") or "", False)
            return
        if self.hidden_from is None and (
            not shown or tag in _HIDDEN or (self.muted and tag in _UNDRAWN) or self._is_hidden(tag, attrs)
        ):
            self.hidden_from = len(self.open)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(tag)
        if self.hidden_from is None:
            self._begin(tag, attrs)

    def _is_folded(self, tag: str) -> bool:
        """Whether something that begins here lies directly in closed details and is not their first summary."""
        if not self.closed or self.closed[-1][0] != len(self.open) - 1:
            return False
        if tag == "summary" and not self.closed[-1][1]:
            self.closed[-1][1] = True
            return False
        return True

    def handle_endtag(self, tag: str) -> None:
        self.fresh = False
        if tag == "br":
            self.handle_starttag("br", {})
        elif tag == "p" and not self.at.get("p"):
            self.handle_starttag("p", {})
            self._pop()
        elif self.at.get(tag) and self._reaches(tag):
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1] == "head" and not _SPACES.sub("", data) == "":
            self._end_head()
        if self.hidden_from is None and not (self.muted and self.muted[-1]) and not self._is_folded(""):
            if self.fresh:
                data = data.removeprefix("\n")
            self.pages[-1].text(data, self.pre > 0)
        self.fresh = False

    def _end_head(self) -> None:
        """End a head without an end tag; what stands deeper, as in a title or template, leaves it open."""
        if self.open and self.open[-1] == "head":
            self._pop()

    def _reaches(self, tag: str) -> bool:
        """An end tag inside a table cell closes nothing outside the cell's table."""
        if tag in ("table", "tr", "td", "th", "body", "html") or not self.at.get("table"):
            return True
        return self.at[tag][-1] > self.at["table"][-1]

    @staticmethod
    def _is_hidden(tag: str, attrs: dict[str, str]) -> bool:
        return "hidden" in attrs or tag == "dialog" and "open" not in attrs or bool(_INVISIBLE.search(attrs.get("style", "")))

    def _end_implied(self, ends: frozenset[str], scope: frozenset[str]) -> None:
        """Close up to the outermost of ``ends`` that no element of ``scope`` separates from here."""
        border = max((self.at[t][-1] for t in scope if self.at.get(t)), default=-1)
        cut = len(self.open)
        for tag in ends:
            depths = self.at.get(tag)
            if depths and depths[-1] > border:
                cut = min(cut, depths[bisect_right(depths, border)])
        while len(self.open) > cut:
            self._pop()

    def _pop(self) -> str:
        tag = self.open.pop()
        self.at[tag].pop()
        if self.hidden_from is None:
            self._finish(tag)
        elif self.hidden_from == len(self.open):
            self.hidden_from = None
        return tag

    def _begin(self, tag: str, attrs: dict[str, str]) -> None:
        page = self.pages[-1]
        if tag in ("td", "th"):
            if self.deep:
                page.block(0)
            elif self.tables:
                if not self.tables[-1]:
                    self.tables[-1].append([])
                self.pages.append(_Page())
                self.spans.append((_span(attrs.get("colspan"), 1000), _span(attrs.get("rowspan"), 65534)))
            return
        if tag == "select":
            size = attrs.get("size") or "1"
            listed = "multiple" in attrs or (size.isascii() and size.isdigit() and size.lstrip("0") not in ("", "1"))
            self.selects.append({"listed": listed, "options": []})
            self.pages.append(_Page())  # text beside the options is not shown
            return
        if tag == "option" and self.selects:
            self.selects[-1]["options"].append([attrs.get("label"), "selected" in attrs, "disabled" in attrs])
            self.pages.append(_Page())
            return
        if tag == "optgroup" and self.selects:
            if self.selects[-1]["listed"] and attrs.get("label"):
                self.selects[-1]["options"].append([attrs["label"], False, True])
            return
        if tag == "svg":
            self.muted.append(True)
        elif tag in _DRAWN and self.muted:
            self.muted.append(False)
            page.block(0)
        elif tag == "textarea":
            self.pre += 1
            self.fresh = True
        if tag in _PARAGRAPHS or tag in _LINES:
            # a list inside an item follows it without a blank line
            page.block(1 if tag in _PARAGRAPHS and not (tag in _LISTS and self.lists) else 0)
        if tag in ("pre", "xmp"):
            self.pre += 1
            self.fresh = tag == "pre"
        elif tag in _LISTS:
            self.lists.append([tag, _number(attrs.get("start"), 1), attrs.get("type") or "1"])
        elif tag == "li":
            mark = "- "
            if self.lists and self.lists[-1][0] == "ol":
                number = _number(attrs.get("value"), self.lists[-1][1])
                mark = f"{_counter(number, self.lists[-1][2])}. "
                self.lists[-1][1] = number + 1
            page.indent.append(" " * len(mark))
            page.mark = mark
        elif tag in ("dd", "blockquote"):
            page.indent.append("  ")
        elif tag == "details" and "open" not in attrs:
            self.closed.append([len(self.open) - 1, False])
        elif tag == "table":
            if self.deep or len(self.tables) == _LEVELS:
                self.deep += 1
            else:
                self.tables.append([])
        elif tag == "tr" and self.tables and not self.deep:
            self.tables[-1].append([])

    def _finish(self, tag: str) -> None:
        if tag in ("td", "th"):
            if self.deep:
                self.pages[-1].block(0)
            elif self.tables and len(self.pages) > 1:
                cell = self.pages.pop().result()
                self.tables[-1][-1].append((cell, *self.spans.pop()))
            return
        if tag == "option" and self.selects:
            own, option = self.pages.pop().result(), self.selects[-1]["options"][-1]
            option[0] = option[0] or " ".join(own.split())
            return
        if tag == "optgroup" and self.selects:
            return
        if tag == "select":
            self.pages.pop()
            self._choose(self.selects.pop())
            return
        page = self.pages[-1]
        if tag == "svg" or tag in _DRAWN and self.muted:
            self.muted.pop()
            if tag != "svg":
                page.block(0)
        elif tag == "textarea":
            self.pre -= 1
        elif tag in ("mtd", "mtr"):
            page.text(" ", False)
        if tag in _PARAGRAPHS or tag in _LINES:
            page.block(1 if tag in _PARAGRAPHS and not (tag in _LISTS and len(self.lists) > 1) else 0)
        if tag in ("pre", "xmp"):
            self.pre -= 1
        elif tag == "details" and self.closed and self.closed[-1][0] == len(self.open):
            self.closed.pop()
        elif tag in _LISTS and self.lists:
            self.lists.pop()
        elif tag == "li" or tag in ("dd", "blockquote"):
            page.mark = ""
            if page.indent:
                page.indent.pop()
        elif tag == "table" and self.deep:
            self.deep -= 1
        elif tag == "table" and self.tables:
            page.rows(self.tables.pop())
            page.gap = 1

    def _choose(self, select: dict) -> None:
        """A list shows all its options, a drop-down the last selected one, or else the first that is not disabled."""
        page, options = self.pages[-1], select["options"]
        if select["listed"]:
            for label, _, _ in options:
                page.block(0)
                page.text(label or "", False)
            page.block(0)
            return
        chosen = [o for o in options if o[1]][-1:] or [o for o in options if not o[2]][:1]
        for label, _, _ in chosen:
            page.text(label or "", False)

    def finish(self) -> str:
        while self.open:
            self._pop()
        return self.pages[0].result()


def visible_text(html: str) -> str:
    """The laid-out visible text of one page."""
    renderer = _Renderer()
    renderer.read(html)
    return renderer.finish()


def extract(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """``page_id, text, n_lines`` of every page.

    Tags are completed as browsers do for paragraphs, list items and table parts; what is in the head,
    scripts, styles, templates, comments, or marked hidden or not displayed is left out. Text of formulas, of
    drawings' text elements and of text areas is shown, and the options of a selection that a browser shows at first. Blocks
    begin on lines of their own, paragraphs, headings, lists and tables are set off by a blank line, list
    items are marked and indented, and the cells of a table's column are aligned, spans included. Closed details show their
    summary. Indents stop growing after 20 levels, columns are padded to 60 characters at most, and tables nested deeper than 20
    levels or mostly blank are not aligned; no text is left out for that. Null or empty pages give an empty text; text outside
    any tag is text; broken markup never fails, and time grows with the page's length. Rows are independent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            texts = [visible_text(h) if h else "" for h in batch["html"].to_pylist()]
            lines = [t.count("\n") + 1 if t else 0 for t in texts]
            yield pa.record_batch(
                [batch["page_id"], pa.array(texts, pa.string()), pa.array(lines, pa.int64())], ["page_id", "text", "n_lines"]
            )

    rows = pages.select(F.col(id_column).cast("bigint").alias("page_id"), F.col(html_column).alias("html"))
    return rows.mapInArrow(run, "page_id long, text string, n_lines long")
