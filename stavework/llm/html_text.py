"""Visible text of HTML pages, laid out.

A page is cut into tags and text in one forward scan, whose time grows with the page
whatever is in it, built into a tree with the implied tags that browsers add (paragraphs,
list items, rows and cells that are never closed; tags that close others), and rendered: hidden parts are left out, white space is
collapsed outside ``pre``, blocks stand on lines of their own with an empty line around
paragraphs and headings, list items get their markers and indents, and the cells of a
table's columns are padded to the same width on a screen.

``display`` and the ``hidden`` attribute cut a whole subtree, as do a ``dialog`` and, but
for its summary, a ``details`` that aren't open. ``visibility`` is inherited: the text of
an invisible element is left out, its blocks and lines stay, and what is visible again
inside is shown. Style sheets are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Generator, Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stavework.llm.common import table, text_chunks, texts_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes title object audio video canvas svg math datalist select".split())
#: Blocks with an empty line before and after, and blocks with line breaks only.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr menu".split())
BLOCKS = SPACED | frozenset(
    "html body div section article aside nav header footer main address li dt dd tr thead tbody tfoot caption form fieldset legend details summary figcaption hgroup center search dialog option optgroup".split()
)
#: A start tag of the key closes an open element of the value, up to a border.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"optgroup", "option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
CLOSES |= {t: ({"p"}, {"td", "th", "button", "caption", "table", "object"}) for t in BLOCKS - set(CLOSES) - {"html", "body", "option", "optgroup", "tr"}}
#: Blocks that end an open head.
AFTER_HEAD = BLOCKS - {"html"} | frozenset("a b i span em strong img br".split())

_DECLARED = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)", re.S)
#: What ends a tag's name, and what ends a tag or begins a quoted value.
_NAME_END, _TAG_END = re.compile(r"[\s/>]"), re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|\"[^\"]*\"|'[^']*'")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: A declaration of a style: semicolons in strings and brackets don't end it.
_DECLARATION = re.compile(r"(?:[^;\"'(]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|\([^)]*(?:\)|\Z))++")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_NUMBER = re.compile(r"\s*([-+]?\d+)")
#: A step of the layout: yields the steps that it needs and is sent their results.
Step = Generator["Step", object, object]


def attributes_of(raw: str) -> dict[str, str]:
    """A tag's attributes by lower-case name; of a repeated one the first counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        if name:
            found.setdefault(name.lower(), unescape("".join(values)))
    return found


def display_and_visibility(style: str) -> tuple[str, str]:
    """Their values, empty where there is none; the last declaration counts, important ones first."""
    last = {"display": (False, ""), "visibility": (False, "")}
    for declaration in _DECLARATION.findall(_COMMENT.sub("", style)):
        name, _, value = declaration.partition(":")
        name, (value, mark, _) = name.strip().lower(), value.lower().partition("!")
        if name in last and (mark or not last[name][0]):
            last[name] = bool(mark), value.strip()
    return last["display"][1], last["visibility"][1]


class How(NamedTuple):
    """What an element hands down to its children."""

    pre: bool = False
    seen: bool = True


class Element:
    """An element with its children: strings and elements.

    hidden: it and all that is in it; visibility: its own value, if it has one.
    """

    __slots__ = ("attributes", "children", "hidden", "name", "visibility")

    def __init__(self, name: str, attributes: str = ""):
        self.name = name
        self.attributes = attributes_of(attributes) if attributes else {}
        self.children: list[Element | str] = []
        display, self.visibility = display_and_visibility(self.attributes["style"]) if "style" in self.attributes else ("", "")
        self.hidden = name in HIDDEN or "hidden" in self.attributes or display == "none" or (name == "dialog" and "open" not in self.attributes)

    def hands_down(self, how: How) -> How:
        seen = {"hidden": False, "collapse": False, "visible": True, "initial": True}.get(self.visibility, how.seen)
        return How(how.pre or self.name == "pre", seen)

    def shown(self) -> list[Element | str]:
        """The children that can be seen; of closed details the first summary."""
        if self.name != "details" or "open" in self.attributes:
            return self.children
        return [c for c in self.children if isinstance(c, Element) and c.name == "summary"][:1]

    def number(self, attribute: str, default: int) -> int:
        found = _NUMBER.match(self.attributes.get(attribute, ""))
        return int(found[1]) if found and len(found[1]) <= 10 else default  # browsers take 32 bits


class Tags:
    """Finds tags. A tag that never ends is text, and is not looked for again and again.

    Where the next character of a kind is, is kept for all places before it; a quote
    that was opened in a tag without an end is dead, and so is every later tag that gets
    to it. So each character is passed a few times at most.
    """

    def __init__(self, html: str):
        self.html = html
        self.known: dict[re.Pattern, tuple[int, int]] = {}
        self.dead: set[int] = set()

    def next(self, pattern: re.Pattern, at: int) -> int:
        low, found = self.known.get(pattern, (0, -1))
        if not low <= at <= found:
            match = pattern.search(self.html, at)
            found = match.start() if match else len(self.html)
            self.known[pattern] = at, found
        return found

    def end(self, at: int) -> int | None:
        """The place of the > that ends a tag whose attributes begin at ``at``."""
        opened: list[int] = []
        while (at := self.next(_TAG_END, at)) < len(self.html) and at not in self.dead:
            if self.html[at] == ">":
                return at
            opened.append(at)
            if (at := self.html.find(self.html[at], at + 1) + 1) == 0:
                break
        self.dead.update(opened)
        return None

    def tag(self, at: int) -> tuple[bool, str, str, int] | None:
        """(whether an end tag, name, attributes, place behind it) of the tag at a <."""
        html, first = self.html, at + 1 + html_is(self.html, "/", at + 1)
        if not (first < len(html) and html[first].isascii() and html[first].isalpha()):
            return None
        stop = self.next(_NAME_END, first)
        end = self.end(stop)
        return None if end is None else (first > at + 1, html[first:stop].lower(), html[stop:end], end + 1)


def html_is(html: str, character: str, at: int) -> bool:
    return html[at : at + 1] == character


def build(html: str) -> Element:
    """The page's tree. Anything is accepted; tags that fit nowhere are left out."""
    root = Element("html")
    stack = [root]
    depths: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements below root, by name
    at, end = 0, len(html)

    def push(element: Element) -> None:
        depths[element.name].append(len(stack))
        stack.append(element)

    def deepest(names: set[str]) -> int:
        return max((depths[name][-1] for name in names if depths.get(name)), default=0)

    def cut(depth: int) -> None:
        while len(stack) > depth:
            depths[stack.pop().name].pop()

    def close_to(names: set[str], borders: set[str]) -> None:
        depth = deepest(names)
        if depth and depth >= deepest(borders):
            cut(depth)

    def text(raw: str) -> None:
        if raw:
            stack[-1].children.append(unescape(raw) if "&" in raw else raw)

    tags, plain = Tags(html), 0  # text since ``plain`` is not in the tree yet
    while at < end:
        at = html.find("<", at)
        if at < 0:
            break
        if html_is(html, "!", at + 1) or html_is(html, "?", at + 1):
            text(html[plain:at])
            plain = at = _DECLARED.match(html, at).end()
            continue
        found = tags.tag(at)
        if found is None:
            at += 1
            continue
        text(html[plain:at])
        closing, name, attributes, at = found
        plain = at
        if closing:
            if name == "p" and not deepest({"p"}):
                stack[-1].children.append(Element("p"))
            elif name == "br":
                stack[-1].children.append(Element("br"))
            elif name not in ("html", "body"):
                close_to({name}, {"td", "th", "table"} - {name} if name not in ("table", "tr", "thead", "tbody", "tfoot") else {"table"} - {name})
            continue
        if name == "html":
            continue
        if name in CLOSES:
            close_to(*CLOSES[name])
        if name in AFTER_HEAD and len(stack) > 1 and stack[1].name == "head":
            cut(1)
        if name in ("td", "th") and stack[-1].name in ("table", "thead", "tbody", "tfoot"):  # a cell without a row
            row = Element("tr")
            stack[-1].children.append(row)
            push(row)
        element = Element(name, attributes)
        stack[-1].children.append(element)
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            stop = close.start() if close else end
            inner = html[at:stop]
            if name == "textarea":
                inner = inner.removeprefix("\r").removeprefix("\n")
            element.children.append(unescape(inner) if name in ("textarea", "title") else inner)
            plain = at = close.end() if close else end
        elif name not in VOID:
            push(element)
            if name == "pre":  # a line break right behind the tag is none
                at += html_is(html, "\r", at)
                at += html_is(html, "\n", at)
                plain = at
    text(html[plain:])
    return root


class Layout:
    """Lines of text with the spacing that blocks ask for.

    tight: inside a list's item, where further lists stand without empty lines.
    """

    def __init__(self, tight: bool = False) -> None:
        self.tight = tight
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # empty lines owed before the next text
        self.space = False
        self.marker = ""

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end_line()
        if spaced:
            self.gap = 1

    def _open(self) -> None:
        if not self.line:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = 0
            if self.marker:
                self.line.append(self.marker)
                self.marker = ""

    def flow(self, text: str) -> None:
        """Text whose white space collapses."""
        words = _SPACES.sub(" ", text)
        if words == " " or not words:
            self.space |= bool(words)
            return
        lead = words[0] == " "
        had = bool(self.line)
        self._open()
        if (self.space or lead) and had:
            self.line.append(" ")
        self.line.append(words.strip(" "))
        self.space = words[-1] == " "

    def verbatim(self, text: str) -> None:
        for k, part in enumerate(text.split("\n")):
            if k:
                self.break_line()
            if part:
                self._open()
                self.line.append(part)

    def break_line(self) -> None:
        self._open()
        self.lines.append("".join(self.line).rstrip(" "))
        self.line = []
        self.space = False

    def insert(self, lines: list[str]) -> None:
        """Finished lines, as a block; the first takes a waiting marker."""
        if lines:
            self._open()
            self.lines.append(("".join(self.line) + lines[0]).rstrip(" "))
            self.line = []
            self.lines.extend(lines[1:])

    def done(self) -> list[str]:
        self.end_line()
        if self.marker:
            self.lines.append(self.marker.rstrip(" "))
            self.marker = ""
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def finish(step: Step) -> object:
    """A step's result. Steps wait on a list, so that depth has no limit."""
    waiting, result = [step], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(result))
            result = None
        except StopIteration as done:
            waiting.pop()
            result = done.value
    return result


def put(text: str, out: Layout, how: How) -> None:
    if how.seen:
        out.verbatim(text) if how.pre else out.flow(text)


def render(element: Element, out: Layout, how: How) -> Step:
    """Put an element's visible text into ``out``; how: what its parent hands down."""
    name = element.name
    if element.hidden:
        return
    how = element.hands_down(how)
    if name == "br":
        out.break_line()
        return
    if name == "img" or name in VOID - {"hr"}:
        return
    if name in ("ul", "ol", "menu"):
        out.block(not out.tight)
        yield items(element, out, how)
        out.block(not out.tight)
        return
    if name == "table":
        out.block(True)
        out.insert((yield rows(element, how)))
        out.block(True)
        return
    is_block = name in BLOCKS
    if is_block:
        out.block(name in SPACED)
    for child in element.shown():
        if isinstance(child, str):
            put(child, out, how)
        else:
            yield render(child, out, how)
    if is_block:
        out.block(name in SPACED)


def lines_of(children: list[Element | str], how: How, tight: bool = False) -> Step:
    """Children laid out apart."""
    out = Layout(tight)
    for child in children:
        if isinstance(child, str):
            put(child, out, how)
        else:
            yield render(child, out, how)
    return out.done()


def letters(n: int) -> str:
    """1, 2, ... as a, b, ..., z, aa, ab, ..."""
    found = ""
    while n > 0:
        n, k = divmod(n - 1, 26)
        found = chr(ord("a") + k) + found
    return found


#: The numerals of 1,000 down to 1.
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def roman(n: int) -> str:
    found = ""
    for value, numeral in ROMAN:
        found += numeral * (n // value)
        n %= value
    return found


def ordinal(n: int, kind: str) -> str:
    """A list's number by its type; one that the type can't write is decimal."""
    if kind in ("a", "A") and n > 0:
        return letters(n) if kind == "a" else letters(n).upper()
    if kind in ("i", "I") and 0 < n < 4000:
        return roman(n) if kind == "i" else roman(n).upper()
    return str(n)


def items(element: Element, out: Layout, how: How) -> Step:
    """A list: markers, and deeper lines under their item's text."""
    step = -1 if "reversed" in element.attributes else 1
    own_items = sum(isinstance(c, Element) and c.name == "li" and not c.hidden for c in element.children)
    number, kind = element.number("start", 1 if step > 0 else own_items), element.attributes.get("type", "")
    for child in element.children:
        if isinstance(child, str):
            if how.seen:
                out.flow(child)
            continue
        if child.hidden:
            continue
        if child.name != "li":
            yield render(child, out, how)
            continue
        number = child.number("value", number)
        marker = f"{ordinal(number, child.attributes.get('type', kind))}. " if element.name == "ol" else "- "
        number += step
        out.block(False)
        below = child.hands_down(how)
        own = yield lines_of(child.children, below, tight=True)
        if not below.seen:  # nor is its marker seen
            out.insert([line and " " * len(marker) + line for line in own])
            continue
        out.insert([marker + own[0], *(line and " " * len(marker) + line for line in own[1:])] if own else [marker.rstrip(" ")])


def width(line: str) -> int:
    """Columns that a line takes on a screen: two for wide characters, none for combining ones."""
    if line.isascii():
        return len(line)
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


class Grid:
    """The cells of a table's rows by column, and the cells that reach into the next rows."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.reaching: list[tuple[int, int, float]] = []  # first column, end, rows left

    def end_group(self) -> None:
        """No cell reaches out of its group of rows."""
        self.reaching = []

    def row(self, cells: list[tuple[Element, list[str]]]) -> None:
        own, column, k, reaching = [], 0, 0, self.reaching
        taken = [(a, b, left - 1) for a, b, left in reaching if left > 1]
        for cell, lines in cells:
            while k < len(reaching) and reaching[k][0] <= column:
                column = max(column, reaching[k][1])
                k += 1
            own.append((column, lines))
            end = column + max(cell.number("colspan", 1), 1)
            down = cell.number("rowspan", 1)
            if down > 1 or down == 0:  # 0: to the end of the group
                taken.append((column, end, down - 1 if down else float("inf")))
            column = end
        self.reaching = sorted(taken) if len(taken) > 1 else taken
        if own:
            self.rows.append(own)

    def lines(self) -> list[str]:
        """Lines with columns padded; a column in which no cell begins takes no room."""
        widths: dict[int, int] = {}
        for cells in self.rows:
            for k, cell in cells:
                widths[k] = max(widths.get(k, 0), *map(width, cell))
        offsets, offset = {}, 0
        for k in sorted(widths):
            offsets[k] = offset
            offset += widths[k] + 2
        lines: list[str] = []
        for cells in self.rows:
            if len(cells) == 1 and not offsets[cells[0][0]]:
                lines.extend(cells[0][1])
                continue
            for i in range(max(len(cell) for _, cell in cells)):
                line = ""
                for k, cell in cells:
                    if i < len(cell) and cell[i]:
                        line += " " * (offsets[k] - width(line)) + cell[i]
                lines.append(line)
        return lines


def rows(element: Element, how: How) -> Step:
    """A table's lines: a caption, then rows with cells padded by column.

    how: what the table hands down. An invisible cell keeps its place; a collapsed row goes.
    """
    lines: list[str] = []
    grid = Grid()

    def walk(node: Element, how: How) -> Step:
        for child in node.children:
            if isinstance(child, str):
                if child.strip():  # text between cells stands before the table
                    lines.extend((yield lines_of([child], how)))
            elif child.hidden:
                continue
            elif child.name == "tr":
                if child.visibility == "collapse":
                    continue
                inner = child.hands_down(how)
                cells, stray = [], []
                for cell in child.children:
                    if isinstance(cell, Element) and cell.name in ("td", "th"):
                        if not cell.hidden:
                            cells.append((cell, (yield lines_of(cell.children, cell.hands_down(inner))) or [""]))
                    else:
                        stray.append(cell)
                lines.extend((yield lines_of(stray, inner)))
                grid.row(cells)
            elif child.name in ("thead", "tbody", "tfoot"):
                if child.visibility == "collapse":
                    continue
                grid.end_group()
                yield walk(child, child.hands_down(how))
                grid.end_group()
            elif child.name == "colgroup":
                yield walk(child, child.hands_down(how))
            else:
                lines.extend((yield lines_of([child], how)))

    yield walk(element, how)
    return lines + grid.lines()


def visible_text(html: str) -> str:
    """All visible text of a page, laid out; lines end without spaces."""
    out = Layout()
    finish(render(build(html), out, How()))
    return "\n".join(out.done())


def extract(pages: DataFrame) -> DataFrame:
    """Visible text of whole pages.

    pages: ``page_id``, ``html``; other columns are not read. Returns ``page_id``,
    ``text``, ``n_chars`` for every row, repeated ones too. A null or empty page, and one
    with nothing visible, has an empty text; what is no markup is text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "html"):
            texts = [visible_text(t.decode()) for t in texts_of(batch, "html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "text", "n_chars"]
            )

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
