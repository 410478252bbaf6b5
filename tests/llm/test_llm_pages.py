"""Pages against a renderer of its own over html.parser, and pages that are costly to scan."""

import random
import re
import time
import unicodedata
from html.parser import HTMLParser

import pytest

from stavework.llm.html_text import visible_text


class Nodes(HTMLParser):
    """Well-formed pages as nested (name, attributes, children)."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.open = [("root", {}, [])]
        self.feed(html)
        self.close()

    def handle_starttag(self, name, attributes):
        node = (name, dict(attributes), [])
        self.open[-1][2].append(node)
        if name not in ("br", "hr", "img"):
            self.open.append(node)

    def handle_endtag(self, name):
        assert self.open.pop()[0] == name

    def handle_data(self, data):
        if self.open[-1][0] == "pre" and not self.open[-1][2] and self.get_starttag_text().startswith("<pre"):
            data = data.removeprefix("\n")
        self.open[-1][2].append(data)

    def unknown_decl(self, data):
        pass


SPACED = {"p", "h2", "ul", "ol", "pre", "table", "hr"}


def cells_of(text):
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def mark_of(attributes, number):
    kind = attributes.get("type", "1")
    if kind in "aA":
        text = chr(96 + number) if 0 < number < 27 else "a" + chr(70 + number) if 26 < number < 53 else str(number)
    elif kind in "iI":
        text = "x" * (number // 10) + ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"][number % 10] if 0 < number < 40 else str(number)
    else:
        text = str(number)
    return (text.upper() if kind in "AI" else text) + ". "


def atoms(node, pre, in_item, seen=True):
    """Words, blanks, edges of blocks (0: a line, 1: an empty line), forced ends of lines, and finished lines."""
    if isinstance(node, str):
        if not seen:
            return
        if pre:
            for k, part in enumerate(node.split("\n")):
                yield from [("end",)] * (k > 0)
                yield from [("word", part)] * bool(part)
            return
        for part in re.findall(r"[ \t\n\r\f]+|[^ \t\n\r\f]+", node):
            yield ("blank",) if part[0] in " \t\n\r\f" else ("word", part)
        return
    name, attributes, children = node
    if "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "") or name in ("script", "style"):
        return
    if name == "dialog" and "open" not in attributes:
        return
    if name == "details" and "open" not in attributes:
        children = [c for c in children if not isinstance(c, str) and c[0] == "summary"][:1]
    seen = {"visibility:hidden": False, "visibility:visible": True}.get(attributes.get("style", "").replace(" ", ""), seen)
    if name == "br":
        yield ("end",)
        return
    edge = [("edge", 1 if name in SPACED and not (in_item and name in ("ul", "ol")) else 0)] * (name in SPACED | {"div", "section", "details", "summary", "dialog"})
    yield from edge
    if name in ("ul", "ol"):
        own_items = [c for c in children if not isinstance(c, str) and "hidden" not in c[1]]
        down = "reversed" in attributes
        number = len(own_items) if down else 1
        for child in own_items:
            number = int(child[1].get("value", number))
            mark = "- " if name == "ul" else mark_of(attributes, number)
            number += -1 if down else 1
            below = {"visibility:hidden": False}.get(child[1].get("style"), seen)
            own = lines([a for c in child[2] for a in atoms(c, pre, True, below)])
            yield ("edge", 0)
            if not below:
                yield ("lines", [" " * len(mark) + x if x else "" for x in own])
                continue
            yield ("lines", [mark + own[0]] + [" " * len(mark) + x if x else "" for x in own[1:]] if own else [mark.strip()])
    elif name == "table":
        cells = [[lines([a for c in td[2] for a in atoms(c, pre, False, seen)]) or [""] for td in tr[2]] for tr in children]
        width = [max(cells_of(x) for row in cells for x in row[k]) for k in range(len(cells[0]))]
        out = []
        for row in cells:
            for i in range(max(map(len, row))):
                out.append("  ".join(padded(c[i] if i < len(c) else "", w) for c, w in zip(row, width, strict=True)).rstrip())
        yield ("lines", out)
    else:
        for child in children:
            yield from atoms(child, pre or name == "pre", in_item, seen)
    yield from edge


def padded(text, width):
    return text + " " * (width - cells_of(text))


def lines(found):
    done, line, owed, blank = [], "", 0, False

    def begin():
        nonlocal owed
        if not line:
            done.extend([""] * bool(owed and done))
            owed = 0

    for kind, *value in found:
        if kind == "blank":
            blank = True
        elif kind == "word":
            begin()
            line += (" " if blank and line else "") + value[0]
            blank = False
        elif kind == "end":
            begin()
            done.append(line.rstrip(" "))
            line, blank = "", False
        else:
            if line:
                done.append(line.rstrip(" "))
            line, blank = "", False
            if kind == "edge":
                owed = owed or value[0]
            elif value[0]:
                begin()
                done.extend(x.rstrip(" ") for x in value[0])
    if line:
        done.append(line.rstrip(" "))
    while done and not done[-1]:
        done.pop()
    return done


def page(rng, depth=0, block=True):
    """A random well-formed piece of a page."""
    word = lambda: rng.choice(["alpha", "b", "x &lt; y", "caf&eacute;", "hidden", "long word here", "&amp;", "  two  ", "\n", "é世界"])
    if depth > 4 or rng.random() < 0.35:
        return word() + rng.choice(["", " ", "<br>", "<b>bold</b> ", "<!-- note -->", "<span hidden>no</span>", "<script>if (a < b) c()</script>", "<![CDATA[gone]]>", "<i style='visibility:visible'>see</i>"])
    inner = lambda block=True: "".join(page(rng, depth + 1, block) for _ in range(rng.randrange(1, 4)))
    kind = rng.choice(["div", "section", "p", "h2", "pre", "ul", "ol", "table", "b", "gone", "hr", "details", "dialog", "veil"] if block else ["b", "i", "gone"])
    if kind == "gone":
        return rng.choice(['<b style="color: red; display: none">', "<b hidden>"]) + inner(False) + "</b>"
    if kind == "hr":
        return "<hr>"
    if kind == "veil":
        return f"<div style='visibility:hidden'>{inner()}<div style='visibility:visible'>{inner()}</div></div>"
    if kind == "details":
        return f"<details{rng.choice(['', ' open'])}>" + rng.choice(["", f"<summary>{inner(False)}</summary>"]) + inner() + "</details>"
    if kind == "dialog":
        return f"<dialog{rng.choice(['', ' open'])}>{inner()}</dialog>"
    if kind == "pre":
        return "<pre>" + rng.choice(["", "\n", "\n\n"]) + inner(False) + "</pre>"
    if kind in ("ul", "ol"):
        more = rng.choice(["", "", " reversed", " type=a", " type=I", " type=A reversed"]) if kind == "ol" else ""
        return f"<{kind}{more}>" + "".join(f"<li{rng.choice(['', '', '', ' hidden', ' style=visibility:hidden', ' value=27' * (kind == 'ol')])}>{inner()}</li>" for _ in range(rng.randrange(1, 4))) + f"</{kind}>"
    if kind == "table":
        n = rng.randrange(1, 4)
        return "<table>" + "".join("<tr>" + "".join(f"<td>{inner(False)}</td>" for _ in range(n)) + "</tr>" for _ in range(rng.randrange(1, 4))) + "</table>"
    title = rng.choice(["", ' title="the hidden truth"', ' class="hidden md:block"', ' data-css="display:none"', " style='visibility : visible'"])
    return f"<{kind}{title}>{inner(kind in ('div', 'section'))}</{kind}>"


@pytest.mark.parametrize("seed", range(400))
def test_pages_are_laid_out_as_by_the_renderer(seed):
    rng = random.Random(seed)
    html = "".join(page(rng) for _ in range(4))
    root = Nodes(html).open[0]
    assert visible_text(html).split("\n") == (lines([a for c in root[2] for a in atoms(c, False, False)]) or [""])


UNENDED = ["<a ", '<a "', "<a '", "<a<", "<", "</a ", '<p title="', "<!", "<a x='\"", "<b/", "<?", "&", "<a =\"'"]


@pytest.mark.parametrize("piece", UNENDED)
def test_a_megabyte_of_unended_tags_takes_seconds(piece):
    began = time.perf_counter()
    visible_text(piece * ((1 << 20) // len(piece)))
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize(("html", "text"), [
    ("a <b and then", "a <b and then"),
    ('<a href="x>y</a> z', '<a href="x>y z'),
    ("a < b <c", "a < b <c"),
    ("<ul><li><pre>a\n\nb</pre><li><p>c<p>d</ul>", "- a\n\n  b\n- c\n\n  d"),
    ("<table><tr><td><pre>a  b\nc</pre><td>d</table>", "a  b  d\nc"),
    ("<p style='visibility:hidden'>a <b style='visibility:visible'>b</b> c", "b"),
    ("a<div style='visibility:hidden'>x</div>b", "a\nb"),
    ("<details>no<summary>yes</summary>no<summary>no</summary></details>", "yes"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<ol type=i start=3><li>a<li value=9>b<li type=A>c</ol><ol reversed><li>x<li>y</ol><ol type=a start=-1><li>z</ol>", "iii. a\nix. b\nJ. c\n\n2. x\n1. y\n\n-1. z"),
    ("<pre>\n\na</pre>", "\na"),
    ("a<![CDATA[x]]>b<!-->c<!--x--!>d", "abcd"),
    ("<table><tr><td>世界<td>1<tr><td>abcd<td>2<tr><td>e\u0301<td>3</table>", "世界  1\nabcd  2\ne\u0301     3"),
    ("<table><tr><td style='visibility:hidden'>aa<td>b<tr><td>c<td>d<tr style='visibility:collapse'><td>long text<td>e</table>", "   b\nc  d"),
    ("<pre><table><tr><td>a  b<td>d</table></pre>", "a  b  d"),
])
def test_text_that_is_no_tag_and_spaces_that_count(html, text):
    assert visible_text(html) == text
