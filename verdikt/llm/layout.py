"""Text of web pages as a reader sees it: a tree with implied tags, visibility, and a plain-text layout.

All visible text comes out once and in order. Blocks begin on lines of their own, paragraphs and the like stand between
blank lines, list items carry marks and indent, preformatted text keeps its blanks, and table cells stand in columns.

Not visible: comments, ``head``, scripts, styles and templates; elements with ``hidden``, ``display: none`` or
``visibility: hidden`` in their style or in a simple rule (tag, class, id) of a style sheet in the page; closed
``details`` but for their summary; hidden inputs. Elements nest to any depth; boxes in more than ``INDENTS`` others that
indent are not moved further to the right.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from verdikt.llm.batches import with_text_columns

INDENTS = 150
#: A cell wider than this runs over and does not widen its column: it would be repeated as blanks in every row.
COLUMN = 60

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title iframe noembed noframes object audio video canvas datalist area col colgroup param source track".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul
xmp""".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 menu ol p pre table ul dir hr xmp".split())
#: An element of the first kind closes an open one of the second, if none of the third is in between.
_SCOPE = frozenset("table td th caption button object html body template".split())
CLOSES = {
    **{t: (frozenset(["p"]), _SCOPE) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul xmp".split()},
    "li": (frozenset(["li", "p"]), _SCOPE | {"ul", "ol", "menu", "dir"}),
    "dt": (frozenset(["dt", "dd", "p"]), _SCOPE | {"dl"}), "dd": (frozenset(["dt", "dd", "p"]), _SCOPE | {"dl"}),
    "option": (frozenset(["option"]), _SCOPE | {"select", "datalist"}), "optgroup": (frozenset(["option", "optgroup"]), _SCOPE | {"select"}),
    "td": (frozenset(["td", "th", "caption"]), frozenset(["table"])), "th": (frozenset(["td", "th", "caption"]), frozenset(["table"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])),
    **{t: (frozenset(["tr", "td", "th", "thead", "tbody", "tfoot", "caption"]), frozenset(["table"])) for t in ("thead", "tbody", "tfoot")},
    "body": (frozenset(["head"]), frozenset(["body"])),
}
#: The parents without which an element of a table is given one.
PARENTS = {"td": ("tr", frozenset(["tr"])), "th": ("tr", frozenset(["tr"])), "tr": ("tbody", frozenset(["tbody", "thead", "tfoot"]))}
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*)?(?:([.#])([\w-]+))?")
_HIDES = re.compile(r"display\s*:\s*none|(visibility)\s*:\s*(hidden|collapse|visible)", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def get(self, name: str) -> str | None:
        """Value of an attribute, empty if it has none; None if it is not there."""
        if name not in self.attrs.lower():
            return None
        for key, *values in _ATTRIBUTE.findall(self.attrs):
            if key.lower() == name:
                return html.unescape(next((v for v in values if v), ""))
        return None


class Stack(list):
    """The open elements, and how many there are of each tag: what is not open is not searched for."""

    def __init__(self, root: Node) -> None:
        super().__init__([root])
        self.open, self.deepest = Counter(), 1

    def push(self, node: Node) -> None:
        self.append(node)
        self.open[node.tag] += 1
        self.deepest = max(self.deepest, len(self))

    def cut(self, at: int) -> None:
        while len(self) > at:
            self.open[self.pop().tag] -= 1


def parse(page: str) -> tuple[Node, list[str], int]:
    """The tree of a page, the texts of its style sheets, and the depth of the tree."""
    root = Node("html")
    stack, sheets, at = Stack(root), [], 0

    def text(data: str) -> None:
        if data:
            top = stack[-1]
            if top.tag == "head" and data.strip():  # text ends the head
                stack.cut(len(stack) - 1)
                top = stack[-1]
            top.children.append(data)

    while at < len(page):
        found = _TOKEN.search(page, at)
        if not found:
            text(html.unescape(page[at:]))
            break
        if found.start() > at:
            text(html.unescape(page[at:found.start()]))
        at = found.end()
        if found[0].startswith("<![CDATA["):
            text(found[0][9:].removesuffix("]]>"))
            continue
        if not found[1]:
            continue
        tag = found[1].lower()
        if found[0][1] == "/":
            _close(stack, tag)
            continue
        if tag in ("html", "body"):
            if tag == "body":
                _close_open(stack, "body")
            stack[0].attrs += found[2] if tag == "html" else ""
            if tag == "body" and len(stack) == 1:
                stack.push(Node("body", found[2]))
                root.children.append(stack[-1])
            continue
        if len(stack) > 1 and stack[-1].tag == "head" and tag not in HEAD_ONLY:
            stack.cut(len(stack) - 1)
        _close_open(stack, tag)
        if tag in PARENTS:
            _imply(stack, tag)
        node = Node(tag, found[2])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            inner = page[at:end.start() if end else len(page)]
            at = end.end() if end else len(page)
            if tag == "style":
                sheets.append(inner)
            elif tag in ("textarea", "title"):
                node.children.append(html.unescape(inner))
            elif tag == "xmp":
                node.children.append(inner)
        elif tag not in VOID:
            stack.push(node)
    return root, sheets, stack.deepest


def _imply(stack: Stack, tag: str) -> None:
    parent, allowed = PARENTS[tag]
    if stack[-1].tag in allowed or not stack.open["table"]:
        return
    if parent in PARENTS:
        _imply(stack, parent)
    stack[-1].children.append(Node(parent))
    stack.push(stack[-1].children[-1])


def _close_open(stack: Stack, tag: str) -> None:
    """Closes what the beginning of ``tag`` ends."""
    if tag not in CLOSES:
        return
    ended, within = CLOSES[tag]
    if not any(stack.open[t] for t in ended):
        return
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in within:
            break
        if stack[k].tag in ended:
            cut = k
            while cut > 1 and stack[cut - 1].tag in ended:
                cut -= 1
            stack.cut(cut)
            break


def _close(stack: Stack, tag: str) -> None:
    if tag == "p" and not stack.open["p"]:
        stack[-1].children.append(Node("p"))
    elif tag == "br":
        stack[-1].children.append(Node("br"))
    if not stack.open[tag]:
        return
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            stack.cut(k)
            return
        if stack[k].tag in ("td", "th", "table") and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html"):
            return


class Styles:
    """Which elements the page's own simple rules hide."""

    def __init__(self, sheets: list[str]) -> None:
        self.rules: dict[tuple[str, str], list[tuple[str, str]]] = {}
        for sheet in sheets:
            for selectors, body in _RULE.findall(re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)):
                effect = self.effect(body)
                if effect:
                    for selector in selectors.split(","):
                        simple = _SIMPLE.fullmatch(selector.strip())
                        if simple and (simple[1] or simple[3]):
                            self.rules.setdefault((simple[2] or "", simple[3] or simple[1].lower()), []).append((simple[1] or "", effect))

    @staticmethod
    def effect(style: str) -> str:
        """``none``, ``hidden`` or ``visible``, or nothing."""
        out = ""
        for m in _HIDES.finditer(style):
            if not m[1]:
                return "none"
            out = "visible" if m[2].lower() == "visible" else "hidden"
        return out

    def of(self, node: Node) -> str:
        if node.attrs:
            own = node.get("style")
            if own and (effect := self.effect(own)):
                return effect
            if node.get("hidden") is not None:
                return "none"
        if self.rules:
            keys = [("", node.tag), ("#", node.get("id") or ""), *[(".", c) for c in (node.get("class") or "").split()]]
            effects = [e for key in keys for tag, e in self.rules.get(key, ()) if not tag or not key[0] or tag.lower() == node.tag]
            if effects:
                return "none" if "none" in effects else effects[-1]
        return ""


class Page:
    """Lines of a box: a growing paragraph, and blank lines asked for before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.pending = self.wish = 0
        self.space = False

    def text(self, data: str) -> None:
        data = _BLANKS.sub(" ", data)
        if data == " " or not data:
            self.space = self.space or bool(data and self.parts)
            return
        if data[0] == " ":
            self.space = self.space or bool(self.parts)
        if self.space:
            self.parts.append(" ")
        self.space = data[-1] == " "
        self.parts.append(data.strip(" "))

    def end_line(self) -> None:
        if self.parts:
            self._put("".join(self.parts))
            self.parts = []
        self.space = False

    def _put(self, line: str) -> None:
        if self.wish and self.lines:
            self.lines.append("")
        self.wish = 0
        self.lines.append(line)

    def raw(self, lines: list[str], first: str = "", rest: str = "") -> None:
        """Whole lines, with something before the first and before the rest."""
        self.end_line()
        for k, line in enumerate(lines):
            self._put(((first if k == 0 else rest) + line).rstrip() if line else "")

    def gap(self) -> None:
        self.end_line()
        self.wish = 1


def _number(value: str | None, usual: int, least: int, most: int) -> int:
    found = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return min(max(int(found[1]), least), most) if found else usual


class Renderer:
    def __init__(self, styles: Styles) -> None:
        self.styles, self.level = styles, 0

    def inner(self, node: Node, shown: bool) -> list[str]:
        """Lines of a box that is to be indented."""
        self.level += 1
        lines = self.box(node, shown)
        self.level -= 1
        return lines

    def box(self, node: Node, shown: bool) -> list[str]:
        page = Page()
        self.children(node, page, shown)
        page.end_line()
        return page.lines

    def children(self, node: Node, page: Page, shown: bool) -> None:
        for child in node.children:
            if isinstance(child, str):
                if shown:
                    page.text(child)
            else:
                self.element(child, page, shown)

    def element(self, node: Node, page: Page, shown: bool) -> None:
        tag = node.tag
        if tag in UNSEEN:
            return
        effect = self.styles.of(node)
        if effect == "none":
            return
        shown = effect == "visible" or shown and effect != "hidden"
        if tag == "br":
            page.raw([""]) if not page.parts and shown and page.lines else page.end_line()
        elif tag == "wbr" or tag == "img":
            return
        elif tag == "input":
            if shown and (node.get("type") or "").lower() in ("submit", "button", "reset") and node.get("value"):
                page.text(f" {node.get('value')} ")
        elif tag == "select":
            options = list(_options(node))
            chosen = [o for o in options if o.get("selected") is not None] or options[:1]
            for option in options if node.get("multiple") is not None else chosen[:1]:
                page.text(" ")
                self.children(option, page, shown)
                page.text(" ")
        elif tag in ("pre", "xmp", "textarea"):
            if shown:
                lines = _plain(node).replace("\r\n", "\n").expandtabs(8).split("\n")
                if lines and not lines[0].strip():
                    lines = lines[1:]
                while lines and not lines[-1].strip():
                    lines.pop()
                page.gap()
                page.raw(lines)
                page.gap()
        elif tag == "hr":
            page.gap()
            if shown:
                page.raw(["---"])
            page.gap()
        elif tag == "table":
            lines = self.table(node, shown)
            if lines:
                page.gap()
                page.raw(lines)
                page.gap()
        elif tag in ("ul", "ol", "menu", "dir"):
            lines = self.list(node, shown)
            if lines:
                page.gap()
                page.raw(lines)
                page.gap()
        elif tag in ("blockquote", "dd"):
            lines = self.inner(node, shown)
            if lines:
                blanks = "  " if self.level < INDENTS else ""
                page.gap() if tag == "blockquote" else page.end_line()
                page.raw(lines, blanks, blanks)
                page.gap() if tag == "blockquote" else None
        elif tag == "details" and node.get("open") is None:
            page.end_line()
            for child in node.children:
                if isinstance(child, Node) and child.tag == "summary":
                    self.element(child, page, shown)
                    break
            page.end_line()
        elif tag in BLOCK:
            page.gap() if tag in SPACED else page.end_line()
            self.children(node, page, shown)
            page.gap() if tag in SPACED else page.end_line()
        elif tag == "q":
            page.text('"' if shown else "")
            self.children(node, page, shown)
            page.parts.append('"') if shown else None
        else:
            self.children(node, page, shown)

    def list(self, node: Node, shown: bool) -> list[str]:
        """Items after their marks, further lines under the first; what stands between items keeps its place."""
        page, number = Page(), _number(node.get("start"), 1, -10**9, 10**9)
        loose = Node("div")

        def settle() -> None:
            page.raw(self.box(loose, shown))
            loose.children = []

        for child in node.children:
            if isinstance(child, str) or child.tag != "li":
                loose.children.append(child)
                continue
            settle()
            effect = self.styles.of(child)
            if effect == "none":
                continue
            number = _number(child.get("value"), number, -10**9, 10**9) if node.tag == "ol" else number
            mark = f"{number}. " if node.tag == "ol" else "* "
            number += 1
            lines = self.inner(child, effect == "visible" or shown and effect != "hidden")
            if lines:
                page.raw(lines, mark, " " * len(mark) if self.level < INDENTS else "")
        settle()
        return page.lines

    def rows(self, node: Node, shown: bool) -> Iterator[tuple[list[tuple[Node, bool]], bool, Node]]:
        """Cells of each visible row, the footers last; what is no row comes as the row's node without cells."""
        late = []
        for child in node.children:
            if isinstance(child, str):
                if child.strip():
                    loose = Node("div")
                    loose.children = [child]
                    yield [], shown, loose
                continue
            effect = self.styles.of(child)
            if effect == "none" or child.tag in UNSEEN:
                continue
            seen = effect == "visible" or shown and effect != "hidden"
            if child.tag in ("tbody", "thead"):
                yield from self.rows(child, seen)
            elif child.tag == "tfoot":
                late.append((child, seen))
            elif child.tag == "tr":
                cells = []
                for cell in child.children:
                    if isinstance(cell, Node) and cell.tag in ("td", "th"):
                        effect = self.styles.of(cell)
                        if effect != "none":
                            cells.append((cell, effect == "visible" or seen and effect != "hidden"))
                    elif isinstance(cell, Node) and cell.tag not in UNSEEN or isinstance(cell, str) and cell.strip():
                        wrapped = Node("td")
                        wrapped.children = [cell]
                        cells.append((wrapped, seen))
                yield cells, seen, child
            else:
                yield [], seen, child
        for child, seen in late:
            yield from self.rows(child, seen)

    def table(self, node: Node, shown: bool) -> list[str]:
        grid: list[list[tuple[int, int, list[str], str]] | list[str]] = []
        held: dict[int, int] = {}     # column -> rows it is still taken by a cell from above
        for cells, seen, row in self.rows(node, shown):
            if not cells and row.tag != "tr":
                page = Page()
                self.element(row, page, seen)
                page.end_line()
                if page.lines:
                    grid.append(page.lines)
                continue
            out, column, taken = [], 0, {}
            for cell, cell_seen in cells:
                while held.get(column, 0) > 0:
                    column += 1
                wide, tall = _number(cell.get("colspan"), 1, 1, 1000), _number(cell.get("rowspan"), 1, 1, 65534)
                out.append((column, wide, self.box(cell, cell_seen), (cell.get("align") or "").lower()))
                if tall > 1:
                    taken.update((c, tall) for c in range(column, column + wide))
                column += wide
            held = {c: n - 1 for c, n in {**held, **taken}.items() if n > 1}
            if any(lines for _, _, lines, _ in out):
                grid.append(out)
        width: dict[int, int] = {}
        for row in grid:
            if row and isinstance(row[0], tuple):
                for column, wide, lines, _ in row:
                    if wide == 1 and (needed := max(map(len, lines), default=0)) <= COLUMN:
                        width[column] = max(width.get(column, 0), needed)
        out_lines: list[str] = []
        for row in grid:
            if not row or isinstance(row[0], str):
                out_lines += row
                continue
            for k in range(max(len(lines) for _, _, lines, _ in row)):
                line, edge, at = "", 0, 0
                for column, wide, lines, align in row:
                    for c in range(at, column):
                        edge += width.get(c, 0) + 2
                    room = sum(width.get(c, 0) for c in range(column, column + wide)) + 2 * (wide - 1)
                    piece = lines[k] if k < len(lines) else ""
                    if align == "right":
                        piece = piece.rjust(room)
                    elif align == "center":
                        piece = piece.center(room)
                    if piece.strip():
                        line = line.ljust(edge) if len(line) <= edge - 2 or not line else line + "  "
                        line += piece
                    edge, at = edge + room + 2, column + wide
                out_lines.append(line.rstrip())
        return out_lines


def _options(node: Node) -> Iterator[Node]:
    todo = node.children[::-1]
    while todo:
        child = todo.pop()
        if isinstance(child, Node):
            if child.tag == "option":
                yield child
            else:
                todo += child.children[::-1]


def _plain(node: Node) -> str:
    out, todo = [], node.children[::-1]
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            out.append(child)
        elif child.tag == "br":
            out.append("\n")
        elif child.tag not in UNSEEN:
            todo += child.children[::-1]
    return "".join(out)


def render(page: str | None) -> str:
    """Visible text of a page; nothing for a null or empty one."""
    if not page:
        return ""
    root, sheets, deep = parse(page.replace("\x00", ""))
    usual = sys.getrecursionlimit()
    # Calls between these methods take heap, not the C stack: at most four to a level, and five for a table.
    sys.setrecursionlimit(usual + 8 * deep)
    try:
        lines = Renderer(Styles(sheets)).box(root, True)
    finally:
        sys.setrecursionlimit(usual)
    return "\n".join(line.rstrip() for line in lines).strip("\n")


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` without the column ``column`` and with ``text`` rendered from it; empty where it is null."""
    given = pages.drop("rendered", *({"text"} - {column})).withColumnRenamed(column, "text")
    return with_text_columns(given, lambda texts: [pa.array([render(t) for t in texts.to_pylist()], pa.string())], "rendered string") \
        .select(*[c for c in given.columns if c != "text"], F.col("rendered").alias("text"))
