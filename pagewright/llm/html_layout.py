"""Layout-aware rendering of HTML to the visible text.

A tokenizer that reads every character once and a tree builder with implied end tags make the tree; visibility rules (elements
that never show, `hidden`, closed `details` and `dialog`, inline styles and simple selectors of style sheets) drop what a reader
does not see; everything else is laid out: white space collapses outside of preformatted text, blocks stand on lines of their
own, paragraphs and headings are set off by an empty line, list items carry their mark and indent, and table cells are padded to
columns, those that span several columns or rows as well. Cells with lists, preformatted text or tables keep their lines.

Style sheets are taken as a plain screen of `SCREEN` pixels takes them: rules for print, narrow screens or conditions that
are not understood do not apply, and of the rules for an element the cascade decides (`!important`, kind of selector, order).
Visibility is inherited until an element says otherwise. Selectors of several parts, with attributes or with states are not
followed, nor are sheets outside of the page.

Nesting has no limit, and time grows with the page (tables in tables are laid out once a level). Only blanks are bounded: an indent stops growing at `MAX_INDENT`, and a
cell stands at most `MAX_BLANKS` behind the one before it.

Defined cases: null html gives null, empty html the empty text; unclosed and stray tags never fail; an unclosed comment or
raw element runs to the end, a tag without its `>` takes the rest of the page; `/>` ends no element but foreign ones; extra
columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.common import pick, read

MAX_INDENT = 120
MAX_BLANKS = 400

_MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"[a-zA-Z][^ \t\n\f/>]*")
_GAP = re.compile(r"[ \t\n\f/]*")
_KEY = re.compile(r"=?[^ \t\n\f/>=]*")
_EQUALS = re.compile(r"[ \t\n\f]*+=[ \t\n\f]*")
_PLAIN = re.compile(r"[^ \t\n\f>]*")
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_CSS_MARK = re.compile(r"[{};]|\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?", re.S)
_SIMPLE = re.compile(r"[a-zA-Z][\w-]*|[.#][\w-]+")
#: Width and height of the screen that media conditions are held against.
SCREEN = {"width": 1280, "height": 800}
_SCREEN_IS = {"orientation": "landscape", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine"}
_EXTENT = re.compile(r"\(\s*(?:(min|max)-)?(width|height)\s*(:|<=|>=|<|>)\s*([\d.]+)(px|em|rem)?\s*\)")
_KEYWORD = re.compile(r"\(\s*([a-z-]+)\s*:\s*([a-z-]+)\s*\)")
_SPACE = re.compile(r"[ \t\n\r\f]+")

# Element kinds of HTML: fixed values of the standard.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Their content is no markup; in the latter, character references count.
_RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
_REFERENCES = frozenset(("textarea", "title"))
_NEVER = frozenset("head script style template noscript title datalist iframe object audio video canvas svg noembed noframes rp".split())
_FOREIGN = frozenset(("svg", "math"))
_LITERAL = frozenset("pre listing xmp textarea plaintext".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p plaintext pre section summary table tbody td tfoot th thead tr ul xmp".split()
)
_SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre listing xmp figure hr fieldset".split())
_CLOSES_P = _BLOCK - frozenset("body html li dd dt td th tr tbody thead tfoot legend summary".split())
#: A start tag on the left ends open elements on the right, up to the element that bounds the search.
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir", "table", "td", "th", "caption")),
    "dt": (("dt", "dd"), ("dl", "table", "td", "th", "caption")), "dd": (("dt", "dd"), ("dl", "table", "td", "th", "caption")),
    "tr": (("tr", "td", "th", "caption"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "caption"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "caption"), ("table",)), "tfoot": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "option": (("option",), ("select",)), "optgroup": (("optgroup", "option"), ("select",)), "body": (("head",), ("html",)),
}
_WALLS = ("td", "th", "table", "caption", "button")
_TABLE_PARTS = frozenset("table caption thead tbody tfoot tr td th".split())
_IN_HEAD = frozenset("meta link base title style script noscript template".split())
_KEEPS_LINES = frozenset("ul ol menu dir dl pre listing xmp table".split())
#: Fields that show their value.
_SHOWS_VALUE = frozenset(("", "text", "search", "email", "url", "tel", "number", "submit", "reset", "button"))


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes = tag, attributes or {}
        self.children: list[Node | str] = []


def _tag(markup: str, at: int) -> tuple[dict[str, str], bool, int] | None:
    """Attributes (the first of a name counts), whether it ends in `/>`, and the place behind the tag whose name ends at `at`;
    None: the page ends before the tag does."""
    attributes: dict[str, str] = {}
    while True:
        gap = _GAP.match(markup, at)
        at = gap.end()
        if at >= len(markup):
            return None
        if markup[at] == ">":
            return attributes, gap.group().endswith("/"), at + 1
        key = _KEY.match(markup, at)
        at, value = key.end(), ""
        if equals := _EQUALS.match(markup, at):
            at = equals.end()
            quote = markup[at : at + 1]
            if quote in ('"', "'"):
                close = markup.find(quote, at + 1)
                if close < 0:
                    return None
                value, at = markup[at + 1 : close], close + 1
            else:
                value = _PLAIN.match(markup, at).group()
                at += len(value)
        attributes.setdefault(key.group().lower(), html.unescape(value) if "&" in value else value)


class _Builder:
    """Open elements, and by tag the places where they are open, so that no search walks the nesting."""

    def __init__(self) -> None:
        self.open = [Node("#document")]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.sheets: list[Node] = []

    def last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def cut(self, at: int) -> None:
        """Ends the element open at that place and all inside."""
        while len(self.open) > at:
            tag = self.open.pop().tag
            self.places[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()

    def implied(self, tag: str) -> None:
        if tag in _IMPLIED:
            ended, bounds = _IMPLIED[tag]
            bound = self.last(bounds)
            # The outermost of them inside the bound.
            inside = [p[k] for t in ended if (p := self.places[t]) and (k := bisect_right(p, bound)) < len(p)]
            if inside:
                self.cut(min(inside))
        if tag in _CLOSES_P and self.last(("p",)) > self.last(_WALLS):
            self.cut(self.last(("p",)))
        if self.open[-1].tag == "head" and tag not in _IN_HEAD:
            self.cut(len(self.open) - 1)

    def start(self, tag: str, attributes: dict[str, str], closed: bool) -> Node | None:
        if tag in ("html", "body") and self.places[tag]:
            return None
        self.implied(tag)
        node = Node(tag, attributes)
        self.open[-1].children.append(node)
        if tag == "style":
            self.sheets.append(node)
        foreign = tag in _FOREIGN or self.last(("svg", "math"))
        if tag not in _VOID and not (closed and foreign):
            self.places[tag].append(len(self.open))
            if tag in _BLOCK:
                self.blocks.append(len(self.open))
            self.open.append(node)
        return node

    def end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br"))
            return
        if tag in ("html", "body"):
            return
        at = self.last((tag,))
        if tag in _TABLE_PARTS:
            bound = self.last(("table",)) if tag != "table" else 0
        elif tag in _NEVER:
            bound = 0
        elif tag in _BLOCK or tag == "button":
            bound = self.last(_WALLS if tag != "button" else _WALLS[:-1])
        else:
            # What is no block ends no block that was opened inside it.
            bound = max(self.blocks[-1] if self.blocks else 0, self.last(("table",)))
        if at > bound:
            self.cut(at)

    def text(self, text: str) -> None:
        node = self.open[-1]
        if text and not node.children and node.tag in _LITERAL:
            # A line break right behind the start tag does not count.
            text = text.removeprefix("\n")
        if text:
            node.children.append(text)


def build(markup: str) -> tuple[Node, list[Node]]:
    """The element tree, text with character references resolved, and its style sheets."""
    markup = markup.replace("\r\n", "\n").replace("\r", "\n")
    tree = _Builder()
    at, end = 0, len(markup)
    while at < end:
        found = _MARKUP.search(markup, at)
        start = found.start() if found else end
        if start > at:
            tree.text(html.unescape(markup[at:start]))
        if found is None:
            break
        if markup.startswith("<!--", start):
            if markup.startswith((">", "->"), start + 4):
                at = markup.index(">", start) + 1
                continue
            close = markup.find("-->", start + 4)
            at = end if close < 0 else close + 3
            continue
        ends = markup.startswith("</", start)
        name = _NAME.match(markup, start + 1 + ends)
        if name is None:
            close = markup.find(">", start)
            at = end if close < 0 else close + 1
            continue
        told = _tag(markup, name.end())
        if told is None:
            break
        tag = name.group().lower()
        attributes, closed, at = told
        if ends:
            tree.end(tag)
            continue
        node = tree.start(tag, attributes, closed)
        if tag == "plaintext":
            tree.text(markup[at:])
            break
        if node is not None and tag in _RAW and tree.open[-1] is node:
            close = re.compile(rf"</{tag}(?=[ \t\n\f/>])", re.I).search(markup, at)
            raw = markup[at : close.start() if close else end]
            tree.text(html.unescape(raw) if tag in _REFERENCES else raw)
            at = close.start() if close else end
    return tree.open[0], tree.sheets


def _condition(part: str) -> bool | None:
    """Whether a media condition holds on the screen; None: not understood."""
    if part in ("all", "screen", "print", "speech"):
        return part in ("all", "screen")
    if found := _EXTENT.fullmatch(part):
        bound, side, sign, number, unit = found.groups()
        try:
            size = float(number) * (16 if unit in ("em", "rem") else 1)
        except ValueError:
            return None
        sign = {"min": ">=", "max": "<="}.get(bound, sign)
        have = SCREEN[side]
        return {">=": have >= size, "<=": have <= size, ">": have > size, "<": have < size, ":": have == size}[sign]
    if (found := _KEYWORD.fullmatch(part)) and found[1] in _SCREEN_IS:
        return _SCREEN_IS[found[1]] == found[2]
    return None


def on_screen(media: str) -> bool:
    """Whether a list of media queries applies; one with a condition that is not understood does not."""
    if not media.strip():
        return True
    for query in media.lower().split(","):
        negated, query = re.fullmatch(r"\s*(?:(not)\b|only\b)?(.*)", query, re.S).groups()
        held = [_condition(part.strip()) for part in re.split(r"\band\b", query)]
        if None not in held and all(held) != bool(negated):
            return True
    return False


def _applies(at_rule: str) -> bool:
    name, rest = re.fullmatch(r"(@[\w-]*)(.*)", at_rule.lower(), re.S).groups()
    if name == "@media":
        return on_screen(rest)
    return name == "@layer" or name == "@supports" and not rest.strip().startswith("not")


def declarations(sheet: str) -> Iterator[tuple[str, str]]:
    """Selectors and text of each declaration that applies on the screen, in order."""
    sheet = _CSS_COMMENT.sub(" ", sheet)
    # Selectors of the open blocks: the empty text for at-rules outside of rules, None where nothing inside applies.
    open_: list[str | None] = [""]
    start = 0
    for found in _CSS_MARK.finditer(sheet):
        mark = found.group()
        if mark not in "{};":
            continue
        text = " ".join(sheet[start : found.start()].split())
        start = found.end()
        if mark != "{":
            if open_[-1]:
                yield open_[-1], text
            if mark == "}" and len(open_) > 1:
                open_.pop()
        elif open_[-1] is None:
            open_.append(None)
        elif text.startswith("@"):
            open_.append(open_[-1] if _applies(text) else None)
        else:
            # A rule inside a rule has a selector of several parts.
            open_.append(None if open_[-1] else text or None)
    if open_[-1]:
        yield open_[-1], " ".join(sheet[start:].split())


def _shown(declaration: str) -> tuple[str, bool, bool] | None:
    """Property, whether it is important, and whether it hides, of a declaration of display or visibility."""
    name, _, value = declaration.lower().partition(":")
    name = name.strip()
    if name not in ("display", "visibility"):
        return None
    value, mark, rest = value.partition("!")
    return name, bool(mark) and rest.strip() == "important", value.strip() in ("none", "hidden", "collapse")


class Styles:
    """What a document's own style sheets hide; selectors of one simple part only."""

    def __init__(self, sheets: list[Node] = ()):
        #: By selector and property the rule that decides: whether it is important, kind of selector, order, whether it hides.
        self.rules: dict[str, dict[str, tuple[bool, int, int, bool]]] = {}
        order = 0
        for sheet in sheets:
            if not on_screen(sheet.attributes.get("media", "")):
                continue
            for selectors, declaration in declarations("".join(c for c in sheet.children if isinstance(c, str))):
                if shown := _shown(declaration):
                    order += 1
                    for selector in selectors.split(","):
                        self._add(selector.strip(), order, *shown)

    def _add(self, selector: str, order: int, name: str, important: bool, hides: bool) -> None:
        if not _SIMPLE.fullmatch(selector):
            return
        kind = {"#": 2, ".": 1}.get(selector[0], 0)
        held = self.rules.setdefault(selector if kind else selector.lower(), {})
        held[name] = max(held.get(name, (False, 0, 0, False)), (important, kind, order, hides))

    def of(self, node: Node) -> tuple[bool, bool | None]:
        """Whether a node takes no place, and whether its text is visible (None: as its parent's)."""
        if node.tag in _NEVER:
            return True, None
        attributes = node.attributes
        if not attributes and not self.rules:
            return node.tag == "dialog", None
        if node.tag == "dialog" and "open" not in attributes:
            return True, None
        last: dict[str, tuple[bool, int, int, bool]] = {}
        if "hidden" in attributes:
            last["display"] = (False, -1, 0, True)
        named = [node.tag]
        if self.rules:
            named += [f".{c}" for c in attributes.get("class", "").split()]
            if "id" in attributes:
                named.append(f"#{attributes['id']}")
            for selector in named:
                for name, rule in self.rules.get(selector, {}).items():
                    last[name] = max(last.get(name, rule), rule)
        if inline := attributes.get("style"):
            for order, declaration in enumerate(_CSS_COMMENT.sub(" ", inline).split(";")):
                if shown := _shown(declaration):
                    rule = (shown[1], 3, order, shown[2])
                    last[shown[0]] = max(last.get(shown[0], rule), rule)
        hides = {name: rule[3] for name, rule in last.items()}
        return hides.get("display", False), not hides["visibility"] if "visibility" in hides else None


def _number(text: str | None, default: int, least: int, most: int) -> int:
    found = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return min(most, max(least, int(found[1]))) if found else default


class Layout:
    """Lines of visible text, with the spacing that is due before the next one.

    The methods that walk the tree are generators: each yields the walk of a part that comes first, and `run` keeps them on a
    list of its own, so nesting is bounded by memory only.
    """

    def __init__(self, styles: Styles):
        self.styles = styles
        self.lines: list[str] = []
        self.words: list[str] = []
        self.space = False
        self.due = 0
        self.indent = [""]
        self.lists = 0
        #: Indent and mark of an item's first line, until it is written.
        self.mark: str | None = None

    def line(self, text: str) -> None:
        if self.lines and self.due > 1:
            self.lines.append("")
        prefix = self.indent[-1] if self.mark is None else self.mark
        self.mark = None
        self.lines.append((prefix + text).rstrip())
        self.due = 0

    def flush(self) -> None:
        if self.words:
            self.line("".join(self.words))
        self.words, self.space = [], False

    def gap(self, size: int) -> None:
        self.flush()
        self.due = max(self.due, size)

    def push(self, blanks: int) -> None:
        held = self.indent[-1]
        self.indent.append(held + " " * blanks if len(held) < MAX_INDENT else held)

    def text(self, text: str) -> None:
        parts = _SPACE.sub(" ", text)
        if not parts:
            return
        if parts[0] == " ":
            self.space = True
            parts = parts[1:]
        if parts:
            if self.space and self.words:
                self.words.append(" ")
            self.space = parts[-1] == " "
            self.words.append(parts.rstrip(" "))

    def literal(self, text: str) -> None:
        first, *rest = text.split("\n")
        self.words.append(first)
        for more in rest:
            self.line("".join(self.words))
            self.words = [more]

    def children(self, node: Node, pre: bool, seen: bool) -> Iterator:
        for child in node.children:
            if isinstance(child, Node):
                yield self.element(child, pre, seen)
            elif seen:
                (self.literal if pre else self.text)(child)

    def element(self, node: Node, pre: bool, seen: bool) -> Iterator:
        gone, visible = self.styles.of(node)
        if gone:
            return
        tag, seen = node.tag, seen if visible is None else visible
        if tag == "br":
            if self.words or pre:
                self.flush()
            elif self.lines:
                self.due = 2
        elif tag == "table":
            self.gap(2)
            yield self.table(node, seen)
            self.gap(2)
        elif tag in ("ul", "ol", "menu", "dir"):
            # A nested list follows its item without an empty line.
            size = 1 if self.lists or len(self.indent) > 1 else 2
            self.gap(size)
            yield self.list(node, pre, seen)
            self.gap(size)
        elif tag in ("blockquote", "dd"):
            self.gap(2 if tag == "blockquote" else 1)
            self.push(2)
            yield self.children(node, pre, seen)
            self.gap(2 if tag == "blockquote" else 1)
            self.indent.pop()
        elif tag == "details" and "open" not in node.attributes:
            self.gap(1)
            for child in [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]:
                yield self.element(child, pre, seen)
            self.gap(1)
        elif tag == "input":
            if seen and node.attributes.get("type", "").lower() in _SHOWS_VALUE:
                self.text(node.attributes.get("value", ""))
        elif tag in _BLOCK:
            size = 2 if tag in _SPACED else 1
            self.gap(size)
            yield self.children(node, pre or tag in _LITERAL, seen)
            self.gap(size)
        elif node.children:
            yield self.children(node, pre or tag in _LITERAL, seen)

    def list(self, node: Node, pre: bool, seen: bool) -> Iterator:
        number = _number(node.attributes.get("start"), 1, -(10**9), 10**9) if node.tag == "ol" else 1
        self.lists += 1
        for child in node.children:
            if not isinstance(child, Node):
                if seen:
                    self.text(child)
            elif child.tag != "li":
                yield self.element(child, pre, seen)
            else:
                gone, visible = self.styles.of(child)
                if gone:
                    continue
                if node.tag == "ol":
                    number = _number(child.attributes.get("value"), number, -(10**9), 10**9)
                mark = f"{number}. " if node.tag == "ol" else "- "
                number += 1
                self.gap(1)
                shown = seen if visible is None else visible
                # An item that begins with a list shares its first line with the inner item.
                self.mark = (self.indent[-1] if self.mark is None else self.mark) + mark if shown else None
                self.push(len(mark))
                yield self.children(child, pre, shown)
                self.gap(1)
                self.indent.pop()
                self.mark = None
        self.lists -= 1

    def table(self, node: Node, seen: bool) -> Iterator:
        """Cells are placed first, on a grid of columns that a cell may span, and written row by row."""
        rows: list[list[tuple[int, int, list[str]]]] = []
        #: By its first column what is still held from rows above: the column behind it and the last row.
        held: dict[int, tuple[int, float]] = {}

        def cells(parts: list[tuple[Node, bool]]) -> Iterator:
            row: list[tuple[int, int, list[str]]] = []
            at, number = 0, len(rows)
            rows.append(row)
            new: dict[int, tuple[int, float]] = {}
            for part, shown in parts:
                while at in held:
                    at = held[at][0]
                # Browsers take no more columns and rows than these for one cell.
                behind = at + _number(part.attributes.get("colspan"), 1, 1, 1000)
                down = _number(part.attributes.get("rowspan"), 1, 0, 65534)
                inner = Layout(self.styles)
                inner.lists = 1
                yield inner.children(part, False, shown)
                inner.flush()
                keeps = any(n.tag in _KEEPS_LINES for n in _inside(part))
                row.append((at, behind, inner.lines if keeps else [" ".join(" ".join(inner.lines).split())]))
                if down != 1:
                    new[at] = behind, number + down - 1 if down else float("inf")
                at = behind
            for first in [f for f, (_, last) in held.items() if last <= number]:
                del held[first]
            held.update(new)

        def gather(part: Node, seen: bool) -> Iterator:
            for child in part.children:
                if not isinstance(child, Node):
                    if seen:
                        self.text(child)
                    continue
                gone, visible = self.styles.of(child)
                shown = seen if visible is None else visible
                if gone:
                    continue
                if child.tag in ("thead", "tbody", "tfoot"):
                    yield gather(child, shown)
                    held.clear()
                elif child.tag == "tr":
                    parts = []
                    for cell in child.children:
                        if not isinstance(cell, Node):
                            if shown:
                                self.text(cell)
                        elif cell.tag in ("td", "th"):
                            gone, visible = self.styles.of(cell)
                            if not gone:
                                parts.append((cell, shown if visible is None else visible))
                        else:
                            yield self.element(cell, False, shown)
                    yield cells(parts)
                elif child.tag in ("td", "th"):
                    yield cells([(child, shown)])
                else:
                    yield self.element(child, False, seen)

        yield gather(node, seen)
        self.flush()
        for text in _grid(rows):
            self.line(text)


def _inside(node: Node) -> Iterator[Node]:
    """The nodes of a cell, without those of cells within."""
    todo = [node]
    while todo:
        for child in todo.pop().children:
            if isinstance(child, Node):
                yield child
                if child.tag != "table":
                    todo.append(child)


def _grid(rows: list[list[tuple[int, int, list[str]]]]) -> Iterator[str]:
    """The lines of rows of cells (first column, column behind, lines); rows without text have none."""
    # Only columns where some cell begins matter, however many are spanned.
    begins = sorted({at for row in rows for at, _, _ in row})
    place = {at: k for k, at in enumerate(begins)}
    widths = [0] * len(begins)
    spanning = []
    for row in rows:
        for at, behind, lines in row:
            first, last = place[at], bisect_right(begins, behind - 1) - 1
            if first == last:
                widths[first] = max(widths[first], max(map(len, lines), default=0))
            else:
                spanning.append((last - first, first, last, max(map(len, lines), default=0)))
    for _, first, last, width in sorted(spanning):
        # A wide cell widens the last column it spans; behind the last one there is nothing to align.
        have = sum(widths[first : last + 1]) + 2 * (last - first)
        if width > have and last < len(begins) - 1:
            widths[last] += width - have
    starts = [0] * len(begins)
    for k in range(1, len(begins)):
        starts[k] = starts[k - 1] + widths[k - 1] + 2
    for row in rows:
        if not any(any(lines) for _, _, lines in row):
            continue
        for k in range(max(len(lines) for _, _, lines in row)):
            out, end = [], 0
            for at, _, lines in row:
                text = lines[k] if k < len(lines) else ""
                if text:
                    blanks = min(max(starts[place[at]] - end, 2 if end else 0), MAX_BLANKS)
                    out.append(" " * blanks + text)
                    end = max(end + blanks, starts[place[at]]) + len(text)
            yield "".join(out)


def run(walk: Iterator) -> None:
    """Runs a walk and the walks it yields, innermost first."""
    todo = [walk]
    while todo:
        part = next(todo[-1], None)
        if part is None:
            todo.pop()
        else:
            todo.append(part)


def render(markup: str | None) -> str | None:
    """The visible text of a page."""
    if markup is None:
        return None
    tree, sheets = build(markup)
    layout = Layout(Styles(sheets))
    run(layout.children(tree, False, True))
    layout.flush()
    return "\n".join(layout.lines)


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([render(m) for m in some.column(1).to_pylist()], pa.string())], names=["page_id", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return pick(pages, "page_id", "html").mapInArrow(_rendered, f"page_id {kind}, text string")


def op2_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
