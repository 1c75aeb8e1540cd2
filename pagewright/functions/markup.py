"""Selecting in page source: an element tree on the standard parser and a useful part of the selector language.

Selectors: type, `*`, `#id`, `.class`, `[attr]`, `[attr=v]`, `[attr^=v]`, `[attr$=v]`, `[attr*=v]`, `[attr~=v]`, `:first-child`,
`:last-child`, `:nth-child(n)`, joined by descendant, `>`, `+` and `~`, and lists of these by commas.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
_UNSEEN = frozenset("head script style template noscript title".split())
_LINES = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main nav ol p pre section table tr ul".split()
)
_ENDED_BY = {
    "li": {"li"}, "p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "pre", "blockquote", "footer", "header", "nav"},
    "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
}
#: An ampersand that begins no whole character reference.
_CUT_REFERENCE = re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_STEP = re.compile(
    r"""\s*(?P<join>[>+~]?)\s*(?P<simple>(?:\*|[\w-]+)?(?:[#.][\w-]+|\[[^\]]*\]|:first-child|:last-child|:nth-child\(\s*\d+\s*\))*)"""
)
_TERM = re.compile(r"""[#.][\w-]+|\[\s*([\w:-]+)\s*(?:([~^$*]?=)\s*("[^"]*"|'[^']*'|[^\]]*?)\s*)?\]|:[\w-]+(?:\(\s*(\d+)\s*\))?""")


class Element:
    __slots__ = ("tag", "attributes", "parent", "children", "elements", "place")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Element | str] = []
        #: The children that are elements, and this one's place among those of its parent, from 1.
        self.elements: list[Element] = []
        self.place = 0
        if parent is not None:
            parent.children.append(self)
            parent.elements.append(self)
            self.place = len(parent.elements)

    def descendants(self) -> Iterator[Element]:
        todo = self.elements[::-1]
        while todo:
            node = todo.pop()
            yield node
            todo += node.elements[::-1]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#document", {}, None)
        self.open = [self.root]
        #: By tag where it is open, so that no search walks the nesting.
        self.places: dict[str, list[int]] = {}
        self.lines: list[int] = []

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def cut(self, at: int) -> None:
        while len(self.open) > at:
            tag = self.open.pop().tag
            self.places[tag].pop()
            if tag in _LINES and tag != "p":
                self.lines.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while len(self.open) > 1 and tag in _ENDED_BY.get(self.open[-1].tag, ()):
            self.cut(len(self.open) - 1)
        # A paragraph left open around inline elements ends as well.
        if tag in _ENDED_BY["p"]:
            bound = self.lines[-1] if self.lines else 0
            while self.last("p") > bound:
                self.cut(self.last("p"))
        node = Element(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        if tag not in _EMPTY:
            self.places.setdefault(tag, []).append(len(self.open))
            if tag in _LINES and tag != "p":
                self.lines.append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and tag not in _EMPTY:
            self.cut(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if self.last(tag):
            self.cut(self.last(tag))

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        # `<![` begins nothing that pages may hold: a comment that ends at the next `>`.
        return self.parse_bogus_comment(i)


def parse(source: str | None, *, strict_references: bool = False) -> Element:
    """`strict_references`: a character reference without its semicolon is text, as in XML; pages are read as browsers read
    them without, where `&amp` counts and `&am` does not."""
    builder = _Builder()
    source = source or ""
    builder.feed(_CUT_REFERENCE.sub("&amp;", source) if strict_references else source)
    builder.close()
    return builder.root


def _compile(selector: str) -> list[list[tuple[str, str]]]:
    compiled = []
    for one in selector.split(","):
        at, steps = 0, []
        one = one.strip()
        while at < len(one):
            found = _STEP.match(one, at)
            if not found or not found["simple"]:
                raise ValueError(f"unsupported selector: {selector}")
            steps.append((found["join"] or " ", found["simple"]))
            at = found.end()
        if not steps:
            raise ValueError(f"unsupported selector: {selector}")
        compiled.append(steps)
    return compiled


def _is(node: Element, simple: str) -> bool:
    tag = re.match(r"\*|[\w-]+", simple)
    if tag and tag[0] not in ("*", node.tag) and tag[0].lower() != node.tag:
        return False
    for term in _TERM.finditer(simple, tag.end() if tag else 0):
        text = term[0]
        if text[0] == "#":
            ok = node.attributes.get("id") == text[1:]
        elif text[0] == ".":
            ok = text[1:] in node.attributes.get("class", "").split()
        elif text[0] == "[":
            value, wanted = node.attributes.get(term[1]), (term[3] or "").strip("\"'")
            tests = {None: lambda v: True, "=": wanted.__eq__, "^=": lambda v: v.startswith(wanted), "$=": lambda v: v.endswith(wanted), "*=": lambda v: wanted in v, "~=": lambda v: wanted in v.split()}
            ok = value is not None and bool(tests[term[2]](value))
        elif text == ":first-child":
            ok = node.place == 1
        elif text == ":last-child":
            ok = node.parent is not None and node.parent.elements[-1] is node
        else:
            ok = node.place == int(term[4])
        if not ok:
            return False
    return True


def _matches(root: Element, steps: list[tuple[str, str]]) -> set[Element]:
    """The elements that the steps lead to, step by step: each looks at an element once, however many siblings there are."""
    held: set[Element] = set()
    for at, (join, simple) in enumerate(steps):
        found: set[Element] = set()
        #: By parent how far `~` reaches back: the first place among its children that the step before matched.
        first: dict[int, int] = {}
        under: set[Element] = set()
        if join == "~" and at:
            for node in held:
                key = id(node.parent)
                first[key] = min(first.get(key, node.place), node.place)
        for node in root.descendants():
            parent = node.parent
            if join == " " and at and (parent in held or parent in under):
                under.add(node)
                led = True
            elif not at:
                led = True
            elif join == ">":
                led = parent in held
            elif join == "+":
                led = node.place > 1 and parent.elements[node.place - 2] in held
            elif join == "~":
                led = first.get(id(parent), node.place) < node.place
            else:
                led = False
            if led and _is(node, simple):
                found.add(node)
        held = found
    return held


def select(root: Element, selector: str) -> list[Element]:
    """Matching elements in document order."""
    found = set().union(*(_matches(root, steps) for steps in _compile(selector)))
    return [n for n in root.descendants() if n in found]


def inner_text(node: Element) -> str:
    """Visible text: white space collapsed, blocks and breaks on lines of their own, unseen elements left out."""
    out: list[str] = []

    def walk(top: Element) -> None:
        todo: list[Element | str | None] = [top]
        while todo:
            item = todo.pop()
            if item is None:
                out.append("\n")
            elif isinstance(item, str):
                out.append(_SPACES.sub(" ", item))
            elif item.tag == "br":
                out.append("\n")
            elif item.tag not in _UNSEEN and "hidden" not in item.attributes:
                block = item.tag in _LINES and item is not top
                todo += ([None] if block else []) + item.children[::-1] + ([None] if block else [])

    walk(node)
    lines = [line.strip(" ") for line in "".join(out).split("\n")]
    return "\n".join(_SPACES.sub(" ", line) for line in lines if line)


def base_of(root: Element) -> str | None:
    """The address that the page's links count from, as it is written; null where the page names none."""
    for node in root.descendants():
        if node.tag == "base" and "href" in node.attributes:
            return node.attributes["href"]
    return None


def _once(parser):
    """Keeps filters on parsed fields above the parser: pushed below, they would parse each page a second time."""
    return parser.asNondeterministic()


def _told(failure: Exception) -> str:
    return f"{type(failure).__name__}: {failure}"


def links_in(html: Column, selector: str) -> Column:
    """Struct of the page's `base`, its `hrefs` (the `href` of each element the selector matches, null where it has none; SVG
    links count by either name) and a `fault` where the page could not be read."""
    _compile(selector)

    @F.pandas_udf("base string, hrefs array<string>, fault string")
    def found(sources: pd.Series) -> pd.DataFrame:
        rows = []
        for source in sources:
            try:
                root = parse(source)
                rows.append((base_of(root), [n.attributes.get("href", n.attributes.get("xlink:href")) for n in select(root, selector)], None))
            except Exception as failure:  # no page fails the run
                rows.append((None, None, _told(failure)))
        return pd.DataFrame(rows, columns=["base", "hrefs", "fault"], dtype=object)

    return _once(found)(html)


def fields_in(html: Column, *, strict_references: bool = False, **selectors: str) -> Column:
    """Struct of the text of the first match of each selector, null where nothing matches, and a `fault` where the page could
    not be read."""
    for selector in selectors.values():
        _compile(selector)

    @F.pandas_udf(", ".join(f"{name} string" for name in (*selectors, "fault")))
    def found(sources: pd.Series) -> pd.DataFrame:
        rows = []
        for source in sources:
            try:
                root = parse(source, strict_references=strict_references)
                matches = {name: select(root, s) for name, s in selectors.items()}
                rows.append({name: inner_text(m[0]) if m else None for name, m in matches.items()})
            except Exception as failure:  # no page fails the run
                rows.append({"fault": _told(failure)})
        return pd.DataFrame([[r.get(c) for c in (*selectors, "fault")] for r in rows], columns=[*selectors, "fault"], dtype=object)

    return _once(found)(html)
