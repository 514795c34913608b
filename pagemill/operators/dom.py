"""Trees of pages by hand: navigation, edits, paths, ranges, walkers, observers, shadow trees, builders; and ``apply``, which
runs a function over the tree of every page.

What an object of a browser keeps alive across calls is, in a table of pages, the state of one kernel: a function gets the tree of
one page, may use everything here on it, and gives rows or the edited page back.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.functions.markup import VOID, serialize
from pagemill.operators.edit import matches
from pagemill.operators.extract import grid
from pagemill.operators.selectors import parse_selector
from pagemill.sources.nodes import per_page
from pagemill.sources.tree import HTML, Node, parse, parse_fragment

# -- navigation ------------------------------------------------------------------------------------------------------------


def ancestors(node: Node) -> Iterator[Node]:
    while node.parent is not None:
        node = node.parent
        yield node


def root_of(node: Node) -> Node:
    return next(reversed([node, *ancestors(node)]))


def index_of(node: Node) -> int:
    """Place among the siblings, from 0."""
    return next((i for i, c in enumerate(node.parent.children) if c is node), 0) if node.parent is not None else 0


def next_siblings(node: Node) -> list[Node]:
    return node.parent.children[index_of(node) + 1 :] if node.parent is not None else []


def previous_siblings(node: Node) -> list[Node]:
    """Nearest first."""
    return node.parent.children[: index_of(node)][::-1] if node.parent is not None else []


def following(node: Node) -> Iterator[Node]:
    """Nodes after the node and what is below it, in document order."""
    for n in [node, *ancestors(node)]:
        for s in next_siblings(n):
            yield from s.walk()


def preceding(node: Node) -> Iterator[Node]:
    """Nodes before it that are not above it, nearest first."""
    for n in [node, *ancestors(node)]:
        for s in previous_siblings(n):
            yield from reversed(list(s.walk()))


def contains(node: Node, other: Node) -> bool:
    return other is node or any(a is node for a in ancestors(other))


def compare_position(a: Node, b: Node) -> int:
    """-1, 0 or 1 as ``a`` comes before, is, or comes after ``b`` in document order."""
    if a is b:
        return 0
    path = lambda n: [index_of(x) for x in reversed([n, *ancestors(n)])]
    return -1 if path(a) < path(b) else 1


def equal(a: Node, b: Node) -> bool:
    """Whether two trees have the same nodes, names, attributes and texts."""
    same = (a.kind, a.tag, a.ns, a.data, a.attrs) == (b.kind, b.tag, b.ns, b.data, b.attrs)
    return same and len(a.children) == len(b.children) and all(map(equal, a.children, b.children))


def clone(node: Node, deep: bool = True) -> Node:
    copy = Node(node.kind, node.tag, node.ns, dict(node.attrs), node.data)
    if node.content is not None:
        copy.content = clone(node.content)
    for c in node.children if deep else ():
        copy.append(clone(c))
    return copy


def strings(node: Node) -> list[str]:
    """The texts below a node without blanks around them; blank ones are left out."""
    return [t for n in node.walk() if n.kind == "text" and (t := n.data.strip())]


def select(node: Node, selector: str) -> list[Node]:
    parsed = parse_selector(selector)
    return [n for n in node.elements() if n is not node and any(matches(n, s) for s in parsed)]


def select_one(node: Node, selector: str) -> Node | None:
    return next(iter(select(node, selector)), None)


def match(node: Node, selector: str) -> bool:
    return any(matches(node, s) for s in parse_selector(selector))


def closest(node: Node, selector: str) -> Node | None:
    parsed = parse_selector(selector)
    return next((n for n in [node, *ancestors(node)] if n.kind == "element" and any(matches(n, s) for s in parsed)), None)


# -- edits -----------------------------------------------------------------------------------------------------------------


def nodes_of(value: Node | str | Iterable[Node | str]) -> list[Node]:
    """Nodes of what is to be inserted: a text stands for a text node."""
    if isinstance(value, str):
        return [Node("text", data=value)]
    return [value] if isinstance(value, Node) else [n for v in value for n in nodes_of(v)]


def append(parent: Node, *values: Node | str) -> Node:
    for n in nodes_of(values):
        parent.append(n)
    return parent


def prepend(parent: Node, *values: Node | str) -> Node:
    for n in reversed(nodes_of(values)):
        parent.insert(0, n)
    return parent


def insert_before(node: Node, *values: Node | str) -> None:
    for n in nodes_of(values):
        node.parent.insert(index_of(node), n)


def insert_after(node: Node, *values: Node | str) -> None:
    for n in reversed(nodes_of(values)):
        node.parent.insert(index_of(node) + 1, n)


def replace_with(node: Node, *values: Node | str) -> None:
    insert_before(node, *values)
    node.remove()


def wrap(node: Node, wrapper: Node) -> Node:
    node.parent.insert(index_of(node), wrapper)
    wrapper.append(node)
    return wrapper


def wrap_children(node: Node, wrapper: Node) -> Node:
    for c in list(node.children):
        wrapper.append(c)
    node.append(wrapper)
    return wrapper


def unwrap(node: Node) -> None:
    replace_with(node, *list(node.children))


def clear(node: Node) -> None:
    for c in list(node.children):
        c.remove()


def set_text(node: Node, text: str) -> None:
    clear(node)
    node.append(Node("text", data=text))


def set_inner_html(node: Node, html: str) -> None:
    clear(node)
    append(node, *parse_fragment(html, node.tag or "body"))


def insert_adjacent_html(node: Node, where: str, html: str) -> None:
    """``beforebegin``, ``afterbegin``, ``beforeend`` or ``afterend``."""
    inside = where in ("afterbegin", "beforeend")
    new = parse_fragment(html, node.tag if inside else (node.parent.tag or "body"))
    {"beforebegin": insert_before, "afterbegin": prepend, "beforeend": append, "afterend": insert_after}[where](node, *new)


def normalize(node: Node) -> None:
    """Join texts that stand side by side, drop empty ones."""
    for n in list(node.walk()):
        kept: list[Node] = []
        for c in list(n.children):
            if c.kind == "text" and (not c.data or kept and kept[-1].kind == "text"):
                if kept and kept[-1].kind == "text":
                    kept[-1].data += c.data
                c.remove()
            else:
                kept.append(c)


def prune(node: Node, keep: Callable[[Node], bool]) -> None:
    """Take out every element for which ``keep`` is false and that has none below for which it is true."""
    for n in reversed([x for x in node.elements() if x is not node]):
        if not keep(n) and not any(c.kind == "element" for c in n.children):
            n.remove()


def strip_tags(node: Node, *tags: str) -> None:
    for n in [x for x in node.elements() if x.tag in tags and x is not node]:
        unwrap(n)


def strip_elements(node: Node, *tags: str) -> None:
    for n in [x for x in node.elements() if x.tag in tags and x is not node]:
        n.remove()


def collapse_whitespace(node: Node) -> None:
    """Runs of white space in texts become one blank, except where they show as they are."""
    for n in node.walk():
        if n.kind == "text" and not any(a.tag in ("pre", "textarea", "script", "style") for a in ancestors(n)):
            n.data = re.sub(r"[ \t\n\f\r]+", " ", n.data)


def strip_comments(node: Node) -> None:
    for n in [x for x in node.walk() if x.kind == "comment"]:
        n.remove()


def transform(node: Node, function: Callable[[Node], Node | str | None | bool]) -> None:
    """Call the function on every element below, in document order: what it returns takes the element's place, ``None`` takes it
    out, and ``True`` leaves it."""
    for n in [x for x in node.elements() if x is not node]:
        if root_of(n) is root_of(node):
            result = function(n)
            if result is None or result is False:
                n.remove()
            elif result is not True and result is not n:
                replace_with(n, result)


# -- classes, tables, paths ------------------------------------------------------------------------------------------------


def classes(node: Node) -> list[str]:
    return node.attrs.get("class", "").split()


def has_class(node: Node, name: str) -> bool:
    return name in classes(node)


def add_class(node: Node, *names: str) -> None:
    node.attrs["class"] = " ".join(dict.fromkeys([*classes(node), *names]))


def remove_class(node: Node, *names: str) -> None:
    node.attrs["class"] = " ".join(c for c in classes(node) if c not in names)


def toggle_class(node: Node, name: str) -> bool:
    present = has_class(node, name)
    (remove_class if present else add_class)(node, name)
    return not present


def rows(table: Node) -> list[list[str]]:
    """The grid of a table with spans filled."""
    return grid(table)


def records(table: Node) -> list[dict[str, str]]:
    """The rows of a table by the texts of its first; repeated names get a number."""
    head, *body = grid(table) or [[]]
    names: list[str] = []
    for h in head:
        names.append(h if h not in names else f"{h}_{sum(x == h or x.startswith(h + '_') for x in names) + 1}")
    return [dict(zip(names, r, strict=False)) for r in body]


def escape_identifier(text: str) -> str:
    """A name as CSS writes it."""
    out = ""
    for i, c in enumerate(text):
        if c == "\0":
            out += "�"
        elif c < " " or c == "\x7f" or c in "0123456789" and (i == 0 or i == 1 and text[0] == "-"):
            out += f"\\{ord(c):x} "
        elif c == "-" and text == "-":
            out += "\\-"
        else:
            out += c if c > "\x7f" or c.isalnum() or c in "-_" else "\\" + c
    return out


def css_path(node: Node) -> str:
    """A selector that selects this element alone: up to the nearest unique id, then by place."""
    top, parts = root_of(node), []
    for n in [node, *ancestors(node)]:
        if n.kind != "element":
            break
        if (name := n.attrs.get("id")) and sum(x.attrs.get("id") == name for x in top.elements()) == 1:
            parts.append(f"#{escape_identifier(name)}")
            break
        same = [c for c in n.parent.children if c.kind == "element" and c.tag == n.tag] if n.parent is not None else [n]
        parts.append(escape_identifier(n.tag) + (f":nth-of-type({next(i for i, c in enumerate(same, 1) if c is n)})" if len(same) > 1 else ""))
    return " > ".join(reversed(parts))


def xpath_path(node: Node) -> str:
    """The location path of a node by names and places."""
    parts = []
    for n in [node, *ancestors(node)]:
        if n.kind == "document":
            break
        name = {"text": "text()", "comment": "comment()"}.get(n.kind, n.tag)
        same = [c for c in n.parent.children if (c.kind, c.tag) == (n.kind, n.tag)] if n.parent is not None else [n]
        parts.append(name + (f"[{next(i for i, c in enumerate(same, 1) if c is n)}]" if len(same) > 1 else ""))
    return "/" + "/".join(reversed(parts))


# -- builders --------------------------------------------------------------------------------------------------------------


class ElementMaker:
    """``E.div({"class": "a"}, "text", E.b("bold"))``: an element with attributes and content."""

    def __init__(self, ns: str = HTML) -> None:
        self.ns = ns

    def __call__(self, tag: str, *content: Node | str | Mapping[str, str], **attrs: str) -> Node:
        node = Node("element", tag, self.ns, {k.rstrip("_").replace("_", "-"): v for k, v in attrs.items()})
        for c in content:
            if isinstance(c, Mapping):
                node.attrs |= c
            else:
                append(node, c)
        return node

    def __getattr__(self, tag: str) -> Callable[..., Node]:
        if tag.startswith("__"):
            raise AttributeError(tag)
        return lambda *content, **attrs: self(tag.rstrip("_").replace("_", "-"), *content, **attrs)


E = ElementMaker()


def document(*content: Node | str, title: str | None = None, lang: str | None = None) -> Node:
    """A whole page around the content."""
    page = Node("document")
    page.append(Node("doctype", "html"))
    head = E.head(E.meta(charset="utf-8"), *([E.title(title)] if title is not None else []))
    page.append(E("html", {"lang": lang} if lang else {}, head, E.body(*content)))
    return page


class TreeBuilder:
    """What ``parse_into`` calls; another tree can be built by overriding it."""

    def create_document(self) -> object:
        return Node("document")

    def create_doctype(self, name: str) -> object:
        return Node("doctype", name)

    def create_element(self, tag: str, ns: str, attrs: dict[str, str]) -> object:
        return Node("element", tag, ns, dict(attrs))

    def create_text(self, data: str) -> object:
        return Node("text", data=data)

    def create_comment(self, data: str) -> object:
        return Node("comment", data=data)

    def create_pi(self, target: str, data: str) -> object:
        return Node("processing-instruction", target, data=data)

    def append(self, parent: object, child: object) -> None:
        parent.append(child)


class EtreeBuilder(TreeBuilder):
    """Builds trees of ``xml.etree``: texts become ``text`` and ``tail``."""

    def create_document(self) -> ET.Element:
        return ET.Element("document")

    def create_element(self, tag: str, ns: str, attrs: dict[str, str]) -> ET.Element:
        return ET.Element(tag, attrs)

    def create_text(self, data: str) -> str:
        return data

    def create_comment(self, data: str) -> ET.Element:
        return ET.Comment(data)

    def create_pi(self, target: str, data: str) -> ET.Element:
        return ET.ProcessingInstruction(target, data)

    def create_doctype(self, name: str) -> None:
        return None

    def append(self, parent: ET.Element, child: ET.Element | str | None) -> None:
        if isinstance(child, str):
            if len(parent):
                parent[-1].tail = (parent[-1].tail or "") + child
            else:
                parent.text = (parent.text or "") + child
        elif child is not None:
            parent.append(child)


def parse_into(builder: TreeBuilder, html: str | None) -> object:
    """The tree of a page, made by a builder."""

    def made(n: Node, parent: object) -> None:
        for c in (n.content or n).children:
            if c.kind == "element":
                new = builder.create_element(c.tag, c.ns, c.attrs)
                made(c, new)
            elif c.kind == "text":
                new = builder.create_text(c.data)
            elif c.kind == "comment":
                new = builder.create_comment(c.data)
            elif c.kind == "doctype":
                new = builder.create_doctype(c.tag)
            else:
                new = builder.create_pi(c.tag, c.data)
            builder.append(parent, new)

    top = builder.create_document()
    made(parse(html), top)
    return top


def to_etree(html: str | None) -> ET.Element:
    """The ``html`` element of a page as an ``xml.etree`` tree."""
    return next(x for x in parse_into(EtreeBuilder(), html) if x.tag == "html")


def from_etree(element: ET.Element) -> Node:
    """A tree of nodes from an ``xml.etree`` (or compatible) one."""
    if element.tag is ET.Comment:
        return Node("comment", data=element.text or "")
    if not isinstance(element.tag, str):
        return Node("processing-instruction", *(element.text or "").split(" ", 1)[:1], data=(element.text or "").partition(" ")[2])
    node = Node("element", element.tag, HTML, dict(element.attrib))
    if element.text:
        append(node, element.text)
    for child in element:
        append(node, from_etree(child))
        if child.tail:
            append(node, child.tail)
    return node


# -- ranges, walkers, observers ----------------------------------------------------------------------------------------------


def _size(n: Node) -> int:
    return len(n.data) if n.kind in ("text", "comment") else len(n.children)


@dataclass
class Range:
    """The part of a tree between two points, each a node and an offset in its text or children."""

    start_container: Node
    start_offset: int
    end_container: Node
    end_offset: int

    @classmethod
    def around(cls, node: Node) -> Range:
        at = index_of(node)
        return cls(node.parent, at, node.parent, at + 1)

    @classmethod
    def within(cls, node: Node) -> Range:
        return cls(node, 0, node, _size(node))

    @staticmethod
    def _point(container: Node, offset: int) -> list[float]:
        path = [float(index_of(x)) for x in reversed([container, *ancestors(container)])][1:]
        return [*path, offset - 0.5]

    @property
    def collapsed(self) -> bool:
        return self.start_container is self.end_container and self.start_offset == self.end_offset

    @property
    def common_ancestor_container(self) -> Node:
        above = [self.end_container, *ancestors(self.end_container)]
        return next(n for n in [self.start_container, *ancestors(self.start_container)] if any(n is x for x in above))

    def set_start(self, node: Node, offset: int) -> None:
        self.start_container, self.start_offset = node, offset
        if self._point(node, offset) > self._point(self.end_container, self.end_offset):
            self.end_container, self.end_offset = node, offset

    def set_end(self, node: Node, offset: int) -> None:
        self.end_container, self.end_offset = node, offset
        if self._point(node, offset) < self._point(self.start_container, self.start_offset):
            self.start_container, self.start_offset = node, offset

    def set_start_before(self, node: Node) -> None:
        self.set_start(node.parent, index_of(node))

    def set_start_after(self, node: Node) -> None:
        self.set_start(node.parent, index_of(node) + 1)

    def set_end_before(self, node: Node) -> None:
        self.set_end(node.parent, index_of(node))

    def set_end_after(self, node: Node) -> None:
        self.set_end(node.parent, index_of(node) + 1)

    def select_node(self, node: Node) -> None:
        other = Range.around(node)
        self.__dict__.update(other.__dict__)

    def select_node_contents(self, node: Node) -> None:
        self.__dict__.update(Range.within(node).__dict__)

    def collapse(self, to_start: bool = False) -> None:
        if to_start:
            self.end_container, self.end_offset = self.start_container, self.start_offset
        else:
            self.start_container, self.start_offset = self.end_container, self.end_offset

    def compare_point(self, node: Node, offset: int) -> int:
        """-1, 0 or 1 as the point lies before, in or after the range."""
        point = self._point(node, offset)
        if point < self._point(self.start_container, self.start_offset):
            return -1
        return 1 if point > self._point(self.end_container, self.end_offset) else 0

    def is_point_in_range(self, node: Node, offset: int) -> bool:
        return self.compare_point(node, offset) == 0

    def intersects_node(self, node: Node) -> bool:
        if node.parent is None:
            return True
        other = Range.around(node)
        return self._point(other.start_container, other.start_offset) < self._point(self.end_container, self.end_offset) and self._point(other.end_container, other.end_offset) > self._point(self.start_container, self.start_offset)

    def compare_boundary_points(self, how: str, other: Range) -> int:
        """``how``: start_to_start, start_to_end, end_to_end or end_to_start (a point of ``other`` to one of this)."""
        mine = self._point(self.end_container, self.end_offset) if how.startswith("start_to_end") or how.startswith("end_to_end") else self._point(self.start_container, self.start_offset)
        theirs = other._point(other.start_container, other.start_offset) if how.startswith("start") else other._point(other.end_container, other.end_offset)
        return (mine > theirs) - (mine < theirs)

    def clone_range(self) -> Range:
        return Range(self.start_container, self.start_offset, self.end_container, self.end_offset)

    def _piece(self, node: Node, take: bool) -> Node | None:
        """A copy of the part of a node inside the range; with ``take`` that part leaves the tree."""
        if node.kind in ("text", "comment"):
            begin = self.start_offset if node is self.start_container else 0
            end = self.end_offset if node is self.end_container else len(node.data)
            copy = Node(node.kind, data=node.data[begin:end])
            if take:
                node.data = node.data[:begin] + node.data[end:]
            return copy
        copy = Node(node.kind, node.tag, node.ns, dict(node.attrs))
        for c in list(node.children):
            around = Range.around(c)
            whole = self._point(around.start_container, around.start_offset) >= self._first and self._point(around.end_container, around.end_offset) <= self._last
            if whole:
                self._moves.append((c, copy)) if take else copy.append(clone(c))
            elif self.intersects_node(c) and (piece := self._piece(c, take)) is not None:
                self._moves.append((piece, copy)) if take else copy.append(piece)
        return copy

    def _contents(self, take: bool) -> Node:
        self._first, self._last = self._point(self.start_container, self.start_offset), self._point(self.end_container, self.end_offset)
        self._moves: list[tuple[Node, Node]] = []
        top = self.common_ancestor_container
        piece = self._piece(top, take)
        fragment = Node("document")
        for node, parent in self._moves:
            parent.append(node)
        if top.kind in ("text", "comment"):
            fragment.append(piece)
        for c in list(piece.children):
            fragment.append(c)
        if take:
            self.collapse(True)
        return fragment

    def clone_contents(self) -> Node:
        return self._contents(False)

    def extract_contents(self) -> Node:
        return self._contents(True)

    def delete_contents(self) -> None:
        self._contents(True)

    def insert_node(self, node: Node) -> None:
        at, where = self.start_container, self.start_offset
        if at.kind in ("text", "comment"):
            tail = Node("text", data=at.data[where:])
            at.data = at.data[:where]
            insert_after(at, node, tail)
        else:
            at.insert(where, node)

    def surround_contents(self, wrapper: Node) -> None:
        content = self.extract_contents()
        self.insert_node(wrapper)
        append(wrapper, *list(content.children))
        self.select_node(wrapper)

    def __str__(self) -> str:
        return self.clone_contents().text()


Filter = Callable[[Node], bool]


@dataclass
class TreeWalker:
    """Steps through the nodes below ``root`` that are of a wanted kind and pass the filter."""

    root: Node
    what_to_show: frozenset[str] | None = None
    filter: Filter | None = None
    current_node: Node = None

    def __post_init__(self) -> None:
        self.current_node = self.current_node or self.root

    def shows(self, n: Node) -> bool:
        return (self.what_to_show is None or n.kind in self.what_to_show) and (self.filter is None or self.filter(n))

    def _to(self, nodes: Iterable[Node]) -> Node | None:
        found = next((n for n in nodes if self.shows(n)), None)
        self.current_node = found if found is not None else self.current_node
        return found

    def _inside(self, nodes: Iterable[Node]) -> Iterator[Node]:
        return (n for n in nodes if n is not self.root and contains(self.root, n))

    def next_node(self) -> Node | None:
        return self._to(self._inside([*list(self.current_node.walk())[1:], *following(self.current_node)]))

    def previous_node(self) -> Node | None:
        order = list(self.root.walk())
        at = next(i for i, n in enumerate(order) if n is self.current_node)
        return self._to(reversed(order[:at]))

    def parent_node(self) -> Node | None:
        return self._to(self._inside(ancestors(self.current_node))) if self.current_node is not self.root else None

    def first_child(self) -> Node | None:
        return self._to(self.current_node.children)

    def last_child(self) -> Node | None:
        return self._to(reversed(self.current_node.children))

    def next_sibling(self) -> Node | None:
        return self._to(self._inside(next_siblings(self.current_node)))

    def previous_sibling(self) -> Node | None:
        return self._to(self._inside(previous_siblings(self.current_node)))


@dataclass
class NodeIterator:
    """Goes forwards and backwards over the shown nodes below ``root``, the root first."""

    root: Node
    what_to_show: frozenset[str] | None = None
    filter: Filter | None = None
    reference_node: Node = None
    pointer_before_reference_node: bool = True

    def __post_init__(self) -> None:
        self.reference_node = self.reference_node or self.root

    def _step(self, forward: bool) -> Node | None:
        order = list(self.root.walk())
        at = next((i for i, n in enumerate(order) if n is self.reference_node), 0)
        if forward:
            candidates = order[at:] if self.pointer_before_reference_node else order[at + 1 :]
        else:
            candidates = (order[:at] if self.pointer_before_reference_node else order[: at + 1])[::-1]
        for n in candidates:
            if (self.what_to_show is None or n.kind in self.what_to_show) and (self.filter is None or self.filter(n)):
                self.reference_node, self.pointer_before_reference_node = n, not forward
                return n
        return None

    def next_node(self) -> Node | None:
        return self._step(True)

    def previous_node(self) -> Node | None:
        return self._step(False)

    def __iter__(self) -> Iterator[Node]:
        while (n := self.next_node()) is not None:
            yield n


@dataclass
class MutationRecord:
    type: str  # childList, attributes, characterData
    target: Node
    added: list[Node] = field(default_factory=list)
    removed: list[Node] = field(default_factory=list)
    attribute: str | None = None
    old_value: str | None = None


class MutationObserver:
    """What changed below a node since it was observed, or since the records were taken."""

    def __init__(self, callback: Callable[[list[MutationRecord]], None] | None = None) -> None:
        self.callback, self.seen = callback, {}

    @staticmethod
    def _state(root: Node) -> dict[int, tuple]:
        return {id(n): (n, list(n.children), dict(n.attrs), n.data) for n in root.walk()}

    def observe(self, node: Node) -> None:
        self.seen[id(node)] = (node, self._state(node))

    def take_records(self) -> list[MutationRecord]:
        records = []
        for key, (root, before) in list(self.seen.items()):
            for n, children, attrs, data in before.values():
                old, new = set(map(id, children)), set(map(id, n.children))
                if old != new:
                    records.append(MutationRecord("childList", n, [c for c in n.children if id(c) not in old], [c for c in children if id(c) not in new]))
                records += [MutationRecord("attributes", n, attribute=k, old_value=attrs.get(k)) for k in sorted(attrs.keys() | n.attrs.keys()) if attrs.get(k) != n.attrs.get(k)]
                if n.data != data:
                    records.append(MutationRecord("characterData", n, old_value=data))
            self.seen[key] = (root, self._state(root))
        return records

    def deliver(self) -> None:
        if (records := self.take_records()) and self.callback:
            self.callback(records)

    def disconnect(self) -> None:
        self.seen.clear()


# -- shadow trees ----------------------------------------------------------------------------------------------------------


@dataclass
class ShadowRoot:
    """A tree beside an element's own children, with slots that those are assigned to."""

    host: Node
    mode: str = "open"
    delegates_focus: bool = False
    clonable: bool = False
    content: Node = field(default_factory=lambda: Node("document"))

    def append(self, *values: Node | str) -> None:
        append(self.content, *values)

    def set_inner_html(self, html: str) -> None:
        set_inner_html(self.content, html)

    def slots(self) -> list[Node]:
        return [n for n in self.content.elements() if n.tag == "slot"]

    def assigned_nodes(self, slot: Node) -> list[Node]:
        """The host's children that a slot shows: those that name it, the unnamed ones for the first unnamed slot; else none."""
        name = slot.attrs.get("name", "")
        if next((s for s in self.slots() if s.attrs.get("name", "") == name), None) is not slot:
            return []
        return [c for c in self.host.children if c.kind == "element" and c.attrs.get("slot", "") == name or c.kind == "text" and not name]

    def assigned_elements(self, slot: Node) -> list[Node]:
        return [n for n in self.assigned_nodes(slot) if n.kind == "element"]


# Elements of the standard that can have a shadow tree.
HOSTS = frozenset("article aside blockquote body div footer h1 h2 h3 h4 h5 h6 header main nav p section span".split())


def attach_shadow(host: Node, mode: str = "open", **options: bool) -> ShadowRoot:
    if host.tag not in HOSTS and "-" not in host.tag:
        raise ValueError(f"{host.tag} has no shadow tree")
    return ShadowRoot(host, mode, **options)


def declared_shadows(root: Node) -> list[ShadowRoot]:
    """Shadow trees that templates declare (``shadowrootmode``); the templates leave the tree."""
    out = []
    for t in [n for n in root.elements() if n.tag == "template" and n.attrs.get("shadowrootmode") in ("open", "closed")]:
        host = t.parent
        if host is not None and (host.tag in HOSTS or "-" in host.tag) and not any(s.host is host for s in out):
            shadow = ShadowRoot(host, t.attrs["shadowrootmode"], "shadowrootdelegatesfocus" in t.attrs, "shadowrootclonable" in t.attrs)
            append(shadow.content, *list((t.content or t).children))
            t.remove()
            out.append(shadow)
    return out


@dataclass(frozen=True)
class Matcher:
    """A selector compiled once."""

    pattern: str

    def __post_init__(self) -> None:
        parse_selector(self.pattern)

    def match(self, node: Node) -> bool:
        return match(node, self.pattern)

    def select(self, node: Node, limit: int = 0) -> list[Node]:
        found = select(node, self.pattern)
        return found[:limit] if limit else found

    def iselect(self, node: Node) -> Iterator[Node]:
        yield from select(node, self.pattern)

    def select_one(self, node: Node) -> Node | None:
        return select_one(node, self.pattern)

    def filter(self, nodes: Iterable[Node]) -> list[Node]:
        return [n for n in nodes if n.kind == "element" and match(n, self.pattern)]

    def closest(self, node: Node) -> Node | None:
        return closest(node, self.pattern)


# -- chains ----------------------------------------------------------------------------------------------------------------


class Query:
    """Elements of one page, in a chain of steps that each give such elements again."""

    def __init__(self, source: str | Node | Iterable[Node]) -> None:
        found = parse(source) if isinstance(source, str) else source
        self.nodes = [found] if isinstance(found, Node) else list(found)

    def __len__(self) -> int:
        return len(self.nodes)

    def __iter__(self) -> Iterator[Node]:
        return iter(self.nodes)

    def __getitem__(self, at: int) -> Node:
        return self.nodes[at]

    def __call__(self, selector: str) -> Query:
        return self.find(selector)

    def _of(self, nodes: Iterable[Node]) -> Query:
        return Query({id(n): n for n in nodes if n.kind == "element"}.values())

    def find(self, selector: str) -> Query:
        return self._of(x for n in self.nodes for x in select(n, selector))

    def filter(self, test: str | Callable[[Node], bool]) -> Query:
        return self._of(n for n in self.nodes if (match(n, test) if isinstance(test, str) else test(n)))

    def eq(self, at: int) -> Query:
        return self._of(self.nodes[at : at + 1 or None])

    def items(self) -> list[Query]:
        return [Query(n) for n in self.nodes]

    def parent(self) -> Query:
        return self._of(n.parent for n in self.nodes if n.parent is not None)

    def children(self, selector: str = "*") -> Query:
        return self._of(c for n in self.nodes for c in n.children if c.kind == "element" and match(c, selector))

    def siblings(self, selector: str = "*") -> Query:
        return self._of(c for n in self.nodes if n.parent is not None for c in n.parent.children if c is not n and c.kind == "element" and match(c, selector))

    def closest(self, selector: str) -> Query:
        return self._of(x for n in self.nodes if (x := closest(n, selector)) is not None)

    def text(self, value: str | None = None) -> str | Query:
        if value is None:
            return "".join(n.text() for n in self.nodes)
        for n in self.nodes:
            set_text(n, value)
        return self

    def html(self) -> str | None:
        return serialize(self.nodes[0], inner=True) if self.nodes else None

    def attr(self, name: str, value: str | None = None) -> str | None | Query:
        if value is None:
            return self.nodes[0].attrs.get(name) if self.nodes else None
        for n in self.nodes:
            n.attrs[name] = value
        return self

    def has_class(self, name: str) -> bool:
        return any(has_class(n, name) for n in self.nodes)

    def add_class(self, *names: str) -> Query:
        for n in self.nodes:
            add_class(n, *names)
        return self

    def remove_class(self, *names: str) -> Query:
        for n in self.nodes:
            remove_class(n, *names)
        return self

    def toggle_class(self, name: str) -> Query:
        for n in self.nodes:
            toggle_class(n, name)
        return self

    def remove(self) -> Query:
        for n in self.nodes:
            n.remove()
        return self


# -- over pages ------------------------------------------------------------------------------------------------------------


def apply(pages: DataFrame, function: Callable[[Node], None], html: str = "html", key: str = "page_id") -> DataFrame:
    """``rewritten``: every page after ``function`` has edited its tree in place. A null page is an empty document."""

    def kernel(text: str | None) -> list[tuple]:
        tree = parse(text)
        function(tree)
        return [(serialize(tree),)]

    return per_page(pages, kernel, "page_id bigint, rewritten string", [pa.string()], html, key=key)


def collect(pages: DataFrame, function: Callable[[Node], Iterable[str | None]], html: str = "html", key: str = "page_id") -> DataFrame:
    """``seq`` and ``value``: what ``function`` gives for the tree of every page."""

    def kernel(text: str | None) -> list[tuple]:
        return [(i, v) for i, v in enumerate(function(parse(text)), 1)]

    return per_page(pages, kernel, "page_id bigint, seq int, value string", [pa.int32(), pa.string()], html, key=key)


def paths(pages: DataFrame, selector: str, html: str = "html", key: str = "page_id") -> DataFrame:
    """``seq``, ``css`` and ``xpath``: the paths of what a selector selects."""

    def kernel(text: str | None) -> list[tuple]:
        return [(i, css_path(n), xpath_path(n)) for i, n in enumerate(select(parse(text), selector), 1)]

    return per_page(pages, kernel, "page_id bigint, seq int, css string, xpath string", [pa.int32(), pa.string(), pa.string()], html, key=key)


def table_records(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """``table_no``, ``row_no`` and ``record``: rows of all tables by the names in their first row."""

    def kernel(text: str | None) -> list[tuple]:
        tables = [n for n in parse(text).elements() if n.tag == "table"]
        return [(t, r, list(record.items())) for t, n in enumerate(tables, 1) for r, record in enumerate(records(n), 1)]

    return per_page(pages, kernel, "page_id bigint, table_no int, row_no int, record map<string,string>", [pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string())], html, key=key)


def is_void(node: Node) -> bool:
    return node.ns == HTML and node.tag in VOID
