"""XPath 1.0 over pages, with the set, math, string and pattern extensions, as an Arrow kernel.

The expression is parsed once on the driver, so a wrong one fails there; each page is parsed and evaluated in one pass, without
a shuffle. For plain structural steps over a materialised node table see :func:`pagemill.operators.selectors.axis`.
"""

from __future__ import annotations

import datetime
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.sources.nodes import per_page
from pagemill.sources.tree import HTML, Node, parse


class XPathError(ValueError):
    """The expression is not valid or a function is called wrongly."""


class Attribute:
    """An attribute as a node."""

    __slots__ = ("data", "kind", "ns", "parent", "tag")

    def __init__(self, owner: Node, name: str) -> None:
        self.kind, self.parent, self.tag, self.data, self.ns = "attribute", owner, name, owner.attrs[name], ""


class Namespace:
    """A namespace in scope of an element as a node."""

    __slots__ = ("data", "kind", "ns", "parent", "tag")

    def __init__(self, owner: Node, prefix: str, uri: str) -> None:
        self.kind, self.parent, self.tag, self.data, self.ns = "namespace", owner, prefix, uri, ""


# Namespaces of the trees of pages.
URIS = {"html": "http://www.w3.org/1999/xhtml", "svg": "http://www.w3.org/2000/svg", "math": "http://www.w3.org/1998/Math/MathML"}
AXES = (
    "ancestor", "ancestor-or-self", "attribute", "child", "descendant", "descendant-or-self", "following", "following-sibling",
    "namespace", "parent", "preceding", "preceding-sibling", "self",
)
REVERSE = frozenset(("ancestor", "ancestor-or-self", "preceding", "preceding-sibling"))
_LEX = re.compile(
    r"\s*(?:(\d+(?:\.\d*)?|\.\d+)|\"([^\"]*)\"|'([^']*)'|(\$[\w.-]+(?::[\w.-]+)?)|(::|//|\.\.|!=|<=|>=|[()\[\].@,/|+\-=<>*:])"
    r"|([^\W\d][\w.-]*(?::(?!:)(?:[^\W\d][\w.-]*|\*))?))"
)


@dataclass(frozen=True)
class Word:
    kind: str  # number, string, variable, sign, name, operator, end
    value: str


def lex(text: str) -> list[Word]:
    words: list[Word] = []
    at = 0
    while text[at:].strip():
        m = _LEX.match(text, at)
        if not m:
            raise XPathError(f"unexpected {text[at:].strip()[:10]!r}")
        at = m.end()
        before = words[-1] if words else None
        operand = before is not None and not (before.kind == "operator" or before.kind == "sign" and before.value in ("@", "::", "(", "[", ",", "/", "//", "|", "+", "-", "=", "!=", "<", "<=", ">", ">="))
        if m[1]:
            words.append(Word("number", m[1]))
        elif m[2] is not None or m[3] is not None:
            words.append(Word("string", m[2] if m[2] is not None else m[3]))
        elif m[4]:
            words.append(Word("variable", m[4][1:]))
        elif m[5]:
            words.append(Word("operator" if m[5] == "*" and operand else "sign", m[5]))
        else:
            words.append(Word("operator" if operand and m[6] in ("and", "or", "div", "mod") else "name", m[6]))
    return [*words, Word("end", "")]


class Parser:
    """Operator precedence by one method per level; the result is a tree of tuples."""

    LEVELS = (("or",), ("and",), ("=", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "div", "mod"))

    def __init__(self, text: str) -> None:
        self.words, self.at = lex(text), 0

    def now(self) -> Word:
        return self.words[self.at]

    def take(self, value: str | None = None) -> Word:
        word = self.now()
        if value is not None and word.value != value:
            raise XPathError(f"{value!r} expected, {word.value!r} found")
        self.at += 1
        return word

    def parse(self) -> tuple:
        tree = self.level(0)
        if self.now().kind != "end":
            raise XPathError(f"{self.now().value!r} is left over")
        return tree

    def level(self, n: int) -> tuple:
        if n == len(self.LEVELS):
            return self.unary()
        left = self.level(n + 1)
        while self.now().kind in ("operator", "sign") and self.now().value in self.LEVELS[n] and not (self.now().value == "*" and self.now().kind == "sign"):
            left = ("op", self.take().value, left, self.level(n + 1))
        return left

    def unary(self) -> tuple:
        if self.now() == Word("sign", "-"):
            self.take()
            return ("neg", self.unary())
        left = self.path()
        while self.now() == Word("sign", "|"):
            self.take()
            left = ("union", left, self.path())
        return left

    def starts_primary(self) -> bool:
        word, after = self.now(), self.words[min(self.at + 1, len(self.words) - 1)]
        if word.kind in ("number", "string", "variable") or word == Word("sign", "("):
            return True
        return word.kind == "name" and after == Word("sign", "(") and word.value not in ("node", "text", "comment", "processing-instruction")

    def path(self) -> tuple:
        if self.starts_primary():
            tree = self.primary()
            while self.now() == Word("sign", "["):
                tree = ("filter", tree, self.predicate())
            if self.now().value in ("/", "//") and self.now().kind == "sign":
                return ("path", tree, self.steps([]))
            return tree
        word = self.now()
        if word == Word("sign", "/"):
            self.take()
            nxt = self.now()
            if nxt.kind == "name" or nxt.kind == "sign" and nxt.value in (".", "..", "@", "*"):
                return ("path", ("root",), self.relative([]))
            return ("root",)
        if word == Word("sign", "//"):
            return ("path", ("root",), self.steps([]))
        return ("path", ("context",), self.relative([]))

    def steps(self, steps: list) -> list:
        while self.now().kind == "sign" and self.now().value in ("/", "//"):
            if self.take().value == "//":
                steps.append(("descendant-or-self", ("node",), []))
            steps.append(self.step())
        return steps

    def relative(self, steps: list) -> list:
        steps.append(self.step())
        return self.steps(steps)

    def step(self) -> tuple:
        word = self.now()
        if word == Word("sign", "."):
            self.take()
            return ("self", ("node",), [])
        if word == Word("sign", ".."):
            self.take()
            return ("parent", ("node",), [])
        axis = "child"
        if word == Word("sign", "@"):
            self.take()
            axis = "attribute"
        elif word.kind == "name" and self.words[self.at + 1] == Word("sign", "::"):
            axis = self.take().value
            if axis not in AXES:
                raise XPathError(f"no axis {axis}")
            self.take("::")
        test = self.test()
        predicates = []
        while self.now() == Word("sign", "["):
            predicates.append(self.predicate())
        return (axis, test, predicates)

    def test(self) -> tuple:
        word = self.take()
        if word.kind == "sign" and word.value == "*":
            return ("name", "*")
        if word.kind != "name":
            raise XPathError(f"a node test is missing before {word.value!r}")
        if word.value in ("node", "text", "comment", "processing-instruction") and self.now() == Word("sign", "("):
            self.take("(")
            if self.now().kind == "string":
                self.take()
            self.take(")")
            return (word.value,)
        return ("name", word.value)

    def predicate(self) -> tuple:
        self.take("[")
        tree = self.level(0)
        self.take("]")
        return tree

    def primary(self) -> tuple:
        word = self.take()
        if word.kind == "number":
            return ("number", float(word.value))
        if word.kind == "string":
            return ("string", word.value)
        if word.kind == "variable":
            return ("variable", word.value)
        if word.value == "(":
            tree = self.level(0)
            self.take(")")
            return tree
        self.take("(")
        arguments = []
        while self.now() != Word("sign", ")"):
            arguments.append(self.level(0))
            if self.now() == Word("sign", ","):
                self.take()
            elif self.now() != Word("sign", ")"):
                raise XPathError("an argument list is not closed")
        self.take(")")
        if word.value not in FUNCTIONS:
            raise XPathError(f"no function {word.value}()")
        return ("call", word.value, arguments)


def string_of(node: Node | Attribute) -> str:
    return node.data if node.kind in ("attribute", "text", "comment", "namespace", "processing-instruction") else node.text()


def to_string(value: object) -> str:
    if isinstance(value, list):
        return string_of(value[0]) if value else ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        if math.isinf(value):
            return "Infinity" if value > 0 else "-Infinity"
        return str(int(value)) if value == int(value) else f"{value:.15g}" if "e" not in f"{value:.15g}" else f"{value:f}".rstrip("0")
    return value


def to_number(value: object) -> float:
    if isinstance(value, bool):
        return float(value)
    if isinstance(value, float):
        return value
    text = to_string(value).strip(" \t\r\n")
    return float(text) if re.fullmatch(r"-?(?:\d+(?:\.\d*)?|\.\d+)", text) else math.nan


def to_boolean(value: object) -> bool:
    if isinstance(value, float):
        return value != 0 and not math.isnan(value)
    return bool(value)


def _round(x: float) -> float:
    return x if math.isnan(x) or math.isinf(x) else math.floor(x + 0.5)


class Page:
    """Document order and evaluation for one page."""

    def __init__(self, document: Node, variables: dict[str, object]) -> None:
        self.document, self.variables = document, variables
        self.order = {id(n): i for i, n in enumerate(document.walk())}
        self.nodes = list(document.walk())
        self.attributes: dict[tuple[int, str], Attribute] = {}

    def attribute(self, owner: Node, name: str) -> Attribute:
        key = (id(owner), name)
        if key not in self.attributes:
            self.attributes[key] = Attribute(owner, name)
        return self.attributes[key]

    def namespaces(self, node: Node) -> list[Namespace]:
        """The namespaces in scope of an element: those declared on it or above, its own, and that of ``xml``."""
        key = (id(node), "namespaces")
        if key not in self.attributes:
            found = {"xml": "http://www.w3.org/XML/1998/namespace"}
            for n in reversed([node, *self.walk_axis(node, "ancestor")]):
                declared = {k[6:]: v for k, v in n.attrs.items() if k == "xmlns" or k.startswith("xmlns:")} if n.kind == "element" else {}
                found |= declared
            if node.ns in URIS:
                found.setdefault("", URIS[node.ns])
            self.attributes[key] = [Namespace(node, prefix, uri) for prefix, uri in sorted(found.items()) if uri]
        return self.attributes[key]

    def key(self, node: Node | Attribute) -> tuple[int, int]:
        if node.kind == "namespace":
            return self.order[id(node.parent)], 0
        if node.kind == "attribute":
            return self.order[id(node.parent)], 1 + list(node.parent.attrs).index(node.tag)
        return self.order[id(node)], 0

    def sorted(self, nodes: list) -> list:
        return sorted({id(n): n for n in nodes}.values(), key=self.key)

    def walk_axis(self, node: Node | Attribute, axis: str) -> list:
        """Nodes along an axis, nearest first."""
        if axis == "self":
            return [node]
        if axis == "parent":
            return [node.parent] if node.parent is not None else []
        if axis in ("ancestor", "ancestor-or-self"):
            out = [node] if axis == "ancestor-or-self" else []
            while node.parent is not None:
                node = node.parent
                out.append(node)
            return out
        if node.kind in ("attribute", "namespace"):
            if axis in ("following", "preceding"):
                node = node.parent
            else:
                return [node] if axis == "descendant-or-self" else []
        if axis == "child":
            return node.children
        if axis in ("descendant", "descendant-or-self"):
            found = list(node.walk())
            return found if axis == "descendant-or-self" else found[1:]
        if axis == "attribute":
            return [self.attribute(node, k) for k in node.attrs if k != "xmlns" and not k.startswith("xmlns:") or node.ns == HTML] if node.kind == "element" else []
        if axis == "namespace":
            return self.namespaces(node) if node.kind == "element" else []
        if axis in ("following-sibling", "preceding-sibling"):
            if node.parent is None:
                return []
            siblings = node.parent.children
            at = siblings.index(node)
            return siblings[at + 1 :] if axis == "following-sibling" else siblings[:at][::-1]
        if axis == "following":
            end = self.order[id(node)] + sum(1 for _ in node.walk())
            return self.nodes[end:]
        if axis == "preceding":
            above = set(map(id, self.walk_axis(node, "ancestor")))
            return [n for n in self.nodes[: self.order[id(node)]] if id(n) not in above][::-1]
        return []

    @staticmethod
    def passes(node: Node | Attribute, test: tuple, axis: str) -> bool:
        if test[0] == "node":
            return True
        if test[0] != "name":
            return node.kind == test[0]
        if node.kind != (axis if axis in ("attribute", "namespace") else "element"):
            return False
        name = test[1]
        if name == "*":
            return True
        prefix, _, local = name.rpartition(":")
        if prefix and node.kind == "element" and node.ns != prefix:
            return False
        local = local if prefix else name
        return local == "*" or node.tag == local or node.ns == HTML and node.tag == local.lower()

    def value(self, tree: tuple, node: Node | Attribute, position: int = 1, size: int = 1) -> object:
        kind = tree[0]
        if kind == "path":
            start = self.value(tree[1], node, position, size)
            return self.steps(start, tree[2])
        if kind == "context":
            return [node]
        if kind == "root":
            return [self.document]
        if kind in ("number", "string"):
            return tree[1]
        if kind == "variable":
            if tree[1] not in self.variables:
                raise XPathError(f"no variable ${tree[1]}")
            return self.variables[tree[1]]
        if kind == "neg":
            return -to_number(self.value(tree[1], node, position, size))
        if kind == "union":
            return self.sorted([*self.value(tree[1], node, position, size), *self.value(tree[2], node, position, size)])
        if kind == "filter":
            nodes = self.value(tree[1], node, position, size)
            return self.filtered(nodes, tree[2])
        if kind == "call":
            return FUNCTIONS[tree[1]](self, node, position, size, [self.value(a, node, position, size) for a in tree[2]])
        return self.operator(tree, node, position, size)

    def filtered(self, nodes: list, predicate: tuple) -> list:
        out = []
        for i, n in enumerate(nodes, 1):
            v = self.value(predicate, n, i, len(nodes))
            if v == i if isinstance(v, float) else to_boolean(v):
                out.append(n)
        return out

    def steps(self, nodes: list, steps: list) -> list:
        for axis, test, predicates in steps:
            found = []
            for n in nodes:
                reached = [x for x in self.walk_axis(n, axis) if self.passes(x, test, axis)]
                for p in predicates:
                    reached = self.filtered(reached, p)
                found += reached
            nodes = self.sorted(found) if len(nodes) > 1 or axis in REVERSE else found
        return nodes

    def operator(self, tree: tuple, node: Node | Attribute, position: int, size: int) -> object:
        op = tree[1]
        left = self.value(tree[2], node, position, size)
        if op in ("and", "or"):
            if to_boolean(left) == (op == "or"):
                return op == "or"
            return to_boolean(self.value(tree[3], node, position, size))
        right = self.value(tree[3], node, position, size)
        if op in ("=", "!=", "<", "<=", ">", ">="):
            return compare(op, left, right)
        a, b = to_number(left), to_number(right)
        if op == "+":
            return a + b
        if op == "-":
            return a - b
        if op == "*":
            return a * b
        if math.isnan(a) or math.isnan(b):
            return math.nan
        if op == "div":
            return a / b if b else math.nan if a == 0 else math.copysign(math.inf, a) * math.copysign(1, b)
        return math.fmod(a, b) if b and not math.isinf(a) else math.nan


_TESTS: dict[str, Callable] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def compare(op: str, left: object, right: object) -> bool:
    """Comparison; for node-sets it holds if it does for some member."""
    test = _TESTS[op]
    sets = isinstance(left, list), isinstance(right, list)
    if any(sets) and not (isinstance(left, bool) or isinstance(right, bool)):
        lefts = [string_of(n) for n in left] if sets[0] else [left]
        rights = [string_of(n) for n in right] if sets[1] else [right]
        if op in ("=", "!=") and not isinstance(left, float) and not isinstance(right, float):
            if op == "=":
                return not set(map(to_string, lefts)).isdisjoint(map(to_string, rights))
            return any(a != b for a in set(lefts) for b in set(rights))
        ls, rs = [to_number(x) for x in lefts], [to_number(x) for x in rights]
        if op in ("=", "!="):
            return any(test(a, b) for a in ls for b in rs)
        ls, rs = [x for x in ls if not math.isnan(x)], [x for x in rs if not math.isnan(x)]
        if not ls or not rs:
            return False
        return test(min(ls), max(rs)) if op in ("<", "<=") else test(max(ls), min(rs))
    if op in ("=", "!="):
        if isinstance(left, bool) or isinstance(right, bool):
            return test(to_boolean(left), to_boolean(right))
        if isinstance(left, float) or isinstance(right, float):
            return test(to_number(left), to_number(right))
        return test(to_string(left), to_string(right))
    return test(to_number(left), to_number(right))


FUNCTIONS: dict[str, Callable] = {}


def _function(name: str, least: int, most: int | None = None):
    def wrap(body: Callable) -> Callable:
        def call(page: Page, node: Node, position: int, size: int, args: list) -> object:
            if len(args) < least or most is not None and len(args) > most:
                raise XPathError(f"{name}() is called with {len(args)} arguments")
            return body(page, node, position, size, args)

        FUNCTIONS[name] = call
        return body

    return wrap


def _text(node: Node, args: list) -> str:
    return to_string(args[0] if args else [node])


def _simple(name: str, least: int, most: int | None, body: Callable) -> None:
    _function(name, least, most)(lambda page, node, position, size, args: body(*args))


def _lang(page: Page, node: Node, position: int, size: int, args: list) -> bool:
    wanted = to_string(args[0]).lower()
    for n in page.walk_axis(node, "ancestor-or-self"):
        value = getattr(n, "attrs", {}).get("lang", getattr(n, "attrs", {}).get("xml:lang"))
        if value is not None:
            return value.lower() == wanted or value.lower().startswith(wanted + "-")
    return False


def _id(page: Page, node: Node, position: int, size: int, args: list) -> list:
    wanted = {w for v in (map(string_of, args[0]) if isinstance(args[0], list) else [to_string(args[0])]) for w in v.split()}
    return [n for n in page.nodes if n.kind == "element" and n.attrs.get("id") in wanted]


def _substring(text: object, start: object, length: object = None) -> str:
    s, a = to_string(text), _round(to_number(start))
    end = math.inf if length is None else a + _round(to_number(length))
    return "".join(c for i, c in enumerate(s, 1) if a <= i < end)


def _translate(text: object, source: object, target: object) -> str:
    table: dict[int, str | None] = {}
    to = to_string(target)
    for i, c in enumerate(to_string(source)):
        table.setdefault(ord(c), to[i] if i < len(to) else None)
    return to_string(text).translate(table)


def _flags(flags: str) -> int:
    return sum(f for c, f in (("i", re.I), ("s", re.S), ("m", re.M), ("x", re.X)) if c in flags)


def _replace(text: str, pattern: str, by: str, flags: str = "") -> str:
    return re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", by.replace("\\", "\\\\")), text, count=0, flags=_flags(flags))


_function("position", 0, 0)(lambda page, node, position, size, args: float(position))
_function("last", 0, 0)(lambda page, node, position, size, args: float(size))
_function("lang", 1, 1)(_lang)
_function("id", 1, 1)(_id)
_function("string", 0, 1)(lambda page, node, position, size, args: _text(node, args))
_function("string-length", 0, 1)(lambda page, node, position, size, args: float(len(_text(node, args))))
_function("normalize-space", 0, 1)(lambda page, node, position, size, args: " ".join(re.findall(r"[^ \t\r\n]+", _text(node, args))))
_function("number", 0, 1)(lambda page, node, position, size, args: to_number(args[0] if args else [node]))
_function("name", 0, 1)(lambda page, node, position, size, args: (args[0][0].tag if args[0] else "") if args else node.tag)


def _namespace_uri(page: Page, node: Node, position: int, size: int, args: list) -> str:
    if args and not args[0]:
        return ""
    n = args[0][0] if args else node
    if n.kind == "element" and n.ns not in URIS:
        prefix = n.tag.rpartition(":")[0]
        return next((x.data for x in page.namespaces(n) if x.tag == prefix), "")
    return URIS.get(n.ns, "")


def _local_name(page: Page, node: Node, position: int, size: int, args: list) -> str:
    if args and not args[0]:
        return ""
    return (args[0][0] if args else node).tag.rpartition(":")[2]


_function("namespace-uri", 0, 1)(_namespace_uri)
_function("local-name", 0, 1)(_local_name)
_simple("count", 1, 1, lambda nodes: float(len(nodes)))
_simple("sum", 1, 1, lambda nodes: float(sum(to_number(string_of(n)) for n in nodes)))
_simple("concat", 2, None, lambda *a: "".join(map(to_string, a)))
_simple("starts-with", 2, 2, lambda a, b: to_string(a).startswith(to_string(b)))
_simple("ends-with", 2, 2, lambda a, b: to_string(a).endswith(to_string(b)))
_simple("contains", 2, 2, lambda a, b: to_string(b) in to_string(a))
_simple("substring", 2, 3, _substring)
_simple("substring-before", 2, 2, lambda a, b: to_string(a).partition(to_string(b))[0] if to_string(b) in to_string(a) else "")
_simple("substring-after", 2, 2, lambda a, b: to_string(a).partition(to_string(b))[2] if to_string(b) in to_string(a) else "")
_simple("translate", 3, 3, _translate)
_simple("boolean", 1, 1, to_boolean)
_simple("not", 1, 1, lambda a: not to_boolean(a))
_simple("true", 0, 0, lambda: True)
_simple("false", 0, 0, lambda: False)
_simple("floor", 1, 1, lambda a: float(math.floor(to_number(a))) if math.isfinite(to_number(a)) else to_number(a))
_simple("ceiling", 1, 1, lambda a: float(math.ceil(to_number(a))) if math.isfinite(to_number(a)) else to_number(a))
_simple("round", 1, 1, lambda a: float(_round(to_number(a))))
_simple("lower-case", 1, 1, lambda a: to_string(a).lower())
_simple("upper-case", 1, 1, lambda a: to_string(a).upper())
_simple("string-join", 1, 2, lambda nodes, sep="": to_string(sep).join(map(string_of, nodes)))
_simple("matches", 2, 3, lambda a, b, f="": bool(re.search(to_string(b), to_string(a), _flags(to_string(f)))))
_simple("replace", 3, 4, lambda a, b, c, f="": _replace(to_string(a), to_string(b), to_string(c), to_string(f)))
_simple("re:test", 2, 3, lambda a, b, f="": bool(re.search(to_string(b), to_string(a), _flags(to_string(f)))))
_simple("re:replace", 4, 4, lambda a, b, f, c: _replace(to_string(a), to_string(b), to_string(c), to_string(f)))
_simple("math:min", 1, 1, lambda nodes: min((to_number(string_of(n)) for n in nodes), default=math.nan))
_simple("math:max", 1, 1, lambda nodes: max((to_number(string_of(n)) for n in nodes), default=math.nan))
_simple("math:abs", 1, 1, lambda a: abs(to_number(a)))
_simple("math:sqrt", 1, 1, lambda a: math.sqrt(to_number(a)) if to_number(a) >= 0 else math.nan)
_simple("math:power", 2, 2, lambda a, b: to_number(a) ** to_number(b))
for _name in ("sin", "cos", "tan", "exp"):
    _simple(f"math:{_name}", 1, 1, lambda a, f=getattr(math, _name): f(to_number(a)))
_simple("math:log", 1, 1, lambda a: math.log(to_number(a)) if to_number(a) > 0 else math.nan)
_simple("math:highest", 1, 1, lambda nodes: [n for n in nodes if to_number(string_of(n)) == max(to_number(string_of(x)) for x in nodes)])
_simple("math:lowest", 1, 1, lambda nodes: [n for n in nodes if to_number(string_of(n)) == min(to_number(string_of(x)) for x in nodes)])
_simple("set:distinct", 1, 1, lambda nodes: list({string_of(n): n for n in reversed(nodes)}.values())[::-1])
_simple("set:intersection", 2, 2, lambda a, b: (ids := set(map(id, b))) and [n for n in a if id(n) in ids] or [])
_simple("set:difference", 2, 2, lambda a, b: [n for n in a if id(n) not in ids] if (ids := set(map(id, b))) else a)
_simple("set:has-same-node", 2, 2, lambda a, b: not set(map(id, a)).isdisjoint(map(id, b)))
_function("set:leading", 2, 2)(lambda page, node, position, size, args: [n for n in args[0] if page.key(n) < page.key(args[1][0])] if args[1] else args[0])
_function("set:trailing", 2, 2)(lambda page, node, position, size, args: [n for n in args[0] if page.key(n) > page.key(args[1][0])] if args[1] else args[0])
_simple("str:concat", 1, 1, lambda nodes: "".join(map(string_of, nodes)))
_simple("str:padding", 1, 2, lambda n, c=" ": (to_string(c) * (int(to_number(n)) + 1))[: int(to_number(n))])
_simple("str:replace", 3, 3, lambda a, b, c: to_string(a).replace(to_string(b), to_string(c)))
_simple("str:align", 2, 3, lambda a, b, how="left": {"left": str.ljust, "right": str.rjust, "center": str.center}[to_string(how)](to_string(a), len(to_string(b)))[: len(to_string(b))])

_DATE = re.compile(r"\s*(-?\d{4,})(?:-(\d\d)(?:-(\d\d))?)?(?:T\d\d:\d\d:\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:\d\d)?\s*")


def _date(part: int) -> Callable:
    """The year, month or day of an ISO date (today without argument); not a number if the value has none."""

    def of(value: object = None) -> float:
        text = datetime.date.today().isoformat() if value is None else to_string(value)
        m = _DATE.fullmatch(text)
        return float(m[part]) if m and m[part] else math.nan

    return of


def _weekday(value: object = None) -> float:
    """1 for Sunday to 7 for Saturday."""
    year, month, day = (_date(i)(value) for i in (1, 2, 3))
    try:
        return float(datetime.date(int(year), int(month), int(day)).isoweekday() % 7 + 1)
    except ValueError:
        return math.nan


def _leap(value: object = None) -> bool | float:
    year = _date(1)(value)
    return math.nan if math.isnan(year) else year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)


for _name, _part in (("year", 1), ("month-in-year", 2), ("day-in-month", 3)):
    _simple(f"date:{_name}", 0, 1, _date(_part))
_simple("date:day-in-week", 0, 1, _weekday)
_simple("date:leap-year", 0, 1, _leap)

RESULT = "page_id bigint, pos int, kind string, pre int, tag string, value string"
_TYPES = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]


def evaluate(document: Node, tree: tuple, variables: dict[str, object] | None = None) -> object:
    page = Page(document, variables or {})
    return page, page.value(tree, document)


def xpath(pages: DataFrame, expression: str, variables: dict[str, str | float | bool] | None = None, html: str = "html", key: str = "page_id") -> DataFrame:
    """The result of the expression on every page: a row per node in document order, or one row with a value.

    ``kind`` is element, attribute, text, comment, document, string, number or boolean; ``value`` is the string value. A page
    on which a node-set is empty gives no row; a null page is an empty document. Wrong expressions raise on the driver.
    """
    tree = Parser(expression).parse()
    given = {k: float(v) if isinstance(v, int) and not isinstance(v, bool) else v for k, v in (variables or {}).items()}

    def kernel(text: str | None) -> list[tuple]:
        page, found = evaluate(parse(text), tree, given)
        if isinstance(found, list):
            return [(i, n.kind, page.key(n)[0], n.tag or None, string_of(n)) for i, n in enumerate(found, 1)]
        kind = "boolean" if isinstance(found, bool) else "number" if isinstance(found, float) else "string"
        return [(1, kind, None, None, to_string(found))]

    return per_page(pages, kernel, RESULT, _TYPES, html, key=key)
