"""XSLT 1.0 over pages: the stylesheet is read once on the driver, each page is transformed in its own kernel.

Templates by match and by name with modes, priorities and import precedence, built-in rules, variables and parameters, sorting,
numbering, copies, keys, attribute value templates, number formats, aliases of namespaces, fallbacks of unknown instructions.
Imported and included stylesheets come from a mapping of addresses to texts that the caller gives; nothing is fetched.
"""

from __future__ import annotations

import decimal
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.functions.markup import serialize
from pagemill.operators.xpath import FUNCTIONS, Attribute, Page, Parser, XPathError, string_of, to_boolean, to_number, to_string
from pagemill.sources.nodes import per_page
from pagemill.sources.tree import Node, parse
from pagemill.sources.xml import canonical, parse_xml


class StylesheetError(ValueError):
    """The stylesheet is not valid."""


# Instructions of XSLT 1.0.
INSTRUCTIONS = frozenset(
    f"xsl:{x}"
    for x in "apply-imports apply-templates attribute call-template choose comment copy copy-of element fallback for-each if message number processing-instruction text value-of variable".split()
)
#: Template calls within each other that a transformation may make.
DEPTH = 400


def _split(text: str, sign: str = "|") -> list[str]:
    """Alternatives of a pattern, outside brackets and quotes."""
    out, level, quote, begin = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "[(":
            level += 1
        elif c in "])":
            level -= 1
        elif c == sign and not level:
            out.append(text[begin:i])
            begin = i + 1
    return [*out, text[begin:]]


def _priority(pattern: str) -> float:
    if re.fullmatch(r"@?\*|(?:node|text|comment|processing-instruction)\(\)|@node\(\)", pattern):
        return -0.5
    return 0.0 if re.fullmatch(r"@?[\w.:-]+|processing-instruction\(.+\)", pattern) else 0.5


@dataclass
class Template:
    node: Node
    pattern: tuple | None
    priority: float
    mode: str
    place: int
    precedence: int = 0


@dataclass
class Stylesheet:
    templates: list[Template] = field(default_factory=list)
    named: dict[str, Node] = field(default_factory=dict)
    variables: list[Node] = field(default_factory=list)
    keys: dict[str, list[tuple[tuple, tuple]]] = field(default_factory=dict)
    sets: dict[str, list[Node]] = field(default_factory=dict)
    output: str = "xml"
    strip: list[str] = field(default_factory=list)
    preserve: list[str] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    formats: dict[str, dict[str, str]] = field(default_factory=dict)
    precedence: int = 0


def _local(node: Node) -> str | None:
    return node.tag[4:] if node.kind == "element" and node.tag.startswith("xsl:") else None


#: Stylesheets that may import each other in a row.
IMPORTS = 32


def compile_stylesheet(text: str, sources: dict[str, str] | None = None) -> Stylesheet:
    """The stylesheet, with those that it imports and includes taken from ``sources`` by address."""
    sheet = Stylesheet()
    _read(sheet, text, sources or {}, IMPORTS)
    return sheet


def _read(sheet: Stylesheet, text: str, sources: dict[str, str], depth: int, included: bool = False) -> None:
    root = next((n for n in parse_xml(text).children if n.kind == "element"), None)
    if root is None:
        raise StylesheetError("no xsl:stylesheet")
    if _local(root) not in ("stylesheet", "transform"):
        if "xsl:version" not in root.attrs:
            raise StylesheetError("no xsl:stylesheet")
        rule = Node("element", "xsl:template", "xml", {"match": "/"})  # the page itself is the only template
        root.remove()
        rule.append(root)
        holder = Node("element", "xsl:stylesheet", "xml")
        holder.append(rule)
        root = holder
    if not depth:
        raise StylesheetError("stylesheets import each other without end")
    for n in (c for c in root.children if c.kind == "element"):  # imports come first and weigh less
        if _local(n) == "import":
            if n.attrs.get("href") not in sources:
                raise StylesheetError(f"no stylesheet {n.attrs.get('href')}")
            _read(sheet, sources[n.attrs["href"]], sources, depth - 1)
    if not included:
        sheet.precedence += 1
    for n in (c for c in root.children if c.kind == "element"):
        kind = _local(n)
        if kind == "include":
            if n.attrs.get("href") not in sources:
                raise StylesheetError(f"no stylesheet {n.attrs.get('href')}")
            _read(sheet, sources[n.attrs["href"]], sources, depth - 1, True)
        elif kind == "template":
            if "name" in n.attrs:
                sheet.named[n.attrs["name"]] = n
            for pattern in _split(n.attrs.get("match", "")):
                if pattern.strip():
                    p = pattern.strip()
                    priority = float(n.attrs["priority"]) if "priority" in n.attrs else _priority(p)
                    tree = Parser(p if p.startswith(("/", "id(", "key(")) else f"//{p}").parse()
                    sheet.templates.append(Template(n, tree, priority, n.attrs.get("mode", ""), len(sheet.templates), sheet.precedence))
        elif kind in ("variable", "param"):
            sheet.variables = [v for v in sheet.variables if v.attrs["name"] != n.attrs["name"]] + [n]
        elif kind == "key":
            sheet.keys.setdefault(n.attrs["name"], []).append((Parser("//" + n.attrs["match"]).parse(), Parser(n.attrs["use"]).parse()))
        elif kind == "output":
            sheet.output = n.attrs.get("method", sheet.output)
        elif kind == "attribute-set":
            sheet.sets.setdefault(n.attrs["name"], []).extend(c for c in n.children if _local(c) == "attribute")
        elif kind == "strip-space":
            sheet.strip += n.attrs.get("elements", "").split()
        elif kind == "preserve-space":
            sheet.preserve += n.attrs.get("elements", "").split()
        elif kind == "namespace-alias":
            prefix = lambda v: "" if v == "#default" else v
            sheet.aliases[prefix(n.attrs["stylesheet-prefix"])] = prefix(n.attrs["result-prefix"])
        elif kind == "decimal-format":
            sheet.formats[n.attrs.get("name", "")] = dict(n.attrs)
        elif kind not in ("import", None):
            raise StylesheetError(f"xsl:{kind} at the top")


class Transform:
    """One page through one stylesheet."""

    def __init__(self, sheet: Stylesheet, document: Node, parameters: dict[str, object]) -> None:
        self.sheet, self.document = sheet, document
        if sheet.strip:

            def dropped(tag: str) -> bool:  # a name weighs more than the star
                if tag in sheet.strip or tag in sheet.preserve:
                    return tag not in sheet.preserve
                return "*" in sheet.strip and "*" not in sheet.preserve

            for n in list(document.walk()):
                if n.kind == "text" and not n.data.strip() and n.parent is not None and dropped(n.parent.tag):
                    n.remove()
        self.page = Page(document, {})
        self.page.transform = self
        self.parsed: dict[str, tuple] = {}
        self.matched: dict[int, set[int]] = {}
        self.depth = 0
        self.rule: Template | None = None
        self.current: Node | Attribute = document
        for i, t in enumerate(sheet.templates):
            self.matched[i] = {id(n) for n in self.page.value(t.pattern, document)}
        variables: dict[str, object] = dict(parameters)
        for n in sheet.variables:
            if not (_local(n) == "param" and n.attrs["name"] in parameters):
                variables[n.attrs["name"]] = self.bound(n, document, 1, 1, variables)
        self.globals = variables

    def value(self, text: str, node: Node | Attribute, position: int, size: int, variables: dict) -> object:
        if text not in self.parsed:
            self.parsed[text] = Parser(text).parse()
        before, self.page.variables = self.page.variables, variables
        self.current = node
        try:
            return self.page.value(self.parsed[text], node, position, size)
        finally:
            self.page.variables = before

    def bound(self, n: Node, node: Node | Attribute, position: int, size: int, variables: dict) -> object:
        if "select" in n.attrs:
            return self.value(n.attrs["select"], node, position, size, variables)
        holder = Node("document")
        self.body(n, holder, node, position, size, variables)
        return holder.text()

    def filled(self, text: str, node: Node | Attribute, position: int, size: int, variables: dict) -> str:
        """An attribute value template."""
        parts = re.split(r"(\{\{|\}\}|\{[^{}]*\})", text)
        return "".join("{" if p == "{{" else "}" if p == "}}" else to_string(self.value(p[1:-1], node, position, size, variables)) if p.startswith("{") else p for p in parts)

    def apply(self, nodes: list, out: Node, mode: str, given: dict, variables: dict, below: int | None = None) -> None:
        for i, n in enumerate(nodes, 1):
            best = None
            for j, t in enumerate(self.sheet.templates):
                fits = id(n) in self.matched[j] and (below is None or t.precedence < below)
                if t.mode == mode and fits and (best is None or (t.precedence, t.priority, t.place) >= (best.precedence, best.priority, best.place)):
                    best = t
            if best is not None:
                before, self.rule = self.rule, best
                self.call(best.node, out, n, i, len(nodes), given)
                self.rule = before
            elif n.kind in ("text", "attribute"):
                self.text(out, n.data)
            elif n.kind in ("element", "document"):
                self.apply(n.children, out, mode, {}, variables)

    def call(self, template: Node, out: Node, node: Node | Attribute, position: int, size: int, given: dict) -> None:
        self.depth += 1
        if self.depth > DEPTH:
            raise StylesheetError("templates call each other without end")
        variables = dict(self.globals)
        for n in template.children:
            if _local(n) == "param":
                name = n.attrs["name"]
                variables[name] = given[name] if name in given else self.bound(n, node, position, size, variables)
        self.body(template, out, node, position, size, variables)
        self.depth -= 1

    @staticmethod
    def text(out: Node, data: str) -> None:
        if data:
            if out.children and out.children[-1].kind == "text":
                out.children[-1].data += data
            else:
                out.append(Node("text", data=data))

    def sorted(self, parent: Node, nodes: list, variables: dict) -> list:
        for s in reversed([c for c in parent.children if _local(c) == "sort"]):
            keys = [self.value(s.attrs.get("select", "."), n, i, len(nodes), variables) for i, n in enumerate(nodes, 1)]
            if s.attrs.get("data-type") == "number":
                ranks = [(-math.inf if math.isnan(x) else x) for x in map(to_number, keys)]
            else:
                ranks = [to_string(k) for k in keys]
            down = s.attrs.get("order") == "descending"
            nodes = [nodes[i] for i in sorted(range(len(nodes)), key=lambda i: ranks[i], reverse=down)] if not down else [nodes[i] for i in sorted(range(len(nodes) - 1, -1, -1), key=lambda i: ranks[i])][::-1]
        return nodes

    def body(self, parent: Node, out: Node, node: Node | Attribute, position: int, size: int, variables: dict) -> None:
        scope = dict(variables)
        here = (node, position, size, scope)
        for n in parent.children:
            kind = _local(n)
            if n.kind == "text":
                if n.data.strip():
                    self.text(out, n.data)
            elif n.kind != "element" or kind in ("param", "sort", "fallback"):
                continue
            elif kind is None:
                new = Node("element", self.aliased(n.tag), "xml", {self.aliased(k): self.filled(v, *here) for k, v in n.attrs.items() if not k.startswith(("xsl:", "xmlns:xsl"))})
                self.use_sets(n.attrs.get("xsl:use-attribute-sets", ""), new, here)
                out.append(new)
                self.body(n, new, *here)
            elif kind == "value-of":
                self.text(out, to_string(self.value(n.attrs["select"], *here)))
            elif kind == "text":
                self.text(out, n.text())
            elif kind == "variable":
                scope[n.attrs["name"]] = self.bound(n, *here)
            elif kind in ("apply-templates", "call-template"):
                given = {c.attrs["name"]: self.bound(c, *here) for c in n.children if _local(c) == "with-param"}
                if kind == "call-template":
                    if n.attrs["name"] not in self.sheet.named:
                        raise StylesheetError(f"no template {n.attrs['name']}")
                    self.call(self.sheet.named[n.attrs["name"]], out, node, position, size, given)
                else:
                    nodes = self.value(n.attrs["select"], *here) if "select" in n.attrs else list(getattr(node, "children", []))
                    self.apply(self.sorted(n, nodes, scope), out, n.attrs.get("mode", ""), given, scope)
            elif kind == "apply-imports":
                if self.rule is not None:
                    self.apply([node], out, self.rule.mode, {}, scope, self.rule.precedence)
            elif kind == "for-each":
                nodes = self.sorted(n, self.value(n.attrs["select"], *here), scope)
                for i, x in enumerate(nodes, 1):
                    self.body(n, out, x, i, len(nodes), scope)
            elif kind == "if":
                if to_boolean(self.value(n.attrs["test"], *here)):
                    self.body(n, out, *here)
            elif kind == "choose":
                for arm in (c for c in n.children if _local(c) in ("when", "otherwise")):
                    if _local(arm) == "otherwise" or to_boolean(self.value(arm.attrs["test"], *here)):
                        self.body(arm, out, *here)
                        break
            elif kind == "element":
                new = Node("element", self.filled(n.attrs["name"], *here), "xml")
                self.use_sets(n.attrs.get("use-attribute-sets", ""), new, here)
                out.append(new)
                self.body(n, new, *here)
            elif kind == "attribute":
                holder = Node("document")
                self.body(n, holder, *here)
                out.attrs[self.filled(n.attrs["name"], *here)] = holder.text()
            elif kind == "comment":
                holder = Node("document")
                self.body(n, holder, *here)
                out.append(Node("comment", data=holder.text()))
            elif kind == "processing-instruction":
                holder = Node("document")
                self.body(n, holder, *here)
                out.append(Node("processing-instruction", self.filled(n.attrs["name"], *here), data=holder.text()))
            elif kind == "copy":
                if node.kind == "element":
                    new = Node("element", node.tag, node.ns)
                    self.use_sets(n.attrs.get("use-attribute-sets", ""), new, here)
                    out.append(new)
                    self.body(n, new, *here)
                elif node.kind == "document":
                    self.body(n, out, *here)
                else:
                    self.copy(node, out)
            elif kind == "copy-of":
                found = self.value(n.attrs["select"], *here)
                if isinstance(found, list):
                    for x in found:
                        self.copy(x, out)
                else:
                    self.text(out, to_string(found))
            elif kind == "number":
                counts = [int(to_number(self.value(n.attrs["value"], *here)))] if "value" in n.attrs else self.counted(n, node)
                form = self.filled(n.attrs.get("format", "1"), *here)
                text = _numbered(counts, form) if counts else ""
                if "grouping-separator" in n.attrs and n.attrs.get("grouping-size", "").isdigit():
                    text = re.sub(rf"(?<=\d)(?=(?:\d{{{n.attrs['grouping-size']}}})+$)", n.attrs["grouping-separator"], text)
                self.text(out, text)
            elif kind == "message":
                if n.attrs.get("terminate") == "yes":
                    raise StylesheetError(n.text().strip())
            elif fallbacks := [c for c in n.children if _local(c) == "fallback"]:
                for c in fallbacks:
                    self.body(c, out, *here)
            else:
                raise StylesheetError(f"xsl:{kind} in a template")

    def aliased(self, name: str) -> str:
        """A name of the stylesheet as the result is to have it."""
        prefix, colon, local = name.rpartition(":")
        to = self.sheet.aliases.get(prefix) if (colon or "" in self.sheet.aliases) and not name.startswith("xmlns") else None
        return name if to is None else f"{to}:{local}" if to else local

    def counted(self, n: Node, node: Node | Attribute) -> list[int]:
        """The numbers of ``xsl:number`` for a node: among its siblings, at every level, or in the whole page."""

        def fits(pattern: str | None, x: Node) -> bool:
            if pattern is None:
                return x.kind == node.kind and x.tag == node.tag
            if pattern not in self.parsed:
                parts = [p.strip() for p in _split(pattern)]
                self.parsed[pattern] = Parser(" | ".join(p if p.startswith("/") else f"//{p}" for p in parts)).parse()
            return any(x is y for y in self.page.value(self.parsed[pattern], self.document))

        count, begin = n.attrs.get("count"), n.attrs.get("from")
        line = self.page.walk_axis(node, "ancestor-or-self")
        if begin is not None:
            at = next((i for i, x in enumerate(line) if i and fits(begin, x)), len(line))
            line = line[:at]
        if n.attrs.get("level") == "any":
            nodes = [x for x in self.page.nodes if self.page.key(x) <= self.page.key(node)]
            if begin is not None:
                at = max((i for i, x in enumerate(nodes) if fits(begin, x)), default=-1)
                nodes = nodes[at + 1 :]
            total = sum(1 for x in nodes if fits(count, x))
            return [total] if total else []
        levels = [x for x in line if fits(count, x)]
        if n.attrs.get("level", "single") == "single":
            levels = levels[:1]
        return [1 + sum(1 for y in self.page.walk_axis(x, "preceding-sibling") if fits(count, y)) for x in reversed(levels)]

    def use_sets(self, names: str, new: Node, here: tuple) -> None:
        for name in names.split():
            for a in self.sheet.sets.get(name, []):
                holder = Node("document")
                self.body(a, holder, *here)
                new.attrs.setdefault(a.attrs["name"], holder.text())

    def copy(self, node: Node | Attribute, out: Node) -> None:
        if node.kind == "attribute":
            out.attrs[node.tag] = node.data
        elif node.kind == "document":
            for c in node.children:
                self.copy(c, out)
        elif node.kind == "text":
            self.text(out, node.data)
        else:
            new = Node(node.kind, node.tag, node.ns, dict(node.attrs), node.data)
            out.append(new)
            for c in node.children:
                self.copy(c, new)

    def run(self) -> str:
        out = Node("document")
        self.apply([self.document], out, "", {}, self.globals)
        if self.sheet.output == "text":
            return out.text()
        if self.sheet.output == "html":
            for n in out.elements():
                n.ns = "html"
            return serialize(out)
        return "".join(canonical(c, comments=True) for c in out.children)


def _sign(n: int, sign: str) -> str:
    if sign in ("a", "A"):
        text = ""
        while n > 0:
            n, r = divmod(n - 1, 26)
            text = chr(ord(sign) + r) + text
        return text
    if sign in ("i", "I"):
        text = ""
        for value, letters in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            text += letters * (n // value)
            n %= value
        return text.upper() if sign == "I" else text
    return str(n).zfill(len(sign))


def _numbered(counts: list[int], form: str) -> str:
    """Numbers in a format such as ``1.a)``: signs in turn, the marks between them, the last sign for the rest."""
    signs = re.findall(r"[^\W_]+", form) or ["1"]
    marks = re.split(r"[^\W_]+", form) if re.search(r"[^\W_]", form) else [form, ""]
    out = marks[0]
    for i, n in enumerate(counts):
        if i:
            out += marks[i] if i < len(marks) - 1 else marks[-2] if len(marks) > 2 else "."
        out += _sign(n, signs[min(i, len(signs) - 1)])
    return out + marks[-1]


def _format_number(page: Page, node: Node, position: int, size: int, args: list) -> str:
    """``format-number``: a number by a picture such as ``#,##0.00``."""
    value, picture = to_number(args[0]), to_string(args[1])
    o = page.transform.sheet.formats.get(to_string(args[2]) if len(args) > 2 else "", {})
    point, group, zero, digit = o.get("decimal-separator", "."), o.get("grouping-separator", ","), o.get("zero-digit", "0"), o.get("digit", "#")
    percent, minus = o.get("percent", "%"), o.get("minus-sign", "-")
    if math.isnan(value):
        return o.get("NaN", "NaN")
    positive, _, negative = picture.partition(o.get("pattern-separator", ";"))
    part = negative if value < 0 and negative else positive
    signs = re.escape(point + group + zero + digit)
    m = re.search(f"[{signs}]+", part)
    if m is None:
        return part
    before, after = part[: m.start()], part[m.end() :]
    if math.isinf(value):
        body = o.get("infinity", "Infinity")
    else:
        scale = 100 if percent in part else 1000 if "\u2030" in part else 1
        whole, _, fraction = m[0].partition(point)
        least, most = fraction.count(zero), len(fraction.replace(group, ""))
        number = f"{decimal.Decimal(repr(abs(value) * scale)).quantize(decimal.Decimal(1).scaleb(-most), decimal.ROUND_HALF_EVEN):f}"
        left, _, right = number.partition(".")
        while len(right) > least and right.endswith("0"):
            right = right[:-1]
        left = left.lstrip("0").rjust(whole.replace(group, "").count(zero), "0")
        if group in whole and (step := len(whole) - whole.rindex(group) - 1):
            left = re.sub(rf"(?<=\d)(?=(?:\d{{{step}}})+$)", lambda _: group, left)
        body = left + (point + right if right else "")
        if zero != "0":
            body = body.translate({ord("0") + i: chr(ord(zero) + i) for i in range(10)})
    return (minus if value < 0 and not negative else "") + before + body + after


def _key(page: Page, node: Node, position: int, size: int, args: list) -> list:
    wanted = {string_of(n) for n in args[1]} if isinstance(args[1], list) else {to_string(args[1])}
    found = []
    for match, use in page.transform.sheet.keys.get(to_string(args[0]), []):
        for n in page.value(match, page.document):
            value = page.value(use, n)
            if ({string_of(x) for x in value} if isinstance(value, list) else {to_string(value)}) & wanted:
                found.append(n)
    return page.sorted(found)


FUNCTIONS["key"] = _key
FUNCTIONS["format-number"] = _format_number
FUNCTIONS["system-property"] = lambda page, node, position, size, args: {"xsl:version": 1.0, "xsl:vendor": "pagemill", "xsl:vendor-url": ""}.get(to_string(args[0]), "")
FUNCTIONS["function-available"] = lambda page, node, position, size, args: to_string(args[0]) in FUNCTIONS
FUNCTIONS["element-available"] = lambda page, node, position, size, args: to_string(args[0]) in INSTRUCTIONS
FUNCTIONS["current"] = lambda page, node, position, size, args: [page.transform.current]
FUNCTIONS["generate-id"] = lambda page, node, position, size, args: "n%d_%d" % page.key((args[0] or [node])[0] if args else node)


def transform(pages: DataFrame, stylesheet: str, parameters: dict[str, str | float | bool] | None = None, xml: bool = False, html: str = "html", key: str = "page_id", sources: dict[str, str] | None = None) -> DataFrame:
    """``result`` of the stylesheet on every page (``xml``: on documents that are XML), and ``error`` where it fails.

    A wrong stylesheet raises on the driver. Null is an empty page; an empty or broken XML document is an error.
    """
    sheet = compile_stylesheet(stylesheet, sources)
    given = {k: float(v) if isinstance(v, int) and not isinstance(v, bool) else v for k, v in (parameters or {}).items()}

    def kernel(text: str | None) -> list[tuple]:
        try:
            return [(Transform(sheet, parse_xml(text) if xml else parse(text), given).run(), None)]
        except (ValueError, XPathError, KeyError) as error:
            return [(None, str(error))]

    return per_page(pages, kernel, "page_id bigint, result string, error string", [pa.string(), pa.string()], html, key=key)
