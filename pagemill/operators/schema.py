"""Validating XML documents against XML Schema 1.0 and RELAX NG, a document a row; the schema is compiled once on the driver.

Content models of both are one kind of expression (sequence, choice, interleaving, repetition over elements, texts and attributes)
and are matched by derivatives: the expression that is left after each child. What a schema asks for that is not checked
(identity constraints, other schemas by address, grammars in other files) fails when it is compiled, not silently.
"""

from __future__ import annotations

import datetime
import decimal
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.sources.nodes import per_page
from pagemill.sources.tree import Node
from pagemill.sources.xml import XMLError, parse_xml

XS, RNG = "http://www.w3.org/2001/XMLSchema", "http://relaxng.org/ns/structure/1.0"


class SchemaError(ValueError):
    """The schema is wrong or asks for what is not checked."""


@dataclass(frozen=True)
class Problem:
    """What is wrong where: a message, the path of the element, and a kind (structure, attribute, value, well-formedness)."""

    message: str
    path: str
    type: str


class SchemaValidationError(ValueError):
    def __init__(self, problems: list[Problem]) -> None:
        super().__init__("; ".join(f"{p.path}: {p.message}" for p in problems[:5]))
        self.problems = problems


# -- names -----------------------------------------------------------------------------------------------------------------


def scope_of(n: Node) -> dict[str, str]:
    out = scope_of(n.parent) if n.parent is not None and n.parent.kind == "element" else {"xml": "http://www.w3.org/XML/1998/namespace"}
    return out | {k[6:]: v for k, v in n.attrs.items() if k == "xmlns" or k.startswith("xmlns:")}


def expanded(name: str, scope: dict[str, str], attribute: bool = False) -> tuple[str, str]:
    prefix, _, local = name.rpartition(":")
    return ("" if attribute and not prefix else scope.get(prefix, "")), local


def path_of(n: Node) -> str:
    parts = []
    while n is not None and n.kind == "element":
        same = [c for c in n.parent.children if c.kind == "element" and c.tag == n.tag] if n.parent is not None else [n]
        parts.append(n.tag + (f"[{next(i for i, c in enumerate(same, 1) if c is n)}]" if len(same) > 1 else ""))
        n = n.parent
    return "/" + "/".join(reversed(parts))


def elements_of(n: Node) -> list[Node]:
    return [c for c in n.children if c.kind == "element"]


# -- values ----------------------------------------------------------------------------------------------------------------

_INTEGERS = {
    "integer": (None, None), "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1), "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127),
    "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 255),
}
_ZONE = r"(?:Z|[+-](?:(?:0\d|1[0-3]):[0-5]\d|14:00))?"
_NAME = r"[^\W\d][\w.·-]*"
# Lexical forms of the built-in types that are patterns.
_FORMS = {
    "decimal": r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)", "float": r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|-?INF|NaN", "double": r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|-?INF|NaN", "boolean": "true|false|1|0", "time": rf"(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?{_ZONE}|24:00:00(?:\.0+)?{_ZONE}",
    "duration": r"-?P(?=[\dT])(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?=\d)(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?", "gYear": rf"-?\d{{4,}}{_ZONE}", "gYearMonth": rf"-?\d{{4,}}-(?:0[1-9]|1[0-2]){_ZONE}", "gMonth": rf"--(?:0[1-9]|1[0-2]){_ZONE}", "gDay": rf"---(?:0[1-9]|[12]\d|3[01]){_ZONE}",
    "gMonthDay": rf"--(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]){_ZONE}", "hexBinary": "(?:[0-9A-Fa-f]{2})*", "base64Binary": r"(?:[A-Za-z0-9+/]{4}|[A-Za-z0-9+/ ]{4,})*(?:[A-Za-z0-9+/ ]{2,3}==?)?", "anyURI": r"[^\s<>\"{}|\\^`]*", "language": "[A-Za-z]{1,8}(?:-[A-Za-z0-9]{1,8})*", "NCName": _NAME,
    "Name": rf"(?:{_NAME}|:)(?::?[\w.·-]*)*", "QName": rf"(?:{_NAME}:)?{_NAME}", "NMTOKEN": r"[\w.:·-]+", "NMTOKENS": r"[\w.:·-]+(?: [\w.:·-]+)*", "ID": _NAME, "IDREF": _NAME, "IDREFS": rf"{_NAME}(?: {_NAME})*", "ENTITY": _NAME, "ENTITIES": rf"{_NAME}(?: {_NAME})*", "NOTATION": rf"(?:{_NAME}:)?{_NAME}",
}
BUILT_IN = {"string", "normalizedString", "token", "anySimpleType", "date", "dateTime", *_FORMS, *_INTEGERS}


def spaced(value: str, base: str) -> str:
    if base in ("string", "anySimpleType"):
        return value
    value = re.sub(r"[\t\n\r]", " ", value)
    return value if base == "normalizedString" else re.sub(" +", " ", value).strip(" ")


def fits(value: str, base: str) -> bool:
    """Whether a value, its blanks treated, is one of a built-in type."""
    if base in _INTEGERS:
        if not re.fullmatch(r"[+-]?\d+", value):
            return False
        low, high = _INTEGERS[base]
        return (low is None or int(value) >= low) and (high is None or int(value) <= high)
    if base in ("date", "dateTime"):
        m = re.fullmatch(rf"(-?\d{{4,}})-(\d\d)-(\d\d)(T.+?)?({_ZONE})" if base == "dateTime" else rf"(-?\d{{4,}})-(\d\d)-(\d\d)()({_ZONE})", value)
        if m is None or base == "dateTime" and (not m[4] or not re.fullmatch(_FORMS["time"], m[4][1:])):
            return False
        try:
            datetime.date(abs(int(m[1])) % 400 + 2000, int(m[2]), int(m[3]))
        except ValueError:
            return False
        return True
    form = _FORMS.get(base)
    return form is None or re.fullmatch(form, value) is not None


def comparable(value: str, base: str) -> object:
    """The value for comparing."""
    if base == "decimal" or base in _INTEGERS:
        return decimal.Decimal(value)
    if base in ("float", "double"):
        return float(value.replace("INF", "inf"))
    if base == "boolean":
        return value in ("true", "1")
    if base in ("date", "dateTime") and (m := re.fullmatch(r"(\d{4}-\d\d-\d\d(?:T[\d:.]+)?)(Z|[+-]\d\d:\d\d)?", value)):
        moment = datetime.datetime.fromisoformat(m[1][:26])
        zone = 0 if m[2] in (None, "Z") else int(m[2][:3]) * 60 + int(m[2][0] + m[2][4:])
        return moment - datetime.timedelta(minutes=zone)
    return value


def xsd_pattern(text: str) -> re.Pattern:
    """A pattern of XML Schema as one of Python."""
    text = text.replace(r"\i", "[A-Za-z_:]").replace(r"\c", r"[\w.:-]").replace(r"\I", "[^A-Za-z_:]").replace(r"\C", r"[^\w.:-]")
    text = re.sub(r"\\p\{(?:L|Lu|Ll)\}", lambda m: {"L": r"[^\\W\\d_]", "Lu": "[A-ZÀ-ÞА-Я]", "Ll": "[a-zß-ÿа-я]"}[m[0][3:-1]].replace("\\\\", "\\"), text)
    text = re.sub(r"\\p\{Nd?\}", r"\\d", text)
    try:
        return re.compile(text)
    except re.error as error:
        raise SchemaError(f"pattern {text}: {error}") from None


@dataclass
class Simple:
    """A simple type: a built-in base with facets, a list of an item type, or a union of types."""

    base: str = "string"
    facets: list[tuple[str, object]] = field(default_factory=list)
    item: Simple | None = None
    members: list[Simple] = field(default_factory=list)

    def problem(self, value: str) -> str | None:
        if self.members:
            if all(m.problem(value) for m in self.members):
                return f"{value!r} fits no type of the union"
            return self._facets(value, value)
        if self.item is not None:
            parts = value.split()
            for p in parts:
                if found := self.item.problem(p):
                    return found
            return self._facets(" ".join(parts), parts)
        value = spaced(value, self.base)
        if not fits(value, self.base):
            return f"{value!r} is no {self.base}"
        return self._facets(value, value)

    def _facets(self, value: str, sized: str | list[str]) -> str | None:
        patterns = [p for k, p in self.facets if k == "pattern"]
        allowed = [v for k, v in self.facets if k == "enumeration"]
        size = len(sized) // 2 if self.base == "hexBinary" and self.item is None else len(sized)
        if patterns and not any(p.fullmatch(value) for p in patterns):
            return f"{value!r} does not match the pattern"
        if allowed and not any(comparable(value, self.base) == comparable(str(a), self.base) for a in allowed):
            return f"{value!r} is none of {', '.join(map(repr, allowed))}"
        for kind, limit in self.facets:
            wrong = {
                "length": lambda v: size != v, "minLength": lambda v: size < v, "maxLength": lambda v: size > v,
                "minInclusive": lambda v: comparable(value, self.base) < comparable(v, self.base), "maxInclusive": lambda v: comparable(value, self.base) > comparable(v, self.base),
                "minExclusive": lambda v: comparable(value, self.base) <= comparable(v, self.base), "maxExclusive": lambda v: comparable(value, self.base) >= comparable(v, self.base),
                "totalDigits": lambda v: len(re.sub(r"\D", "", value).lstrip("0") or "0") > v, "fractionDigits": lambda v: len(value.partition(".")[2].rstrip("0")) > v,
            }.get(kind)
            if wrong is not None and wrong(limit):
                return f"{value!r} breaks {kind} {limit}"
        return None


# -- content expressions -----------------------------------------------------------------------------------------------------

#: Expressions are tuples: ("none",), ("empty",), ("text",), ("el", matcher, content), ("seq", a, b), ("or", a, b), ("mix", a, b),
#: ("many", a), ("all", frozenset of (optional, el)), ("range", a, least, most).
NONE, EMPTY, TEXT = ("none",), ("empty",), ("text",)


def seq(a: tuple, b: tuple) -> tuple:
    return NONE if NONE in (a, b) else b if a == EMPTY else a if b == EMPTY else ("seq", a, b)


def either(a: tuple, b: tuple) -> tuple:
    return b if a == NONE else a if b == NONE or a == b else ("or", a, b)


def mix(a: tuple, b: tuple) -> tuple:
    return NONE if NONE in (a, b) else b if a == EMPTY else a if b == EMPTY else ("mix", a, b)


def repeated(a: tuple, least: int, most: int | None) -> tuple:
    if a in (NONE, EMPTY):
        return EMPTY if a == EMPTY or least == 0 else NONE
    if most == 0:
        return EMPTY
    if (least, most) == (1, 1):
        return a
    return ("many", a) if (least, most) == (0, None) else ("range", a, least, most)


@lru_cache(maxsize=100_000)
def nullable(e: tuple) -> bool:
    kind = e[0]
    if kind in ("empty", "text", "many"):
        return True
    if kind in ("seq", "mix"):
        return nullable(e[1]) and nullable(e[2])
    if kind == "or":
        return nullable(e[1]) or nullable(e[2])
    if kind == "range":
        return e[2] == 0 or nullable(e[1])
    return kind == "all" and all(optional for optional, _ in e[1])


def derive(e: tuple, child: Callable[[tuple], bool], text: bool) -> tuple:
    """What is left of an expression after one child: an element that ``child`` accepts, or a text."""
    kind = e[0]
    if kind == "text":
        return TEXT if text else NONE
    if kind == "el":
        return EMPTY if not text and child(e) else NONE
    if kind == "seq":
        left = seq(derive(e[1], child, text), e[2])
        return either(left, derive(e[2], child, text)) if nullable(e[1]) else left
    if kind == "or":
        return either(derive(e[1], child, text), derive(e[2], child, text))
    if kind == "mix":
        return either(mix(derive(e[1], child, text), e[2]), mix(e[1], derive(e[2], child, text)))
    if kind == "many":
        return seq(derive(e[1], child, text), e)
    if kind == "range":
        rest = repeated(e[1], max(0, e[2] - 1), None if e[3] is None else e[3] - 1)
        return seq(derive(e[1], child, text), rest)
    if kind == "all":
        for member in e[1]:
            if not text and child(member[1]):
                rest = e[1] - {member}
                return ("all", rest) if rest else EMPTY
    return NONE


def expected(e: tuple) -> list[str]:
    """Names of the elements that may come next."""
    kind = e[0]
    if kind == "el":
        return [str(e[1])]
    if kind == "seq":
        return expected(e[1]) + (expected(e[2]) if nullable(e[1]) else [])
    if kind in ("or", "mix"):
        return expected(e[1]) + expected(e[2])
    if kind in ("many", "range"):
        return expected(e[1])
    return [str(x[1]) for _, x in sorted(e[1], key=str)] if kind == "all" else []


@dataclass(frozen=True)
class Name:
    """A name test: a namespace (null: any, or none of ``not_ns``) and a local name (null: any)."""

    ns: str | None
    local: str | None
    not_ns: frozenset[str] = frozenset()

    def __call__(self, name: tuple[str, str]) -> bool:
        return (self.ns is None or name[0] == self.ns) and (self.local is None or name[1] == self.local) and name[0] not in self.not_ns

    def __str__(self) -> str:
        return self.local or "*"


# -- XML Schema ---------------------------------------------------------------------------------------------------------------


@dataclass
class Complex:
    """A complex type: attributes by name (type, required, fixed), content, and whether texts may stand between."""

    content: tuple = EMPTY
    attributes: dict[tuple[str, str], tuple[Simple, bool, str | None]] = field(default_factory=dict)
    mixed: bool = False
    value: Simple | None = None
    any_attribute: Name | None = None
    abstract: bool = False


@dataclass(eq=False)
class Declared:
    """An element declaration; its type is looked up when it is met, since types may contain themselves."""

    type: Callable[[], Simple | Complex]
    nillable: bool = False
    fixed: str | None = None
    abstract: bool = False
    lax: bool = False


def _local(n: Node) -> str:
    return n.tag.rpartition(":")[2]


class XMLSchema:
    """A schema of elements, types, groups and attributes, compiled from its document."""

    def __init__(self, text: str) -> None:
        root = next(iter(elements_of(parse_xml(text))), None)
        if root is None or expanded(root.tag, scope_of(root)) != (XS, "schema"):
            raise SchemaError("no xs:schema")
        self.root, self.target = root, root.attrs.get("targetNamespace", "")
        self.qualified = root.attrs.get("elementFormDefault") == "qualified"
        self.named: dict[tuple[str, str], Node] = {}
        self.cache: dict[int, Simple | Complex] = {}
        self.substitutes: dict[tuple[str, str], list[Node]] = {}
        for n in elements_of(root):
            kind = _local(n)
            if kind in ("import", "include", "redefine") and n.attrs.get("schemaLocation"):
                raise SchemaError(f"xs:{kind} of another schema is not read")
            if "name" in n.attrs:
                self.named[kind, n.attrs["name"]] = n
            if kind == "element" and "substitutionGroup" in n.attrs:
                self.substitutes.setdefault(expanded(n.attrs["substitutionGroup"], scope_of(n)), []).append(n)
        for n in root.walk():
            if n.kind == "element" and _local(n) in ("key", "keyref", "unique"):
                raise SchemaError(f"xs:{_local(n)} is not checked")
        self.elements = {(self.target, name): self.declaration(n) for (kind, name), n in self.named.items() if kind == "element"}
        for n in root.walk():  # types are compiled now, so that a wrong schema fails here
            if n.kind == "element" and _local(n) in ("simpleType", "complexType"):
                self.type_at(n)

    def lookup(self, kind: str, name: str, n: Node) -> Node:
        found = self.named.get((kind, name.rpartition(":")[2]))
        if found is None:
            raise SchemaError(f"no {kind} {name}")
        return found

    def type_named(self, name: str, n: Node) -> Simple | Complex:
        ns, local = expanded(name, scope_of(n))
        if ns == XS:
            if local == "anyType":
                return Complex(("many", ("el", Name(None, None), Declared(lambda: Complex(), lax=True))), mixed=True, any_attribute=Name(None, None))
            if local not in BUILT_IN:
                raise SchemaError(f"no type xs:{local}")
            plural = {"NMTOKENS": "NMTOKEN", "IDREFS": "IDREF", "ENTITIES": "ENTITY"}.get(local)
            return Simple(item=Simple(plural), facets=[("minLength", 1)]) if plural else Simple(local)
        kind = "complexType" if ("complexType", local) in self.named else "simpleType"
        return self.type_at(self.lookup(kind, name, n))

    def type_at(self, n: Node) -> Simple | Complex:
        if id(n) not in self.cache:
            if _local(n) == "simpleType":
                self.cache[id(n)] = self.simple(n)
            else:
                self.cache[id(n)] = made = Complex()
                self.complex(n, made)
        return self.cache[id(n)]

    def simple(self, n: Node) -> Simple:
        body = next((c for c in elements_of(n) if _local(c) in ("restriction", "list", "union")), None)
        if body is None:
            raise SchemaError("a simple type without content")
        inner = [self.type_at(c) for c in elements_of(body) if _local(c) == "simpleType"]
        kind = _local(body)
        if kind == "list":
            return Simple(item=self.type_named(body.attrs["itemType"], body) if "itemType" in body.attrs else inner[0])
        if kind == "union":
            return Simple(members=[*(self.type_named(t, body) for t in body.attrs.get("memberTypes", "").split()), *inner])
        base = self.type_named(body.attrs["base"], body) if "base" in body.attrs else inner[0]
        return self.restricted(base, body)

    def restricted(self, base: Simple, body: Node) -> Simple:
        facets: list[tuple[str, object]] = []
        for c in elements_of(body):
            kind, value = _local(c), c.attrs.get("value", "")
            if kind == "pattern":
                facets.append((kind, xsd_pattern(value)))
            elif kind in ("length", "minLength", "maxLength", "totalDigits", "fractionDigits"):
                facets.append((kind, int(value)))
            elif kind in ("enumeration", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive"):
                facets.append((kind, value))
        whole = any(k == "enumeration" for k, _ in facets)
        kept = [f for f in base.facets if not (whole and f[0] == "enumeration")]
        return Simple(base.base, [*kept, *facets], base.item, base.members)

    def complex(self, n: Node, made: Complex) -> None:
        made.mixed = n.attrs.get("mixed") == "true"
        made.abstract = n.attrs.get("abstract") == "true"
        body = n
        for c in elements_of(n):
            if _local(c) in ("simpleContent", "complexContent"):
                body = next(x for x in elements_of(c) if _local(x) in ("extension", "restriction"))
                base = self.type_named(body.attrs["base"], body)
                made.mixed = made.mixed or c.attrs.get("mixed") == "true"
                if isinstance(base, Simple):
                    made.value = base
                else:
                    made.attributes |= base.attributes
                    made.any_attribute, made.value = base.any_attribute, base.value
                    made.mixed = made.mixed or base.mixed and _local(body) == "extension"
                    if _local(body) == "extension":
                        made.content = base.content
                if _local(c) == "simpleContent" and _local(body) == "restriction" and made.value is not None:
                    made.value = self.restricted(made.value, body)
        for c in elements_of(body):
            if _local(c) in ("sequence", "choice", "all", "group"):
                made.content = seq(made.content, self.particle(c))
        self.attributes(body, made)

    def attributes(self, n: Node, made: Complex) -> None:
        for c in elements_of(n):
            kind = _local(c)
            if kind == "attributeGroup":
                self.attributes(self.lookup("attributeGroup", c.attrs["ref"], c), made)
            elif kind == "anyAttribute":
                made.any_attribute = self.wildcard(c)
            elif kind == "attribute":
                d = self.lookup("attribute", c.attrs["ref"], c) if "ref" in c.attrs else c
                name = expanded(c.attrs["ref"], scope_of(c), True) if "ref" in c.attrs else (self.target if c.attrs.get("form") == "qualified" else "", c.attrs["name"])
                inner = next((self.type_at(x) for x in elements_of(d) if _local(x) == "simpleType"), None)
                kind_of = self.type_named(d.attrs["type"], d) if "type" in d.attrs else inner or Simple("anySimpleType")
                if c.attrs.get("use") == "prohibited":
                    made.attributes.pop(name, None)
                else:
                    made.attributes[name] = (kind_of, c.attrs.get("use") == "required", c.attrs.get("fixed", d.attrs.get("fixed")))

    def wildcard(self, n: Node) -> Name:
        ns = n.attrs.get("namespace", "##any")
        if ns == "##any":
            return Name(None, None)
        if ns == "##other":
            return Name(None, None, frozenset((self.target, "")))
        return Name({"##targetNamespace": self.target, "##local": ""}.get(ns.split()[0], ns.split()[0]), None)

    def declaration(self, n: Node) -> Declared:
        inner = next((x for x in elements_of(n) if _local(x) in ("simpleType", "complexType")), None)
        get = (lambda: self.type_named(n.attrs["type"], n)) if "type" in n.attrs else (lambda: self.type_at(inner)) if inner is not None else (lambda: self.type_named(f"{self._xs(n)}anyType", n))
        return Declared(get, n.attrs.get("nillable") == "true", n.attrs.get("fixed"), n.attrs.get("abstract") == "true")

    @staticmethod
    def _xs(n: Node) -> str:
        prefix = next(p for p, u in scope_of(n).items() if u == XS)
        return f"{prefix}:" if prefix else ""

    def particle(self, n: Node) -> tuple:
        kind = _local(n)
        least = int(n.attrs.get("minOccurs", "1"))
        most = None if n.attrs.get("maxOccurs") == "unbounded" else int(n.attrs.get("maxOccurs", "1"))
        if kind == "element":
            if "ref" in n.attrs:
                name = expanded(n.attrs["ref"], scope_of(n))
                one = ("el", Name(*name), self.declaration(self.lookup("element", n.attrs["ref"], n)))
                for other in self.substitutes.get(name, []):
                    one = either(one, ("el", Name(self.target, other.attrs["name"]), self.declaration(other)))
            else:
                qualified = n.attrs.get("form", "qualified" if self.qualified else "") == "qualified"
                one = ("el", Name(self.target if qualified else "", n.attrs["name"]), self.declaration(n))
        elif kind == "any":
            one = ("el", self.wildcard(n), Declared(lambda: Complex(), lax=True))
        elif kind == "group":
            group = self.lookup("group", n.attrs["ref"], n)
            one = self.particle(next(c for c in elements_of(group) if _local(c) in ("sequence", "choice", "all")))
        else:
            parts = [c for c in elements_of(n) if _local(c) in ("element", "any", "group", "sequence", "choice", "all")]
            if kind == "all":
                one = ("all", frozenset((c.attrs.get("minOccurs") == "0", self.particle_once(c)) for c in parts)) if parts else EMPTY
            elif kind == "choice":
                one = NONE
                for c in parts:
                    one = either(one, self.particle(c))
                one = EMPTY if not parts else one
            else:
                one = EMPTY
                for c in reversed(parts):
                    one = seq(self.particle(c), one)
        return repeated(one, least, most)

    def particle_once(self, n: Node) -> tuple:
        attrs, n.attrs = n.attrs, {k: v for k, v in n.attrs.items() if k not in ("minOccurs", "maxOccurs")}
        try:
            return self.particle(n)
        finally:
            n.attrs = attrs

    # validation

    def validate(self, text: str | None) -> list[Problem]:
        """Everything that is wrong with a document; empty if it is valid."""
        try:
            root = elements_of(parse_xml(text))[0]
        except XMLError as error:
            return [Problem(str(error), "/", "well-formedness")]
        out: list[Problem] = []
        self.ids: set[str] = set()
        self.references: list[tuple[str, Node]] = []
        declared = self.elements.get(expanded(root.tag, scope_of(root)))
        if declared is None:
            return [Problem(f"no element {root.tag} is declared", path_of(root), "structure")]
        self.element(root, declared, out)
        out += [Problem(f"no ID {r!r}", path_of(n), "value") for r, n in self.references if r not in self.ids]
        return out

    def is_valid(self, text: str | None) -> bool:
        return not self.validate(text)

    def assert_valid(self, text: str | None) -> None:
        if problems := self.validate(text):
            raise SchemaValidationError(problems)

    def value(self, kind: Simple, value: str, n: Node, out: list[Problem], what: str) -> None:
        if found := kind.problem(value):
            out.append(Problem(f"{what}{found}", path_of(n), "value"))
        elif kind.base == "ID":
            if value.strip() in self.ids:
                out.append(Problem(f"{what}ID {value.strip()!r} stands twice", path_of(n), "value"))
            self.ids.add(value.strip())
        elif kind.base == "IDREF" or kind.item is not None and kind.item.base == "IDREF":
            self.references += [(v, n) for v in value.split()]

    def element(self, n: Node, declared: Declared, out: list[Problem]) -> None:
        scope = scope_of(n)
        xsi = {expanded(k, scope, True)[1]: v for k, v in n.attrs.items() if expanded(k, scope, True)[0].endswith("XMLSchema-instance")}
        if declared.lax:
            found = self.elements.get(expanded(n.tag, scope))
            if found is not None:
                self.element(n, found, out)
            else:
                for c in elements_of(n):
                    self.element(c, declared, out)
            return
        if declared.abstract:
            out.append(Problem(f"element {n.tag} is abstract", path_of(n), "structure"))
        kind = declared.type()
        if "type" in xsi:
            try:
                prefix_scope = scope
                ns, local = expanded(xsi["type"], prefix_scope)
                kind = Simple(local) if ns == XS else self.type_at(self.named["complexType", local] if ("complexType", local) in self.named else self.named["simpleType", local])
            except KeyError:
                out.append(Problem(f"no type {xsi['type']}", path_of(n), "structure"))
        if xsi.get("nil") in ("true", "1"):
            if not declared.nillable:
                out.append(Problem(f"element {n.tag} is not nillable", path_of(n), "structure"))
            elif n.children:
                out.append(Problem(f"element {n.tag} is nil and not empty", path_of(n), "structure"))
            return
        given = {expanded(k, scope, True): v for k, v in n.attrs.items() if not (k == "xmlns" or k.startswith("xmlns:")) and not expanded(k, scope, True)[0].endswith("XMLSchema-instance")}
        text = "".join(c.data for c in n.children if c.kind == "text")
        if isinstance(kind, Simple):
            out.extend(Problem(f"attribute {name[1]} is not allowed", path_of(n), "attribute") for name in given)
            if elements_of(n):
                out.append(Problem(f"element {n.tag} has elements in a simple value", path_of(n), "structure"))
            else:
                self.value(kind, text, n, out, "")
        else:
            if kind.abstract:
                out.append(Problem(f"the type of {n.tag} is abstract", path_of(n), "structure"))
            self.complex_value(n, kind, given, text, out)
        if declared.fixed is not None and text and text != declared.fixed:
            out.append(Problem(f"{text!r} is not the fixed {declared.fixed!r}", path_of(n), "value"))

    def complex_value(self, n: Node, kind: Complex, given: dict[tuple[str, str], str], text: str, out: list[Problem]) -> None:
        for name, value in given.items():
            if name in kind.attributes:
                simple, _, fixed = kind.attributes[name]
                self.value(simple, value, n, out, f"attribute {name[1]}: ")
                if fixed is not None and value != fixed:
                    out.append(Problem(f"attribute {name[1]} is not the fixed {fixed!r}", path_of(n), "attribute"))
            elif not (kind.any_attribute and kind.any_attribute(name)) and name[0] != "http://www.w3.org/XML/1998/namespace":
                out.append(Problem(f"attribute {name[1]} is not allowed", path_of(n), "attribute"))
        out.extend(Problem(f"attribute {name[1]} is missing", path_of(n), "attribute") for name, (_, required, _) in kind.attributes.items() if required and name not in given)
        if kind.value is not None:
            if elements_of(n):
                out.append(Problem(f"element {n.tag} has elements in a simple value", path_of(n), "structure"))
            self.value(kind.value, text, n, out, "")
            return
        if not kind.mixed and text.strip():
            out.append(Problem(f"text is not allowed in {n.tag}", path_of(n), "structure"))
        rest, matched = kind.content, []
        for c in elements_of(n):
            name, hits = expanded(c.tag, scope_of(c)), []
            left = derive(rest, lambda e, name=name, hits=hits: e[1](name) and (hits.append(e[2]) or True), False)
            if left == NONE:
                out.append(Problem(f"element {c.tag} is not expected" + (f", but {' or '.join(dict.fromkeys(expected(rest)))}" if expected(rest) else ""), path_of(c), "structure"))
                return
            rest = left
            matched.append((c, hits[0]))
        if not nullable(rest):
            out.append(Problem(f"{n.tag} is not complete: {' or '.join(dict.fromkeys(expected(rest)))} is missing", path_of(n), "structure"))
        for c, declared in matched:
            self.element(c, declared, out)


# -- RELAX NG --------------------------------------------------------------------------------------------------------------------


class RelaxNG:
    """A grammar in the XML syntax of RELAX NG, matched by derivatives over attributes and children together."""

    def __init__(self, text: str) -> None:
        root = next(iter(elements_of(parse_xml(text))), None)
        if root is None or expanded(root.tag, scope_of(root))[0] != RNG:
            raise SchemaError("no RELAX NG grammar")
        self.defines: dict[str, tuple] = {}
        self.sources: dict[str, list[Node]] = {}
        self.compiled: dict[int, tuple] = {}
        start = [root]
        if _local(root) == "grammar":
            start = []
            stack = elements_of(root)
            while stack:
                n = stack.pop(0)
                if _local(n) == "div":
                    stack = elements_of(n) + stack
                elif _local(n) == "define":
                    self.sources.setdefault(n.attrs["name"], []).append(n)
                elif _local(n) == "start":
                    start.append(n)
                elif _local(n) == "include":
                    raise SchemaError("include is not read")
        if not start:
            raise SchemaError("a grammar without start")
        body = [c for n in start for c in (elements_of(n) if _local(n) == "start" else [n])]
        self.start = self.many(body, either if len(start) > 1 else seq)
        for name in list(self.sources):
            self.define(name)

    def many(self, nodes: list[Node], join: Callable[[tuple, tuple], tuple]) -> tuple:
        out = None
        for n in reversed(nodes):
            p = self.pattern(n)
            out = p if out is None else join(p, out)
        return EMPTY if out is None else out

    def define(self, name: str) -> tuple:
        if name not in self.defines:
            if name not in self.sources:
                raise SchemaError(f"no define {name}")
            self.defines[name] = ("ref", name)  # met inside itself: looked up when it is derived
            parts = [self.many([c for c in elements_of(n)], seq) for n in self.sources[name]]
            how = mix if any(n.attrs.get("combine") == "interleave" for n in self.sources[name]) else either
            out = parts[0]
            for p in parts[1:]:
                out = how(out, p)
            self.defines[name] = out
        return self.defines[name]

    @staticmethod
    def inherited(n: Node, name: str) -> str:
        while n is not None and n.kind == "element":
            if name in n.attrs:
                return n.attrs[name]
            n = n.parent
        return ""

    def name_class(self, n: Node, attribute: bool) -> Callable[[tuple[str, str]], bool]:
        if "name" in n.attrs:
            ns = ("" if ":" not in n.attrs["name"] and "ns" not in n.attrs else self.inherited(n, "ns")) if attribute else self.inherited(n, "ns")
            if ":" in n.attrs["name"]:
                return Name(*expanded(n.attrs["name"], scope_of(n)))
            return Name(ns, n.attrs["name"])
        return self.name_test(elements_of(n)[0], attribute)

    def name_test(self, n: Node, attribute: bool) -> Callable[[tuple[str, str]], bool]:
        kind = _local(n)
        if kind == "name":
            text = n.text().strip()
            return Name(*expanded(text, scope_of(n))) if ":" in text else Name(self.inherited(n, "ns"), text)
        tests = [self.name_test(c, attribute) for c in elements_of(n) if _local(c) != "except"]
        excepted = [self.name_test(x, attribute) for c in elements_of(n) if _local(c) == "except" for x in elements_of(c)]
        if kind == "choice":
            return _AnyName(tuple(tests))
        if kind in ("anyName", "nsName"):
            return _Except(Name(self.inherited(n, "ns") if kind == "nsName" else None, None), tuple(excepted))
        raise SchemaError(f"{kind} is no name class")

    def pattern(self, n: Node) -> tuple:
        kind, inner = _local(n), elements_of(n)
        if kind == "element":
            names = self.name_class(n, False)
            body = inner if "name" in n.attrs else inner[1:]
            return ("el", names, _Content(self, body))
        if kind == "attribute":
            names = self.name_class(n, True)
            body = inner if "name" in n.attrs else inner[1:]
            return ("at", names, self.many(body, seq) if body else TEXT)
        if kind in ("group", "div"):
            return self.many(inner, seq)
        if kind == "choice":
            return self.many(inner, either)
        if kind == "interleave":
            return self.many(inner, mix)
        if kind == "mixed":
            return mix(TEXT, self.many(inner, seq))
        if kind == "optional":
            return either(EMPTY, self.many(inner, seq))
        if kind == "zeroOrMore":
            return ("many", self.many(inner, seq))
        if kind == "oneOrMore":
            one = self.many(inner, seq)
            return seq(one, ("many", one))
        if kind == "list":
            return ("list", self.many(inner, seq))
        if kind == "ref":
            name = n.attrs["name"]
            return self.define(name)
        if kind == "empty":
            return EMPTY
        if kind == "text":
            return TEXT
        if kind == "notAllowed":
            return NONE
        if kind == "value":
            return ("value", n.attrs.get("type", "token"), n.text())
        if kind == "data":
            return ("data", self.data_type(n))
        raise SchemaError(f"{kind} is not read")

    def data_type(self, n: Node) -> _Data:
        base = n.attrs["type"]
        if base not in BUILT_IN:
            raise SchemaError(f"no type {base}")
        facets: list[tuple[str, object]] = []
        for p in elements_of(n):
            if _local(p) == "param":
                name, value = p.attrs["name"], p.text()
                facets.append((name, xsd_pattern(value) if name == "pattern" else int(value) if "ength" in name or name.endswith("Digits") else value))
        excepted = [self.many(elements_of(p), either) for p in elements_of(n) if _local(p) == "except"]
        return _Data(Simple(base, facets), tuple(excepted))

    # derivatives

    def null(self, e: tuple) -> bool:
        kind = e[0]
        if kind == "ref":
            return self.null(self.defines[e[1]])
        if kind in ("seq", "mix"):
            return self.null(e[1]) and self.null(e[2])
        if kind == "or":
            return self.null(e[1]) or self.null(e[2])
        return kind in ("empty", "text", "many")

    def step(self, e: tuple, hit: Callable[[tuple], tuple], ordered: bool = True) -> tuple:
        """What is left after an item for which ``hit`` tells what becomes of the leaf that takes it."""
        kind = e[0]
        if kind == "ref":
            return self.step(self.defines[e[1]], hit, ordered)
        if kind == "seq":
            left = seq(self.step(e[1], hit, ordered), e[2])
            if not ordered:
                return either(left, seq(e[1], self.step(e[2], hit, ordered)))
            return either(left, self.step(e[2], hit, ordered)) if self.null(e[1]) else left
        if kind == "or":
            return either(self.step(e[1], hit, ordered), self.step(e[2], hit, ordered))
        if kind == "mix":
            return either(mix(self.step(e[1], hit, ordered), e[2]), mix(e[1], self.step(e[2], hit, ordered)))
        if kind == "many":
            return seq(self.step(e[1], hit, ordered), e)
        return hit(e)

    def takes(self, e: tuple, value: str) -> bool:
        """Whether a pattern takes a whole text."""

        def hit(leaf: tuple) -> tuple:
            if leaf[0] == "text":
                return TEXT
            if leaf[0] == "value":
                same = spaced(value, leaf[1]) == spaced(leaf[2], leaf[1]) if leaf[1] == "string" else " ".join(value.split()) == " ".join(leaf[2].split())
                return EMPTY if same else NONE
            if leaf[0] == "data":
                return EMPTY if leaf[1].simple.problem(value) is None and not any(self.takes(x, value) for x in leaf[1].excepted) else NONE
            if leaf[0] == "list":
                rest = leaf[1]
                for part in value.split():
                    rest = self.step(rest, lambda x, part=part: (EMPTY if x[0] in ("data", "value", "text") and self.takes(x, part) else NONE))
                return EMPTY if self.null(rest) else NONE
            return NONE

        return self.null(self.step(e, hit)) or not value.strip() and self.null(e)

    def without_attributes(self, e: tuple) -> tuple:
        kind = e[0]
        if kind == "ref":
            return self.without_attributes(self.defines[e[1]])
        if kind == "at":
            return NONE
        if kind in ("seq", "or", "mix"):
            return {"seq": seq, "or": either, "mix": mix}[kind](self.without_attributes(e[1]), self.without_attributes(e[2]))
        if kind == "many":
            inner = self.without_attributes(e[1])
            return EMPTY if inner == NONE else ("many", inner)
        return e

    def check(self, n: Node, e: tuple, out: list[Problem] | None) -> bool:
        """Whether an element's attributes and children match a content pattern; what does not is told in ``out``."""

        def wrong(message: str, at: Node, kind: str) -> bool:
            if out is not None:
                out.append(Problem(message, path_of(at), kind))
            return False

        scope = scope_of(n)
        for key, value in n.attrs.items():
            if key == "xmlns" or key.startswith("xmlns:"):
                continue
            name = expanded(key, scope, True)
            left = self.step(e, lambda leaf, name=name, value=value: EMPTY if leaf[0] == "at" and leaf[1](name) and self.takes(leaf[2], value) else NONE, False)
            if left == NONE:
                return wrong(f"attribute {key}={value!r} is not allowed", n, "attribute")
            e = left
        e2 = self.without_attributes(e)
        if e2 == NONE:
            return wrong(f"an attribute of {n.tag} is missing", n, "attribute")
        e = e2
        items = [c for c in n.children if c.kind in ("element", "text")]
        if not any(c.kind == "element" for c in items):
            text = "".join(c.data for c in items)
            return self.takes(e, text) or wrong(f"{text!r} is not allowed in {n.tag}" if text.strip() else f"{n.tag} is not complete", n, "value" if text.strip() else "structure")
        for c in items:
            if c.kind == "text":
                if c.data.strip():
                    e = self.step(e, lambda leaf: TEXT if leaf[0] == "text" else NONE)
                    if e == NONE:
                        return wrong(f"text is not allowed in {n.tag}", n, "structure")
                continue
            name, tried = expanded(c.tag, scope_of(c)), []

            def hit(leaf: tuple, c: Node = c, name: tuple = name, tried: list = tried) -> tuple:
                if leaf[0] != "el" or not leaf[1](name):
                    return NONE
                tried.append(leaf)
                return EMPTY if self.check(c, leaf[2].pattern(), None) else NONE

            left = self.step(e, hit)
            if left == NONE:
                if tried and out is not None:
                    self.check(c, tried[0][2].pattern(), out)
                    return False
                return wrong(f"element {c.tag} is not expected", c, "structure")
            e = left
        return self.null(e) or wrong(f"{n.tag} is not complete", n, "structure")

    def validate(self, text: str | None) -> list[Problem]:
        try:
            root = elements_of(parse_xml(text))[0]
        except XMLError as error:
            return [Problem(str(error), "/", "well-formedness")]
        holder = Node("element", "#document", "xml")
        holder.children = [root]
        out: list[Problem] = []
        parent, root.parent = root.parent, None
        try:
            self.check(holder, self.start, out)
        finally:
            root.parent = parent
        return out

    is_valid = XMLSchema.is_valid
    assert_valid = XMLSchema.assert_valid


@dataclass(frozen=True)
class _AnyName:
    tests: tuple

    def __call__(self, name: tuple[str, str]) -> bool:
        return any(t(name) for t in self.tests)


@dataclass(frozen=True)
class _Except:
    test: Name
    excepted: tuple

    def __call__(self, name: tuple[str, str]) -> bool:
        return self.test(name) and not any(t(name) for t in self.excepted)


@dataclass(eq=False)
class _Data:
    simple: Simple
    excepted: tuple


class _Content:
    """The content of an element pattern, compiled when it is first needed, since grammars are recursive through elements."""

    def __init__(self, grammar: RelaxNG, body: list[Node]) -> None:
        self.grammar, self.body, self.made = grammar, body, None

    def pattern(self) -> tuple:
        if self.made is None:
            self.made = self.grammar.many(self.body, seq)
        return self.made


# -- over documents ----------------------------------------------------------------------------------------------------------------


def validate(documents: DataFrame, schema: str, kind: str = "xsd", xml: str = "xml", key: str = "page_id") -> DataFrame:
    """``valid`` and ``errors`` of every document against a schema (``xsd`` or ``rng``), given as its text.

    A wrong schema raises on the driver; it is compiled again once in each task. Null is a document that is not well formed.
    """
    made = {"xsd": XMLSchema, "rng": RelaxNG}[kind]
    made(schema)
    compiled: dict[str, XMLSchema | RelaxNG] = {}

    def kernel(text: str | None) -> list[tuple]:
        if "it" not in compiled:
            compiled["it"] = made(schema)
        problems = compiled["it"].validate(text)
        return [(not problems, [{"message": p.message, "path": p.path, "type": p.type} for p in problems])]

    types = [pa.bool_(), pa.list_(pa.struct([("message", pa.string()), ("path", pa.string()), ("type", pa.string())]))]
    return per_page(documents, kernel, "page_id bigint, valid boolean, errors array<struct<message:string,path:string,type:string>>", types, xml, key=key)
