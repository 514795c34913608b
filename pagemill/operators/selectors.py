"""CSS selectors as relational plans over node rows.

A compound selector is a predicate on one row: position among siblings, attributes and classes are columns. A combinator is
a left-semi join of the node table with itself on ``page_id`` and a comparison of interval numbers; ``:has`` is a semi join,
``:not`` of a complex selector an anti join. Catalyst sees ordinary joins, pushes the row predicates to both sides and prunes
the columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nesting of functional pseudo-classes that the parser accepts.
DEPTH = 128
# Attributes whose values HTML compares without regard to letter case.
CASELESS = frozenset(
    "accept accept-charset align alink axis bgcolor charset checked clear codetype color compact declare defer dir direction "
    "disabled enctype face frame hreflang http-equiv lang language link media method multiple nohref noresize noshade nowrap "
    "readonly rel rev rules scope scrolling selected shape target text type valign valuetype vlink".split()
)
# Pseudo-classes of interaction; they parse, and match nothing on a static page.
NEVER = frozenset(
    "hover focus focus-within focus-visible active target target-within visited modal fullscreen picture-in-picture playing "
    "paused muted current past future user-valid user-invalid autofill popover-open".split()
)
# Pseudo-classes without arguments that a static page can match.
STATIC = frozenset(
    "root scope empty first-child last-child only-child first-of-type last-of-type only-of-type link any-link checked required "
    "optional read-write read-only defined placeholder-shown indeterminate enabled disabled default".split()
)
CONTROLS = ("button", "input", "select", "textarea", "optgroup", "option", "fieldset")
TEXTUAL = ("text", "search", "url", "tel", "email", "password", "date", "month", "week", "time", "datetime-local", "number", "")


class SelectorError(ValueError):
    """The selector is not valid."""


@dataclass
class Simple:
    kind: str  # tag, id, class, attr, pseudo
    name: str = ""
    op: str = ""
    value: str = ""
    flag: str = ""
    selectors: list[Complex] = field(default_factory=list)
    formula: tuple[int, int] = (0, 0)


@dataclass
class Complex:
    """Compounds with the combinator before each; the first one's is empty, or the relative one in ``:has``."""

    parts: list[tuple[str, list[Simple]]]


class Parser:
    """Recursive descent over the selector's text."""

    _IDENT = re.compile(r"-?(?:[A-Za-z_\u0080-\U0010ffff]|\\[0-9a-fA-F]{1,6}\s?|\\.)(?:[\w\u0080-\U0010ffff-]|\\[0-9a-fA-F]{1,6}\s?|\\.)*|--(?:[\w-])*")
    _STRING = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'")

    def __init__(self, text: str) -> None:
        self.text, self.at, self.depth = re.sub(r"/\*.*?\*/", "", text, flags=re.S), 0, 0

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def blank(self) -> bool:
        m = re.compile(r"[ \t\r\n\f]*").match(self.text, self.at)
        self.at = m.end()
        return bool(m[0])

    def ident(self) -> str:
        m = self._IDENT.match(self.text, self.at)
        if not m:
            raise SelectorError(f"a name is missing at {self.at} of {self.text!r}")
        self.at = m.end()
        return self.unescape(m[0])

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))", lambda m: chr(int(m[1], 16)) if m[1] else m[2], text)

    def parse(self) -> list[Complex]:
        found = self.list()
        if self.at < len(self.text):
            raise SelectorError(f"{self.text[self.at:]!r} is left over")
        return found

    def list(self, relative: bool = False, forgiving: bool = False) -> list[Complex]:
        self.depth += 1
        if self.depth > DEPTH:
            raise SelectorError("selectors are nested too deeply")
        found = []
        while True:
            start = self.at
            try:
                found.append(self.complex(relative))
            except SelectorError:
                if not forgiving:
                    raise
                self.at, level = start, 0
                while self.at < len(self.text) and (level or self.peek() not in ",)"):
                    level += {"(": 1, ")": -1}.get(self.peek(), 0)
                    self.at += 1
            self.blank()
            if self.peek() != ",":
                self.depth -= 1
                return found
            self.at += 1

    def complex(self, relative: bool) -> Complex:
        self.blank()
        combinator = ""
        if relative:
            combinator = " "
            if self.peek() in ">+~" and self.peek():
                combinator, self.at = self.peek(), self.at + 1
                self.blank()
        parts = [(combinator, self.compound())]
        while True:
            gap = self.blank()
            sign = self.peek()
            if sign and sign in ">+~":
                self.at += 1
                self.blank()
            elif gap and sign and sign not in ",)":
                sign = " "
            else:
                return Complex(parts)
            parts.append((sign, self.compound()))

    def compound(self) -> list[Simple]:
        found: list[Simple] = []
        if self.peek() == "*":
            self.at += 1
            found.append(Simple("tag", "*"))
        elif self._IDENT.match(self.text, self.at):
            found.append(Simple("tag", self.ident()))
        if self.peek() == "|" and self.peek(2) != "|=":
            self.at += 1
            found = [Simple("tag", "*" if self.peek() == "*" else self.ident())]
            self.at += self.peek() == "*"
        while sign := self.peek():
            if sign == "#":
                self.at += 1
                m = re.compile(r"(?:[\w\u0080-\U0010ffff-]|\\.)+").match(self.text, self.at)
                if not m:
                    raise SelectorError("an id is missing")
                self.at = m.end()
                found.append(Simple("id", self.unescape(m[0])))
            elif sign == ".":
                self.at += 1
                found.append(Simple("class", self.ident()))
            elif sign == "[":
                found.append(self.attribute())
            elif sign == ":":
                found.append(self.pseudo())
            else:
                break
        if not found:
            raise SelectorError(f"a selector is missing at {self.at} of {self.text!r}")
        return found

    def attribute(self) -> Simple:
        self.at += 1
        self.blank()
        name = self.ident()
        if self.peek() == "|" and self.peek(2) != "|=":
            self.at += 1
            name = self.ident()
        self.blank()
        if self.peek() == "]":
            self.at += 1
            return Simple("attr", name)
        m = re.compile(r"[~|^$*]?=").match(self.text, self.at)
        if not m:
            raise SelectorError("an attribute operator is missing")
        self.at = m.end()
        self.blank()
        if s := self._STRING.match(self.text, self.at):
            value, self.at = self.unescape(s[1] if s[1] is not None else s[2]), s.end()
        else:
            value = self.ident()
        self.blank()
        flag = ""
        if self.peek().lower() in ("i", "s"):
            flag, self.at = self.peek().lower(), self.at + 1
            self.blank()
        if self.peek() != "]":
            raise SelectorError("] is missing")
        self.at += 1
        return Simple("attr", name, m[0], value, flag)

    def pseudo(self) -> Simple:
        self.at += 1
        if self.peek() == ":":
            raise SelectorError("pseudo-elements select no node")
        name = self.ident().lower()
        if self.peek() != "(":
            if name not in STATIC | NEVER:
                raise SelectorError(f"unknown pseudo-class {name}")
            return Simple("pseudo", name)
        self.at += 1
        simple = Simple("pseudo", name, op="(")
        if name in ("is", "where", "matches", "any"):
            simple.selectors = self.list(forgiving=True)
        elif name == "not":
            simple.selectors = self.list()
        elif name == "has":
            simple.selectors = self.list(relative=True)
        elif name.startswith("nth-"):
            simple.formula = self.formula()
            self.blank()
            if self.text[self.at : self.at + 3].lower() == "of ":
                self.at += 3
                simple.selectors = self.list()
        elif name in ("lang", "dir"):
            m = re.compile(r"[^)]*").match(self.text, self.at)
            simple.value, self.at = m[0].strip().strip("\"'").lower(), m.end()
        else:
            raise SelectorError(f"unknown pseudo-class {name}")
        self.blank()
        if self.peek() != ")":
            raise SelectorError(") is missing")
        self.at += 1
        return simple

    def formula(self) -> tuple[int, int]:
        self.blank()
        m = re.compile(r"(even|odd)|([+-]?\d*)n(?:\s*([+-])\s*(\d+))?|([+-]?\d+)", re.I).match(self.text, self.at)
        if not m:
            raise SelectorError("an+b is missing")
        self.at = m.end()
        if m[1]:
            return (2, 0) if m[1].lower() == "even" else (2, 1)
        if m[5]:
            return 0, int(m[5])
        a = int(m[2] + "1") if m[2] in ("", "+", "-") else int(m[2])
        return a, int(m[3] + m[4]) if m[4] else 0


def parse_selector(text: str) -> list[Complex]:
    return Parser(text).parse()


def specificity(selector: Complex) -> tuple[int, int, int]:
    """Ids, classes with attributes and pseudo-classes, and tags."""
    a = b = c = 0
    for _, compound in selector.parts:
        for s in compound:
            if s.kind == "id":
                a += 1
            elif s.kind == "tag":
                c += s.name != "*"
            elif s.kind == "pseudo" and s.selectors:
                inner = max(map(specificity, s.selectors)) if s.name != "where" else (0, 0, 0)
                a, b, c = a + inner[0], b + inner[1] + s.name.startswith("nth-"), c + inner[2]
            elif not (s.kind == "pseudo" and s.name == "where"):
                b += 1
    return a, b, c


def _nth(index: Column, a: int, b: int) -> Column:
    if a == 0:
        return index == b
    return ((index - b) % a == 0) & ((index - b) / a >= 0)


class Plan:
    """Builds the plan of selectors over one node table."""

    def __init__(self, nodes: DataFrame) -> None:
        self.nodes = nodes
        self.elements = nodes.filter("node_type = 'element'")

    def select(self, selectors: list[Complex]) -> DataFrame:
        """The selected element rows, each once."""
        single = [s for s in selectors if len(s.parts) == 1 and (p := self.predicate(s.parts[0][1])) is not None]
        if len(single) == len(selectors):  # one scan, no join
            return self.elements.filter(reduce(lambda x, y: x | y, [self.predicate(s.parts[0][1]) for s in single], F.lit(False)))
        found = [self.complex(s) for s in selectors]
        if len(found) == 1:
            return found[0]
        keys = reduce(DataFrame.union, [f.select("page_id", "pre") for f in found]).distinct()
        return self.elements.join(keys, ["page_id", "pre"], "left_semi")

    def select_all(self, named: dict[str, list[Complex]]) -> DataFrame:
        """The element rows with the ``name`` of each selector that selects them.

        Selectors that need no other row share one scan, those of a row and its parent share one join; others have a plan each.
        """
        single, child, found = {}, {}, []
        for name, selectors in named.items():
            tests = [[self.predicate(compound) for _, compound in s.parts] for s in selectors]
            if any(t is None for ts in tests for t in ts) or any(len(ts) > 2 or len(ts) == 2 and s.parts[1][0] != ">" for s, ts in zip(selectors, tests, strict=True)):
                found.append(self.select(selectors).withColumn("name", F.lit(name)))
            elif all(len(ts) == 1 for ts in tests):
                single[name] = reduce(lambda x, y: x | y, [ts[0] for ts in tests])
            else:
                child[name] = tests
        named_by = lambda tests: F.explode(F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))).alias("name")
        if single:
            found.append(self.elements.select("*", named_by(single)))
        if child:
            every = [(name, ts) for name, tests in child.items() for ts in tests]
            above = [ts[0] if len(ts) == 2 else None for _, ts in every]
            held = [(f"o_{i}", t) for i, t in enumerate(above) if t is not None]
            parents = self.elements.filter(reduce(lambda x, y: x | y, [t for _, t in held]))
            parents = parents.groupBy(F.col("page_id").alias("o_page"), F.col("pre").alias("o_pre")).agg(*[F.max(t).alias(c) for c, t in held])
            joined = self.elements.filter(reduce(lambda x, y: x | y, [ts[-1] for _, ts in every])).select("*", *[ts[-1].alias(f"t_{i}") for i, (_, ts) in enumerate(every)])
            joined = joined.join(parents, (joined["page_id"] == parents["o_page"]) & (joined["parent"] == parents["o_pre"]), "left" if any(t is None for t in above) else "inner")
            tests: dict[str, Column] = {}
            for i, (name, ts) in enumerate(every):
                test = F.col(f"t_{i}") if len(ts) == 1 else F.col(f"t_{i}") & F.coalesce(F.col(f"o_{i}"), F.lit(False))
                tests[name] = tests[name] | test if name in tests else test
            found.append(joined.select(*self.elements.columns, named_by(tests)))
        return reduce(DataFrame.unionByName, found)

    def complex(self, selector: Complex) -> DataFrame:
        found = self.compound(selector.parts[0][1])
        for combinator, compound in selector.parts[1:]:
            found = self.follow(self.compound(compound), found, combinator)
        return found

    @staticmethod
    def related(node: DataFrame, other: DataFrame, combinator: str) -> Column:
        """``node`` stands to ``other`` as the right side of a combinator to its left."""
        same = node["page_id"] == other["o_page"]
        if combinator == " ":
            return same & (node["pre"] > other["o_pre"]) & (node["pre"] <= other["o_last"])
        if combinator == ">":
            return same & (node["parent"] == other["o_pre"])
        step = node["el_idx"] == other["o_idx"] + 1 if combinator == "+" else node["el_idx"] > other["o_idx"]
        return same & (node["parent"] == other["o_parent"]) & step

    @staticmethod
    def _renamed(df: DataFrame) -> DataFrame:
        return df.select(F.col("page_id").alias("o_page"), F.col("pre").alias("o_pre"), F.col("last").alias("o_last"), F.col("parent").alias("o_parent"), F.col("el_idx").alias("o_idx"))

    def follow(self, right: DataFrame, left: DataFrame, combinator: str) -> DataFrame:
        other = self._renamed(left)
        return right.join(other, self.related(right, other, combinator), "left_semi")

    def compound(self, compound: list[Simple]) -> DataFrame:
        found = self.elements
        for s in compound:
            condition = self.row(s)
            if condition is not None:
                found = found.filter(condition)
        for s in compound:
            if self.row(s) is None:
                found = self.join(found, s)
        return found

    def predicate(self, compound: list[Simple]) -> Column | None:
        """The compound as a predicate on one row, if it needs no other row."""
        rows = [self.row(s) for s in compound]
        return None if any(r is None for r in rows) else reduce(lambda x, y: x & y, rows)

    def row(self, s: Simple) -> Column | None:
        attr = lambda name: F.try_element_at("attrs", F.lit(name))
        has = lambda name: F.map_contains_key("attrs", F.lit(name))
        if s.kind == "tag":
            return F.lit(True) if s.name == "*" else (F.col("tag") == s.name) | ((F.col("ns") == "html") & (F.col("tag") == s.name.lower()))
        if s.kind == "id":
            return F.coalesce(attr("id") == s.name, F.lit(False))
        if s.kind == "class":
            return F.array_contains("classes", s.name)
        if s.kind == "attr":
            return self.attribute(s)
        name = s.name
        if name in NEVER:
            return F.lit(False)
        if s.op == "(":
            if name in ("is", "where", "matches", "any", "not"):
                inner = [self.predicate(x.parts[0][1]) if len(x.parts) == 1 else None for x in s.selectors]
                if any(i is None for i in inner):
                    return None
                either = reduce(lambda x, y: x | y, inner, F.lit(False))
                return ~either if name == "not" else either
            if name.startswith("nth-") and not s.selectors:
                index = {
                    "nth-child": F.col("el_idx"), "nth-last-child": F.col("el_count") - F.col("el_idx") + 1,
                    "nth-of-type": F.col("type_idx"), "nth-last-of-type": F.col("type_count") - F.col("type_idx") + 1,
                }.get(name)
                if index is None:
                    raise SelectorError(f"unknown pseudo-class {name}")
                return _nth(index, *s.formula)
            return None
        tag, kind = F.col("tag"), F.lower(F.coalesce(attr("type"), F.lit("")))
        textual = (tag == "textarea") | ((tag == "input") & kind.isin(*TEXTUAL))
        writable = textual & ~has("readonly") & ~has("disabled") | F.coalesce(F.lower(attr("contenteditable")).isin("", "true", "plaintext-only"), F.lit(False))
        rows = {
            "root": F.col("depth") == 1,
            "scope": F.col("depth") == 1,
            "first-child": F.col("el_idx") == 1,
            "last-child": F.col("el_idx") == F.col("el_count"),
            "only-child": F.col("el_count") == 1,
            "first-of-type": F.col("type_idx") == 1,
            "last-of-type": F.col("type_idx") == F.col("type_count"),
            "only-of-type": F.col("type_count") == 1,
            "link": tag.isin("a", "area") & has("href"),
            "any-link": tag.isin("a", "area") & has("href"),
            "checked": (tag == "input") & kind.isin("checkbox", "radio") & has("checked") | (tag == "option") & has("selected"),
            "required": tag.isin("input", "select", "textarea") & has("required"),
            "optional": tag.isin("input", "select", "textarea") & ~has("required"),
            "read-write": writable,
            "read-only": ~writable,
            "defined": (F.col("ns") != "html") | ~tag.contains("-"),
            "placeholder-shown": textual & has("placeholder") & (F.coalesce(attr("value"), F.lit("")) == ""),
            "indeterminate": (tag == "progress") & ~has("value"),
        }
        if name in rows:
            return rows[name]
        if name == "empty" and "filled" in self.nodes.columns:
            return ~F.col("filled")
        if name in ("empty", "enabled", "disabled", "default"):
            return None
        raise SelectorError(f"unknown pseudo-class {name}")

    @staticmethod
    def attribute(s: Simple) -> Column:
        name = s.name.lower()
        value = F.coalesce(F.try_element_at("attrs", F.lit(s.name)), F.try_element_at("attrs", F.lit(name)))
        if not s.op:
            return value.isNotNull()
        wanted = s.value
        if s.flag == "i" or s.flag != "s" and name in CASELESS:
            value, wanted = F.lower(value), wanted.lower()
        if s.op in ("~=", "^=", "$=", "*=") and (not wanted or s.op == "~=" and re.search(r"\s", wanted)):
            return F.lit(False)
        test = {
            "=": lambda: value == wanted,
            "~=": lambda: F.array_contains(F.split(value, "[ \t\n\f\r]+"), wanted),
            "|=": lambda: (value == wanted) | value.startswith(wanted + "-"),
            "^=": lambda: value.startswith(wanted),
            "$=": lambda: value.endswith(wanted),
            "*=": lambda: value.contains(wanted),
        }[s.op]()
        return F.coalesce(test, F.lit(False))

    def join(self, found: DataFrame, s: Simple) -> DataFrame:
        keys = ["page_id", "pre"]
        if s.name in ("is", "where", "matches", "any", "not"):
            inner = self.select(s.selectors).select(*keys)
            return found.join(inner, keys, "left_anti" if s.name == "not" else "left_semi")
        if s.name == "has":
            anchors = [self.anchors(x) for x in s.selectors]
            return found.join(reduce(DataFrame.union, anchors).distinct(), keys, "left_semi")
        if s.name == "empty":
            filled = self.nodes.filter("node_type = 'element' OR node_type = 'text' AND data <> ''").select("page_id", F.col("parent").alias("pre"))
            return found.join(filled, keys, "left_anti")
        if s.name.startswith("nth-"):
            matching = self.select(s.selectors)
            last = "last" in s.name
            from pyspark.sql.window import Window

            order = Window.partitionBy("page_id", "parent").orderBy(F.desc("pre") if last else F.col("pre"))
            ranked = matching.withColumn("_n", F.row_number().over(order)).filter(_nth(F.col("_n"), *s.formula)).select(*keys)
            return found.join(ranked, keys, "left_semi")
        if s.name in ("disabled", "enabled"):
            own = self.elements.filter(F.col("tag").isin(*CONTROLS))
            direct = own.filter(F.map_contains_key("attrs", F.lit("disabled")))
            sets = self._renamed(direct.filter("tag = 'fieldset'"))
            legends = self.elements.filter("tag = 'legend' AND type_idx = 1")
            inside = own.join(sets, self.related(own, sets, " "), "left_semi")
            allowed = self._renamed(legends.join(sets, self.related(legends, sets, ">"), "left_semi"))
            inside = inside.join(allowed, self.related(inside, allowed, " "), "left_anti")
            off = direct.select(*keys).union(inside.select(*keys)).distinct()
            if s.name == "disabled":
                return found.join(off, keys, "left_semi")
            return found.filter(F.col("tag").isin(*CONTROLS)).join(off, keys, "left_anti")
        if s.name == "default":
            kind = F.lower(F.coalesce(F.try_element_at("attrs", F.lit("type")), F.lit("")))
            submit = self.elements.filter((F.col("tag") == "button") & kind.isin("", "submit") | (F.col("tag") == "input") & kind.isin("submit", "image"))
            forms = self._renamed(self.elements.filter("tag = 'form'"))
            first = submit.join(forms, self.related(submit, forms, " ")).groupBy("page_id", "o_pre").agg(F.min("pre").alias("pre")).select(*keys)
            chosen = self.elements.filter((F.col("tag") == "option") & F.map_contains_key("attrs", F.lit("selected")) | kind.isin("checkbox", "radio") & F.map_contains_key("attrs", F.lit("checked")))
            return found.join(first.union(chosen.select(*keys)).distinct(), keys, "left_semi")
        if s.name in ("lang", "dir"):
            above = self.elements.filter(F.map_contains_key("attrs", F.lit(s.name))).select(
                F.col("page_id").alias("o_page"), F.col("pre").alias("o_pre"), F.col("last").alias("o_last"), F.lower(F.try_element_at("attrs", F.lit(s.name))).alias("_v")
            )
            on = (found["page_id"] == above["o_page"]) & found["pre"].between(above["o_pre"], above["o_last"])
            nearest = found.join(above, on, "left").groupBy("page_id", "pre").agg(F.max_by("_v", "o_pre").alias("_v"))
            if s.name == "dir":  # a page runs from left to right unless it says otherwise
                nearest = nearest.fillna("ltr", ["_v"])
            test = (F.col("_v") == s.value) | F.col("_v").startswith(s.value + "-") if s.name == "lang" else F.col("_v") == s.value
            return found.join(nearest.filter(test).select(*keys), keys, "left_semi")
        raise SelectorError(f"unknown pseudo-class {s.name}")

    def anchors(self, relative: Complex) -> DataFrame:
        """Keys of the elements from which a relative selector leads somewhere: its joins are followed backwards."""
        parts = relative.parts
        reached = self.compound(parts[-1][1])
        for i in range(len(parts) - 1, -1, -1):
            step = parts[i][0]
            before = self.compound(parts[i - 1][1]) if i else self.elements
            other = reached.select(F.col("page_id").alias("r_page"), F.col("pre").alias("r_pre"), F.col("parent").alias("r_parent"), F.col("el_idx").alias("r_idx"))
            same = before["page_id"] == other["r_page"]
            on = {
                " ": same & (other["r_pre"] > before["pre"]) & (other["r_pre"] <= before["last"]),
                ">": same & (other["r_parent"] == before["pre"]),
                "+": same & (other["r_parent"] == before["parent"]) & (other["r_idx"] == before["el_idx"] + 1),
                "~": same & (other["r_parent"] == before["parent"]) & (other["r_idx"] > before["el_idx"]),
            }[step]
            reached = before.join(other, on, "left_semi")
        return reached.select("page_id", "pre")


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """Element rows that match the selector list, each once. Invalid selectors raise :class:`SelectorError` on the driver."""
    return Plan(nodes).select(parse_selector(selector))


def select_all(nodes: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """Element rows that match each of several selector lists, each once with the ``name`` of the list, as few scans and joins of the
    node table as they need together. Invalid selectors raise :class:`SelectorError` on the driver; none at all is a ``ValueError``."""
    if not selectors:
        raise ValueError("no selectors")
    return Plan(nodes).select_all({name: parse_selector(s) for name, s in selectors.items()})


def closest(nodes: DataFrame, starts: DataFrame, selector: str) -> DataFrame:
    """For each start row the nearest element at or above it that matches: ``page_id``, ``pre``, ``closest``."""
    found = Plan._renamed(select(nodes, selector))
    on = (starts["page_id"] == found["o_page"]) & starts["pre"].between(found["o_pre"], found["o_last"])
    return starts.join(found, on).groupBy("page_id", "pre").agg(F.max("o_pre").alias("closest"))


def axis(nodes: DataFrame, starts: DataFrame, name: str) -> DataFrame:
    """Pairs ``page_id``, ``start``, and the node row reached along an axis of the XPath data model."""
    s = starts.select(F.col("page_id").alias("s_page"), F.col("pre").alias("start"), F.col("last").alias("s_last"), F.col("parent").alias("s_parent"))
    n = nodes
    same = n["page_id"] == s["s_page"]
    on = {
        "self": n["pre"] == s["start"],
        "child": n["parent"] == s["start"],
        "descendant": (n["pre"] > s["start"]) & (n["pre"] <= s["s_last"]),
        "descendant-or-self": n["pre"].between(s["start"], s["s_last"]),
        "parent": n["pre"] == s["s_parent"],
        "ancestor": (n["pre"] < s["start"]) & (n["last"] >= s["s_last"]),
        "ancestor-or-self": (n["pre"] <= s["start"]) & (n["last"] >= s["s_last"]),
        "following-sibling": (n["parent"] == s["s_parent"]) & (n["pre"] > s["start"]),
        "preceding-sibling": (n["parent"] == s["s_parent"]) & (n["pre"] < s["start"]),
        "following": n["pre"] > s["s_last"],
        "preceding": n["last"] < s["start"],
    }[name]
    return n.join(s, same & on).drop("s_page", "s_last", "s_parent")
