"""Computed styles: the rules of a page's style sheets and style attributes, cascaded and inherited."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.operators.edit import matches
from pagemill.operators.selectors import SelectorError, parse_selector, specificity
from pagemill.sources.nodes import per_page
from pagemill.sources.tree import Node, parse

# Properties that an element takes from its parent where no rule sets them.
INHERITED = frozenset(
    "border-collapse border-spacing caption-side color cursor direction empty-cells font font-family font-size font-style font-variant font-weight hyphens "
    "letter-spacing line-height list-style list-style-image list-style-position list-style-type orphans overflow-wrap quotes tab-size text-align "
    "text-indent text-transform visibility white-space widows word-break word-spacing writing-mode".split()
)
#: Media for which the styles are computed.
MEDIA = frozenset(("all", "screen", ""))


def declarations(text: str) -> list[tuple[str, str, bool]]:
    """Property, value and importance of each declaration; semicolons in brackets and quotes part nothing."""
    out = []
    for part in re.findall(r"(?:[^;\"'(]|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\([^)]*\))+", text):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip()
        important = bool(m := re.search(r"!\s*important\s*$", value, re.I))
        value = value[: m.start()].strip() if m else value
        if colon and value and re.fullmatch(r"-{0,2}[a-z][\w-]*", name):
            out.append((name, value, important))
    return out


def rules(text: str) -> list[tuple[str, str]]:
    """Selector texts and declaration blocks, those inside fitting media rules too."""
    text, out, at = re.sub(r"/\*.*?\*/|<!--|-->", "", text, flags=re.S), [], 0
    while (brace := text.find("{", at)) >= 0:
        head = text[at:brace].rpartition(";")[2].strip() if "@" not in text[at:brace] or ";" in text[at:brace] else text[at:brace].strip()
        level, end = 1, brace + 1
        while end < len(text) and level:
            level += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
        body = text[brace + 1 : end - (level == 0)]
        if head.lower().startswith("@media"):
            kinds = {re.split(r"\s|\(", k.strip().removeprefix("only ").strip())[0] for k in head[6:].lower().split(",")}
            if kinds & MEDIA and "(" not in head:
                out += rules(body)
        elif not head.startswith("@"):
            out.append((head, body))
        at = end
    return out


class StyleDeclaration:
    """Properties of a rule or a ``style`` attribute, the last and the important ones first to count."""

    def __init__(self, text: str) -> None:
        self.found: dict[str, tuple[str, bool]] = {}
        for name, value, important in declarations(text):
            if important or not self.found.get(name, ("", False))[1]:
                self.found.pop(name, None)
                self.found[name] = (value, important)

    @classmethod
    def parse(cls, text: str) -> StyleDeclaration:
        return cls(text)

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.found.get(name.lower(), (default, False))[0]

    def __getitem__(self, name: str) -> str:
        return self.found[name.lower()][0]

    def important(self, name: str) -> bool:
        return self.found.get(name.lower(), ("", False))[1]

    @property
    def properties(self) -> list[str]:
        return list(self.found)

    @property
    def text(self) -> str:
        return "; ".join(f"{k}: {v}{' !important' if i else ''}" for k, (v, i) in self.found.items())


class StyleRule:
    """A selector with its declarations."""

    def __init__(self, selector: str, body: str) -> None:
        self.selector, self.style = selector, StyleDeclaration(body)

    @property
    def specificity(self) -> tuple:
        return max(map(specificity, parse_selector(self.selector)))


class StyleSheet:
    """The rules of a style sheet that hold for a screen."""

    def __init__(self, text: str) -> None:
        self.rules = [StyleRule(head, body) for head, body in rules(text)]

    def __getitem__(self, at: int) -> StyleRule:
        return self.rules[at]

    def __len__(self) -> int:
        return len(self.rules)


def style_rules(sheets: DataFrame, css: str = "css", key: str = "page_id") -> DataFrame:
    """``rule_no, selector, property, value, important``: the declarations of every style sheet."""

    def kernel(text: str | None) -> list[tuple]:
        found = StyleSheet(text or "").rules
        return [(i, r.selector, name, r.style[name], r.style.important(name)) for i, r in enumerate(found, 1) for name in r.style.properties]

    schema = "page_id bigint, rule_no int, selector string, property string, value string, important boolean"
    return per_page(sheets, kernel, schema, [pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_()], css, key=key)


def computed(document: Node) -> list[tuple[Node, dict[str, str]]]:
    """The style of every element: importance, then origin (style attributes win), specificity and order decide."""
    sheet = []
    for n in document.elements():
        if n.tag == "style" and set(n.attrs.get("media", "").lower().replace(" ", "").split(",")) & MEDIA:
            for head, body in rules(n.text()):
                try:
                    parsed = parse_selector(head)
                except SelectorError:
                    continue
                sheet.append((parsed, declarations(body)))
    styles: dict[int, dict[str, str]] = {}
    out = []
    for n in document.elements():
        found: dict[str, tuple[tuple, str]] = {}

        def offer(name: str, value: str, rank: tuple) -> None:
            if name not in found or rank >= found[name][0]:  # noqa: B023
                found[name] = (rank, value)  # noqa: B023

        for order, (selectors, block) in enumerate(sheet):
            weights = [specificity(s) for s in selectors if matches(n, s)]
            if weights:
                for name, value, important in block:
                    offer(name, value, (important, False, max(weights), order))
        for name, value, important in declarations(n.attrs.get("style", "")):
            offer(name, value, (important, True, (0, 0, 0), 0))
        above = styles.get(id(n.parent), {})
        style = {k: v for k, v in above.items() if k in INHERITED or k.startswith("--")}
        for name, (_, value) in found.items():
            if value.lower() == "inherit":
                value = above.get(name, "")
            if value.lower() in ("initial", "unset", "revert", ""):
                style.pop(name, None)
                if value.lower() == "unset" and name in INHERITED and name in above:
                    style[name] = above[name]
            else:
                style[name] = value
        for name, value in style.items():
            style[name] = re.sub(r"var\(\s*(--[\w-]+)\s*(?:,\s*([^)]*))?\)", lambda m: style.get(m[1], m[2] or ""), value)  # noqa: B023
        styles[id(n)] = style
        out.append((n, style))
    return out


def computed_styles(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """One row per element with a style: ``element_no`` in document order, ``tag``, ``style``. Null is an empty document."""

    def kernel(text: str | None) -> list[tuple]:
        return [(i, n.tag, sorted(style.items())) for i, (n, style) in enumerate(computed(parse(text)), 1) if style]

    schema = "page_id bigint, element_no int, tag string, style map<string,string>"
    return per_page(pages, kernel, schema, [pa.int32(), pa.string(), pa.map_(pa.string(), pa.string())], html, key=key)
