"""Editing pages: removing, unwrapping, renaming and setting by selector; absolute links; comments; minified style sheets."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.functions.markup import serialize
from pagemill.functions.styles import minify_css
from pagemill.operators.extract import LINKS, _join, base_of
from pagemill.operators.selectors import CASELESS, CONTROLS, NEVER, TEXTUAL, Complex, SelectorError, Simple, parse_selector
from pagemill.sources.nodes import per_page
from pagemill.sources.tree import Node, parse, parse_fragment


__all__ = ["Edit", "annotated_text", "count_many", "css_to_xpath", "is_normalized", "matches", "matches_many", "minify_css", "normalize", "normalizer", "rewrite", "select_many"]


def _siblings(n: Node) -> list[Node]:
    return [c for c in n.parent.children if c.kind == "element"] if n.parent is not None else [n]


def _simple(n: Node, s: Simple) -> bool:
    if s.kind == "tag":
        return s.name == "*" or n.tag == s.name or n.ns == "html" and n.tag == s.name.lower()
    if s.kind == "id":
        return n.attrs.get("id") == s.name
    if s.kind == "class":
        return s.name in n.attrs.get("class", "").split()
    if s.kind == "attr":
        value = n.attrs.get(s.name, n.attrs.get(s.name.lower()))
        if value is None or not s.op:
            return value is not None
        wanted = s.value
        if s.flag == "i" or s.flag != "s" and s.name.lower() in CASELESS:
            value, wanted = value.lower(), wanted.lower()
        if s.op != "=" and s.op != "|=" and not wanted:
            return False
        return {
            "=": value == wanted, "~=": wanted in value.split(), "|=": value == wanted or value.startswith(wanted + "-"), "^=": value.startswith(wanted),
            "$=": value.endswith(wanted), "*=": wanted in value,
        }[s.op]
    if s.name in ("is", "where", "matches", "any"):
        return any(matches(n, x) for x in s.selectors)
    if s.name == "not":
        return not any(matches(n, x) for x in s.selectors)
    if s.name == "has":
        return any(_relative(n, x) for x in s.selectors)
    if s.name == "root":
        return n.parent is not None and n.parent.kind == "document"
    if s.name == "empty":
        return not any(c.kind == "element" or c.kind == "text" and c.data for c in n.children)
    if s.name in ("link", "any-link"):
        return n.tag in ("a", "area") and "href" in n.attrs
    if not s.name.startswith(("nth-", "first-", "last-", "only-")):
        return _state(n, s)
    family = _siblings(n)
    if "type" in s.name:
        family = [c for c in family if c.tag == n.tag]
    if s.name.startswith("nth-"):
        if s.selectors:
            family = [c for c in family if any(matches(c, x) for x in s.selectors)]
        if n not in family:
            return False
        index = len(family) - family.index(n) if "last" in s.name else family.index(n) + 1
        a, b = s.formula
        return index == b if a == 0 else (index - b) % a == 0 and (index - b) // a >= 0
    return {"first": family[0] is n, "last": family[-1] is n, "only": len(family) == 1}[s.name.split("-")[0]]


def _state(n: Node, s: Simple) -> bool:
    """Pseudo-classes of forms, languages and definition; those of interaction match nothing."""
    name, kind = s.name, n.attrs.get("type", "").lower()
    field_ = n.tag in ("input", "select", "textarea")
    if name == "checked":
        return n.tag == "input" and kind in ("checkbox", "radio") and "checked" in n.attrs or n.tag == "option" and "selected" in n.attrs
    if name == "required":
        return field_ and "required" in n.attrs
    if name == "optional":
        return field_ and "required" not in n.attrs
    if name in ("disabled", "enabled"):
        return n.tag in CONTROLS and _disabled(n) == (name == "disabled")
    if name in ("read-write", "read-only", "placeholder-shown"):
        textual = n.tag == "textarea" or n.tag == "input" and kind in TEXTUAL
        if name == "placeholder-shown":
            return textual and "placeholder" in n.attrs and not n.attrs.get("value")
        writable = textual and "readonly" not in n.attrs and "disabled" not in n.attrs or n.attrs.get("contenteditable", "no").lower() in ("", "true", "plaintext-only")
        return writable == (name == "read-write")
    if name == "indeterminate":
        return n.tag == "progress" and "value" not in n.attrs
    if name == "default":
        if n.tag == "option" and "selected" in n.attrs or kind in ("checkbox", "radio") and "checked" in n.attrs:
            return True
        form = next((x for x in _before(n, " ") if x.tag == "form"), None)
        first = next((x for x in form.elements() if _submits(x)), None) if form is not None else None
        return first is n
    if name == "defined":
        return n.ns != "html" or "-" not in n.tag
    if name == "scope":
        return n.parent is not None and n.parent.kind == "document"
    if name in ("lang", "dir"):
        nearest = next((x.attrs[name].lower() for x in [n, *_before(n, " ")] if name in x.attrs), "ltr" if name == "dir" else "")
        return nearest == s.value or name == "lang" and nearest.startswith(f"{s.value}-")
    return False


def _submits(n: Node) -> bool:
    kind = n.attrs.get("type", "").lower()
    return n.tag == "button" and kind in ("", "submit") or n.tag == "input" and kind in ("submit", "image")


def _disabled(n: Node) -> bool:
    """Whether a control is disabled itself or by a fieldset around it, the first legend of which is exempt."""
    if "disabled" in n.attrs:
        return True
    below = n
    for x in _before(n, " "):
        if x.tag == "fieldset" and "disabled" in x.attrs:
            legend = next((c for c in x.children if c.tag == "legend"), None)
            if legend is None or legend is not below and not any(y is below for y in legend.elements()):
                return True
        below = x
    return False


def _before(n: Node, combinator: str) -> list[Node]:
    if combinator in (" ", ">"):
        out, up = [], n.parent
        while up is not None and up.kind == "element":
            out.append(up)
            up = up.parent
        return out[:1] if combinator == ">" else out
    family = _siblings(n)
    earlier = family[: family.index(n)][::-1]
    return earlier[:1] if combinator == "+" else earlier


def matches(n: Node, selector: Complex, at: int | None = None) -> bool:
    """Whether an element of a tree matches."""
    at = len(selector.parts) - 1 if at is None else at
    combinator, compound = selector.parts[at]
    for s in compound:
        if not _simple(n, s):
            return False
    if at == 0:
        return True
    for x in _before(n, combinator):
        if matches(x, selector, at - 1):
            return True
    return False


def _relative(anchor: Node, selector: Complex) -> bool:
    first = selector.parts[0][0]
    scope = anchor.elements() if first in (" ", ">") else (x for s in _siblings(anchor) for x in s.elements())

    def back(n: Node, at: int) -> bool:
        combinator, compound = selector.parts[at]
        for s in compound:
            if not _simple(n, s):
                return False
        return any(x is anchor if at == 0 else back(x, at - 1) for x in _before(n, combinator))

    at = len(selector.parts) - 1
    for x in scope:
        if x is not anchor and back(x, at):
            return True
    return False


@dataclass(frozen=True)
class Edit:
    """One step for what ``selector`` selects: ``remove``, ``unwrap``, ``empty``, ``rename``, ``set`` or ``drop`` (an attribute), or ``before``,
    ``after``, ``prepend``, ``append``, ``replace``, ``content`` (HTML)."""

    action: str
    selector: str
    name: str = ""
    value: str = ""
    parsed: list = field(default_factory=list, compare=False)


def _apply(document: Node, edit: Edit) -> None:
    found = [n for n in document.elements() if any(matches(n, s) for s in edit.parsed)]
    for n in found:
        if edit.action == "remove":
            n.remove()
        elif edit.action == "unwrap" and n.parent is not None:
            at = n.parent.children.index(n)
            for i, c in enumerate(list(n.children)):
                n.parent.insert(at + i, c)
            n.remove()
        elif edit.action == "empty":
            n.children = []
        elif edit.action == "rename":
            n.tag = edit.name
        elif edit.action == "set":
            n.attrs[edit.name] = edit.value
        elif edit.action == "drop":
            n.attrs.pop(edit.name, None)
        elif edit.action in HTML_ACTIONS:
            _insert(n, edit.action, edit.name)


HTML_ACTIONS = ("before", "after", "prepend", "append", "replace", "content")


def _insert(n: Node, action: str, html: str) -> None:
    inside = action in ("prepend", "append", "content")
    if not inside and n.parent is None:
        return
    place = n if inside else n.parent
    new = parse_fragment(html, place.tag or "body")
    at = 0 if action in ("prepend", "content") else len(n.children) if action == "append" else next(i for i, c in enumerate(place.children) if c is n) + (action == "after")
    if action == "content":
        n.children = []
    for i, x in enumerate(new):
        place.insert(at + i, x)
    if action == "replace":
        n.remove()


ACTIONS = ("remove", "unwrap", "empty", "rename", "set", "drop", *HTML_ACTIONS, "absolute", "comments")


def rewrite(pages: DataFrame, edits: list[tuple[str, ...]], html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """``rewritten``: the page after the edits in their order.

    An edit is (action, selector[, name[, value]]); ``("absolute",)`` resolves all addresses against the page's, and
    ``("comments",)`` takes the comments out. Wrong edits raise on the driver. Null is an empty document.
    """
    steps = []
    for action, *rest in edits:
        if action not in ACTIONS:
            raise ValueError(f"no edit {action}")
        steps.append(Edit(action, *rest, parsed=parse_selector(rest[0])) if rest else Edit(action, ""))
        if not rest and action not in ("absolute", "comments"):
            raise SelectorError(f"{action} needs a selector")

    def kernel(text: str | None, address: str | None) -> list[tuple]:
        document = parse(text)
        for step in steps:
            if step.action == "absolute":
                base = base_of(document, address)
                for n in document.elements():
                    for name in LINKS.get(n.tag, ()):
                        if name in n.attrs and name != "srcset":
                            n.attrs[name] = _join(base, n.attrs[name].strip())
            elif step.action == "comments":
                for n in [x for x in document.walk() if x.kind == "comment"]:
                    n.remove()
            else:
                _apply(document, step)
        return [(serialize(document),)]

    return per_page(pages, kernel, "page_id bigint, rewritten string", [pa.string()], html, url, key=key)


#: Kinds of simple selectors by how few elements they leave; each has a list of elements in :func:`_listed`.
_SPARSE = ("id", "class", "tag", "attr")


def _keys(selector: Complex) -> list[tuple[str, str]] | None:
    """Lists of :func:`_listed` that hold all elements which the selector can match; null if any element may."""
    last = selector.parts[-1][1]
    if any(s.kind == "pseudo" and s.name in NEVER for s in last):
        return []
    for kind in _SPARSE:
        if found := next((s.name for s in last if s.kind == kind and s.name != "*"), None):
            return [(kind, name) for name in ({found, found.lower()} if kind in ("tag", "attr") else (found,))]
    if any(s.kind == "pseudo" and s.name in ("root", "scope") for s in last):
        return [("root", "")]
    for s in last:
        if s.kind == "pseudo" and s.name in ("is", "where", "matches", "any") and None not in (inner := [_keys(x) for x in s.selectors]):
            return [key for keys in inner for key in keys]
    return None


def _listed(elements: list[Node]) -> dict[tuple[str, str], list[int]]:
    """Places of elements by tag, attribute, id, class and, if the document holds them, as root."""
    by: dict[tuple[str, str], list[int]] = {}
    for i, n in enumerate(elements):
        by.setdefault(("tag", n.tag), []).append(i)
        if n.parent is not None and n.parent.kind == "document":
            by.setdefault(("root", ""), []).append(i)
        for name, value in n.attrs.items():
            by.setdefault(("attr", name), []).append(i)
            if name == "id":
                by.setdefault(("id", value), []).append(i)
            elif name == "class":
                for word in value.split():
                    by.setdefault(("class", word), []).append(i)
    return by


def selected(document: Node, named: dict[str, list[tuple[Complex, list[tuple[str, str]] | None]]]) -> list[tuple[str, list[Node]]]:
    """The elements that each of several selector lists (with their :func:`_keys`) selects, in document order: only those listed are tried."""
    elements = list(document.elements())
    by, out = _listed(elements), []
    for name, alternatives in named.items():
        found: set[int] = set()
        for selector, keys in alternatives:
            places = range(len(elements)) if keys is None else {i for key in keys for i in by.get(key, ())}
            found.update(i for i in places if i not in found and matches(elements[i], selector))
        out.append((name, [elements[i] for i in sorted(found)]))
    return out


def count_many(pages: DataFrame, selectors: dict[str, str], html: str = "html", key: str = "page_id") -> DataFrame:
    """How many elements each of several selectors selects, in one pass and without a shuffle: ``name, n`` of every page and selector with a match."""
    parsed = {name: [(s, _keys(s)) for s in parse_selector(text)] for name, text in selectors.items()}
    kernel = lambda text: [(name, len(found)) for name, found in selected(parse(text), parsed) if found]
    return per_page(pages, kernel, "page_id bigint, name string, n bigint", [pa.string(), pa.int64()], html, key=key)


def select_many(pages: DataFrame, selectors: dict[str, str], html: str = "html", key: str = "page_id") -> DataFrame:
    """Several selectors in one pass over the pages: ``name, pos, tag, text`` of every match."""
    parsed = {name: [(s, _keys(s)) for s in parse_selector(text)] for name, text in selectors.items()}
    kernel = lambda text: [(name, i, n.tag, n.text()) for name, found in selected(parse(text), parsed) for i, n in enumerate(found, 1)]

    return per_page(pages, kernel, "page_id bigint, name string, pos int, tag string, text string", [pa.string(), pa.int32(), pa.string(), pa.string()], html, key=key)


def matches_many(pages: DataFrame, selectors: dict[str, str], html: str = "html", key: str = "page_id") -> DataFrame:
    """Which of several selectors every element matches: ``element_no`` in document order, ``tag``, ``names``; those that match none are left out."""
    parsed = {name: parse_selector(s) for name, s in selectors.items()}

    def kernel(text: str | None) -> list[tuple]:
        found = [(i, n.tag, [k for k, v in parsed.items() if any(matches(n, s) for s in v)]) for i, n in enumerate(parse(text).elements(), 1)]
        return [row for row in found if row[2]]

    return per_page(pages, kernel, "page_id bigint, element_no int, tag string, names array<string>", [pa.int32(), pa.string(), pa.list_(pa.string())], html, key=key)


def annotated_text(pages: DataFrame, labels: dict[str, str], html: str = "html", key: str = "page_id") -> DataFrame:
    """The text of a page's body and the spans of it that labelled selectors cover: ``text``, ``spans`` (start, end, label)."""
    parsed = {label: parse_selector(s) for label, s in labels.items()}

    def kernel(text: str | None) -> list[tuple]:
        body = parse(text).first("body")
        spans, out, size = [], [], 0
        begun: dict[int, int] = {}

        def visit(n: Node) -> None:
            nonlocal size
            begun[id(n)] = size
            for c in n.children:
                if c.kind == "text":
                    out.append(c.data)
                    size += len(c.data)
                elif c.kind == "element" and c.tag not in ("script", "style", "template"):
                    visit(c)
            if n.kind == "element":
                spans.extend({"start": begun[id(n)], "end": size, "label": k} for k, v in parsed.items() if any(matches(n, s) for s in v))

        if body is not None:
            visit(body)
        return [("".join(out), sorted(spans, key=lambda s: (s["start"], -s["end"], s["label"])))]

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))
    return per_page(pages, kernel, "page_id bigint, text string, spans array<struct<start:int,end:int,label:string>>", [pa.string(), kind], html, key=key)


def css_to_xpath(selector: str) -> str:
    """The XPath that selects what a selector does; what XPath cannot say raises :class:`SelectorError`."""

    def quoted(v: str) -> str:
        return f"'{v}'" if "'" not in v else f'"{v}"'

    def test(s: Simple) -> str:
        if s.kind == "id":
            return f"@id = {quoted(s.name)}"
        if s.kind == "class":
            return f"contains(concat(' ', normalize-space(@class), ' '), {quoted(f' {s.name} ')})"
        if s.kind == "attr":
            name, v = f"@{s.name}", quoted(s.value)
            return {
                "": name, "=": f"{name} = {v}", "~=": f"contains(concat(' ', normalize-space({name}), ' '), {quoted(f' {s.value} ')})", "|=": f"({name} = {v} or starts-with({name}, {quoted(s.value + '-')}))",
                "^=": f"starts-with({name}, {v})", "$=": f"ends-with({name}, {v})", "*=": f"contains({name}, {v})",
            }[s.op]
        simple = {"first-child": "not(preceding-sibling::*)", "last-child": "not(following-sibling::*)", "only-child": "not(preceding-sibling::* or following-sibling::*)", "empty": "not(*) and not(text())", "root": "not(parent::*)"}
        if s.name in simple:
            return simple[s.name]
        if s.name in ("not", "is", "where") and all(len(x.parts) == 1 for x in s.selectors):
            inner = " or ".join("(" + " and ".join([*(f"self::{y.name}" for y in x.parts[0][1] if y.kind == "tag" and y.name != "*"), *(test(y) for y in x.parts[0][1] if y.kind != "tag")] or ["true()"]) + ")" for x in s.selectors)
            return f"not({inner})" if s.name == "not" else f"({inner})"
        if s.name == "has":
            return " or ".join("." + path(x) for x in s.selectors)
        if s.name in ("nth-child", "nth-last-child") and not s.selectors:
            a, b = s.formula
            place = f"count({'preceding' if s.name == 'nth-child' else 'following'}-sibling::*) + 1"
            return f"{place} = {b}" if a == 0 else f"({place} - {b}) mod {a} = 0 and ({place} - {b}) div {a} >= 0"
        raise SelectorError(f":{s.name} has no XPath")

    def path(c: Complex) -> str:
        out = ""
        for combinator, compound in c.parts:
            tag = next((s.name for s in compound if s.kind == "tag"), "*")
            axis = {"": "//", " ": "//", ">": "/", "+": "/following-sibling::*[1]/self::", "~": "/following-sibling::"}[combinator]
            out += axis + tag + "".join(f"[{test(s)}]" for s in compound if s.kind != "tag")
        return out

    return " | ".join(map(path, parse_selector(selector)))


def normalizer(form: str) -> Callable[[str | None], str | None]:
    """Unicode normalization NFC, NFD, NFKC or NFKD of one value."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"no form {form}")
    return lambda text: None if text is None else unicodedata.normalize(form, text)


def is_normalized(text: str | None, form: str = "NFC") -> bool | None:
    return None if text is None else unicodedata.is_normalized(form, text)


def normalize(df: DataFrame, text: str, form: str = "NFC") -> DataFrame:
    """Column ``text`` in a Unicode normalization form; other columns stay, null stays null."""
    one = normalizer(form)
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            column = pa.array([one(v) for v in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)
