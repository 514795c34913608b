"""Parse errors of pages with their places, and the places of elements.

The tokenizer and the tree builder recover from everything and do not stop to complain; what was wrong is read off afterwards
from the spans of the tokens and the nodes, so pages that nobody asks about pay nothing. Codes are the standard's.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.sources.nodes import per_page
from pagemill.sources.tokens import Tokenizer
from pagemill.sources.tree import HTML, IMPLIED_END, VOID, Builder, Node

RAW = frozenset(("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "plaintext"))
_ATTRIBUTES = re.compile(r"([\s/]*)([^\s/>=][^\s/>=]*|=[^\s/>=]*)(\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*|(?=\s*\Z)))?")
_REFERENCE = re.compile(r"&(?:#([xX]?)([0-9A-Za-z]*)(;?)|([A-Za-z][A-Za-z0-9]*)(;?))")


class Lines:
    """Lines and columns, both from 1, of places in a text."""

    def __init__(self, text: str) -> None:
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def __call__(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.starts, at)
        return line, at - self.starts[line - 1] + 1


def _references(text: str, at: int, attribute: bool) -> list[tuple[str, int]]:
    out = []
    for m in _REFERENCE.finditer(text):
        place = at + m.start()
        if m[4] is None:
            digits = re.match("[0-9A-Fa-f]*" if m[1] else "[0-9]*", m[2])[0]
            if not digits:
                out.append(("absence-of-digits-in-numeric-character-reference", place))
                continue
            code = int(digits, 16 if m[1] else 10)
            if digits != m[2] or not m[3]:
                out.append(("missing-semicolon-after-character-reference", place))
            if code == 0:
                out.append(("null-character-reference", place))
            elif code > 0x10FFFF:
                out.append(("character-reference-outside-unicode-range", place))
            elif 0xD800 <= code <= 0xDFFF:
                out.append(("surrogate-character-reference", place))
            elif 0xFDD0 <= code <= 0xFDEF or code & 0xFFFE == 0xFFFE:
                out.append(("noncharacter-character-reference", place))
            elif code < 0x20 and code not in (9, 10, 12) or 0x7F <= code <= 0x9F:
                out.append(("control-character-reference", place))
        elif m[4] + ";" in html5 and m[5]:
            continue
        elif any(m[4][:i] in html5 for i in range(len(m[4]), 1, -1)):
            following = text[m.end() : m.end() + 1]
            if not (attribute and (following == "=" or m[4] not in html5)):
                out.append(("missing-semicolon-after-character-reference", place))
        elif m[5]:
            out.append(("unknown-named-character-reference", place))
    return out


def _tag_errors(source: str, at: int, end_tag: bool, name: str) -> list[tuple[str, int]]:
    out, seen = [], set()
    body = source[2 if end_tag else 1 : -1]
    start = re.match(r"[^\s/>]*", body).end()
    place = start
    while place < len(body):
        m = _ATTRIBUTES.match(body, place)
        if m is None or m.end() == place:
            break
        gap, key, value = m[1], m[2], m[3] or ""
        where = at + (2 if end_tag else 1) + m.start(2)
        if not gap:
            out.append(("missing-whitespace-between-attributes", where))
        elif "/" in gap and not gap.endswith("/>"):
            out.append(("unexpected-solidus-in-tag", where - 1))
        if key.startswith("="):
            out.append(("unexpected-equals-sign-before-attribute-name", where))
        if re.search("[\"'<]", key):
            out.append(("unexpected-character-in-attribute-name", where))
        if key.lower() in seen:
            out.append(("duplicate-attribute", where))
        seen.add(key.lower())
        inner = re.sub(r"^\s*=\s*", "", value)
        if value and not inner:
            out.append(("missing-attribute-value", where))
        elif inner and inner[0] not in "\"'" and re.search("[\"'<=`]", inner):
            out.append(("unexpected-character-in-unquoted-attribute-value", where))
        out += _references(inner, at + (2 if end_tag else 1) + m.end() - len(inner), True)
        place = m.end()
    if end_tag and seen:
        out.append(("end-tag-with-attributes", at))
    if end_tag and source.endswith("/>"):
        out.append(("end-tag-with-trailing-solidus", at))
    if not end_tag and source.endswith("/>") and name not in VOID:
        out.append(("non-void-html-element-start-tag-with-trailing-solidus", at))
    return out


def _comment_errors(source: str, at: int, text: str) -> list[tuple[str, int]]:
    if not source.startswith("<!"):
        if source.startswith("<?"):
            return [("unexpected-question-mark-instead-of-tag-name", at + 1)]
        return [("invalid-first-character-of-tag-name", at + 2)]
    if source.startswith("<![CDATA["):
        return [("cdata-in-html-content", at + 2)]
    if not source.startswith("<!--"):
        return [("incorrectly-opened-comment", at + 2)]
    out = []
    if re.fullmatch("<!---?>", source):
        return [("abrupt-closing-of-empty-comment", at + 4)]
    if not re.search(r"--!?>\Z", source):
        out.append(("eof-in-comment", len(text)))
    elif source.endswith("--!>"):
        out.append(("incorrectly-closed-comment", at + len(source) - 4))
    if "<!--" in source[4:-3]:
        out.append(("nested-comment", at + source.index("<!--", 4)))
    return out


def errors_of(text: str | None, fragment: bool = False) -> list[tuple[str, int, int, int]]:
    """Code, place, line and column of every error, in document order."""
    source = (text or "").removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    found: list[tuple[str, int]] = [("unexpected-null-character", m.start()) for m in re.finditer("\0", source)]
    found += [("control-character-in-input-stream", m.start()) for m in re.finditer("[\x01-\x08\x0b\x0e-\x1f\x7f-\x9f]", source)]
    found += [("noncharacter-in-input-stream", m.start()) for m in re.finditer("[﷐-﷯￾￿]", source)]
    tokens = Tokenizer(source)
    reached, doctype, first = 0, False, True
    for t in tokens:
        piece = source[t.at : tokens.at]
        if t.at > reached and source.startswith("</>", reached):
            found.append(("missing-end-tag-name", reached + 2))
        reached = tokens.at
        if t.kind in ("start", "end"):
            found += _tag_errors(piece, t.at, t.kind == "end", t.data)
            if t.kind == "start" and t.data in RAW:
                tokens.raw = t.data
        elif t.kind == "text":
            found += _references(piece, t.at, False)
            for m in re.finditer(r"<(?=[^A-Za-z!/?])|<\Z", piece):
                found.append(("eof-before-tag-name" if m.end() == len(piece) and tokens.at == len(source) else "invalid-first-character-of-tag-name", t.at + m.end()))
        elif t.kind == "comment":
            found += _comment_errors(piece, t.at, source)
        elif t.kind == "doctype":
            doctype = True
            if not t.data:
                found.append(("missing-doctype-name", t.at))
            elif not piece.endswith(">"):
                found.append(("eof-in-doctype", len(source)))
            elif t.data != "html" or t.public or t.system not in (None, "about:legacy-compat"):
                found.append(("unexpected-doctype", t.at))
            if not first:
                found.append(("misplaced-doctype", t.at))
        if not (t.kind == "comment" or t.kind == "text" and not t.data.strip()):
            first = False
    if reached < len(source) and re.match(r"</?[A-Za-z]", source[reached:]):
        found.append(("eof-in-tag", len(source)))
    builder = Builder(source, "body" if fragment else None)
    tree = builder.run()
    if not doctype and not fragment:
        found.append(("missing-doctype", 0))
    found += [("stray-end-tag", span[0]) for name, span in builder.stray if name not in ("br", "p")]
    optional = IMPLIED_END | frozenset("html head body tbody thead tfoot tr td th colgroup caption".split())
    found += [("unclosed-element", n.start[0]) for n in tree.elements() if n.start and n.end is None and n.ns == HTML and n.tag not in VOID and n.tag not in optional]
    lines = Lines(source)
    return [(code, at, *lines(at)) for code, at in sorted(set(found), key=lambda x: (x[1], x[0]))]


class ParseError(ValueError):
    """The first error of a page that is read strictly."""

    def __init__(self, code: str, line: int, col: int) -> None:
        super().__init__(f"{code} at line {line}, column {col}")
        self.code, self.line, self.col = code, line, col


def parse_strict(text: str | None) -> Node:
    """The tree of a page without errors; raises :class:`ParseError` for the first one."""
    for code, _, line, col in errors_of(text):
        raise ParseError(code, line, col)
    return Builder(text or "").run()


def parse_errors(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Every parse error of every page: ``seq, code, line, col``. A null page lacks a doctype, like an empty one."""

    def kernel(text: str | None) -> list[tuple]:
        return [(i, code, line, col) for i, (code, _, line, col) in enumerate(errors_of(text), 1)]

    return per_page(pages, kernel, "page_id bigint, seq int, code string, line int, col int", [pa.int32(), pa.string(), pa.int32(), pa.int32()], html, key=key)


def locations_of(text: str | None) -> list[tuple]:
    source = (text or "").removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    lines, out = Lines(source), []
    for i, n in enumerate(Builder(source).run().elements()):
        if n.start:
            stop = n.end[1] if n.end else None
            out.append((i, n.tag, *n.start, *(n.end or (None, None)), *lines(n.start[0]), *(lines(stop) if stop is not None else (None, None))))
    return out


def locations(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Where every element that the source wrote stands: spans of its tags, and lines and columns of its begin and end."""
    names = ("start", "start_end", "close", "close_end", "line", "col", "end_line", "end_col")
    schema = "page_id bigint, element_no int, tag string, " + ", ".join(f"{n} int" for n in names)
    return per_page(pages, locations_of, schema, [pa.int32(), pa.string(), *[pa.int32()] * len(names)], html, key=key)
