"""XML documents to the same trees: names keep their letter case, errors end the document."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import urljoin
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.sources.nodes import per_page
from pagemill.sources.tree import Node


class XMLError(ValueError):
    """The document is not well formed."""


def parse_xml(text: str | None) -> Node:
    """The tree of an XML document; prefixes stay in the names. External entities are not read."""
    document = Node("document")
    stack = [document]
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)

    def start(tag: str, attrs: dict[str, str]) -> None:
        node = Node("element", tag, "xml", dict(attrs))
        stack[-1].append(node)
        stack.append(node)

    def data(value: str) -> None:
        if len(stack) > 1:
            stack[-1].append(Node("text", data=value))

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda tag: stack.pop() and None
    parser.CharacterDataHandler = data
    parser.CommentHandler = lambda value: stack[-1].append(Node("comment", data=value))
    parser.ProcessingInstructionHandler = lambda target, value: stack[-1].append(Node("processing-instruction", target, data=value))
    try:
        parser.Parse((text or "").removeprefix("﻿").encode(), True)
    except expat.ExpatError as error:
        raise XMLError(str(error)) from None
    return document


@dataclass(frozen=True)
class Canonical:
    """Which canonical form: version 1.0 or 1.1, with or without comments; or the exclusive one, which declares only the
    namespaces that an element uses, and those of ``inclusive_ns_prefixes``."""

    version: str = "1.0"
    exclusive: bool = False
    with_comments: bool = False
    inclusive_ns_prefixes: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.exclusive and self.version != "1.0":
            raise ValueError("exclusive canonical form builds on version 1.0")
        if self.inclusive_ns_prefixes and not self.exclusive:
            raise ValueError("inclusive prefixes are for the exclusive form")


def _declared(node: Node) -> dict[str, str]:
    return {k[6:]: v for k, v in node.attrs.items() if k == "xmlns" or k.startswith("xmlns:")}


def _above(node: Node) -> list[Node]:
    out = []
    while (node := node.parent) is not None:
        out.append(node)
    return out


def canonicalize(node: Node, options: Canonical = Canonical()) -> str:
    """The canonical form of a document or of the part below a node, as signatures use it."""
    o = options
    text = lambda v: v.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#xD;")
    value = lambda v: v.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;").replace("\t", "&#x9;").replace("\n", "&#xA;").replace("\r", "&#xD;")

    def inherited(n: Node) -> dict[str, str]:
        """Attributes of ``xml:`` that the apex takes from what is left out above it."""
        found: dict[str, str] = {}
        for a in _above(n):
            for k, v in a.attrs.items():
                if k.startswith("xml:") and k not in found and not (o.version == "1.1" and k == "xml:id"):
                    found[k] = v
        if o.version == "1.1" and "xml:base" in found:  # the bases above are put together
            base = ""
            for a in reversed(_above(n)):
                base = urljoin(base, a.attrs.get("xml:base", ""))
            found["xml:base"] = urljoin(base, n.attrs["xml:base"]) if "xml:base" in n.attrs else base
            return {k: v for k, v in found.items() if k not in n.attrs or k == "xml:base"}
        return {k: v for k, v in found.items() if k not in n.attrs}

    def element(n: Node, rendered: dict[str, str], scope: dict[str, str], apex: bool) -> str:
        scope = scope | _declared(n)
        attrs = {k: v for k, v in n.attrs.items() if k != "xmlns" and not k.startswith("xmlns:")}
        if apex and not o.exclusive:
            attrs |= inherited(n)
        if o.exclusive:
            used = {n.tag.rpartition(":")[0], *(k.rpartition(":")[0] for k in attrs if ":" in k)} | {p.replace("#default", "") for p in o.inclusive_ns_prefixes}
            wanted = {p: scope.get(p, "") for p in used if p != "xml"}
        else:
            wanted = scope
        new = {p: u for p, u in wanted.items() if rendered.get(p, "") != u and (u or not p)}
        rendered = rendered | wanted
        spaces = "".join(f' xmlns{":" if p else ""}{p}="{value(u)}"' for p, u in sorted(new.items()))

        def order(item: tuple[str, str]) -> tuple[str, str]:
            prefix, _, local = item[0].rpartition(":")
            return ("http://www.w3.org/XML/1998/namespace" if prefix == "xml" else scope.get(prefix, "") if prefix else "", local)

        written = "".join(f' {k}="{value(v)}"' for k, v in sorted(attrs.items(), key=order))
        inner = "".join(one(c, rendered, scope) for c in n.children)
        return f"<{n.tag}{spaces}{written}>{inner}</{n.tag}>"

    def one(n: Node, rendered: dict[str, str], scope: dict[str, str], apex: bool = False) -> str:
        if n.kind == "text":
            return text(n.data)
        if n.kind == "comment":
            return f"<!--{n.data}-->" if o.with_comments else ""
        if n.kind == "processing-instruction":
            return f"<?{n.tag}{' ' + n.data if n.data else ''}?>"
        return element(n, rendered, scope, apex) if n.kind == "element" else ""

    if node.kind == "document":
        return "\n".join(x for x in (one(c, {}, {}) for c in node.children) if x)
    scope: dict[str, str] = {}
    for a in reversed(_above(node)):
        scope |= _declared(a)
    return one(node, {}, scope, True)


def canonical(node: Node, comments: bool = False) -> str:
    """Canonical form 1.0 of an XML tree: sorted attributes, namespace declarations first, no empty-element tags."""
    return canonicalize(node, Canonical(with_comments=comments))


def canonical_xml(documents: DataFrame, options: Canonical = Canonical(), xml: str = "xml", key: str = "page_id") -> DataFrame:
    """``canonical`` form of every XML document, or its ``error``; null is an error like an empty document."""

    def kernel(value: str | None) -> list[tuple]:
        try:
            return [(canonicalize(parse_xml(value), options), None)]
        except XMLError as error:
            return [(None, str(error))]

    return per_page(documents, kernel, "page_id bigint, canonical string, error string", [pa.string(), pa.string()], xml, key=key)
