"""Pages to node rows, token rows and page facts: Arrow kernels that see one page at a time.

A page becomes its preorder interval encoding: ``pre`` numbers the nodes in document order and ``last`` is the number of the
last node below, so every structural relation is an equality on ``page_id`` and a comparison of numbers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.sources.tokens import Tokenizer
from pagemill.sources.tree import Builder, Node

NODES = (
    "page_id bigint, pre int, last int, parent int, depth int, ord int, el_idx int, el_count int, type_idx int, type_count int, "
    "node_type string, ns string, tag string, attrs map<string,string>, classes array<string>, data string, implied boolean"
)
TOKENS = "page_id bigint, seq int, kind string, name string, data string, attrs map<string,string>, self_closing boolean, start int"
_NODE_TYPES = [
    pa.int64(), *[pa.int32()] * 9, pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.string(), pa.bool_(),
]
#: Pages in one output batch.
PAGES = 64


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in re.split(r", (?![^<]*>)", schema)]


def node_rows(page: int | None, document: Node, filled: bool = False) -> list[tuple]:
    """The rows of one document; the content of a template lies below it. ``filled`` adds the column of that name."""
    rows: list[list] = []

    def kids(n: Node) -> list[Node]:
        return n.content.children if n.content is not None else n.children

    stack: list[tuple[Node, int, int, int, int, int, int, int]] = [(document, -1, 0, 0, 0, 0, 0, 0)]
    while stack:
        node, parent, depth, order, index, count, kind_index, kind_count = stack.pop()
        pre = len(rows)
        element = node.kind == "element"
        rows.append(
            [
                page, pre, pre, parent, depth, order, index if element else None, count if element else None, kind_index if element else None,
                kind_count if element else None, node.kind, node.ns if element else None, node.tag if node.kind != "text" and node.tag else None,
                list(node.attrs.items()), node.attrs.get("class", "").split() if element else [], node.data if node.kind in ("text", "comment") else None, node.implied,
            ]
        )
        children = kids(node)
        if filled:
            rows[-1].append(any(c.kind == "element" or c.kind == "text" and c.data != "" for c in children))
        elements = [c for c in children if c.kind == "element"]
        totals: dict[str, int] = {}
        for c in elements:
            totals[c.tag] = totals.get(c.tag, 0) + 1
        seen: dict[str, int] = {}
        place = 0
        below = []
        for i, c in enumerate(children):
            if c.kind == "element":
                place += 1
                seen[c.tag] = seen.get(c.tag, 0) + 1
                below.append((c, pre, depth + 1, i, place, len(elements), seen[c.tag], totals[c.tag]))
            else:
                below.append((c, pre, depth + 1, i, 0, 0, 0, 0))
        stack.extend(reversed(below))
    for row in reversed(rows):
        if row[3] >= 0:
            above = rows[row[3]]
            above[2] = max(above[2], row[2])
    return rows


def table_of(rows: list, types: list[pa.DataType], columns: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types, strict=True)], names=columns)


#: Columns that structural relations need; attributes and texts, most of a node table's size, are not among them.
STRUCTURE = ("page_id", "pre", "last", "parent", "depth", "ord", "el_idx", "el_count", "type_idx", "type_count", "node_type", "ns", "tag")
#: Column beyond those of a whole node table, for ``columns``: whether a node has an element or a text that is not empty right below it.
FILLED = "filled boolean"
#: Columns that selectors need of elements.
SELECTABLE = (*STRUCTURE, "attrs", "classes", "filled")


def parse_nodes(pages: DataFrame, key: str = "page_id", html: str = "html", columns: tuple[str, ...] | None = None, elements: bool = False) -> DataFrame:
    """Node rows of every page. A null page has the nodes of an empty document; text of any length is read whole.

    ``columns`` names the only columns wanted, ``elements`` leaves out all other nodes: the kernel makes no more than that, since a
    projection behind it could not save the work.
    """
    every = names(NODES)
    wanted = [[*every, "filled"].index(c) for c in columns or every]
    fields = [*re.split(r", (?![^<]*>)", NODES), FILLED]
    schema, types = ", ".join(fields[i] for i in wanted), [[*_NODE_TYPES, pa.bool_()][i] for i in wanted]
    filled = len(every) in wanted
    kind = every.index("node_type")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                rows = []
                for page, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = node_rows(page, Builder((text or "").removeprefix("﻿")).run(), filled)
                    rows += [r for r in found if r[kind] == "element"] if elements else found
                if columns is None:
                    yield table_of(rows, types, every)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in zip(wanted, types, strict=True)], names=list(columns))

    return pages.select(F.col(key).cast("bigint"), html).mapInArrow(run, schema)


def tokenize(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Token rows of every page, without building a tree; raw-text elements are recognised by name."""
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.bool_(), pa.int32()]
    raw = frozenset(("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "plaintext"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                rows = []
                for page, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    tokens = Tokenizer(text or "")
                    for seq, t in enumerate(tokens):
                        if t.kind == "start" and t.data in raw:
                            tokens.raw = t.data
                        tag = t.kind in ("start", "end", "doctype")
                        rows.append((page, seq, t.kind, t.data if tag else None, None if tag else t.data, list(t.attrs.items()), t.closing, t.at))
                yield table_of(rows, types, names(TOKENS))

    return pages.select(F.col(key).cast("bigint"), html).mapInArrow(run, TOKENS)


def per_page(pages: DataFrame, kernel: Callable, schema: str, types: list[pa.DataType], *columns: str, key: str = "page_id") -> DataFrame:
    """Rows that ``kernel(page values...)`` yields for each page, with the page's key first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                rows = []
                for page, *values in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    rows += [(page, *row) for row in kernel(*values)]
                yield table_of(rows, [pa.int64(), *types], names(schema))

    return pages.select(F.col(key).cast("bigint").alias("page_id"), *columns).mapInArrow(run, schema)


def text_of(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``page_id``, ``pre`` and ``text`` of each root: the text below it in document order; empty if there is none."""
    texts = nodes.filter("node_type = 'text'").select("page_id", F.col("pre").alias("at"), "data")
    spans = roots.select("page_id", "pre", "last")
    joined = spans.join(texts, (spans.page_id == texts.page_id) & texts["at"].between(spans.pre, spans.last), "left").select(
        spans.page_id, spans.pre, "at", "data"
    )
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "data")))), lambda p: p["data"])
    return joined.groupBy("page_id", "pre").agg(F.array_join(parts, "").alias("text"))


