"""Sizes of texts in tokens of a public byte-level BPE tokenizer.

The splitting pattern of the tokenizer takes a line end before a visible character as a piece of its own, so the number of
tokens of a text is the sum over its chunks cut before such line ends. Counts of chunks that occur again, which in
subtitles is most of the text, come from a table of bounded size; the sum is exact for every text.
"""

from __future__ import annotations

import base64
import importlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Folder with the tokenizer files; a parameter, the files are never copied.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks whose counts a worker keeps; beyond it the table starts afresh.
KEPT = 200_000

_CHUNK = re.compile(r"(?=\n\S)")
_SIGNS = re.compile(r"[\x00-\x1b\x20-\x40\x5b-\x60\x7b-\x7f]+")
_PIECE = re.compile(r" ?[0-9]+| ?[^\s0-9]+|\s+(?!\S)|\s+")
_FRAME = re.compile(r"\s*(?:﻿?\s*[0-9]+|[^\n]*-->[^\n]*|(?:WEBVTT|NOTE|STYLE|REGION)\b[^\n]*)\s*")
_LOADED: dict[str, object] = {}


def encoding(directory: str, name: str):
    """The tokenizer, loaded once per worker."""
    if (path := os.path.join(directory, name)) not in _LOADED:
        tiktoken = importlib.import_module("tiktoken")
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _LOADED[path] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


class Counter:
    """Token counts of texts and of their chunks."""

    def __init__(self, directory: str = TOKENIZER_DIR, name: str = TOKENIZER) -> None:
        self.encode = encoding(directory, name).encode_ordinary
        self.chunks: dict[str, tuple[int, bool]] = {}
        self.pieces: dict[str, int] = {}

    def piece(self, text: str) -> int:
        if (n := self.pieces.get(text)) is None:
            if len(self.pieces) >= KEPT:
                self.pieces.clear()
            n = self.pieces[text] = len(self.encode(text))
        return n

    def chunk(self, text: str) -> tuple[int, bool]:
        """Tokens of a chunk, and whether they bear loss: numbers and times of cues do not."""
        if (known := self.chunks.get(text)) is not None:
            return known
        frame = bool(_FRAME.fullmatch(text))
        if _SIGNS.fullmatch(text):  # no letters: its pieces are few and small, and repeat
            n = sum(map(self.piece, _PIECE.findall(text)))
        else:
            n = len(self.encode(text))
        if not frame or len(text) < 12:
            if len(self.chunks) >= KEPT:
                self.chunks.clear()
            self.chunks[text] = (n, not frame)
        return n, not frame

    def sizes(self, text: str) -> tuple[list[int], list[bool]]:
        found = [self.chunk(c) for c in _CHUNK.split(text) if c]
        return [n for n, _ in found], [loss for _, loss in found]

    def count(self, text: str) -> int:
        return sum(self.chunk(c)[0] for c in _CHUNK.split(text) if c)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", *keep: str) -> DataFrame:
    """``key``, the columns ``keep`` and ``tokens`` of every row; null and empty texts have 0 tokens."""
    fields = [df.schema[c] for c in (key, *keep)]
    out = T.StructType([*fields, T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            sizes = [counter.count(t) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=out.names)

    return df.select(key, *keep, text).mapInArrow(run, out)


def pieces_of(sizes: list[int], loss: list[bool], capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """Piece number, first token, tokens and loss-bearing tokens of a text cut every ``capacity`` tokens."""
    ends = np.cumsum(sizes)
    bearing = np.concatenate([[0], np.cumsum(np.where(loss, sizes, 0))])
    total = int(ends[-1]) if len(ends) else 0
    cuts = np.append(np.arange(0, total, capacity), total)
    chunk = np.searchsorted(ends, cuts, side="right")
    start = np.concatenate([[0], ends])
    flags = np.append(np.asarray(loss, dtype=bool), False)
    upto = bearing[chunk] + np.where(flags[chunk], cuts - start[chunk], 0)
    for i in range(len(cuts) - 1):
        yield i, int(cuts[i]), int(cuts[i + 1] - cuts[i]), int(upto[i + 1] - upto[i])
