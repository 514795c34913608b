"""Pages that come in pieces: tokens and trees as far as they are certain after each piece.

A piece is read together with what was left of the ones before. A token counts once something follows it, or the text is over, since
more text could change it; so a text is held back as long as it may go on, and a tag until it is closed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pagemill.sources.tokens import Token, Tokenizer
from pagemill.sources.tree import HTML, Builder, Node


class StreamingTokenizer:
    """Tokens of a text that is fed in pieces; ``position`` is how much of it they cover."""

    def __init__(self, handler: Callable[[Token], None] | None = None, raw_elements: frozenset[str] = frozenset(("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "plaintext"))) -> None:
        self.handler, self.raw_elements = handler, raw_elements
        self.reset()

    def reset(self) -> None:
        self.rest, self.position, self.raw, self.foreign, self.closed = "", 0, "", False, False
        self.inside = ""  # raw element whose text is being read

    def __enter__(self) -> StreamingTokenizer:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def feed(self, text: str) -> list[Token]:
        if self.closed:
            raise ValueError("the tokenizer is closed")
        self.rest += text
        return list(self._tokens(False))

    def close(self) -> list[Token]:
        if self.closed:
            return []
        self.closed = True
        return list(self._tokens(True))

    def _tokens(self, last: bool) -> Iterator[Token]:
        text, tail = self.rest, ""
        if not last and text.endswith("\r"):  # half a line end, perhaps
            text, tail = text[:-1], "\r"
        tokens = Tokenizer(text)
        text = tokens.text
        done = 0
        tokens.raw, tokens.foreign = self.raw, self.foreign
        for t in tokens:
            end = tokens.at
            if not last and end >= len(text):
                break
            t.at += self.position
            if t.kind == "start" and t.data in self.raw_elements:
                tokens.raw = t.data
            done, self.raw, self.foreign = end, tokens.raw, tokens.foreign
            yield t
            if self.handler is not None:
                self.handler(t)
            tokens.raw, tokens.foreign = self.raw or tokens.raw, self.foreign
            self.raw = tokens.raw
        self.rest = text[done:] + tail
        self.position += done
        if last:
            self.rest = ""


class PushParser:
    """The tree of a page that is fed in pieces: built as the pieces come, whole after ``close``."""

    def __init__(self) -> None:
        self.builder = Builder("")
        self.tokens = StreamingTokenizer(raw_elements=frozenset())
        self.first = True

    def __enter__(self) -> PushParser:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    @property
    def document(self) -> Node:
        """The tree so far."""
        return self.builder.document

    def _take(self, last: bool) -> None:
        builder, tokens = self.builder, self.tokens
        for t in tokens._tokens(last):
            builder.tokens.raw = ""
            builder.span = (t.at, tokens.position)
            if t.kind == "end":
                builder.end_tag(t)
            else:
                builder.handle(t)
            tokens.raw = builder.tokens.raw
            tokens.foreign = bool(builder.open) and builder.current().ns != HTML

    def feed(self, text: str) -> None:
        if self.first and text:
            text, self.first = text.removeprefix("﻿"), False
        self.tokens.rest += text
        self._take(False)

    def close(self) -> Node:
        if not self.tokens.closed:
            self.tokens.closed = True
            self._take(True)
            self.builder.handle(Token("eof", at=self.tokens.position))
        return self.builder.document
