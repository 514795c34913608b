"""Reading pages by events: a parser whose methods are called for tags and texts as they stand, and one for the events of the tree."""

from __future__ import annotations

import re
from html import unescape

from pagemill.sources.errors import Lines
from pagemill.sources.push import StreamingTokenizer
from pagemill.sources.tokens import Token
from pagemill.sources.tree import Node, parse


class HTMLParser:
    """Calls ``handle_...`` for what is fed, without building a tree. Override what is wanted.

    With ``convert_charrefs`` false, references are handed on as such instead of what they stand for.
    """

    def __init__(self, convert_charrefs: bool = True) -> None:
        self.convert_charrefs = convert_charrefs
        self.reset()

    def reset(self) -> None:
        self.tokens = StreamingTokenizer()
        self.source = ""
        self.place = 0

    def feed(self, text: str) -> None:
        self.source += text.replace("\r\n", "\n").replace("\r", "\n")
        for t in self.tokens.feed(text):
            self._handle(t)

    def close(self) -> None:
        for t in self.tokens.close():
            self._handle(t)

    def getpos(self) -> tuple[int, int]:
        """Line, from 1, and offset in it, from 0, of what is being handled."""
        line, column = Lines(self.source)(self.place)
        return line, column - 1

    def _handle(self, t: Token) -> None:
        self.place = t.at
        if t.kind == "start":
            (self.handle_startendtag if t.closing else self.handle_starttag)(t.data, list(t.attrs.items()))
        elif t.kind == "end":
            self.handle_endtag(t.data)
        elif t.kind == "text":
            self._text(t)
        elif t.kind == "doctype":
            self.handle_decl(f"doctype {t.data}".strip())
        elif self.source.startswith("<?", t.at):
            self.handle_pi(t.data[1:] if t.data.startswith("?") else t.data)
        elif self.source.startswith("<![", t.at):
            self.unknown_decl(t.data.strip("[]"))
        else:
            self.handle_comment(t.data)

    def _text(self, t: Token) -> None:
        if self.convert_charrefs:
            self.handle_data(t.data)
            return
        end = self.source.find("<", t.at + 1)
        raw = self.source[t.at : end if end >= 0 else len(self.source)]
        if unescape(raw) != t.data:  # text of a script or a held-back one: as it is
            self.handle_data(t.data)
            return
        for part in re.split(r"(&#?[0-9A-Za-z]+;?)", raw):
            if m := re.fullmatch(r"&(#?)([0-9A-Za-z]+);?", part):
                (self.handle_charref if m[1] else self.handle_entityref)(m[2])
            elif part:
                self.handle_data(part)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str]]) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str]]) -> None: ...
    def handle_endtag(self, tag: str) -> None: ...
    def handle_data(self, data: str) -> None: ...
    def handle_comment(self, data: str) -> None: ...
    def handle_decl(self, decl: str) -> None: ...
    def handle_pi(self, data: str) -> None: ...
    def handle_entityref(self, name: str) -> None: ...
    def handle_charref(self, name: str) -> None: ...
    def unknown_decl(self, data: str) -> None: ...


class SaxHandler:
    """What ``sax_parse`` calls, in document order of the tree. Override what is wanted."""

    def start_element(self, tag: str, attrs: dict[str, str]) -> None: ...
    def end_element(self, tag: str) -> None: ...
    def characters(self, data: str) -> None: ...
    def comment(self, data: str) -> None: ...
    def doctype(self, name: str) -> None: ...
    def processing_instruction(self, target: str, data: str) -> None: ...


def sax_parse(text: str | None, handler: SaxHandler) -> None:
    """Events of the tree of a page: elements that the parser adds are among them."""
    stack: list[Node | str] = [parse(text)]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            handler.end_element(n)
        elif n.kind == "element":
            handler.start_element(n.tag, dict(n.attrs))
            stack.append(n.tag)
            stack.extend(reversed((n.content or n).children))
        elif n.kind == "text":
            handler.characters(n.data)
        elif n.kind == "comment":
            handler.comment(n.data)
        elif n.kind == "doctype":
            handler.doctype(n.tag)
        elif n.kind == "processing-instruction":
            handler.processing_instruction(n.tag, n.data)
        else:
            stack.extend(reversed(n.children))
