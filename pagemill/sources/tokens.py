"""HTML tokens of a page, by the WHATWG rules, as a generator over the page's text.

Runs of characters are found by pattern search rather than one state per character; the states of the standard remain as the
places where the search starts: data, RCDATA, RAWTEXT, script data with its escapes, PLAINTEXT, tags, comments, doctypes.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from html.entities import html5

# Characters that HTML takes as white space.
WHITE = "\t\n\f\r "
_NAME = re.compile(r"[^\t\n\f\r />]*")
_BLANK = re.compile(r"[\t\n\f\r ]*")
_ATTRIBUTE = re.compile(r"[\t\n\f\r /]*([^\t\n\f\r />][^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:\"([^\"]*)(\"|\Z)|'([^']*)('|\Z)|([^\t\n\f\r >]*)))?")
_REFERENCE = re.compile(r"&(#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;?)")
_COMMENT_END = re.compile(r"--!?>|--!?\Z|-\Z")
_DOCTYPE = re.compile(
    r"[\t\n\f\r ]*([^\t\n\f\r >]*)[\t\n\f\r ]*(?:(?i:(public))[\t\n\f\r ]*(?:\"([^\">]*)\"?|'([^'>]*)'?)?"
    r"[\t\n\f\r ]*(?:\"([^\">]*)\"?|'([^'>]*)'?)?|(?i:(system))[\t\n\f\r ]*(?:\"([^\">]*)\"?|'([^'>]*)'?)?)?[^>]*>?"
)
_SCRIPT = re.compile(r"<!--|-->|<(/?)script(?=[\t\n\f\r />])", re.I)
# Elements whose content is text of its own kind.
RCDATA = frozenset(("title", "textarea"))
RAWTEXT = frozenset(("style", "xmp", "iframe", "noembed", "noframes"))


@dataclass(slots=True)
class Token:
    """``kind`` is start, end, text, comment, doctype or pi; ``at`` is where it begins in the page."""

    kind: str
    data: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    closing: bool = False
    at: int = 0
    public: str | None = None
    system: str | None = None
    quirks: bool = False


def unescape(text: str) -> str:
    """Character references of text resolved."""
    return html.unescape(text) if "&" in text else text


def unescape_attribute(value: str) -> str:
    """Character references of an attribute: a name without semicolon stays if a letter, digit or ``=`` follows."""
    if "&" not in value:
        return value

    def one(m: re.Match) -> str:
        body = m[1]
        if body[0] == "#" or body.endswith(";") and body in html5:
            return html.unescape(m[0])
        for cut in range(len(body), 1, -1):
            if body[:cut] in html5:
                following = body[cut : cut + 1] or value[m.end() : m.end() + 1]
                return m[0] if following and (following == "=" or following.isalnum()) else html5[body[:cut]] + body[cut:]
        return m[0]

    return _REFERENCE.sub(one, value)


_BARE = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)>")


class Tokenizer:
    """Iterates over the tokens of ``text``; the tree builder sets ``raw`` and ``foreign`` between tokens."""

    def __init__(self, text: str) -> None:
        self.text = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
        self.at = 0
        self.raw = ""  # name of the raw-text element whose content comes next
        self.foreign = False  # whether the adjusted current node is foreign: CDATA is read

    def __iter__(self):
        text, size = self.text, len(self.text)
        while self.at < size:
            if self.raw:
                yield from self._raw_text()
                continue
            begin = self.at
            if m := _BARE.match(text, begin):  # most tags have no attributes
                self.at = m.end()
                yield Token("end" if m[1] else "start", m[2].lower(), {}, at=begin)
                continue
            lt = text.find("<", begin)
            while lt >= 0 and not self._opens(lt):
                lt = text.find("<", lt + 1)
            if lt < 0:
                lt = size
            if lt > begin:
                self.at = lt
                yield Token("text", unescape(text[begin:lt]), at=begin)
                continue
            token = self._markup(begin)
            if token is not None:
                yield token

    def _opens(self, lt: int) -> bool:
        following = self.text[lt + 1 : lt + 2]
        return following in ("!", "?") or following.isascii() and following.isalpha() or following == "/" and lt + 2 < len(self.text)

    def _markup(self, begin: int) -> Token | None:
        text = self.text
        sign = text[begin + 1]
        if sign == "!":
            return self._declaration(begin)
        if sign == "?":
            return self._bogus(begin, begin + 1)
        end = sign == "/"
        start = begin + 1 + end
        first = text[start : start + 1]
        if not (first.isascii() and first.isalpha()):
            if first == ">":
                self.at = start + 1
                return None
            return self._bogus(begin, start)
        m = _NAME.match(text, start)
        name, at = m[0].lower(), m.end()
        attrs: dict[str, str] = {}
        closing = False
        while True:
            m = _ATTRIBUTE.match(text, at)
            if m is None:
                at = _BLANK.match(text, at).end()
                while text[at : at + 1] == "/":
                    closing = text[at + 1 : at + 2] == ">"
                    at = _BLANK.match(text, at + 1).end()
                break
            at = m.end()
            key = m[1].lower()
            if m[2] is not None and not m[3] or m[4] is not None and not m[5]:
                self.at = len(text)  # the page ends inside the tag
                return None
            value = m[2] if m[2] is not None else m[4] if m[4] is not None else m[6] or ""
            if key not in attrs:
                attrs[key] = unescape_attribute(value)
        if text[at : at + 1] != ">":
            self.at = len(text)
            return None
        self.at = at + 1
        return Token("end" if end else "start", name.replace("\0", "�"), {} if end else attrs, closing, begin)

    def _bogus(self, begin: int, start: int) -> Token:
        end = self.text.find(">", start)
        self.at = len(self.text) if end < 0 else end + 1
        data = self.text[start : len(self.text) if end < 0 else end]
        return Token("comment", data.replace("\0", "�"), at=begin)

    def _declaration(self, begin: int) -> Token:
        text = self.text
        if text.startswith("--", begin + 2):
            start = begin + 4
            if m := re.compile("-?>").match(text, start):
                self.at = m.end()
                return Token("comment", "", at=begin)
            m = _COMMENT_END.search(text, start)
            self.at = m.end() if m else len(text)
            return Token("comment", text[start : m.start() if m else len(text)].replace("\0", "�"), at=begin)
        if text[begin + 2 : begin + 9].lower() == "doctype":
            m = _DOCTYPE.match(text, begin + 9)
            self.at = m.end()
            pick = lambda *g: next((m[i] for i in g if m[i] is not None), None)
            public, system = pick(3, 4), pick(5, 6, 8, 9)
            broken = not m[1] or (m[2] and public is None) or (m[7] and system is None) or not m[0].endswith(">")
            return Token("doctype", m[1].lower(), at=begin, public=public, system=system, quirks=bool(broken))
        if self.foreign and text.startswith("[CDATA[", begin + 2):
            end = text.find("]]>", begin + 9)
            self.at = len(text) if end < 0 else end + 3
            return Token("text", text[begin + 9 : len(text) if end < 0 else end], at=begin)
        return self._bogus(begin, begin + 2)

    def _raw_text(self):
        text, name, begin = self.text, self.raw, self.at
        self.raw = ""
        if name == "plaintext":
            self.at = len(text)
            yield Token("text", text[begin:].replace("\0", "�"), at=begin)
            return
        close = self._script_end(begin) if name == "script" else None
        if close is None:
            m = re.compile(rf"</{re.escape(name)}(?=[\t\n\f\r />])", re.I).search(text, begin) if name != "script" else None
            close = m.start() if m else len(text)
        self.at = close
        if close > begin:
            data = text[begin:close].replace("\0", "�")
            yield Token("text", unescape(data) if name in RCDATA else data, at=begin)

    def _script_end(self, begin: int) -> int:
        """Where a script ends: ``</script`` counts unless a comment has opened and a script inside it."""
        escaped = double = False
        at = begin
        while m := _SCRIPT.search(self.text, at):
            at = m.end()
            if m[0] == "<!--":
                escaped = True
                at = m.start() + 2  # its dashes may close it: <!-->
            elif m[0] == "-->":
                escaped = double = False
            elif m[1]:
                if not double:
                    return m.start()
                double = False
            elif escaped:
                double = True
        return len(self.text)
