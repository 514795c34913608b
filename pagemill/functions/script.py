"""Shorter scripts that do the same: comments and blanks out, constants folded, local names shortened.

A script is read as tokens, not as a tree, so whatever is not certain stays as it is: a line end goes only where no statement can
end, and a name is shortened only where every place it stands in is understood.
"""

from __future__ import annotations

import itertools
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

_TOKEN = re.compile(
    r"(?P<space>[ \t\v\f ﻿]+)|(?P<line>(?:\r\n?|\n| | ))|(?P<comment>//[^\n\r  ]*|/\*.*?\*/|<!--[^\n]*)|(?P<name>[#@]?(?:[^\W\d]|\$|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})(?:\w|\$|‌|‍|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})*)"
    r"|(?P<number>0[xX][0-9A-Fa-f_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)|(?P<string>\"(?:[^\"\\\n\r]|\\(?:\r\n|.|\n))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|.|\n))*')"
    r"|(?P<sign>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.#@])",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\.|\[(?:[^\]\\\n\r]|\\.)*\])+/[A-Za-z]*")
# Words of the language; words after which an operand comes; words after which a line end ends the statement.
RESERVED = frozenset(
    "await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof let new null of return static super switch this throw true try typeof var void while with yield async get set arguments eval undefined NaN Infinity".split()
)
_BEFORE_OPERAND = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())
_RESTRICTED = frozenset("return break continue throw yield async".split())


class ScriptError(ValueError):
    """A text or comment that is not closed, or a sign that no script has."""


@dataclass
class Token:
    kind: str  # name, number, string, template, regex, sign
    text: str
    line: bool  # a line end stands before it


def tokens_of(script: str) -> list[Token]:
    out: list[Token] = []
    at, line = 0, False
    if script.startswith("#!"):
        at = len(script.split("\n", 1)[0])
    while at < len(script):
        if script[at] == "`":
            end = _template_end(script, at)
            out.append(Token("template", script[at:end], line))
            at, line = end, False
            continue
        if script[at] == "/" and not script.startswith(("//", "/*"), at) and _operand_next(out):
            m = _REGEX.match(script, at)
            if m is None:
                raise ScriptError(f"a pattern is not closed at {at}")
            out.append(Token("regex", m[0], line))
            at, line = m.end(), False
            continue
        m = _TOKEN.match(script, at)
        if m is None or m[0] == "/" and script.startswith("/*", at):
            raise ScriptError(f"unexpected {script[at]!r} at {at}")
        kind = m.lastgroup
        if kind == "line" or kind == "comment" and re.search("[\n\r  ]", m[0]):
            line = True
        elif kind not in ("space", "comment"):
            out.append(Token(kind, m[0], line))
            line = False
        elif kind == "comment" and m[0].startswith("/*!"):  # a notice that is to stay
            out.append(Token("notice", m[0], line))
        at = m.end()
    return out


def _template_end(script: str, at: int) -> int:
    depth, i = 0, at + 1
    while i < len(script):
        c = script[i]
        if c == "\\":
            i += 2
            continue
        if depth == 0 and c == "`":
            return i + 1
        if depth == 0 and script.startswith("${", i):
            depth, i = 1, i + 2
            continue
        if depth:
            if c == "`":
                i = _template_end(script, i)
                continue
            if c in "\"'":
                m = _TOKEN.match(script, i)
                i = m.end() if m else i + 1
                continue
            depth += (c == "{") - (c == "}")
        i += 1
    raise ScriptError(f"a template is not closed at {at}")


def _operand_next(before: list[Token]) -> bool:
    """Whether an operand, not an operator, comes next."""
    last = next((t for t in reversed(before) if t.kind != "notice"), None)
    if last is None:
        return True
    if last.kind == "name":
        return last.text in _BEFORE_OPERAND
    return last.kind == "sign" and last.text not in (")", "]", "}", "++", "--")


@dataclass(frozen=True)
class JSMinify:
    """``mangle`` shortens the names of functions' own variables; ``fold`` writes constants shorter."""

    mangle: bool = True
    fold: bool = True


def _folded(tokens: list[Token]) -> list[Token]:
    out: list[Token] = []
    for i, t in enumerate(tokens):
        before, after = (tokens[i - 1].text if i else ""), (tokens[i + 1].text if i + 1 < len(tokens) else "")
        text = t.text
        plain = before not in (".", "?.") and after != ":" and not (before in ("{", ",") and after in (",", "}", "(", "=")) and after != "=" and before not in ("function", "class", "get", "set", "static", "async", "*")
        if t.kind == "name" and plain and text in ("true", "false") and after != ".":
            text = "!0" if text == "true" else "!1"
        elif t.kind == "number" and re.fullmatch(r"[\d_]*\.?[\d_]+", text.replace("_", "_")) and not text.endswith("n"):
            digits = text.replace("_", "")
            if not re.fullmatch(r"0\d+", digits):
                whole, point, fraction = digits.partition(".")
                fraction = fraction.rstrip("0")
                digits = (whole.lstrip("0") or ("" if fraction else "0")) + ("." + fraction if fraction else "")
                if m := re.fullmatch(r"([1-9]\d*?)(0{3,})", digits):
                    digits = f"{m[1]}e{len(m[2])}"
                text = digits if after != "." or "e" in digits else t.text
        if t.kind == "string" and len(out) > 1 and out[-1].text == "+" and out[-2].kind == "string" and out[-2].text[0] == text[0] and (len(out) < 3 or out[-3].text in ("=", "(", ",", "[", ":", "return", "?", "{", ";", "+=")) and after not in (".", "[", "*", "/", "%", "`", "("):
            out.pop()
            out[-1] = Token("string", out[-1].text[:-1] + text[1:], out[-1].line)
            continue
        out.append(Token(t.kind if not text.startswith("!") or t.kind != "name" else "folded", text, t.line))
    return out


def _matching(tokens: list[Token]) -> dict[int, int]:
    """Places of closing brackets by those of opening ones."""
    pairs, stack = {}, []
    for i, t in enumerate(tokens):
        if t.kind == "sign" and t.text in "([{":
            stack.append(i)
        elif t.kind == "sign" and t.text in ")]}" and stack:
            pairs[stack.pop()] = i
    return pairs


def _holds_pairs(tokens: list[Token], at: int) -> bool:
    """Whether a bracket opens an object or a pattern of one rather than a block."""
    if at < 0 or tokens[at].text != "{":
        return False
    before = tokens[at - 1].text if at else ";"
    return before not in (")", ";", "{", "}", "=>", "else", "do", "try", "finally")


def _short_names(used: set[str]) -> Iterator[str]:
    letters = string.ascii_letters
    for size in itertools.count(1):
        for first in letters:
            for rest in itertools.product(letters + string.digits, repeat=size - 1):
                name = first + "".join(rest)
                if name not in used and name not in RESERVED:
                    yield name


def _mangled(tokens: list[Token]) -> list[Token]:
    words = [t.text for t in tokens if t.kind == "name"]
    if {"eval", "with"} & set(words) or any(a == "new" and b == "Function" for a, b in itertools.pairwise(words)):
        return tokens
    pairs = _matching(tokens)
    closing = {b: a for a, b in pairs.items()}
    opener: list[int] = []
    around: list[int] = []  # place of the bracket around each token
    for i, t in enumerate(tokens):
        if i in closing and opener:
            opener.pop()
        around.append(opener[-1] if opener else -1)
        if i in pairs:
            opener.append(i)
    templates = " ".join(t.text for t in tokens if t.kind == "template")
    names = _short_names(set(words))
    renamed: dict[int, str] = {}
    functions = []
    for i, t in enumerate(tokens):
        if t.kind == "name" and t.text == "function" and (i == 0 or tokens[i - 1].text not in (".", "?.")):
            at = i + 1
            while at < len(tokens) and tokens[at].text != "(":
                at += 1
            if at in pairs and pairs[at] + 1 in pairs and tokens[pairs[at] + 1].text == "{" and at - i <= 3:
                functions.append((at, pairs[at], pairs[at] + 1, pairs[pairs[at] + 1]))
    for start, params_end, body, end in sorted(functions, key=lambda f: f[0]):
        own: set[str] = set()
        params = tokens[start + 1 : params_end]
        if all(t.kind == "name" or t.text == "," for t in params):
            own |= {t.text for t in params if t.kind == "name"}
        inner = [(a, d) for a, _, _, d in functions if a > body and d < end]
        for i in range(body + 1, end):
            if tokens[i].text in ("var", "let", "const") and tokens[i].kind == "name" and not any(a <= i <= d for a, d in inner):
                if tokens[i + 1].kind == "name" and tokens[i + 1].text not in RESERVED:
                    own.add(tokens[i + 1].text)
                    at, depth = i + 2, 0
                    while at < end and (depth or tokens[at].text not in (";", "in", "of")) and not (depth == 0 and tokens[at].line and tokens[at].kind == "name"):
                        depth += (tokens[at].text in "([{" and tokens[at].kind == "sign") - (tokens[at].text in ")]}" and tokens[at].kind == "sign")
                        if depth < 0:
                            break
                        if depth == 0 and tokens[at].text == "," and tokens[at + 1].kind == "name":
                            own.add(tokens[at + 1].text)
                        at += 1
        for name in sorted(own):
            if len(name) < 2 or name in RESERVED or re.search(rf"(?<![\w$]){re.escape(name)}(?![\w$])", templates):
                continue
            places, certain = [], True
            for i in range(start, end + 1):
                if tokens[i].kind != "name" or tokens[i].text != name:
                    continue
                before, after = tokens[i - 1].text, tokens[i + 1].text
                if before in (".", "?."):
                    continue
                shorthand = before in ("{", ",") and after in ("}", ",", "=", "(") and _holds_pairs(tokens, around[i])
                if after == ":" or shorthand or before in ("get", "set", "static", "async", "class", "function", "break", "continue") or i in renamed:
                    certain = False
                    break
                places.append(i)
            # A name that is declared again inside, or used outside before it is declared, is renamed alike everywhere in its function.
            if certain and places:
                short = next(names)
                renamed |= dict.fromkeys(places, short)
    return [Token(t.kind, renamed.get(i, t.text), t.line) for i, t in enumerate(tokens)]


def minify_js(script: str, options: JSMinify = JSMinify()) -> str:
    """The script without what it does not need."""
    tokens = tokens_of(script)
    if options.mangle:
        tokens = _mangled(tokens)
    if options.fold:
        tokens = _folded(tokens)
    out: list[str] = []
    last: Token | None = None
    for i, t in enumerate(tokens):
        if t.kind == "notice":
            out.append(("\n" if out else "") + t.text + "\n")
            last = None
            continue
        if last is not None:
            wordy = lambda x: x.kind in ("name", "number", "regex")
            a, b = last.text[-1], t.text[0]
            needs = t.line and _line_ends(last, t)
            if needs:
                out.append("\n")
            elif (wordy(last) and (re.match(r"[\w$\\#@]", b) is not None)) or a in "+-" and b == a and t.kind in ("sign", "number") or a == "/" and b in "/*" or last.kind == "number" and b == "." and re.fullmatch(r"\d+", last.text) or a == "<" and b == "!" or last.text == "--" and b == ">":
                out.append(" ")
        if t.text == "}" and out and out[-1] == ";" and not _loop_head(tokens, i):
            out.pop()  # the last one of a block
        out.append(t.text)
        last = t
    text = "".join(out).strip("\n")
    return text[:-1] if text.endswith(";") and not _loop_head(tokens, len(tokens)) else text


def _loop_head(tokens: list[Token], end: int) -> bool:
    """Whether the semicolon before ``end`` is the empty body of a loop or condition, and must stay."""
    before = [t for t in tokens[:end] if t.kind != "notice"]
    if len(before) < 2 or before[-1].text != ";":
        return False
    if before[-2].text != ")":
        return before[-2].text in ("else", "do")
    depth = 0
    for i in range(len(before) - 2, -1, -1):
        depth += (before[i].text == ")") - (before[i].text == "(")
        if not depth:
            return i > 0 and before[i - 1].text in ("while", "for", "if", "with", "await")
    return False


def _line_ends(a: Token, b: Token) -> bool:
    """Whether a line end between two tokens may end a statement."""
    if a.kind == "name" and a.text in _RESTRICTED:
        return True
    if a.kind == "sign" and a.text not in (")", "]", "}", "++", "--"):
        return False
    if b.kind == "sign":
        return b.text in ("++", "--", "{", "!", "~", "@", "#") and not (b.text == "{" and a.text == ")")
    if b.kind == "template":
        return False
    return not (b.kind == "name" and b.text in ("in", "instanceof", "of")) and not (a.kind == "name" and a.text in _BEFORE_OPERAND | {"var", "let", "const", "function", "class", "extends", "import", "export"})
