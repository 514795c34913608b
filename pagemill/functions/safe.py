"""Texts that are HTML already: what is put into one is escaped, unless it is such a text itself. For functions that build pages in kernels."""

from __future__ import annotations

import string
from collections.abc import Iterable, Mapping
from html import escape as _escape
from html import unescape as _unescape

from pagemill.functions.markup import to_text
from pagemill.sources.tree import Node, parse_fragment


def escape(value: object) -> Markup:
    """The value as HTML: as it is if it is HTML or can say so (``__html__``), else escaped."""
    if isinstance(value, Markup):
        return value
    if hasattr(value, "__html__"):
        return Markup(value.__html__())
    return Markup(_escape(str(value)).replace("&#x27;", "&#39;"))


def _same(name: str):
    """A method of texts whose result is HTML again, its text arguments escaped."""
    plain = getattr(str, name)

    def method(self: Markup, *args: object, **kwargs: object) -> Markup:
        return Markup(plain(self, *(escape(a) if isinstance(a, str) else a for a in args), **kwargs))

    method.__name__, method.__doc__ = name, plain.__doc__
    return method


def _parts(name: str):
    plain = getattr(str, name)

    def method(self: Markup, *args: object, **kwargs: object):
        found = plain(self, *args, **kwargs)
        return type(found)(map(Markup, found))

    method.__name__, method.__doc__ = name, plain.__doc__
    return method


class Markup(str):
    """HTML as a text."""

    __slots__ = ()

    @classmethod
    def escape(cls, value: object) -> Markup:
        return escape(value)

    def __html__(self) -> Markup:
        return self

    def __add__(self, other: object) -> Markup:
        return Markup(str.__add__(self, escape(other))) if isinstance(other, str) or hasattr(other, "__html__") else NotImplemented

    def __radd__(self, other: object) -> Markup:
        return escape(other) + self if isinstance(other, str) or hasattr(other, "__html__") else NotImplemented

    def __mul__(self, times: int) -> Markup:
        return Markup(str.__mul__(self, times))

    __rmul__ = __mul__

    def __getitem__(self, at: int | slice) -> Markup:
        return Markup(str.__getitem__(self, at))

    def __mod__(self, values: object) -> Markup:
        if isinstance(values, tuple):
            values = tuple(_Escaping(v) for v in values)
        elif isinstance(values, Mapping):
            values = {k: _Escaping(v) for k, v in values.items()}
        else:
            values = _Escaping(values)
        return Markup(str.__mod__(self, values))

    def __repr__(self) -> str:
        return f"Markup({str.__repr__(self)})"

    def join(self, values: Iterable[object]) -> Markup:
        return Markup(str.join(self, map(escape, values)))

    def format(self, *args: object, **kwargs: object) -> Markup:
        return Markup(EscapeFormatter().vformat(self, args, kwargs))

    def format_map(self, mapping: Mapping[str, object]) -> Markup:
        return Markup(EscapeFormatter().vformat(self, (), mapping))

    def unescape(self) -> str:
        """The text that the references stand for."""
        return _unescape(str(self))

    def striptags(self) -> str:
        """The text without elements and comments, its blanks collapsed."""
        root = Node("element", "div")
        for n in parse_fragment(str(self)):
            root.append(n)
        return " ".join(to_text(root).split())

    capitalize, title, lower, upper, swapcase, casefold = map(_same, ("capitalize", "title", "lower", "upper", "swapcase", "casefold"))
    ljust, rjust, center, zfill, expandtabs = map(_same, ("ljust", "rjust", "center", "zfill", "expandtabs"))
    strip, lstrip, rstrip = map(_same, ("strip", "lstrip", "rstrip"))
    replace, removeprefix, removesuffix, translate = map(_same, ("replace", "removeprefix", "removesuffix", "translate"))
    split, rsplit, splitlines, partition, rpartition = map(_parts, ("split", "rsplit", "splitlines", "partition", "rpartition"))


class EscapeFormatter(string.Formatter):
    """Formats with every value escaped; ``__html_format__`` of a value takes the format's place."""

    def format_field(self, value: object, spec: str) -> str:
        if hasattr(value, "__html_format__"):
            return value.__html_format__(spec)
        if isinstance(value, Markup) and not spec:
            return value
        return escape(super().format_field(value, spec))


class _Escaping:
    """A value that escapes itself when it is written by ``%``."""

    def __init__(self, value: object) -> None:
        self.value = value

    def __getitem__(self, key: object) -> _Escaping:
        return _Escaping(self.value[key])

    def __str__(self) -> str:
        return str(escape(self.value))

    def __repr__(self) -> str:
        return str(escape(repr(self.value)))

    def __int__(self) -> int:
        return int(self.value)

    def __float__(self) -> float:
        return float(self.value)

    def __index__(self) -> int:
        return int(self.value)
