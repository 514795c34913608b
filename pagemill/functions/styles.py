"""Shorter style sheets that mean the same."""

from __future__ import annotations

import re

_CSS = re.compile(r"(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|url\(\s*[^\"')][^)]*\))|/\*.*?\*/|(\s+)", re.S)


def minify_css(text: str) -> str:
    """A style sheet without comments and needless blanks; texts and addresses stay as they are."""
    kept: list[str] = []

    def one(m: re.Match) -> str:
        if m[1]:
            kept.append(m[1])
            return f"{len(kept) - 1}"
        return " "

    text = _CSS.sub(one, text)
    text = re.sub(r"\s+", " ", text).strip()
    text = re.sub(r" ?([{};,>~]) ?", r"\1", text)
    text = re.sub(r"(?<=[{;])([\w-]+) ?: ?", r"\1:", text)
    text = re.sub(r";+\}", "}", text)
    text = re.sub(r"(?<![\w#.])0\.(\d)", r".\1", text)
    text = re.sub(r"#([0-9a-fA-F])\1([0-9a-fA-F])\2([0-9a-fA-F])\3(?![0-9a-fA-F\w])(?=[^{]*\})", r"#\1\2\3", text)
    text = re.sub(r"[^{}]+\{\}", "", text)
    return re.sub("([0-9]+)", lambda m: kept[int(m[1])], text)


def minify_css_inline(style: str) -> str:
    """The declarations of a ``style`` attribute, shortened."""
    return minify_css("x{" + style + "}").removeprefix("x{").removesuffix("}")
