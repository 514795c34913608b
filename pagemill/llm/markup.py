"""Markup residue: finding HTML, Markdown, wiki and LaTeX constructs in plain-text fields and turning them into clean text.

Clean text keeps structure in one plain notation: ``# `` before headings (one sign per level), ``- `` before list items,
code blocks between lines of three backticks, formulas between dollar signs. Everything else of the markup goes: tags,
emphasis, link targets, references, comments, templates, table rules.

A host suffix array (see :mod:`pagemill.llm.boilerplate`) finds runs that repeat across pages; a construct that occurs once
in one value is no such run, so constructs are found by the grammar below.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAGS = (
    "a|abbr|address|article|aside|audio|b|bdi|bdo|big|blockquote|body|br|button|caption|center|cite|code|col|colgroup|data|dd|"
    "del|details|dfn|div|dl|dt|em|embed|figcaption|figure|font|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|i|iframe|"
    "img|input|ins|kbd|label|legend|li|link|main|mark|math|meta|nav|nowiki|object|ol|option|p|param|picture|pre|q|ref|"
    "s|samp|script|section|select|small|source|span|strike|strong|style|sub|summary|sup|svg|table|tbody|td|template|"
    "textarea|tfoot|th|thead|time|title|tr|tt|u|ul|var|video|wbr|references|gallery|syntaxhighlight|content|entry|item"
)
_NAMES = frozenset(_TAGS.split("|"))
#: Character references that are cut off at the end count if they begin one of these.
_REFERENCES = ("amp;", "nbsp;", "quot;", "hellip;", "mdash;", "ndash;", "rsquo;", "lsquo;", "rdquo;", "ldquo;", "eacute;", "copy;", "apos;")

HTML = re.compile(
    rf"</?(?:{_TAGS})(?:\s[^<>]*)?/?>|</?[a-z][a-z0-9]*:[a-z]+[^<>]*>|<!--|-->|<!\[CDATA\[|\]\]>|<!doctype\b|<\?xml\b"
    rf"|<https?://[^<>\s]*>?|</?(?:{_TAGS})(?:\s[^<>]*)?\Z|<(?:{_TAGS})\s+[a-z-]+\s*=",
    re.I,
)
_CUT_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)?\Z")
REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});|&(?:amp|lt|gt|quot|nbsp|copy|reg)\b(?![=(])")
_CUT_REFERENCE = re.compile(r"&(#[0-9]{0,7}|#[xX][0-9A-Fa-f]{0,6}|[A-Za-z]{2,8})\Z")
MARKDOWN = re.compile(
    r"^ {0,3}(?:```|~~~)|^ {0,3}#{1,6}[ \t]+\S|^[^\n]*\w[^\n]*\n {0,3}(?:={3,}|-{3,})[ \t]*$|^ {0,3}>(?:[ \t]|$)"
    r"|^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$|^\|[^\n]*\|[ \t]*$"
    r"|!?\[[^\[\]\n]*\]\([^)\s]*(?:\)|\Z| \")|!?\[[^\[\]\n]+\]\[[^\[\]\n]*\]|\[\^[\w-]{1,20}(?:\]|\Z)|^ {0,3}\[[^\[\]\n]+\]:[ \t]*\S"
    r"|(?<![\w*])\*{2,3}(?=[^\s*])|(?<=[^\s*])\*{2,3}(?![\w*])|(?<![\w*])\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?![\w*])"
    r"|(?<!\w)__?(?=[^\s_])[^_\n]+(?<=[^\s_])__?(?!\w)|~~(?=\S)|(?<=\S)~~|`[^`\n]+`|(?<![^\s(“])`\w|\w`(?=[\s.,;:!?]|\Z)",
    re.M,
)
_ITEM = re.compile(r"^ {0,6}(?:[-+*]|\*{2,3}|#{2,3}|[0-9]{1,3}[.)])[ \t]+(?=\S)", re.M)
WIKI = re.compile(
    r"(?<![\w'])'{2,5}(?=[^\s'])[^'\n]|(?<=[^\s'])'{2,5}(?![\w'])|^={2,6}[ \t]*[^=\s][^=\n]*(?:={2,6}[ \t]*$|\Z)"
    r"|\[\[[^\[\]\n]+(?:\]\]|\Z)|\]\]|\{\{[^{}\n]*(?:\}\}|\||\Z)|\}\}|^\{\||^\|\}|^\|-(?![-: |]*\|)|\[https?://[^\]\s]*(?:[ \]]|\Z)|__[A-Z]{3,}__",
    re.M,
)
LATEX = re.compile(
    r"(?<![A-Za-z:.\\/])\\(?:[A-Za-z]{2,}\*?(?![\w\\/])|[A-Za-z]+\{|[\[\]()](?=\s|\S)|[%&#_${}](?!/)|\\(?=\s|$))|\$\$|(?<![\w$])\$(?=[^\s\d$])[^$\n]*(?<=[^\s$])\$(?!\w)"
    r"|\$[^$\n]*[\\^_=][^$\n]*\$",
    re.M,
)
_SIGNS = r"[<&*_`~#|\[\]{}$\\>]|''|^=|\n"


def _cut(text: str) -> bool:
    """A tag or character reference of which the text's end leaves the beginning."""
    if (m := _CUT_TAG.search(text)) and m.start() > 0 and not text[m.start() - 1].isspace():
        return True
    if m and m[1] and any(n.startswith(m[1].lower()) for n in _NAMES):
        return True
    if m := _CUT_REFERENCE.search(text):
        return m[1].startswith("#") or any(r.startswith(m[1].lower()) and len(m[1]) > 1 for r in _REFERENCES)
    return False


def families(text: str) -> list[str]:
    """Which of html, markdown, wiki and latex the text carries a construct of."""
    found = []
    tagged = "<" in text or ">" in text
    if (tagged and HTML.search(text)) or ("&" in text and any(m[0][-1] != ";" or html.unescape(m[0]) != m[0] for m in REFERENCE.finditer(text))) or _cut(text):
        found.append("html")
    if MARKDOWN.search(text):
        found.append("markdown")
    elif (items := _ITEM.findall(text)) and (len(items) > 1 or not _ITEM.match(text)):
        found.append("markdown")
    if WIKI.search(text):
        found.append("wiki")
    if ("\\" in text or "$" in text) and LATEX.search(text):
        found.append("latex")
    return found


class _Kept:
    """Code blocks and formulas, taken out before the rest is converted."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def keep(self, part: str) -> str:
        self.parts.append(part)
        return f"\ue000{len(self.parts) - 1}\ue001"

    def code(self, body: str) -> str:
        return "\n" + self.keep("```\n" + body.strip("\n") + "\n```") + "\n"

    def formula(self, body: str, block: bool) -> str:
        sign = "$$" if block else "$"
        return self.keep(f"{sign}{body.strip()}{sign}")

    def restore(self, text: str) -> str:
        return re.sub("\ue000([0-9]+)\ue001", lambda m: self.parts[int(m[1])], text)


_ESCAPED = re.compile(rf"&(?:amp;)*lt;/?(?:{_TAGS}|!--)", re.I)
_FENCE = re.compile(r"^ {0,3}(```+|~~~+)[^\n`]*\n(.*?)(?:^ {0,3}\1[ \t]*$|\Z)", re.M | re.S)
_PRE = re.compile(r"<(pre|syntaxhighlight|source)\b[^>]*>(.*?)(?:</\1\s*>|\Z)", re.I | re.S)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting)\}[^\n]*\n?(.*?)(?:\\end\{\1\}|\Z)", re.S)
_BLOCK_MATH = re.compile(r"\$\$(.+?)(?:\$\$|\Z)|\\\[(.+?)(?:\\\]|\Z)|\\begin\{(equation|align|gather)(\*?)\}(.+?)(?:\\end\{\3\4\}|\Z)", re.S)
_INLINE_MATH = re.compile(r"\\\((.+?)\\\)|(?<![\w$\\])\$(?=[^\s\d$]|[0-9][^$\n]*[\\^_=])([^$\n]*[^\s$])\$(?!\w)|<math\b[^>]*>(.*?)</math>", re.S)


def _html(text: str) -> str:
    text = re.sub(r"<!\[CDATA\[|\]\]>", "", text)
    text = re.sub(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<ref\b[^>]*/>", "", text, flags=re.I | re.S)
    text = re.sub(r"<ref\b[^>]*>", " ", text, flags=re.I)
    text = re.sub(r"<h([1-6])\b[^>]*>\s*", lambda m: "\n\n" + "#" * int(m[1]) + " ", text, flags=re.I)
    text = re.sub(r"<li\b[^>]*>\s*", "\n- ", text, flags=re.I)
    text = re.sub(r"<img\b[^>]*?\balt\s*=\s*(\"([^\"]*)\"|'([^']*)')[^>]*>", lambda m: (m[2] or m[3] or "") + " ", text, flags=re.I)
    text = re.sub(r"<t[dh]\b[^>]*>", "\t", text, flags=re.I)
    text = re.sub(r"<(?:br|hr|tr|dt|dd)\b[^>]*>", "\n", text, flags=re.I)
    text = re.sub(r"</?(?:p|div|ul|ol|table|blockquote|section|article|h[1-6]|header|footer|figure|form)\b[^>]*>", "\n", text, flags=re.I)
    text = re.sub(r"<(https?://[^<>\s]*)>?", r"\1", text)
    text = re.sub(rf"</?(?:{_TAGS})(?:\s[^<>]*)?/?>|<[!?][^<>]*>|</?[a-z][a-z0-9]*:[a-z]+[^<>]*>", "", text, flags=re.I)
    if _cut(text):
        text = re.sub(r"</?[A-Za-z]*\Z|&[#A-Za-z0-9]*\Z", "", text)
    text = re.sub(rf"</?(?:{_TAGS})(?:\s[^<>]*)?\Z", "", text, flags=re.I)
    return html.unescape(text)


def _wiki(text: str) -> str:
    text = re.sub(r"^(={2,6})[ \t]*([^=\n]+?)[ \t]*(?:={2,6})?[ \t]*$", lambda m: "\n" + "#" * len(m[1]) + " " + m[2] + "\n", text, flags=re.M)
    text = re.sub(r"^(?:\{\||\|\}|\|-(?![-: |]*\|)|\|\+).*$", "", text, flags=re.M)
    text = re.sub(r"^[!|][ \t]*(.*)$", lambda m: re.sub(r"[ \t]*(?:\|\||!!)[ \t]*", "\t", m[1]) if "||" in m[1] or "!!" in m[1] or m[0][0] == "!" else m[0], text, flags=re.M)
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)(?:\]\]|\Z)", r"\1", text)
    text = re.sub(r"\[https?://\S+[ \t]+([^\]\n]*)(?:\]|\Z)|\[(https?://[^\]\s]*)\]", lambda m: m[1] or m[2] or "", text)
    text = re.sub(r"\{\{[^{}|\n]*\|?([^{}]*?)(?:\}\}|\Z)", lambda m: m[1].replace("|", " — "), text)
    return re.sub(r"(?<!')'{2,5}(?!')|__[A-Z]{3,}__", "", text)


def _latex(text: str) -> str:
    text = re.sub(r"(?<!\\)%[^\n]*", "", text)
    level = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "title": 1}
    text = re.sub(
        r"\\(part|chapter|section|subsection|subsubsection|paragraph|title)\*?\{([^{}]*)\}?",
        lambda m: "\n" + "#" * level[m[1]] + " " + m[2] + "\n", text,
    )
    text = re.sub(r"\\item\b[ \t]*", "\n- ", text)
    text = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", "\n", text)
    text = re.sub(r"~?\\(?:cite[a-z]*|ref|label|eqref|pageref|index)\*?(?:\[[^\]]*\])?\{[^{}]*\}?", "", text)
    text = re.sub(r"\\(?:ldots|dots)(?:\{\})?", "…", text)
    text = re.sub(r"\\(?:href)\{[^{}]*\}", "", text)
    for _ in range(3):
        text = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\\\", "\n", text)
    text = re.sub(r"(?<![A-Za-z:.\\/])\\[A-Za-z]{2,}\*?(?![\w\\/])\{?", "", text)
    return re.sub(r"\\([%&#_${}])", r"\1", text).replace("~", " ")


def _markdown(text: str) -> str:
    text = re.sub(r"^ {0,3}\[\^[^\]\n]+\]:[^\n]*$|\[\^[\w-]+\]?|^ {0,3}\[[^\[\]\n]+\]:[ \t]*\S+[^\n]*$", "", text, flags=re.M)
    text = re.sub(r"!?\[([^\[\]\n]*)\]\([^)\n]*(?:\)|\Z)|!?\[([^\[\]\n]+)\]\[[^\[\]\n]*\]", lambda m: m[1] if m[1] is not None else m[2], text)
    text = re.sub(r"^([^\n]*\w[^\n]*)\n {0,3}(={3,}|-{3,})[ \t]*$", lambda m: ("# " if m[2][0] == "=" else "## ") + m[1], text, flags=re.M)
    text = re.sub(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$\n?", "", text, flags=re.M)
    text = re.sub(r"^\|[ \t]*([^\n]*?)[ \t]*\|[ \t]*$", lambda m: re.sub(r"[ \t]*\|[ \t]*", "\t", m[1]), text, flags=re.M)
    text = re.sub(r"^ {0,3}(?:>[ \t]?)+", "", text, flags=re.M)
    if len(_ITEM.findall(text)) > 1 or not _ITEM.match(text):
        text = re.sub(r"^ {0,6}(?:[-+*]|\*{2,3})[ \t]+(?=\S)", "- ", text, flags=re.M)
    text = re.sub(r"(?<![\w*])\*{1,3}(?=[^\s*])([^*\n]+)(?<=[^\s*])\*{1,3}(?![\w*])", r"\1", text)
    text = re.sub(r"(?<![\w*])\*{2,3}(?=[^\s*])|(?<=[^\s*])\*{2,3}(?![\w*])|~~", "", text)
    text = re.sub(r"(?<!\w)__?(?=[^\s_])([^_\n]+)(?<=[^\s_])__?(?!\w)", r"\1", text)
    return re.sub(r"`+([^`\n]+)`+|(?<![^\s(“])`(?=\w)|(?<=\w)`(?=[\s.,;:!?]|\Z)", lambda m: m[1] or "", text)


def clean(text: str, found: list[str] | None = None) -> str:
    """The text without markup; a text without any construct comes back unchanged."""
    found = families(text) if found is None else found
    if not found:
        return text
    kept = _Kept()
    for _ in range(3):
        if not _ESCAPED.search(text):
            break
        text = html.unescape(text)
    text = _FENCE.sub(lambda m: kept.code(m[2]), text)
    text = _PRE.sub(lambda m: kept.code(html.unescape(re.sub(r"</?code\b[^>]*>", "", m[2], flags=re.I))), text)
    text = _VERBATIM.sub(lambda m: kept.code(m[2]), text)
    text = _BLOCK_MATH.sub(lambda m: kept.formula(m[1] or m[2] or m[5], True), text)
    text = _INLINE_MATH.sub(lambda m: kept.formula(m[1] or m[2] or m[3] or "", False), text)
    if "html" in found:
        text = _html(text)
    if "latex" in found:
        text = _latex(text)
    if "wiki" in found:
        text = _wiki(text)
    if "markdown" in found or "wiki" in found:
        text = _markdown(text)
    text = re.sub(r"[ \t]+$|^[ \t]+(?=\S)", "", re.sub(r"[ \u00a0]{2,}", " ", text), flags=re.M)
    return kept.restore(re.sub(r"\n{3,}", "\n\n", text).strip())


def convert(df: DataFrame, text: str, cleaning: bool = True) -> DataFrame:
    """Add ``families`` (the kinds of markup found, empty if none) and ``clean`` for column ``text``.

    Null stays null with no families; an empty text stays empty; texts of any length are read whole. Other columns stay;
    input columns named like the outputs are replaced. Rows without any sign that could begin a construct do not leave
    the JVM's row, they are passed through the kernel unread. With ``cleaning`` off, ``clean`` is null.
    """
    columns = [c for c in df.columns if c not in ("families", "clean", "_suspect")]
    fields = [df.schema[c] for c in columns]
    out = T.StructType([*fields, T.StructField("families", T.ArrayType(T.StringType())), T.StructField("clean", T.StringType())])
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, cleaned = [], []
            for value, suspect in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                found = families(value) if suspect else []
                kinds.append(found)
                cleaned.append((clean(value, found) if found else value) if cleaning else None)
            arrays = [*batch.columns[: len(columns)], pa.array(kinds, pa.list_(pa.string())), pa.array(cleaned, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return df.select(*[F.col(f"`{c}`") for c in columns], F.col(text).rlike(_SIGNS).alias("_suspect")).mapInArrow(run, out)
