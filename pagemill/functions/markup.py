"""Rendering trees: HTML, canonical and minified HTML, plain text, Markdown; and escaping as Column expressions."""

from __future__ import annotations

import re
import textwrap
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from html.entities import codepoint2name
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.sources.tree import HTML, RAWTEXT, VOID, Node

_NO_END = VOID | {"basefont", "bgsound", "frame", "keygen"}
_RAW = RAWTEXT | {"script", "plaintext", "noscript"}
# Elements that stand on lines of their own.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
HIDDEN = frozenset("script style template head noscript iframe object svg math".split())
# Attributes that mean true by being there.
BOOLEAN = frozenset(
    "allowfullscreen async autofocus autoplay checked controls default defer disabled formnovalidate hidden inert ismap itemscope "
    "loop multiple muted nomodule novalidate open playsinline readonly required reversed selected".split()
)


def escape(text: Column, quote: bool = True) -> Column:
    """``& < >`` and, with ``quote``, both quotation marks as character references."""
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    if quote:
        out = F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    return out


def collapse_space(text: Column) -> Column:
    """Runs of white space become one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(text, "[ \t\n\f\r]+", " "))


def escape_text(text: str) -> str:
    return text.replace("&", "&amp;").replace(" ", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_value(text: str) -> str:
    return text.replace("&", "&amp;").replace(" ", "&nbsp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")


def serialize(node: Node, inner: bool = False) -> str:
    """HTML of a node by the serialization algorithm of the standard."""
    out: list[str] = []
    stack: list[Node | str] = list(reversed((node.content or node).children)) if inner or node.kind == "document" else [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.kind == "element":
            attrs = "".join(f' {k}="{escape_value(v)}"' for k, v in n.attrs.items())
            out.append(f"<{n.tag}{attrs}>")
            if not (n.ns == HTML and n.tag in _NO_END):
                stack.append(f"</{n.tag}>")
                stack.extend(reversed((n.content or n).children))
        elif n.kind == "text":
            raw = n.parent is not None and n.parent.kind == "element" and n.parent.ns == HTML and n.parent.tag in _RAW
            out.append(n.data if raw else escape_text(n.data))
        elif n.kind == "comment":
            out.append(f"<!--{n.data}-->")
        elif n.kind == "doctype":
            out.append(f"<!DOCTYPE {n.tag}>")
    return "".join(out)


@dataclass(frozen=True)
class Minify:
    """What minifying does to a page: each step can be left out; styles and scripts are shortened only on demand."""

    collapse_whitespace: bool = True
    omit_optional_tags: bool = True
    unquote_attributes: bool = True
    strip_comments: bool = True
    minify_css: bool = False
    minify_js: bool = False


def minify(node: Node, options: Minify = Minify()) -> str:
    """Shorter HTML of the same tree: no comments, single blanks, attributes without needless quotes, optional end tags left out."""
    from pagemill.functions.script import ScriptError, minify_js
    from pagemill.functions.styles import minify_css

    o = options
    out: list[str] = []

    def raw_text(n: Node, data: str) -> str:
        if o.minify_css and n.tag == "style":
            return minify_css(data)
        if o.minify_js and n.tag == "script" and n.attrs.get("type", "").lower() in ("", "module", "text/javascript", "application/javascript"):
            try:
                return minify_js(data)
            except ScriptError:
                return data
        return data

    def visit(n: Node, keep: bool) -> None:
        for i, c in enumerate((n.content or n).children):
            if c.kind == "doctype":
                out.append(f"<!doctype {c.tag}>")
            elif c.kind == "comment" and not o.strip_comments:
                out.append(f"<!--{c.data}-->")
            elif c.kind == "text":
                raw = n.kind == "element" and n.tag in _RAW
                data = c.data if raw or keep else re.sub(r"[ \t\n\f\r]+", " ", c.data)
                if not raw and not keep and data == " " and (n.tag in ("html", "head", "table", "tbody", "tr", "ul", "ol", "select") or n.kind == "document"):
                    continue
                out.append(raw_text(n, data) if raw else data.replace("&", "&amp;").replace("<", "&lt;"))
            elif c.kind == "element":
                attrs = ""
                for k, v in c.attrs.items():
                    if k in BOOLEAN or not v:
                        attrs += f" {k}"
                    elif not o.unquote_attributes or re.search(r"[\s\"'=<>`]", v):
                        attrs += f" {k}=\"{escape_value(v)}\"" if '"' not in v else f" {k}='{v.replace('&', '&amp;').replace(chr(39), '&#39;')}'"
                    else:
                        attrs += f" {k}={v.replace('&', '&amp;')}"
                out.append(f"<{c.tag}{attrs}>")
                visit(c, keep or c.tag in ("pre", "textarea"))
                following = next((x for x in n.children[i + 1 :] if not (x.kind == "text" and not x.data.strip())), None)
                last = following is None
                omit = c.tag in VOID or o.omit_optional_tags and (
                    c.tag in ("li", "dt", "dd", "tr", "td", "th", "option", "tbody", "tfoot")
                    and (last or following.kind == "element" and following.tag == c.tag)
                    or c.tag == "p" and following is not None and following.kind == "element" and following.tag in BLOCK - {"td", "th", "tr"}
                )
                if not omit or c.ns != HTML:
                    out.append(f"</{c.tag}>")

    visit(node, not o.collapse_whitespace)
    return "".join(out)


@dataclass(frozen=True)
class PlainText:
    """How plain text is written.

    ``layout`` strict leaves out blank lines between blocks. ``links``: none, inline or footnote.
    """

    width: int = 0  # 0: lines are not wrapped
    links: str = "none"
    images: bool = False  # with their alternative texts
    layout: str = "extended"  # extended, strict
    default_image_alt: str = ""
    table_cell_separator: str = "\t"
    bullet: str = ""


def to_text(node: Node, options: PlainText | None = None) -> str:
    """The text as a reader sees it: blocks on lines of their own, cells parted by tabs, hidden elements left out."""
    o = options or PlainText()
    out: list[str] = []
    notes: list[str] = []

    def line() -> None:
        if out and out[-1] != "\n":
            out.append("\n")

    def visit(n: Node, pre: bool) -> None:
        for c in n.children:
            if c.kind == "text":
                data = c.data if pre else re.sub(r"[ \t\n\f\r]+", " ", c.data)
                if not pre and (not out or out[-1] == "\n" or out[-1].endswith(" ")):
                    data = data.lstrip(" ")
                if data:
                    out.append(data)
            elif c.kind == "element" and c.tag not in HIDDEN and "hidden" not in c.attrs:
                if c.tag == "br":
                    out.append("\n")
                    continue
                if c.tag == "img":
                    if o.images and (alt := c.attrs.get("alt") or o.default_image_alt):
                        out.append(alt)
                    continue
                if c.tag in ("td", "th"):
                    if out and out[-1] != "\n":
                        out.append(o.table_cell_separator)
                    visit(c, pre)
                    continue
                if c.tag in BLOCK:
                    line()
                if c.tag == "li" and o.bullet:
                    out.append(o.bullet if o.bullet.endswith(" ") else o.bullet + " ")
                visit(c, pre or c.tag in ("pre", "textarea"))
                if c.tag == "a" and c.attrs.get("href") and o.links != "none":
                    notes.append(c.attrs["href"])
                    out.append(f" ({notes[-1]})" if o.links == "inline" else f" [{len(notes)}]")
                if c.tag in BLOCK:
                    line()
                    if o.layout == "extended" and c.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "ul", "ol", "table"):
                        out.append("\n")

    visit(node, False)
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(out))).strip()
    if o.width:
        text = "\n".join(textwrap.fill(x, o.width, break_long_words=False) for x in text.split("\n"))
    if o.links == "footnote" and notes:
        text += "\n\n" + "\n".join(f"[{i}] {u}" for i, u in enumerate(notes, 1))
    return text


@dataclass(frozen=True)
class Markdown:
    """How Markdown is written, in groups; the defaults give GitHub's dialect.

    ``strip`` names elements that leave only their text, ``convert`` the only ones that leave more; not both. ``converters`` are
    functions by element name, of the node and the Markdown of its content.
    """

    @dataclass(frozen=True)
    class Headings:
        style: str = "atx"  # atx, atx_closed, setext

    @dataclass(frozen=True)
    class Lists:
        bullets: str = "-"  # taken in turn by depth

    @dataclass(frozen=True)
    class Inline:
        strong: str = "**"
        emphasis: str = "*"
        strikethrough: str = "keep"  # keep, hide
        ignore_emphasis: bool = False
        sub: str = ""
        sup: str = ""
        hide_strikethrough: bool = False  # of styles, where those are read
        quote_open: str = '"'
        quote_close: str = '"'

    @dataclass(frozen=True)
    class Code:
        block_style: str = "fenced"  # fenced, indented
        language: str = ""
        mark: bool = False  # [code] and [/code] around inline code

    @dataclass(frozen=True)
    class Links:
        style: str = "inline"  # inline, reference
        autolink: bool = True  # <url> where the text is the address
        title: bool = False  # the address as title where there is none
        ignore: bool = False
        skip_internal: bool = False
        base_url: str = ""

    @dataclass(frozen=True)
    class Images:
        mode: str = "markdown"  # markdown, alt, ignore, html
        default_alt: str = ""

    @dataclass(frozen=True)
    class Tables:
        mode: str = "markdown"  # markdown, strip, html
        header: str = "first"  # first, detect, none
        cell_blocks: str = "html"  # html, text: what lists and tables in a cell become
        pad: bool = False

    @dataclass(frozen=True)
    class Escaping:
        mode: str = "minimal"  # minimal, all, none
        asterisks: bool = True
        underscores: bool = True

    @dataclass(frozen=True)
    class Wrapping:
        width: int = 0  # 0: lines are not wrapped
        list_items: bool = False
        links: bool = True  # whether a line may end within a link

    @dataclass(frozen=True)
    class Document:
        line_break: str = "spaces"  # spaces, backslash
        block_spacing: str = "double"  # double, single
        trim: str = "strip"  # strip, lstrip, rstrip, none
        transliterate: bool = False  # typographic signs to ASCII

    @dataclass(frozen=True)
    class GoogleDoc:
        enabled: bool = False  # styles are read as marks and levels, as word processors export them
        list_indent: int = 36

    headings: Markdown.Headings = field(default_factory=Headings)
    lists: Markdown.Lists = field(default_factory=Lists)
    inline: Markdown.Inline = field(default_factory=Inline)
    code: Markdown.Code = field(default_factory=Code)
    links: Markdown.Links = field(default_factory=Links)
    images: Markdown.Images = field(default_factory=Images)
    tables: Markdown.Tables = field(default_factory=Tables)
    escaping: Markdown.Escaping = field(default_factory=Escaping)
    wrapping: Markdown.Wrapping = field(default_factory=Wrapping)
    document: Markdown.Document = field(default_factory=Document)
    google: Markdown.GoogleDoc = field(default_factory=GoogleDoc)
    strip: Iterable[str] | None = None
    convert: Iterable[str] | None = None
    converters: Mapping[str, Callable[[Node, str], str]] | None = None

    def __post_init__(self) -> None:
        if self.strip is not None and self.convert is not None:
            raise ValueError("strip and convert exclude each other")

    @classmethod
    def google_doc(cls) -> Markdown:
        """Options for pages that a word processor exported."""
        return cls(google=cls.GoogleDoc(enabled=True))


# Typographic signs and their ASCII spellings.
ASCII_SIGNS = str.maketrans({"‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "–": "-", "—": "--", "…": "...", "•": "*", "\u00a0": " ", "‹": "'", "›": "'", "×": "x", "©": "(c)", "®": "(r)", "™": "(tm)"})
_NO_BREAK = "\ue000"  # stands for a blank within a link that must not be a line end


def style_of(n: Node) -> dict[str, str]:
    """Properties of the style attribute, lower case."""
    pairs = (p.partition(":") for p in n.attrs.get("style", "").lower().split(";"))
    return {k.strip(): v.strip() for k, colon, v in pairs if colon}


class _Markdown:
    """Renders one tree."""

    def __init__(self, options: Markdown) -> None:
        self.o = options
        self.references: dict[tuple[str, str], int] = {}
        self.strip, self.convert = frozenset(options.strip or ()), None if options.convert is None else frozenset(options.convert)

    def plain(self, tag: str) -> bool:
        return tag in self.strip or self.convert is not None and tag not in self.convert

    def target(self, url: str) -> str:
        return urljoin(self.o.links.base_url, url) if self.o.links.base_url else url

    def escaped(self, data: str) -> str:
        o = self.o.escaping
        if self.o.document.transliterate:
            data = data.translate(ASCII_SIGNS)
        if o.mode == "none":
            return data
        signs = r"\\`\[\]" + ("*" if o.asterisks else "") + ("_" if o.underscores else "") + ("{}()#+!|>~.-" if o.mode == "all" else "")
        return re.sub(f"([{signs}])", r"\\\1", data)

    def destination(self, url: str, title: str) -> str:
        url = f"<{url}>" if re.search(r"[\s()]", url) else url
        return f"{url} \"{title.replace(chr(34), chr(92) + chr(34))}\"" if title else url

    def link(self, c: Node, body: str) -> str:
        o = self.o.links
        url = self.target(c.attrs["href"])
        bare = body.strip()
        if o.ignore or o.skip_internal and c.attrs["href"].startswith("#"):
            return body
        if not bare:
            return ""
        title = c.attrs.get("title", "") or (url if o.title else "")
        if o.autolink and not title and c.text().strip() == url and re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", url):
            return f"<{url}>"
        if o.style == "reference":
            number = self.references.setdefault((url, title), len(self.references) + 1)
            found = f"[{bare}][{number}]"
        else:
            found = f"[{bare}]({self.destination(url, title)})"
        lead, trail = body[: len(body) - len(body.lstrip())], body[len(body.rstrip()) :]
        return lead + (found if self.o.wrapping.links else found.replace(" ", _NO_BREAK)) + trail

    def image(self, c: Node) -> str:
        mode, alt = self.o.images.mode, c.attrs.get("alt") or self.o.images.default_alt
        if mode == "html":
            return serialize(c)
        found = f"![{alt}]({self.destination(self.target(c.attrs.get('src', '')), c.attrs.get('title', ''))})"
        return {"alt": alt, "ignore": ""}.get(mode, found if self.o.wrapping.links else found.replace(" ", _NO_BREAK))

    def marks(self, c: Node) -> list[str] | None:
        """The marks around the content of an element; null: it is hidden."""
        o = self.o.inline
        found = {"b": o.strong, "strong": o.strong, "i": o.emphasis, "em": o.emphasis, "del": "~~", "s": "~~", "strike": "~~", "sub": o.sub, "sup": o.sup}.get(c.tag, "")
        marks = [found] if found else []
        struck = found == "~~"
        if struck and o.strikethrough == "hide":
            return None
        if self.o.google.enabled and (style := style_of(c)):
            if "line-through" in style.get("text-decoration", ""):
                if o.hide_strikethrough:
                    return None
                marks.append("~~")
            if style.get("font-weight", "") in ("bold", "bolder", "700", "800", "900") and c.tag not in ("b", "strong"):
                marks.append(o.strong)
            if style.get("font-style") == "italic" and c.tag not in ("i", "em"):
                marks.append(o.emphasis)
        return [] if o.ignore_emphasis and c.tag not in ("sub", "sup") else marks

    def inline(self, n: Node) -> str:
        return "".join(map(self.piece, n.children))

    def piece(self, c: Node) -> str:
        o = self.o
        if c.kind == "text":
            return self.escaped(re.sub(r"[ \t\n\f\r]+", " ", c.data))
        if c.kind != "element" or c.tag in HIDDEN:
            return ""
        if o.converters and c.tag in o.converters:
            return o.converters[c.tag](c, self.inline(c))
        if c.tag == "br":
            return "  \n" if o.document.line_break == "spaces" else "\\\n"
        if c.tag == "img":
            return c.attrs.get("alt", "") if self.plain("img") else self.image(c)
        if self.plain(c.tag):
            return self.inline(c)
        if c.tag in ("code", "kbd", "samp", "tt"):
            text = c.text()
            if o.code.mark:
                return f"[code]{text}[/code]"
            fence = "`" * (max((len(m) for m in re.findall("`+", text)), default=0) + 1)
            pad = " " if text.startswith("`") or text.endswith("`") else ""
            return f"{fence}{pad}{text}{pad}{fence}" if text else ""
        if c.tag == "q":
            return f"{o.inline.quote_open}{self.inline(c)}{o.inline.quote_close}"
        marks = self.marks(c)
        if marks is None:
            return ""
        body = self.inline(c)
        if c.tag == "a" and c.attrs.get("href"):
            body = self.link(c, body)
        if marks and body.strip():
            lead, trail = body[: len(body) - len(body.lstrip())], body[len(body.rstrip()) :]
            around = "".join(marks)
            closing = "".join(re.sub(r"^<(\w+)>$", r"</\1>", m) for m in reversed(marks))
            return f"{lead}{around}{body.strip()}{closing}{trail}"
        return body

    def wrapped(self, text: str, listed: bool = False) -> str:
        width = self.o.wrapping.width
        if width and (not listed or self.o.wrapping.list_items):
            text = "\n".join(textwrap.fill(x, width, break_long_words=False, break_on_hyphens=False) if not x.endswith("  ") else x for x in text.split("\n"))
        return text.replace(_NO_BREAK, " ")

    def heading(self, level: int, text: str) -> str:
        style = self.o.headings.style
        if style == "setext" and level < 3:
            return f"{text}\n{('=' if level == 1 else '-') * max(3, len(text))}"
        return f"{'#' * level} {text}" + (f" {'#' * level}" if style == "atx_closed" else "")

    def cell(self, n: Node) -> str:
        inner = any(x.tag in ("table", "ul", "ol", "pre", "blockquote") for x in n.elements() if x is not n)
        if inner and self.o.tables.cell_blocks == "html":
            return re.sub(r"\s*\n\s*", " ", serialize(n, inner=True)).strip().replace("|", "&#124;")
        parts = self.blocks(n, 0, True)
        joined = ("<br>" if self.o.tables.cell_blocks == "html" else " ").join("\n".join(parts).replace("  \n", "\n").split("\n"))
        return joined.replace("|", "\\|").strip()

    def table(self, n: Node) -> str:
        o = self.o.tables
        if o.mode == "html":
            return serialize(n)
        trs, stack = [], list(reversed(n.children))
        while stack:  # rows of this table, not of tables within
            x = stack.pop()
            if x.tag == "tr":
                trs.append(x)
            elif x.tag != "table":
                stack.extend(reversed(x.children))
        cells = [[x for x in tr.children if x.tag in ("td", "th")] for tr in trs]
        cells = [r for r in cells if r]
        if not cells:
            return ""
        if o.mode == "strip":
            return "\n".join("\t".join(" ".join(self.inline(x).split()) for x in r) for r in cells)
        rows = [[self.cell(x) for x in r] for r in cells]
        first = o.header == "first" or o.header == "detect" and all(x.tag == "th" for x in cells[0])
        width = max(map(len, rows))
        rows = [r + [""] * (width - len(r)) for r in rows]
        head, body = (rows[0], rows[1:]) if first else ([""] * width, rows)
        align = [{"left": ":--", "right": "--:", "center": ":-:"}.get(style_of(x).get("text-align") or x.attrs.get("align", "").lower(), "---") for x in cells[0]]
        align += ["---"] * (width - len(align))
        if o.pad:
            sizes = [max(3, *(len(r[i]) for r in [head, *body])) for i in range(width)]
            head, body = [x.ljust(s) for x, s in zip(head, sizes, strict=True)], [[x.ljust(s) for x, s in zip(r, sizes, strict=True)] for r in body]
            align = [a[0] + "-" * (s - 2) + a[-1] for a, s in zip(align, sizes, strict=True)]
        lines = ["| " + " | ".join(r) + " |" for r in [head, align, *body]]
        caption = n.first("caption")
        return ("" if caption is None or not (text := self.inline(caption).strip()) else text + "\n\n") + "\n".join(lines)

    def listing(self, c: Node, depth: int) -> str:
        o, items = self.o, []
        number = int(c.attrs["start"]) if re.fullmatch(r"\d+", c.attrs.get("start", "")) else 1
        for li in (x for x in c.children if x.kind == "element" and x.tag not in HIDDEN):
            level = depth
            if o.google.enabled:
                margin = re.match(r"(\d+)", style_of(li).get("margin-left", ""))
                level = max(0, int(margin[1]) // o.google.list_indent - 1) if margin else depth
            ordered = c.tag == "ol" and not (o.google.enabled and style_of(c).get("list-style-type", "decimal") in ("disc", "circle", "square", "none"))
            mark = f"{number}. " if ordered else f"{o.lists.bullets[level % len(o.lists.bullets)]} "
            number += 1
            box = next((x for x in li.children if x.tag == "input" and x.attrs.get("type", "").lower() == "checkbox"), None)
            task = "" if box is None else "[x] " if "checked" in box.attrs else "[ ] "
            lead = "  " * level if o.google.enabled else ""
            body = self.blocks(li, depth + 1, True)
            loose = sum(x.tag == "p" for x in li.children) > 1
            text = ("\n\n" if loose else "\n").join(body)
            items.append(lead + mark + task + f"\n{lead}{' ' * len(mark)}".join(text.split("\n")))
        return re.sub(r"\n[ ]+(?=\n)", "\n", "\n".join(items))

    def blocks(self, n: Node, depth: int = 0, listed: bool = False) -> list[str]:
        found: list[str] = []
        run: list[Node] = []

        def flush() -> None:
            if not run:
                return
            if text := "".join(map(self.piece, run)).strip():
                found.append(self.wrapped(text, listed))
            run.clear()

        for c in n.children:
            if c.kind == "text" or c.kind == "element" and c.tag not in BLOCK and c.tag not in HIDDEN and not any(x.tag in BLOCK for x in c.elements()):
                run.append(c)
                continue
            if c.kind != "element" or c.tag in HIDDEN:
                continue
            flush()
            found += self.block(c, depth, listed)
        flush()
        return found

    def block(self, c: Node, depth: int, listed: bool) -> list[str]:
        o = self.o
        if o.converters and c.tag in o.converters:
            text = o.converters[c.tag](c, "\n\n".join(self.blocks(c, depth, listed)))
            return [text] if text else []
        if self.plain(c.tag):
            return self.blocks(c, depth, listed)
        if c.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            text = re.sub(r"[ \t\n\f\r]+", " ", self.inline(c).replace("\\\n", " ")).strip(" ").replace(_NO_BREAK, " ")
            return [self.heading(int(c.tag[1]), text)] if text else []
        if c.tag == "hr":
            return ["---"]
        if c.tag == "pre":
            body = c.text().strip("\n")
            declared = re.search(r"\b(?:language|lang)-([\w+#-]+)", (c.first("code") or c).attrs.get("class", "") + " " + c.attrs.get("class", ""))
            lang = declared[1] if declared else o.code.language if "`" not in o.code.language else ""
            if o.code.block_style == "indented" and not listed:
                return [textwrap.indent(body, "    ")]
            fence = "`" * max(3, max((len(m) for m in re.findall("`+", body)), default=0) + 1)
            return [f"{fence}{lang}\n{body}\n{fence}"]
        if c.tag == "blockquote":
            text = "\n\n".join(self.blocks(c, depth))
            return ["\n".join(f"> {x}".rstrip() for x in text.split("\n"))] if text else []
        if c.tag in ("ul", "ol", "menu", "dir"):
            text = self.listing(c, depth)
            return [text] if text else []
        if c.tag == "table":
            text = self.table(c)
            return [text] if text else []
        if c.tag == "dd":
            return [f":   {x}" if i == 0 else textwrap.indent(x, "    ") for i, x in enumerate(self.blocks(c, depth, True))]
        return self.blocks(c, depth, listed)


def to_markdown(node: Node, options: Markdown | None = None) -> str:
    """Markdown of the visible content: headings, lists, quotes, code, links, images, emphasis, tables."""
    o = options or Markdown()
    writer = _Markdown(o)
    parts = writer.blocks(node) if node.kind != "element" or node.tag not in BLOCK | {"html"} else writer.block(node, 0, False)
    out = ("\n\n" if o.document.block_spacing == "double" else "\n").join(parts)
    out = {"strip": out.strip, "lstrip": out.lstrip, "rstrip": out.rstrip}.get(o.document.trim, lambda: f"\n{out}\n")()
    notes = "".join(f"\n{chr(10) if i == 1 else ''}[{i}]: {writer.destination(u, t)}" for (u, t), i in writer.references.items())
    return out + notes


@dataclass(frozen=True)
class Html:
    """How HTML is written again.

    ``formatter``: whatwg, minimal (only ``& < >``), entities (every sign that has a name), ascii (numbers for all others) or
    none. ``layout``: null, ``indent`` (by ``unit``) or ``minify``. ``meta_charset`` declares UTF-8 in the head.
    """

    formatter: str = "whatwg"
    layout: str | None = None
    unit: str = "  "
    minify: Minify = Minify()
    sort_attributes: bool = False
    meta_charset: bool = False
    xml: bool = False


def _formatted(text: str, formatter: str, quote: bool) -> str:
    if formatter == "none":
        return text
    if formatter == "whatwg":
        return escape_value(text) if quote else escape_text(text)
    out = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    out = out.replace('"', "&quot;") if quote else out
    if formatter == "entities":
        return "".join(f"&{codepoint2name[ord(c)]};" if c > "\x7f" and ord(c) in codepoint2name else c for c in out)
    return out.encode("ascii", "xmlcharrefreplace").decode() if formatter == "ascii" else out


def serialize_with(node: Node, options: Html) -> str:
    """HTML, indented HTML, minified HTML or XML of a tree, by options."""
    o = options
    if o.meta_charset:
        head = node.first("head")
        for n in [x for x in node.elements() if x.tag == "meta" and ("charset" in x.attrs or x.attrs.get("http-equiv", "").lower() == "content-type")]:
            n.remove()
        if head is not None:
            head.insert(0, Node("element", "meta", attrs={"charset": "utf-8"}))
    if o.sort_attributes:
        for n in node.elements():
            n.attrs = dict(sorted(n.attrs.items()))
    if o.xml:
        return serialize_xml(node)
    if o.layout == "minify":
        return minify(node, o.minify)
    out: list[str] = []

    def visit(n: Node, depth: int, pretty: bool) -> None:
        for c in (n.content or n).children:
            line = f"\n{o.unit * depth}" if pretty and out else ""
            if c.kind == "text":
                raw = n.kind == "element" and n.ns == HTML and n.tag in _RAW
                data = c.data if not pretty else " ".join(c.data.split())
                if data:
                    out.append(line + (data if raw else _formatted(data, o.formatter, False)))
            elif c.kind == "comment":
                out.append(f"{line}<!--{c.data}-->")
            elif c.kind == "doctype":
                out.append(f"{line}<!DOCTYPE {c.tag}>")
            elif c.kind == "element":
                out.append(f"{line}<{c.tag}" + "".join(f' {k}="{_formatted(v, o.formatter, True)}"' for k, v in c.attrs.items()) + ">")
                if c.ns == HTML and c.tag in _NO_END:
                    continue
                blocks = pretty and c.tag not in ("pre", "textarea") and c.tag not in _RAW and any(x.kind == "element" and (x.tag in BLOCK or x.tag in HIDDEN or x.tag in ("meta", "link")) for x in (c.content or c).children)
                visit(c, depth + 1, bool(blocks))
                out.append((f"\n{o.unit * depth}" if blocks else "") + f"</{c.tag}>")

    visit(node, 0, o.layout == "indent")
    return "".join(out)


_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")
# Namespaces of XHTML, SVG and MathML.
NAMESPACES = {HTML: "http://www.w3.org/1999/xhtml", "svg": "http://www.w3.org/2000/svg", "math": "http://www.w3.org/1998/Math/MathML"}


def serialize_xml(node: Node, inner: bool = False) -> str:
    """Well-formed XML of a tree: empty elements close themselves, SVG and MathML declare their namespaces, and what XML cannot
    hold is left out."""
    out: list[str] = []
    text = lambda v: _NOT_XML.sub("", v).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def visit(n: Node, ns: str) -> None:
        if n.kind == "text":
            out.append(text(n.data))
        elif n.kind == "comment":
            data = re.sub("-(?=-)", "- ", _NOT_XML.sub("", n.data))
            out.append(f"<!--{data}{' ' if data.endswith('-') else ''}-->")
        elif n.kind == "doctype":
            out.append(f"<!DOCTYPE {n.tag}>")
        elif n.kind == "processing-instruction":
            out.append(f"<?{n.tag} {n.data}?>")
        elif n.kind == "element":
            attrs = {k: v for k, v in n.attrs.items() if re.fullmatch(r"[A-Za-z_:][\w:.-]*", k)}
            if n.ns != ns and n.ns in NAMESPACES and n.ns != HTML and "xmlns" not in attrs:
                attrs = {"xmlns": NAMESPACES[n.ns]} | attrs
            if any(k.startswith("xlink:") for k in attrs) and "xmlns:xlink" not in attrs:
                attrs = {"xmlns:xlink": "http://www.w3.org/1999/xlink"} | attrs
            written = "".join(f' {k}="{text(v).replace(chr(34), "&quot;").replace(chr(10), "&#10;").replace(chr(9), "&#9;")}"' for k, v in attrs.items())
            children = (n.content or n).children
            if not children:
                out.append(f"<{n.tag}{written}/>")
                return
            out.append(f"<{n.tag}{written}>")
            for c in children:
                visit(c, n.ns)
            out.append(f"</{n.tag}>")
        else:
            for c in n.children:
                visit(c, ns)

    if inner or node.kind == "document":
        for c in (node.content or node).children:
            visit(c, HTML)
    else:
        visit(node, HTML)
    return "".join(out)


def to_source(node: Node, text: str) -> str:
    """The page as it was written: ``text`` itself, with line ends as the tokenizer reads them, where the tree still has its nodes.

    An element that was taken out of the tree is cut out of the source; everything else, spelling of tags and of references
    included, stays as it was.
    """
    source = text.replace("\r\n", "\n").replace("\r", "\n")
    kept = sorted({n.start for n in node.walk() if n.start} | {n.end for n in node.walk() if n.end})
    return "".join(source[a:b] for a, b in kept)


