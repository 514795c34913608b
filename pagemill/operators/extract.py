"""What a page says: links, tables, metadata, structured data, main content, paragraphs, dates, forms; and feeds.

Each extractor is a kernel over one parsed page, so a job over all pages is a scan with a projection and no shuffle.
"""

from __future__ import annotations

import datetime
import json
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, replace
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.functions.markup import BLOCK, HIDDEN, serialize, to_markdown, to_text
from pagemill.functions.whatwg import UrlCleaning, clean_one, resolve
from pagemill.sources.nodes import per_page
from pagemill.sources.tree import Node, parse

_S, _I, _B, _D = pa.string(), pa.int32(), pa.bool_(), pa.float64()

# Attributes that hold addresses, by element; ``srcset`` holds several.
LINKS = {
    "a": ("href",), "area": ("href",), "link": ("href",), "base": ("href",), "img": ("src", "srcset", "longdesc"), "script": ("src",),
    "iframe": ("src",), "frame": ("src",), "embed": ("src",), "source": ("src", "srcset"), "track": ("src",), "video": ("src", "poster"),
    "audio": ("src",), "input": ("src",), "form": ("action",), "button": ("formaction",), "object": ("data",), "blockquote": ("cite",),
    "q": ("cite",), "ins": ("cite",), "del": ("cite",), "body": ("background",),
}
_CSS_URL = re.compile(r"url\(\s*(?:\"([^\"]*)\"|'([^']*)'|([^)\s]*))\s*\)|@import\s+(?:\"([^\"]*)\"|'([^']*)')", re.I)


def base_of(document: Node, url: str | None) -> str:
    base = next((n.attrs["href"] for n in document.elements() if n.tag == "base" and n.attrs.get("href")), "")
    return _join(url or "", base.strip())


def _join(base: str, link: str) -> str:
    """``link`` against ``base`` by the URL standard; as it is where that gives no address."""
    return resolve(link, base or None) or link


_REFRESH = re.compile(r"\s*([0-9.]+)\s*(?:[;,]?\s*(?:url\s*=\s*)?(?:\"([^\"]*)\"?|'([^']*)'?|(\S.*)))?", re.I | re.S)


def meta_refresh_of(n: Node) -> tuple[float, str] | None:
    """Seconds and address of a ``meta`` element that refreshes the page."""
    if n.tag != "meta" or n.attrs.get("http-equiv", "").strip().lower() != "refresh" or (m := _REFRESH.match(n.attrs.get("content", ""))) is None:
        return None
    seconds = re.match(r"\d*\.?\d*", m[1])[0]
    return float(seconds) if seconds not in ("", ".") else 0.0, (m[2] or m[3] or m[4] or "").strip()


def meta_refresh(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """``seconds`` and ``target`` (resolved; the page's own address if it names none) of pages that refresh themselves."""

    def kernel(text: str | None, address: str | None) -> list[tuple]:
        document = parse(text)
        found = next((r for n in document.elements() if (r := meta_refresh_of(n))), None)
        return [(found[0], _join(base_of(document, address), found[1]) if found[1] else address)] if found else []

    return per_page(pages, kernel, "page_id bigint, seconds double, target string", [_D, _S], html, url, key=key)


def links_of(document: Node, url: str | None) -> list[tuple]:
    base, out = base_of(document, url), []
    for n in document.elements():
        for name in LINKS.get(n.tag, ()):
            value = n.attrs.get(name)
            if value is None:
                continue
            parts = [p.strip().split()[0] for p in re.split(r",\s+", value) if p.strip()] if name == "srcset" else [value.strip()]
            rel = n.attrs.get("rel", "").lower()
            out += [(len(out) + i, n.tag, name, p, _join(base, p), rel, " ".join(n.text().split())) for i, p in enumerate(parts, 1)]
        for name, several in (("ping", True), ("archive", True), ("usemap", False), ("manifest", False), ("icon", False), ("codebase", False)):
            if (value := n.attrs.get(name)) and (name != "icon" or n.tag in ("command", "menuitem")):
                parts = value.replace(",", " ").split() if several else [value.strip()]
                out += [(len(out) + i, n.tag, name, p, _join(base, p), "", "") for i, p in enumerate(parts, 1)]
        if n.tag == "meta" and (refresh := meta_refresh_of(n)) and refresh[1]:
            out.append((len(out) + 1, "meta", "content", refresh[1], _join(base, refresh[1]), "refresh", ""))
        css = n.attrs.get("style", "") if n.tag != "style" else n.text()
        for m in _CSS_URL.finditer(css):
            link = next(g for g in m.groups() if g is not None)
            out.append((len(out) + 1, n.tag, "style" if n.tag != "style" else None, link, _join(base, link), "", ""))
    return out


def links(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """Every address in a page, resolved against its base: ``seq, tag, attribute, link, url, rel, text``."""
    schema = "page_id bigint, seq int, tag string, attribute string, link string, url string, rel string, text string"
    return per_page(pages, lambda h, u: links_of(parse(h), u), schema, [_I, _S, _S, _S, _S, _S, _S], html, url, key=key)


def extract_links(pages: DataFrame, options: UrlCleaning = UrlCleaning(), html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """Clean addresses of the pages that each page's anchors lead to, each once (``seq, url, text``).

    Twins that differ in http against https or in a trailing slash count as one; the first stays.
    """

    def kernel(text: str | None, address: str | None) -> list[tuple]:
        document = parse(text)
        base, seen, out = base_of(document, address), set(), []
        for n in document.elements():
            if n.tag in ("a", "area") and n.attrs.get("href"):
                clean = clean_one(n.attrs["href"], replace(options, base_url=base or options.base_url))
                twin = (clean or "").partition("://")[2].rstrip("/")
                if clean and twin not in seen:
                    seen.add(twin)
                    out.append((len(out) + 1, clean, " ".join(n.text().split())))
        return out

    return per_page(pages, kernel, "page_id bigint, seq int, url string, text string", [_I, _S, _S], html, url, key=key)


def grid(table: Node) -> list[list[str]]:
    """The cells of a table as a full grid: spanned places repeat the cell's text."""
    rows: list[dict[int, str]] = []
    pending: dict[int, tuple[int, str]] = {}
    trs = []
    stack = list(reversed(table.children))
    while stack:
        n = stack.pop()
        if n.tag == "tr":
            trs.append(n)
        elif n.tag != "table":
            stack.extend(reversed(n.children))
    for tr in trs:
        row: dict[int, str] = {c: text for c, (_, text) in pending.items()}
        pending = {c: (left - 1, text) for c, (left, text) in pending.items() if left > 1}
        at = 0
        for cell in (c for c in tr.children if c.tag in ("td", "th")):
            while at in row:
                at += 1
            span = lambda k: min(1000, max(1, int(m[0]))) if (m := re.match(r"\s*\d+", cell.attrs.get(k, ""))) else 1  # noqa: B023, E731
            text = " ".join(to_text(cell).split())
            for c in range(at, at + span("colspan")):
                row[c] = text
                if span("rowspan") > 1:
                    pending[c] = (span("rowspan") - 1, text)
            at += span("colspan")
        rows.append(row)
    width = max((max(r) + 1 for r in rows if r), default=0)
    return [[r.get(c, "") for c in range(width)] for r in rows]


def tables(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Rows of all tables: ``table_no, row_no, cells``."""

    def kernel(text: str | None) -> list[tuple]:
        found = [n for n in parse(text).elements() if n.tag == "table"]
        return [(t, r, cells) for t, n in enumerate(found, 1) for r, cells in enumerate(grid(n), 1)]

    return per_page(pages, kernel, "page_id bigint, table_no int, row_no int, cells array<string>", [_I, _I, pa.list_(_S)], html, key=key)


def metadata_of(document: Node, url: str | None) -> tuple:
    meta: dict[str, str] = {}
    for n in document.elements():
        if n.tag == "meta" and "content" in n.attrs:
            name = (n.attrs.get("property") or n.attrs.get("name") or n.attrs.get("http-equiv") or n.attrs.get("itemprop") or "").lower()
            if name:
                meta.setdefault(name, n.attrs["content"].strip())
    title = document.first("title")
    root = document.first("html")
    rel = {n.attrs.get("rel", "").lower(): n.attrs["href"] for n in document.elements() if n.tag == "link" and n.attrs.get("href")}
    pick = lambda *names: next((meta[k] for k in names if meta.get(k)), None)
    own = " ".join(title.text().split()) if title is not None else None
    return (
        pick("og:title", "twitter:title") or own or None, pick("description", "og:description", "twitter:description"),
        pick("author", "article:author", "dc.creator"), pick("og:site_name", "application-name"),
        (root.attrs.get("lang") if root is not None else None) or pick("og:locale", "content-language"),
        _join(base_of(document, url), rel["canonical"]) if "canonical" in rel else pick("og:url"), pick("og:image", "twitter:image"), list(meta.items()),
    )


def metadata(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """One row per page: title, description, author, site, language, canonical address, image, and all ``meta`` values."""
    schema = "page_id bigint, title string, description string, author string, site string, language string, canonical string, image string, meta map<string,string>"
    return per_page(pages, lambda h, u: [metadata_of(parse(h), u)], schema, [_S] * 7 + [pa.map_(_S, _S)], html, url, key=key)


def _microdata(item: Node, base: str, by_id: dict[str, Node], depth: int = 0) -> dict:
    out: dict = {"type": item.attrs.get("itemtype", "").split(), "properties": {}}
    if "itemid" in item.attrs:
        out["id"] = _join(base, item.attrs["itemid"])
    roots = [*item.children, *(by_id[i] for i in item.attrs.get("itemref", "").split() if i in by_id and by_id[i] is not item)]
    stack = list(reversed(roots))
    while stack:
        n = stack.pop()
        if n.kind != "element":
            continue
        inner = "itemscope" in n.attrs
        for name in n.attrs.get("itemprop", "").split():
            if inner:
                value = _microdata(n, base, by_id, depth + 1) if depth < 32 else {}
            elif n.tag == "meta":
                value = n.attrs.get("content", "")
            elif n.tag in ("a", "area", "link"):
                value = _join(base, n.attrs.get("href", ""))
            elif n.tag in ("img", "audio", "video", "source", "iframe", "embed", "track"):
                value = _join(base, n.attrs.get("src", ""))
            elif n.tag in ("data", "meter"):
                value = n.attrs.get("value", "")
            elif n.tag == "time":
                value = n.attrs.get("datetime", n.text())
            else:
                value = n.text().strip()
            out["properties"].setdefault(name, []).append(value)
        if not inner:
            stack.extend(reversed(n.children))
    return out


def _rdfa(root: Node, base: str) -> list[dict]:
    out: list[dict] = []

    def visit(n: Node, item: dict | None, vocab: str) -> None:
        if n.kind == "element":
            vocab = n.attrs.get("vocab", vocab)
            name = n.attrs.get("property")
            if "typeof" in n.attrs:
                new = {"type": [vocab + t if ":" not in t else t for t in n.attrs["typeof"].split()], "properties": {}}
                if resource := n.attrs.get("resource") or n.attrs.get("about"):
                    new["id"] = _join(base, resource)
                if name and item is not None:
                    item["properties"].setdefault(name, []).append(new)
                else:
                    out.append(new)
                item = new
            elif name and item is not None:
                value = n.attrs.get("content") or n.attrs.get("datetime") or (_join(base, n.attrs.get("href") or n.attrs["src"]) if n.attrs.get("href") or n.attrs.get("src") else n.text().strip())
                item["properties"].setdefault(name, []).append(value)
        for c in n.children:
            visit(c, item, vocab)

    visit(root, None, "")
    return out


def structured_of(document: Node, url: str | None) -> tuple:
    base = base_of(document, url)
    data, opengraph, core = [], {}, {}
    for n in document.elements():
        if n.tag == "script" and n.attrs.get("type", "").split(";")[0].strip().lower() == "application/ld+json":
            try:
                data.append(json.dumps(json.loads(n.text().strip()), ensure_ascii=False, sort_keys=True))
            except ValueError:
                continue
        elif n.tag == "meta" and "content" in n.attrs:
            name = (n.attrs.get("property") or n.attrs.get("name") or "").lower()
            if name.startswith(("og:", "article:", "book:", "profile:", "video:", "music:")):
                opengraph.setdefault(name, n.attrs["content"])
            elif name.startswith(("dc.", "dcterms.")):
                core.setdefault(name, n.attrs["content"])
    by_id = {n.attrs["id"]: n for n in document.elements() if "id" in n.attrs}
    items = [n for n in document.elements() if "itemscope" in n.attrs and "itemprop" not in n.attrs]
    dump = lambda xs: [json.dumps(x, ensure_ascii=False, sort_keys=True) for x in xs]
    return data, dump(_microdata(n, base, by_id) for n in items), list(opengraph.items()), dump(_rdfa(document, base)), list(core.items())


def structured_data(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """JSON-LD, microdata and RDFa items as JSON texts, Open Graph and Dublin Core as maps."""
    schema = "page_id bigint, json_ld array<string>, microdata array<string>, opengraph map<string,string>, rdfa array<string>, dublin_core map<string,string>"
    types = [pa.list_(_S), pa.list_(_S), pa.map_(_S, _S), pa.list_(_S), pa.map_(_S, _S)]
    return per_page(pages, lambda h, u: [structured_of(parse(h), u)], schema, types, html, url, key=key)


# Words in class and id that speak for and against main content.
GOOD = re.compile(r"article|body|content|entry|hentry|h-entry|main|page|post|text|blog|story", re.I)
BAD = re.compile(r"-ad-|hidden|banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget|nav|menu|breadcrumb", re.I)


def _length(n: Node) -> int:
    return len(" ".join(n.text().split()))


def link_density(n: Node) -> float:
    size = _length(n)
    return sum(_length(a) for a in n.elements() if a.tag == "a") / size if size else 0.0


def main_node(document: Node) -> Node | None:
    """The element that holds the main content: paragraphs score for their parents by length and commas."""
    scores: dict[int, float] = {}
    nodes: dict[int, Node] = {}

    def start(n: Node) -> float:
        weight = {"div": 5, "article": 8, "main": 8, "section": 3, "pre": 3, "td": 3, "blockquote": 3}.get(n.tag, 0)
        weight -= {"address": 3, "ol": 3, "ul": 3, "dl": 3, "form": 3, "th": 5, "h1": 5, "h2": 5, "nav": 25, "aside": 25, "footer": 25, "header": 10}.get(n.tag, 0)
        names = n.attrs.get("class", "") + " " + n.attrs.get("id", "")
        return weight + (25 if GOOD.search(names) else 0) - (25 if BAD.search(names) else 0)

    for p in document.elements():
        if p.tag not in ("p", "td", "pre", "section", "h2", "h3") or any(c.kind == "element" and c.tag in BLOCK for c in p.children):
            continue
        text = " ".join(p.text().split())
        if len(text) < 25:
            continue
        score = 1 + text.count(",") + min(len(text) // 100, 3)
        n, level = p.parent, 0
        while n is not None and n.kind == "element" and level < 5:
            if id(n) not in scores:
                scores[id(n)], nodes[id(n)] = start(n), n
            scores[id(n)] += score / (1 if level == 0 else 2 if level == 1 else level * 3)
            n, level = n.parent, level + 1
    if not scores:
        return document.first("body")
    return max(nodes.values(), key=lambda n: (scores[id(n)] * (1 - link_density(n)), -len(n.tag)))


def main_content(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Tag and text of the element with the main content; null for a page without any."""

    def kernel(text: str | None) -> list[tuple]:
        n = main_node(parse(text))
        return [(n.tag if n is not None else None, to_text(n) if n is not None else None)]

    return per_page(pages, kernel, "page_id bigint, tag string, text string", [_S, _S], html, key=key)


@dataclass(frozen=True)
class Article:
    """Main content with what the page says about it."""

    title: str | None
    author: str | None
    published: str | None
    description: str | None
    site: str | None
    language: str | None
    image: str | None
    canonical: str | None
    html: str | None
    text: str | None
    markdown: str | None


def article_of(document: Node, url: str | None) -> Article:
    title, description, author, site, language, canonical, image, meta = metadata_of(document, url)
    if author is None:
        for item in structured_of(document, url)[0]:
            if m := re.search(r'"author": (?:\[?\{[^{}]*"name": "([^"]*)"|"([^"]*)")', item):
                author = m[1] or m[2]
                break
    node = main_node(document)
    whole = lambda f: f(node) if node is not None else None
    return Article(title, author, date_of(document, url, known=meta)[0], description, site, language, image, canonical, whole(serialize), whole(to_text), whole(to_markdown))


def articles(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """One row per page: its main content as HTML, text and Markdown, with title, author, date and the rest of its metadata."""
    names = list(Article.__dataclass_fields__)

    def kernel(text: str | None, address: str | None) -> list[tuple]:
        article = article_of(parse(text), address)
        return [tuple(getattr(article, n) for n in names)]

    return per_page(pages, kernel, "page_id bigint, " + ", ".join(f"{n} string" for n in names), [_S] * len(names), html, url, key=key)


@dataclass(frozen=True)
class Extraction:
    """What counts as boilerplate: blocks shorter than ``min_length``, with more of their text in links than ``max_link_density``,
    or outside the content. ``keep_headings`` false judges headings like other blocks."""

    min_length: int = 25
    max_link_density: float = 0.5
    keep_headings: bool = True

    @classmethod
    def strict(cls) -> Extraction:
        """Limits as usual for text corpora."""
        return cls(70, 0.2)


def boilerplate(pages: DataFrame, options: Extraction = Extraction(), html: str = "html", key: str = "page_id") -> DataFrame:
    """Text blocks with whether they are boilerplate by the options: ``para_no, text, is_boilerplate, is_heading``."""
    o = options

    def kernel(text: str | None) -> list[tuple]:
        rows = paragraphs_of(parse(text), o.min_length, o.max_link_density)
        return [(i, words, poor or heading and not o.keep_headings and len(words) < o.min_length, heading) for i, words, poor, heading in rows]

    return per_page(pages, kernel, "page_id bigint, para_no int, text string, is_boilerplate boolean, is_heading boolean", [_I, _S, _B, _B], html, key=key)


def paragraphs_of(document: Node, shortest: int = 40, density: float = 0.35) -> list[tuple]:
    """Text blocks with whether they are boilerplate and whether they are headings."""
    out: list[list] = []

    def visit(n: Node, heading: bool, nav: bool) -> None:
        run: list[Node] = []

        def flush() -> None:
            words = re.sub(r"[ \t\n\f\r]+", " ", "".join(x.text() if x.kind == "element" else x.data for x in run)).strip(" ")
            if words:
                linked = sum(_length(a) for x in run if x.kind == "element" for a in x.elements() if a.tag == "a")
                poor = nav or "©" in words or "|" in words or linked / len(words) > density or not heading and len(words) < shortest
                out.append([words, poor, heading])
            run.clear()

        for c in n.children:
            if c.kind == "text" or c.kind == "element" and c.tag not in BLOCK and c.tag not in HIDDEN and c.tag != "br" and not any(x.tag in BLOCK for x in c.elements() if x is not c):
                run.append(c)
            elif c.kind == "element" and c.tag not in HIDDEN:
                flush()
                visit(c, c.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), nav or c.tag in ("nav", "footer", "aside", "header"))
        flush()

    if (body := document.first("body")) is not None:
        visit(body, False, False)
    return [(i, *row) for i, row in enumerate(out, 1)]


def paragraphs(pages: DataFrame, shortest: int = 40, density: float = 0.35, html: str = "html", key: str = "page_id") -> DataFrame:
    """Text blocks of each page: ``para_no, text, is_boilerplate, is_heading``."""
    schema = "page_id bigint, para_no int, text string, is_boilerplate boolean, is_heading boolean"
    return per_page(pages, lambda h: paragraphs_of(parse(h), shortest, density), schema, [_I, _S, _B, _B], html, key=key)


_DATE = re.compile(r"(?<!\d)((?:19|20)\d\d)[-/.](0?[1-9]|1[0-2])[-/.](0?[1-9]|[12]\d|3[01])(?!\d)")
# Spelled months of English, German, French and Spanish by their first letters.
_MONTHS = {m: i for i, ms in enumerate(("jan ene", "feb fév fev", "mar mär", "apr avr abr", "may mai", "jun juin", "jul juil", "aug aoû ago", "sep", "oct okt", "nov", "dec dez déc dic"), 1) for m in ms.split()}
_SPELLED = re.compile(r"\b(\d{1,2})(?:st|nd|rd|th|er|\.)?\s+(?:de\s+)?([A-Za-zéûä]{3,10})\.?,?\s+(?:de\s+)?((?:19|20)\d\d)\b|\b([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+((?:19|20)\d\d)\b")
_POINTED = re.compile(r"(?<![\d.])(0?[1-9]|[12]\d|3[01])[./](0?[1-9]|1[0-2])[./]((?:19|20)\d\d)(?!\d)")
# Names of metadata that tell a date; first published, or last changed.
_PUBLISHED = ("article:published_time", "datepublished", "date", "dc.date", "dc.date.issued", "dcterms.created", "dcterms.date", "pubdate", "publishdate", "og:published_time", "sailthru.date", "parsely-pub-date")
_CHANGED = ("article:modified_time", "datemodified", "dcterms.modified", "last-modified", "og:updated_time", "lastmod")


@dataclass(frozen=True)
class DateExtraction:
    """Which date: the first published (``original``) or the last changed where both are said, between ``min_date`` and ``max_date``
    (ISO; today if null), written by ``output_format``. ``extensive_search`` reads the visible text, too."""

    original: bool = True
    output_format: str = "%Y-%m-%d"
    min_date: str = "1995-01-01"
    max_date: str | None = None
    extensive_search: bool = True


def date_of(document: Node, url: str | None, options: DateExtraction = DateExtraction(), known: list[tuple[str, str]] | None = None) -> tuple:
    """The date of a page and what says so: metadata (``known``, if a caller has them), structured data, a time element, the address, or the text."""
    o = options
    last = o.max_date or datetime.date.today().isoformat()

    def pick(text: str | None, spelled: bool = False) -> str | None:
        found = [(m.start(), m[1], m[2], m[3]) for m in _DATE.finditer(text or "")]
        if spelled:
            found += [(m.start(), m[3], m[2], m[1]) for m in _POINTED.finditer(text or "")]
            for m in _SPELLED.finditer(text or ""):
                word = (m[2] or m[4]).lower()
                if month := _MONTHS.get(word[:4]) or _MONTHS.get(word[:3]):
                    found.append((m.start(), m[3] or m[6], month, m[1] or m[5]))
        for _, year, month, day in sorted(found, key=lambda x: x[0]):
            try:
                date = datetime.date(int(year), int(month), int(day))
            except ValueError:
                continue
            if o.min_date <= date.isoformat() <= last:
                return date.strftime(o.output_format)
        return None

    meta = dict(metadata_of(document, url)[7] if known is None else known)
    for name in (*_PUBLISHED, *_CHANGED) if o.original else (*_CHANGED, *_PUBLISHED):
        if found := pick(meta.get(name)):
            return found, f"meta:{name}"
    keys = ("Published", "Created", "Modified") if o.original else ("Modified", "Published", "Created")
    for text in structured_of(document, url)[0]:
        for name in keys:
            if found := pick(" ".join(re.findall(rf'"date{name}": "([^"]*)"', text))):
                return found, "json-ld"
    for n in document.elements():
        if n.tag == "time" and (found := pick(n.attrs.get("datetime") or n.text(), True)):
            return found, "time"
    if found := pick(url):
        return found, "url"
    body = document.first("body")
    found = pick(body.text(), True) if body is not None and o.extensive_search else None
    return found, "text" if found else None


def dates(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", options: DateExtraction = DateExtraction()) -> DataFrame:
    return per_page(pages, lambda h, u: [date_of(parse(h), u, options)], "page_id bigint, date string, signal string", [_S, _S], html, url, key=key)


def form_of(document: Node) -> list[tuple]:
    """Names and values that submitting each form as it stands would send.

    A control belongs to the form that its ``form`` attribute names, else to the one around it; a disabled fieldset disables all
    in it but its first legend; choices in a datalist are none.
    """
    forms = [n for n in document.elements() if n.tag == "form"]
    by_id = {n.attrs["id"]: n for n in reversed(forms) if n.attrs.get("id")}
    number = {id(n): i for i, n in enumerate(forms, 1)}
    out = []

    def visit(n: Node, form: Node | None, off: bool, listed: bool) -> None:
        for c in n.children:
            if c.kind != "element":
                continue
            owner = by_id.get(c.attrs["form"]) if "form" in c.attrs else form
            if owner is not None and not off and not listed and "disabled" not in c.attrs and c.attrs.get("name"):
                out.extend((number[id(owner)], c.attrs["name"], v) for v in field_values(c))
            closed = off
            if c.tag == "fieldset" and "disabled" in c.attrs:
                legend = next((x for x in c.children if x.tag == "legend"), None)
                for x in list(c.children):
                    holder = Node("content")
                    holder.children = [x]
                    visit(holder, form, off or x is not legend, listed)
                continue
            visit(c, c if c.tag == "form" else form, closed, listed or c.tag == "datalist")

    visit(document, None, False, False)
    return sorted(out, key=lambda r: r[0])


def field_values(n: Node) -> list[str]:
    """What a control sends as it stands: nothing, one value, or several."""
    kind = n.attrs.get("type", "").lower()
    if n.tag == "input" and kind not in ("submit", "button", "image", "reset", "file"):
        if kind in ("checkbox", "radio"):
            return [n.attrs.get("value", "on")] if "checked" in n.attrs else []
        return [n.attrs.get("value", "")]
    if n.tag == "textarea":
        return [n.text()]
    if n.tag == "select":
        options = [o for o in n.elements() if o.tag == "option" and "disabled" not in o.attrs]
        chosen = [o for o in options if "selected" in o.attrs] or ([] if "multiple" in n.attrs else options[:1])
        return [o.attrs.get("value", " ".join(o.text().split())) for o in (chosen if "multiple" in n.attrs else chosen[-1:])]
    return []


def labels_of(document: Node) -> list[tuple]:
    """Labels with the control each is for: named by ``for``, else the first control in it."""
    controls = ("input", "select", "textarea", "button", "meter", "output", "progress")
    by_id = {n.attrs["id"]: n for n in reversed(list(document.elements())) if n.attrs.get("id")}
    out = []
    for n in (x for x in document.elements() if x.tag == "label"):
        control = by_id.get(n.attrs["for"]) if "for" in n.attrs else next((x for x in n.elements() if x.tag in controls), None)
        if control is not None and control.tag in controls:
            out.append((len(out) + 1, " ".join(n.text().split()), control.tag, control.attrs.get("name"), control.attrs.get("id")))
    return out


def labels(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """``seq, label, control, name, id``: every label with its control."""
    return per_page(pages, lambda h: labels_of(parse(h)), "page_id bigint, seq int, label string, control string, name string, id string", [_I, _S, _S, _S, _S], html, key=key)


def form_data(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    return per_page(pages, lambda h: form_of(parse(h)), "page_id bigint, form_no int, name string, value string", [_I, _S, _S], html, key=key)


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else ""


# Elements of feeds whose text is markup when it is not escaped.
_FEED_TEXTS = "title|description|summary|content|content:encoded|subtitle|rights|guid|link|author|name|id|pubDate|published|updated|dc:creator|dc:date"


def _repaired(text: str) -> ET.Element | None:
    """A feed that is not well formed: stray ampersands escaped, names of HTML read, controls dropped, texts with markup taken as
    they stand, what is left open closed."""
    if not re.search(r"<(?:rss|feed|rdf:RDF)[\s>]", text[:5_000], re.I):
        return None
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", text)
    text = re.sub(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)", lambda m: "&amp;", re.sub(r"&(?!amp|lt|gt|quot|apos)([A-Za-z][A-Za-z0-9]*);", lambda m: html5.get(m[1] + ";", f"&amp;{m[1]};"), text))

    def plain(m: re.Match) -> str:
        body = m[3]
        if "<![CDATA[" in body or "<" not in body:
            return m[0]
        return f"<{m[1]}{m[2]}>{body.replace('<', '&lt;').replace('>', '&gt;')}</{m[1]}>"

    text = re.sub(rf"<({_FEED_TEXTS})((?:\s[^<>]*)?)(?<!/)>(.*?)</\1\s*>", plain, text, flags=re.S)
    for name in set(re.findall(r"</?([A-Za-z][\w.-]*):", text)) | set(re.findall(r"\s([A-Za-z][\w.-]*):[\w.-]+\s*=", text)):
        if name not in ("xmlns", "xml") and f"xmlns:{name}=" not in text:
            text = re.sub(r"<((?:rss|feed|rdf:RDF))", rf'<\1 xmlns:{name}="urn:{name}"', text, count=1, flags=re.I)
    open_: list[str] = []
    for m in re.finditer(r"<!\[CDATA\[.*?(?:\]\]>|\Z)|<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][\w:.-]*)([^<>]*?)(/?)>", text, re.S):
        if m[2] and not m[4]:
            if not m[1]:
                open_.append(m[2])
            elif m[2] in open_:
                while open_.pop() != m[2]:
                    pass
    text = re.sub(r"<[^<>]*\Z", "", text) + "".join(f"</{t}>" for t in reversed(open_))
    try:
        return ET.fromstring(text)
    except ET.ParseError:
        return None


def feed_of(xml: str | None) -> list[tuple]:
    """Entries of an RSS 2.0, Atom 1.0 or RDF feed, with the feed's own fields; nothing for what is no feed."""
    text_ = (xml or "").strip().removeprefix("﻿")
    try:
        root = ET.fromstring(text_)
    except ET.ParseError:
        root = _repaired(text_)
        if root is None:
            return []
    kind = {"rss": "rss", "feed": "atom", "rdf": "rdf"}.get(_local(root))
    if kind is None:
        return []

    def child(e: ET.Element, *wanted: str) -> ET.Element | None:
        return next((c for w in wanted for c in e if _local(c) == w), None)

    def text(e: ET.Element | None) -> str | None:
        return re.sub(r"[ \t\n\f\r]+", " ", "".join(e.itertext())).strip(" ") or None if e is not None else None

    def link(e: ET.Element) -> str | None:
        if kind != "atom":
            return text(child(e, "link"))
        found = [c for c in e if _local(c) == "link"]
        return next((c.get("href") for c in found if c.get("rel", "alternate") == "alternate"), found[0].get("href") if found else None)

    head = root if kind == "atom" else child(root, "channel")
    head = root if head is None else head
    own = (kind, text(child(head, "title")), link(head), text(child(head, "description", "subtitle")), text(child(head, "updated", "lastbuilddate", "pubdate", "date")))
    entries = [e for e in (root if kind != "rss" else head) if _local(e) in ("item", "entry")]
    out = []
    for i, e in enumerate(entries, 1):
        author = child(e, "author", "creator")
        name = child(author, "name") if author is not None else None
        content = child(e, "encoded", "content")
        ident = text(child(e, "guid", "id")) or next((v for k, v in e.attrib.items() if k.endswith("about")), None)
        out.append((*own, i, text(child(e, "title")), link(e), ident, text(child(e, "updated", "date")), text(child(e, "published", "pubdate")), text(child(e, "summary", "description")), "".join(content.itertext()) if content is not None else None, text(name if name is not None else author)))
    return out or [(*own, *[None] * 9)]


def feed(documents: DataFrame, xml: str = "xml", key: str = "page_id") -> DataFrame:
    """One row per entry of each feed document, with the feed's fields beside it."""
    schema = (
        "page_id bigint, type string, feed_title string, feed_link string, feed_description string, feed_updated string, entry_no int, "
        "title string, link string, id string, updated string, published string, summary string, content string, author string"
    )
    return per_page(documents, feed_of, schema, [_S] * 5 + [_I] + [_S] * 8, xml, key=key)


