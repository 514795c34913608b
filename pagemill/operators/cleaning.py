"""Sanitizing HTML against an allow-list, and turning addresses in text into links."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.markup import Html, Markdown, PlainText, minify, serialize, serialize_with, serialize_xml, to_markdown, to_text
from pagemill.functions.phones import find_phones
from pagemill.sources.nodes import per_page
from pagemill.sources.tree import MATH, SVG, VOID, Node, parse, parse_fragment

# What the basic and the relaxed policy allow.
BASIC_TAGS = frozenset("a abbr acronym b blockquote code em i li ol strong ul".split())
BASIC_ATTRIBUTES = {"a": frozenset(("href", "title")), "abbr": frozenset(("title",)), "acronym": frozenset(("title",))}
SCHEMES = frozenset(("http", "https", "mailto"))
RELAXED_TAGS = BASIC_TAGS | frozenset(
    "p br hr span div pre h1 h2 h3 h4 h5 h6 dl dt dd sub sup del ins mark small u s q cite img figure figcaption table thead tbody tfoot tr th td caption colgroup col".split()
)
RELAXED_ATTRIBUTES = {
    "*": frozenset(("title", "lang", "dir")),
    "a": frozenset(("href", "title", "name")),
    "img": frozenset(("src", "alt", "title", "width", "height")),
    "td": frozenset(("colspan", "rowspan")),
    "th": frozenset(("colspan", "rowspan", "scope")),
    "col": frozenset(("span",)),
    "colgroup": frozenset(("span",)),
}
# Properties of CSS that a style may set.
CSS_PROPERTIES = frozenset(
    "azimuth background-color border-bottom-color border-collapse border-color border-left-color border-right-color border-top-color "
    "clear color cursor direction display elevation float font font-family font-size font-style font-variant font-weight height "
    "letter-spacing line-height overflow pause pause-after pause-before pitch pitch-range richness speak speak-header speak-numeral "
    "speak-punctuation speech-rate stress text-align text-decoration text-indent unicode-bidi vertical-align voice-family volume "
    "white-space width fill fill-opacity fill-rule stroke stroke-width stroke-linecap stroke-linejoin stroke-opacity".split()
)
# Elements that no policy can allow.
UNSAFE = frozenset(
    "script iframe embed object noscript noembed noframes base basefont title plaintext xmp template frame frameset animate animatecolor animatemotion animatetransform set".split()
)
# Attributes that hold addresses, and elements with embedded media.
ADDRESSES = frozenset("href src cite data ping action poster longdesc formaction background xlink:href srcset imagesrcset codebase dynsrc lowsrc manifest".split())
MEDIA = frozenset("audio video source track".split())
# Schemes that run code, and names with a hyphen that are no custom elements.
SCRIPTING = frozenset("javascript vbscript livescript mocha".split())
RESERVED = frozenset("annotation-xml color-profile font-face font-face-src font-face-uri font-face-format font-face-name missing-glyph".split())
ESCAPE, STRIP, REMOVE = "escape", "strip", "remove"


@dataclass(frozen=True)
class Transform:
    """Another name, and attributes to add, for an element; what comes of it is judged like any other."""

    tag: str
    attributes: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Policy:
    """What a sanitized page may contain.

    Whatever is allowed, elements and addresses that run code, ``on...`` attributes and dangerous styles go. An element that
    is not allowed is shown as text (``escape``), gives way to its children (``strip``) or goes with them (``remove``).
    ``attributes`` are by element, ``*`` for every element and, as a name, for every attribute. Functions must be picklable,
    they run on the workers.
    """

    tags: frozenset[str] = BASIC_TAGS
    attributes: Mapping[str, frozenset[str]] = field(default_factory=lambda: BASIC_ATTRIBUTES)
    url_schemes: frozenset[str] = SCHEMES
    allow_relative_urls: bool = True
    allow_fragment_urls: bool = False
    on_disallowed_tag: str = ESCAPE
    strip_comments: bool = True
    add_link_rel: frozenset[str] = frozenset()
    attribute_filter: Callable[[str, str, str], str | None] | None = None
    set_attributes: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    remove_with_content: frozenset[str] = frozenset()
    css_properties: frozenset[str] = CSS_PROPERTIES
    attribute_prefixes: frozenset[str] = frozenset()
    attribute_values: Mapping[str, Mapping[str, frozenset[str]]] = field(default_factory=dict)
    media_hosts: frozenset[str] = frozenset()
    strip_template_markers: bool = False
    allowed_styles: Mapping[str, Mapping[str, Sequence[str]]] = field(default_factory=dict)
    transform_tags: Mapping[str, Transform | str] = field(default_factory=dict)
    isolate_named_props: bool = False
    custom_element_check: Callable[[str], bool] | None = None
    custom_attribute_check: Callable[[str, str], bool] | None = None
    allow_customized_builtins: bool = False
    allow_html: bool = True
    allow_svg: bool = True
    allow_mathml: bool = True
    xml: bool = False
    attribute_predicate: Callable[[str, str, str], bool] | None = None
    #: Check only the attributes href, src and the like of HTML 4, as an older sanitizer did.
    only_classic_urls: bool = False

    @classmethod
    def strict(cls) -> Policy:
        """No element and no attribute."""
        return cls(tags=frozenset(), attributes={})

    @classmethod
    def basic(cls) -> Policy:
        """Inline marks, links, lists and quotes."""
        return cls()

    @classmethod
    def relaxed(cls) -> Policy:
        """Also headings, tables, images and figures; links get ``rel``."""
        return cls(tags=RELAXED_TAGS, attributes=RELAXED_ATTRIBUTES, add_link_rel=frozenset(("noopener", "noreferrer")))


#: What pages become that are to stay readable: the relaxed set, everything else gives way, code goes with its content.
READABLE = replace(
    Policy.relaxed(), on_disallowed_tag=STRIP, remove_with_content=UNSAFE | frozenset("style svg math textarea select option head".split()) - {"template"}, url_schemes=SCHEMES | {"tel"}
)
_BLANK = re.compile(r"[\x00-\x20\x7f-\xa0\u200b-\u200f\u2028\u2029\ufeff]")
_TEMPLATE = re.compile(r"\{\{.*?\}\}|\$\{.*?\}|<%.*?%>", re.S)
_REFRESH = re.compile(r"^[\s\d.]*[;,]?\s*(?:url\s*=\s*)?['\"]?(.*?)['\"]?\s*$", re.I | re.S)


def _scheme(value: str) -> str | None:
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", _BLANK.sub("", value))
    return m[1].lower() if m else None


def safe_url(value: str, policy: Policy) -> bool:
    """Whether one address has a scheme that is allowed, or none where those are."""
    scheme = _scheme(value)
    if scheme is not None:
        return scheme in policy.url_schemes and scheme not in SCRIPTING
    bare = _BLANK.sub("", value)
    return policy.allow_relative_urls or policy.allow_fragment_urls and bare.startswith("#")


def _safe_urls(name: str, value: str, policy: Policy) -> bool:
    if name in ("srcset", "imagesrcset"):
        return all(safe_url(p.split()[0], policy) for p in re.split(r",\s+|,$", value) if p.strip())
    return all(safe_url(p, policy) for p in value.split() or [""]) if name == "ping" else safe_url(value, policy)


_CSS_PART = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|\\.|[^;{}()\"'/\\]+|.", re.S)
_CSS_ESCAPE = re.compile(r"\\([0-9A-Fa-f]{1,6})\s?|\\(.)", re.S)


def _css_plain(value: str) -> str:
    """A value with its escapes read and without strings and comments, for judging what it calls."""
    value = re.sub(r"/\*.*?(?:\*/|\Z)", "", value, flags=re.S)
    return _CSS_ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] and 0 < int(m[1], 16) < 0x110000 else m[2] or "", value)


def _safe_value(value: str, policy: Policy) -> bool:
    plain = _css_plain(value)
    outside = re.sub(r"\"[^\"]*\"?|'[^']*'?", "''", plain).lower()
    if re.search(r"expression\s*\(|javascript\s*:|-moz-binding|behaviou?r\s*:|@import", outside) or "\x00" in plain:
        return False
    return all(safe_url(m[1].strip().strip("'\""), policy) for m in re.finditer(r"(?:url|image|image-set)\s*\(([^)]*)\)?", plain, re.I))


def declarations(style: str) -> list[tuple[str, str]]:
    """Property names (lower case) and values of a style; pieces that are no declaration are left out."""
    parts, now, depth = [], "", 0
    for m in _CSS_PART.finditer(style):
        if m[0] == ";" and depth <= 0:
            parts.append(now)
            now = ""
            continue
        depth += (m[0] == "(") - (m[0] == ")")
        now += m[0]
    found = []
    for part in [*parts, now]:
        name, colon, value = re.sub(r"^\s*(?:/\*.*?\*/\s*)*", "", part, flags=re.S).partition(":")
        if colon and value.strip() and re.fullmatch(r"\s*-{0,2}[A-Za-z][\w-]*\s*", _css_plain(name)):
            found.append((_css_plain(name).strip().lower(), value.strip()))
    return found


def clean_style(style: str, tag: str, policy: Policy, inline: bool = True) -> list[str]:
    """The declarations that the policy allows."""
    rules: dict[str, list] = {}
    for key in ("*", tag):
        for name, patterns in policy.allowed_styles.get(key, {}).items():
            rules.setdefault(name.lower(), []).extend(patterns)
    kept = []
    for name, value in declarations(style):
        narrowed = not (inline and policy.allowed_styles) or any(re.search(p, value) for p in rules.get(name, ()))
        if name in policy.css_properties and narrowed and name not in ("behavior", "-moz-binding") and _safe_value(value, policy):
            kept.append(f"{name}: {value}")
    return kept


def clean_sheet(css: str, policy: Policy) -> str:
    """A style sheet with only allowed declarations; selectors and nesting stay, at-rules that load others go."""
    out, now, depth = "", "", 0
    for m in _CSS_PART.finditer(css):
        sign = m[0]
        if depth <= 0 and sign == "{":
            out += re.sub(r"\s+", " ", now).strip() + "{"
            now = ""
        elif depth <= 0 and sign == "}":
            out += "".join(f"{d.replace(': ', ':', 1)};" for d in clean_style(now, "style", policy, inline=False)) + "}"
            now = ""
        elif depth <= 0 and sign == ";" and now.lstrip().startswith("@"):
            now = ""
        elif sign.startswith("/*"):
            continue
        else:
            depth += (sign == "(") - (sign == ")")
            now += sign
    return out.replace("</", "<\\/")


class Cleaner:
    """Builds the tree of what a policy allows."""

    def __init__(self, policy: Policy) -> None:
        self.policy = policy
        self.removed: list[tuple[str, str | None]] = []

    def kept(self, n: Node) -> bool:
        p = self.policy
        allowed = {SVG: p.allow_svg, MATH: p.allow_mathml}.get(n.ns, p.allow_html)
        if n.tag.lower() in UNSAFE or not allowed:
            return False
        if n.tag in p.tags:
            return True
        custom = n.ns not in (SVG, MATH) and re.fullmatch(r"[a-z][^\s/>]*-[^\s/>]*", n.tag) and n.tag not in RESERVED
        return bool(custom and p.custom_element_check and p.custom_element_check(n.tag))

    def listed(self, tag: str, name: str) -> bool:
        p = self.policy
        names = p.attributes.get("*", frozenset()) | p.attributes.get(tag, frozenset())
        if name in names or "*" in names or any(name.startswith(x) for x in p.attribute_prefixes):
            return True
        return bool("-" in tag and tag not in p.tags and p.custom_attribute_check and p.custom_attribute_check(tag, name))

    def safe(self, n: Node, tag: str, name: str, value: str) -> str | None:
        """The value as it may stand, or null."""
        p, low = self.policy, name.lower()
        if low.startswith("on") or low == "srcdoc":
            return None
        if low in ADDRESSES and not (p.only_classic_urls and low not in ("href", "src", "cite", "action", "longdesc", "background")) and not _safe_urls(low, value, p):
            return None
        if low == "src" and tag in MEDIA and p.media_hosts:
            host = urlsplit(_BLANK.sub("", value)).hostname
            if host is not None and host not in p.media_hosts:
                return None
        if low == "content" and tag == "meta" and n.attrs.get("http-equiv", "").strip().lower() == "refresh" and (m := _REFRESH.match(value)) and m[1] and not safe_url(m[1], p):
            return None
        if low == "is":
            return value if p.allow_customized_builtins and p.custom_element_check and p.custom_element_check(value) else None
        if low == "style":
            value = "; ".join(clean_style(value, tag, p))
            if not value:
                return None
        if p.strip_template_markers:
            value = _TEMPLATE.sub(" ", value)
        values = p.attribute_values.get(tag, {}).get(name)
        if values is not None and value not in values:
            return None
        if p.isolate_named_props and low in ("id", "name") and not value.startswith("user-content-"):
            value = f"user-content-{value}"
        return value

    def attributes(self, n: Node, copy: Node, extra: Mapping[str, str]) -> None:
        p, tag = self.policy, copy.tag
        for name, given in {**n.attrs, **extra}.items():
            value: str | None = given
            if p.attribute_predicate and not p.attribute_predicate(tag, name, given):
                value = None
            elif not (self.listed(tag, name) or name == "is" and p.allow_customized_builtins):
                value = None
            else:
                value = self.safe(n, tag, name, given)
                if value is not None and p.attribute_filter:
                    value = p.attribute_filter(tag, name, value)
                    value = self.safe(n, tag, name, value) if value is not None else None
            if value is None:
                self.removed.append((tag, name))
            else:
                copy.attrs[name] = value
        for name, given in p.set_attributes.get(tag, {}).items():
            if (value := self.safe(n, tag, name, given)) is not None:
                copy.attrs[name] = value
        if tag == "a" and "href" in copy.attrs and p.add_link_rel:
            tokens = copy.attrs.get("rel", "").split()
            copy.attrs["rel"] = " ".join([*tokens, *sorted(p.add_link_rel - set(tokens))])

    def element(self, n: Node, target: Node) -> None:
        p = self.policy
        tag, extra = n.tag, {}
        rule = p.transform_tags.get(n.tag) if n.ns not in (SVG, MATH) else None
        if rule is not None:
            tag, extra = (rule, {}) if isinstance(rule, str) else (rule.tag, rule.attributes)
        judged = Node("element", tag, n.ns, n.attrs)
        if self.kept(judged):
            copy = Node("element", tag, n.ns)
            self.attributes(n, copy, extra)
            target.append(copy)
            if tag == "style":
                copy.append(Node("text", data=clean_sheet(n.text(), p)))
            else:
                self.visit((n.content or n).children, copy)
            return
        self.removed.append((n.tag, None))
        if tag in p.remove_with_content or p.on_disallowed_tag == REMOVE:
            return
        if p.on_disallowed_tag == STRIP or n.implied:
            self.visit((n.content or n).children, target)
            return
        attrs = "".join(f' {k}="{html.escape(v, quote=False)}"' if v else f" {k}" for k, v in n.attrs.items())
        target.append(Node("text", data=f"<{n.tag}{attrs}>"))
        self.visit((n.content or n).children, target)
        if n.end is not None and n.tag not in VOID:
            target.append(Node("text", data=f"</{n.tag}>"))

    def visit(self, source: list[Node], target: Node) -> None:
        for n in source:
            if n.kind == "text":
                target.append(Node("text", data=_TEMPLATE.sub(" ", n.data) if self.policy.strip_template_markers else n.data))
            elif n.kind == "element":
                self.element(n, target)
            elif n.kind == "comment":
                if self.policy.strip_comments or target.tag in ("textarea", "style"):
                    self.removed.append(("#comment", None))
                else:
                    target.append(Node("comment", data=n.data.replace("--", "- -").replace(">", "&gt;")))

    def run(self, nodes: list[Node]) -> Node:
        root = Node("element", "div")
        self.visit(nodes, root)
        return root


def sanitize_tree(nodes: list[Node], policy: Policy, removed: list[tuple[str, str | None]]) -> Node:
    """A tree of what the policy allows."""
    cleaner = Cleaner(policy)
    root = cleaner.run(nodes)
    removed += cleaner.removed
    return root


def sanitize(pages: DataFrame, policy: Policy | None = None, html: str = "html", key: str = "page_id") -> DataFrame:
    """``clean`` HTML and what was ``removed``, in the order it was met; null stays an empty fragment."""
    rules = policy or Policy()

    def kernel(text: str | None) -> list[tuple]:
        removed: list[tuple[str, str | None]] = []
        root = sanitize_tree(parse_fragment(text), rules, removed)
        clean = serialize_xml(root, inner=True) if rules.xml else serialize(root, inner=True)
        return [(clean, [{"tag": t, "attribute": a} for t, a in removed])]

    kind = pa.list_(pa.struct([("tag", pa.string()), ("attribute", pa.string())]))
    return per_page(pages, kernel, "page_id bigint, clean string, removed array<struct<tag:string,attribute:string>>", [pa.string(), kind], html, key=key)


def render(pages: DataFrame, form: str, html: str = "html", key: str = "page_id", options: Markdown | PlainText | Html | None = None) -> DataFrame:
    """``rendered``: the page as ``text``, ``markdown``, ``html`` (serialized again) or ``minified``; all but the last take options."""
    how = _renderer(form, options)
    return per_page(pages, lambda h: [(how(parse(h)),)], "page_id bigint, rendered string", [pa.string()], html, key=key)


def _renderer(form: str, options: Markdown | PlainText | Html | None) -> Callable[[Node], str]:
    return {
        "text": lambda n: to_text(n, options),
        "markdown": lambda n: to_markdown(n, options),
        "html": lambda n: serialize_with(n, options) if options else serialize(n),
        "minified": minify,
    }[form]


def render_many(pages: DataFrame, form: str, options: dict[str, Markdown | PlainText | None], html: str = "html", key: str = "page_id") -> DataFrame:
    """``rendered`` by each of several named options (``form``), as by :func:`render`; a page is parsed once. Only for ``text`` and
    ``markdown``, which leave the tree as it is."""
    if form not in ("text", "markdown"):
        raise ValueError(f"{form} may change the tree")
    hows = [(name, _renderer(form, o)) for name, o in options.items()]

    def kernel(text: str | None) -> list[tuple]:
        document = parse(text)
        return [(how(document), name) for name, how in hows]

    return per_page(pages, kernel, "page_id bigint, rendered string, form string", [pa.string(), pa.string()], html, key=key)


# Top-level domains that a bare host name needs.
TLDS = "com org net edu gov mil int info biz io dev app eu uk de fr es it pl pt ru nl be at ch se no dk fi cz us ca au jp cn br mx in co me tv cc ai xyz online site shop tech blog news example test".split()


@dataclass(frozen=True)
class Linkify:
    """What becomes a link: addresses of ``schemes``, host names under known and ``extra_tlds``, mailboxes (``parse_email``) and
    telephone numbers of ``phones`` (regions). Each of ``callbacks`` gets the attributes and the text of a link and gives
    attributes back, or null for no link. Text in ``skip_tags`` stays; ``process_existing`` sends links that are there through
    the callbacks, too."""

    callbacks: tuple[Callable[[dict[str, str], str], dict[str, str] | None], ...] = ()
    skip_tags: frozenset[str] = frozenset(("pre", "code", "script", "style", "textarea"))
    parse_email: bool = True
    process_existing: bool = False
    extra_tlds: frozenset[str] = frozenset()
    schemes: frozenset[str] = frozenset(("http", "https", "ftp"))
    phones: tuple[str, ...] | None = None


def nofollow(attrs: dict[str, str], text: str) -> dict[str, str]:
    """Adds ``rel=nofollow`` to links other than mailboxes."""
    if attrs.get("href", "").startswith("mailto:"):
        return attrs
    rel = attrs.get("rel", "").split()
    return attrs | {"rel": " ".join(rel if "nofollow" in rel else [*rel, "nofollow"])}


def target_blank(attrs: dict[str, str], text: str) -> dict[str, str]:
    return attrs if attrs.get("href", "").startswith("mailto:") else attrs | {"target": "_blank"}


@cache
def _link_pattern(options: Linkify) -> re.Pattern:
    tlds = "|".join(sorted({*TLDS, *options.extra_tlds}, key=lambda t: (-len(t), t)))
    label = r"[^\W_](?:[\w-]*[^\W_])?"
    return re.compile(
        rf"(?P<mail>(?<![\w.+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{{2,}})|(?P<url>\b(?:{'|'.join(sorted(options.schemes))})://[^\s<>\"“”]+)"
        rf"|(?P<bare>(?<![@\w.-])(?<!//)(?:www\.)?(?:{label}\.)+(?:{tlds})(?![\w-])(?!\.\w)(?::\d+)?(?:/[^\s<>\"“”]*)?)",
        re.I,
    )


def find_links(text: str | None, options: Linkify = Linkify()) -> list[dict]:
    """Addresses in plain text with their places; punctuation after one is not part of it, nor an unbalanced bracket."""
    out = []
    for m in _link_pattern(options).finditer(text or ""):
        kind = m.lastgroup
        if kind == "mail" and not options.parse_email:
            continue
        found = m[0]
        if kind != "mail":
            while found and (found[-1] in ".,;:!?'*" or found[-1] in ")]" and found.count(found[-1]) > found.count("(" if found[-1] == ")" else "[")):
                found = found[:-1]
        url = f"mailto:{found}" if kind == "mail" else found if kind == "url" else f"http://{found}"
        out.append({"start": m.start(), "end": m.start() + len(found), "text": found, "url": url, "is_email": kind == "mail"})
    if options.phones is not None:
        for start, end, spelled, phone in find_phones(text, options.phones):
            if all(end <= x["start"] or start >= x["end"] for x in out):
                out.append({"start": start, "end": end, "text": spelled, "url": phone.format("rfc3966"), "is_email": False})
        out.sort(key=lambda x: x["start"])
    return out


def has_link(text: str | None, options: Linkify = Linkify()) -> bool:
    return bool(find_links(text, options))


LINK_SPANS = "array<struct<start:int,end:int,text:string,url:string,is_email:boolean>>"


def _anchor(link: dict, options: Linkify) -> dict[str, str] | None:
    attrs: dict[str, str] | None = {"href": link["url"]}
    for callback in options.callbacks:
        attrs = callback(attrs, link["text"]) if attrs is not None else None
    return attrs


def linkify(df: DataFrame, text: str, options: Linkify = Linkify()) -> DataFrame:
    """Add ``links``, the addresses found in column ``text``, and ``linked``, the escaped text with them as anchors.

    Null gives no links and null; other columns stay, input columns named like the outputs are replaced.
    """
    columns = [c for c in df.columns if c not in ("links", "linked")]
    at = columns.index(text)
    schema = T.StructType([*[df.schema[c] for c in columns], *df.sparkSession.createDataFrame([], f"links {LINK_SPANS}, linked string").schema])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("url", pa.string()), ("is_email", pa.bool_())]))

    def linked(value: str | None, found: list[dict]) -> str | None:
        if value is None:
            return None
        out, begin = "", 0
        for x in found:
            attrs = _anchor(x, options)
            out += html.escape(value[begin : x["start"]])
            written = "".join(f' {k}="{html.escape(v)}"' for k, v in (attrs or {}).items())
            out += f"<a{written}>{html.escape(x['text'])}</a>" if attrs is not None else html.escape(x["text"])
            begin = x["end"]
        return out + html.escape(value[begin:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(at).to_pylist()
            found = [find_links(v, options) for v in values]
            new = [pa.array(found, kind), pa.array([linked(v, f) for v, f in zip(values, found, strict=True)], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def linkify_tree(root: Node, options: Linkify = Linkify()) -> None:
    """Turn the addresses in the texts of a tree into anchors, in place."""
    for n in [x for x in root.walk() if x.kind == "text"]:
        above, skip = n.parent, False
        while above is not None and not skip:
            skip = above.tag == "a" or above.tag in options.skip_tags
            above = above.parent
        if skip or n.parent is None:
            continue
        parent, begin = n.parent, 0
        at = next(i for i, c in enumerate(parent.children) if c is n)
        pieces: list[Node] = []
        for x in find_links(n.data, options):
            if (attrs := _anchor(x, options)) is not None:
                pieces.append(Node("text", data=n.data[begin : x["start"]]))
                link = Node("element", "a", attrs=attrs)
                link.append(Node("text", data=x["text"]))
                pieces.append(link)
                begin = x["end"]
        if pieces:
            pieces.append(Node("text", data=n.data[begin:]))
            n.remove()
            for i, p in enumerate(p for p in pieces if p.kind != "text" or p.data):
                parent.insert(at + i, p)
    if options.process_existing:
        for n in [x for x in root.elements() if x.tag == "a" and "href" in x.attrs]:
            attrs: dict[str, str] | None = dict(n.attrs)
            for callback in options.callbacks:
                attrs = callback(attrs, n.text()) if attrs is not None else None
            if attrs is not None:
                n.attrs = attrs
            else:  # the link gives way to its content
                at = next(i for i, c in enumerate(n.parent.children) if c is n)
                for i, c in enumerate(list(n.children)):
                    n.parent.insert(at + i, c)
                n.remove()


def linkify_pages(pages: DataFrame, options: Linkify = Linkify(), html: str = "html", key: str = "page_id") -> DataFrame:
    """``linked``: fragments of HTML with the addresses in their texts as anchors; null stays empty."""

    def kernel(text: str | None) -> list[tuple]:
        root = Node("element", "div")
        for n in parse_fragment(text):
            root.append(n)
        linkify_tree(root, options)
        return [(serialize(root, inner=True),)]

    return per_page(pages, kernel, "page_id bigint, linked string", [pa.string()], html, key=key)
