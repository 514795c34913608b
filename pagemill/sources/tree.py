"""HTML tree construction by the WHATWG insertion modes, for one page at a time."""

from __future__ import annotations

import re

from pagemill.sources.tokens import RAWTEXT, RCDATA, WHITE, Token, Tokenizer

HTML, SVG, MATH = "html", "svg", "math"


class Node:
    """One node; ``kind`` is document, element, text, comment or doctype."""

    __slots__ = ("attrs", "children", "content", "data", "end", "implied", "kind", "ns", "parent", "start", "tag")

    def __init__(self, kind: str, tag: str = "", ns: str = HTML, attrs: dict[str, str] | None = None, data: str = "") -> None:
        self.kind, self.tag, self.ns, self.data = kind, tag, ns, data
        self.attrs = attrs if attrs is not None else {}
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.implied = False
        self.content: Node | None = None  # of a template
        self.start: tuple[int, int] | None = None  # where its start tag, or the node itself, stands in the source (line ends as \n)
        self.end: tuple[int, int] | None = None  # where its end tag stands

    def append(self, child: Node) -> None:
        child.remove()
        child.parent = self
        self.children.append(child)

    def insert(self, at: int, child: Node) -> None:
        child.remove()
        child.parent = self
        self.children.insert(at, child)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None

    def walk(self):
        """The node and everything below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def elements(self):
        stack = [self]
        while stack:
            node = stack.pop()
            if node.kind == "element":
                yield node
            if node.children:
                stack.extend(node.children[::-1])

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if node.kind == "text":
                out.append(node.data)
            if node.children:
                stack.extend(node.children[::-1])
        return "".join(out)

    def first(self, tag: str) -> Node | None:
        return next((n for n in self.elements() if n.tag == tag), None)


def _set(names: str) -> frozenset[str]:
    return frozenset(names.split())


# The element groups of the standard.
VOID = _set("area base br col embed hr img input link meta param source track wbr")
SPECIAL = _set(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details "
    "dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext "
    "pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp"
)
FORMATTING = _set("a b big code em font i nobr s small strike strong tt u")
IMPLIED_END = _set("dd dt li optgroup option p rb rp rt rtc")
THOROUGH = IMPLIED_END | _set("caption colgroup tbody td tfoot th thead tr")
SCOPE = _set("applet caption html table td th marquee object template")
FOREIGN_SCOPE = {MATH: _set("mi mo mn ms mtext annotation-xml"), SVG: _set("foreignObject desc title")}
BLOCKS = _set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main "
    "menu nav ol p search section summary ul"
)
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
TABLE_PARTS = _set("caption col colgroup tbody td tfoot th thead tr")
BREAKOUT = _set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
    "ruby s small span strong strike sub sup table tt u ul var"
)
SVG_TAGS = {
    t.lower(): t
    for t in (
        "altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix "
        "feComponentTransfer feComposite feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood "
        "feFuncA feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight "
        "feSpecularLighting feSpotLight feTile feTurbulence foreignObject glyphRef linearGradient radialGradient textPath"
    ).split()
}
SVG_ATTRS = {
    t.lower(): t
    for t in (
        "attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits glyphRef "
        "gradientTransform gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust limitingConeAngle "
        "markerHeight markerUnits markerWidth maskContentUnits maskUnits numOctaves pathLength patternContentUnits patternTransform "
        "patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha preserveAspectRatio primitiveUnits refX refY repeatCount repeatDur "
        "requiredExtensions requiredFeatures specularConstant specularExponent spreadMethod startOffset stdDeviation stitchTiles "
        "surfaceScale systemLanguage tableValues targetX targetY textLength viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan"
    ).split()
}
# Public identifiers of doctypes that put a page into quirks mode, by their beginnings (lower case).
QUIRKY_PUBLIC = (
    "+//silmaril//dtd html pro v0r11 19970101//",
    "-//as//dtd html 3.0 aswedit + extensions//",
    "-//advasoft ltd//dtd html 3.0 aswedit + extensions//",
    "-//ietf//dtd html 2.0 level 1//",
    "-//ietf//dtd html 2.0 level 2//",
    "-//ietf//dtd html 2.0 strict level 1//",
    "-//ietf//dtd html 2.0 strict level 2//",
    "-//ietf//dtd html 2.0 strict//",
    "-//ietf//dtd html 2.0//",
    "-//ietf//dtd html 2.1e//",
    "-//ietf//dtd html 3.0//",
    "-//ietf//dtd html 3.2 final//",
    "-//ietf//dtd html 3.2//",
    "-//ietf//dtd html 3//",
    "-//ietf//dtd html level 0//",
    "-//ietf//dtd html level 1//",
    "-//ietf//dtd html level 2//",
    "-//ietf//dtd html level 3//",
    "-//ietf//dtd html strict level 0//",
    "-//ietf//dtd html strict level 1//",
    "-//ietf//dtd html strict level 2//",
    "-//ietf//dtd html strict level 3//",
    "-//ietf//dtd html strict//",
    "-//ietf//dtd html//",
    "-//metrius//dtd metrius presentational//",
    "-//microsoft//dtd internet explorer 2.0 html strict//",
    "-//microsoft//dtd internet explorer 2.0 html//",
    "-//microsoft//dtd internet explorer 2.0 tables//",
    "-//microsoft//dtd internet explorer 3.0 html strict//",
    "-//microsoft//dtd internet explorer 3.0 html//",
    "-//microsoft//dtd internet explorer 3.0 tables//",
    "-//netscape comm. corp.//dtd html//",
    "-//netscape comm. corp.//dtd strict html//",
    "-//o'reilly and associates//dtd html 2.0//",
    "-//o'reilly and associates//dtd html extended 1.0//",
    "-//o'reilly and associates//dtd html extended relaxed 1.0//",
    "-//sq//dtd html 2.0 hotmetal + extensions//",
    "-//softquad software//dtd hotmetal pro 6.0::19990601::extensions to html 4.0//",
    "-//softquad//dtd hotmetal pro 4.0::19971010::extensions to html 4.0//",
    "-//spyglass//dtd html 2.0 extended//",
    "-//sun microsystems corp.//dtd hotjava html//",
    "-//sun microsystems corp.//dtd hotjava strict html//",
    "-//w3c//dtd html 3 1995-03-24//",
    "-//w3c//dtd html 3.2 draft//",
    "-//w3c//dtd html 3.2 final//",
    "-//w3c//dtd html 3.2//",
    "-//w3c//dtd html 3.2s draft//",
    "-//w3c//dtd html 4.0 frameset//",
    "-//w3c//dtd html 4.0 transitional//",
    "-//w3c//dtd html experimental 19960712//",
    "-//w3c//dtd html experimental 970421//",
    "-//w3c//dtd w3 html//",
    "-//w3o//dtd w3 html 3.0//",
    "-//webtechs//dtd mozilla html 2.0//",
    "-//webtechs//dtd mozilla html//",
)
# The same, whole; the same, where there is no system identifier; and a system identifier.
QUIRKY_WHOLE = ("-//w3o//dtd w3 html strict 3.0//en//", "-/w3c/dtd html 4.0 transitional/en", "html")
QUIRKY_ALONE = ("-//w3c//dtd html 4.01 frameset//", "-//w3c//dtd html 4.01 transitional//")
QUIRKY_SYSTEM = "http://www.ibm.com/data/dtd/v11/ibmxhtml1-transitional.dtd"


class Builder:
    """Builds the document of one page."""

    def __init__(self, text: str, fragment: str | None = None) -> None:
        self.tokens = Tokenizer(text)
        self.document = Node("document")
        self.open: list[Node] = []
        self.active: list[Node | None] = []  # formatting elements; None is a marker
        self.head: Node | None = None
        self.form: Node | None = None
        self.mode = self.initial
        self.original = self.initial
        self.templates: list = []
        self.quirks = False
        self.foster = False
        self.pending: list[str] = []
        self.skip_newline = False
        self.framesets = True
        self.span: tuple[int, int] | None = None
        self.stray: list[tuple[str, tuple[int, int]]] = []  # end tags that close nothing
        self.context: Node | None = None
        if fragment is not None:
            self.context = Node("element", fragment)
            root = Node("element", "html")
            self.document.append(root)
            self.open.append(root)
            if fragment in RCDATA | RAWTEXT or fragment in ("script", "plaintext"):
                self.tokens.raw = fragment
            if fragment == "template":
                self.templates.append(self.in_template)
            self.reset_mode()

    def run(self) -> Node:
        for token in self.tokens:
            self.span = (token.at, self.tokens.at)
            if token.kind == "end":
                self.end_tag(token)
            else:
                self.handle(token)
            self.tokens.foreign = bool(self.open) and self.current().ns != HTML
        self.handle(Token("eof", at=len(self.tokens.text)))
        return self.document

    def end_tag(self, t: Token) -> None:
        """Handle an end tag and note it at the element that it closes."""
        span = self.span
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i].tag.lower() == t.data), -1)
        wanted = self.open[at] if at >= 0 else None
        self.handle(t)
        if wanted is not None and (len(self.open) <= at or self.open[at] is not wanted):
            wanted.end = span
        elif wanted is None:
            self.stray.append((t.data, span))

    # -- helpers ---------------------------------------------------------------------------------------------------

    def current(self) -> Node:
        return self.open[-1]

    def handle(self, t: Token) -> None:
        if t.kind == "text":
            if self.skip_newline:
                self.skip_newline = False
                if t.data.startswith("\n"):
                    t.data = t.data[1:]
            if not t.data:
                return
        else:
            self.skip_newline = False
        if self.use_foreign(t):
            self.in_foreign(t)
        else:
            self.mode(t)

    def use_foreign(self, t: Token) -> bool:
        if not self.open or t.kind == "eof":
            return False
        node = self.context if self.context and len(self.open) == 1 else self.current()
        if node.ns == HTML:
            return False
        if self.math_text(node) and (t.kind == "text" or t.kind == "start" and t.data not in ("mglyph", "malignmark")):
            return False
        if node.ns == MATH and node.tag == "annotation-xml" and t.kind == "start" and t.data == "svg":
            return False
        return not (self.html_point(node) and t.kind in ("start", "text"))

    @staticmethod
    def math_text(n: Node) -> bool:
        return n.ns == MATH and n.tag in ("mi", "mo", "mn", "ms", "mtext")

    @staticmethod
    def html_point(n: Node) -> bool:
        if n.ns == SVG:
            return n.tag in ("foreignObject", "desc", "title")
        return n.ns == MATH and n.tag == "annotation-xml" and n.attrs.get("encoding", "").lower() in ("text/html", "application/xhtml+xml")

    def place(self, target: Node | None = None) -> tuple[Node, int]:
        """Parent and index at which the next node goes."""
        target = target or self.current()
        if self.foster and target.ns == HTML and target.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            for i in range(len(self.open) - 1, -1, -1):
                n = self.open[i]
                if n.tag == "template" and n.ns == HTML:
                    return n.content, len(n.content.children)
                if n.tag == "table" and n.ns == HTML:
                    if n.parent is not None:
                        return n.parent, n.parent.children.index(n)
                    return self.open[i - 1], len(self.open[i - 1].children)
            return self.open[0], len(self.open[0].children)
        if target.content is not None:
            return target.content, len(target.content.children)
        return target, len(target.children)

    def put_text(self, data: str) -> None:
        parent, at = self.place()
        if parent.kind == "document":
            return
        if at and parent.children[at - 1].kind == "text":
            before = parent.children[at - 1]
            before.data += data
            if before.start and self.span and before.start[1] == self.span[0]:
                before.start = (before.start[0], self.span[1])
        else:
            node = Node("text", data=data)
            node.start = self.span
            parent.insert(at, node)

    def put_comment(self, t: Token, parent: Node | None = None) -> None:
        node = Node("comment", data=t.data)
        node.start = self.span
        if parent is not None:
            parent.append(node)
        else:
            where, at = self.place()
            where.insert(at, node)

    def put(self, t: Token, ns: str = HTML, implied: bool = False) -> Node:
        node = Node("element", t.data, ns, dict(t.attrs))
        node.implied = implied
        node.start = None if implied else self.span
        if t.data == "template" and ns == HTML:
            node.content = Node("content")
            node.content.parent = None
        parent, at = self.place()
        parent.insert(at, node)
        self.open.append(node)
        return node

    def imply(self, tag: str) -> Node:
        return self.put(Token("start", tag), implied=True)

    def in_scope(self, tags: frozenset[str] | set[str] | tuple, extra: frozenset[str] = frozenset(), only: frozenset[str] | None = None) -> bool:
        for n in reversed(self.open):
            if n.ns == HTML:
                if n.tag in tags:
                    return True
                if n.tag in (only if only is not None else SCOPE | extra):
                    return False
            elif only is None and n.tag in FOREIGN_SCOPE[n.ns]:
                return False
        return False

    def button_scope(self, tag: str) -> bool:
        return self.in_scope((tag,), frozenset(("button",)))

    def table_scope(self, *tags: str) -> bool:
        return self.in_scope(tags, only=frozenset(("html", "table", "template")))

    def imply_ends(self, but: str = "", thorough: bool = False) -> None:
        group = THOROUGH if thorough else IMPLIED_END
        while self.current().tag in group and self.current().tag != but and self.current().ns == HTML:
            self.open.pop()

    def pop_to(self, *tags: str) -> None:
        while self.open:
            n = self.open.pop()
            if n.ns == HTML and n.tag in tags:
                break

    def close_p(self) -> None:
        if self.button_scope("p"):
            self.imply_ends("p")
            self.pop_to("p")

    def has(self, tag: str) -> bool:
        return any(n.tag == tag and n.ns == HTML for n in self.open)

    # -- formatting elements ---------------------------------------------------------------------------------------

    def push_active(self, node: Node) -> None:
        same = []
        for n in reversed(self.active):
            if n is None:
                break
            if n.tag == node.tag and n.attrs == node.attrs:
                same.append(n)
        if len(same) >= 3:
            self.active.remove(same[-1])
        self.active.append(node)

    def reconstruct(self) -> None:
        if not self.active or self.active[-1] is None or self.active[-1] in self.open:
            return
        i = len(self.active) - 1
        while i > 0 and self.active[i - 1] is not None and self.active[i - 1] not in self.open:
            i -= 1
        for j in range(i, len(self.active)):
            old = self.active[j]
            node = self.put(Token("start", old.tag, old.attrs))
            node.implied = True
            self.active[j] = node

    def clear_active(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def adopt(self, tag: str) -> bool:
        """The adoption agency; false if the end tag is to be treated like any other."""
        if self.current().tag == tag and self.current().ns == HTML and self.current() not in self.active:
            self.open.pop()
            return True
        for _ in range(8):
            element = None
            for n in reversed(self.active):
                if n is None:
                    break
                if n.tag == tag:
                    element = n
                    break
            if element is None:
                return False
            if element not in self.open:
                self.active.remove(element)
                return True
            if not self.in_scope((tag,)):
                return True
            at = self.open.index(element)
            furthest = next((n for n in self.open[at + 1 :] if n.ns == HTML and n.tag in SPECIAL or self.html_point(n) or self.math_text(n)), None)
            if furthest is None:
                del self.open[at:]
                self.active.remove(element)
                return True
            ancestor = self.open[at - 1]
            mark = self.active.index(element)
            node = last = furthest
            position = self.open.index(furthest)
            inner = 0
            while True:
                inner += 1
                position -= 1
                node = self.open[position]
                if node is element:
                    break
                if inner > 3 and node in self.active:
                    if self.active.index(node) < mark:
                        mark -= 1
                    self.active.remove(node)
                if node not in self.active:
                    self.open.remove(node)
                    continue
                copy = Node("element", node.tag, node.ns, dict(node.attrs))
                copy.implied = True
                self.active[self.active.index(node)] = copy
                self.open[position] = copy
                node = copy
                if last is furthest:
                    mark = self.active.index(node) + 1
                node.append(last)
                last = node
            last.remove()
            foster, self.foster = self.foster, ancestor.tag in ("table", "tbody", "tfoot", "thead", "tr")
            parent, index = self.place(ancestor)
            self.foster = foster
            parent.insert(index, last)
            copy = Node("element", element.tag, element.ns, dict(element.attrs))
            copy.implied = True
            for child in list(furthest.children):
                copy.append(child)
            furthest.append(copy)
            gone = self.active.index(element)
            self.active.remove(element)
            self.active.insert(mark - (gone < mark), copy)
            self.open.remove(element)
            self.open.insert(self.open.index(furthest) + 1, copy)
        return True

    # -- insertion modes -------------------------------------------------------------------------------------------

    def reset_mode(self) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            node, last = self.open[i], i == 0
            if last and self.context:
                node = self.context
            tag = node.tag if node.ns == HTML else ""
            if tag in ("td", "th") and not last:
                self.mode = self.in_cell
            elif tag == "tr":
                self.mode = self.in_row
            elif tag in ("tbody", "thead", "tfoot"):
                self.mode = self.in_table_body
            elif tag == "caption":
                self.mode = self.in_caption
            elif tag == "colgroup":
                self.mode = self.in_column_group
            elif tag == "table":
                self.mode = self.in_table
            elif tag == "template":
                self.mode = self.templates[-1]
            elif tag == "head" and not last:
                self.mode = self.in_head
            elif tag == "body":
                self.mode = self.in_body
            elif tag == "frameset":
                self.mode = self.in_frameset
            elif tag == "html":
                self.mode = self.before_head if self.head is None else self.after_head
            elif last:
                self.mode = self.in_body
            else:
                continue
            return

    def raw_element(self, t: Token) -> None:
        self.put(t)
        self.tokens.raw = t.data
        self.original, self.mode = self.mode, self.in_text

    @staticmethod
    def _lead(t: Token) -> str:
        return t.data[: len(t.data) - len(t.data.lstrip(WHITE))]

    def initial(self, t: Token) -> None:
        if t.kind == "text":
            t.data = t.data.lstrip(WHITE)
            if not t.data:
                return
        elif t.kind == "comment":
            return self.put_comment(t, self.document)
        elif t.kind == "doctype":
            node = Node("doctype", t.data)
            node.start = self.span
            node.attrs = {"public": t.public or "", "system": t.system or ""}
            self.document.append(node)
            public = (t.public or "").lower()
            alone = public.startswith(QUIRKY_ALONE) and t.system is None
            old = public.startswith(QUIRKY_PUBLIC) or public in QUIRKY_WHOLE or (t.system or "").lower() == QUIRKY_SYSTEM
            self.quirks = t.quirks or t.data != "html" or old or alone
            self.mode = self.before_html
            return None
        else:
            self.quirks = True
        self.quirks = True
        self.mode = self.before_html
        return self.mode(t)

    def before_html(self, t: Token) -> None:
        if t.kind == "doctype":
            return None
        if t.kind == "comment":
            return self.put_comment(t, self.document)
        if t.kind == "text":
            t.data = t.data.lstrip(WHITE)
            if not t.data:
                return None
        if t.kind == "start" and t.data == "html":
            self._root(t)
            self.mode = self.before_head
            return None
        if t.kind == "end" and t.data not in ("head", "body", "html", "br"):
            return None
        self._root(Token("start", "html")).implied = True
        self.mode = self.before_head
        return self.handle(t)

    def _root(self, t: Token) -> Node:
        node = Node("element", "html", HTML, dict(t.attrs))
        self.document.append(node)
        self.open.append(node)
        return node

    def before_head(self, t: Token) -> None:
        if t.kind == "text":
            t.data = t.data.lstrip(WHITE)
            if not t.data:
                return None
        elif t.kind == "comment":
            return self.put_comment(t)
        elif t.kind == "doctype":
            return None
        elif t.kind == "start" and t.data == "html":
            return self.in_body(t)
        elif t.kind == "start" and t.data == "head":
            self.head = self.put(t)
            self.mode = self.in_head
            return None
        elif t.kind == "end" and t.data not in ("head", "body", "html", "br"):
            return None
        self.head = self.imply("head")
        self.mode = self.in_head
        return self.handle(t)

    def in_head(self, t: Token) -> None:
        if t.kind == "text":
            lead = self._lead(t)
            if lead:
                self.put_text(lead)
                t.data = t.data[len(lead) :]
            if not t.data:
                return None
        elif t.kind == "comment":
            return self.put_comment(t)
        elif t.kind == "doctype":
            return None
        elif t.kind == "start":
            tag = t.data
            if tag == "html":
                return self.in_body(t)
            if tag in ("base", "basefont", "bgsound", "link", "meta"):
                self.put(t)
                self.open.pop()
                return None
            if tag == "title" or tag in ("noframes", "style", "script"):
                return self.raw_element(t)
            if tag == "noscript":
                self.put(t)
                self.mode = self.in_head_noscript
                return None
            if tag == "template":
                self.put(t)
                self.active.append(None)
                self.framesets = False
                self.mode = self.in_template
                self.templates.append(self.in_template)
                return None
            if tag == "head":
                return None
        elif t.kind == "end":
            if t.data == "head":
                self.open.pop()
                self.mode = self.after_head
                return None
            if t.data == "template":
                return self.end_template()
            if t.data not in ("body", "html", "br"):
                return None
        self.open.pop()
        self.mode = self.after_head
        return self.handle(t)

    def end_template(self) -> None:
        if not self.has("template"):
            return
        self.imply_ends(thorough=True)
        self.pop_to("template")
        self.clear_active()
        self.templates.pop()
        self.reset_mode()

    def in_head_noscript(self, t: Token) -> None:
        if t.kind == "doctype":
            return None
        if t.kind == "start" and t.data == "html":
            return self.in_body(t)
        if t.kind == "end" and t.data == "noscript":
            self.open.pop()
            self.mode = self.in_head
            return None
        if t.kind == "comment" or t.kind == "text" and not t.data.strip(WHITE) or t.kind == "start" and t.data in ("basefont", "bgsound", "link", "meta", "noframes", "style"):
            return self.in_head(t)
        if t.kind == "start" and t.data in ("head", "noscript") or t.kind == "end" and t.data != "br":
            return None
        self.open.pop()
        self.mode = self.in_head
        return self.handle(t)

    def after_head(self, t: Token) -> None:
        if t.kind == "text":
            lead = self._lead(t)
            if lead:
                self.put_text(lead)
                t.data = t.data[len(lead) :]
            if not t.data:
                return None
        elif t.kind == "comment":
            return self.put_comment(t)
        elif t.kind == "doctype":
            return None
        elif t.kind == "start":
            if t.data == "html":
                return self.in_body(t)
            if t.data == "body":
                self.put(t)
                self.framesets = False
                self.mode = self.in_body
                return None
            if t.data == "frameset":
                self.put(t)
                self.mode = self.in_frameset
                return None
            if t.data in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
                self.open.append(self.head)
                self.in_head(t)
                if self.head in self.open:
                    self.open.remove(self.head)
                return None
            if t.data == "head":
                return None
        elif t.kind == "end":
            if t.data == "template":
                return self.end_template()
            if t.data not in ("body", "html", "br"):
                return None
        self.imply("body")
        self.mode = self.in_body
        return self.handle(t)

    def in_text(self, t: Token) -> None:
        if t.kind == "text":
            return self.put_text(t.data)
        self.open.pop()
        self.mode = self.original
        if t.kind == "eof":
            return self.handle(t)
        return None

    def in_body(self, t: Token) -> None:
        if t.kind == "text":
            data = t.data.replace("\0", "")
            if data:
                self.reconstruct()
                self.put_text(data)
                if data.strip(WHITE):
                    self.framesets = False
            return None
        if t.kind == "comment":
            return self.put_comment(t)
        if t.kind == "doctype":
            return None
        if t.kind == "eof":
            return self.in_template(t) if self.templates else None
        if t.kind == "start":
            return self.start_in_body(t)
        return self.end_in_body(t)

    def start_in_body(self, t: Token) -> None:
        tag = t.data
        if tag == "html":
            if not self.has("template"):
                for k, v in t.attrs.items():
                    self.open[0].attrs.setdefault(k, v)
        elif tag in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
            self.in_head(t)
        elif tag == "body":
            if len(self.open) > 1 and self.open[1].tag == "body" and not self.has("template"):
                self.framesets = False
                for k, v in t.attrs.items():
                    self.open[1].attrs.setdefault(k, v)
        elif tag == "frameset":
            if self.framesets and len(self.open) > 1 and self.open[1].tag == "body":
                self.open[1].remove()
                del self.open[1:]
                self.put(t)
                self.mode = self.in_frameset
        elif tag in BLOCKS:
            self.close_p()
            self.put(t)
        elif tag in HEADINGS:
            self.close_p()
            if self.current().tag in HEADINGS:
                self.open.pop()
            self.put(t)
        elif tag in ("pre", "listing"):
            self.close_p()
            self.put(t)
            self.skip_newline = True
            self.framesets = False
        elif tag == "form":
            if self.form is None or self.has("template"):
                self.close_p()
                node = self.put(t)
                if not self.has("template"):
                    self.form = node
        elif tag in ("li", "dd", "dt"):
            self.framesets = False
            same = ("li",) if tag == "li" else ("dd", "dt")
            for n in reversed(self.open):
                if n.ns == HTML and n.tag in same:
                    self.imply_ends(n.tag)
                    self.pop_to(n.tag)
                    break
                if n.tag in SPECIAL and n.tag not in ("address", "div", "p") and n.ns == HTML:
                    break
            self.close_p()
            self.put(t)
        elif tag == "plaintext":
            self.close_p()
            self.put(t)
            self.tokens.raw = "plaintext"
        elif tag == "button":
            if self.in_scope(("button",)):
                self.imply_ends()
                self.pop_to("button")
            self.reconstruct()
            self.put(t)
            self.framesets = False
        elif tag == "a":
            for n in reversed(self.active):
                if n is None:
                    break
                if n.tag == "a":
                    self.adopt("a")
                    if n in self.active:
                        self.active.remove(n)
                    if n in self.open:
                        self.open.remove(n)
                    break
            self.reconstruct()
            self.push_active(self.put(t))
        elif tag in FORMATTING and tag != "nobr":
            self.reconstruct()
            self.push_active(self.put(t))
        elif tag == "nobr":
            self.reconstruct()
            if self.in_scope(("nobr",)):
                self.adopt("nobr")
                self.reconstruct()
            self.push_active(self.put(t))
        elif tag in ("applet", "marquee", "object"):
            self.reconstruct()
            self.put(t)
            self.active.append(None)
            self.framesets = False
        elif tag == "table":
            if not self.quirks:
                self.close_p()
            self.put(t)
            self.framesets = False
            self.mode = self.in_table
        elif tag in ("area", "br", "embed", "img", "keygen", "wbr", "input", "image"):
            if tag == "image":
                t.data = "img"
            self.reconstruct()
            self.put(t)
            self.open.pop()
            if tag != "input" or t.attrs.get("type", "").lower() != "hidden":
                self.framesets = False
        elif tag in ("param", "source", "track"):
            self.put(t)
            self.open.pop()
        elif tag == "hr":
            self.close_p()
            self.put(t)
            self.open.pop()
            self.framesets = False
        elif tag == "textarea":
            self.framesets = False
            self.raw_element(t)
            self.skip_newline = True
        elif tag == "xmp":
            self.close_p()
            self.reconstruct()
            self.framesets = False
            self.raw_element(t)
        elif tag == "iframe":
            self.framesets = False
            self.raw_element(t)
        elif tag == "noembed":
            self.raw_element(t)
        elif tag == "select":
            self.reconstruct()
            self.put(t)
            self.framesets = False
        elif tag in ("optgroup", "option"):
            if self.current().tag == "option":
                self.open.pop()
            if tag == "optgroup" and self.current().tag == "optgroup":
                self.open.pop()
            self.reconstruct()
            self.put(t)
        elif tag in ("rb", "rtc", "rp", "rt"):
            if self.in_scope(("ruby",)):
                self.imply_ends("rtc" if tag in ("rp", "rt") else "")
            self.put(t)
        elif tag in ("math", "svg"):
            self.reconstruct()
            self.put_foreign(t, MATH if tag == "math" else SVG)
        elif tag not in TABLE_PARTS | {"frame", "head"}:
            self.reconstruct()
            self.put(t)
            if t.closing and tag in VOID:
                self.open.pop()

    def end_in_body(self, t: Token) -> None:
        tag = t.data
        if tag == "template":
            self.end_template()
        elif tag in ("body", "html"):
            if self.in_scope(("body",)):
                self.mode = self.after_body
                if tag == "html":
                    self.mode(t)
        elif tag in BLOCKS | {"button", "listing", "pre"} and tag != "p":
            if self.in_scope((tag,)):
                self.imply_ends()
                self.pop_to(tag)
        elif tag == "form":
            if self.has("template"):
                if self.in_scope(("form",)):
                    self.imply_ends()
                    self.pop_to("form")
            else:
                node, self.form = self.form, None
                if node is not None and node in self.open and self.in_scope(("form",)):
                    self.imply_ends()
                    self.open.remove(node)
        elif tag == "p":
            if not self.button_scope("p"):
                self.imply("p")
            self.close_p()
        elif tag in ("li", "dd", "dt"):
            if self.in_scope((tag,), _set("ol ul") if tag == "li" else frozenset()):
                self.imply_ends(tag)
                self.pop_to(tag)
        elif tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.imply_ends()
                self.pop_to(*HEADINGS)
        elif tag in FORMATTING:
            if not self.adopt(tag):
                self.any_end(tag)
        elif tag in ("applet", "marquee", "object"):
            if self.in_scope((tag,)):
                self.imply_ends()
                self.pop_to(tag)
                self.clear_active()
        elif tag == "br":
            self.start_in_body(Token("start", "br"))
        else:
            self.any_end(tag)

    def any_end(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            n = self.open[i]
            if n.ns == HTML and n.tag == tag:
                self.imply_ends(tag)
                del self.open[i:]
                return
            if n.ns == HTML and n.tag in SPECIAL:
                return

    def clear_to(self, *tags: str) -> None:
        while self.current().tag not in tags and self.current().tag not in ("html", "template"):
            self.open.pop()

    def in_table(self, t: Token) -> None:
        if t.kind == "text" and self.current().tag in ("table", "tbody", "template", "tfoot", "thead", "tr"):
            if t.data.strip(WHITE):
                self.foster = True
                self.in_body(t)
                self.foster = False
            else:
                self.put_text(t.data)
            return None
        if t.kind == "comment":
            return self.put_comment(t)
        if t.kind == "doctype":
            return None
        if t.kind == "start":
            tag = t.data
            if tag == "caption":
                self.clear_to("table")
                self.active.append(None)
                self.put(t)
                self.mode = self.in_caption
                return None
            if tag == "colgroup":
                self.clear_to("table")
                self.put(t)
                self.mode = self.in_column_group
                return None
            if tag == "col":
                self.clear_to("table")
                self.imply("colgroup")
                self.mode = self.in_column_group
                return self.handle(t)
            if tag in ("tbody", "tfoot", "thead"):
                self.clear_to("table")
                self.put(t)
                self.mode = self.in_table_body
                return None
            if tag in ("td", "th", "tr"):
                self.clear_to("table")
                self.imply("tbody")
                self.mode = self.in_table_body
                return self.handle(t)
            if tag == "table":
                if self.table_scope("table"):
                    self.pop_to("table")
                    self.reset_mode()
                    return self.handle(t)
                return None
            if tag in ("style", "script", "template"):
                return self.in_head(t)
            if tag == "input" and t.attrs.get("type", "").lower() == "hidden":
                self.put(t)
                self.open.pop()
                return None
            if tag == "form":
                if self.form is None and not self.has("template"):
                    self.form = self.put(t)
                    self.open.pop()
                return None
        elif t.kind == "end":
            if t.data == "table":
                if self.table_scope("table"):
                    self.pop_to("table")
                    self.reset_mode()
                return None
            if t.data in TABLE_PARTS | {"body", "html"}:
                return None
            if t.data == "template":
                return self.end_template()
        elif t.kind == "eof":
            return self.in_body(t)
        self.foster = True
        self.in_body(t)
        self.foster = False
        return None

    def in_caption(self, t: Token) -> None:
        leaves = t.kind == "start" and t.data in TABLE_PARTS or t.kind == "end" and t.data == "table"
        if leaves or t.kind == "end" and t.data == "caption":
            if self.table_scope("caption"):
                self.imply_ends()
                self.pop_to("caption")
                self.clear_active()
                self.mode = self.in_table
                if leaves:
                    return self.handle(t)
            return None
        if t.kind == "end" and t.data in (TABLE_PARTS | {"body", "html"}) - {"caption"}:
            return None
        return self.in_body(t)

    def in_column_group(self, t: Token) -> None:
        if t.kind == "text":
            lead = self._lead(t)
            if lead:
                self.put_text(lead)
                t.data = t.data[len(lead) :]
            if not t.data:
                return None
        elif t.kind == "comment":
            return self.put_comment(t)
        elif t.kind == "doctype":
            return None
        elif t.kind == "start" and t.data == "html":
            return self.in_body(t)
        elif t.kind == "start" and t.data == "col":
            self.put(t)
            self.open.pop()
            return None
        elif t.kind in ("start", "end") and t.data == "template":
            return self.in_head(t)
        elif t.kind == "end" and t.data == "col":
            return None
        elif t.kind == "eof":
            return self.in_body(t)
        if self.current().tag != "colgroup":
            return None
        self.open.pop()
        self.mode = self.in_table
        if not (t.kind == "end" and t.data == "colgroup"):
            return self.handle(t)
        return None

    def in_table_body(self, t: Token) -> None:
        if t.kind == "start" and t.data in ("tr", "td", "th"):
            self.clear_to("tbody", "tfoot", "thead")
            if t.data == "tr":
                self.put(t)
                self.mode = self.in_row
                return None
            self.imply("tr")
            self.mode = self.in_row
            return self.handle(t)
        if t.kind == "end" and t.data in ("tbody", "tfoot", "thead"):
            if self.table_scope(t.data):
                self.clear_to("tbody", "tfoot", "thead")
                self.open.pop()
                self.mode = self.in_table
            return None
        if t.kind == "start" and t.data in ("caption", "col", "colgroup", "tbody", "tfoot", "thead") or t.kind == "end" and t.data == "table":
            if self.table_scope("tbody", "thead", "tfoot"):
                self.clear_to("tbody", "tfoot", "thead")
                self.open.pop()
                self.mode = self.in_table
                return self.handle(t)
            return None
        if t.kind == "end" and t.data in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
            return None
        return self.in_table(t)

    def in_row(self, t: Token) -> None:
        if t.kind == "start" and t.data in ("td", "th"):
            self.clear_to("tr")
            self.put(t)
            self.mode = self.in_cell
            self.active.append(None)
            return None
        ends = t.kind == "end" and t.data == "tr"
        leaves = (
            t.kind == "start" and t.data in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr")
            or t.kind == "end" and (t.data == "table" or t.data in ("tbody", "tfoot", "thead") and self.table_scope(t.data))
        )
        if ends or leaves:
            if self.table_scope("tr"):
                self.clear_to("tr")
                self.open.pop()
                self.mode = self.in_table_body
                if leaves:
                    return self.handle(t)
            return None
        if t.kind == "end" and t.data in ("body", "caption", "col", "colgroup", "html", "td", "th", "tbody", "tfoot", "thead"):
            return None
        return self.in_table(t)

    def in_cell(self, t: Token) -> None:
        if t.kind == "end" and t.data in ("td", "th"):
            if self.table_scope(t.data):
                self.imply_ends()
                self.pop_to(t.data)
                self.clear_active()
                self.mode = self.in_row
            return None
        if t.kind == "start" and t.data in TABLE_PARTS or t.kind == "end" and t.data in ("table", "tbody", "tfoot", "thead", "tr"):
            if t.kind == "start" and self.table_scope("td", "th") or t.kind == "end" and self.table_scope(t.data):
                self.imply_ends()
                self.pop_to("td", "th")
                self.clear_active()
                self.mode = self.in_row
                return self.handle(t)
            return None
        if t.kind == "end" and t.data in ("body", "caption", "col", "colgroup", "html"):
            return None
        return self.in_body(t)

    def in_template(self, t: Token) -> None:
        if t.kind in ("text", "comment", "doctype"):
            return self.in_body(t)
        if t.kind == "start":
            if t.data in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
                return self.in_head(t)
            mode = {"col": self.in_column_group, "tr": self.in_table_body, "td": self.in_row, "th": self.in_row}.get(t.data)
            if mode is None:
                mode = self.in_table if t.data in ("caption", "colgroup", "tbody", "tfoot", "thead") else self.in_body
            self.templates[-1] = mode
            self.mode = mode
            return self.handle(t)
        if t.kind == "end":
            return self.end_template() if t.data == "template" else None
        if not self.has("template"):
            return None
        self.pop_to("template")
        self.clear_active()
        self.templates.pop()
        self.reset_mode()
        return self.handle(t)

    def after_body(self, t: Token) -> None:
        if t.kind == "comment":
            return self.put_comment(t, self.open[0])
        if t.kind == "text" and not t.data.strip(WHITE) or t.kind == "start" and t.data == "html":
            return self.in_body(t)
        if t.kind in ("doctype", "eof"):
            return None
        if t.kind == "end" and t.data == "html":
            if not self.context:
                self.mode = self.after_after_body
            return None
        self.mode = self.in_body
        return self.handle(t)

    def after_after_body(self, t: Token) -> None:
        if t.kind == "comment":
            return self.put_comment(t, self.document)
        if t.kind == "doctype" or t.kind == "text" and not t.data.strip(WHITE) or t.kind == "start" and t.data == "html":
            return self.in_body(t)
        if t.kind == "eof":
            return None
        self.mode = self.in_body
        return self.handle(t)

    def in_frameset(self, t: Token) -> None:
        if t.kind == "text":
            if blank := "".join(c for c in t.data if c in WHITE):
                self.put_text(blank)
        elif t.kind == "comment":
            self.put_comment(t)
        elif t.kind == "start" and t.data in ("frameset", "frame"):
            self.put(t)
            if t.data == "frame":
                self.open.pop()
        elif t.kind == "start" and t.data == "noframes":
            self.in_head(t)
        elif t.kind == "end" and t.data == "frameset" and len(self.open) > 1:
            self.open.pop()
            if self.current().tag != "frameset":
                self.mode = self.after_frameset

    def after_frameset(self, t: Token) -> None:
        if t.kind == "text":
            if blank := "".join(c for c in t.data if c in WHITE):
                self.put_text(blank)
        elif t.kind == "comment":
            self.put_comment(t)
        elif t.kind == "start" and t.data == "noframes":
            self.in_head(t)

    # -- foreign content -------------------------------------------------------------------------------------------

    def put_foreign(self, t: Token, ns: str) -> None:
        if ns == SVG:
            t.data = SVG_TAGS.get(t.data, t.data)
            t.attrs = {SVG_ATTRS.get(k, k): v for k, v in t.attrs.items()}
        elif "definitionurl" in t.attrs:
            t.attrs = {"definitionURL" if k == "definitionurl" else k: v for k, v in t.attrs.items()}
        self.put(t, ns)
        if t.closing:
            self.open.pop()

    def in_foreign(self, t: Token) -> None:
        if t.kind == "text":
            self.put_text(t.data.replace("\0", "�"))
            if t.data.strip(WHITE + "\0"):
                self.framesets = False
            return None
        if t.kind == "comment":
            return self.put_comment(t)
        if t.kind == "doctype":
            return None
        if t.kind == "start":
            if t.data in BREAKOUT or t.data == "font" and any(a in t.attrs for a in ("color", "face", "size")):
                while self.current().ns != HTML and not self.html_point(self.current()) and not self.math_text(self.current()):
                    self.open.pop()
                return self.mode(t)
            node = self.context if self.context and len(self.open) == 1 else self.current()
            return self.put_foreign(t, node.ns)
        if t.data in ("br", "p"):
            while self.current().ns != HTML and not self.html_point(self.current()) and not self.math_text(self.current()):
                self.open.pop()
            return self.mode(t)
        for i in range(len(self.open) - 1, 0, -1):
            node = self.open[i]
            if node.ns == HTML:
                return self.mode(t)
            if node.tag.lower() == t.data:
                del self.open[i:]
                return None
        return None


def parse(text: str | None) -> Node:
    """The document of a page; null is an empty page."""
    return Builder((text or "").removeprefix("﻿")).run()


def parse_fragment(text: str | None, context: str = "body") -> list[Node]:
    """The nodes that ``text`` gives as content of an element ``context``."""
    document = Builder(text or "", context).run()
    return list(document.children[0].children)
