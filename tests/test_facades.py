"""Texts that are HTML, event parsers, style sheets, edits with HTML, compiled selectors."""

from __future__ import annotations

from pagemill.functions.safe import EscapeFormatter, Markup, escape
from pagemill.operators.dom import Matcher
from pagemill.operators.edit import is_normalized, matches_many, rewrite
from pagemill.operators.styles import StyleDeclaration, StyleSheet, style_rules
from pagemill.sources.handlers import HTMLParser, SaxHandler, sax_parse
from pagemill.sources.tree import parse


def test_markup():
    b = Markup("<b>")
    assert escape("<&\"'>") == "&lt;&amp;&#34;&#39;&gt;".replace("&#34;", "&quot;") and escape(b) is b and escape(None) == "None"
    assert b + "<i>" == "<b>&lt;i&gt;" and "<i>" + b == "&lt;i&gt;<b>" and b * 2 == "<b><b>" and isinstance(b[1:], Markup) and isinstance(b.upper(), Markup)
    assert Markup("<p>{} {x}</p>").format("<", x=b) == "<p>&lt; <b></p>" and Markup("%s-%d") % ("<", 3) == "&lt;-3" and Markup("%(k)s") % {"k": "<"} == "&lt;"
    assert Markup(", ").join(["<", b]) == "&lt;, <b>" and Markup("a b").split() == ["a", "b"] and isinstance(Markup("a b").partition(" ")[2], Markup) and Markup("x").replace("x", "<") == "&lt;"
    assert Markup("&lt;a&gt;").unescape() == "<a>" and Markup("<p>a  <b>b</b></p><!-- c --> d").striptags() == "a b d" and repr(b) == "Markup('<b>')"
    assert EscapeFormatter().format("{0:>4}", "<") == "   &lt;" and Markup("{a[k]}").format_map({"a": {"k": "<"}}) == "&lt;"


class Log(HTMLParser):
    def __init__(self, **options):
        self.log = []
        super().__init__(**options)

    def handle_starttag(self, tag, attrs):
        self.log.append(("start", tag, attrs, self.getpos()))

    def handle_endtag(self, tag):
        self.log.append(("end", tag))

    def handle_data(self, data):
        self.log.append(("data", data))

    def handle_comment(self, data):
        self.log.append(("comment", data))

    def handle_decl(self, decl):
        self.log.append(("decl", decl))

    def handle_entityref(self, name):
        self.log.append(("entity", name))

    def handle_charref(self, name):
        self.log.append(("char", name))

    def handle_pi(self, data):
        self.log.append(("pi", data))


def test_event_parser():
    parser = Log()
    for part in ("<!doctype html>\n<p a=1>x &a", "mp; y<br/><!-- c --></p>", "<?pi z>"):
        parser.feed(part)
    parser.close()
    assert parser.log == [("decl", "doctype html"), ("data", "\n"), ("start", "p", [("a", "1")], (2, 0)), ("data", "x & y"), ("start", "br", [], (2, 16)), ("end", "br"), ("comment", " c "), ("end", "p"), ("pi", "pi z")]
    plain = Log(convert_charrefs=False)
    plain.feed("<p>a&amp;b&#65;</p>")
    plain.close()
    assert [x[:2] for x in plain.log] == [("start", "p"), ("data", "a"), ("entity", "amp"), ("data", "b"), ("char", "65"), ("end", "p")]


def test_sax():
    class Handler(SaxHandler):
        def __init__(self):
            self.log = []

        def start_element(self, tag, attrs):
            self.log.append(tag)

        def end_element(self, tag):
            self.log.append("/" + tag)

        def characters(self, data):
            self.log.append(data)

        def comment(self, data):
            self.log.append("!" + data)

        def doctype(self, name):
            self.log.append("?" + name)

    handler = Handler()
    sax_parse("<!doctype html><p>a<!--c-->", handler)
    assert handler.log == ["?html", "html", "head", "/head", "body", "p", "a", "!c", "/p", "/body", "/html"]


def test_style_sheets(spark):
    sheet = StyleSheet("p, b.c { color: red; COLOR: blue !important; color: green } @media print { p { top: 1px } } @media screen { i { left: 0 } }")
    assert len(sheet) == 2 and sheet[0].selector == "p, b.c" and sheet[0].style["color"] == "blue" and sheet[0].style.important("color") and sheet[0].style.text == "color: blue !important" and sheet[0].specificity > sheet[1].specificity
    style = StyleDeclaration.parse("a: 1; b: url(x;y); a: 2")
    assert style.properties == ["b", "a"] and style.get("a") == "2" and style.get("z", "d") == "d"
    rows = style_rules(spark.createDataFrame([(1, "p{a:1;b:2!important}"), (2, None)], "page_id bigint, css string")).collect()
    assert [(r["selector"], r["property"], r["important"]) for r in rows] == [("p", "a", False), ("p", "b", True)]


def test_edits_with_html(spark):
    pages = spark.createDataFrame([(1, "<p>x</p><i>y</i><b>z</b>"), (2, None)], "page_id bigint, html string").selectExpr("*", "cast(null as string) AS url")
    steps = [("before", "p", "<hr>"), ("after", "p", "t"), ("prepend", "i", "<u>1</u>"), ("append", "i", "2"), ("replace", "b", "<s>r</s>q"), ("content", "p", "<em>n</em>")]
    got = {r["page_id"]: r["rewritten"] for r in rewrite(pages, steps).collect()}
    assert got[1] == "<html><head></head><body><hr><p><em>n</em></p>t<i><u>1</u>y2</i><s>r</s>q</body></html>"
    many = matches_many(pages, {"any": "p, i", "first": ":first-child", "none": ".x"}).filter("page_id = 1 AND tag = 'p'").head()
    assert many["names"] == ["any", "first"]
    m = Matcher("p, b")
    body = parse("<div><p>x<b>y</b></div>").first("div")
    assert [n.tag for n in m.select(body)] == ["p", "b"] and m.select_one(body).tag == "p" and len(m.select(body, 1)) == len(list(m.iselect(body))) - 1 and m.closest(body) is None and m.filter(body.children) == body.children and m.match(body.children[0])
    assert is_normalized("é") and not is_normalized("é") and is_normalized(None) is None
