"""Conformance, find, events, edits, style sheets, XML and XSLT."""

from __future__ import annotations

import pytest

from pagemill.operators.conformance import conformance, events, find
from pagemill.operators.edit import annotated_text, css_to_xpath, minify_css, normalize, rewrite, select_many
from pagemill.operators.selectors import SelectorError, select
from pagemill.operators.xpath import xpath
from pagemill.operators.xslt import StylesheetError, Transform, compile_stylesheet, transform
from pagemill.sources.nodes import parse_nodes
from pagemill.sources.xml import XMLError, canonical, parse_xml

PAGE = "<html><body><img src=a><h1> </h1><section><p id=x align=left role=paragraph>one <b>two</b></p></section><center id=x role=nope>c</center><script type=text/javascript></script><a href='/u'>l</a><!--c--></body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, PAGE, "http://a.example/d/"), (2, "<!doctype html><html lang=en><title>t</title>", None)], "page_id bigint, html string, url string")


def test_conformance(spark, pages):
    codes = sorted(r["code"] for r in conformance(parse_nodes(pages)).collect())
    assert codes == sorted(["img-missing-alt", "empty-heading", "section-no-heading", "obsolete-attribute", "aria-redundant-role", "obsolete-element", "aria-invalid-role", "duplicate-id", "redundant-type-attribute", "missing-lang", "missing-title"])


def test_find_and_events(pages):
    nodes = parse_nodes(pages)
    assert find(nodes, tag=["p", "b"]).count() == 2
    assert find(nodes, attrs={"id": True, "align": False}).count() == 1
    assert find(nodes, tag="re:^[bh]", text="two", within="section").count() == 1
    rows = events(nodes.filter("page_id = 2")).orderBy("seq").collect()
    assert [(r["kind"], r["name"] or r["data"]) for r in rows] == [("doctype", "html"), ("start", "html"), ("start", "head"), ("start", "title"), ("text", "t"), ("end", "title"), ("end", "head"), ("start", "body"), ("end", "body"), ("end", "html")]


def test_edits(pages):
    edits = [("remove", "script, h1"), ("unwrap", "section > p b"), ("set", "p", "class", "k"), ("drop", "p", "align"), ("rename", "center", "div"), ("absolute",), ("comments",), ("empty", "section")]
    got = rewrite(pages, edits).filter("page_id = 1").head()["rewritten"]
    assert got == '<html><head></head><body><img src="http://a.example/d/a"><section></section><div id="x" role="nope">c</div><a href="http://a.example/u">l</a></body></html>'
    with pytest.raises(SelectorError):
        rewrite(pages, [("remove", "p:bad")])
    many = select_many(pages, {"a": "section b", "n": ":not(html *):root"}).collect()
    assert sorted((r["page_id"], r["name"], r["text"][:3]) for r in many) == [(1, "a", "two"), (1, "n", " on"), (2, "n", "t")]
    row = annotated_text(pages, {"bold": "b"}).filter("page_id = 1").head()
    assert [row["text"][s["start"] : s["end"]] for s in row["spans"]] == ["two"]


@pytest.mark.parametrize("selector", ["p", "section > p b", "[id=x]", ".none", "h1 + section", "img ~ a", "p:has(b)", ":not(p, b)", "p:nth-child(1)", "b:only-child", "[href^='/']"])
def test_selectors_agree(spark, pages, selector):
    plan = select(parse_nodes(pages), selector).count()
    assert select_many(pages, {"s": selector}).count() == plan
    assert xpath(pages, css_to_xpath(selector)).count() == plan


def test_minify_css():
    assert minify_css("a  >  b { color : #ffffff ; margin: 0.5em  0 } /* c */ c::before{content:' a  b ';}\n d {}") == "a>b{color:#fff;margin:.5em 0}c::before{content:' a  b '}"


def test_normalize(spark):
    df = spark.createDataFrame([(1, "é"), (2, None)], "k int, t string")
    assert [r["t"] for r in normalize(df, "t").orderBy("k").collect()] == ["é", None]


def test_xml():
    assert canonical(parse_xml('<b:r xmlns:b="u" z="1" a="&lt;"><c xmlns:b="u"/>x&amp;<!--c--></b:r>')) == '<b:r xmlns:b="u" a="&lt;" z="1"><c></c>x&amp;</b:r>'
    with pytest.raises(XMLError):
        parse_xml("<a><b></a>")


SHEET = """<xsl:stylesheet xmlns:xsl="http://www.w3.org/1999/XSL/Transform" version="1.0"><xsl:param name="p" select="'d'"/><xsl:key name="k" match="item" use="@c"/>
<xsl:template match="/"><out p="{$p}-{count(//item)}"><xsl:apply-templates select="//item"><xsl:sort select="@n" data-type="number" order="descending"/></xsl:apply-templates><xsl:for-each select="key('k','x')"><k><xsl:value-of select="position()"/></k></xsl:for-each></out></xsl:template>
<xsl:template match="item[@c='x']" priority="2"><x><xsl:call-template name="t"><xsl:with-param name="v" select="@n"/></xsl:call-template></x></xsl:template>
<xsl:template match="item"><i><xsl:choose><xsl:when test=". = 'b'">B</xsl:when><xsl:otherwise><xsl:copy-of select="."/></xsl:otherwise></xsl:choose></i></xsl:template>
<xsl:template name="t"><xsl:param name="v">0</xsl:param><xsl:if test="$v &gt; 1"><xsl:value-of select="$v"/></xsl:if><xsl:number value="4" format="i."/></xsl:template></xsl:stylesheet>"""


def test_xslt(spark):
    data = '<r><item n="1" c="x">a</item><item n="3">b</item><item n="2" c="x">c</item><item n="10">d</item></r>'
    wanted = '<out p="{}-4"><i><item n="10">d</item></i><i>B</i><x>2iv.</x><x>iv.</x><k>1</k><k>2</k></out>'
    assert Transform(compile_stylesheet(SHEET), parse_xml(data), {}).run() == wanted.format("d")
    df = spark.createDataFrame([(1, data), (2, "<r>"), (3, None)], "page_id bigint, html string")
    rows = {r["page_id"]: r for r in transform(df, SHEET, {"p": "q"}, xml=True).collect()}
    assert rows[1]["result"] == wanted.format("q")
    assert rows[2]["result"] is None and rows[2]["error"] and rows[3]["error"]
    with pytest.raises(StylesheetError):
        compile_stylesheet("<a/>")


def test_computed_styles(spark):
    from pagemill.operators.styles import computed_styles, declarations, rules

    html = (
        "<style>p{color:red;margin:1px} .x{color:blue} #i{color:green!important} @media print{p{color:black}} @media screen{b{top:1px}} bad::x{a:b} div{--c:3px;font-size:9px}</style>"
        "<div><p class=x style='color:pink'>a</p><p id=i class=x style='color:pink'><b style='left:var(--c, 1px);margin:inherit'>b</b></p></div>"
    )
    rows = {r["tag"] + str(r["element_no"]): r["style"] for r in computed_styles(spark.createDataFrame([(1, html), (2, None)], "page_id bigint, html string")).collect()}
    assert rows["p6"] == {"color": "pink", "margin": "1px", "font-size": "9px", "--c": "3px"}
    assert rows["p7"]["color"] == "green"
    assert rows["b8"] == {"color": "green", "font-size": "9px", "--c": "3px", "left": "3px", "top": "1px", "margin": "1px"}
    assert declarations("a:url(x;y);b:';';c") == [("a", "url(x;y)", False), ("b", "';'", False)]
    assert rules("@import 'a'; p{x:y}") == [("p", "x:y")]


def test_trigram_language(spark):
    from pagemill.functions.languages import detect_language, profiles

    data = [("the old ferry and the harbour office keep the lanterns", "en"), ("die alte Fähre und das Hafenamt führen die Laternen", "de"), (None, "en")]
    known = profiles(spark.createDataFrame(data, "text string, lang string"))
    df = spark.createDataFrame([(1, "the ferry keeps the office"), (2, "das Amt und die Fähre"), (3, "12"), (4, None)], "k int, t string")
    assert [r["language"] for r in detect_language(df, "t", known).orderBy("k").collect()] == ["en", "de", None, None]


def test_command_line(tmp_path, capsys):
    from pagemill.__main__ import main

    (tmp_path / "a.html").write_bytes(b"<h1>T</h1><p onclick=x>caf\xe9")
    path = str(tmp_path / "a.html")
    assert [main([form, path]) for form in ("markdown", "sanitized", "errors", "encoding", "nope")] == [0, 0, 0, 0, 2]
    assert capsys.readouterr().out.startswith("# T\n\ncafé\n<h1>T</h1><p>café</p>\n1:1 missing-doctype\ncp1252 0.")


def test_command_line_over_tables(spark, tmp_path):
    from pagemill.__main__ import main

    pages = spark.createDataFrame([(1, "<p>x"), (2, None)], "page_id bigint, html string")
    pages.write.parquet(str(tmp_path / "pages"))
    assert main(["nodes", str(tmp_path / "pages"), str(tmp_path / "nodes")]) == 0
    assert spark.read.parquet(str(tmp_path / "nodes")).filter("tag = 'p'").count() == 1


@pytest.fixture(scope="module")
def marked_up(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("marked_up"))
    html = ["<html><body><p>a lantern<p>b &amp; <b>c</b><script>x</script></body></html>", "<h1>cut <p>off lantern", None]
    spark.createDataFrame([(i, h, None) for i, h in enumerate(html)], "page_id bigint, html string, url string").write.parquet(f"{folder}/pages.parquet")
    rows = [(0, "A & B <i>", "<p>plain</p>", "<ul><li>x &lt; y</ul>", None), (1, "«Ж»", None, "<!-- c --><p onclick=x>q</p>", None), (2, None, "<p>r <a href='javascript:x'>s</a></p>", None, None)]
    entries = spark.createDataFrame(rows, "row_id bigint, title string, content string, summary string, link string")
    entries.selectExpr("*", "'i' AS id", "'1' AS published", "'n' AS author").write.parquet(f"{folder}/entries.parquet")
    texts = {("pages", i): h for i, h in enumerate(html)} | {("contents", r[0]): r[2] for r in rows} | {("summaries", r[0]): r[3] for r in rows}
    return folder, texts, {r[0]: r[1] for r in rows}


def test_queries_over_all_rows(spark, marked_up):
    from pagemill.functions.markup import serialize, to_markdown
    from pagemill.operators.cleaning import READABLE, parse_fragment, sanitize_tree
    from pagemill.plans.web import QUERIES
    from pagemill.sources.tree import parse

    folder, texts, titles = marked_up
    got = lambda name, column: {(r["source"], r["page_id"]): r[column] for r in QUERIES[name](spark, folder).collect()}
    assert got("sanitize_pages", "clean") == {k: serialize(sanitize_tree(parse_fragment(t), READABLE, []), inner=True) for k, t in texts.items()}
    assert got("render_markdown", "rendered") == {k: to_markdown(parse(t), None) for k, t in texts.items()}
    rewritten = got("rewrite_pages", "rewritten")
    assert rewritten.keys() == texts.keys() and rewritten["summaries", 1] == '<html><head></head><body><div onclick="x">q</div></body></html>'
    assert got("xpath_longest", "value") == {("pages", 0): "9", ("pages", 1): "11", ("contents", 0): "5", ("contents", 2): "3", ("summaries", 1): "1"}
    assert {r["page_id"]: r["title"] for r in QUERIES["feed_entries"](spark, folder).collect()} == titles


def test_unfinished_pages(spark, marked_up):
    from pagemill.plans.web import QUERIES

    got = lambda name: {r["page_id"]: r["n"] for r in QUERIES[name](spark, marked_up[0]).collect()}
    assert got("find_text") == {0: 1, 1: 1}
    assert got("walk_events") == {0: 7, 1: 5, 2: 3}
