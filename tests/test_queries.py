"""Selectors and paths over node rows, extraction, addresses, sanitizing, encodings, chunked streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagemill.functions.markup import collapse_space, escape
from pagemill.functions.urls import clean_url, registrable_domain, url_parts
from pagemill.operators import extract
from pagemill.operators.cleaning import READABLE, find_links, linkify, sanitize
from pagemill.operators.selectors import SelectorError, axis, closest, parse_selector, select, specificity
from pagemill.operators.xpath import XPathError, xpath
from pagemill.sources.encodings import decode, detect
from pagemill.sources.nodes import parse_nodes, tokenize
from pagemill.streaming.chunks import parse_chunks

PAGE = (
    "<!doctype html><html lang=de><head><title>T</title></head><body><div id=m class='a b'><p class=x>one</p><p>two <b>bold</b></p><p lang=en></p></div>"
    "<ul><li>1<li class=x>2<li>3</ul><form><fieldset disabled><legend><input name=l></legend><input name=q required></fieldset><input name=r type=checkbox checked></form>"
    "<a href=/u REL=Next>link</a></body></html>"
)


@pytest.fixture(scope="module")
def nodes(spark):
    return parse_nodes(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id bigint, html string")).cache()


SELECTORS = [
    ("p", 3), ("*", 29), ("div > p", 3), ("div p + p", 2), ("p ~ p", 2), (".x", 2), ("p.x", 1), ("#m", 1), ("#m.a.b", 1), ("[class~=b]", 1), ("[lang|=de]", 1),
    ("a[rel=next]", 1), ("a[rel=next s]", 0), ("a[href^='/']", 1), ("a[href*='']", 0), ("li:first-child, li:last-child", 2), ("li:nth-child(2n+1)", 2), ("li:nth-last-child(1)", 1),
    ("li:nth-child(1 of .x)", 1), ("p:not(.x)", 2), ("p:has(b)", 1), ("div:has(> p + p)", 1), (":is(p, li).x", 2), ("p:not(div p)", 0), ("p:empty", 1), ("input:disabled", 1),
    ("input:enabled", 2), ("input:required", 1), ("input:checked", 1), ("p:lang(en)", 1), ("p:lang(de)", 2), (":root", 3), ("a:hover", 0), (":is(p:bad, li)", 3), ("b:only-of-type", 1),
    ("body :not(p, li, :has(*))", 5), ("a:any-link", 1),
]


@pytest.mark.parametrize(("selector", "count"), SELECTORS)
def test_select(nodes, selector, count):
    got = select(nodes, selector)
    if selector == "*":
        assert got.count() == nodes.filter("node_type = 'element'").count()
    else:
        assert got.count() == count


@pytest.mark.parametrize("bad", ["", "p >", "p::before", "p:nope", "[a", ":not()", "p:nth-child(x)", "#"])
def test_bad_selectors(nodes, bad):
    with pytest.raises(SelectorError):
        select(nodes, bad)


def test_specificity():
    assert specificity(parse_selector("#a .b[c] p:not(#d):where(#e)")[0]) == (2, 2, 1)


def test_intervals_and_axes(nodes):
    rows = nodes.filter("page_id = 1").collect()
    assert [r["pre"] for r in sorted(rows, key=lambda r: r["pre"])] == list(range(len(rows)))
    for r in rows:
        below = [x for x in rows if r["pre"] < x["pre"] <= r["last"]]
        assert all(any(x["parent"] == y["pre"] for y in [r, *below]) for x in below)
    bold = select(nodes, "b")
    assert {r["tag"] for r in axis(nodes, bold, "ancestor").filter("tag is not null").collect()} == {"html", "body", "div", "p"}
    assert axis(nodes, select(nodes, "li.x"), "following-sibling").count() == axis(nodes, select(nodes, "li.x"), "preceding-sibling").count() == 1
    assert closest(nodes, bold, "div, body").count() == 1


XPATHS = [
    ("count(//p)", "3"), ("string(//p[2])", "two bold"), ("//li[last()]", "3"), ("//li[position() > 1][1]", "2"), ("//p[@class='x']/following-sibling::p[1]", "two bold"),
    ("name(//b/ancestor::*[2])", "div"), ("//@href", "/u"), ("concat('a', 1 + 2 * 3, true())", "a7true"), ("substring('12345', 1.5, 2.6)", "234"), ("1 div 0", "Infinity"),
    ("-5 mod 2", "-1"), ("string(0 div 0)", "NaN"), ("translate('bar', 'abc', 'AB')", "BAr"), ("normalize-space('  a   b ')", "a b"), ("sum(//li)", "6"), ("//li = 2", "true"),
    ("//li > 3", "false"), ("boolean(//nope)", "false"), ("math:max(//li)", "3"), ("string-join(//li, '-')", "1-2-3"), ("matches('abc', '^A', 'i')", "true"), ("count(//p | //li)", "6"),
    ("count(set:difference(//*, //body//*))", "4"), ("//li[2]/preceding::p[1]/@lang", "en"), ("count(//p[lang('de')])", "2"), ("round(-1.5)", "-1"), ("$v + 1", "3"), ("id('m')/p[1]", "one"),
    ("count(//text()[. = 'one'])", "1"), ("(//p)[1]", "one"), ("replace('a1', '([a-z])(\\d)', '$2$1')", "1a"),
]


@pytest.mark.parametrize(("expression", "wanted"), XPATHS)
def test_xpath(spark, expression, wanted):
    pages = spark.createDataFrame([(1, PAGE)], "page_id bigint, html string")
    assert [r["value"] for r in xpath(pages, expression, {"v": 2}).collect()] == [wanted]


@pytest.mark.parametrize("bad", ["//", "nope()", "//p[", "1 +", "foo::p", "'a"])
def test_bad_xpath(spark, bad):
    with pytest.raises(XPathError):
        xpath(spark.createDataFrame([], "page_id bigint, html string"), bad)


def test_tokens(spark):
    got = tokenize(spark.createDataFrame([(1, "<p a=1>x</p><script></p></script>"), (2, None)], "page_id bigint, html string")).orderBy("seq").collect()
    assert [(r["kind"], r["name"] or r["data"]) for r in got] == [("start", "p"), ("text", "x"), ("end", "p"), ("start", "script"), ("text", "</p>"), ("end", "script")]


def one(df):
    return [tuple(r) for r in df.collect()]


def test_extraction(spark):
    html = (
        "<html lang=en><head><title>T</title><meta property='og:title' content='O'><link rel=canonical href=/c><base href='http://b.example/d/'>"
        "<script type='application/ld+json'>{\"@type\": \"Article\", \"datePublished\": \"2024-05-06T10:00\"}</script></head><body>"
        "<div itemscope itemtype=Person><span itemprop=name>Ann</span><a itemprop=url href=x>u</a></div>"
        "<table><tr><td rowspan=2>a<td>b<tr><td>c</table><img srcset='1.png 1x, 2.png 2x'><p style=\"background:url(z.gif)\">p</p>"
        "<form><input name=a value=1><select name=s><option>x<option selected>y</select><textarea name=t>z</textarea></form></body></html>"
    )
    pages = spark.createDataFrame([(1, html, "http://a.example/"), (2, None, None), (3, "", "")], "page_id bigint, html string, url string")
    found = {(r["attribute"], r["url"]) for r in extract.links(pages).collect()}
    assert {("srcset", "http://b.example/d/1.png"), ("style", "http://b.example/d/z.gif"), ("href", "http://b.example/c")} <= found
    assert [r["cells"] for r in extract.tables(pages).collect()] == [["a", "b"], ["a", "c"]]
    row = extract.metadata(pages).filter("page_id = 1").head()
    assert (row["title"], row["language"], row["canonical"]) == ("O", "en", "http://b.example/c")
    data = extract.structured_data(pages).filter("page_id = 1").head()
    assert '"name": ["Ann"]' in data["microdata"][0]
    assert data["opengraph"] == {"og:title": "O"}
    assert one(extract.dates(pages).filter("page_id = 1")) == [(1, "2024-05-06", "json-ld")]
    assert [r[2:] for r in one(extract.form_data(pages))] == [("a", "1"), ("s", "y"), ("t", "z")]
    for operator in (extract.metadata, extract.structured_data, extract.main_content, extract.dates):
        assert operator(pages).count() == 3
    assert extract.links(pages.limit(0)).count() == 0


def test_main_content_and_paragraphs(spark):
    body = "<p>" + "A long sentence, with commas, that goes on and on. " * 5 + "</p>"
    html = f"<body><nav><a href=x>home</a></nav><div class=sidebar><p>{'short, text here, ok ' * 3}</p></div><article><h1>Title</h1>{body * 3}</article><footer>© 2024</footer></body>"
    pages = spark.createDataFrame([(1, html)], "page_id bigint, html string")
    assert extract.main_content(pages).head()["tag"] == "article"
    flags = [(r["is_boilerplate"], r["is_heading"]) for r in extract.paragraphs(pages).orderBy("para_no").collect()]
    assert flags == [(True, False), (False, False), (False, True), (False, False), (False, False), (False, False), (True, False)]


def test_feeds(spark):
    rss = "<rss><channel><title>F</title><item><title>a</title><guid>1</guid><pubDate>d</pubDate></item><item><title>b</title></item></channel></rss>"
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><title>G</title><entry><id>i</id><link href='u'/><author><name>N</name></author></entry></feed>"
    docs = spark.createDataFrame([(1, rss), (2, atom), (3, "<p>no"), (4, None)], "page_id bigint, xml string")
    got = extract.feed(docs).orderBy("page_id", "entry_no").collect()
    assert [(r["type"], r["title"], r["id"], r["link"], r["author"]) for r in got] == [("rss", "a", "1", None, None), ("rss", "b", None, None, None), ("atom", None, "i", "u", "N")]


def test_sanitize_and_linkify(spark):
    bad = "<p onclick=x>a<script>alert(1)</script><a href='java\tscript:x' title=t>l</a><blink>k</blink><!--c--></p>"
    pages = spark.createDataFrame([(1, bad), (2, None)], "page_id bigint, html string")
    got = {r["page_id"]: r for r in sanitize(pages, READABLE).collect()}
    assert got[1]["clean"] == '<p>a<a title="t">l</a>k</p>'
    assert got[2]["clean"] == ""
    assert {r["tag"] for r in got[1]["removed"]} == {"p", "script", "a", "blink", "#comment"}
    links = find_links("See www.a.example/x(y), mail b.c@d.test. Or (http://e.example).")
    assert [x["url"] for x in links] == ["http://www.a.example/x(y)", "mailto:b.c@d.test", "http://e.example"]
    df = spark.createDataFrame([("a < www.a.example", 1), (None, 2)], "text string, links int")
    rows = {r["linked"] for r in linkify(df, "text").collect()}
    assert rows == {'a &lt; <a href="http://www.a.example">www.a.example</a>', None}


def test_addresses(spark):
    df = spark.createDataFrame([("https://U@Sub.Shop.co.uk:8080/p?q#f",), ("http://10.0.0.1/",), ("mailto:x",), (None,), ("https://a.example/x.PNG",)], "u string")
    rows = df.select(url_parts(F.col("u")).alias("p"), registrable_domain(url_parts(F.col("u"))["host"]).alias("d"), clean_url(F.col("u")).alias("c")).collect()
    assert rows[0]["p"].asDict() == {"scheme": "https", "user": "U", "host": "sub.shop.co.uk", "port": 8080, "path": "/p", "query": "q", "fragment": "f"}
    assert [r["d"] for r in rows] == ["shop.co.uk", None, None, None, "a.example"]
    assert rows[4]["c"] is None
    text = spark.createDataFrame([(" a\n b&'<", ), (None,)], "t string").select(escape(F.col("t")), collapse_space(F.col("t"))).collect()
    assert tuple(text[0]) == (" a\n b&amp;&#x27;&lt;", "a b&'<")


def test_encodings(spark):
    assert detect(b"\xef\xbb\xbfx") == ("utf-8", 1.0)
    assert detect(b"<meta charset=iso-8859-1>\xe9")[0] == "cp1252"
    assert detect("é".encode())[0] == "utf-8"
    assert detect(b"\xe9x")[0] == "cp1252"
    df = spark.createDataFrame([(1, bytearray(b"caf\xe9")), (2, None)], "page_id bigint, content binary")
    assert [r["html"] for r in decode(df, "content").orderBy("page_id").collect()] == ["café", None]


def test_chunked_pages_like_whole_ones(spark, tmp_path):
    page = "<title>T</title><p>one<p>two</p>"
    cuts = [page[:9], page[9:20], page[20:]]
    schema = "page_id bigint, chunk_no int, last boolean, data string"
    source = tmp_path / "chunks"
    spark.createDataFrame([(1, 2, True, cuts[2]), (1, 0, False, cuts[0])], schema).write.parquet(str(source / "a"))
    spark.createDataFrame([(1, 1, False, cuts[1]), (1, 1, False, cuts[1]), (2, 0, False, "<p>x")], schema).write.parquet(str(source / "b"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    query = parse_chunks(stream, timeout=None).writeStream.format("memory").queryName("chunked").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    rows = spark.table("chunked").collect()
    assert [(r["page_id"], r["n_elements"], r["title"], r["text"], r["complete"]) for r in rows] == [(1, 6, "T", "one\n\ntwo", True)]
