"""Articles, dates, forms, labels, broken feeds, canonical XML, links in texts and trees, options of language detection."""

from __future__ import annotations

import pytest

from pagemill.functions.languages import LanguageDetection, detect_language, profiles, script_of
from pagemill.operators import extract
from pagemill.operators.cleaning import Linkify, find_links, has_link, linkify, linkify_pages, nofollow, target_blank
from pagemill.operators.extract import DateExtraction, Extraction, date_of, feed_of, form_of, labels_of
from pagemill.sources.tree import parse
from pagemill.sources.xml import Canonical, canonical_xml, canonicalize, parse_xml

TEXT = "The ferry sells warm bread, and the harbour office keeps a list of every lantern. " * 4


def test_articles(spark):
    page = f"<html lang=en><title>T</title><meta property=og:site_name content=S><script type=application/ld+json>{{\"author\": {{\"name\": \"Ann\"}}, \"datePublished\": \"2024-02-03\"}}</script><nav><a href=x>menu</a></nav><article><p>{TEXT}</p></article>"
    rows = {r["page_id"]: r for r in extract.articles(spark.createDataFrame([(1, page, "http://a.example/"), (2, None, None)], "page_id bigint, html string, url string")).collect()}
    a = rows[1]
    assert (a["title"], a["author"], a["published"], a["site"], a["language"]) == ("T", "Ann", "2024-02-03", "S", "en") and a["markdown"] == a["text"] == TEXT.strip() and a["html"].startswith("<article>")
    assert rows[2]["title"] is None and rows[2]["text"] == ""
    blocks = {r["text"]: r["is_boilerplate"] for r in extract.boilerplate(spark.createDataFrame([(1, f"<h2>Short</h2><p>{TEXT}</p><p>tiny</p>")], "page_id bigint, html string"), Extraction(keep_headings=False)).collect()}
    assert blocks == {"Short": True, TEXT.strip(): False, "tiny": True} and Extraction.strict().min_length == 70


@pytest.mark.parametrize(
    ("page", "options", "wanted"),
    [
        ("<meta name=date content=2024-05-06><meta property=article:modified_time content=2024-07-08>", DateExtraction(), ("2024-05-06", "meta:date")), ("<meta name=date content=2024-05-06><meta property=article:modified_time content=2024-07-08>", DateExtraction(original=False), ("2024-07-08", "meta:article:modified_time")),
        ("<time>3 March 2021</time>", DateExtraction(output_format="%d.%m.%Y"), ("03.03.2021", "time")), ("<p>Posted on Jan 5, 2020", DateExtraction(), ("2020-01-05", "text")), ("<p>am 7. Oktober 2019", DateExtraction(), ("2019-10-07", "text")), ("<p>07.10.2019", DateExtraction(), ("2019-10-07", "text")),
        ("<p>2019-10-07", DateExtraction(extensive_search=False), (None, None)), ("<p>2019-02-31", DateExtraction(), (None, None)), ("<time datetime=1990-01-01>", DateExtraction(), (None, None)), ("<time datetime=1990-01-01>", DateExtraction(min_date="1980-01-01", max_date="1999-12-31"), ("1990-01-01", "time")),
    ],
)
def test_dates(page, options, wanted):
    assert date_of(parse(page), None, options) == wanted


def test_forms(spark):
    page = """<form id=f><fieldset disabled><legend><input name=in value=1></legend><input name=out value=2></fieldset><datalist><input name=d></datalist><label>L <select name=m multiple><option selected>a<option selected>b</select></label></form>
    <input name=far form=f value=3><input name=lost form=g><form><input type=radio name=r value=x><input type=radio name=r value=y checked></form><label for=k>K</label><textarea id=k name=t></textarea>"""
    assert form_of(parse(page)) == [(1, "in", "1"), (1, "m", "a"), (1, "m", "b"), (1, "far", "3"), (2, "r", "y")]
    assert labels_of(parse(page)) == [(1, "L ab", "select", "m", None), (2, "K", "textarea", "t", "k")]
    assert extract.labels(spark.createDataFrame([(1, page), (2, None)], "page_id bigint, html string")).count() == 2


def test_broken_feeds():
    broken = "<rss version=2.0><channel><title>A & B &nbsp; C</title><item><title>x <b>y</b></title><link>http://a.example/?a=1&b=2</link><dc:creator>N</dc:creator></item><item><title>cut"
    rows = feed_of(broken.replace("version=2.0", "version='2.0'"))
    assert [(r[1], r[6], r[7], r[-1]) for r in rows] == [("A & B   C", "x <b>y</b>", "http://a.example/?a=1&b=2", "N"), ("A & B   C", "cut", None, None)]
    assert feed_of("<p>no & feed") == [] and feed_of(None) == []


def test_canonical_forms(spark):
    doc = parse_xml('<a:r xmlns:a="urn:a" xmlns:b="urn:b" xmlns="urn:d" xml:lang="en" z="1" a:y="2"><b:c  q=\'&lt;"\'><!-- n --><d/>x&#13;</b:c></a:r>')
    assert canonicalize(doc) == '<a:r xmlns="urn:d" xmlns:a="urn:a" xmlns:b="urn:b" z="1" xml:lang="en" a:y="2"><b:c q="&lt;&quot;"><d></d>x&#xD;</b:c></a:r>'
    inner = doc.children[0].children[0]
    assert canonicalize(inner) == '<b:c xmlns="urn:d" xmlns:a="urn:a" xmlns:b="urn:b" q="&lt;&quot;" xml:lang="en"><d></d>x&#xD;</b:c>'
    assert canonicalize(inner, Canonical(exclusive=True, with_comments=True)) == '<b:c xmlns:b="urn:b" q="&lt;&quot;"><!-- n --><d xmlns="urn:d"></d>x&#xD;</b:c>'
    assert canonicalize(inner, Canonical(exclusive=True, inclusive_ns_prefixes=("a",))).startswith('<b:c xmlns:a="urn:a" xmlns:b="urn:b"')
    based = parse_xml('<r xml:base="http://a.example/x/" xml:id="i"><s xml:base="y/"><t/></s></r>').children[0].children[0].children[0]
    assert canonicalize(based, Canonical("1.1")) == '<t xml:base="http://a.example/x/y/"></t>' and 'xml:id="i"' in canonicalize(based)
    with pytest.raises(ValueError, match="exclusive"):
        Canonical("1.1", exclusive=True)
    rows = canonical_xml(spark.createDataFrame([(1, "<a  b='1'/>"), (2, "<a>"), (3, None)], "page_id bigint, xml string")).orderBy("page_id").collect()
    assert [r["canonical"] for r in rows] == ['<a b="1"></a>', None, None] and rows[1]["error"]


def test_links(spark):
    text = "See a.shop, b.zzz and c@d.test or gopher://e.example; call +44 20 7946 0541."
    assert [x["url"] for x in find_links(text)] == ["http://a.shop", "mailto:c@d.test"]
    every = Linkify(parse_email=False, extra_tlds=frozenset(("zzz",)), schemes=frozenset(("gopher",)), phones=())
    assert [x["url"] for x in find_links(text, every)] == ["http://a.shop", "http://b.zzz", "gopher://e.example", "tel:+44-20-7946-0541"]
    assert has_link("x www.a.example") and not has_link("nothing here") and not has_link(None)
    drop = Linkify(callbacks=(nofollow, target_blank, lambda a, t: None if "bad" in t else a), process_existing=True)
    page = "<p>www.a.example <a href=b rel=me>x</a> <a href=c>bad</a> bad.example <code>d.example</code></p>"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id bigint, html string")
    got = {r["page_id"]: r["linked"] for r in linkify_pages(df, drop).collect()}
    assert got[1] == '<p><a href="http://www.a.example" rel="nofollow" target="_blank">www.a.example</a> <a href="b" rel="me nofollow" target="_blank">x</a> bad bad.example <code>d.example</code></p>' and got[2] == ""
    row = linkify(spark.createDataFrame([("a.example & bad.example",)], "t string"), "t", drop).head()
    assert row["linked"] == '<a href="http://a.example" rel="nofollow" target="_blank">a.example</a> &amp; bad.example'


def test_language_options(spark):
    known = profiles(spark.createDataFrame([("the old ferry and the harbour", "en"), ("die alte Fähre und das Amt", "de")], "text string, lang string"))
    df = spark.createDataFrame([(1, "the ferry and the harbour")], "k int, t string")
    pick = lambda o: detect_language(df, "t", known, o).head()["language"]
    assert (pick(LanguageDetection()), pick(LanguageDetection(excluded=frozenset(("en",)))), pick(LanguageDetection(allowed=frozenset(("de",)))), pick(LanguageDetection(threshold=2.0))) == ("en", "de", "de", None)
    assert (script_of("привет x"), script_of("12"), script_of("漢字")) == ("Cyrillic", None, "Han")
