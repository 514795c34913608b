"""Addresses by the standard, host names, suffix rules, cleaning."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.functions.whatwg import UrlCleaning, clean_one, normalize_one, parse_url, resolve, to_ascii, to_unicode
from pagemill.operators.extract import extract_links, links, meta_refresh

BASE = "http://h.example/a/b/c?q=1#f"


@pytest.mark.parametrize(
    ("link", "wanted"),
    [
        ("", "http://h.example/a/b/c?q=1"), ("#x", "http://h.example/a/b/c?q=1#x"), ("?y", "http://h.example/a/b/c?y"), ("d", "http://h.example/a/b/d"), ("/d", "http://h.example/d"), ("../../../e", "http://h.example/e"), ("./", "http://h.example/a/b/"), ("//k.example/z", "http://k.example/z"),
        ("\\\\k.example\\z", "http://k.example/z"), ("http:d", "http://h.example/a/b/d"), ("https:k.example", "https://k.example/"), ("HTTP://EXAMPLE.test:80/%7ex/../a b", "http://example.test/a%20b"), ("https://u:p@h.example:8443/é?ü#ö", "https://u:p@h.example:8443/%C3%A9?%C3%BC#%C3%B6"),
        ("mailto:a@b", "mailto:a@b"), ("data:text/plain,x y", "data:text/plain,x y"), ("http://0x7f.1/", "http://127.0.0.1/"), ("http://[1:0::2]/", "http://[1::2]/"), ("http://1.2.3.4.5/", None), ("http://a b/", None), ("http://h:99999/", None), ("ja\nva\tscript:x", "javascript:x"),
        ("http://ex%41mple.test/%2e%2E/x", "http://example.test/x"), ("file:///C|/x/../..", "file:///C:/"), ("custom://h/p/../q", "custom://h/q"),
    ],
)
def test_resolving(link, wanted):
    assert resolve(link, BASE) == wanted


def test_hosts():
    assert to_ascii("Bücher.Example") == "xn--bcher-kva.example" and to_unicode("xn--bcher-kva.example") == "bücher.example"
    assert to_ascii("faß.example") == "xn--fa-hia.example" and to_ascii("a。b") == "a.b" and to_ascii("xn--a") is None and to_ascii("a b") is None
    for url in ("http://a.example/", "http://xn--bcher-kva.example/x%20y?z#w", "mailto:x", "https://u@h.test/"):
        assert str(parse_url(url)) == url and str(parse_url(str(parse_url(url)))) == url
    assert parse_url(None) is None and parse_url("x") is None and parse_url("https://h.test:444/").origin == "https://h.test:444"


def test_cleaning():
    assert normalize_one("HTTP://A.example:80/b/../c/?z=1&utm_source=q&a=2#top") == "http://a.example/c/?a=2&z=1#top"
    assert clean_one("http://a.example/x/?id=3&s=4", UrlCleaning(strict=True, trailing_slash=False)) == "http://a.example/x?id=3"
    assert clean_one("http://a.example/x?a=1&b=2#f", UrlCleaning(query_allow=frozenset("a"), strip_fragment=True)) == "http://a.example/x?a=1"
    assert clean_one("http://a.example/x?a=1&b=2", UrlCleaning(query_deny=frozenset("a"))) == "http://a.example/x?b=2"
    assert clean_one("http://a.example/de/x", UrlCleaning(language="en")) is None and clean_one("http://a.example/en/x", UrlCleaning(language="en")) is not None
    assert clean_one("y", UrlCleaning(base_url="http://www.a.example/x")) == "http://www.a.example/y" and clean_one("http://s.a.example/", UrlCleaning(base_url="http://www.a.example/", external_only=True)) is None
    assert clean_one("ftp://a.example/") is None and clean_one("http://a.example/p.PNG") is None and clean_one("") is None and clean_one(None) is None


def test_columns(spark):
    hosts = [("a.b.co.uk", "b.co.uk"), ("co.uk", None), ("x.y.ck", "x.y.ck"), ("y.ck", None), ("www.ck", "www.ck"), ("a.www.ck", "www.ck"), ("a.city.kobe.jp", "city.kobe.jp"), ("p.q.kobe.jp", "p.q.kobe.jp"), ("10.0.0.1", None), ("Example.", None), ("a.Example", "a.example"), ("", None), (None, None)]
    df = spark.createDataFrame([(h, i) for i, (h, _) in enumerate(hosts)], "h string, i int")
    got = [r[0] for r in df.orderBy("i").select(urls.registrable_domain(F.col("h"))).collect()]
    assert got == [w for _, w in hosts]
    assert df.select(urls.registrable_domain(F.col("h"), ["b.co.uk"])).head()[0] == "a.b.co.uk"
    one = spark.createDataFrame([("../x", BASE, "bücher.test", "a%20b%FF")], "l string, b string, h string, p string")
    row = one.select(urls.resolve(F.col("l"), F.col("b")), urls.to_ascii(F.col("h")), urls.percent_decode(F.col("p")), urls.percent_encode(F.col("h")), urls.normalize_url(F.col("b")), urls.scrub_url(F.col("h"))).head()
    assert tuple(row) == ("http://h.example/a/x", "xn--bcher-kva.test", "a b\ufffd", "b%C3%BCcher.test", BASE, None)


def test_links_of_pages(spark):
    page = "<base href=/d/><meta http-equiv=refresh content='3;url=n'><a href=x ping='p q'>1</a><a href='https://h.example/d/x/'>2</a><a href='mailto:m'>3</a><a href=y.pdf>4</a><area href=z>"
    pages = spark.createDataFrame([(1, page, "http://h.example/a"), (2, None, None)], "page_id bigint, html string, url string")
    assert [r["url"] for r in extract_links(pages).orderBy("seq").collect()] == ["http://h.example/d/x", "http://h.example/d/z"]
    assert {r["url"].rpartition("/")[2] for r in links(pages).collect() if r["attribute"] in ("ping", "content")} == {"p", "q", "n"}
    assert [tuple(r) for r in meta_refresh(pages).collect()] == [(1, 3.0, "http://h.example/d/n")]
