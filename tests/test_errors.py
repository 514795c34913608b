"""Parse errors and places."""

from __future__ import annotations

import pytest

from pagemill.functions.markup import to_source
from pagemill.sources.errors import ParseError, errors_of, locations, parse_errors, parse_strict
from pagemill.sources.tree import parse

D = "<!doctype html>"


@pytest.mark.parametrize(
    ("page", "codes"),
    [
        (D + "<html lang=en><head><title>t</title></head><body><p>a &amp; b &copy;<br>c</p></body></html>", []), ("<p>x", ["missing-doctype"]), ("", ["missing-doctype"]), (D + "<p a=1 a=2>", ["duplicate-attribute"]), (D + "</b>", ["stray-end-tag"]), (D + "<div>", ["unclosed-element"]),
        (D + "<p>&#0;&#x110000;&#xd800;&#128;&#", ["null-character-reference", "character-reference-outside-unicode-range", "surrogate-character-reference", "control-character-reference", "absence-of-digits-in-numeric-character-reference"]), (D + "<p>&copy &nope;", ["missing-semicolon-after-character-reference", "unknown-named-character-reference"]),
        (D + "<p><?php ?>", ["unexpected-question-mark-instead-of-tag-name"]), (D + "<!-->", ["abrupt-closing-of-empty-comment"]), (D + "<!-- a", ["eof-in-comment"]), (D + "<!x>", ["incorrectly-opened-comment"]), (D + "<p><![CDATA[x]]>", ["cdata-in-html-content"]), (D + "<p a='1'b>", ["missing-whitespace-between-attributes"]),
        (D + "<p a=>", ["missing-attribute-value"]), (D + "<p a=b'c>", ["unexpected-character-in-unquoted-attribute-value"]), (D + "<div/></div>", ["non-void-html-element-start-tag-with-trailing-solidus"]), (D + "<div></div a>", ["end-tag-with-attributes"]), (D + "<p>a < b", ["invalid-first-character-of-tag-name"]), (D + "<p", ["eof-in-tag"]),
        (D + "<p>\0", ["unexpected-null-character"]), (D + "<!-- a --!>", ["incorrectly-closed-comment"]), ("<!doctype>", ["missing-doctype-name"]),
    ],
)
def test_codes(page, codes):
    assert sorted(c for c, *_ in errors_of(page)) == sorted(codes)


def test_places_and_strictness():
    assert errors_of(D + "\n<p>\n  <b c=1 c=2></b>")[0] == ("duplicate-attribute", 29, 3, 10)
    with pytest.raises(ParseError, match="duplicate-attribute at line 1, column 24") as e:
        parse_strict(D + "<p a=1 \x20a=2>")
    assert (e.value.code, e.value.line) == ("duplicate-attribute", 1)
    assert parse_strict(D + "<p>x").first("p").text() == "x"


def test_rows(spark):
    pages = spark.createDataFrame([(1, D + "\n<div id=a><p>x</div></b>"), (2, None)], "page_id bigint, html string")
    assert [(r["page_id"], r["code"], r["line"], r["col"]) for r in parse_errors(pages).orderBy("page_id", "seq").collect()] == [(1, "stray-end-tag", 2, 21), (2, "missing-doctype", 1, 1)]
    got = {r["tag"]: (r["start"], r["close"], r["line"], r["end_col"]) for r in locations(pages).collect()}
    assert got == {"div": (16, 30, 2, 21), "p": (26, None, 2, None)}


def test_lossless_source():
    page = "<!DOCTYPE  html><P  CLASS='a'>x &amp; y<BR/>z</P\t><!-- c --><b>q"
    tree = parse(page)
    assert to_source(tree, page) == page
    tree.first("br").remove()
    assert to_source(tree, page) == page.replace("<BR/>", "")
