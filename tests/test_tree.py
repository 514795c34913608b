"""Tree construction: cases of the standard's kinds of recovery, and invariants over arbitrary text."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.functions.markup import Markdown, PlainText, serialize, to_markdown, to_text
from pagemill.sources.tokens import Tokenizer, unescape_attribute
from pagemill.sources.tree import parse, parse_fragment

CASES = [
    ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
    ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
    ("<a><p>X<a>Y</a>Z</p></a>", "<a></a><p><a>X</a><a>Y</a>Z</p>"),
    ("<table><b><tr><td>aaa</td></tr>bbb</table>ccc", "<b></b><b>bbb</b><table><tbody><tr><td>aaa</td></tr></tbody></table><b>ccc</b>"),
    ("<table><td>a<td>b<tr><td>c</table>", "<table><tbody><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></tbody></table>"),
    ("<ul><li>a<li>b</ul>c", "<ul><li>a</li><li>b</li></ul>c"),
    ("<p>a<p>b", "<p>a</p><p>b</p>"),
    ("<p><b>x<p>y", "<p><b>x</b></p><p><b>y</b></p>"),
    ("<svg><foreignobject><p>x</p></foreignobject><circle/></svg>y", "<svg><foreignObject><p>x</p></foreignObject><circle></circle></svg>y"),
    ("<select><option>a<option>b</select>", "<select><option>a</option><option>b</option></select>"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
    ("a<!-- b --!>c<!-->d<? x>e", "a<!-- b -->c<!---->d<!--? x-->e"),
    ("x</p>y", "x<p></p>y"),
    ("<h1>a<h2>b</h2>", "<h1>a</h1><h2>b</h2>"),
    ("a &lt; b &amp; &copy &notit; &#x80;", "a &lt; b &amp; © ¬it; €"),
    ("<div <p>x", '<div <p="">x</div>'),
    ("<br/></br>", "<br><br>"),
    ("<math><mi>x</mi></math>", "<math><mi>x</mi></math>"),
    ("a<b", "a"),
    ("<textarea>\n<b>x</textarea>", "<textarea>&lt;b&gt;x</textarea>"),
]


@pytest.mark.parametrize(("text", "wanted"), CASES)
def test_body(text, wanted):
    assert serialize(parse("<!doctype html>" + text).first("body"), inner=True) == wanted


def test_document_shape():
    assert serialize(parse("<title>a&amp;b</title>x")) == "<html><head><title>a&amp;b</title></head><body>x</body></html>"
    assert serialize(parse(None)) == serialize(parse("")) == "<html><head></head><body></body></html>"
    assert serialize(parse("<script><!--<script></script>--></script>x")) == "<html><head><script><!--<script></script>--></script></head><body>x</body></html>"
    assert serialize(parse("<frameset><frame></frameset>")) == "<html><head></head><frameset><frame></frameset></html>"
    assert serialize(parse("<template><td>x</td></template>")) == "<html><head><template><td>x</td></template></head><body></body></html>"


def test_fragment_and_attribute_references():
    assert "".join(map(serialize, parse_fragment("<td>x", "tr"))) == "<td>x</td>"
    assert unescape_attribute("?a=1&copy=2&lt;&amp") == "?a=1&copy=2<&"
    assert [t.attrs for t in Tokenizer("<a B=1 b=2 c='x\"' d>")] == [{"b": "1", "c": 'x"', "d": ""}]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<i>", "</i>", "<a href=x>", "</a>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "x", " ", "<svg>", "<template>", "</template>", "<select>", "<!--c-->", "</div>", "<div>", "&amp;", "<h1>", "<button>", "<form>", "</form>"]), max_size=30))
def test_any_markup_gives_a_tree(parts):
    document = parse("".join(parts))
    for n in document.walk():
        assert all(c.parent is n for c in n.children)
    text = serialize(document)
    assert "x" * "".join(parts).count("x") == "".join(c for c in text if c == "x" and True)[: "".join(parts).count("x")] or "<svg>" in parts or "<a href=x>" in parts or "<template>" in parts
    to_text(document)
    to_markdown(document)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-=\"' abp&;#x\n[]?", max_size=60))
def test_any_text_ends(text):
    parse(text)


def test_deep_and_long():
    assert sum(1 for _ in parse("<div>" * 3000 + "x").elements()) == 3003
    assert len(parse("x" * 2_000_000).text()) == 2_000_000


def test_markdown_and_text():
    page = parse("<h1>T</h1><p>a <b>b</b> <a href='u'>c</a></p><ul><li>x<li>y</ul><pre><code class='language-py'>1\n2</code></pre><table><tr><th>h<th>k<tr><td>1<td>2</table>")
    assert to_markdown(page) == "# T\n\na **b** [c](u)\n\n- x\n- y\n\n```py\n1\n2\n```\n\n| h | k |\n| --- | --- |\n| 1 | 2 |"
    assert to_text(parse("<p>a  b<br>c</p><script>x</script><p>d")) == "a b\nc\n\nd"


def test_rendering_options():
    page = parse("<h1>T</h1><p>a <b>b</b> <del>x</del><a href='u'>c</a><br>d <img src=i alt=pic></p><ul><li>x</ul><pre>1</pre><table><tr><td>1<td>2</table>")
    options = Markdown(
        headings=Markdown.Headings("setext"), lists=Markdown.Lists("*"), inline=Markdown.Inline(strong="__", strikethrough="hide"), code=Markdown.Code("indented"),
        links=Markdown.Links("reference", base_url="http://a.example/"), images=Markdown.Images("alt"), tables=Markdown.Tables("strip"), document=Markdown.Document("backslash"),
    )
    assert to_markdown(page, options) == "T\n===\n\na __b__ [c][1]\\\nd pic\n\n* x\n\n    1\n\n1\t2\n\n[1]: http://a.example/u"
    assert to_markdown(parse("<h2>T</h2><p>" + "word " * 6), Markdown(headings=Markdown.Headings("atx_closed"), wrapping=Markdown.Wrapping(12))) == "## T ##\n\nword word\nword word\nword word"
    text = to_text(parse("<p>a <a href=u>l</a> <img alt=pic><ul><li>x</ul><table><tr><td>1<td>2</table>"), PlainText(links="footnote", images=True, table_cell_separator=" | ", bullet="-"))
    assert text == "a l [1] pic\n\n- x\n\n1 | 2\n\n[1] u"


def test_columns_of_nodes(spark):
    from pagemill.sources.nodes import STRUCTURE, parse_nodes

    pages = spark.createDataFrame([(1, "<p class=a>x<b>y</b>"), (2, None)], "page_id bigint, html string")
    whole, part = parse_nodes(pages), parse_nodes(pages, columns=STRUCTURE, elements=True)
    assert part.columns == list(STRUCTURE)
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, whole.filter("node_type = 'element'").select(*STRUCTURE).collect()))
    assert parse_nodes(pages, columns=("page_id", "tag")).count() == whole.count()
