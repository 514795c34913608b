"""Trees by hand: navigation, edits, ranges, walkers, observers, shadow trees, builders, chains."""

from __future__ import annotations

import pytest

from pagemill.functions.markup import serialize
from pagemill.operators import dom
from pagemill.operators.dom import E, MutationObserver, NodeIterator, Query, Range, TreeWalker
from pagemill.sources.tree import parse

PAGE = "<body><div id=a class='x y'><p>one <b>two</b> three</p><!-- c --><p class=z>four</p></div><ul><li>1<li>2</ul></body>"


def body(html=PAGE):
    return parse(html).first("body")


def inner(node):
    return serialize(node, inner=True)


def test_navigation():
    top = body()
    b, (p, q), div = top.first("b"), dom.select(top, "p"), top.first("div")
    assert [n.tag for n in dom.ancestors(b) if n.kind == "element"] == ["p", "div", "body", "html"]
    assert [n.tag for n in dom.following(b) if n.kind == "element"] == ["p", "ul", "li", "li"] and [n.tag for n in dom.preceding(q) if n.kind == "element"] == ["b", "p", "head"]
    assert dom.index_of(q) == 2 and dom.next_siblings(p)[-1] is q and dom.previous_siblings(q)[-1] is p and dom.contains(div, b) and not dom.contains(b, div)
    assert (dom.compare_position(p, q), dom.compare_position(q, b), dom.compare_position(b, b)) == (-1, 1, 0)
    assert dom.equal(dom.clone(top), top) and not dom.equal(p, q) and dom.strings(p) == ["one", "two", "three"]
    assert dom.closest(b, "div, ul") is div and dom.match(q, ".z") and dom.select_one(top, "nope") is None
    assert dom.css_path(b) == "#a > p:nth-of-type(1) > b" and dom.xpath_path(b) == "/html/body/div/p[1]/b" and dom.xpath_path(b.children[0]).endswith("/b/text()")
    assert all(dom.select(dom.root_of(n), dom.css_path(n)) == [n] for n in top.elements())
    assert dom.escape_identifier("1a b-") == "\\31 a\\ b-"


def test_edits():
    top = body("<p>a</p><i>b</i>")
    p, i = top.children
    dom.insert_before(i, "x", E.u("y"))
    dom.insert_after(i, "z")
    dom.wrap(i, E.div())
    dom.append(p, E.b("c", class_="k"), "d")
    dom.prepend(p, "0")
    assert inner(top) == '<p>0a<b class="k">c</b>d</p>x<u>y</u><div><i>b</i></div>z'
    dom.unwrap(top.first("div"))
    dom.replace_with(top.first("u"), "w")
    dom.normalize(top)
    assert inner(top) == '<p>0a<b class="k">c</b>d</p>xw<i>b</i>z' and len(top.children) == 4
    dom.wrap_children(top.first("i"), E.s())
    dom.set_inner_html(p, "<em>n</em>m")
    dom.insert_adjacent_html(p, "afterbegin", "<b>1</b>")
    dom.insert_adjacent_html(p, "afterend", "<hr>")
    assert inner(top) == "<p><b>1</b><em>n</em>m</p><hr>xw<i><s>b</s></i>z"
    dom.strip_tags(top, "b", "s")
    dom.strip_elements(top, "em", "hr")
    dom.transform(top, lambda n: None if n.tag == "i" else True)
    assert inner(top) == "<p>1m</p>xwz"
    dom.set_text(p, "<&")
    assert inner(p) == "&lt;&amp;"
    c = body("<div class=a>  x \n y<!-- c --><pre>  z</pre><p><b></b></p></div>")
    dom.strip_comments(c)
    dom.collapse_whitespace(c)
    dom.prune(c, lambda n: n.tag == "pre")
    assert inner(c) == '<div class="a"> x y<pre>  z</pre></div>'
    d = c.first("div")
    assert dom.toggle_class(d, "b") and dom.has_class(d, "b") and not dom.toggle_class(d, "a") and dom.classes(d) == ["b"]


def test_ranges():
    top = body("<p>one <b>two</b> three</p><p>four</p>")
    p, q = top.children
    r = Range(p.children[0], 1, p.children[2], 3)
    assert str(r) == "ne two th" and not r.collapsed and r.common_ancestor_container is p and r.intersects_node(p.children[1]) and not r.intersects_node(q)
    assert inner(r.clone_contents()) == "ne <b>two</b> th" and inner(top) == "<p>one <b>two</b> three</p><p>four</p>"
    assert r.compare_point(p.children[0], 0) == -1 and r.is_point_in_range(p.children[1], 0) and r.compare_point(q, 0) == 1
    assert r.compare_boundary_points("start_to_start", Range.within(q)) == -1
    r.surround_contents(E.u())
    assert inner(top) == "<p>o<u>ne <b>two</b> th</u>ree</p><p>four</p>"
    across = Range(p.children[0], 0, q.children[0], 2)
    gone = across.extract_contents()
    assert inner(gone) == "<p>o<u>ne <b>two</b> th</u>ree</p><p>fo</p>" and top.text() == "ur" and across.collapsed
    r2 = Range.within(q)
    r2.set_end_before(q.children[0])
    r2.collapse()
    r2.insert_node(E.i("x"))
    assert inner(q) == "<i>x</i>ur"


def test_walkers_and_observers():
    top = body()
    walker = TreeWalker(top, frozenset(("element",)))
    order = []
    while n := walker.next_node():
        order.append(n.tag)
    assert order == ["div", "p", "b", "p", "ul", "li", "li"]
    assert walker.previous_node().tag == "li" and walker.parent_node().tag == "ul" and walker.first_child().tag == "li" and walker.next_sibling().tag == "li" and walker.previous_sibling().tag == "li"
    texts = NodeIterator(top, frozenset(("text",)), lambda n: n.data.strip())
    assert [n.data for n in texts] == ["one ", "two", " three", "four", "1", "2"] and texts.previous_node().data == "2"
    seen = []
    observer = MutationObserver(seen.extend)
    observer.observe(top)
    top.first("b").remove()
    top.first("ul").attrs["k"] = "v"
    dom.select(top, "li")[0].children[0].data = "9"
    observer.deliver()
    assert [(m.type, m.attribute, len(m.removed)) for m in seen] == [("childList", None, 1), ("attributes", "k", 0), ("characterData", None, 0)] and observer.take_records() == []


def test_shadow_trees():
    top = body("<x-y><template shadowrootmode=open><slot name=a></slot><slot></slot></template><b slot=a>1</b>t<i>2</i></x-y>")
    (shadow,) = dom.declared_shadows(top)
    named, rest = shadow.slots()
    assert [n.tag for n in shadow.assigned_elements(named)] == ["b"] and [n.text() for n in shadow.assigned_nodes(rest)] == ["t", "2"] and "template" not in inner(top)
    own = dom.attach_shadow(E.div(), "closed", clonable=True)
    own.set_inner_html("<p>x</p>")
    assert own.content.text() == "x" and own.clonable
    with pytest.raises(ValueError, match="img"):
        dom.attach_shadow(E.img())


def test_builders():
    page = dom.document(E.h1("T"), E("x-y", {"data-k": "v"}), title="t", lang="en")
    assert serialize(page) == '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>t</title></head><body><h1>T</h1><x-y data-k="v"></x-y></body></html>'
    root = dom.to_etree("<p>a<b>c</b>d<!--e--></p>")
    assert root.find("body/p/b").tail == "d" and serialize(dom.from_etree(root)).endswith("<p>a<b>c</b>d<!--e--></p></body></html>")
    assert serialize(dom.parse_into(dom.TreeBuilder(), PAGE)) == serialize(parse(PAGE))


def test_chains():
    q = Query(PAGE)
    assert q("p").eq(1).attr("class") == "z" and q("li").text() == "12" and len(q("p").parent()) == 1 and q("b").closest("div").has_class("x") and q("div").children("p").filter(".z").html() == "four"
    q("li").add_class("k").toggle_class("m").eq(0).remove_class("k").attr("id", "f").text("n")
    assert q("ul").html() == '<li class="m" id="f">n</li><li class="k m">2</li>' and [i.text() for i in q("li").items()] == ["n", "2"] and len(q("p").siblings(".z")) == 1


def test_over_pages(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<table><tr><th>k<th>k<tr><td>1<td>2</table>")], "page_id bigint, html string")
    got = {r["page_id"]: r["rewritten"] for r in dom.apply(pages, lambda t: dom.strip_tags(t, "b")).collect()}
    assert "<p>one two three</p>" in got[1] and got[2] == "<html><head></head><body></body></html>"
    assert [(r["page_id"], r["value"]) for r in dom.collect(pages, lambda t: [n.tag for n in dom.select(t, "li")]).collect()] == [(1, "li"), (1, "li")]
    assert [r["css"] for r in dom.paths(pages, "b").collect()] == ["#a > p:nth-of-type(1) > b"]
    assert [r["record"] for r in dom.table_records(pages).collect()] == [{"k": "1", "k_2": "2"}]
