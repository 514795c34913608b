"""What is planned, parsed or matched once for a whole family of selectors, forms or fields."""

from __future__ import annotations

import pytest

from pagemill.functions.markup import to_markdown
from pagemill.operators import cleaning, edit, extract
from pagemill.operators.selectors import SelectorError, parse_selector, select, select_all
from pagemill.plans import catalog
from pagemill.sources.nodes import SELECTABLE, parse_nodes
from pagemill.sources.tree import parse

#: Beside the forest: templates, comments and empty texts in elements, tags in capitals, a null page.
PAGES = [
    catalog._FOREST.replace("{t}", "A &amp; b"),
    "<div id=a><p></p><p><!-- c --></p><p> </p><p><i></i></p><template><p id=t></p></template><template></template></div><DIV class='k k'><P>x<p CLASS=k>y</DIV><svg><a href=u /><clipPath/></svg>",
    "<fieldset disabled><legend><input id=in></legend><input id=out></fieldset><form><input type=image><button>b</button></form><ul><li><ul><li class=k>1<li>2</ul><li class=k>3</ul>",
    "",
    None,
]
SELECTORS = ["span:empty", "div > :first-child", "p:nth-child(2 of .c)", "p:empty, div > p.k", "div > p, p", "template:empty", "ul > li:nth-child(2), ol > li", "a, clipPath"]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(list(enumerate(PAGES)), "page_id bigint, html string").cache()


def test_selectors_of_one_plan(pages):
    whole = parse_nodes(pages).cache()
    lean = parse_nodes(pages, columns=SELECTABLE, elements=True).cache()
    wanted = sorted((s, r["page_id"], r["pre"]) for s in SELECTORS for r in select(whole, s).select("page_id", "pre").collect())
    for nodes in (whole, lean):
        assert sorted(map(tuple, select_all(nodes, {s: s for s in SELECTORS}).select("name", "page_id", "pre").collect())) == wanted
    with pytest.raises(SelectorError):
        select_all(lean, {"x": "p:bad"})
    with pytest.raises(ValueError, match="no selectors"):
        select_all(lean, {})


def test_structure_needs_few_joins(spark, pages, tmp_path):
    pages.selectExpr("page_id AS row_id", "html AS title").write.parquet(f"{tmp_path}/entries.parquet")
    plan = catalog.QUERIES["selectors_structure"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 2


def test_an_article_is_parsed_once(monkeypatch):
    """The kernel without Spark: one tree a page, whatever the number of columns."""
    parsed, parse = [], extract.parse
    monkeypatch.setattr(extract, "parse", lambda text: parsed.append(text) or parse(text))
    monkeypatch.setattr(extract, "per_page", lambda pages, kernel, schema, *rest, **more: kernel(pages, "http://a.example/"))
    page = "<title>T</title><meta name=date content=2024-05-06><link rel=canonical href=/c><p>" + "long words, and more of them " * 3
    (row,) = extract.articles(page)
    assert parsed == [page]
    assert row[0] == "T" and row[2] == "2024-05-06" and row[7] == "http://a.example/c"


#: Selectors for which lists of elements could be wrong: letter case, lists in lists, roots, nothing.
TRICKY = ["P", "*", "[CLASS]", "LI.k", "clippath", "clipPath", ":is(p:bad, li)", ":is(.k, #in):not(x)", ":has(i)", ":root > body", ":scope", "svg *", "body :not(p, li, :has(*))", "p:hover", ":is(a:hover, li)"]


def test_listed_elements_are_all():
    every = {s: parse_selector(s) for s in [*(s for group in catalog._SELECTORS.values() for s in group), *SELECTORS, *TRICKY]}
    for page in PAGES:
        document = parse(page)
        wanted = [(s, [n for n in document.elements() if any(edit.matches(n, c) for c in cs)]) for s, cs in every.items()]
        assert edit.selected(document, {s: [(c, edit._keys(c)) for c in cs] for s, cs in every.items()}) == wanted


def test_only_listed_elements_are_tried(monkeypatch):
    tried, matches = [], edit.matches
    monkeypatch.setattr(edit, "matches", lambda n, *rest: tried.append(n) or matches(n, *rest))
    monkeypatch.setattr(edit, "per_page", lambda pages, kernel, *rest, **more: kernel(pages))
    assert [(r[0], r[2]) for r in edit.select_many(PAGES[0], {"a": "#p1", "b": "li", "c": "p:hover"})] == [("a", "p"), *[("b", "li")] * 4]
    assert len(tried) == 5


def test_rows_with_one_key_stay_apart(spark, tmp_path):
    """As in the SQL: rows of a table are not summed up by their key."""
    spark.createDataFrame([(1, "a"), (1, "b")], "row_id bigint, title string").write.parquet(f"{tmp_path}/entries.parquet")
    rows = [r["n"] for r in catalog.QUERIES["selectors_together"](spark, str(tmp_path)).filter("selector = 'p'").collect()]
    assert rows == [4, 4]


def test_a_page_is_parsed_once_for_all_forms(monkeypatch):
    parsed = []
    monkeypatch.setattr(cleaning, "parse", lambda text: parsed.append(text) or parse(text))
    monkeypatch.setattr(cleaning, "per_page", lambda pages, kernel, *rest, **more: kernel(pages))
    page = catalog._DOC.replace("{t}", "A _title_")
    options = {name: o for name, (o, _) in catalog._MARKDOWN.items()}
    assert cleaning.render_many(page, "markdown", options) == [(to_markdown(parse(page), o), name) for name, o in options.items()]
    assert parsed == [page]
    with pytest.raises(ValueError, match="change the tree"):
        cleaning.render_many(page, "minified", {})
