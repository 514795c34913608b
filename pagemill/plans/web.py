"""Queries over pages, addresses and texts, with the SQL of those that SQL can express on the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.identifiers import canonical_id, canonical_url
from pagemill.functions.languages import detect_language, profiles
from pagemill.functions.markup import collapse_space, escape
from pagemill.functions.urls import clean_url, registrable_domain, url_parts
from pagemill.operators import extract
from pagemill.operators.cleaning import READABLE, linkify, render, sanitize
from pagemill.operators.conformance import conformance, events, find
from pagemill.operators.edit import annotated_text, normalize, rewrite, select_many
from pagemill.operators.selectors import axis, closest, select
from pagemill.operators.xpath import xpath
from pagemill.operators.xslt import transform
from pagemill.plans.delivery import KEYED, URL
from pagemill.session import materialize, spread_table, table
from pagemill.sources.encodings import decode
from pagemill.sources.nodes import STRUCTURE, parse_nodes, text_of, tokenize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(body: Query) -> Query:
        QUERIES[name] = body
        if sql:
            ORACLES[name] = sql
        return body

    return add


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, sf_dir, "pages")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table, parsed once and written: several joins read it."""
    return materialize(parse_nodes(_pages(spark, sf_dir)), "nodes")


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements with what structural relations need, parsed once and written."""
    return materialize(parse_nodes(_pages(spark, sf_dir), columns=STRUCTURE, elements=True), "elements")


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HTML contents of entries as pages."""
    return spread_table(spark, sf_dir, "entries").select(F.col("row_id").alias("page_id"), F.col("content").alias("html"), F.col("link").alias("url"))


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summaries of entries, some of which carry HTML, as pages."""
    return spread_table(spark, sf_dir, "entries").select(F.col("row_id").alias("page_id"), F.col("summary").alias("html"), F.col("link").alias("url"))


@_query("select_title", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages WHERE html LIKE '%<title>%</title>%'")
def select_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ("page_id", "pre", "last", "parent", "depth", "node_type", "ns", "tag", "data")
    nodes = materialize(parse_nodes(_pages(spark, sf_dir), columns=kept), "nodes")
    return text_of(nodes, select(nodes, "title")).select("page_id", F.col("text").alias("title"))


@_query("count_paragraphs", "SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<p>')) AS tag FROM pages) GROUP BY page_id")
def count_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(parse_nodes(_pages(spark, sf_dir), columns=STRUCTURE, elements=True), "p").groupBy("page_id").agg(F.count("*").alias("n"))


@_query("select_headings", "SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h[1-6]>')) AS tag FROM pages) GROUP BY page_id")
def select_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(parse_nodes(_pages(spark, sf_dir), columns=STRUCTURE, elements=True), ":is(h1, h2, h3, h4, h5, h6)").groupBy("page_id").agg(F.count("*").alias("n"))


@_query("select_descendants", "SELECT page_id, len(regexp_extract_all(html, '<p>')) + len(regexp_extract_all(html, '<li>')) + len(regexp_extract_all(html, '<h[12]>')) AS n FROM pages WHERE regexp_matches(html, '<(p|li|h1|h2)>')")
def select_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(_elements(spark, sf_dir), "html > body *").groupBy("page_id").agg(F.count("*").alias("n"))


@_query("select_has", "SELECT page_id FROM pages WHERE html LIKE '%<body>%<h1>%'")
def select_has(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(_elements(spark, sf_dir), "html:has(> body h1)").select("page_id")


@_query("select_not", "SELECT page_id, len(regexp_extract_all(html, '<li>')) AS n FROM pages WHERE html LIKE '%<li>%'")
def select_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(_elements(spark, sf_dir), "body :not(p, h1, h2, head *)").groupBy("page_id").agg(F.count("*").alias("n"))


@_query("select_attribute", "SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages WHERE html LIKE '%<html lang=%'")
def select_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(parse_nodes(_pages(spark, sf_dir)), "html[lang]").select("page_id", F.try_element_at("attrs", F.lit("lang")).alias("lang"))


@_query("axis_ancestors")
def axis_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _elements(spark, sf_dir)
    return axis(nodes, select(nodes, "p"), "ancestor").groupBy("page_id", "start").agg(F.count("*").alias("n"))


@_query("closest_body", "SELECT page_id, len(regexp_extract_all(html, '<p>')) AS n FROM pages WHERE html LIKE '%<p>%'")
def closest_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _elements(spark, sf_dir)
    return closest(nodes, select(nodes, "p"), "body").groupBy("page_id").agg(F.count("*").alias("n"))


@_query("tokenize_tags", "SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[^<>]*>', 1)) AS name FROM pages) GROUP BY name")
def tokenize_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(_pages(spark, sf_dir)).filter("kind = 'start'").groupBy("name").agg(F.count("*").alias("n"))


@_query("xpath_count", "SELECT page_id, CAST(coalesce(len(regexp_extract_all(html, '<p>')), 0) AS VARCHAR) AS value FROM pages")
def xpath_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xpath(_pages(spark, sf_dir), "count(//p)").select("page_id", "value")


@_query("xpath_lang", "SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS value FROM pages WHERE html LIKE '%<html lang=%'")
def xpath_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xpath(_pages(spark, sf_dir), "/html/@lang").select("page_id", "value")


@_query("xpath_predicate")
def xpath_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xpath(_pages(spark, sf_dir), "//p[string-length(normalize-space()) > 100][position() < 3] | //h1[following-sibling::p]")


@_query("extract_links")
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.links(_summaries(spark, sf_dir))


@_query("extract_tables")
def extract_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.tables(_summaries(spark, sf_dir)).select("page_id", "table_no", "row_no", F.array_join("cells", "\t").alias("cells"))


@_query("extract_metadata", "SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, nullif(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1), '') AS language FROM pages")
def extract_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.metadata(_pages(spark, sf_dir)).select("page_id", "title", "language")


@_query("extract_structured")
def extract_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.structured_data(_pages(spark, sf_dir))
    return found.select("page_id", F.size("json_ld").alias("json_ld"), F.size("microdata").alias("microdata"), F.size("rdfa").alias("rdfa"))


@_query("extract_main")
def extract_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_content(_pages(spark, sf_dir))


@_query("extract_paragraphs", "SELECT page_id, para_no, text, is_heading FROM paragraphs WHERE page_id IN (SELECT page_id FROM pages WHERE html IS NOT NULL)")
def extract_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.paragraphs(_pages(spark, sf_dir)).select("page_id", "para_no", "text", "is_heading")


@_query("extract_dates")
def extract_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.dates(_pages(spark, sf_dir))


@_query("render_text")
def render_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(_pages(spark, sf_dir), "text")


@_query("render_minified")
def render_minified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(_pages(spark, sf_dir), "minified")


@_query("linkify_documents")
def linkify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", "text")
    return linkify(docs, "text").select("doc_id", F.size("links").alias("links"), "linked")


@_query("escape_titles", "SELECT row_id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM entries")
def escape_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entries").select("row_id", escape(F.col("title")).alias("escaped"))


@_query("collapse_summaries", "SELECT row_id, trim(regexp_replace(summary, '[ \\t\\n\\f\\r]+', ' ', 'g')) AS collapsed FROM entries")
def collapse_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entries").select("row_id", collapse_space(F.col("summary")).alias("collapsed"))


@_query("url_hosts", "SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host FROM pages WHERE regexp_matches(url, '^[A-Za-z]+://')")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", url_parts(F.col("url"))["host"].alias("host")).filter("host IS NOT NULL")


@_query("url_domains", "SELECT page_id, nullif(regexp_extract(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '([^.]+[.][^.]+)$', 1), '') AS domain FROM pages WHERE regexp_matches(url, '^[A-Za-z]+://')")
def url_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = url_parts(F.col("url"))["host"]
    return _pages(spark, sf_dir).filter(F.col("url").rlike("^[A-Za-z]+://")).select("page_id", registrable_domain(host).alias("domain"))


@_query(
    "url_canonical",
    "WITH a AS (SELECT row_id, trim(link, ' ' || chr(9) || chr(10) || chr(13)) AS u FROM entries WHERE link IS NOT NULL), "
    "b AS (SELECT row_id, replace(u, '%2D', '-') AS u FROM a), "
    "c AS (SELECT row_id, 'https://' || regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1)), ':(80|443)?$', ''), '^www[.]', '') AS h, "
    "regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(u, '^[A-Za-z]+://[^?#]*[?]([^#]*)', 1) AS q FROM b), "
    "d AS (SELECT row_id, h, regexp_replace(p, '/+$', '') AS p, trim(regexp_replace(q, '(^|&)(utm_[a-z_]+|fbclid)=[^&]*', '', 'g'), '&') AS q FROM c) "
    "SELECT row_id, h || p || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url FROM d",
)
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entries").filter("link IS NOT NULL").select("row_id", canonical_url(F.col("link")).alias("url"))


@_query("url_clean", f"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN {URL.format('url')} END AS url FROM pages")
def url_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", clean_url(F.col("url")).alias("url"))


@_query("id_canonical", KEYED + " SELECT row_id, i AS id FROM keyed")
def id_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entries").select("row_id", canonical_id(F.col("id")).alias("id"))


@_query("decode_bytes", "SELECT page_id, html, CAST(CASE WHEN html IS NULL THEN NULL ELSE 'utf-8' END AS VARCHAR) AS encoding FROM pages")
def decode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _pages(spark, sf_dir).select("page_id", F.encode("html", "utf-8").alias("content"))
    return decode(raw, "content").select("page_id", "html", "encoding")


@_query("conformance_messages")
def conformance_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformance(_nodes(spark, sf_dir))


@_query("conformance_title", "SELECT page_id, 'missing-title' AS code FROM pages WHERE html IS NULL OR html NOT LIKE '%<title>%'")
def conformance_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformance(_nodes(spark, sf_dir)).filter("code = 'missing-title'").select("page_id", "code")


@_query("select_together", "SELECT page_id, 'p' AS name, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n FROM pages WHERE html LIKE '%<p>%' UNION ALL SELECT page_id, 'heading', CAST(len(regexp_extract_all(html, '<h[1-6]>')) AS BIGINT) FROM pages WHERE regexp_matches(html, '<h[1-6]>')")
def select_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = select_many(_pages(spark, sf_dir), {"p": "body p", "heading": ":is(h1, h2, h3, h4, h5, h6)"})
    return found.groupBy("page_id", "name").agg(F.count("*").alias("n"))


@_query("annotate_pages")
def annotate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotated_text(_pages(spark, sf_dir), {"heading": "h1, h2", "paragraph": "p"}).select("page_id", F.length("text").alias("length"), F.size("spans").alias("spans"))


STYLESHEET = """<xsl:stylesheet xmlns:xsl="http://www.w3.org/1999/XSL/Transform" version="1.0"><xsl:output method="text"/>
<xsl:template match="/"><xsl:value-of select="count(//p)"/>,<xsl:value-of select="/html/@lang"/></xsl:template></xsl:stylesheet>"""


@_query("transform_pages", "SELECT page_id, coalesce(len(regexp_extract_all(html, '<p>')), 0) || ',' || coalesce(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1), '') AS result FROM pages")
def transform_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(_pages(spark, sf_dir), STYLESHEET).select("page_id", "result")


@_query("normalize_titles", "SELECT row_id, nfc_normalize(title) AS title FROM entries")
def normalize_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(table(spark, sf_dir, "entries").select("row_id", "title"), "title")


@_query("detect_languages")
def detect_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spread_table(spark, sf_dir, "paragraphs").select("para_id", "text")
    return detect_language(texts, "text", profiles(table(spark, sf_dir, "langsamples"))).select("para_id", "language", "confidence")


def _every(spark: SparkSession, sf_dir: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The operator over all pages, contents and summaries, with their ``source``."""
    sources = {"pages": _pages, "contents": _contents, "summaries": _summaries}
    return reduce(DataFrame.unionByName, [operator(rows(spark, sf_dir)).withColumn("source", F.lit(name)) for name, rows in sources.items()])


@_query("sanitize_pages")
def sanitize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _every(spark, sf_dir, lambda rows: sanitize(rows, READABLE).select("page_id", "clean"))


@_query("sanitize_contents", "SELECT row_id AS page_id, coalesce(content, '') AS clean FROM entries")
def sanitize_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents are clean by nature, so every one of them must come back as it is."""
    return sanitize(_contents(spark, sf_dir), READABLE).select("page_id", "clean")


@_query("rewrite_pages")
def rewrite_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _every(spark, sf_dir, lambda rows: rewrite(rows, [("rename", "p", "div"), ("comments",)]))


@_query("render_markdown")
def render_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _every(spark, sf_dir, lambda rows: render(rows, "markdown"))


@_query("xpath_longest")
def xpath_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _every(spark, sf_dir, lambda rows: xpath(rows, "//p").groupBy("page_id").agg(F.max(F.length("value")).cast("string").alias("value")))


_ONE_LINE = "nullif(trim(regexp_replace({0}, '[ \\t\\n\\f\\r]+', ' ', 'g'), ' '), '')"


@_query(
    "feed_entries",
    "SELECT row_id AS page_id, 'rss' AS type, 'All' AS feed_title, " + ", ".join(f"{_ONE_LINE.format(c)} AS {c}" for c in ("title", "link", "id", "published", "summary", "author")) + ", nullif(content, '') AS content FROM entries",
)
def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry as an item of a feed document, with the fields that it has, read back by the feed operator."""
    fields = {"title": "title", "link": "link", "guid": "id", "pubDate": "published", "description": "summary", "author": "author", "content:encoded": "content"}
    parts = [F.coalesce(F.concat(F.lit(f"<{tag}>"), escape(F.col(c)), F.lit(f"</{tag}>")), F.lit("")) for tag, c in fields.items()]
    xml = F.concat(F.lit("<rss version='2.0' xmlns:content='http://purl.org/rss/1.0/modules/content/'><channel><title>All</title><item>"), *parts, F.lit("</item></channel></rss>"))
    rows = spread_table(spark, sf_dir, "entries").select(F.col("row_id").alias("page_id"), xml.alias("xml"))
    return extract.feed(rows).select("page_id", "type", "feed_title", "title", "link", "id", "published", "summary", "author", "content")


@_query("find_text", "SELECT page_id, n FROM (SELECT page_id, CAST(len(regexp_extract_all(html, '<p>[^<]*(?:lantern|Laterne)')) AS BIGINT) AS n FROM pages) WHERE n > 0")
def find_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(_nodes(spark, sf_dir), tag="p", text="lantern|Laterne", within="body").groupBy("page_id").agg(F.count("*").alias("n"))


@_query("walk_events", "SELECT page_id, CASE WHEN html IS NULL THEN 3 ELSE CAST(len(regexp_extract_all(html, '<[a-z][a-z0-9]*[^<>]*>')) AS BIGINT) END AS n FROM pages")
def walk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and unfinished pages have the elements that tree construction gives them."""
    return events(parse_nodes(_pages(spark, sf_dir))).filter("kind = 'start'").groupBy("page_id").agg(F.count("*").alias("n"))
