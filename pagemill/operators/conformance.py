"""Authoring conformance of pages as relational rules over node rows.

Each rule is a filter, an anti-join or an aggregation; their union is one plan. Messages: ``page_id, code, severity, pre,
message``; ``pre`` is the node concerned, or that of the document for rules about a whole page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.selectors import select

# Elements and attributes that the standard calls obsolete.
OBSOLETE = "acronym applet basefont bgsound big blink center dir font frame frameset isindex keygen listing marquee menuitem multicol nextid nobr noembed noframes param plaintext rb rtc spacer strike tt xmp".split()
OBSOLETE_ATTRIBUTES = {
    "a": "charset coords methods name rev shape urn", "body": "alink background bgcolor link marginheight marginwidth text vlink", "br": "clear", "caption": "align",
    "col": "align char charoff valign width", "div": "align", "h1": "align", "h2": "align", "h3": "align", "h4": "align", "h5": "align", "h6": "align", "hr": "align color noshade size width",
    "html": "version manifest", "iframe": "align allowtransparency frameborder hspace longdesc marginheight marginwidth scrolling vspace", "img": "align border hspace longdesc lowsrc name vspace",
    "input": "align border hspace ismap usemap vspace", "li": "type", "link": "charset methods rev target urn", "meta": "scheme", "object": "align archive border classid code codebase codetype declare hspace standby vspace",
    "ol": "compact", "p": "align", "pre": "width", "script": "charset event for language", "table": "align bgcolor border bordercolor cellpadding cellspacing datapagesize frame height rules summary width",
    "tbody": "align char charoff valign", "td": "abbr align axis bgcolor char charoff height nowrap scope valign width", "th": "align axis bgcolor char charoff height nowrap valign width", "tr": "align bgcolor char charoff valign", "ul": "compact type",
}
ROLES = (
    "alert alertdialog application article banner blockquote button caption cell checkbox code columnheader combobox complementary contentinfo definition deletion dialog directory "
    "document emphasis feed figure form generic grid gridcell group heading img insertion link list listbox listitem log main mark marquee math menu menubar menuitem "
    "menuitemcheckbox menuitemradio meter navigation none note option paragraph presentation progressbar radio radiogroup region row rowgroup rowheader scrollbar search searchbox "
    "separator slider spinbutton status strong subscript superscript switch tab table tablist tabpanel term textbox time timer toolbar tooltip tree treegrid treeitem"
).split()
IMPLICIT = {"article": "article", "aside": "complementary", "button": "button", "dialog": "dialog", "figure": "figure", "form": "form", "hr": "separator", "li": "listitem", "main": "main", "nav": "navigation", "ol": "list", "option": "option", "p": "paragraph", "progress": "progressbar", "table": "table", "tbody": "rowgroup", "textarea": "textbox", "ul": "list"} | {f"h{i}": "heading" for i in range(1, 7)}


def _has(name: str) -> Column:
    return F.map_contains_key("attrs", F.lit(name))


def _attr(name: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))))


def _say(rows: DataFrame, code: str, severity: str, message: Column | str) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return rows.select("page_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), "pre", text.alias("message"))


def conformance(nodes: DataFrame) -> DataFrame:
    """All messages about the pages of a node table; a page without fault has none."""
    elements = nodes.filter("node_type = 'element' AND ns = 'html'")
    pages = nodes.filter("node_type = 'document'").select("page_id", "pre")
    tag = F.col("tag")
    implicit = F.create_map(*[F.lit(x) for kv in IMPLICIT.items() for x in kv])
    worn = F.create_map(*[x for k, v in OBSOLETE_ATTRIBUTES.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v.split()]))])
    used = elements.select("page_id", "pre", "tag", F.explode(F.array_intersect(F.map_keys("attrs"), F.try_element_at(worn, tag))).alias("name"))
    headings = elements.filter(tag.rlike("^h[1-6]$"))
    shown = nodes.filter("node_type = 'text' AND trim(data) <> '' OR tag = 'img'").select(F.col("page_id").alias("o_page"), F.col("pre").alias("o_pre"))
    full = (headings["page_id"] == shown["o_page"]) & (shown["o_pre"] > headings["pre"]) & (shown["o_pre"] <= headings["last"])
    sections = elements.filter("tag = 'section'")
    heads = headings.select(F.col("page_id").alias("o_page"), F.col("pre").alias("o_pre"))
    led = (sections["page_id"] == heads["o_page"]) & (heads["o_pre"] > sections["pre"]) & (heads["o_pre"] <= sections["last"])
    twice = (
        elements.filter(_has("id"))
        .groupBy("page_id", F.try_element_at("attrs", F.lit("id")).alias("id"))
        .agg(F.count("*").alias("n"), F.max("pre").alias("pre"))
        .filter("n > 1 AND id <> ''")
    )
    role = F.split(_attr("role"), r"\s+")
    script = (tag == "script") & _attr("type").isin("text/javascript", "application/javascript") | (tag == "style") & (_attr("type") == "text/css")
    rules = [
        _say(elements.filter((tag == "img") & ~_has("alt")), "img-missing-alt", "error", "an img has no alt"),
        _say(elements.filter((tag == "area") & _has("href") & ~_has("alt")), "area-missing-alt", "error", "an area has no alt"),
        _say(elements.filter((tag == "input") & (_attr("type") == "image") & ~_has("alt")), "input-image-missing-alt", "error", "an image input has no alt"),
        _say(elements.filter(tag.isin(OBSOLETE)), "obsolete-element", "error", F.concat(tag, F.lit(" is obsolete"))),
        _say(used, "obsolete-attribute", "error", F.concat(F.col("name"), F.lit(" is obsolete on "), tag)),
        _say(elements.filter((_attr("role") != "") & (F.size(F.array_except(role, F.array(*[F.lit(r) for r in ROLES]))) > 0)), "aria-invalid-role", "error", F.concat(F.lit("no role "), _attr("role"))),
        _say(elements.filter((_attr("role") != "") & (_attr("role") == F.try_element_at(implicit, tag))), "aria-redundant-role", "warning", F.concat(_attr("role"), F.lit(" is the role of "), tag)),
        _say(elements.filter(script), "redundant-type-attribute", "info", F.concat(F.lit("the type of "), tag, F.lit(" is the default"))),
        _say(headings.join(shown, full, "left_anti"), "empty-heading", "warning", "a heading has no content"),
        _say(sections.join(heads, led, "left_anti"), "section-no-heading", "warning", "a section has no heading"),
        _say(twice, "duplicate-id", "error", F.concat(F.lit("the id "), F.col("id"), F.lit(" occurs again"))),
        _say(elements.filter((tag == "html") & (_attr("lang") == "")), "missing-lang", "warning", "html has no lang"),
        _say(pages.join(elements.filter("tag = 'title'").select("page_id"), "page_id", "left_anti"), "missing-title", "error", "the page has no title"),
    ]
    return reduce(DataFrame.unionByName, rules)


def find(nodes: DataFrame, tag: str | list[str] | None = None, attrs: dict | None = None, class_: str | list[str] | None = None, text: str | None = None, within: str | None = None) -> DataFrame:
    """Element rows by filters: ``tag`` names, ``attrs`` values, ``class_`` names and the pattern ``text`` of their own text.

    A value may be a text, a list of texts of which one must fit, or true or false for present or absent; a text that begins
    with ``re:`` is a pattern. ``within`` is a selector that must have been met above.
    """

    def fits(value: Column, wanted: object) -> Column:
        if isinstance(wanted, bool):
            return value.isNotNull() if wanted else value.isNull()
        if isinstance(wanted, list):
            return reduce(lambda a, b: a | b, [fits(value, w) for w in wanted], F.lit(False))
        test = value.rlike(wanted[3:]) if wanted.startswith("re:") else value == wanted
        return F.coalesce(test, F.lit(False))

    found = nodes.filter("node_type = 'element'")
    if tag is not None:
        found = found.filter(fits(F.col("tag"), tag))
    for name, wanted in (attrs or {}).items():
        found = found.filter(fits(F.try_element_at("attrs", F.lit(name)), wanted))
    if class_ is not None:
        names = [class_] if isinstance(class_, str) else class_
        found = found.filter(reduce(lambda a, b: a | b, [F.exists("classes", lambda c, n=n: fits(c, n)) for n in names]))
    if text is not None:
        own = nodes.filter("node_type = 'text'").filter(F.col("data").rlike(text)).select("page_id", F.col("parent").alias("pre"))
        found = found.join(own.distinct(), ["page_id", "pre"], "left_semi")
    if within is not None:
        above = select(nodes, within).select(F.col("page_id").alias("o_page"), F.col("pre").alias("o_pre"), F.col("last").alias("o_last"))
        found = found.join(above, (found["page_id"] == above["o_page"]) & (found["pre"] > above["o_pre"]) & (found["pre"] <= above["o_last"]), "left_semi")
    return found


def events(nodes: DataFrame) -> DataFrame:
    """The events of walking the tree: ``page_id, seq, kind, name, data``; an element starts at its node and ends after its last."""
    starts = nodes.filter("node_type <> 'document'").select(
        "page_id", F.struct(F.col("pre").alias("at"), F.lit(1).alias("end"), F.lit(0).alias("depth")).alias("o"),
        F.when(F.col("node_type") == "element", "start").otherwise(F.col("node_type")).alias("kind"), F.col("tag").alias("name"), "data",
    )
    ends = nodes.filter("node_type = 'element'").select(
        "page_id", F.struct(F.col("last").alias("at"), F.lit(2).alias("end"), (-F.col("depth")).alias("depth")).alias("o"), F.lit("end").alias("kind"), F.col("tag").alias("name"), F.lit(None).cast("string").alias("data")
    )
    from pyspark.sql.window import Window

    return starts.unionByName(ends).withColumn("seq", F.row_number().over(Window.partitionBy("page_id").orderBy("o"))).drop("o")
