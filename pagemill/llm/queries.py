"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.boilerplate import boilerplate
from pagemill.llm.garbled import damaged, repair
from pagemill.llm.languages import documents_languages, mislabelled, passages
from pagemill.llm.markup import convert
from pagemill.llm.mixing import mix
from pagemill.llm.packing import container_fill, divided, pack
from pagemill.llm.personal import mentions, redact
from pagemill.session import spread_table, table


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the summaries of entries and the texts of paragraphs, with the declared language."""
    entries = spread_table(spark, sf_dir, "entries").select(F.lit("entries").alias("table_name"), "row_id", "lang", F.col("summary").alias("text"))
    paragraphs = spread_table(spark, sf_dir, "paragraphs").select(F.lit("paragraphs").alias("table_name"), F.col("para_id").alias("row_id"), "lang", "text")
    return passages(entries.union(paragraphs), "text", table(spark, sf_dir, "langsamples"), "lang")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mislabelled(_labelled(spark, sf_dir), "lang")
    return found.select("table_name", "row_id", F.col("language").alias("lang"))


def p1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_languages(_labelled(spark, sf_dir)).select("table_name", "row_id", "language", "confidence")


def p1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("table_name", "row_id", F.inline("passages"))


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of entries and descriptions of feeds."""
    entries = spread_table(spark, sf_dir, "entries").select(F.lit("entries").alias("table_name"), "row_id", F.col("summary").alias("text"))
    feeds = table(spark, sf_dir, "feeds").select(F.lit("feeds").alias("table_name"), F.col("snap_id").alias("row_id"), F.col("description").alias("text"))
    return entries.union(feeds)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert(_described(spark, sf_dir), "text", cleaning=False).filter(F.size("families") > 0).select("table_name", "row_id")


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert(_described(spark, sf_dir), "text").select("table_name", "row_id", F.array_join("families", " ").alias("families"), "clean")


def p4_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_replace(F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/?#:]+)", 1), r"^(?:www|m|blog)\.", "")
    pages = table(spark, sf_dir, "pages").select("page_id", F.nullif(host, F.lit("")).alias("host"))
    units = table(spark, sf_dir, "paragraphs").join(pages, "page_id", "left")
    return boilerplate(units.select("host", "page_id", F.col("para_id").alias("unit_id"), "text"))


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and summaries of entries and texts of paragraphs, one row per value."""

    def field(name: str, key: str, column: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.lit(name).alias("table_name"), F.col(key).alias("row_id"), F.lit(column).alias("field"), F.col(column).alias("text"))

    return field("entries", "row_id", "title").union(field("entries", "row_id", "summary")).union(field("paragraphs", "para_id", "text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged(_decoded(spark, sf_dir))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(_decoded(spark, sf_dir))


#: Share of a container that loss-bearing tokens may take. The documents have about 0.52, so it binds in part.
LOSS_SHARE = 0.6


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    capacity = table(spark, sf_dir, "containers").orderBy("kind").head()["capacity"]  # one kind of container at a time
    return pack(spread_table(spark, sf_dir, "documents").select("doc_id", "text"), capacity, loss_capacity=int(capacity * LOSS_SHARE)), capacity


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divided(_packed(spark, sf_dir)[0])


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)[0]


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container_fill(*_packed(spark, sf_dir))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spread_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "mixtargets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spread_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "mixtargets"))[1]


def _mentions(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    return mentions(spread_table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "namelist"), with_text)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _mentions(spark, sf_dir, False).select("doc_id", F.explode("found").alias("m"))
    return found.select("doc_id", F.col("m.type").alias("pii_type"), F.col("m.start").alias("start_pos"))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(_mentions(spark, sf_dir, True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_documents": p1_documents,
    "p1_passages": p1_passages,
    "p4_found": p4_found,
    "p4_clean": p4_clean,
    "p4_boilerplate": p4_boilerplate,
    "p5_found": p5_found,
    "p5_repaired": p5_repaired,
    "p6_found": p6_found,
    "p6_pack": p6_pack,
    "p6_fill": p6_fill,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
}
ORACLES: dict[str, str] = {}
#: What the benchmark runs.
HEADLINE = ["p1_found", "p4_found", "p4_clean", "p5_found", "p6_found", "p7_mix", "p8_found"]
