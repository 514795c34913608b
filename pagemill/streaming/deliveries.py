"""Deliveries as a stream: every micro-batch is upserted into the store of identifiers, and merged with the others now and then.

A micro-batch that Spark runs again after a failure has the same number and replaces its own run; one that was merged already is merged
again without effect. So each delivery counts once, whatever is lost in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators.upsert import GROUP, SortedStore, identifier_rows


def delivery_store(spark, path: str) -> SortedStore:
    """The store of a stream's deliveries, as :func:`pagemill.operators.upsert.membership` lays it out."""
    return SortedStore(spark, [*GROUP, "block", "blocks"], {"members": F.array_union}, path)


def upsert_deliveries(entries: DataFrame, path: str, checkpoint: str, blocks: int = 16, every: int = 8, **trigger: object) -> StreamingQuery:
    """Start a query that keeps the store under ``path`` up to date with a stream of entries.

    Each identifier is spread over ``blocks`` rows of the store by the hash of ``row_id``, since a stream cannot know beforehand which
    will be large. The runs are merged after every ``every`` micro-batches. ``trigger`` is that of ``writeStream``.
    """

    def batch(rows: DataFrame, number: int) -> None:
        store = delivery_store(rows.sparkSession, path)
        keyed = identifier_rows(rows).withColumn("blocks", F.lit(blocks)).withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int"))
        store.upsert(keyed, [F.collect_set(F.struct("row_id", "has_id")).alias("members")], f"batch{number:012d}")
        if number % every == every - 1:
            store.compact()

    writer = entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def item_sizes(spark, path: str) -> DataFrame:
    """``feed_id``, ``kind``, ``key`` and ``deliveries``: how many distinct rows delivered each identifier, read from the compacted store."""
    return delivery_store(spark, path).compact().groupBy(*GROUP).agg(F.sum(F.size("members")).alias("deliveries"))
