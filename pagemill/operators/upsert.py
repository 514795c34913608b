"""At-least-once deliveries: idempotent upsert into hash-bucketed sorted storage, merged by compaction.

Every batch becomes one *run*: a table bucketed by the hash of the identifier and sorted by it inside each bucket, under a
name of its own in the folder of the store. A run is collapsed with map-side aggregation before it is shuffled, so an
identifier that holds a third of all rows arrives at its bucket as one row per map task. Runs are unique by identifier;
compaction merges sorted runs bucket by bucket with a full outer sort-merge join that needs neither exchange nor sort, equal
identifiers collapse to one row, and the merged run takes the place of its parts. Writing a batch twice changes nothing:
its run is replaced, and merging is idempotent.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.identifiers import canonical_id, canonical_url
from pagemill.session import TABLES, materialize, scratch

#: Rows of one identifier that one row of the store may list; larger groups are cut into blocks of this size.
BLOCK = 2_000


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


class SortedStore:
    """Runs of rows keyed by ``keys`` in ``buckets`` hash buckets, each bucket one file sorted by the keys.

    ``merge`` names every other column of a run with the way in which two values of equal keys, the older one first, become
    one. It must be idempotent: merging a value with itself gives that value.

    The store lives in the folder ``path`` (a fresh one under the shared checkpoint folder by default); a store opened
    again on its folder, in another session too, has its runs. Key columns must not be null, else equal keys could not be
    merged without an exchange. An empty run is a valid run. Buckets follow ``spark.sql.shuffle.partitions``, which grows
    with the data of a job, and must not change during the life of a store.
    """

    def __init__(self, spark: SparkSession, keys: list[str], merge: dict[str, Callable[[Column, Column], Column]], path: str | None = None, buckets: int | None = None) -> None:
        self.spark, self.keys, self.merge = spark, keys, merge
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = path or scratch(spark, "store")
        self.name = f"store_{uuid.uuid4().hex[:12]}"

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def runs(self) -> list[str]:
        """Names of the finished runs in the folder."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted(n for n in names if fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def run(self, name: str) -> DataFrame:
        """A run as a bucketed table."""
        table = f"{self.name}_{name}"
        TABLES.add(table)
        if not self.spark.catalog.tableExists(table):
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(f"{self.path}/{name}").schema)
            keys = ", ".join(self.keys)
            self.spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(table)

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, already dealt out by the hash of the keys, as the run ``name``; replaces a run of that name."""
        table = f"{self.name}_{name}"
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        # One task holds whole buckets, so each bucket is one file, as long as the partitions are not merged unevenly.
        writer = df.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).format("parquet").mode("overwrite")
        writer.option("path", f"{self.path}/{name}").saveAsTable(table)
        TABLES.add(table)
        return self.spark.table(table)

    def upsert(self, df: DataFrame, collapse: list[Column], name: str) -> DataFrame:
        """Collapse ``df`` to one row per key by the aggregates ``collapse`` and write it as the run ``name``."""
        with _setting(self.spark, "spark.sql.shuffle.partitions", str(self.buckets)):
            return self._write(df.groupBy(*self.keys).agg(*collapse), name)

    def compact(self) -> DataFrame:
        """Merge all runs into one, bucket by bucket, and drop its parts once it is written.

        A compaction that was cut off leaves parts beside the run that already holds them; merging them again changes nothing.
        """
        names = self.runs()
        while len(names) > 1:
            # The scan of a bucket with one sorted file keeps its order only under this setting.
            with _setting(self.spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true"):
                merged = [(names[i : i + 2], f"merged{uuid.uuid4().hex[:12]}") for i in range(0, len(names) - 1, 2)]
                for parts, name in merged:
                    self._write(self._merged(*map(self.run, parts)), name)
            for parts, _ in merged:
                self._drop(parts)
            names = self.runs()
        return self.run(names[0])

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        left = a.select(*self.keys, *[F.col(c).alias(f"_a_{c}") for c in self.merge])
        right = b.select(*self.keys, *[F.col(c).alias(f"_b_{c}") for c in self.merge])
        on = reduce(lambda x, y: x & y, [left[k] == right[k] for k in self.keys])
        both = left.join(right.hint("merge"), on, "full_outer")
        values = [F.when(F.col(f"_a_{c}").isNull(), F.col(f"_b_{c}")).when(F.col(f"_b_{c}").isNull(), F.col(f"_a_{c}")).otherwise(way(F.col(f"_a_{c}"), F.col(f"_b_{c}"))).alias(c) for c, way in self.merge.items()]
        return both.select(*[F.coalesce(left[k], right[k]).alias(k) for k in self.keys], *values)

    def _drop(self, names: list[str]) -> None:
        fs, path = self._fs()
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{name}")
            fs.delete(path(f"{self.path}/{name}"), True)


def deliveries(entries: DataFrame) -> DataFrame:
    """``feed_id``, ``row_id``, ``batch_id``, canonical ``id_key`` and ``link_key`` of every delivered row."""
    return entries.select(
        "feed_id", "row_id", "batch_id", canonical_id(F.col("id")).alias("id_key"), canonical_url(F.col("link")).alias("link_key")
    )


def identifier_rows(entries: DataFrame) -> DataFrame:
    """Storage rows: (feed_id, kind, key) to a delivery. A row stands under its id and under its link, if it has them."""
    rows = deliveries(entries).filter("feed_id IS NOT NULL AND row_id IS NOT NULL")
    both = F.array(
        F.struct(F.lit("id").alias("kind"), F.col("id_key").alias("key")),
        F.struct(F.lit("link").alias("kind"), F.col("link_key").alias("key")),
    )
    return rows.select(
        "feed_id", "row_id", "batch_id", F.col("id_key").isNotNull().alias("has_id"), F.explode(both).alias("k")
    ).select("feed_id", F.col("k.kind").alias("kind"), F.col("k.key").alias("key"), "row_id", "has_id", "batch_id").filter(
        "key IS NOT NULL"
    )


GROUP = ["feed_id", "kind", "key"]


def membership(entries: DataFrame, runs: int = 2, path: str | None = None) -> DataFrame:
    """The compacted store of the deliveries: one row for each identifier of a feed and block, with its ``members``.

    ``feed_id``, ``kind`` (id or link), ``key``, ``block`` of ``blocks``, and ``members``, the set of (``row_id``,
    ``has_id``). Identifiers with more than ``BLOCK`` rows are cut into blocks by the hash of ``row_id``, so no row of the
    store grows with the data. Batches are upserted in ``runs`` runs; each row of the input is read once.
    """
    spark = entries.sparkSession
    keyed = materialize(identifier_rows(entries), "keyed")
    hot = keyed.groupBy(*GROUP).count().filter(F.col("count") > BLOCK)
    blocks = F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("int")
    keyed = keyed.join(hot, GROUP, "left").withColumn("blocks", blocks)
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int"))
    store = SortedStore(spark, [*GROUP, "block", "blocks"], {"members": F.array_union}, path)
    part = F.pmod(F.coalesce(F.col("batch_id"), F.lit(0)), F.lit(runs))
    members = F.collect_set(F.struct("row_id", "has_id")).alias("members")
    for r in range(runs):
        store.upsert(keyed.filter(part == r), [members], f"run{r}")
    return store.compact()


def item_pairs(entries: DataFrame, runs: int = 2) -> DataFrame:
    """Pairs ``(row_a, row_b)``, smaller first, of rows that deliver the same item of the same feed.

    Two rows deliver the same item when their canonical ids are equal or, if at least one of them has no id, their
    canonical links are. Rows with neither are in no pair; repeated rows are one row. Needs ``row_id`` (unique but for
    repeated rows), ``feed_id``, ``batch_id``, ``id`` and ``link``; other columns are ignored. An empty table gives no pairs.

    The pairs are read from the compacted store (``membership``): those within a block from its row, those between the
    blocks of a large group from two rows, so no task holds such a group. Two rows with ids pair by id only, others by link
    only, and equal identifiers are one row of the store, so no pair arises twice.
    """
    stored = membership(entries, runs)

    def pairs(df: DataFrame, a: Column, b: Column) -> DataFrame:
        both = df.select("kind", F.explode(a).alias("a"), b.alias("others")).select("kind", "a", F.explode("others").alias("b"))
        wanted = (F.col("kind") == "id") | ~F.col("a.has_id") | ~F.col("b.has_id")
        return both.filter(wanted).select(F.least("a.row_id", "b.row_id").alias("row_a"), F.greatest("a.row_id", "b.row_id").alias("row_b")).filter("row_a < row_b")

    # Sorted, so that each member meets those after it.
    many = stored.filter("size(members) > 1").select("kind", F.array_sort("members").alias("members"))
    each = many.select("kind", "members", F.posexplode("members").alias("at", "member"))
    within = pairs(each, F.array("member"), F.slice("members", F.col("at") + 2, F.size("members")))
    cut = stored.filter("blocks > 1")
    ahead = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x > F.col("block"))
    asking = cut.select(*GROUP, F.explode(ahead).alias("other"), "members")
    facing = cut.select(*GROUP, F.col("block").alias("other"), F.col("members").alias("facing"))
    across = pairs(asking.join(facing, [*GROUP, "other"]), F.col("members"), F.col("facing"))
    return within.union(across)


def latest_items(entries: DataFrame, runs: int = 2, path: str | None = None) -> DataFrame:
    """Exactly one row of ``entries`` for each item, all columns kept, with its ``item_key``.

    The item of a row is its feed and canonical id; without an id, the id that another row of the feed has under the same
    link (the smallest, if there are several); without one, the link. Rows with neither stand for themselves. Of several
    deliveries the one received last stays, of equally late ones the one with the greatest ``row_id``; null times count
    as earliest. Upserting the same batch again changes nothing. Empty input gives an empty result. A column of the input
    named ``item_key`` is replaced.
    """
    spark = entries.sparkSession
    data = [c for c in entries.columns if c != "item_key"]
    keyed = entries.select(*data).withColumn("_id", canonical_id(F.col("id"))).withColumn("_link", canonical_url(F.col("link")))
    known = (
        keyed.filter("_id IS NOT NULL AND _link IS NOT NULL")
        .groupBy(F.col("feed_id").alias("_f"), F.col("_link").alias("_l"))
        .agg(F.min("_id").alias("_by_link"))
    )
    on = keyed.feed_id.eqNullSafe(known._f) & (keyed._link == known._l) & keyed._id.isNull()
    item = (
        F.when(F.coalesce("_id", "_by_link").isNotNull(), F.concat(F.lit(":id:"), F.coalesce("_id", "_by_link")))
        .when(F.col("_link").isNotNull(), F.concat(F.lit(":link:"), F.col("_link")))
        .otherwise(F.concat(F.lit(":row:"), F.coalesce(F.col("row_id").cast("string"), F.lit(""))))
    )
    feed = F.coalesce(F.col("feed_id").cast("string"), F.lit(""))
    rows = materialize(keyed.join(known, on, "left").select(*data, F.concat(feed, item).alias("item_key")), "items")
    version = F.struct(F.coalesce(F.col("received_at"), F.lit("0001-01-01").cast("timestamp")).alias("at"), F.coalesce(F.col("row_id"), F.lit(-1)).alias("row"))
    newest = F.max_by(F.struct(version.alias("version"), F.struct(*[F.col(f"`{c}`") for c in data]).alias("row")), version).alias("newest")
    store = SortedStore(spark, ["item_key"], {"newest": lambda a, b: F.when(a["version"] >= b["version"], a).otherwise(b)}, path)
    part = F.pmod(F.coalesce(F.col("batch_id"), F.lit(0)), F.lit(runs))
    for r in range(runs):
        store.upsert(rows.filter(part == r), [newest], f"run{r}")
    return store.compact().select("newest.row.*", "item_key")
