"""Filling fixed-capacity containers: vector bin packing with the dot-product heuristic.

An item has three sizes: tokens, segments (one for each piece) and loss-bearing tokens; a container has a limit for each.
Containers are filled one after the other; the next item is the one, of those that still fit, whose size vector has the
greatest dot product with the room left, each dimension weighted by its mean demand (Panigrahy, Talwar, Uyeda, Wieder,
"Heuristics for Vector Bin Packing", 2011). Items larger than the token capacity are cut into full pieces and a rest;
no other item is divided.

Packing runs in shards of a bounded number of items, chosen by a hash of the piece, so skewed keys do not matter; containers
left with room are emptied and their items packed again in a second round over all shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tokens import TOKENIZER, TOKENIZER_DIR, Counter, pieces_of
from pagemill.session import materialize

#: Items that one task packs at a time: bounds memory and the quadratic scan.
SHARD = 4096
#: A container filled less than this is packed again in the second round.
FULL = 0.97


def size_items(df: DataFrame, capacity: int, directory: str = TOKENIZER_DIR, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per piece: ``doc_id``, ``doc_tokens``, ``pieces``, ``piece``, ``first_token``, ``tokens``, ``loss_tokens``.

    Texts of at most ``capacity`` tokens are one piece. Null and empty texts have one piece of 0 tokens.
    """
    schema = "doc_id bigint, doc_tokens bigint, pieces int, piece int, first_token bigint, tokens int, loss_tokens int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(directory, tokenizer)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sizes, loss = counter.sizes(text or "")
                total = sum(sizes)
                if total <= capacity:
                    rows.append((doc, total, 1, 0, 0, total, sum(n for n, x in zip(sizes, loss, strict=True) if x)))
                else:
                    parts = list(pieces_of(sizes, loss, capacity))
                    rows += [(doc, total, len(parts), *part) for part in parts]
            names = [c.split()[0] for c in schema.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)

    return df.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def dot_product_bins(sizes: np.ndarray) -> np.ndarray:
    """The bin of each item; ``sizes`` has a row per item and a column per dimension, in shares of a container."""
    bins = np.full(len(sizes), -1, dtype=np.int64)
    order = np.lexsort(sizes.T[::-1])[::-1]
    left, index, current = sizes[order], order, 0
    weight = left.mean(axis=0) if len(left) else np.ones(sizes.shape[1])
    room = np.ones(sizes.shape[1])
    while len(left):
        fits = (left <= room + 1e-12).all(axis=1)
        if not fits.any():
            if (room == 1).all():  # beyond a limit on its own: a container of its own
                fits[0] = True
            else:
                current, room = current + 1, np.ones(sizes.shape[1])
                continue
        best = int(np.argmax(np.where(fits, left @ (weight * room), -1.0)))
        bins[index[best]] = current
        room = room - left[best]
        left, index = np.delete(left, best, axis=0), np.delete(index, best)
    return bins


def pack(
    documents: DataFrame,
    capacity: int,
    max_segments: int = 64,
    loss_capacity: int | None = None,
    directory: str = TOKENIZER_DIR,
    tokenizer: str = TOKENIZER,
) -> DataFrame:
    """Assign every piece of every document to a container.

    Output: the columns of :func:`size_items` and ``container_id``. No container exceeds ``capacity`` tokens,
    ``max_segments`` pieces or ``loss_capacity`` loss-bearing tokens (default: ``capacity``), but for a piece that alone has more
    loss-bearing tokens: only items larger than the capacity are divided, so it gets a container of its own. Items of 0 tokens
    (null and empty texts) get no container. Repeated texts and repeated ``doc_id`` values are items of their own. Other columns of
    the input are ignored. The result depends only on the rows, not on their order or partitioning.
    """
    limits = np.array([capacity, max_segments, loss_capacity or capacity], dtype=float)
    sized = materialize(size_items(documents, capacity, directory, tokenizer), "items")
    full = sized.filter(F.col("tokens") > 0)
    count = full.count()
    columns = ["doc_id", "doc_tokens", "pieces", "piece", "first_token", "tokens", "loss_tokens"]
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in sized.schema)}, container_id bigint, fill double"

    def packer(number: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
            demand = np.column_stack([rows["tokens"], np.ones(len(rows)), rows["loss_tokens"]]) / limits
            bins = dot_product_bins(demand)
            fill = np.bincount(bins, weights=rows["tokens"]) / capacity
            container = (number << 60) + (int(key[0]) << 20) + bins
            return rows[columns].assign(container_id=container, fill=fill[bins])

        return run

    def shards(rows: int):
        # Sizes are part of the hash, so documents without identifier, or with the same one, spread, too.
        return F.pmod(F.xxhash64("doc_id", "piece", "doc_tokens", "loss_tokens"), F.lit(max(1, math.ceil(rows / SHARD))))

    first = materialize(full.groupBy(shards(count).alias("shard")).applyInPandas(packer(0), schema), "packed")
    again = first.filter(F.col("fill") < FULL).select(*columns)
    second = again.groupBy(shards(again.count()).alias("shard")).applyInPandas(packer(1), schema)
    rest = sized.filter(F.col("tokens") == 0).withColumn("container_id", F.lit(None).cast("bigint"))
    done = first.filter(F.col("fill") >= FULL).unionByName(second).drop("fill")
    return done.unionByName(rest)


def divided(packed: DataFrame) -> DataFrame:
    """``doc_id`` of the documents that are larger than a container."""
    return packed.filter("pieces > 1 AND piece = 0").select("doc_id").distinct()


def container_fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row per container: pieces, tokens, loss-bearing tokens and the share of the capacity in use."""
    return (
        packed.filter("container_id IS NOT NULL")
        .groupBy("container_id")
        .agg(
            F.count("*").alias("segments"),
            F.sum("tokens").alias("tokens"),
            F.sum("loss_tokens").alias("loss_tokens"),
            (F.sum("tokens") / capacity).alias("fill"),
        )
    )
