"""Repeated runs of a host's pages by a suffix array.

The token streams of the pages of a host are concatenated, the suffixes sorted, and substrings of at least ``shortest``
tokens that occur on ``pages`` distinct pages are taken as boilerplate; what no such run covers is kept. A position is covered
exactly if one of the windows of ``shortest`` tokens over it occurs on that many pages, which makes the work divisible: large
hosts are cut into shards of bounded size, each shard sorts its own suffixes, and the windows that a shard has not
already found repeated are counted across the shards of the host by their fingerprints.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import materialize

#: Pages of one host that one task sorts.
SHARD = 400
SHORTEST, PAGES = 5, 2


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Where the suffixes begin, in their order, by prefix doubling."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while n > 1 and rank.max() < n - 1 and step < n:
        second = np.full(n, -1, dtype=np.int64)
        second[: n - step] = rank[step:]
        order = np.lexsort((second, rank))
        changed = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(changed)])
        step *= 2
    return order


def shares(codes: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix in the order has its first ``length`` tokens in common with the one before it."""
    padded = np.concatenate([codes, np.full(length, np.iinfo(np.int64).min)])
    same = np.ones(max(len(order) - 1, 0), dtype=bool)
    for k in range(length):
        same &= padded[order[1:] + k] == padded[order[:-1] + k]
    return np.concatenate([[False], same]) if len(order) else same


def repeated(codes: np.ndarray, page: np.ndarray, shortest: int, pages: int) -> np.ndarray:
    """Positions at which a window of ``shortest`` tokens begins that occurs on ``pages`` distinct pages."""
    hit = np.zeros(len(codes), dtype=bool)
    if not len(codes):
        return hit
    order = suffix_array(codes)
    group = np.cumsum(~shares(codes, order, shortest))
    pairs = np.unique(np.column_stack([group, page[order]]), axis=0)
    distinct = np.bincount(pairs[:, 0], minlength=group.max() + 1)
    long = np.bincount(group, minlength=group.max() + 1) > 1
    hit[order] = (long & (distinct >= pages))[group]
    return hit


def boilerplate(units: DataFrame, shortest: int = SHORTEST, pages: int = PAGES) -> DataFrame:
    """For text units (``host``, ``page_id``, ``unit_id``, ``text``): ``tokens``, ``covered`` and the ``kept`` text.

    Tokens are white-space words. Units of null or blank text have 0 tokens; units without host belong to no host and keep
    their text. Runs do not cross units. Repeated rows of a page are one page's, so they are no evidence by themselves.
    """
    words = units.filter("host IS NOT NULL AND text IS NOT NULL")
    sizes = words.groupBy("host").agg(F.countDistinct("page_id").alias("n"))
    shard = F.pmod(F.xxhash64("page_id"), F.ceil(F.col("n") / SHARD).cast("int"))
    rows = words.join(sizes, "host").select("host", "page_id", "unit_id", "text", shard.alias("shard"), (F.col("n") > SHARD).alias("cut"))
    schema = "host string, page_id bigint, unit_id bigint, cut boolean, at int, tokens int, window bigint, hit boolean"

    def local(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["page_id", "unit_id"], kind="stable")
        split = [t.split() for t in part["text"]]
        lengths = np.array([len(s) for s in split])
        vocabulary: dict[str, int] = {}
        codes = np.full(int(lengths.sum()) + len(split), -1, dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        for i, (begin, tokens) in enumerate(zip(starts, split, strict=True)):
            codes[begin : begin + len(tokens)] = [vocabulary.setdefault(t, len(vocabulary)) for t in tokens]
            codes[begin + len(tokens)] = -2 - i  # runs end with the unit
        owner = np.repeat(part["page_id"].to_numpy(), lengths + 1)
        hit = repeated(codes, owner, shortest, pages)
        unit = np.repeat(np.arange(len(part)), lengths + 1)
        at = np.arange(len(codes)) - np.repeat(starts, lengths + 1)
        windows = at <= (lengths - shortest)[unit]
        keep = np.flatnonzero(windows & (hit | part["cut"].to_numpy()[unit]))
        hashes = np.fromiter((hash_window(split[unit[i]][at[i] : at[i] + shortest]) for i in keep), dtype=np.int64, count=len(keep))
        values = part.iloc[unit[keep]]
        return pd.DataFrame({"host": values["host"].to_numpy(), "page_id": values["page_id"].to_numpy(), "unit_id": values["unit_id"].to_numpy(), "cut": values["cut"].to_numpy(), "at": at[keep], "tokens": lengths[unit[keep]], "window": hashes, "hit": hit[keep]})

    found = materialize(rows.groupBy("host", "shard").applyInPandas(local, schema), "windows")
    known = found.filter("hit").select("unit_id", "at")
    across = found.filter("cut AND NOT hit")
    wide = across.groupBy("host", "window").agg(F.countDistinct("page_id").alias("n")).filter(F.col("n") >= pages).select("host", "window")
    seen = found.filter("cut AND hit").select("host", "window").distinct()  # repeated in another shard
    more = across.join(wide.union(seen).distinct(), ["host", "window"], "left_semi").select("unit_id", "at")
    begins = known.union(more).groupBy("unit_id").agg(F.collect_set("at").alias("begins"))
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda t: t != "")
    within = lambda i: F.exists(F.col("begins"), lambda b: (i >= b) & (i < b + shortest))
    out = units.join(begins, "unit_id", "left").withColumn("_tokens", tokens)
    flags = F.transform("_tokens", lambda t, i: F.coalesce(within(i), F.lit(False)))
    kept = F.transform(F.filter(F.arrays_zip(F.col("_tokens").alias("t"), flags.alias("f")), lambda p: ~p["f"]), lambda p: p["t"])
    return out.withColumn("_kept", kept).select(
        "host", "page_id", "unit_id", F.size("_tokens").alias("tokens"), (F.size("_tokens") - F.size("_kept")).alias("covered"), F.array_join("_kept", " ").alias("kept")
    )


def hash_window(tokens: list[str]) -> int:
    """A 64-bit fingerprint that is the same in every process."""
    import xxhash

    return xxhash.xxh64_intdigest("\x1f".join(tokens)) - (1 << 63)
