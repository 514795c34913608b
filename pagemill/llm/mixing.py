"""Mixing sources to target weights by entropy balancing.

Each document gets a rate between 0 and the repeat cap of its source. Of all rates that give every source its share of the
token budget, the ones of greatest (bounded) entropy are exponentially tilted in the document's size; the tilts are the
solution of a convex dual, found by Newton iterations whose gradient and curvature are aggregated over all documents. The
rates are rounded to copies from the largest size to the smallest, carrying the missed tokens along, so a source misses its
share by about half of a short document.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions.identifiers import stripped
from pagemill.llm.tokens import token_counts
from pagemill.session import materialize

#: Documents of one size and source that one task ranks; larger groups are cut by a hash.
BLOCK = 20_000
#: Relative error of a source's tokens at which the iterations stop, and their greatest number.
TOLERANCE, STEPS = 1e-9, 60


def canonical_source(value: Column) -> Column:
    """One spelling per source: stripped, lower case; null when blank."""
    return F.lower(stripped(value))


def _rate(tilt: Column, size: Column, cap: Column) -> Column:
    """The rate at a tilt: cap / (1 + exp(-tilt size)) is the greatest-entropy rate below the cap."""
    return cap / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), tilt * size))))


def solve_tilts(sizes: DataFrame, wanted: dict[str, float], caps: dict[str, int], scale: float) -> dict[str, float]:
    """Tilt per source so that the rates of its documents carry the wanted tokens.

    ``sizes`` has ``source``, ``tokens`` and the number ``n`` of such documents. One aggregation over all sizes per step;
    what comes back is a row per source. Steps are damped by bisection, so they converge from any start.
    """
    spark = sizes.sparkSession
    low, high, tilt = {s: -700.0 for s in wanted}, {s: 700.0 for s in wanted}, {s: 0.0 for s in wanted}
    open_ = set(wanted)
    for _ in range(STEPS):
        if not open_:
            break
        now = spark.createDataFrame([(s, tilt[s], float(caps[s])) for s in open_], "source string, tilt double, cap double")
        x = F.col("tokens") / F.lit(scale)
        r = _rate(F.col("tilt"), x, F.col("cap"))
        rows = (
            sizes.join(F.broadcast(now), "source")  # one row per source of the target table
            .groupBy("source")
            .agg(F.sum(F.col("n") * r * x).alias("g"), F.sum(F.col("n") * r * (1 - r / F.col("cap")) * x * x).alias("h"))
            .collect()
        )
        for row in rows:
            s, miss = row["source"], row["g"] - wanted[row["source"]] / scale
            if abs(miss) <= TOLERANCE * max(1.0, wanted[s] / scale):
                open_.discard(s)
                continue
            (high if miss > 0 else low)[s] = tilt[s]
            step = tilt[s] - miss / row["h"] if row["h"] > 0 else math.nan
            tilt[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
    return tilt


def _round(rows: pd.DataFrame) -> pd.DataFrame:
    """Copies of all documents of each size of a source: largest size first, the missed tokens carried to the next size."""
    rows = rows.sort_values("tokens", ascending=False, kind="stable")
    carried, total = 0.0, []
    for tokens, n, rate, cap in zip(rows["tokens"], rows["n"], rows["rate"], rows["cap"], strict=True):
        mass = carried + n * rate * tokens
        copies = int(min(max(round(mass / tokens), 0), n * cap))
        carried = mass - copies * tokens
        total.append(copies)
    return rows[["source", "tokens", "n"]].assign(total=total)


def mix(documents: DataFrame, targets: DataFrame, budget: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The chosen documents with copies, and the report of shares.

    ``targets`` has ``source``, ``target_share``, ``max_repeats``; it is a table of sources and fits the driver. Without
    ``budget`` the largest total is used at which no source would have to pass its cap. Sources without any tokens get
    nothing; the other shares then refer to the sum of theirs. Documents of sources that are not in ``targets``, of null
    source or without tokens are not chosen. Ties and repeated rows are documents of their own. Null or non-positive
    shares and caps choose nothing.

    Documents: ``doc_id``, ``source``, ``tokens``, ``copies`` (at least 1, at most ``max_repeats``). Report:
    ``source``, ``target_share``, ``actual_share``, ``max_repeats``, ``documents``, ``available_tokens``, ``chosen_documents``,
    ``copies``, ``chosen_tokens``.
    """
    spark = documents.sparkSession
    goal = {
        r["source"]: (r["share"], r["cap"])
        for r in targets.select(
            canonical_source(F.col("source")).alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("cap")
        ).collect()
        if r["source"] and (r["share"] or 0) > 0 and (r["cap"] or 0) > 0
    }
    docs = documents.withColumn("source", canonical_source(F.col("source"))).filter(F.col("source").isin(list(goal)))
    sized = materialize(token_counts(docs, "doc_id", "text", "source").filter("tokens > 0"), "sized")
    sizes = materialize(sized.groupBy("source", "tokens").agg(F.count("*").alias("n")), "sizes")
    have = {r["source"]: r for r in sizes.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect()}
    share = sum(goal[s][0] for s in have)
    weight = {s: goal[s][0] / share for s in have}
    most = min((have[s]["t"] * goal[s][1] / weight[s] for s in have), default=0.0)
    total = min(budget or most, most)
    wanted = {s: weight[s] * total for s in have}
    caps = {s: goal[s][1] for s in have}
    scale = max(1.0, sum(r["t"] for r in have.values()) / max(1, sum(r["n"] for r in have.values())))
    filled = {s for s in have if wanted[s] >= have[s]["t"] * caps[s] * (1 - 1e-9)}
    tilts = solve_tilts(sizes, {s: wanted[s] for s in have if s not in filled}, caps, scale)
    rates = [(s, 700.0 if s in filled else tilts[s], float(caps[s]), s in filled) for s in have]
    plan = spark.createDataFrame(rates, "source string, tilt double, cap double, filled boolean")
    tilted = _rate(F.col("tilt"), F.col("tokens") / F.lit(scale), F.col("cap"))
    per = sizes.join(F.broadcast(plan), "source").withColumn("rate", F.when(F.col("filled"), F.col("cap")).otherwise(tilted))
    # The sizes that occur in a source are bounded by its longest text, however many documents it has.
    rounded = per.select("source", "tokens", "n", "rate", "cap").groupBy("source").applyInPandas(
        _round, "source string, tokens bigint, n bigint, total bigint"
    )
    block = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / BLOCK).cast("int"))
    blocks = sized.join(rounded, ["source", "tokens"]).withColumn("block", block)
    group = ["source", "tokens", "block"]
    ahead = Window.partitionBy("source", "tokens").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = (
        blocks.groupBy(*group)
        .agg(F.count("*").alias("rows"))
        .withColumn("start", F.coalesce(F.sum("rows").over(ahead), F.lit(0)))
        .drop("rows")
    )
    at = F.col("start") + F.row_number().over(Window.partitionBy(*group).orderBy("doc_id"))
    chosen = (
        blocks.join(start, group)
        .withColumn("at", at)
        .selectExpr("doc_id", "source", "tokens", "cast(at * total div n - (at - 1) * total div n as int) AS copies")
        .filter("copies > 0")
    )
    chosen = materialize(chosen, "mix")
    got = chosen.groupBy("source").agg(
        F.count("*").alias("chosen_documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("chosen_tokens")
    )
    stock = spark.createDataFrame([(s, r["n"], r["t"]) for s, r in have.items()], "source string, documents bigint, available_tokens bigint")
    target = spark.createDataFrame([(s, a, c) for s, (a, c) in goal.items()], "source string, target_share double, max_repeats int")
    everything = F.sum("chosen_tokens").over(Window.partitionBy())  # over the rows of the report, one per source
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "available_tokens", "chosen_documents", "copies", "chosen_tokens")]
    report = target.join(stock, "source", "left").join(got, "source", "left").select(
        "source", "target_share", F.coalesce(F.col("chosen_tokens") / everything, F.lit(0.0)).alias("actual_share"), "max_repeats", *zero
    )
    return chosen, report
