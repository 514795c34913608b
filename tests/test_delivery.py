"""Repeated deliveries and mixed timestamps, against brute force and the time zone database of Python."""

from __future__ import annotations

import itertools
import random
from datetime import UTC, datetime, timedelta
from pathlib import Path
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from pagemill import session
from pagemill.functions.identifiers import canonical_id, canonical_url
from pagemill.operators import upsert
from pagemill.operators.instants import normalize_instants
from pagemill.operators.upsert import GROUP, SortedStore, item_pairs, latest_items, membership

ENTRY = "row_id bigint, feed_id bigint, batch_id bigint, received_at timestamp, id string, link string, title string"


def rows(spark, data):
    return spark.createDataFrame(data, ENTRY)


@pytest.mark.parametrize(
    ("value", "wanted"),
    [
        (" https://A.example:443/x/?utm_source=feed#top\n", "https://a.example/x"),
        ("http://www.a.example/x%2Dy?b=2&a=1&fbclid=q", "https://a.example/x-y?a=1&b=2"),
        ("https://a.example:8080/%2f", "https://a.example:8080/%2F"),
        ("https://a.example/?p=9&utm_campaign=w", "https://a.example?p=9"),
        ("tag:a,2024:x", "tag:a,2024:x"),
        ("  ", None),
        (None, None),
        ("https://a.example/100%", "https://a.example/100%"),
    ],
)
def test_canonical_url(spark, value, wanted):
    assert spark.createDataFrame([(value,)], "v string").select(canonical_url(F.col("v"))).head()[0] == wanted


def test_canonical_id(spark):
    u = "997540f4-372b-4b35-acf7-98eaaaaa9847"
    spellings = [u, u.upper(), f"{{{u}}}", f"urn:uuid:{u}", f" URN:UUID:{u} ", u.replace("-", "")]
    got = spark.createDataFrame([(s,) for s in spellings], "v string").select(canonical_id(F.col("v"))).distinct().collect()
    assert [r[0] for r in got] == ["uuid:" + u.replace("-", "")]
    pair = spark.createDataFrame([("aB1",), ("ab1",)], "v string").select(canonical_id(F.col("v"))).distinct().count()
    assert pair == 2


def brute(data):
    found = set()
    for a, b in itertools.combinations(data, 2):
        if a[1] is None or a[1] != b[1] or a[0] == b[0]:
            continue
        ids = a[4] is not None and b[4] is not None
        if ids and a[4] == b[4] or not ids and a[5] is not None and a[5] == b[5]:
            found.add((min(a[0], b[0]), max(a[0], b[0])))
    return found


@pytest.mark.parametrize("block", [2_000, 3])
def test_pairs_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(upsert, "BLOCK", block)
    rng = random.Random(3)
    data = [
        (i, rng.choice([1, 1, 2, None]), rng.choice([1, 2, 3, None]), None, rng.choice([None, "a", "b", "c", f"u{i}"]), rng.choice([None, "l1", "l2"]), None)
        for i in range(70)
    ]
    got = [tuple(r) for r in item_pairs(rows(spark, data)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(data)


def test_pairs_of_nothing_and_repeated_rows(spark):
    assert item_pairs(rows(spark, [])).count() == 0
    twice = [(1, 1, 1, None, "a", None, None)] * 2
    assert item_pairs(rows(spark, twice)).count() == 0


def test_store_is_idempotent_and_persists(spark, tmp_path):
    path = str(tmp_path / "store")
    data = [(i, 1, i % 2, None, f"u{i % 5}", "l", None) for i in range(40)]
    entries = rows(spark, data)
    wanted = {(r["kind"], r["key"]): {m["row_id"] for m in r["members"]} for r in membership(entries).collect()}
    assert len(wanted[("link", "l")]) == 40 and len(wanted) == 6
    for part in (entries, entries, entries.filter("batch_id = 1")):  # the same batches again, whole and in part
        got = membership(part, path=path).collect()
        assert {(r["kind"], r["key"]): {m["row_id"] for m in r["members"]} for r in got} == wanted
    store = SortedStore(spark, [*GROUP, "block", "blocks"], {"members": F.array_union}, path)
    assert len(store.runs()) == 1
    assert store.run(store.runs()[0]).count() == 6


def test_release(spark):
    found = membership(rows(spark, [(1, 1, 1, None, "a", None, None)]))
    assert found.count() == 1 and session.TABLES
    path = found.inputFiles()[0].removeprefix("file:").removeprefix("//")
    session.release(spark)
    assert not session.TABLES and not Path(path).exists()


def test_merging_runs_needs_neither_exchange_nor_sort(spark, tmp_path):
    store = SortedStore(spark, ["k"], {"v": F.greatest}, str(tmp_path / "store"))
    df = spark.range(1000).select((F.col("id") % 100).alias("k"), F.col("id").alias("v"))
    for i in range(3):
        store.upsert(df.filter(F.col("v") % 3 == i), [F.max("v").alias("v")], f"run{i}")
    with upsert._setting(spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true"):
        plan = store._merged(store.run("run0"), store.run("run1"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert {(r["k"], r["v"]) for r in store.compact().collect()} == {(k, 900 + k) for k in range(100)}


def test_latest_items(spark):
    t = datetime(2024, 1, 1)
    data = [
        (1, 1, 1, t, "a", "l", "old"), (2, 1, 2, t + timedelta(1), "a", "l", "new"), (3, 1, 2, t + timedelta(1), "a", None, "newest by row"),
        (4, 1, 2, t + timedelta(9), None, "l", "joins a by link"), (5, 1, 1, None, None, "m", "no time"), (6, 1, 1, t, None, "m", "with time"),
        (7, 1, 1, t, None, None, "alone"), (8, 1, 1, t, None, " ", "alone too"), (9, 2, 1, t, "a", "l", "other feed"), (10, None, None, None, None, None, None),
    ]
    out = latest_items(rows(spark, data).withColumn("item_key", F.lit("clash")))
    assert sorted(r["row_id"] for r in out.collect()) == [4, 6, 7, 8, 9, 10]
    assert latest_items(rows(spark, data + data)).count() == 6
    assert latest_items(rows(spark, [])).count() == 0


CASES = [
    ("2024-08-03T18:04:13-04:00", None, "2024-08-03T22:04:13"),
    ("2024-01-30t07:39:10z", None, "2024-01-30T07:39:10"),
    ("2024-07-01T22:12:27.6355634+02:00", None, "2024-07-01T20:12:27.635563"),
    ("2024-01-09T20:30:37,8+00:00", None, "2024-01-09T20:30:37.8"),
    ("20240607T203743+0930", None, "2024-06-07T11:07:43"),
    ("Mon, 02 Dec 24 06:11:25 CET", None, "2024-12-02T05:11:25"),
    ("Tue, 02 Dec 24 06:11:25 CET", None, None),  # a Monday
    ("6 Nov 2024 18:13:13 +0100", None, "2024-11-06T17:13:13"),
    ("2024-11-28 04:47:16 Europe/Berlin", None, "2024-11-28T03:47:16"),
    ("2024-09-02T13:40:05+02:00[Europe/Warsaw]", None, "2024-09-02T11:40:05"),
    ("01/19/2024 1:09 AM", "America/New_York", "2024-01-19T06:09:00"),
    ("Jul 9, 2024 12:03 PM", "Europe/Paris", "2024-07-09T10:03:00"),
    ("08/21/2024 12:36 AM", "Europe/Paris", "2024-08-20T22:36:00"),
    ("21.10.2024 03:41", "Europe/Berlin", "2024-10-21T01:41:00"),
    ("27. Oktober 2024, 12:24 Uhr", "Europe/Berlin", "2024-10-27T11:24:00"),
    ("1er août 2024 à 00:55", "Europe/Paris", "2024-07-31T22:55:00"),
    ("\n 1716379095666\t", None, "2024-05-22T11:58:15.666"),
    ("1734622313", None, "2024-12-19T15:31:53"),
    ("2024-10-27 02:30", "Europe/Berlin", None),  # twice
    ("2024-03-31 02:30", "Europe/Berlin", None),  # never
    ("2024-03-31 02:30", None, None),
    ("2024-03-31 02:30", "Nowhere/City", None),
    ("2024-02-30 02:30:00Z", None, None),
    ("2024-13-41T99:00:00Z", None, None),
    ("0000-00-00 00:00:00", "Europe/Berlin", None),
    ("13.08.2024", "Europe/Berlin", None),
    ("", "Europe/Berlin", None),
    (None, "Europe/Berlin", None),
    ("unknown", "Europe/Berlin", None),
]


def test_instants(spark):
    df = spark.createDataFrame([(i, v, z, "x") for i, (v, z, _) in enumerate(CASES)], "k int, raw string, zone string, status string")
    got = {r["k"]: r for r in normalize_instants(df, "raw", "zone").collect()}
    assert len(got) == len(CASES)
    for i, (value, _, wanted) in enumerate(CASES):
        micros = None if wanted is None else (datetime.fromisoformat(wanted).replace(tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)
        assert got[i]["utc_micros"] == micros, (value, got[i])
        assert (got[i]["status"] == "ok") == (wanted is not None)


def test_policies_and_brute_force_over_changes(spark):
    zones = ["Europe/Berlin", "America/New_York", "Australia/Adelaide", "Asia/Kathmandu", "America/Sao_Paulo"]
    base = [datetime(2024, 3, 10), datetime(2024, 3, 31), datetime(2024, 10, 27), datetime(2024, 11, 3), datetime(2024, 4, 7), datetime(2024, 10, 6)]
    values = [(b + timedelta(minutes=15 * i), z) for b in base for i in range(20) for z in zones]
    df = spark.createDataFrame([(i, f"{v:%Y-%m-%d %H:%M}", z) for i, (v, z) in enumerate(values)], "k int, raw string, zone string")
    for policy, fold in (("reject", None), ("earlier", 0), ("later", 1)):
        got = {r["k"]: r for r in normalize_instants(df, "raw", "zone", ambiguous=policy).collect()}
        for i, (v, z) in enumerate(values):
            both = {f: v.replace(tzinfo=ZoneInfo(z), fold=f).astimezone(UTC) for f in (0, 1)}
            real = {f: u for f, u in both.items() if u.astimezone(ZoneInfo(z)).replace(tzinfo=None) == v}
            instants = sorted(set(real.values()))
            wanted = None if not instants or len(instants) > 1 and fold is None else instants[-1 if fold else 0]
            micros = None if wanted is None else int(wanted.timestamp()) * 1_000_000
            assert got[i]["utc_micros"] == micros, (v, z, policy)


def test_instants_of_no_rows(spark):
    df = spark.createDataFrame([], "raw string, zone string")
    assert normalize_instants(df, "raw", "zone").count() == 0
