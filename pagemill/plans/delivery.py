"""Queries of the feed problems: repeated deliveries and mixed times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.instants import ABBREVIATIONS, MONTHS, feed_times
from pagemill.operators.upsert import item_pairs, latest_items
from pagemill.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_pairs(table(spark, sf_dir, "entries").select("row_id", "feed_id", "batch_id", "id", "link"))


def p2_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_items(table(spark, sf_dir, "entries")).withColumn("received_at", F.unix_micros("received_at"))


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_times(*[table(spark, sf_dir, name) for name in ("entries", "feeds", "channels")])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(spark, sf_dir).filter("status = 'ok'").select("table_name", "row_id", "field", "utc_micros")


def p3_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(spark, sf_dir).select(
        "table_name", "row_id", "field", "raw", "format", "status", "utc_micros", F.timestamp_micros("utc_micros").alias("instant")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_items": p2_items,
    "p3_found": p3_found,
    "p3_normalized": p3_normalized,
}

URL = """
    CASE WHEN regexp_matches({0}, '^[hH][tT][tT][pP][sS]?://[^/?#]+') THEN
      'https://' || regexp_replace(regexp_replace(lower(regexp_extract({0}, '^[A-Za-z]+://([^/?#]*)', 1)), ':(80|443)?$', ''), '^www[.]', '')
      || regexp_replace(replace(regexp_extract({0}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '%2D', '-'), '/+$', '')
      || CASE WHEN trim(regexp_replace(regexp_extract({0}, '^[A-Za-z]+://[^?#]*[?]([^#]*)', 1), '(^|&)(utm_[a-z_]+|fbclid)=[^&]*', '', 'g'), '&') = '' THEN ''
         ELSE '?' || trim(regexp_replace(regexp_extract({0}, '^[A-Za-z]+://[^?#]*[?]([^#]*)', 1), '(^|&)(utm_[a-z_]+|fbclid)=[^&]*', '', 'g'), '&') END
    ELSE {0} END"""
_RAW = "nullif(trim({0}, ' ' || chr(9) || chr(10) || chr(13)), '')"
_BARE_ID = "replace(regexp_replace(regexp_replace(lower(i), '^(urn:)?(uuid:)?[{]?', ''), '[}]$', ''), '-', '')"
KEYED = f"""
WITH raw AS (SELECT row_id, feed_id, received_at, {_RAW.format("id")} AS i, {_RAW.format("link")} AS l FROM entries),
keyed AS (SELECT row_id, feed_id, received_at,
  CASE WHEN i IS NULL THEN NULL WHEN regexp_full_match({_BARE_ID}, '[0-9a-f]{{32}}') THEN 'uuid:' || {_BARE_ID} ELSE {URL.format("i")} END AS i,
  {URL.format("l")} AS l FROM raw)"""
ORACLES: dict[str, str] = {
    "p2_found": KEYED
    + """
SELECT least(a.row_id, b.row_id) AS row_a, greatest(a.row_id, b.row_id) AS row_b FROM keyed a JOIN keyed b ON a.feed_id = b.feed_id AND a.i = b.i AND a.row_id < b.row_id
UNION
SELECT least(a.row_id, b.row_id), greatest(a.row_id, b.row_id) FROM keyed a JOIN keyed b ON a.feed_id = b.feed_id AND a.l = b.l AND a.row_id <> b.row_id WHERE a.i IS NULL""",
    "p2_items": KEYED
    + """,
known AS (SELECT feed_id, l, min(i) AS by_link FROM keyed WHERE i IS NOT NULL AND l IS NOT NULL GROUP BY feed_id, l),
items AS (SELECT k.row_id, k.received_at, coalesce(CAST(k.feed_id AS VARCHAR), '')
  || CASE WHEN coalesce(k.i, n.by_link) IS NOT NULL THEN ':id:' || coalesce(k.i, n.by_link) WHEN k.l IS NOT NULL THEN ':link:' || k.l ELSE ':row:' || k.row_id END AS item_key
  FROM keyed k LEFT JOIN known n ON k.i IS NULL AND k.feed_id IS NOT DISTINCT FROM n.feed_id AND k.l = n.l),
ranked AS (SELECT row_id, item_key, row_number() OVER (PARTITION BY item_key ORDER BY received_at DESC NULLS LAST, row_id DESC) AS place FROM items)
SELECT e.* REPLACE (epoch_us(e.received_at) AS received_at), r.item_key FROM ranked r JOIN entries e ON e.row_id = r.row_id WHERE place = 1""",
}

# The cascade of formats again, for another engine: patterns, and the groups of year, month, day, hour, minute, second, fraction, half of
# the day, zone and weekday (0: none).
_CLOCK = "([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?"
_PLACE = "([Zz]|[+-][0-9]{2}:?[0-9]{2}|[A-Z]{2,5}|[A-Z][A-Za-z]+(?:/[A-Za-z0-9_+-]+){1,2})?"
_WORD = "([A-Za-zÀ-ÿńśźż]{3,12})[.]?"
_HALF = " ?([AaPp])[.]?[Mm][.]?"
_SHAPES = [
    (f"([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}})[Tt ]{_CLOCK} ?{_PLACE}(?:\\[[A-Za-z0-9_+/-]+\\])?", (1, 2, 3, 4, 5, 6, 7, 0, 8, 0)),
    (f"([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})[Tt]([0-9]{{2}})([0-9]{{2}})(?:([0-9]{{2}})(?:[.,]([0-9]+))?)? ?{_PLACE}", (1, 2, 3, 4, 5, 6, 7, 0, 8, 0)),
    (f"(?:([A-Za-z]{{3}})[a-z]*, ?)?([0-9]{{1,2}}) {_WORD} ([0-9]{{4}}|[0-9]{{2}}) {_CLOCK} ?{_PLACE}", (4, 3, 2, 5, 6, 7, 8, 0, 9, 1)),
    (f"([0-9]{{4}})/([0-9]{{1,2}})/([0-9]{{1,2}}) {_CLOCK} ?{_PLACE}", (1, 2, 3, 4, 5, 6, 7, 0, 8, 0)),
    (f"([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}}),? ([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}}))?{_HALF}", (3, 1, 2, 4, 5, 6, 0, 7, 0, 0)),
    (f"([0-9]{{1,2}})[.]([0-9]{{1,2}})[.]([0-9]{{4}}),? {_CLOCK}(?: Uhr)? ?{_PLACE}", (3, 2, 1, 4, 5, 6, 7, 0, 8, 0)),
    (f"{_WORD} ([0-9]{{1,2}}), ([0-9]{{4}}),? (?:at )?([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}}))?(?:{_HALF})?", (3, 1, 2, 4, 5, 6, 0, 7, 0, 0)),
    (f"([0-9]{{1,2}})(?:[.]|er)? (?:de )?{_WORD} (?:de )?([0-9]{{4}})(?:,| à| a las| às| alle)? ([0-9]{{1,2}})[:h]([0-9]{{2}})(?::([0-9]{{2}}))?(?: Uhr)?", (3, 2, 1, 4, 5, 6, 0, 0, 0, 0)),
]
_FIELDS = ["f_y", "f_mo", "f_d", "f_h", "f_mi", "f_s", "f_us", "f_half", "f_zone", "f_wd"]


def _field(i: int) -> str:
    arms = " ".join(f"WHEN {n} THEN regexp_extract(whole, '^{shape}$', {groups[i]})" for n, (shape, groups) in enumerate(_SHAPES) if groups[i])
    return f"CASE shape {arms} ELSE '' END AS {_FIELDS[i]}"


_MONTH = "CASE " + " ".join(f"WHEN lower(f_mo) IN ({', '.join(repr(x) for x in names.split())}) THEN {n}" for n, names in MONTHS.items()) + " END"
_SHIFT = "CASE upper(f_zone) " + " ".join(f"WHEN '{name}' THEN {minutes}" for name, minutes in ABBREVIATIONS.items()) + " END"
_STEPS = (0, 1_800_000_000, -1_800_000_000, 3_600_000_000, -3_600_000_000, 7_200_000_000, -7_200_000_000)
_NUMBER = "TRY_CAST(nullif({0}, '') AS BIGINT)"
ORACLES["p3_found"] = f"""
WITH v AS (SELECT 'entries' AS table_name, row_id, feed_id, 'published' AS field, published AS raw FROM entries UNION ALL SELECT 'entries', row_id, feed_id, 'updated', updated FROM entries
  UNION ALL SELECT 'feeds', snap_id, feed_id, 'updated', updated FROM feeds),
z AS (SELECT feed_id, max(tz_name) AS tz FROM channels GROUP BY feed_id),
a AS (SELECT v.table_name, v.row_id, v.field, z.tz, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8195) || chr(8201) || chr(8203) || chr(12288) || chr(65279)) AS whole FROM v LEFT JOIN z USING (feed_id)),
b AS (SELECT *, CASE {" ".join(f"WHEN regexp_full_match(whole, '{shape}') THEN {n}" for n, (shape, _) in enumerate(_SHAPES))} END AS shape FROM a),
c AS (SELECT *, {", ".join(map(_field, range(len(_FIELDS))))} FROM b),
e AS (SELECT *, CASE WHEN length(f_y) = 2 THEN {_NUMBER.format("f_y")} + CASE WHEN {_NUMBER.format("f_y")} <= 68 THEN 2000 ELSE 1900 END ELSE {_NUMBER.format("f_y")} END AS y,
  CASE WHEN regexp_full_match(f_mo, '[0-9]+') THEN {_NUMBER.format("f_mo")} ELSE {_MONTH} END AS mo, {_NUMBER.format("f_d")} AS d, {_NUMBER.format("f_mi")} AS mi, coalesce({_NUMBER.format("f_s")}, 0) AS sec,
  CASE WHEN f_half = '' THEN {_NUMBER.format("f_h")} WHEN {_NUMBER.format("f_h")} BETWEEN 1 AND 12 THEN {_NUMBER.format("f_h")} % 12 + CASE WHEN lower(f_half) = 'p' THEN 12 ELSE 0 END END AS h,
  CAST(rpad(substring(f_us, 1, 6), 6, '0') AS BIGINT) AS us,
  CASE WHEN regexp_matches(f_zone, '^[+-]') THEN CASE WHEN f_zone[1] = '-' THEN -1 ELSE 1 END * (CAST(f_zone[2:3] AS BIGINT) * 60 + CAST(right(f_zone, 2) AS BIGINT)) ELSE {_SHIFT} END AS shift FROM c),
f AS (SELECT *, CASE WHEN y >= 1 AND mo BETWEEN 1 AND 12 AND d BETWEEN 1 AND day(last_day(make_date(y, mo, 1))) THEN make_date(y, mo, d) END AS date FROM (SELECT * REPLACE (CASE WHEN mo BETWEEN 1 AND 12 AND y >= 1 THEN mo END AS mo) FROM e)),
g AS (SELECT *, CASE WHEN h BETWEEN 0 AND 23 AND mi <= 59 AND sec <= 59 AND (f_wd = '' OR lower(f_wd) = lower(strftime(date, '%a'))) AND (shift IS NULL OR abs(shift) <= 840 AND NOT regexp_matches(f_zone, '^[+-].*[6-9][0-9]$'))
  THEN epoch_us(CAST(date AS TIMESTAMP)) + (h * 3600 + mi * 60 + sec) * 1000000 + us END AS local, CASE WHEN f_zone = '' THEN tz WHEN shift IS NULL THEN f_zone END AS place FROM f),
k AS (SELECT *, CASE WHEN place IN (SELECT name FROM pg_timezone_names() WHERE name LIKE '%/%') THEN place END AS zone FROM g),
i AS (SELECT *, epoch_us(timezone(coalesce(zone, 'UTC'), make_timestamp(local))) AS first FROM k),
j AS (SELECT *, list_filter([{", ".join(f"CASE WHEN epoch_us(timezone(coalesce(zone, 'UTC'), make_timestamptz(first + {s}))) = local THEN first + {s} END" for s in _STEPS)}], lambda x: x IS NOT NULL) AS fit FROM i),
l AS (SELECT table_name, row_id, field, CASE WHEN regexp_full_match(whole, '[0-9]{{10}}') THEN CAST(whole AS BIGINT) * 1000000 WHEN regexp_full_match(whole, '[0-9]{{13}}') THEN CAST(whole AS BIGINT) * 1000 WHEN regexp_full_match(whole, '[0-9]{{16}}') THEN CAST(whole AS BIGINT)
  WHEN shift IS NOT NULL THEN local - shift * 60000000 WHEN zone IS NOT NULL AND len(fit) = 1 THEN fit[1] END AS utc_micros FROM j)
SELECT * FROM l WHERE utc_micros IS NOT NULL"""
