"""Timestamps of mixed formats and zones to one UTC instant, as Column expressions.

An ordered cascade of anchored patterns rewrites a value to ``year|month|day|hour|minute|second|fraction|half|zone|weekday``;
the first pattern that matches the whole value decides. Fields are then checked strictly (calendar, clock, weekday,
offset range). A value without zone is local time in a default zone that the caller looks up per source. Local times that
a zone skips or repeats follow an explicit policy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.identifiers import let, stripped

# Month names by number, in English, German, French, Spanish, Italian, Portuguese and Polish.
MONTHS = {
    1: "january jan januar jänner janvier enero gennaio janeiro stycznia",
    2: "february feb februar février fevrier febrero febbraio fevereiro lutego",
    3: "march mar märz maerz mars marzo março marca",
    4: "april apr avril abril aprile kwietnia",
    5: "may mai mayo maggio maio maja",
    6: "june jun juni juin junio giugno junho czerwca",
    7: "july jul juli juillet julio luglio julho lipca",
    8: "august aug août aout agosto sierpnia",
    9: "september sep sept septembre septiembre settembre setembro września",
    10: "october oct oktober octobre octubre ottobre outubro października",
    11: "november nov novembre noviembre novembro listopada",
    12: "december dec dezember décembre decembre diciembre dicembre dezembro grudnia",
}
# Zone abbreviations with one meaning in mail and feeds, in minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "MEZ": 60, "CEST": 120,
    "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "JST": 540, "KST": 540,
    "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780,
}
# Weekdays as RFC 822 writes them, in the order of Spark's weekday().
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]

_ZONE = r"[Zz]|[+-][0-9]{2}:?[0-9]{2}|[A-Z]{2,5}|[A-Z][A-Za-z]+(?:/[A-Za-z0-9_+-]+){1,2}"
_TIME = r"([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,9})[0-9]*)?)?"
_NAME = r"([A-Za-zÀ-ÿńśźż]{3,12})\.?"
_HALF = r" ?([AaPp])\.?[Mm]\.?"

#: name of the format, anchored pattern, rewriting to year|month|day|hour|minute|second|fraction|half|zone|weekday
CASCADE = [
    ("iso", rf"^([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}})(?:[Tt]| ){_TIME} ?({_ZONE})?(?:\[([A-Za-z0-9_+/-]+)\])?$", "$1|$2|$3|$4|$5|$6|$7||$8|"),
    ("iso_basic", rf"^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})[Tt]([0-9]{{2}})([0-9]{{2}})(?:([0-9]{{2}})(?:[.,]([0-9]{{1,9}})[0-9]*)?)? ?({_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8|"),
    ("rfc822", rf"^(?:([A-Za-z]{{3}})[a-z]*, ?)?([0-9]{{1,2}}) {_NAME} ([0-9]{{4}}|[0-9]{{2}}) {_TIME} ?({_ZONE})?$", "$4|$3|$2|$5|$6|$7|$8||$9|$1"),
    ("year_slash", rf"^([0-9]{{4}})/([0-9]{{1,2}})/([0-9]{{1,2}}) {_TIME} ?({_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8|"),
    ("month_slash", rf"^([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}}),? ([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}}))?{_HALF}$", "$3|$1|$2|$4|$5|$6||$7||"),
    ("day_dot", rf"^([0-9]{{1,2}})\.([0-9]{{1,2}})\.([0-9]{{4}}),? {_TIME}(?: Uhr)? ?({_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7||$8|"),
    ("month_name", rf"^{_NAME} ([0-9]{{1,2}}), ([0-9]{{4}}),? (?:at )?([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}}))?(?:{_HALF})?$", "$3|$1|$2|$4|$5|$6||$7||"),
    ("day_name", rf"^([0-9]{{1,2}})(?:\.|er)? (?:de )?{_NAME} (?:de )?([0-9]{{4}})(?:,| à| a las| às| alle)? ([0-9]{{1,2}})[:h]([0-9]{{2}})(?::([0-9]{{2}}))?(?: Uhr)?$", "$3|$2|$1|$4|$5|$6||||"),
]
#: digits of an epoch value, microseconds for one unit
EPOCHS = {10: 1_000_000, 13: 1_000, 16: 1}
_DAY = 86_400_000_000


def _lookup(pairs: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def zone_names(spark: SparkSession) -> list[str]:
    """Names of the time zone database that the JVM has; others would make Spark's zone functions fail."""
    names = spark._jvm.java.time.ZoneId.getAvailableZoneIds()
    return sorted(str(x) for x in names if "/" in str(x) and not str(x).startswith("SystemV/"))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 in the proleptic Gregorian calendar; integers in, no exceptions."""
    shifted = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(shifted / 400)
    yoe = shifted - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468


def days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _offset(micros: Column, zone: Column) -> Column:
    """Microseconds that local time in ``zone`` is ahead of UTC at the instant ``micros``."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), zone)) - micros


def local_to_utc(local: Column, zone: Column, ambiguous: str = "reject", nonexistent: str = "reject") -> Column:
    """Struct of ``micros`` and ``status`` for local microseconds in a valid zone.

    Both offsets in force around the local time are tried; an offset fits if it holds at the instant it leads to. Two
    that fit: the time is repeated (``ambiguous``: ``reject``, ``earlier`` or ``later``). None: it is skipped
    (``nonexistent``: ``reject`` or ``shift``, which moves it forward by the gap).
    """
    first, second = local - _offset(local - _DAY, zone), local - _offset(local + _DAY, zone)

    def decide(c: Column) -> Column:
        fit1, fit2 = local - _offset(c[0], zone) == c[0], local - _offset(c[1], zone) == c[1]
        twice = {"reject": F.lit(None).cast("bigint"), "earlier": F.least(c[0], c[1]), "later": F.greatest(c[0], c[1])}
        never = {"reject": F.lit(None).cast("bigint"), "shift": c[0]}

        def struct(micros: Column, status: str) -> Column:
            return F.struct(micros.alias("micros"), F.lit(status).alias("status"))

        return (
            F.when((c[0] == c[1]) & fit1, struct(c[0], "ok"))
            .when(fit1 & fit2, struct(twice[ambiguous], "ambiguous"))
            .when(fit1, struct(c[0], "ok"))
            .when(fit2, struct(c[1], "ok"))
            .otherwise(struct(never[nonexistent], "nonexistent"))
        )

    return let(F.array(first, second), decide)


def normalize_instants(
    df: DataFrame, value: str, default_zone: str, ambiguous: str = "reject", nonexistent: str = "reject"
) -> DataFrame:
    """Add ``utc_micros``, ``format`` and ``status`` for the verbatim time in column ``value``.

    ``default_zone`` names the column with the zone of values without one. ``status`` is ``ok``, ``missing`` (null or
    blank), ``unreadable`` (no pattern), ``date_only``, ``invalid`` (no such day, time, weekday or offset),
    ``unknown_zone``, ``no_zone``, ``ambiguous`` or ``nonexistent``; ``utc_micros`` is null for all but ``ok`` and what the
    policies allow. Two-digit years are 2000 to 2068 and 1969 to 1999. Missing seconds are 0 and digits beyond
    microseconds are cut off. An offset in the value wins over a zone name in brackets. Columns of the input stay;
    the helper columns are dropped; input columns named like the outputs are replaced.
    """
    zones = zone_names(df.sparkSession)
    months = {name: n for n, names in MONTHS.items() for name in names.split()}
    text = F.col("_t_text")
    rewritten, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for label, pattern, target in reversed(CASCADE):
        rewritten = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, f"{label}|{target}")).otherwise(rewritten)
    part = lambda i: F.nullif(F.get(F.col("_t_parts"), F.lit(i)), F.lit(""))
    number = lambda i: part(i).cast("int")

    out = df.withColumn("_t_text", stripped(F.col(value))).withColumn("_t_parts", F.split(rewritten, r"\|"))
    epoch = F.lit(None).cast("bigint")
    for digits, unit in EPOCHS.items():
        epoch = F.when(text.rlike(f"^[0-9]{{{digits}}}$"), text.cast("bigint") * unit).otherwise(epoch)
    epoch = F.when(text.rlike("^[0-9]{10,16}$"), epoch)
    year = F.when(F.length(part(1)) == 2, F.when(number(1) <= 68, number(1) + 2000).otherwise(number(1) + 1900)).otherwise(number(1))
    month = F.when(part(2).rlike("^[0-9]+$"), part(2).try_cast("int")).otherwise(_lookup(months, F.lower(part(2))))
    half = F.lower(part(8))
    hour = (
        F.when(half.isNull(), number(4))
        .when((number(4) < 1) | (number(4) > 12), -1)
        .otherwise(number(4) % 12 + F.when(half == "p", 12).otherwise(0))
    )
    zone = part(9)
    shift = F.when(
        zone.rlike("^[+-]"),
        (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, -2, 2).cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1),
    ).otherwise(_lookup(ABBREVIATIONS, F.upper(zone)))
    out = (
        out.withColumn("_t_epoch", epoch)
        .withColumn("_t_y", year)
        .withColumn("_t_m", month)
        .withColumn("_t_d", number(3))
        .withColumn("_t_h", hour)
        .withColumn("_t_zone", zone)
        .withColumn("_t_shift", shift)
        .withColumn(
            "_t_zone_id",
            F.when(F.col("_t_zone").isNull(), F.col(default_zone)).when(F.col("_t_shift").isNull(), F.col("_t_zone")),
        )
    )
    c = F.col
    clock = (c("_t_h").between(0, 23)) & (number(5) <= 59) & (F.coalesce(number(6), F.lit(0)) <= 59)
    calendar = c("_t_m").between(1, 12) & (c("_t_y") >= 1) & (c("_t_d") >= 1) & (c("_t_d") <= days_in_month(c("_t_y"), c("_t_m")))
    days = days_from_civil(c("_t_y"), c("_t_m"), c("_t_d"))
    spoken = F.lower(part(10))
    weekday = spoken.isNull() | (spoken == F.array(*[F.lit(x) for x in WEEKDAYS])[F.pmod(days + 3, F.lit(7)).cast("int")])
    offset = c("_t_shift").isNull() | (c("_t_shift").between(-14 * 60, 14 * 60) & ~zone.rlike("[6-9][0-9]$"))
    micros = F.rpad(F.coalesce(F.substring(part(7), 1, 6), F.lit("")), 6, "0").cast("bigint")
    local = (days * 86400 + c("_t_h") * 3600 + number(5) * 60 + F.coalesce(number(6), F.lit(0))) * 1_000_000 + micros
    out = out.withColumn("_t_valid", F.coalesce(calendar & clock & weekday & offset, F.lit(False)))
    out = out.withColumn("_t_local", F.when(c("_t_valid"), local.cast("bigint")))
    known = c("_t_zone_id").isin(zones)
    resolved = F.when(c("_t_local").isNotNull() & known, local_to_utc(c("_t_local"), c("_t_zone_id"), ambiguous, nonexistent))
    out = out.withColumn("_t_found", resolved)
    date_only = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{8}$|^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$|^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$|^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"
    status = (
        F.when(text.isNull(), "missing")
        .when(c("_t_epoch").isNotNull(), "ok")
        .when(c("_t_parts").isNull(), F.when(text.rlike(date_only), "date_only").otherwise("unreadable"))
        .when(~c("_t_valid"), "invalid")
        .when(c("_t_shift").isNotNull(), "ok")
        .when(c("_t_zone_id").isNull(), "no_zone")
        .when(~known, "unknown_zone")
        .otherwise(c("_t_found.status"))
    )
    utc = F.coalesce(
        c("_t_epoch"),
        F.when(c("_t_shift").isNotNull(), c("_t_local") - c("_t_shift").cast("bigint") * 60_000_000),
        c("_t_found.micros"),
    )
    label = F.when(c("_t_epoch").isNotNull(), "epoch").otherwise(F.get(c("_t_parts"), F.lit(0)))
    # Through a generator, so that a filter on the results is not pushed into, and does not repeat, the whole cascade.
    found = F.array(F.struct(utc.alias("utc_micros"), label.alias("format"), status.alias("status")))
    kept = [F.col(f"`{x}`") for x in df.columns if x not in ("utc_micros", "format", "status")]
    return out.select(*kept, F.inline(found))


def feed_times(entries: DataFrame, feeds: DataFrame, channels: DataFrame) -> DataFrame:
    """Every time field of entries and feeds, one row each, with the home zone of its feed, normalised.

    The zone lookup is an equi-join on ``feed_id``; Catalyst broadcasts the channels only below its size threshold, and
    adaptive execution splits a hot feed otherwise. A feed without channel, or with a null zone, has no default zone.
    """

    def fields(df: DataFrame, table: str, key: str, names: list[str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("raw")) for n in names])
        return df.select(F.lit(table).alias("table_name"), F.col(key).alias("row_id"), "feed_id", F.inline(pairs))

    values = fields(entries, "entries", "row_id", ["published", "updated"]).union(fields(feeds, "feeds", "snap_id", ["updated"]))
    zones = channels.groupBy("feed_id").agg(F.max("tz_name").alias("home_zone"))
    return normalize_instants(values.join(zones, "feed_id", "left"), "raw", "home_zone")
