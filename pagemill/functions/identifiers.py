"""Canonical spellings of identifiers and web addresses, as Column expressions (no Python in the hot path)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that trace a visit and do not select content.
TRACKING = (
    "utm_[a-z_]+|fbclid|gclid|gclsrc|dclid|msclkid|yclid|twclid|igshid|mc_cid|mc_eid|_hsenc|_hsmi|wt_mc|"
    "ref_src|cmpid|ocid|spm"
)
# Characters that RFC 3986 calls unreserved; an escape of one is the same address.
UNRESERVED = "^[A-Za-z0-9._~-]$"
# Blanks that may stand around a value.
BLANKS = " \t\n\r\f\v\u00a0\u2003\u2009\u200b\u3000\ufeff"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def stripped(value: Column) -> Column:
    """``value`` without blanks around it; null when nothing is left."""
    return F.nullif(F.btrim(value, F.lit(BLANKS)), F.lit(""))


def decode_unreserved(value: Column) -> Column:
    """Resolve %XX escapes of unreserved characters; other escapes get upper-case digits."""

    def fixed(p: Column) -> Column:
        rest = p.substr(F.lit(3), F.length(p))
        sign = F.chr(F.conv(F.substring(p, 1, 2), 16, 10).cast("bigint"))
        escape = F.when(sign.rlike(UNRESERVED), sign).otherwise(F.concat(F.lit("%"), F.upper(F.substring(p, 1, 2))))
        return F.when(p.rlike("^[0-9A-Fa-f]{2}"), F.concat(escape, rest)).otherwise(F.concat(F.lit("%"), p))

    def of(parts: Column) -> Column:
        return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), fixed), ""))

    return F.when(value.contains("%"), let(F.split(value, "%"), of)).otherwise(value)


def canonical_url(value: Column) -> Column:
    """The address without what does not select content.

    Dropped or unified: blanks around it, http against https, letter case of scheme and host, a leading ``www.``, the
    default ports 80 and 443, the fragment, tracking parameters, the order of the other parameters, escapes of
    unreserved characters, a trailing slash. Null, blank: null. A value that is no http address comes back stripped.
    """
    shape = r"^[hH][tT]{2}[pP][sS]?://(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

    def rebuilt(parts: Column) -> Column:
        host = F.regexp_replace(F.lower(parts[0]), r"^www\.|\.$", "")
        query = F.array_sort(
            F.filter(F.split(parts[3], "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^(?:{TRACKING})(?:=|$)"))
        )
        return F.concat(
            F.lit("https://"),
            host,
            F.when(parts[1].isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), parts[1])),
            F.rtrim(parts[2], F.lit("/")),
            F.when(parts[3] == "", "").otherwise(
                let(query, lambda q: F.when(F.size(q) > 0, F.concat(F.lit("?"), F.array_join(q, "&"))).otherwise(""))
            ),
        )

    def of(bare: Column) -> Column:
        parts = F.split(decode_unreserved(F.regexp_replace(bare, shape, "$1\u0001$2\u0001$3\u0001$4")), "\u0001")
        return let(parts, lambda p: F.when(F.size(p) == 4, rebuilt(p)).otherwise(bare))

    return let(stripped(value), of)


def canonical_id(value: Column) -> Column:
    """One spelling for each identifier.

    A UUID in any form (bare, ``urn:uuid:``, braces, no hyphens, any letter case) becomes its lower-case hex digits;
    a web address its canonical address; anything else is stripped and keeps its letter case.
    """
    shape = r"^(?i:urn:)?(?i:uuid:)?\{?([0-9A-Fa-f]{8})-?([0-9A-Fa-f]{4})-?([0-9A-Fa-f]{4})-?([0-9A-Fa-f]{4})-?([0-9A-Fa-f]{12})\}?$"

    def of(bare: Column) -> Column:
        uuid = F.concat(F.lit("uuid:"), F.lower(F.regexp_replace(bare, shape, "$1$2$3$4$5")))
        return F.when(bare.rlike("^(?i:https?)://"), canonical_url(bare)).when(bare.rlike(shape), uuid).otherwise(bare)

    return let(stripped(value), of)
