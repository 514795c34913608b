"""Telephone numbers."""

from __future__ import annotations

import pytest

from pagemill.functions.phones import BY_REGION, find_phones, parse_phone, parse_phones


@pytest.mark.parametrize(
    ("text", "region", "e164", "kind"),
    [
        ("+44 20 7946 0541", None, "+442079460541", "fixed"), ("020 7946 0541", "GB", "+442079460541", "fixed"), ("07700 900123 x12", "GB", "+447700900123", "mobile"), ("(202) 555-0143", "US", "+12025550143", "fixed_or_mobile"), ("1-800-555-0143", "US", "+18005550143", "toll_free"),
        ("416 555 0143", "US", "+14165550143", "fixed_or_mobile"), ("+49 (0)30 123456", None, "+4930123456", "fixed"), ("0049 171 3920034", "DE", "+491713920034", "mobile"), ("8 (912) 345-67-89", "RU", "+79123456789", "mobile"), ("011 33 6 12 34 56 78", "US", "+33612345678", "mobile"),
        ("tel:+34-600-123-456", None, "+34600123456", "mobile"), ("+55 11 91234 5678", None, "+5511912345678", "mobile"), ("+39 06 1234567", None, "+39061234567", "fixed"), ("02079460541", None, None, None), ("+999 123456789", None, None, None), ("12", "DE", None, None), ("call me", "US", None, None), ("", "US", None, None), (None, None, None, None),
        ("111 555 0143", "US", None, None), ("＋４４ ２０ ７９４６ ０５４１", None, "+442079460541", "fixed"),
    ],
)
def test_parsing(text, region, e164, kind):
    found = parse_phone(text, region)
    assert (found and found.e164, found and found.type) == (e164, kind)
    if found:  # every form reads back
        for form in ("e164", "international", "rfc3966"):
            assert parse_phone(found.format(form)).e164 == e164
        assert parse_phone(found.format("national"), found.region).e164 == e164


def test_forms():
    p = parse_phone("+12025550143;ext=7")
    assert (p.region, p.extension, p.international_number, p.format("national"), p.format("rfc3966")) == ("US", "7", "+1 202 555 0143 ext. 7", "(202) 555-0143 ext. 7", "tel:+1-202-555-0143;ext=7")
    assert parse_phone("+33612345678").format("national") == "06 12 34 56 78" and parse_phone("+14165550143").region == "CA"
    assert all(p.least <= p.most and p.groups for p in BY_REGION.values())


def test_finding():
    text = "Call +44 20 7946 0541 or (202) 555-0143 ext 9, not 2024-01-02, 12.03.2024, v1.2.3.4 or 4 × 12."
    assert [(s, p.e164) for _, _, s, p in find_phones(text, ("US",))] == [("+44 20 7946 0541", "+442079460541"), ("(202) 555-0143 ext 9", "+12025550143")]
    assert find_phones(None) == [] and [p.e164 for *_, p in find_phones(text)] == ["+442079460541"]


def test_rows(spark):
    df = spark.createDataFrame([(1, "030 123456", "DE", "x"), (2, None, "DE", "x"), (3, "+41 44 668 18 00", None, "x")], "k int, t string, r string, phone string")
    got = {r["k"]: r["phone"] and (r["phone"]["e164"], r["phone"]["region"]) for r in parse_phones(df, "t", "r").collect()}
    assert got == {1: ("+4930123456", "DE"), 2: None, 3: ("+41446681800", "CH")}
    assert parse_phones(df.limit(0), "t").count() == 0
