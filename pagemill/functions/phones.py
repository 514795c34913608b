"""Telephone numbers: parsing, kinds, formats and finding them in text, from a table of numbering plans by country."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values, one country a line: region, calling code, national prefix (- for none), least and greatest length of the
# national number, beginnings of mobile numbers, of free numbers, and sizes of the groups it is written in.
PLANS = """
US 1 1 10 10 - 800,833,844,855,866,877,888 3,3,4
CA 1 1 10 10 - 800,833,844,855,866,877,888 3,3,4
GB 44 0 9 10 7 800,808 2,4,4
DE 49 0 6 11 15,16,17 800 3,4,4
FR 33 0 9 9 6,7 80 1,2,2,2,2
ES 34 - 9 9 6,7 900,800 3,3,3
IT 39 - 6 11 3 800,803 3,3,4
PT 351 - 9 9 9 800 3,3,3
PL 48 - 9 9 45,50,51,53,57,60,66,69,72,73,78,79,88 800 3,3,3
RU 7 8 10 10 9 800 3,3,2,2
KZ 7 8 10 10 70,77 800 3,3,2,2
UA 380 0 9 9 39,50,63,66,67,68,73,91,92,93,94,95,96,97,98,99 800 2,3,2,2
CZ 420 - 9 9 60,72,73,77,79 800 3,3,3
SK 421 0 9 9 9 800 3,3,3
AT 43 0 7 12 65,66,67,68,69 800 3,3,4
CH 41 0 9 9 74,75,76,77,78,79 800 2,3,2,2
NL 31 0 9 9 6 800 2,3,4
BE 32 0 8 9 4 800 3,2,2,2
LU 352 - 6 9 6 800 3,3,3
DK 45 - 8 8 2,30,31,40,41,42,50,51,52,53,60,61,71,81,91,92,93 80 2,2,2,2
NO 47 - 8 8 4,9 80 2,2,2,2
SE 46 0 7 9 70,72,73,76,79 20 2,3,2,2
FI 358 0 6 10 4,50 800 2,3,4
IE 353 0 7 9 8 1800 2,3,4
GR 30 - 10 10 69 800 3,3,4
HU 36 06 8 9 20,30,31,50,70 80 2,3,4
RO 40 0 9 9 7 800 3,3,3
BG 359 0 8 9 87,88,89,98,99 800 2,3,4
TR 90 0 10 10 5 800 3,3,2,2
IL 972 0 8 9 5 1800 2,3,4
JP 81 0 9 10 70,80,90 120,800 2,4,4
CN 86 0 10 11 13,14,15,16,17,18,19 800,400 3,4,4
KR 82 0 8 10 10,11 80 2,4,4
IN 91 0 10 10 6,7,8,9 1800 5,5
AU 61 0 9 9 4 1800 1,4,4
NZ 64 0 8 10 2 800,508 2,3,4
BR 55 0 10 11 119,219,319,419,519,619,719,819,919 800 2,5,4
MX 52 - 10 10 - 800 2,4,4
AR 54 0 10 10 9 800 2,4,4
ZA 27 0 9 9 6,7,8 80 2,3,4
SG 65 - 8 8 8,9 800 4,4
HK 852 - 8 8 5,6,7,9 800 4,4
"""


@dataclass(frozen=True)
class Plan:
    region: str
    code: str
    prefix: str
    least: int
    most: int
    mobile: tuple[str, ...]
    free: tuple[str, ...]
    groups: tuple[int, ...]


def _plans() -> dict[str, Plan]:
    out = {}
    for line in PLANS.strip().splitlines():
        region, code, prefix, least, most, mobile, free, groups = line.split()
        many = lambda v: tuple(x for x in v.split(",") if x != "-")
        out[region] = Plan(region, code, prefix.replace("-", ""), int(least), int(most), many(mobile), many(free), tuple(map(int, groups.split(","))))
    return out


BY_REGION = _plans()
BY_CODE: dict[str, list[Plan]] = {}
for _plan in BY_REGION.values():
    BY_CODE.setdefault(_plan.code, []).append(_plan)
# Area codes of Canada among those of North America.
CANADA = frozenset(
    "204 226 236 249 250 263 289 306 343 354 365 367 368 382 387 403 416 418 428 431 437 438 450 468 474 506 514 519 548 579 581 584 587 604 613 639 647 672 683 705 709 742 753 778 780 782 807 819 825 867 873 879 902 905".split()
)
_EXTENSION = re.compile(r"(?:\s*(?:;ext=|,|(?:e?xt(?:ension|\.)?|x|#|Durchwahl|App\.?|poste|доб\.?)\s*[:.]?)\s*(\d{1,7}))\s*$", re.I)
_WIDE = str.maketrans("０１２３４５６７８９＋（）－　", "0123456789+()- ")


@dataclass(frozen=True)
class Phone:
    """A number: calling code, national number, extension, country, kind (fixed, mobile, toll_free, fixed_or_mobile)."""

    country_code: int
    national_number: str
    extension: str | None
    region: str
    type: str

    @property
    def e164(self) -> str:
        return f"+{self.country_code}{self.national_number}"

    def _grouped(self) -> list[str]:
        sizes, rest, out = BY_REGION[self.region].groups, self.national_number, []
        if len(rest) < sum(sizes):  # shorter numbers lose it in the middle
            sizes = (sizes[0], *sizes[1:-1], max(2, len(rest) - sum(sizes[:-1]))) if len(rest) - sum(sizes[:-1]) >= 2 else (sizes[0], len(rest) - sizes[0])
        for size in sizes[:-1]:
            out.append(rest[:size])
            rest = rest[size:]
        return [x for x in [*out, rest] if x]

    def format(self, form: str = "e164") -> str:
        """``e164``, ``international``, ``national`` or ``rfc3966``."""
        groups, plan = self._grouped(), BY_REGION[self.region]
        ext = self.extension
        if form == "e164":
            return self.e164
        if form == "rfc3966":
            return f"tel:+{self.country_code}-{'-'.join(groups)}" + (f";ext={ext}" if ext else "")
        if form == "international":
            return f"+{self.country_code} {' '.join(groups)}" + (f" ext. {ext}" if ext else "")
        if self.country_code == 1:
            text = f"({groups[0]}) {'-'.join(groups[1:])}"
        elif plan.code == "7":
            text = f"8 ({groups[0]}) {groups[1]}-{'-'.join(groups[2:])}"
        else:
            text = plan.prefix + " ".join(groups)
        return text + (f" ext. {ext}" if ext else "")

    @property
    def international_number(self) -> str:
        return self.format("international")


def _kind(plan: Plan, number: str) -> str:
    if plan.code == "1":
        return "toll_free" if number.startswith(plan.free) else "fixed_or_mobile"
    if plan.free and number.startswith(plan.free):
        return "toll_free"
    if plan.code == "55":
        return "mobile" if len(number) == 11 and number[2] == "9" else "fixed"
    return "mobile" if plan.mobile and number.startswith(plan.mobile) else "fixed"


def _valid(plan: Plan, number: str) -> bool:
    if not plan.least <= len(number) <= plan.most:
        return False
    if plan.code == "1":
        return bool(re.fullmatch(r"[2-9]\d{2}[2-9]\d{6}", number)) and number[1:3] != "11" and (number[:3] in CANADA) == (plan.region == "CA")
    return not (number.startswith("0") and plan.region != "IT")


def parse_phone(text: str | None, region: str | None = None) -> Phone | None:
    """The number that ``text`` gives, dialled from ``region`` if it has no calling code; null if it gives none that is valid."""
    if not text:
        return None
    body = text.translate(_WIDE).strip()
    body = re.sub(r"^tel:", "", body, flags=re.I)
    m = _EXTENSION.search(body)
    extension = m[1] if m else None
    body = body[: m.start()] if m else body
    if not re.fullmatch(r"[+(]?[\d\s().\-/‐‑–— ]+", body.replace("+", "", 1) if body.startswith("(+") else body):
        return None
    plus = "+" in body[:2]
    body = re.sub(r"\(0\)", "", body) if plus else body
    digits = re.sub(r"\D", "", body)
    out_of = "011" if region in ("US", "CA") else "810" if region in ("RU", "KZ") else "0011" if region == "AU" else "00"
    candidates: list[tuple[Plan, str]] = []
    if plus or digits.startswith(out_of) and len(digits) > 10 or digits.startswith("00") and len(digits) > 10:
        rest = digits if plus else digits[len(out_of) :] if digits.startswith(out_of) else digits[2:]
        for size in (3, 2, 1):
            for plan in BY_CODE.get(rest[:size], ()):
                number = rest[size:]
                candidates += [(plan, number), (plan, number.removeprefix(plan.prefix))] if plan.prefix and number.startswith(plan.prefix) else [(plan, number)]
    elif region in BY_REGION:
        plan = BY_REGION[region]
        same = [plan, *(p for p in BY_CODE[plan.code] if p is not plan)]
        for p in same:
            if p.prefix and digits.startswith(p.prefix):
                candidates.append((p, digits[len(p.prefix) :]))
            candidates.append((p, digits))
    for plan, number in candidates:
        if _valid(plan, number):
            return Phone(int(plan.code), number, extension, plan.region, _kind(plan, number))
    return None


_CANDIDATE = re.compile(r"(?<![\w@/.:+=&-])(?:\(?\+?\d[\d().\-/‐‑–  ]{5,24}\d)(?:\s*(?:ext\.?|x|extension)\s*\d{1,6})?(?![\w@])", re.I)


def find_phones(text: str | None, regions: tuple[str, ...] = ()) -> list[tuple[int, int, str, Phone]]:
    """Begin, end, spelling and number of each in a text. Numbers without calling code need one of ``regions``."""
    out = []
    for m in _CANDIDATE.finditer(text or ""):
        found = None
        if re.search(r"\d{4}-\d\d-\d\d|\d\d?[./]\d\d?[./]\d{2,4}(?!\d)", m[0]) and "+" not in m[0]:
            continue
        for region in (None, *regions):
            if found := parse_phone(m[0], region):
                break
        if found:
            out.append((m.start(), m.end(), m[0], found))
    return out


PHONE = "struct<country_code:int,national_number:string,extension:string,region:string,type:string,e164:string,international:string,national:string,rfc3966:string>"
_KIND = pa.struct([("country_code", pa.int32()), *[(n, pa.string()) for n in ("national_number", "extension", "region", "type", "e164", "international", "national", "rfc3966")]])


def _row(p: Phone | None) -> dict | None:
    return None if p is None else {"country_code": p.country_code, "national_number": p.national_number, "extension": p.extension, "region": p.region, "type": p.type} | {f: p.format(f) for f in ("e164", "international", "national", "rfc3966")}


def parse_phones(df: DataFrame, text: str, region: str | None = None) -> DataFrame:
    """Add ``phone``, the number in column ``text`` in all its forms; null where there is none. Other columns stay.

    ``region`` names a column with the country that the number is dialled from; rows with null there need a calling code.
    """
    columns = [c for c in df.columns if c != "phone"]
    at, by = columns.index(text), columns.index(region) if region else None
    schema = T.StructType([*[df.schema[c] for c in columns], *df.sparkSession.createDataFrame([], f"phone {PHONE}").schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regions = batch.column(by).to_pylist() if by is not None else [None] * batch.num_rows
            found = [_row(parse_phone(v, r)) for v, r in zip(batch.column(at).to_pylist(), regions, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _KIND)], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)
