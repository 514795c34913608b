"""Parts of addresses, registrable domains and address cleaning, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import whatwg
from pagemill.functions.identifiers import canonical_url, let
from pagemill.functions.whatwg import UrlCleaning

# Rules of public suffixes that are common on the web, beside the last label, in the notation of the public list
# (``*`` stands for any label, ``!`` excepts a name). ``read_rules`` reads the whole list from a file.
RULES = (
    "co.uk org.uk gov.uk ac.uk me.uk net.uk ltd.uk plc.uk sch.uk com.au net.au org.au edu.au gov.au id.au co.nz org.nz net.nz govt.nz ac.nz "
    "co.jp ne.jp or.jp ac.jp go.jp ad.jp ed.jp gr.jp lg.jp com.br net.br org.br gov.br edu.br com.mx org.mx gob.mx com.ar gob.ar org.ar com.pl net.pl org.pl edu.pl gov.pl "
    "com.pt edu.pt co.in net.in org.in gen.in firm.in ac.in gov.in com.cn net.cn org.cn gov.cn edu.cn co.kr or.kr go.kr ac.kr com.tr org.tr gov.tr edu.tr com.ua net.ua org.ua gov.ua "
    "co.za org.za gov.za com.sg edu.sg gov.sg com.hk org.hk edu.hk com.tw org.tw gov.tw edu.tw co.il org.il ac.il gov.il com.es org.es nom.es gob.es com.ru msk.ru spb.ru "
    "com.co com.pe com.ve com.ec com.uy com.my com.ph com.vn co.th or.th ac.th go.th in.th co.id or.id ac.id go.id com.sa com.eg co.ke com.ng com.gh com.gr gov.it edu.it "
    "github.io gitlab.io blogspot.com appspot.com cloudfront.net herokuapp.com netlify.app vercel.app pages.dev web.app firebaseapp.com azurewebsites.net s3.amazonaws.com "
    "*.bd *.ck !www.ck *.er *.fk *.jm *.kh *.mm *.np *.pg *.kawasaki.jp !city.kawasaki.jp *.kobe.jp !city.kobe.jp *.nagoya.jp !city.nagoya.jp *.sapporo.jp !city.sapporo.jp *.yokohama.jp !city.yokohama.jp"
).split()
_SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_parts(url: Column) -> Column:
    """Struct of scheme, user, host, port, path, query and fragment; null if it is no absolute address."""
    part = lambda i: F.regexp_extract(url, _SHAPE, i)
    return F.when(
        url.rlike(_SHAPE),
        F.struct(
            F.lower(part(1)).alias("scheme"), part(2).alias("user"), F.lower(part(3)).alias("host"), part(4).try_cast("int").alias("port"),
            part(5).alias("path"), part(6).alias("query"), part(7).alias("fragment"),
        ),
    )


def read_rules(path: str) -> list[str]:
    """Rules of a file in the format of the public suffix list; comments and blank lines are left out."""
    with open(path, encoding="utf-8") as file:
        lines = (line.split()[0] for line in file if line.strip() and not line.startswith("//"))
        return [whatwg.to_ascii(x) or x if x.isascii() or x[0] not in "*!" else x for x in lines]


def registrable_domain(host: Column, rules: list[str] | tuple[str, ...] = tuple(RULES)) -> Column:
    """The public suffix and one label before it; null for addresses of numbers and for suffixes themselves.

    An exception among the rules counts before a wildcard, the longest rule that fits before shorter ones; where none fits
    the suffix is the last label. The rules are a hashed set inside the plan, so there is no join.
    """
    exact = [r for r in rules if r[0] not in "*!"]
    wild = [r[2:] for r in rules if r.startswith("*.")]
    excepted = [r[1:] for r in rules if r.startswith("!")]

    def of(labels: Column) -> Column:
        n = F.size(labels)
        tail = lambda i: F.array_join(F.slice(labels, i, n), ".")
        one = lambda i: F.when(tail(i).isin(excepted), 1000 + n - i).when((i < n) & tail(i + 1).isin(wild) | tail(i).isin(exact), n - i + 1).otherwise(1)
        size = F.array_max(F.transform(F.sequence(F.lit(1), n), one)) % 1000
        return let(size, lambda k: F.when(n > k, F.array_join(F.slice(labels, n - k, k + 1), ".")))

    bare = F.lower(F.rtrim(host, F.lit(".")))
    return F.when(~bare.rlike(r"^[0-9.]*$|:|^$"), let(F.split(bare, r"\."), of))


def clean_url(url: Column, language: str | None = None) -> Column:
    """The canonical address, or null for what is no web page: other schemes, files of media and code, other languages."""
    clean = canonical_url(url)
    keep = clean.startswith("https://") & ~F.lower(clean).rlike(r"\.(?:jpe?g|png|gif|svg|webp|ico|css|js|mp[34]|avi|mov|zip|gz|exe|pdf|docx?|xlsx?)(?:\?|$)")
    if language:
        keep = keep & (~clean.rlike(r"^https://[^/]+/[a-z]{2}(?:-[a-z]{2})?(?:/|$)") | clean.rlike(rf"^https://[^/]+/{language}(?:-[a-z]{{2}})?(?:/|$)"))
    return F.when(keep, clean)


def _each(function: Callable[..., str | None], *columns: Column) -> Column:
    """A function of single values over Arrow batches."""

    @F.pandas_udf("string")
    def one(values: pd.Series) -> pd.Series:
        return values.map(lambda v: function(v) if isinstance(v, str) else None)

    @F.pandas_udf("string")
    def two(values: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([function(v, o if isinstance(o, str) else None) if isinstance(v, str) else None for v, o in zip(values, others, strict=True)], dtype=object)

    return one(*columns) if len(columns) == 1 else two(*columns)


def resolve(link: Column, base: Column) -> Column:
    """``link`` as an absolute address by the URL standard; null if it is none."""
    return _each(whatwg.resolve, link, base)


def to_ascii(host: Column) -> Column:
    """A domain in ASCII by IDNA; null if it is none."""
    return _each(whatwg.to_ascii, host)


def to_unicode(host: Column) -> Column:
    return _each(whatwg.to_unicode, host)


def normalize_url(url: Column, options: UrlCleaning = UrlCleaning()) -> Column:
    """One spelling by the URL standard, without trackers, the query sorted; null for what is no address."""
    return _each(lambda v: whatwg.normalize_one(v, options), url)


def scrub_url(url: Column, options: UrlCleaning = UrlCleaning()) -> Column:
    """The normalized address of a web page, or null for what the options reject."""
    return _each(lambda v: whatwg.clean_one(v, options), url)


def percent_decode(value: Column) -> Column:
    """Escapes read as UTF-8; broken sequences become replacement signs."""
    return _each(lambda v: whatwg.percent_decode(v).decode("utf-8", "replace"), value)


def percent_encode(value: Column) -> Column:
    """Escapes for what a path may not hold as it is."""
    return _each(lambda v: whatwg.percent_encode(v, whatwg._PATH), value)
