"""Addresses by the URL standard: parsing, resolving against a base, serializing, host names in ASCII; and cleaning by options.

Plain functions of one value; ``pagemill.functions.urls`` makes columns of them.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field, replace

# Special schemes with their default ports.
SPECIAL = {"ftp": 21, "file": None, "http": 80, "https": 443, "ws": 80, "wss": 443}
_CONTROL = frozenset(map(chr, [*range(0x20), *range(0x7F, 0xA0)]))
_FRAGMENT = frozenset(' "<>`')
_QUERY = frozenset(' "#<>')
_PATH = _QUERY | frozenset("?^`{}")
_USERINFO = _PATH | frozenset("/:;=@[\\]^|")
_FORBIDDEN_HOST = frozenset("\x00\t\n\r #/:<>?@[\\]^|")
_FORBIDDEN_DOMAIN = _FORBIDDEN_HOST | frozenset(map(chr, range(0x20))) | {"%", "\x7f"}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")


def percent_encode(text: str, signs: frozenset[str]) -> str:
    """UTF-8 escapes for controls, everything beyond ASCII and ``signs``; escapes that are there stay."""
    return "".join(c if " " <= c <= "~" and c not in signs else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def percent_decode(text: str) -> bytes:
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode("utf-8", "replace"))


_IGNORED = dict.fromkeys(map(ord, "\u00ad\u034f\u180b\u180c\u180d\u200b\u2060\u2064\ufe00\ufe01\ufe0f\ufeff"))
_DOTS = re.compile("[.\u3002\uff0e\uff61]")


def to_ascii(host: str) -> str | None:
    """A domain in ASCII (UTS 46, not transitional): mapped, normalized, labels beyond ASCII in Punycode. Null if it is none."""
    mapped = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", host.translate(_IGNORED)).lower().translate(_IGNORED))
    labels = []
    for label in _DOTS.split(mapped):
        if label.startswith("xn--"):
            try:
                plain = label[4:].encode("ascii").decode("punycode")
            except (UnicodeError, ValueError):
                return None
            if not plain or plain.isascii() or unicodedata.normalize("NFC", plain) != plain or to_ascii(plain) != label:
                return None
            labels.append(label)
        elif label.isascii():
            labels.append(label)
        else:
            if unicodedata.category(label[0]).startswith("M") or label.startswith("-") or label.endswith("-") or any(unicodedata.category(c) in ("Cn", "Co", "Cs", "Zs", "Zl", "Zp", "Cc") for c in label):
                return None
            labels.append("xn--" + label.encode("punycode").decode("ascii"))
    out = ".".join(labels)
    return None if not out or any(c in _FORBIDDEN_DOMAIN for c in out) else out


def to_unicode(host: str) -> str:
    """A domain with its Punycode labels read; labels that cannot be read stay."""
    labels = []
    for label in host.split("."):
        if label.lower().startswith("xn--"):
            try:
                label = label[4:].encode("ascii").decode("punycode")
            except (UnicodeError, ValueError):
                pass
        labels.append(label)
    return ".".join(labels)


def _number(part: str) -> int | None:
    if part[:2].lower() == "0x":
        digits, base = part[2:] or "0", 16
    elif len(part) > 1 and part[0] == "0":
        digits, base = part[1:], 8
    else:
        digits, base = part, 10
    try:
        return int(digits, base) if digits and re.fullmatch(r"[0-9A-Fa-f]+", digits) else None
    except ValueError:
        return None


def _ipv4(host: str) -> str | bool | None:
    """The address in dots; false if the name is no number; null if it is a wrong one."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    last = parts[-1]
    if not (last.isdigit() and last.isascii() or last[:2].lower() == "0x" and _number(last) is not None):
        return False
    numbers = [_number(p) if p else None for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n * 256 ** (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _ipv6(text: str) -> str | None:
    if "." in text:
        head, _, tail = text.rpartition(":")
        four = tail.split(".")
        if len(four) != 4 or not all(p.isdigit() and p.isascii() and int(p) < 256 and (p == "0" or p[0] != "0") for p in four):
            return None
        a, b, c, d = map(int, four)
        text = f"{head}:{a * 256 + b:x}:{c * 256 + d:x}"
    if text.count("::") > 1:
        return None
    left, gap, right = text.partition("::")
    parts = [p for p in left.split(":") if left] + (["gap"] if gap else []) + [p for p in right.split(":") if right]
    given = [p for p in parts if p != "gap"]
    if not all(re.fullmatch(r"[0-9A-Fa-f]{1,4}", p) for p in given) or (len(given) != 8 if not gap else len(given) > 7):
        return None
    full: list[int] = []
    for p in parts:
        full += [0] * (8 - len(given)) if p == "gap" else [int(p, 16)]
    runs = [(m.start() // 2, len(m[0]) // 2) for m in re.finditer(r"(?:0,)+", "".join("0," if x == 0 else "1," for x in full))]
    at, size = max(runs, key=lambda r: (r[1], -r[0]), default=(-1, 0))
    if size < 2:
        return "[" + ":".join(f"{x:x}" for x in full) + "]"
    return "[" + ":".join(f"{x:x}" for x in full[:at]) + "::" + ":".join(f"{x:x}" for x in full[at + size :]) + "]"


def parse_host(text: str, special: bool) -> str | None:
    if text.startswith("["):
        return _ipv6(text[1:-1]) if text.endswith("]") else None
    if not special:
        return None if any(c in _FORBIDDEN_HOST for c in text) else percent_encode(text, frozenset())
    domain = to_ascii(percent_decode(text).decode("utf-8", "replace"))
    if domain is None:
        return None
    four = _ipv4(domain)
    return domain if four is False else four


@dataclass(frozen=True)
class Url:
    """An address in its parts; ``path`` begins with a slash unless it is opaque."""

    scheme: str
    username: str = ""
    password: str = ""
    host: str | None = None
    port: int | None = None
    path: str = ""
    query: str | None = None
    fragment: str | None = None
    opaque: bool = False

    def __str__(self) -> str:
        user = f"{self.username}{':' + self.password if self.password else ''}@" if self.username or self.password else ""
        place = "" if self.host is None else f"//{user}{self.host}{'' if self.port is None else f':{self.port}'}"
        guard = "/." if self.host is None and not self.opaque and self.path.startswith("//") else ""
        return f"{self.scheme}:{place}{guard}{self.path}" + ("" if self.query is None else f"?{self.query}") + ("" if self.fragment is None else f"#{self.fragment}")

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host or ''}{'' if self.port is None else f':{self.port}'}" if self.scheme in SPECIAL and self.scheme != "file" else "null"


_ONE = re.compile(r"\.|%2e", re.I)
_TWO = re.compile(r"(?:\.|%2e){2}", re.I)


def _path(text: str, special: bool, base: list[str], scheme: str) -> str:
    """Segments without dots, over those of ``base``."""
    out = list(base)
    parts = re.split(r"[/\\]" if special else "/", text)
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if _TWO.fullmatch(part):
            if out and not (scheme == "file" and len(out) == 1 and re.fullmatch(r"[A-Za-z]:", out[0])):
                out.pop()
            if last:
                out.append("")
        elif _ONE.fullmatch(part):
            if last:
                out.append("")
        else:
            if scheme == "file" and not out and re.fullmatch(r"[A-Za-z][:|]", part):
                part = part[0] + ":"
            out.append(percent_encode(part, _PATH))
    return "/" + "/".join(out)


def parse_url(text: str | None, base: Url | str | None = None) -> Url | None:
    """The address that ``text`` gives, relative to ``base`` if it is; null if it gives none."""
    if text is None:
        return None
    if isinstance(base, str):
        base = parse_url(base)
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(0x21)))))
    text, hash_, fragment = text.partition("#")
    fragment_part = percent_encode(fragment, _FRAGMENT) if hash_ else None
    m = _SCHEME.match(text)
    if m is None and base is None:
        return None
    scheme = m[1].lower() if m else base.scheme
    special = scheme in SPECIAL
    rest = text[m.end() :] if m else text
    signs = _QUERY | ({"'"} if special else set())
    slash = "/\\" if special else "/"
    body, mark, query = rest.partition("?")
    query_part = percent_encode(query, frozenset(signs)) if mark else None
    relative = m is None or special and base is not None and base.scheme == scheme and not (body[:2] and all(c in slash for c in body[:2]) and len(body) > 1) and scheme != "file"
    if m is None and base is not None and base.opaque:
        return replace(base, fragment=fragment_part) if not text and hash_ else None
    if relative and base is not None and not (len(body) > 1 and body[0] in slash and body[1] in slash):
        if not body:
            return replace(base, query=query_part if mark else base.query, fragment=fragment_part)
        own = [] if body[0] in slash else base.path.split("/")[1:-1]
        keep = [base.path.split("/")[1]] if scheme == "file" and body[0] in slash and re.match(r"/[A-Za-z]:(?:/|$)", base.path) else []
        return replace(base, path=_path(body.lstrip(slash) if body[0] in slash and len(body) == 1 else body[1:] if body[0] in slash else body, special, own or keep, scheme), query=query_part, fragment=fragment_part)
    if not special and m is not None and not body.startswith("/"):
        return Url(scheme, path=percent_encode(body, frozenset()), query=query_part, fragment=fragment_part, opaque=True)
    if scheme == "file":
        tail = body
        host = ""
        if len(body) > 1 and body[0] in slash and body[1] in slash:
            place, tail = re.match(r"..([^/\\]*)(.*)", body, re.S).groups()
            if re.fullmatch(r"[A-Za-z][:|]", place):
                tail = "/" + place + tail
            elif place:
                found = parse_host(place, True)
                if found is None:
                    return None
                host = "" if found == "localhost" else found
        return Url(scheme, host=host, path=_path(tail.lstrip(slash) if tail else "", True, [], scheme), query=query_part, fragment=fragment_part)
    if not special and not body.startswith("//"):
        return Url(scheme, path=_path(body[1:], False, [], scheme), query=query_part, fragment=fragment_part)
    place_and_path = body.lstrip("/\\") if special else body[2:]
    end = re.search(r"[/\\]" if special else "/", place_and_path)
    place, tail = (place_and_path[: end.start()], place_and_path[end.start() :]) if end else (place_and_path, "")
    user, at, hostport = place.rpartition("@")
    name, _, secret = user.partition(":")
    pm = re.fullmatch(r"(.*?)(?::([0-9]*))?", hostport, re.S)
    if hostport.startswith("["):
        pm = re.fullmatch(r"(\[[^\]]*\])(?::([0-9]*))?", hostport)
        if pm is None:
            return None
    host_text, port_text = pm[1], pm[2]
    if special and not host_text or (at and not host_text) or ":" in host_text and not host_text.startswith("["):
        return None
    host = parse_host(host_text, special) if host_text else ""
    if host is None:
        return None
    port = int(port_text) if port_text else None
    if port is not None and port > 65535:
        return None
    port = None if port == SPECIAL.get(scheme, -1) else port
    path = _path(tail[1:], special, [], scheme) if tail else "/" if special else ""
    return Url(scheme, percent_encode(name, _USERINFO), percent_encode(secret, _USERINFO), host, port, path, query_part, fragment_part)


def resolve(link: str | None, base: str | None) -> str | None:
    """``link`` as an absolute address; null if it is none and there is no base for it."""
    found = parse_url(link, base)
    return None if found is None else str(found)


# Query parameters that trace a visit, and those that select content on sites that allow no others.
TRACKERS = re.compile(r"(?:utm_.*|fbclid|gclid|gclsrc|dclid|msclkid|yclid|twclid|igshid|mc_cid|mc_eid|_hsenc|_hsmi|wt_mc|ref_src|cmpid|ocid|spm|wickedid|vero_.*|oly_.*)", re.I)
CONTENT = frozenset("aid article_id artnr id itemid objectid p page page_id pagenum pid post postid product_id".split())
LANGUAGE = frozenset(("lang", "language"))
# Endings of files that are no pages.
FILES = re.compile(r"\.(?:jpe?g|png|gif|svg|webp|ico|css|js|mp[34]|avi|mov|webm|zip|gz|tar|rar|7z|exe|dmg|apk|pdf|docx?|xlsx?|pptx?|woff2?|ttf)$", re.I)


@dataclass(frozen=True)
class UrlCleaning:
    """What cleaning an address keeps.

    ``strict`` keeps only query parameters that select content; ``query_allow`` names the only ones kept, ``query_deny`` more
    that go. ``trailing_slash`` false takes it off, ``strip_fragment`` takes the fragment off. ``language`` rejects addresses that
    name another one. ``base_url`` resolves relative addresses; with ``external_only`` those of its own domain are rejected.
    """

    strict: bool = False
    trailing_slash: bool = True
    strip_fragment: bool = False
    language: str | None = None
    query_allow: frozenset[str] | None = None
    query_deny: frozenset[str] = field(default_factory=frozenset)
    base_url: str | None = None
    external_only: bool = False


def normalize_one(text: str | None, options: UrlCleaning = UrlCleaning()) -> str | None:
    """One spelling of an address: the standard's, trackers dropped, the rest of the query sorted."""
    url = parse_url(text, options.base_url)
    if url is None:
        return None
    path = re.sub(r"%([0-9A-Fa-f]{2})", lambda m: c if (c := chr(int(m[1], 16))).isascii() and (c.isalnum() or c in "-._~") else m[0].upper(), url.path)
    if not options.trailing_slash and len(path) > 1:
        path = path.rstrip("/") or "/"
    query = None
    if url.query:
        pairs = sorted(p for p in url.query.split("&") if p)
        name = lambda p: p.partition("=")[0].lower()
        kept = [p for p in pairs if not TRACKERS.fullmatch(name(p)) and name(p) not in options.query_deny]
        if options.query_allow is not None:
            kept = [p for p in kept if name(p) in options.query_allow]
        if options.strict:
            kept = [p for p in kept if name(p) in CONTENT | LANGUAGE]
        query = "&".join(kept) or None
    fragment = None if options.strip_fragment or not url.fragment or TRACKERS.match(url.fragment) else url.fragment
    return str(replace(url, path=path, query=query, fragment=fragment))


def clean_one(text: str | None, options: UrlCleaning = UrlCleaning()) -> str | None:
    """The normalized address of a web page; null for other schemes, files, other languages and, if wanted, the own site."""
    found = normalize_one((text or "").strip(), options)
    url = parse_url(found)
    if url is None or url.scheme not in ("http", "https") or not url.host or "." not in url.host or FILES.search(url.path):
        return None
    if options.language:
        said = [m[1].lower() for m in [re.match(r"/([a-z]{2})(?:[-_][A-Za-z]{2})?(?:/|$)", url.path)] if m]
        said += [p.partition("=")[2].lower()[:2] for p in (url.query or "").split("&") if p.partition("=")[0] in LANGUAGE]
        if said and options.language.lower() not in said:
            return None
    if options.external_only and (base := parse_url(options.base_url)) and base.host and (url.host == base.host or url.host.endswith("." + base.host.removeprefix("www."))):
        return None
    return found
