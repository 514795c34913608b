"""Bytes of pages to text: byte order mark, declared encoding, UTF-8 check, then the frequencies of pairs of letters.

Bytes that declare nothing and are no UTF-8 are read in every candidate encoding that gives them a meaning; the reading whose
pairs of letters are most usual wins. The model of single-byte encodings is counted from sample sentences; multi-byte
encodings of East Asia are judged by the share of their everyday signs, which their code tables keep together.
"""

from __future__ import annotations

import codecs
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_META = re.compile(rb"<meta[^>]*?charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)|<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9_:.-]+)", re.I)
# Labels that mean another encoding than Python's codec of the name.
_LABELS = {
    "iso-8859-1": "cp1252", "iso8859-1": "cp1252", "latin1": "cp1252", "l1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "iso-8859-9": "cp1254", "latin5": "cp1254", "iso-8859-11": "cp874", "tis-620": "cp874", "gb2312": "gb18030", "gbk": "gb18030", "x-gbk": "gb18030",
    "shift_jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "ms_kanji": "cp932", "ks_c_5601-1987": "cp949", "euc-kr": "cp949", "korean": "cp949", "utf-16": "utf-16-le", "unicode": "utf-16-le", "big5": "big5hkscs", "x-mac-cyrillic": "mac_cyrillic", "x-user-defined": "cp1252", "macintosh": "mac_roman",
}
# The standard's names of encodings, by Python's.
STANDARD = {
    "cp1250": "windows-1250", "cp1251": "windows-1251", "cp1252": "windows-1252", "cp1253": "windows-1253", "cp1254": "windows-1254", "cp1255": "windows-1255", "cp1256": "windows-1256", "cp1257": "windows-1257", "cp1258": "windows-1258", "cp874": "windows-874", "cp866": "ibm866",
    "cp932": "shift_jis", "cp949": "euc-kr", "big5hkscs": "big5", "euc_jp": "euc-jp", "iso2022_jp": "iso-2022-jp", "iso8859-2": "iso-8859-2", "iso8859-5": "iso-8859-5", "iso8859-7": "iso-8859-7", "iso8859-8": "iso-8859-8", "koi8-u": "koi8-u", "koi8-r": "koi8-r", "mac_roman": "macintosh",
    "mac-roman": "macintosh", "mac_cyrillic": "x-mac-cyrillic", "mac-cyrillic": "x-mac-cyrillic", "utf-16-le": "utf-16le", "utf-16-be": "utf-16be",
}
#: Candidates of one byte a sign, by the language that they are mostly used for.
SINGLE = {
    "cp1252": "de fr es pt it", "cp1250": "pl cs hu ro", "iso8859-2": "pl cs hu", "cp1251": "ru uk bg", "koi8-r": "ru", "koi8-u": "uk", "cp866": "ru", "iso8859-5": "ru", "mac_cyrillic": "ru", "cp1253": "el", "iso8859-7": "el", "cp1254": "tr", "cp1255": "he", "cp1256": "ar", "cp1257": "lt",
    "mac_roman": "de fr es", "cp437": "de fr", "cp850": "de fr es",
}
MULTIPLE = ("cp932", "euc_jp", "gb18030", "big5hkscs", "cp949")
# Encodings that the sites of a country use most, by its domain.
BY_TLD = {
    "ru": ("cp1251", "koi8-r"), "su": ("koi8-r",), "ua": ("cp1251", "koi8-u"), "bg": ("cp1251",), "by": ("cp1251",), "gr": ("cp1253", "iso8859-7"), "tr": ("cp1254",), "il": ("cp1255",), "pl": ("iso8859-2", "cp1250"), "cz": ("cp1250", "iso8859-2"), "hu": ("iso8859-2", "cp1250"), "ro": ("cp1250",),
    "jp": ("cp932", "euc_jp"), "cn": ("gb18030",), "tw": ("big5hkscs",), "hk": ("big5hkscs",), "kr": ("cp949",), "lt": ("cp1257",), "lv": ("cp1257",), "sa": ("cp1256",), "eg": ("cp1256",),
}
# The first article of the Universal Declaration of Human Rights, and everyday sentences, by language.
SAMPLES = {
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen. Für die Gäste gibt es heute schöne Äpfel, größere Brötchen und süßen Käse, natürlich über die Straße gegenüber.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. L’été dernier, le garçon était déjà arrivé à la forêt où le château brûlait, voilà ce que j’ai reçu.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. El niño comió después allí, mañana también habrá más canción y pingüinos según la estación, ¿verdad? ¡Qué día!",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Não há ninguém à porta, então as crianças estão lá e já são três horas da manhã; você também põe a mão.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Perché la città è più bella, così può già esserci qualità e libertà.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Dziś wieczorem będzie świeży chleb, żółty ser i gorąca zupa, więc proszę przyjść później ścieżką.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. Příští týden přijede žlutý vůz, který měl být už včera večer u řeky; děti běží ještě dál.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. Az idő múlásával a gyűrű és a fűtőtest nőtt, őszi szőlő és tűz.",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității. Această casă şi maşină sunt în oraşul mare, fără ţară.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Старый паром везёт хлеб через реку каждое утро, когда ещё темно; что это было, никто не знает. Сегодня хорошая погода, поэтому дети играют во дворе.",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства. Сьогодні її діти їдуть до міста, бо ще є час і є її книжки. Кожна людина повинна мати всі права і всі свободи, проголошені цією декларацією, незалежно від раси, кольору шкіри, статі, мови, релігії чи іншого становища. Ніхто не повинен бути в рабстві; у лісі біля річки ростуть дерева, які вже пожовтіли.",
    "bg": "Всички хора се раждат свободни и равни по достойнство и права. Те са надарени с разум и съвест и следва да се отнасят помежду си в дух на братство. Тази сутрин старият кораб ще тръгне към града, защото времето е хубаво.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Σήμερα το πρωί ο καιρός ήταν πολύ καλός.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Bugün çok güzel bir gün, çocuklar ağaçların altında şarkı söylüyor, ışık değişti.",
    "he": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה. היום מזג האוויר יפה מאוד והילדים משחקים בחוץ.",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. اليوم الطقس جميل جدا والأطفال يلعبون في الحديقة بعد المدرسة. لكل إنسان حق التمتع بجميع الحقوق والحريات المذكورة في هذا الإعلان دونما تمييز من أي نوع ولا سيما التمييز بسبب العنصر أو اللون أو الجنس أو اللغة أو الدين. كل فرد له حق في الحياة والحرية وفي الأمان على شخصه وكانت المدينة القديمة كبيرة.",
    "lt": "Visi žmonės gimsta laisvi ir lygūs savo orumu ir teisėmis. Jiems suteiktas protas ir sąžinė ir jie turi elgtis vienas kito atžvilgiu kaip broliai. Šiandien oras labai gražus, todėl vaikai žaidžia už namų, būtų dar geriau.",
}


# How much more, or less, usual an encoding is on the web than others of its languages.
USUAL = {"cp1252": 0.35, "cp1251": 0.1, "mac_roman": -0.5, "cp437": -0.3, "cp850": -0.2, "mac_cyrillic": -0.2, "iso8859-5": -0.1}


def canonical(label: str | None) -> str | None:
    """Python's name for a label as pages declare it; null if there is none."""
    name = (label or "").strip().lower()
    try:
        return codecs.lookup(_LABELS.get(name, name)).name if name else None
    except LookupError:
        return None


def standard_name(codec: str) -> str:
    return STANDARD.get(codec, codec)


#: Weight of a letter's own frequency against those of its pairs, and what a letter that a sample lacks counts.
OWN, UNSEEN = 6.0, 0.03


@cache
def _pairs(language: str) -> tuple[Counter, Counter, dict[str, float]]:
    """Pairs of letters of a language's sample, word ends as blanks; how often each letter begins one; frequencies of letters."""
    words = re.findall(r"[^\W\d_]+", SAMPLES[language].lower())
    pairs = Counter(p for w in words for p in zip(f" {w}", f"{w} ", strict=True))
    firsts, seconds = Counter(), Counter()
    for (x, y), n in pairs.items():
        firsts[x] += n
        seconds[y] += n
    total = sum(seconds.values())
    return pairs, firsts, {y: n / total for y, n in seconds.items()}


def _script(c: str) -> str:
    return unicodedata.name(c, "?").split()[0] if c > "\x7f" else "LATIN"


@cache
def _sign_cost(c: str) -> float:
    """What a sign beyond ASCII that is no letter says against a reading."""
    if c in " «»„“”‚‘’–—…•·°§©®№€£":
        return -1.0
    return -9.0 if unicodedata.category(c) in ("Cc", "Cn", "Co") else -5.0


def plausibility(text: str, language: str) -> float:
    """Mean logarithm of the likelihood of the pairs with a letter beyond ASCII; strange signs and changes of case count against it."""
    pairs, firsts, own = _pairs(language)
    total, n = 0.0, 0
    padded = f" {text} "
    for m in re.finditer("[^\x00-\x7f]", padded):
        i = m.start()
        c, before, after = padded[i], padded[i - 1], padded[i + 1]
        n += 1
        if not c.isalpha():
            total += _sign_cost(c)
            continue
        for a, b in ((before, c), (c, after)):
            if a.isalpha() and b.isalpha():
                if a.islower() and b.isupper() or _script(a) != _script(b):
                    total -= 4.0
                    continue
            x, y = (a.lower() if a.isalpha() else " "), (b.lower() if b.isalpha() else " ")
            total += math.log((pairs[x, y] + OWN * own.get(y, UNSEEN / 40)) / (firsts[x] + OWN)) / 2
    return total / n if n else -20.0


def _common(codec: str, data: bytes, text: str) -> float:
    """How everyday the signs of an East Asian reading are, from their places in the code tables."""
    wide = [c for c in text if c > "\x7f"]
    if not wide:
        return -20.0
    kana = sum("぀" <= c <= "ヿ" for c in wide)
    hangul = sum("가" <= c <= "힣" and len(c.encode("euc_kr", "ignore")) == 2 for c in wide)
    half = sum("｡" <= c <= "ﾟ" for c in wide)
    marks = sum(c in "、。，！？：；「」『』（）・“”‘’《》…—　" for c in wide)
    han = [c for c in wide if "一" <= c <= "鿿"]
    level: dict[str, tuple[str, int, int]] = {"cp932": ("euc_jp", 0xB0, 0xCF), "euc_jp": ("euc_jp", 0xB0, 0xCF), "gb18030": ("gb2312", 0xB0, 0xD7), "big5hkscs": ("big5", 0xA4, 0xC6), "cp949": ("euc_kr", 0xCA, 0xFD)}
    table, low, high = level[codec]

    def everyday(c: str) -> bool:
        try:
            raw = c.encode(table)
        except UnicodeEncodeError:
            return False
        return len(raw) == 2 and low <= raw[0] <= high

    good = marks + sum(map(everyday, han)) * (0.35 if codec == "cp949" else 1)
    if codec in ("cp932", "euc_jp"):
        good += kana - half
        if not kana:
            good *= 0.6
    elif codec == "cp949":
        good += hangul
    else:
        good -= kana * 0.5 + hangul
    mixed = len(re.findall("(?<=[A-Za-z])[^\x00-\x7f]|[^\x00-\x7f](?=[A-Za-z])", text))  # a sign that stands in a Latin word
    return -8.0 + 6.5 * max(0.0, good - 2 * mixed) / len(wide)


@dataclass(frozen=True)
class Detection:
    """What detection may answer: a least confidence, a declared label, encodings allowed or excluded, the site's top-level domain."""

    threshold: float = 0.0
    declared: str | None = None
    language: str | None = None
    allowed: frozenset[str] | None = None
    excluded: frozenset[str] = field(default_factory=frozenset)
    tld: str | None = None


@dataclass(frozen=True)
class Match:
    """One reading: Python's codec, confidence, language where the frequencies tell it, and whether a mark says so."""

    codec: str
    confidence: float
    language: str | None = None
    bom: bool = False

    @property
    def encoding(self) -> str:
        """The standard's name."""
        return standard_name(self.codec)


def _statistics(data: bytes, o: Detection) -> list[Match]:
    hints = BY_TLD.get((o.tld or "").lower().rpartition(".")[2], ())
    scored = []
    for codec, languages in SINGLE.items():
        try:
            text = data.decode(codec)
        except UnicodeDecodeError:
            text = data.decode(codec, "replace")
            if text.count("�") * 50 > sum(b > 127 for b in data):
                continue
        for language in languages.split():
            if o.language is None or language == o.language:
                scored.append((plausibility(text, language) + (0.4 if codec in hints else 0.0) + USUAL.get(codec, 0.0), codec, language))
    for codec in MULTIPLE:
        try:
            text = data.decode(codec)
        except UnicodeDecodeError as error:
            if error.start < len(data) - 3:  # a sign may be cut off at the end
                continue
            text = data[: error.start].decode(codec)
        scored.append((_common(codec, data, text) + (0.4 if codec in hints else 0.0), codec, {"cp932": "ja", "euc_jp": "ja", "gb18030": "zh", "big5hkscs": "zh", "cp949": "ko"}[codec]))
    best: dict[str, tuple[float, str]] = {}
    for score, codec, language in sorted(scored):
        best[codec] = (score, language)
    ranked = sorted(best.items(), key=lambda x: -x[1][0])
    weights = [math.exp(2 * (s - ranked[0][1][0])) for _, (s, _) in ranked]
    return [Match(codec, round(0.95 * w / sum(weights), 4), language) for (codec, (_, language)), w in zip(ranked, weights, strict=True)]


def detect_all(data: bytes, options: Detection = Detection()) -> list[Match]:
    """Every reading that the options allow, the likeliest first; never empty."""
    o = options
    fits = lambda m: (o.allowed is None or m.codec in o.allowed or m.encoding in o.allowed) and m.codec not in o.excluded and m.encoding not in o.excluded and m.confidence >= o.threshold

    def found() -> Iterator[Match]:
        for mark, name in _MARKS:
            if data.startswith(mark):
                yield Match(name, 1.0, bom=True)
                return
        if name := canonical(o.declared):
            yield Match(name, 0.95)
        if (m := _META.search(data[:1024])) and (name := canonical((m[1] or m[2]).decode("ascii", "ignore"))):
            yield Match("utf-8" if name.startswith("utf-16") else name, 0.9)
        if re.search(rb"\x1b(?:\$[@B]|\(J)", data) and data.isascii():
            yield Match("iso2022_jp", 0.9, "ja")
        try:
            data.decode("utf-8")
            yield Match("utf-8", 0.9 if not data.isascii() else 0.5)
        except UnicodeDecodeError as error:
            if error.reason == "unexpected end of data" and error.start >= len(data) - 3 and any(b > 127 for b in data[: error.start]):
                yield Match("utf-8", 0.8)  # cut off within a sign
            yield from _statistics(data, o)

    out: dict[str, Match] = {}
    for m in found():
        if fits(m):
            out.setdefault(m.codec, m)
    return list(out.values()) or [Match("cp1252", 0.0)]


def detect(data: bytes, declared: str | None = None, options: Detection | None = None) -> tuple[str, float]:
    """Encoding and confidence."""
    o = options or Detection()
    m = detect_all(data, o if declared is None else Detection(o.threshold, declared, o.language, o.allowed, o.excluded, o.tld))[0]
    return m.codec, m.confidence


class Detector:
    """Detection of bytes that come in pieces: all of them count, the answer is there at once when a mark says it."""

    def __init__(self, options: Detection = Detection()) -> None:
        self.options = options
        self.reset()

    def reset(self) -> None:
        self.parts: list[bytes] = []
        self.done, self.result = False, None

    def feed(self, data: bytes) -> None:
        if not self.done:
            self.parts.append(data)
            head = b"".join(self.parts) if sum(map(len, self.parts)) < 8 else b"".join(self.parts)[:8]
            if any(head.startswith(mark) for mark, _ in _MARKS) and len(head) >= 4:
                self.close()

    def close(self) -> Match:
        if self.result is None:
            self.result = detect_all(b"".join(self.parts), self.options)[0]
            self.done = True
        return self.result


def decode(df: DataFrame, content: str, key: str = "page_id", options: Detection | None = None, tld: str | None = None) -> DataFrame:
    """``key``, ``html``, ``encoding`` and ``confidence`` for a binary column; null bytes give null text.

    ``tld`` names a column with the host or top-level domain of each row, a hint for what declares nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = options or Detection()
        for batch in batches:
            texts, found, sure = [], [], []
            hints: Iterable = batch.column(2).to_pylist() if tld else [o.tld] * batch.num_rows
            for data, hint in zip(batch.column(1).to_pylist(), hints, strict=True):
                name, confidence = detect(data, None, Detection(o.threshold, o.declared, o.language, o.allowed, o.excluded, hint)) if data is not None else (None, None)
                texts.append(data.decode(name, "replace").removeprefix("﻿") if data is not None else None)
                found.append(name)
                sure.append(confidence)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(found, pa.string()), pa.array(sure, pa.float64())], names=[key, "html", "encoding", "confidence"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), content, *([tld] if tld else [])).mapInArrow(run, f"{key} {kind}, html string, encoding string, confidence double")
