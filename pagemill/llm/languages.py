"""Languages of documents and of their passages, with confidence.

Per language an interpolated Kneser-Ney model over the characters of words (with marks for a word's beginning and end),
trained on a table of labelled sentences. All models live in one set of sorted hash arrays: a sorted array of n-gram
hashes with a row of probabilities, one per language, and a sorted array of context hashes with the interpolation weights.
A passage gets the language with the lowest cross-entropy per character; if even that is beyond a limit calibrated by
cross-validation, none. Because no n-gram spans a blank, a word has one score per language, which is kept, so the work per
text is adding up known rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.garbled import _CYRILLIC, READ_AS, undo, undo_utf8
from pagemill.llm.markup import _SIGNS, clean, families

ORDER = 5
#: Labelled sentences used for training, at most, per language.
SAMPLE = 5_000
#: Labelled rows of the data itself that training may use besides, at most.
LABELLED = 6_000
#: Words whose scores a worker keeps; beyond it the table starts afresh.
KEPT = 300_000
#: A sentence less sure than this takes the language most sentences of its text have, if that is a close second.
SURE = 0.9
#: Characters per nat that turn the summed evidence of a passage into a confidence; evidence of characters is not independent.
TEMPER = 3.0
# ISO 639-2 codes, both forms, of languages with a two-letter code that occur in feeds.
THREE = {
    "ger": "de", "deu": "de", "eng": "en", "spa": "es", "fre": "fr", "fra": "fr", "ita": "it", "pol": "pl", "por": "pt",
    "rus": "ru", "dut": "nl", "nld": "nl", "cze": "cs", "ces": "cs", "swe": "sv", "dan": "da", "nor": "no", "fin": "fi",
    "ukr": "uk", "tur": "tr", "rum": "ro", "ron": "ro", "hun": "hu", "gre": "el", "ell": "el", "jpn": "ja", "chi": "zh",
    "zho": "zh", "kor": "ko", "ara": "ar", "heb": "he", "cat": "ca", "hrv": "hr", "srp": "sr", "bul": "bg", "slk": "sk",
}

_WORD = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"(?<=[.!?…])[”\"»’')\]]*\s+(?=[^a-zß-öø-ÿа-яё\s])|\n+|\t+")
_END = re.compile(r"[.!?…][”\"»’')\]]*\s*\Z")
_CODE = re.compile(r"```.*?```|\$\$.*?\$\$|\$[^$\n]*\$", re.S)
_LETTERS = "äöüßÄÖÜáéíóúñüÁÉÍÓÚÑÜàâæçèéêëîïôœùûÿÀÂÇÈÉÊËÎÏÔŒÙÛìòÌÒąćęłńóśźżĄĆĘŁŃÓŚŹŻãõâêôÃÕ"
_STRANGE = re.compile(rf"[^\x00-\x7F{_LETTERS}А-яЁё“”„‘’«»–—…¿¡ §°€£·]|[ Ã]|Â|Ð|Ñ|[Рр][Ѐ-Џ]|В[«»°]")


def language_code(label: Column) -> Column:
    """Two-letter code of a declared language (BCP 47 tag or three-letter code, any case); null if it says nothing."""
    first = F.lower(F.regexp_extract(F.trim(label), "^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    known = F.create_map(*[F.lit(x) for kv in THREE.items() for x in kv])
    code = F.coalesce(F.try_element_at(known, first), first)
    return F.when(code.isin("", "und", "mul", "mis", "zxx"), None).otherwise(code)


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _hashes(codes: np.ndarray) -> np.ndarray:
    """One hash per row of a matrix of code points, by multiplication and mixing in 64 bits."""
    h = np.full(len(codes), 0x9E3779B97F4A7C15, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for column in codes.T:
            h = (h ^ column.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(29)
    return h


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the marked words one after the other, and each character's place in its word."""
    marked = [f"\x02{w}\x03" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32)
    lengths = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return codes, np.arange(len(codes)) - np.repeat(starts, lengths)


@dataclass
class Models:
    """Sorted hash arrays of all languages; a language's probability is NaN where it has not seen the n-gram."""

    languages: list[str]
    grams: list[np.ndarray] = field(default_factory=list)  # by order: sorted hashes
    probabilities: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    floor: float = 1e-4
    limit: float = 5.0

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-probability of each word by language, and its number of characters with the end mark."""
        codes, place = _grams(words)
        p = np.full((len(codes), len(self.languages)), self.floor)
        for n in range(1, ORDER + 1):
            at = np.flatnonzero(place >= max(1, n - 1))
            window = np.stack([codes[at - k] for k in range(n - 1, -1, -1)], axis=1)
            gram, context = _hashes(window), _hashes(window[:, :-1])
            seen = _look(self.grams[n - 1], self.probabilities[n - 1], gram, np.nan)
            weight = _look(self.contexts[n - 1], self.weights[n - 1], context, 1.0)
            p[at] = np.where(np.isnan(seen), weight * p[at], seen)
        log = np.log(p)
        log[place == 0] = 0.0
        starts = np.flatnonzero(place == 0)
        return np.add.reduceat(log, starts, axis=0), np.diff(np.append(starts, len(codes))) - 1


def _look(keys: np.ndarray, rows: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], rows[at], missing)


def train(samples: list[tuple[str, str]]) -> Models:
    """Models from (text, language) pairs; a language without text is left out."""
    by: dict[str, list[str]] = defaultdict(list)
    for text, lang in samples:
        by[lang] += words_of(unicodedata.normalize("NFC", text))
    languages = sorted(x for x in by if by[x])
    models = Models(languages)
    alphabet = {c for words in by.values() for w in words for c in w}
    models.floor = 1.0 / (len(alphabet) + 200)
    probability: list[dict[str, dict[int, float]]] = [defaultdict(dict) for _ in range(ORDER)]
    weight: list[dict[str, dict[int, float]]] = [defaultdict(dict) for _ in range(ORDER)]
    for k, lang in enumerate(languages):
        _kneser_ney(by[lang], k, probability, weight, models.floor)
    for n in range(ORDER):
        for table, keys, rows, missing in ((probability[n], models.grams, models.probabilities, np.nan), (weight[n], models.contexts, models.weights, 1.0)):
            texts = list(table)
            codes = np.array([[ord(c) for c in t] for t in texts], dtype=np.uint32).reshape(len(texts), -1)
            hashed = _hashes(codes)
            order = np.argsort(hashed)
            values = np.full((len(texts), len(languages)), missing)
            for i, t in enumerate(texts):
                for k, v in table[t].items():
                    values[i, k] = v
            keys.append(hashed[order])
            rows.append(values[order])
    return models


def _kneser_ney(words: list[str], k: int, probability: list, weight: list, floor: float) -> None:
    """Interpolated probabilities of one language: raw counts at the highest order, continuation counts below."""
    raw: list[Counter] = [Counter() for _ in range(ORDER)]
    for word, times in Counter(words).items():
        w = f"\x02{word}\x03"
        for i in range(1, len(w)):
            for n in range(1, ORDER + 1):
                if i - n + 1 >= 0:
                    raw[n - 1][w[i - n + 1 : i + 1]] += times
    lower: dict[str, float] = {}
    for n in range(1, ORDER + 1):
        if n == ORDER:
            counts = raw[n - 1]
        else:
            counts = Counter(g[1:] for g in raw[n])
            for gram, times in raw[n - 1].items():  # at a word's beginning nothing can stand before it
                if gram[0] == "\x02":
                    counts[gram] = times
        ones, twos = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
        discount = min(0.95, max(0.1, ones / (ones + 2 * twos) if ones else 0.5))
        total: Counter = Counter()
        kinds: Counter = Counter()
        for gram, times in counts.items():
            total[gram[:-1]] += times
            kinds[gram[:-1]] += 1
        gamma = {c: discount * kinds[c] / total[c] for c in total}
        current = {}
        for gram, times in counts.items():
            rest = lower.get(gram[1:], floor) if n > 1 else floor
            current[gram] = max(times - discount, 0) / total[gram[:-1]] + gamma[gram[:-1]] * rest
            probability[n - 1][gram][k] = current[gram]
        for context, g in gamma.items():
            weight[n - 1][context][k] = g
        lower = current


def fit(samples: list[tuple[str, str]], labelled: list[tuple[str, str]] = (), folds: int = 5) -> Models:
    """Models from all samples, with the rejection limit calibrated on held-out folds.

    ``labelled`` are (text, language) pairs whose labels may be wrong; those sentences of theirs that the models of the
    samples alone put in the declared language are added to the samples.
    """
    entropies = []
    for f in range(folds):
        models = train([s for i, s in enumerate(samples) if i % folds != f])
        reader = Reader(models)
        held = [t for i, (t, _) in enumerate(samples) if i % folds == f and words_of(t)]
        if held and models.languages:
            entropies += list(reader.entropies(held)[0].min(axis=1))
    models = train(samples)
    if entropies:
        models.limit = float(np.quantile(entropies, 0.99) * 1.25)
    if labelled and models.languages:
        found = read_batch(Reader(models), [t for t, _ in labelled], [True] * len(labelled))
        agreed = [
            (text, lang)
            for (_, label), start, end in zip(labelled, found.offsets[:-1], found.offsets[1:], strict=True)
            for text, lang, sure, whole in zip(found.texts[start:end], found.languages[start:end], found.confidence[start:end], found.sentence[start:end], strict=True)
            if whole and lang == label and sure >= 0.5
        ]
        more = train([*samples, *agreed])
        more.limit = models.limit
        return more
    return models


class Reader:
    """Applies the models to texts, keeping the scores of words."""

    def __init__(self, models: Models) -> None:
        self.models = models
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(models.languages)))
        self.lengths = np.zeros(0, dtype=np.int64)

    def learn(self, words: set[str]) -> None:
        new = sorted(w for w in words if w not in self.known)
        if len(self.known) + len(new) > KEPT:
            self.known, new = {}, sorted(words)
            self.rows, self.lengths = self.rows[:0], self.lengths[:0]
        if new:
            rows, lengths = self.models.scores(new)
            self.known |= {w: len(self.rows) + i for i, w in enumerate(new)}
            self.rows, self.lengths = np.concatenate([self.rows, rows]), np.concatenate([self.lengths, lengths])

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character by language, characters and words; texts without words: infinity, 0, 0."""
        split = [words_of(t) for t in texts]
        self.learn({w for words in split for w in words})
        out = np.full((len(texts), len(self.models.languages)), np.inf)
        counts = np.fromiter(map(len, split), dtype=np.int64, count=len(texts))
        sizes = np.zeros(len(texts), dtype=np.int64)
        if len(full := np.flatnonzero(counts)):
            known = self.known
            ids = np.fromiter((known[w] for words in split for w in words), dtype=np.int64)
            starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
            sizes[full] = np.add.reduceat(self.lengths[ids], starts)
            out[full] = -np.add.reduceat(self.rows[ids], starts, axis=0) / sizes[full][:, None]
        return out, sizes, counts


@lru_cache(200_000)
def _restored(token: str) -> str:
    """The token with a wrong decoding undone, if reading it back as UTF-8 proves one."""
    own = sum(c > "\x7f" for c in token)
    (back, covered), read_as = max(((undo_utf8(token, r), r) for r in READ_AS), key=lambda x: x[0][1])
    return back if covered and (read_as not in _CYRILLIC or (covered == own and own >= 4)) else token


# Single-byte misreadings tried on a sentence that no language explains.
_CHAINS = [("cp1251", "cp866"), ("cp1251", "koi8-r"), ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("cp437", "cp866"), ("cp850", "cp866"), ("mac_roman", "cp1251"), ("cp866", "cp1251"), ("koi8-r", "cp1251"), ("cp437", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "iso8859-2"), ("cp1252", "mac_roman")]


def plain_sentences(text: str, suspect: bool) -> list[str]:
    """The passages of a text: its sentences and, between them, what ends without a sentence mark."""
    if suspect and (found := families(text)):
        text = _CODE.sub(" ", clean(text, found))
    if not text.isascii():
        if _STRANGE.search(text):
            text = re.sub(r"[^ \t\r\n]+", lambda m: _restored(m[0]) if not m[0].isascii() else m[0], text)
        text = unicodedata.normalize("NFC", text)
    return [s for s in map(str.strip, _SPLIT.split(text)) if s]


@dataclass
class Reading:
    """Passages of a batch of texts, one after the other; ``offsets`` says where each text's begin."""

    offsets: np.ndarray
    texts: list[str]
    languages: list[str]
    confidence: np.ndarray
    sentence: np.ndarray

    def array(self) -> pa.Array:
        numbers = np.arange(1, len(self.texts) + 1) - np.repeat(self.offsets[:-1], np.diff(self.offsets))
        fields = [pa.array(numbers, pa.int32()), pa.array(self.texts, pa.string()), pa.array(self.languages, pa.string())]
        fields += [pa.array(self.confidence, pa.float64()), pa.array(self.sentence, pa.bool_())]
        struct = pa.StructArray.from_arrays(fields, names=["no", "text", "lang", "confidence", "sentence"])
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), struct)


PASSAGES = "array<struct<no:int,text:string,lang:string,confidence:double,sentence:boolean>>"


def read_batch(reader: Reader, texts: list[str | None], suspects: list[bool | None]) -> Reading:
    """Language and confidence of every passage of every text.

    A sentence ends with a sentence mark and has at least three words; headings, names and numbers do not.
    """
    names, limit = reader.models.languages, reader.models.limit
    split = [plain_sentences(t, bool(s)) if t else [] for t, s in zip(texts, suspects, strict=True)]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in split])]).astype(np.int64)
    flat = [s for part in split for s in part]
    if not flat or not names:
        return Reading(offsets, flat, ["und"] * len(flat), np.zeros(len(flat)), np.zeros(len(flat), dtype=bool))
    entropy, sizes, words = reader.entropies(flat)
    for i in np.flatnonzero((entropy.min(axis=1) > limit) & (sizes > 0)):
        others = [] if flat[i].isascii() else [b for c in _CHAINS if (b := undo(flat[i], *c)) is not None]
        if others:
            tried, lengths, _ = reader.entropies(others)
            best = int(tried.min(axis=1).argmin())
            if tried[best].min() < entropy[i].min():
                entropy[i], sizes[i] = tried[best], lengths[best]
    least, best = entropy.min(axis=1), entropy.argmin(axis=1)
    known = (sizes > 0) & (least <= limit)
    gap = np.where(known[:, None], entropy - np.where(known, least, 0.0)[:, None], 0.0)
    odds = np.exp(-gap * sizes[:, None] / TEMPER)
    confidence = np.where(known, 1.0 / odds.sum(axis=1), 0.0)
    sentence = np.fromiter((bool(_END.search(t)) for t in flat), dtype=bool, count=len(flat)) & (words >= 3)
    # A doubtful sentence goes with the language most of its text is in, where that is a close second.
    for i in np.flatnonzero(known & sentence & (confidence < SURE)):
        row = np.searchsorted(offsets, i, side="right") - 1
        own = np.arange(offsets[row], offsets[row + 1])
        own = own[known[own] & sentence[own]]
        weight = np.bincount(best[own], weights=sizes[own] * confidence[own], minlength=len(names))
        main = int(weight.argmax())
        if main != best[i] and gap[i, main] * sizes[i] < 2 * TEMPER:
            best[i] = main
    return Reading(offsets, flat, [names[b] if k else "und" for b, k in zip(best, known, strict=True)], confidence.round(6), sentence)


def passages(df: DataFrame, text: str, samples: DataFrame, label: str | None = None) -> DataFrame:
    """Add ``passages``, an array of (no, text, lang, confidence, sentence), for the column ``text``.

    ``samples`` has labelled sentences (``text``, ``lang``), of which at most ``SAMPLE`` per language are used. With
    ``label``, the column of declared languages, at most ``LABELLED`` rows of ``df`` itself, chosen by a hash, add those of
    their sentences whose label agrees with the models of the samples. Null and
    empty texts have no passages. Passages in no known language are ``und`` with confidence 0. Other columns stay; an
    input column named ``passages`` is replaced.
    """
    bounded = (
        samples.filter("text IS NOT NULL AND lang IS NOT NULL")
        .select("text", language_code(F.col("lang")).alias("lang"))
        .withColumn("_n", F.expr("row_number() OVER (PARTITION BY lang ORDER BY xxhash64(text), text)"))
        .filter(F.col("_n") <= SAMPLE)
    )
    labelled = []
    if label:
        code = df.select(F.col(text).alias("text"), language_code(F.col(label)).alias("lang")).filter("text <> '' AND lang IS NOT NULL")
        # A hash bounds what the tasks send before the exact cut, so it does not grow with their number.
        share = min(1.0, 4 * LABELLED / max(1, df.count()))
        drawn = code.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20))).dropDuplicates()
        labelled = [tuple(r) for r in drawn.orderBy(F.xxhash64("text"), "text", "lang").limit(LABELLED).collect()]
    models = df.sparkSession.sparkContext.broadcast(fit(sorted((r["text"], r["lang"]) for r in bounded.collect()), labelled))
    columns = [c for c in df.columns if c != "passages"]
    source = df.select(*[F.col(f"`{c}`") for c in columns], F.col(text).rlike(_SIGNS).alias("_suspect"))
    at = columns.index(text)
    schema = source.drop("_suspect").withColumn("passages", F.lit(None).cast(PASSAGES)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(models.value)
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                rows = batch.slice(part, 2000)
                found = read_batch(reader, rows.column(at).to_pylist(), rows.column(len(columns)).to_pylist())
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(columns)], found.array()], names=schema.names)

    return source.mapInArrow(run, schema)


def mislabelled(found: DataFrame, label: str) -> DataFrame:
    """Rows of :func:`passages` whose label is missing or wrong or whose sentences have several languages.

    Adds ``language``, one row for each language with a complete sentence; rows without a complete sentence are left out.
    """
    languages = F.array_distinct(F.transform(F.filter("passages", lambda p: p["sentence"] & (p["lang"] != "und")), lambda p: p["lang"]))
    rows = found.withColumn("_languages", languages).withColumn("_label", language_code(F.col(label)))
    wrong = F.col("_label").isNull() | (F.size("_languages") > 1) | ~F.array_contains("_languages", F.col("_label"))
    return rows.filter((F.size("_languages") > 0) & wrong).withColumn("language", F.explode("_languages")).drop("_languages", "_label")


def documents_languages(found: DataFrame) -> DataFrame:
    """Add ``language`` and ``confidence`` of the whole text: the language with the most text in sure passages."""
    weight = F.aggregate(
        F.filter("passages", lambda p: p["lang"] != "und"),
        F.create_map().cast("map<string,double>"),
        lambda acc, p: F.map_concat(F.map_filter(acc, lambda k, v: k != p["lang"]), F.create_map(p["lang"], F.coalesce(F.try_element_at(acc, p["lang"]), F.lit(0.0)) + F.length(p["text"]) * p["confidence"])),
    )
    entries = F.transform(F.map_entries(weight), lambda e: F.struct(e["value"].alias("w"), e["key"].alias("lang")))
    best, total = F.array_max(entries), F.aggregate(F.transform("passages", lambda p: F.length(p["text"])), F.lit(0.0), lambda a, n: a + n)
    return found.withColumn("language", F.coalesce(best["lang"], F.lit("und"))).withColumn("confidence", F.round(F.coalesce(best["w"] / total, F.lit(0.0)), 6))
