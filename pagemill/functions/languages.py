"""Language of a text by the rank order of its character trigrams (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranks of a profile, trigrams of a text, and labelled rows that profiles are made from, at most.
RANKS, TRIGRAMS, ROWS = 300, 600, 20_000


def trigrams(text: str) -> Counter:
    words = re.findall(r"[^\W\d_]+", unicodedata.normalize("NFC", text).lower())
    return Counter(w[i : i + 3] for w in (f" {x} " for x in words) for i in range(len(w) - 2))


def profiles(samples: DataFrame) -> dict[str, dict[str, int]]:
    """Ranks of the most frequent trigrams by language, from labelled rows (``text``, ``lang``), at most ``ROWS``."""
    rows = samples.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").orderBy(F.xxhash64("text"), "text", "lang").limit(ROWS).collect()
    counts: dict[str, Counter] = {}
    for r in rows:
        counts.setdefault(r["lang"], Counter()).update(trigrams(r["text"]))
    return {lang: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:RANKS])} for lang, c in counts.items() if c}


def rank_distance(text: str, known: dict[str, dict[str, int]]) -> list[tuple[float, str]]:
    """Mean displacement of the text's trigrams in each profile, nearest first; empty without letters."""
    found = sorted(trigrams(text).items(), key=lambda x: (-x[1], x[0]))[:TRIGRAMS]
    if not found:
        return []
    return sorted((sum(abs(i - p[g]) if g in p else RANKS for i, (g, _) in enumerate(found)) / len(found), lang) for lang, p in known.items())


@dataclass(frozen=True)
class LanguageDetection:
    """Answers below ``threshold`` are null; only ``allowed`` languages count, ``excluded`` ones do not."""

    threshold: float = 0.0
    allowed: frozenset[str] | None = None
    excluded: frozenset[str] = frozenset()


# English names of languages by their codes.
NAMES = {
    "ar": "Arabic", "bg": "Bulgarian", "cs": "Czech", "da": "Danish", "de": "German", "el": "Greek", "en": "English", "es": "Spanish", "fi": "Finnish", "fr": "French", "he": "Hebrew", "hu": "Hungarian", "it": "Italian", "ja": "Japanese", "ko": "Korean", "nl": "Dutch", "no": "Norwegian",
    "pl": "Polish", "pt": "Portuguese", "ro": "Romanian", "ru": "Russian", "sv": "Swedish", "tr": "Turkish", "uk": "Ukrainian", "zh": "Chinese",
}


def script_of(text: str) -> str | None:
    """The writing system of most letters."""
    counts = Counter(unicodedata.name(c, "?").split()[0].title() for c in text if c.isalpha())
    return max(counts, key=lambda k: (counts[k], k)).replace("Cjk", "Han") if counts else None


def detect_language(df: DataFrame, text: str, known: dict[str, dict[str, int]], options: LanguageDetection = LanguageDetection()) -> DataFrame:
    """Add ``language`` and ``confidence``; both null for texts without letters. Other columns stay."""
    known = {k: v for k, v in known.items() if (options.allowed is None or k in options.allowed) and k not in options.excluded}
    columns = [c for c in df.columns if c not in ("language", "confidence")]
    at = columns.index(text)
    schema = T.StructType([*[df.schema[c] for c in columns], T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sure = [], []
            for value in batch.column(at).to_pylist():
                ranked = rank_distance(value or "", known)
                confidence = round(1 - ranked[0][0] / max(ranked[1][0], 1e-9), 6) if len(ranked) > 1 else 1.0 if ranked else None
                kept = confidence is not None and confidence >= options.threshold
                names.append(ranked[0][1] if kept else None)
                sure.append(confidence if kept else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)
