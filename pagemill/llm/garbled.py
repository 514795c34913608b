"""Text decoded with the wrong character encoding: learning the mistakes from near-twins, finding and undoing them.

1. Near-twins: sentences that are equal once stripped of non-ASCII characters, though not as they stand. The most frequent
   spelling of such a group is taken as clean, the others are paired with it. Sentences with hardly an ASCII letter, as Russian
   ones, are paired by the lengths of their words instead.
2. Alignment: the ASCII characters of a pair coincide, so the runs of other characters between them correspond. A
   transformation (bytes of one encoding read as another) is learned if it turns clean runs into their counterparts.
3. Learned transformations, and no others, are applied to every token of the remaining records. Reading back UTF-8 is its own
   proof; a change between single-byte encodings counts only if it turns a rare token into one that the corpus knows well.
4. Tokens with lost characters (the replacement sign) take the best-known token with the same ASCII skeleton.

5. A sentence as a whole: the gains of its tokens under one learned transformation are added up, so several words that the
   corpus hardly knows count together, and words it does not know at all go along with the others.

Counts are of distinct texts. Copies of a text speak for a spelling as right ``RATIO`` times at most, and never for the
spelling that is to be repaired. One pass over the distinct texts writes their tokens and sentences (``scan``); all else are
aggregations and joins of that table. Only one row per transformation reaches the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.session import materialize

# Encodings that text was read as by mistake, and encodings that its bytes were in.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "iso8859-2", "iso8859-5", "mac_cyrillic", "cp1254", "iso8859-15")
BYTES_OF = ("utf-8", "cp1252", "cp1250", "cp1251", "koi8-r", "cp866", "iso8859-2", "iso8859-5", "mac_roman", "cp850", "cp437")
#: Aligned characters, summed over twin pairs, that must speak for a change between single-byte encodings.
VOTES = 3
#: A repaired token must be this frequent, and this many times as frequent as the token as it stands.
KNOWN, RATIO = 3, 4
#: A sentence is repaired if the logarithms of its tokens' ratios add up to this; HALF is added to both counts.
SCORE, HALF = 2.0, 0.5

_OTHER = r"[^\x00-\x7F]"
_EDGES = "“”„‟‘’‚«»‹›\"'()[]{}<>.,;:!?…—–-*/"


@cache
def _tables(codec: str) -> tuple[dict[int, str], dict[str, int]]:
    """Characters by byte, and bytes by character; undefined bytes stand for themselves."""
    to = {b: bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256)}
    return to, {c: b for b, c in reversed(to.items())}


def _bytes(text: str, codec: str) -> bytes | None:
    table = _tables(codec)[1]
    try:
        return bytes([table[c] if c > "\x7f" else ord(c) for c in text])
    except KeyError:
        return None


def undo(text: str, read_as: str, bytes_of: str) -> str | None:
    """What ``text`` was before its ``bytes_of`` bytes were read as ``read_as``; null if that can't be."""
    raw = _bytes(text, read_as)
    if raw is None:
        return None
    if bytes_of == "utf-8":
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
    to = _tables(bytes_of)[0]
    return "".join(to[b] for b in raw)


_RUNS = re.compile(r"[^\x00-\x7F]+")
_SPLIT = re.compile(r"(?<=[.!?…]) +|[\r\n]+")
_WORDS = re.compile(r"[^ \t\r\n]+")
_DIGITS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[A-Za-z0-9]")
_FOUR_WORDS = re.compile(r"(?: [^ ]+){3}")
# Scripts and signs that reading back may lead to (Latin, Cyrillic, punctuation, currency, symbols, emoji).
_PLAIN = re.compile("[\x00-\x7F\u00a0-\u017f\u0192\u0218-\u021b\u02c6-\u02dc\u0400-\u045f\u0490\u0491\u2010-\u2044\u20a0-\u20bf\u2100-\u22ff\u2500-\u27bf\ufb01\ufb02\ufeff\U0001f300-\U0001faff]*")
# Encodings whose upper half is letters of running text, so that a short run may read back by chance.
_CYRILLIC = frozenset({"cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic"})


def _mark(read_as: str) -> str:
    """The byte order mark of UTF-8 under a misreading."""
    return "".join(_tables(read_as)[0][b] for b in b"\xef\xbb\xbf")


def _back(part: str, read_as: str) -> str | None:
    back = undo(part, read_as, "utf-8") if len(part) > 1 else None
    if back is None or len(back) >= len(part):
        return None
    if _PLAIN.fullmatch(back):
        return back
    # Control characters are no text, but what a text garbled more than once goes through.
    return _back(back, read_as) if any("\x80" <= c <= "\x9f" for c in back) else None


def undo_utf8(text: str, read_as: str) -> tuple[str, int]:
    """Read the runs of non-ASCII characters back as UTF-8 until nothing changes; also how many characters the first reading explains.

    Marks before or after the run that were right are left as they are; so is a cut-off character at its end.
    """

    def run(m: re.Match) -> str:
        nonlocal covered
        part = m[0]
        before, after = len(part) - len(part.lstrip(_EDGES)), len(part) - len(part.rstrip(_EDGES))
        for lead in sorted({0, min(1, before), min(2, before), before}):
            for cut in sorted({0, 1, 2, 3, after}):
                body = part[lead : len(part) - cut]
                if (back := _back(body, read_as)) is not None:
                    covered += len(body)
                    return part[:lead] + back + part[len(part) - cut :]
        return part

    covered = 0
    out = _RUNS.sub(run, text)
    first = covered
    while covered:  # each reading makes the text shorter
        covered = 0
        out = _RUNS.sub(run, out)
    return out, first


def _chains() -> list[tuple[str, str]]:
    return [(a, b) for a in READ_AS for b in BYTES_OF if a != b]


def _explains(clean: str, garbled: str, chain: tuple[str, str]) -> bool:
    """Whether the chain turns the clean run into the garbled one and does change it."""
    read_as, bytes_of = chain
    raw = clean.encode("utf-8") if bytes_of == "utf-8" else _bytes(clean, bytes_of)
    return raw is not None and clean != garbled and "".join(_tables(read_as)[0][b] for b in raw) == garbled


def core(token: str) -> str:
    """A token without digits' values, letter case and the marks around it; marks alone stay as they are."""
    plain = _DIGITS.sub("0", token.lower())
    return plain.strip(_EDGES) or plain


def skeletons(sentence: str) -> list[tuple[str, bool, bool]]:
    """What a sentence is grouped by, with whether it may stand in that group as clean and as garbled.

    The sentence without its non-ASCII characters, if three ASCII letters or digits are left. Otherwise, for four words or
    more, the lengths of the runs: in characters, which a change between single-byte encodings keeps, and, as the clean one,
    in bytes of UTF-8, which a reading of UTF-8 as a single-byte encoding makes characters of.
    """
    stripped = _RUNS.sub("", sentence)
    if len(_LETTERS.findall(stripped)) >= 3:
        return [(stripped, True, True)]
    if not _FOUR_WORDS.search(sentence):
        return []
    characters = _RUNS.sub(lambda m: f"\x01{len(m[0])}\x02", sentence)
    octets = _RUNS.sub(lambda m: f"\x01{len(m[0].encode('utf-8', 'replace'))}\x02", sentence)
    return [("=" + characters, True, True), ("8" + characters, False, True), ("8" + octets, True, False)]


def distinct_texts(values: DataFrame) -> DataFrame:
    """``text`` once each, with ``copies``, ``RATIO`` at most."""
    return values.filter("text IS NOT NULL").groupBy("text").agg(F.least(F.count("*"), F.lit(RATIO)).alias("copies"))


_SCAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        *[T.StructField(name, T.LongType()) for name in ("text_a", "text_b")],
        T.StructField("sentence", T.BinaryType()),
        *[T.StructField(name, T.StringType()) for name in ("value", "skeleton")],
        *[T.StructField(name, T.BooleanType()) for name in ("as_clean", "as_garbled")],
        *[T.StructField(name, T.LongType()) for name in ("texts", "copies")],
    ]
)
#: Distinct tokens or sentences that a task counts before it hands the counts on.
COUNTED = 200_000


def identity(text: Column) -> list[Column]:
    """128 bits that stand for a text, ``text_a`` and ``text_b``."""
    return [F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit(7), text).alias("text_b")]


def scan(texts: DataFrame) -> DataFrame:
    """One pass over distinct texts (``text``, ``copies``), written once. Rows by ``kind``:

    ``token``: a token (``value``), its core (``skeleton``), the texts it stands in and their copies, counted per task.
    ``spelled``: a sentence with non-ASCII characters, what it is grouped by and its counts.
    ``place``: a token with non-ASCII characters, its text and its sentence (128 bits that stand for it).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, tokens_more = Counter(), Counter()
        spelled, spelled_more = Counter(), Counter()

        def rows(kind: str, size: int, **columns: list) -> pa.RecordBatch:
            given = {"kind": [kind] * size} | columns
            return pa.RecordBatch.from_arrays([pa.array(given[f.name], t) if f.name in given else pa.nulls(size, t) for f, t in zip(_SCAN, arrow, strict=True)], names=_SCAN.names)

        def counted() -> Iterator[pa.RecordBatch]:
            if tokens:
                yield rows("token", len(tokens), value=list(tokens), skeleton=list(map(core, tokens)), texts=list(tokens.values()), copies=[n + tokens_more[t] for t, n in tokens.items()])
            found = [(s, k, c, g, n, n + spelled_more[s]) for s, n in spelled.items() for k, c, g in skeletons(s)]
            if found:
                value, skeleton, clean, garbled, n, more = map(list, zip(*found, strict=True))
                yield rows("spelled", len(found), value=value, skeleton=skeleton, as_clean=clean, as_garbled=garbled, texts=n, copies=more)
            for counter in (tokens, tokens_more, spelled, spelled_more):
                counter.clear()

        arrow = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        for batch in batches:
            places: list[list] = [[], [], [], []]
            for a, b, text, copies in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = set(_WORDS.findall(text))
                tokens.update(own)
                if copies > 1:
                    for t in own:
                        tokens_more[t] += copies - 1
                if text.isascii():
                    continue
                for sentence in dict.fromkeys(s for s in _SPLIT.split(text) if not s.isascii()):
                    if "�" not in sentence:
                        spelled[sentence] += 1
                        if copies > 1:
                            spelled_more[sentence] += copies - 1
                    other = [t for t in dict.fromkeys(_WORDS.findall(sentence)) if not t.isascii()]
                    key = xxhash.xxh3_128_digest(sentence.encode("utf-8", "replace"))
                    for column, more in zip(places, ([a] * len(other), [b] * len(other), [key] * len(other), other), strict=True):
                        column += more
            yield rows("place", len(places[0]), text_a=places[0], text_b=places[1], sentence=places[2], value=places[3])
            if len(tokens) > COUNTED or len(spelled) > COUNTED:
                yield from counted()
        yield from counted()

    return materialize(texts.select(*identity(F.col("text")), "text", "copies").mapInArrow(run, _SCAN), "scan")


def near_twins(values: DataFrame) -> DataFrame:
    """Pairs ``garbled``, ``clean``, ``n`` of sentences that differ only in non-ASCII characters.

    The spelling that occurs in most distinct texts (then: most often, copies limited) stands for the group (ties: the greatest), so a
    group of any size gives one row for each other spelling. See ``skeletons`` for what forms a group.
    """
    return _twins(scan(distinct_texts(values)))


def _twins(scanned: DataFrame) -> DataFrame:
    found = scanned.filter("kind = 'spelled'").groupBy("skeleton", F.col("value").alias("sentence"), "as_clean", "as_garbled")
    spelled = materialize(found.agg(F.struct(F.sum("texts").alias("texts"), F.sum("copies").alias("copies")).alias("n")), "spelled")
    best = spelled.filter("as_clean").groupBy("skeleton").agg(F.max_by("sentence", F.struct("n", "sentence")).alias("clean"), F.max("n").alias("most"))
    pairs = spelled.filter("as_garbled").join(best, "skeleton")
    return pairs.filter("sentence <> clean AND most > n").select(F.col("sentence").alias("garbled"), "clean", F.col("n.texts").alias("n"))


def learn(scanned: DataFrame) -> dict[tuple[str, str], int]:
    """Transformations and how many aligned characters of twin pairs speak for each; one row per transformation is collected."""

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chains = _chains()
        for batch in batches:
            found = []
            for garbled, clean in zip(batch["garbled"], batch["clean"], strict=True):
                ours, theirs = _RUNS.split(garbled), _RUNS.split(clean)
                if ours != theirs:
                    continue
                runs = [(c, g) for c, g in zip(_RUNS.findall(clean), _RUNS.findall(garbled), strict=True) if c != g]
                letters = len({c for run, _ in runs for c in run})
                found += [(*chain, letters) for chain in chains if runs and all(_explains(c, g, chain) for c, g in runs)]
            yield pd.DataFrame(found, columns=["read_as", "bytes_of", "votes"])

    rows = _twins(scanned).mapInPandas(votes, "read_as string, bytes_of string, votes bigint")
    return {(r["read_as"], r["bytes_of"]): r["n"] for r in rows.groupBy("read_as", "bytes_of").agg(F.sum("votes").alias("n")).collect()}


@dataclass
class Proposer:
    """What the learned transformations make of one token."""

    learned: dict[tuple[str, str], int]

    def __post_init__(self) -> None:
        # Of a change and its reverse, which a much copied garbled text speaks for, the one with more votes holds.
        single = [c for c, n in sorted(self.learned.items(), key=lambda x: (-x[1], x[0])) if n >= VOTES and c[1] != "utf-8" and n >= self.learned.get((c[1], c[0]), 0)]
        self.single = [(c, {ord(x): _tables(c[1])[0][b] for x, b in _tables(c[0])[1].items() if x > "\x7f"}) for c in single]
        # UTF-8 proves itself; the reading that most twins speak for is tried first.
        self.multiple = sorted((r for r in READ_AS if (r, "utf-8") in self.learned), key=lambda r: -self.learned[r, "utf-8"])
        self.marks = {_mark(r): r for r in reversed(self.multiple)}

    def rows(self, token: str) -> list[tuple]:
        """One row with ``sure``, or any number of rows to be weighed: token, fixed, read_as, bytes_of, sure, fixed_core, own_core, letters."""
        for mark, read_as in self.marks.items():
            if token.startswith(mark):
                return [(token, token[len(mark) :], read_as, "utf-8", True, None, None, 0)]
        found = []
        broken = any("\x80" <= c <= "\x9f" or c == "�" for c in token)
        read = [(undo_utf8(token, r), r) for r in self.multiple]
        (back, covered), read_as = max(read, key=lambda x: x[0][1], default=((token, 0), ""))
        if covered:
            own = sum(c > "\x7f" for c in token)
            if broken or read_as not in _CYRILLIC or (covered == own and own >= 6):
                return [(token, back, read_as, "utf-8", True, None, None, 0)]
            found.append((back, read_as, "utf-8"))
        signs = {ord(c) for c in token if c > "\x7f"}
        if broken:  # damaged for certain; the change that most twins speak for undoes it, if one does
            backs = ((token.translate(table), chain) for chain, table in self.single if signs <= table.keys())
            back, chain = next(((b, c) for b, c in backs if b != token and _PLAIN.fullmatch(b) and any(map(str.isalpha, b))), (None, (None, None)))
            return [(token, back, *chain, True, None, None, 0)]
        for chain, table in self.single:
            if signs <= table.keys():
                back = token.translate(table)
                if back != token and not any("\x80" <= c <= "\x9f" for c in back):
                    found.append((back, *chain))
        own_core, spelled = core(token), any(map(str.isalpha, token))
        weighed = []
        for fixed, *chain in found:
            longest = max(fixed.split("\u00a0"), key=lambda p: (len(p), p))
            fixed_core = core(longest)
            whole = "\u00a0" not in fixed or (len(fixed_core) * 2 >= len(token) and len(fixed_core) >= 2)
            if fixed_core != own_core and whole and (spelled or not any(map(str.isalpha, fixed))):
                weighed.append((token, fixed, *chain, False, fixed_core, own_core, sum(map(str.isalpha, fixed_core))))
        return weighed


def token_repairs(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``token``, ``fixed``, ``n`` for every token that a wrong decoding has damaged wherever it stands, one row each;
    and ``sentence``, ``token``, ``fixed``, ``n`` for those that only the sentence around them shows to be damaged.

    ``fixed`` is null if the original can't be recovered. ``n`` is null for certain, else how often the corpus has the original.
    """
    proposer = Proposer(learn(scanned))
    every = scanned.filter("kind = 'token'").groupBy(F.col("value").alias("token"), F.col("skeleton").alias("core")).agg(F.sum("texts").alias("texts"), F.sum("copies").alias("n"))
    every = materialize(every, "tokens")
    cores = materialize(every.groupBy("core").agg(F.sum("texts").alias("texts"), F.sum("n").alias("n")), "cores")

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [row for token in batch["token"] for row in proposer.rows(token)]
            yield pd.DataFrame(found, columns=["token", "fixed", "read_as", "bytes_of", "sure", "fixed_core", "own_core", "letters"])

    schema = "token string, fixed string, read_as string, bytes_of string, sure boolean, fixed_core string, own_core string, letters int"
    proposed = materialize(every.filter(F.col("token").rlike(_OTHER)).select("token").mapInPandas(propose, schema), "proposed")
    sure = proposed.filter("sure").select("token", "fixed")
    known = cores.select(F.col("core").alias("fixed_core"), F.col("n").alias("fixed_n"))
    as_is = cores.select(F.col("core").alias("own_core"), F.col("texts").alias("own_n"))
    weighed = proposed.filter("NOT sure").join(known, "fixed_core", "left").join(as_is, "own_core")
    weighed = materialize(weighed.fillna(0, ["fixed_n"]), "weighed")
    likely = (
        weighed.filter((F.col("fixed_n") >= KNOWN) & (F.col("fixed_n") >= RATIO * F.col("own_n")))
        .groupBy("token")
        .agg(F.max_by(F.struct("fixed", F.col("fixed_n").alias("n")), F.struct("fixed_n", "read_as", "bytes_of")).alias("b"))
        .select("token", "b.*")
    )
    skeleton = F.regexp_replace(F.lower(F.col("token")), _OTHER, "")
    lost = sure.filter("fixed IS NULL").select("token", skeleton.alias("skeleton"))
    broken = sure.select("token").union(likely.select("token"))
    whole = every.filter(F.col("token").rlike(_OTHER)).join(broken, "token", "left_anti").withColumn("skeleton", skeleton)
    twin = whole.filter(F.length("skeleton") >= 3).groupBy("skeleton").agg(F.max_by("token", F.struct("n", "token")).alias("twin"))
    recovered = lost.join(twin, "skeleton", "left").select("token", F.col("twin").alias("fixed"))
    certain = sure.filter("fixed IS NOT NULL").unionByName(recovered).withColumn("n", F.lit(None).cast("bigint"))
    # A token is either certain or weighed, and each kind has one row for it.
    return materialize(certain.unionByName(likely), "repairs"), _sentence_repairs(scanned.filter("kind = 'place'"), weighed)


def _sentence_repairs(places: DataFrame, weighed: DataFrame) -> DataFrame:
    # The sentence itself does not speak for its own spelling, nor do the copies of its text.
    gain = F.log((F.col("fixed_n") + HALF) / (F.greatest(F.col("own_n") - 1, F.lit(0)) + HALF))
    scored = weighed.select("token", "fixed", F.col("fixed_n").alias("n"), "read_as", "bytes_of", gain.alias("gain"), "letters")
    telling = scored.filter("gain > 0 AND letters > 1").select("token").distinct()
    words = places.select("sentence", F.col("value").alias("token"))
    hit = words.join(telling, "token", "left_semi").select("sentence").distinct()
    words = words.join(hit, "sentence", "left_semi").distinct()
    by_chain = words.join(scored, "token").groupBy("sentence", "read_as", "bytes_of").agg(F.sum("gain").alias("score"), F.collect_list(F.struct("token", "fixed", "n")).alias("fixes"))
    best = by_chain.filter(F.col("score") >= SCORE).groupBy("sentence").agg(F.max_by("fixes", F.struct("score", "read_as", "bytes_of")).alias("fixes"))
    return materialize(best.select("sentence", F.explode("fixes").alias("f")).select("sentence", "f.token", "f.fixed", "f.n"), "sentences")


def _hits(values: DataFrame) -> DataFrame:
    """``token`` and ``fixed`` for every damaged token of each text; ``n`` (null: certain) and ``around`` tell which of two to take."""
    scanned = scan(distinct_texts(values))
    tokens, sentences = token_repairs(scanned)
    places = scanned.filter("kind = 'place'").select("text_a", "text_b", "sentence", F.col("value").alias("token"))
    alone = places.drop("sentence").join(tokens, "token").withColumn("n", F.coalesce("n", F.lit(1 << 62))).withColumn("around", F.lit(False))
    together = places.join(sentences, ["sentence", "token"]).drop("sentence").withColumn("around", F.lit(True))
    return alone.unionByName(together)


def _keyed(values: DataFrame, *columns: str) -> DataFrame:
    return values.filter(F.col("text").rlike(_OTHER)).select("table_name", "row_id", "field", *columns, *identity(F.col("text")))


def repair(values: DataFrame) -> DataFrame:
    """The damaged values among ``values`` (``table_name``, ``row_id``, ``field``, ``text``), with ``repaired``.

    ``repaired`` has every damaged token replaced by its original; it is null if a token can't be recovered. Null and
    empty texts are never damaged. Repeated rows come back once each time. Other columns are ignored.
    """
    one = _hits(values).groupBy("text_a", "text_b", "token").agg(F.max_by("fixed", F.struct("n", "around")).alias("fixed"))
    hit = one.groupBy("text_a", "text_b").agg(
        F.map_from_entries(F.collect_list(F.struct("token", F.coalesce("fixed", F.lit(""))))).alias("fixes"), F.bool_and(F.col("fixed").isNotNull()).alias("whole")
    )
    parts = F.split("text", r"(?<=[ \t\r\n])|(?=[ \t\r\n])")
    fixed = F.array_join(F.transform(parts, lambda t: F.coalesce(F.try_element_at(F.col("fixes"), t), t)), "")
    keyed = _keyed(values, "text").join(hit, ["text_a", "text_b"])
    return keyed.select("table_name", "row_id", "field", "text", F.when(F.col("whole"), fixed).alias("repaired"))


def damaged(values: DataFrame) -> DataFrame:
    """Keys of the damaged values, distinct."""
    hit = _hits(values).select("text_a", "text_b").distinct()
    return _keyed(values).join(hit, ["text_a", "text_b"], "left_semi").select("table_name", "row_id", "field").distinct()
