"""Personal information inside free text: a linear-chain conditional random field over word shapes.

A text is read in blocks (the lines of a cue, or of a paragraph; a mention may be broken over lines). Each token sees the
words, shapes, endings and name-list membership of itself and its neighbours, the shape of the number or mailbox it is part of, and the
classes of three tokens in a row. The field is trained on a small labelled table with exact gradients from the
forward-backward recursion; decoding is Viterbi over batches of blocks in numpy. An exact check then drops spans that cannot
be what their label says, such as a telephone number with five digits.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.pii_table import Table
from pagemill.session import materialize

TYPES = ("email", "phone", "id_number", "address", "name")
LABELS = ["O", *[f"{p}-{t}" for t in TYPES for p in "BI"]]
#: Rows of the weight table; features are hashed into it.
SPACE = 1 << 17
#: Documents that a name of the corpus must be seen in to join the list.
SEEN = 3
#: Names that the lines of the training table are filled from, at most; the list that the field asks has no such bound.
DRAWN = 20_000
#: Words of listed names that are sent to every worker (8 bytes each). Where the list is longer, each document brings those it has.
LISTED = 2_000_000
#: Blocks whose spans a worker keeps; beyond it the table starts afresh.
KEPT = 200_000

_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"</?[a-z]+>|\w+|[^\w\s]")
_NUMBER = re.compile(r"[(+]?[0-9OQ][0-9OQA-Z]*(?:[ \t\r\n]{0,2}[-./()]{0,2}[ \t\r\n]?(?:[0-9][0-9O]*|O[0-9]+|(?<=[0-9O] )[A-Z](?![\w])|(?<=-)[A-Z](?!\w))[A-Z]?(?![a-z]))*")
_ADDRESS = re.compile(r"(?<!\S)(?:</?[a-z]+>)?([^\s<>@＠]+[@＠][^\s<>@＠]+\.[^\s<>@＠]+)")
# Particles of family names, and titles before names.
PARTICLES = frozenset("von van de del della di da do dos das la le los las du des der den".split())
TITLES = frozenset("dr mr mrs ms miss sir herr frau m mme mlle monsieur madame don doña señor señora sr sra dona senhor senhora signor signora sig pan pani panią pana господин госпожа prof".split())


def shape(word: str) -> str:
    """Letter case and digits of a word; runs longer than four are cut."""
    s = "".join("X" if c.isupper() else "x" if c.islower() else "d" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1", s)


def name_words(name: str) -> list[str]:
    """Lower-case words of a name; particles are no names."""
    return [w for w in re.findall(r"\w+", name.lower()) if w not in PARTICLES and len(w) > 1]


def _sorted_hashes(words: Iterable[str]) -> np.ndarray:
    return np.unique(np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64))


@dataclass
class Lexicon:
    """Words of given and of family names, as sorted arrays of their 64-bit hashes."""

    given: np.ndarray
    family: np.ndarray
    kinds: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def of(given: list[str], family: list[str]) -> Lexicon:
        return Lexicon(*(_sorted_hashes(w for n in names for w in name_words(n)) for names in (given, family)))

    def add(self, listed: Iterable[tuple[str, bool, bool]]) -> None:
        """Words that a batch of documents brings, with whether they are given and family names."""
        self.kinds |= {w: ("B" if f else "G") if g else "F" for w, g, f in listed}

    @staticmethod
    def _has(hashes: np.ndarray, word: str) -> bool:
        h = np.uint64(xxhash.xxh64_intdigest(word))
        at = int(hashes.searchsorted(h))
        return at < len(hashes) and hashes[at] == h

    def kind(self, word: str) -> str:
        low = word.lower()
        if (known := self.kinds.get(low)) is None:
            given, family = self._has(self.given, low), self._has(self.family, low)
            known = ("B" if family else "G") if given else "F" if family else "P" if low in PARTICLES else "T" if low in TITLES else ""
            if len(self.kinds) > KEPT:
                self.kinds.clear()
            self.kinds[low] = known
        if known:
            return known
        if word[0].isdigit():
            return f"{min(len(word), 6)}"
        if word[0].isalpha():
            if len(word) == 1:
                return "I" if word.isupper() else "i"
            return "U" if word.isupper() else "C" if word[0].isupper() else "l" if word.islower() else "m"
        return word[0] if word[0] in ",.:;-@+()[]/’'" else "<" if word[0] == "<" else "x"


def _hash(text: str) -> int:
    return zlib.crc32(text.encode()) % SPACE


OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
EDGE = "\x00"
_ZEROS = bytes.maketrans(b"123456789", b"000000000")


def levelled(text: str) -> str:
    """The text with every digit as 0, as the features see it."""
    return text.encode("utf-8", "surrogatepass").translate(_ZEROS).decode("utf-8", "surrogatepass") if _DIGIT.search(text) else text


def word_features(word: str, kind: str, offset: int) -> list[int]:
    low = levelled(word.lower())
    keys = [f"k{kind}", f"s{shape(word)}"]
    if not word[0].isdigit():
        keys += [f"w{low}"] if abs(offset) < 3 else []
        keys += [f"e{low[-3:]}", f"b{low[:3]}"] if abs(offset) < 2 else []
    return [_hash(f"{offset}{k}") for k in keys]


def starts_of(text: str, tokens: list[str]) -> list[int]:
    """Where the tokens begin."""
    starts, at = [], 0
    for t in tokens:
        at = text.index(t, at)
        starts.append(at)
        at += len(t)
    return starts


def tokenize(text: str) -> tuple[list[str], list[str] | None]:
    """Tokens, and the shape of the number or mailbox around each (empty outside; null if there is none at all)."""
    tokens = _TOKEN.findall(text)
    found = [m for m in _NUMBER.finditer(text) if sum(c.isdigit() for c in m[0]) > 1] if _DIGIT.search(text) else []
    mailbox = "@" in text or "＠" in text
    if not found and not mailbox:
        return tokens, None
    starts, numbers, at = starts_of(text, tokens), [""] * len(tokens), 0
    for m in found:
        form = re.sub(r"\s+", " ", re.sub(r"[0-9]|(?<=[0-9])O|O(?=[0-9])", "9", m[0]))
        while at < len(starts) and starts[at] < m.start():
            at += 1
        while at < len(starts) and starts[at] < m.end():
            numbers[at] = ("<" if starts[at] == m.start() else ">") + form
            at += 1
    if mailbox:
        for m in _ADDRESS.finditer(text):
            for i, s in enumerate(starts):
                if m.start(1) <= s < m.end(1):
                    numbers[i] = "<@" if s == m.start(1) else ">@"
    return tokens, numbers


def _sums(weights: np.ndarray, rows: list[list[int]]) -> np.ndarray:
    """The sum of the weights of each row of features."""
    sizes = np.array([len(r) for r in rows])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.array([i for r in rows for i in r])
    return np.add.reduceat(weights[flat], starts, axis=0)


class Tagger:
    """The field: weights by hashed feature and label, and transitions.

    Words are numbered as they are met, with their classes; the classes and the number around a token are packed into one
    integer. The scores of a word, and of such an integer, are summed once.
    """

    def __init__(self, lexicon: Lexicon, weights: np.ndarray, transitions: np.ndarray) -> None:
        self.lexicon, self.weights, self.transitions = lexicon, weights, transitions
        self.kinds: dict[str, int] = {"^": 0, "$": 1}
        self.forms: dict[str, int] = {"": 0}
        self._forget()

    def _forget(self) -> None:
        # Numbers 0 and 1 stand before and after a text.
        edge = np.stack([_sums(self.weights, [word_features(EDGE, "^", o)]) for o in OFFSETS])
        self.words: dict[str, int] = {EDGE: 0, EDGE * 2: 1}
        self.kind_of = np.array([0, 1])
        self.emission = np.concatenate([edge, edge], axis=1)
        self.windows: dict[int, int] = {}
        self.sequence = np.zeros((0, len(LABELS)), dtype=self.weights.dtype)

    def _learn(self, words: set[str]) -> None:
        if len(self.words) > KEPT:
            self._forget()
        new = [w for w in words if w not in self.words]
        for at in range(0, len(new), 2_000):
            part = new[at : at + 2_000]
            kinds = [self.lexicon.kind(w) for w in part]
            rows = np.stack([_sums(self.weights, [word_features(w, k, o) for w, k in zip(part, kinds, strict=True)]) for o in OFFSETS])
            first = len(self.words)
            self.words |= {w: first + i for i, w in enumerate(part)}
            self.kind_of = np.concatenate([self.kind_of, [self.kinds.setdefault(k, len(self.kinds)) for k in kinds]])
            self.emission = np.concatenate([self.emission, rows], axis=1)

    def _sequences(self, codes: np.ndarray) -> np.ndarray:
        """Scores from the classes around each token and its number."""
        if len(self.windows) > KEPT:
            self.windows, self.sequence = {}, self.sequence[:0]
        different, back = np.unique(codes, return_inverse=True)
        known, new = self.windows, []
        which = []
        for code in different.tolist():
            if (k := known.get(code)) is None:
                k = known[code] = len(known)
                new.append(code)
            which.append(k)
        if new:
            names, forms = list(self.kinds), list(self.forms)
            unpacked = (([names[code >> 6 * i & 63] for i in (4, 3, 2, 1, 0)], forms[code >> 30]) for code in new)
            self.sequence = np.concatenate([self.sequence, _sums(self.weights, [[_hash(x) for x in window_features(*kinds, form)] for kinds, form in unpacked])])
        return self.sequence[np.array(which, dtype=np.int64)[back]]

    def emissions(self, read: list[tuple[list[str], list[str] | None]]) -> list[np.ndarray]:
        """Scores of the labels of each token of each block; no block is empty."""
        words, ids, begins = self.words, [0, 0, 0, 0], []
        numbered = []
        for tokens, numbers in read:
            begins.append(len(ids))
            if numbers is not None:
                numbered += [(begins[-1] + i, self.forms.setdefault(n, len(self.forms))) for i, n in enumerate(numbers) if n]
            ids += map(words.__getitem__, tokens)
            ids += (1, 1, 0, 0)
        ids += (0, 0)
        row = np.array(ids)
        at = np.flatnonzero(row > 1)
        kinds = self.kind_of[row]
        code = kinds[at - 2] << 24 | kinds[at - 1] << 18 | kinds[at] << 12 | kinds[at + 1] << 6 | kinds[at + 2]
        if numbered:
            form = np.zeros(len(row), dtype=np.int64)
            where, which = zip(*numbered, strict=True)
            form[list(where)] = which
            code |= form[at] << 30
        scores = self._sequences(code)
        for j, o in enumerate(OFFSETS):
            scores += self.emission[j, row[at + o]]
        ends = np.cumsum([len(tokens) for tokens, _ in read])
        return np.split(scores, ends[:-1])

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Begin, end and type of every mention in each text."""
        if len(self.forms) > KEPT:
            self.forms, self.windows, self.sequence = {"": 0}, {}, self.sequence[:0]
        read = [tokenize(t) for t in texts]
        self._learn({w for tokens, _ in read for w in tokens})
        order = sorted((i for i in range(len(read)) if read[i][0]), key=lambda i: len(read[i][0]))
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for big in range(0, len(order), 4_096):
            chosen = order[big : big + 4_096]
            emitted = self.emissions([read[i] for i in chosen])
            for b in range(0, len(chosen), 256):
                part = chosen[b : b + 256]
                for i, path in zip(part, viterbi(emitted[b : b + 256], self.transitions), strict=True):
                    if path.any():
                        tokens = read[i][0]
                        found[i] = checked(texts[i], _spans(path, tokens, starts_of(texts[i], tokens)), self.lexicon)
        return found


def _windows(kinds: list[str], numbers: list[str]) -> Iterator[tuple[str, ...]]:
    """The classes of five tokens around each token, and its number."""
    p = ["^", "^", *kinds, "$", "$"]
    return zip(p, p[1:], p[2:], p[3:], p[4:], numbers, strict=False)


def window_features(a: str, b: str, c: str, d: str, e: str, number: str) -> list[str]:
    keys = [f"t{b}{c}{d}", f"l{a}{b}{c}", f"r{c}{d}{e}", f"q{a}{b}{c}{d}{e}"]
    if number:
        keys += [f"n{number}", f"nb{b}{number}", f"nl{re.sub('[^9]', '', number)}{number[0]}"]
    return keys


def viterbi(emitted: list[np.ndarray], transitions: np.ndarray) -> list[np.ndarray]:
    """Best label sequences of a batch, padded to the longest."""
    size, longest, k = len(emitted), max(map(len, emitted)), transitions.shape[0]
    lengths = np.array([len(e) for e in emitted])
    score = np.zeros((longest, size, k))
    for j, e in enumerate(emitted):
        score[: len(e), j] = e
    back = np.zeros((longest, size, k), dtype=np.int8)
    best = score[0].copy()
    rows = np.arange(size)
    final = np.where((lengths == 1)[:, None], best, 0.0)
    for t in range(1, longest):
        step = best[:, :, None] + transitions
        back[t] = step.argmax(axis=1)
        best = step.max(axis=1) + score[t]
        final[lengths == t + 1] = best[lengths == t + 1]
    paths = np.zeros((longest, size), dtype=np.int64)
    paths[lengths - 1, rows] = final.argmax(axis=1)
    for t in range(longest - 1, 0, -1):
        live = lengths > t
        paths[t - 1, live] = back[t, rows[live], paths[t, live]]
    return [paths[: len(e), j] for j, e in enumerate(emitted)]


def _spans(path: np.ndarray, tokens: list[str], starts: list[int]) -> list[tuple[int, int, str]]:
    out, open_ = [], None
    for i, label in enumerate(path):
        kind = LABELS[label][2:]
        if open_ and (label == 0 or kind != open_[2] or LABELS[label][0] == "B"):
            out.append(tuple(open_))
            open_ = None
        if label:
            end = starts[i] + len(tokens[i])
            open_ = [starts[i], end, kind] if open_ is None else [open_[0], end, kind]
    return [*out, tuple(open_)] if open_ else out


_MAILBOX = re.compile(r"\S\s*(?:[@＠]|\s[\[(]?(?:at|AT)[\])]?\s)\s*\S+?\s*(?:\.|\b(?:dot|DOT)\b)\s*\w")
_BEFORE = re.compile(r"[\w.+-]*\Z")
_TURN = re.compile(r"[\s.]*\n\s*[-–—]")
_CASED = r"[^\W\d_]+(?:[’'-][^\W\d_]+)*"
_UNLISTED = re.compile(rf"{_CASED}(?:,?\s+(?:[^\W\d_]\.|{_CASED})){{1,5}}")
_BEFORE_NAME = re.compile(r"[^\s\[\](){}<>\"“”„«».,:;!?*♪/—-]*\Z")


def unlisted_name(body: str) -> bool:
    """Whether words of no list are spelled as a name: two or more in title case, initials and particles between."""
    words = [w for w in re.findall(_CASED, body) if len(w) > 1 and w.lower() not in PARTICLES | TITLES]
    cased = lambda w: all(p[:1].isupper() and p[1:] == p[1:].lower() for p in re.split("[’'-]", w))
    return len(words) >= 2 and bool(_UNLISTED.fullmatch(body)) and all(map(cased, words))


def checked(text: str, spans: list[tuple[int, int, str]], lexicon: Lexicon) -> list[tuple[int, int, str]]:
    """Spans moved to the borders of what they mean, without those that cannot be what they are called."""
    kept = []
    for a, b, kind in spans:
        while a < b and (tag := re.match(r"</?[a-z]+>", text[a:b])):
            a += tag.end()
        lead = r"[^\w(+]" if kind == "phone" else r"\W"
        while a < b and re.match(lead, text[a]):
            a += 1
        while b > a and not (text[b - 1].isalnum() or text[b - 1] in ".)" and kind == "address"):
            b -= 1
        if kind == "email":
            a = _BEFORE.search(text, 0, a).start()
        elif kind in ("name", "address"):
            a = _BEFORE_NAME.search(text, 0, a).start()
        if kind == "name" and (turn := _TURN.search(text, a, b)):  # the next speaker's line is not part of it
            b = turn.start()
        body = text[a:b]
        digits = sum("0" <= c <= "9" for c in body) + len(re.findall(r"(?<=\d)O|O(?=\d)", body))
        if kind == "name":
            kinds = {lexicon.kind(w) for w in re.findall(r"[^\W\d_]+", body) if len(w) > 1} - {"P", "T"}
            listed = bool(kinds & {"G", "F", "B"})
            fits = kinds not in ({"G"}, {"F"}) and len(re.findall(r"[^\W\d_]{2,}", body)) >= 2 if listed else unlisted_name(body)
        else:
            fits = {
                "email": bool(_MAILBOX.search(body)),
                "phone": 8 <= digits <= 18,
                "id_number": 6 <= digits <= 18,
                "address": bool(re.search(r"(?<!\w)[0-9]+[A-Za-z]?(?!\w)", body)) and any(c.isalpha() for c in body),
            }[kind]
        if fits and (not kept or a >= kept[-1][1]):
            kept.append((a, b, kind))
    return kept


def train(lexicon: Lexicon, table: Table, epochs: int = 8, rate: float = 0.35, decay: float = 1e-6) -> Tagger:
    """Fit the field by AdaGrad on the exact gradient of the conditional likelihood."""
    data = []
    rng = np.random.default_rng(5)
    seen: dict[tuple[str, str, int], list[int]] = {}  # words of the table repeat

    def features(word: str, kind: str, offset: int) -> list[int]:
        key = (word, kind, offset)
        if key not in seen:
            seen[key] = word_features(word, kind, offset)
        return seen[key]

    for text, spans in table.rows():
        tokens, numbers = tokenize(text)
        kinds = [lexicon.kind(t) for t in tokens]
        if not tokens:
            continue
        starts, numbers = starts_of(text, tokens), numbers or [""] * len(tokens)
        gold = np.zeros(len(tokens), dtype=np.int64)
        for a, b, kind in spans:
            inside = [i for i, s in enumerate(starts) if a <= s < b]
            gold[inside] = LABELS.index(f"I-{kind}")
            if inside:
                gold[inside[0]] = LABELS.index(f"B-{kind}")
        # A listed name now and then counts as unknown, so that context has to do.
        kinds = ["C" if k in "GFB" and t[0].isupper() and not t.isupper() and rng.random() < 0.12 else k for k, t in zip(kinds, tokens, strict=True)]
        padded = [(EDGE, "^")] * 3 + list(zip(tokens, kinds, strict=True)) + [(EDGE, "^")] * 3
        ids = []
        for i, keys in enumerate(window_features(*w) for w in _windows(kinds, numbers)):
            row = [h for o in OFFSETS for h in features(*padded[i + 3 + o], o)]
            ids.append(np.array(row + [_hash(k) for k in keys]))
        data.append((ids, gold))
    k = len(LABELS)
    weights, squares = np.zeros((SPACE, k)), np.full((SPACE, k), 1e-4)
    transitions, tsquares = np.zeros((k, k)), np.full((k, k), 1e-4)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        order = order[np.argsort([len(data[i][1]) // 4 for i in order], kind="stable")]
        batches = [order[b : b + 64] for b in range(0, len(order), 64)]
        for b in rng.permutation(len(batches)):
            part = [data[i] for i in batches[b]]
            flat = np.concatenate([i for ids, _ in part for i in ids])
            sizes = np.array([len(i) for ids, _ in part for i in ids])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            emitted = np.add.reduceat(weights[flat], starts, axis=0)
            gradient, tgradient = _gradient(emitted, [g for _, g in part], transitions)
            used, inverse = np.unique(flat, return_inverse=True)
            total = np.zeros((len(used), k))
            np.add.at(total, inverse, np.repeat(gradient, sizes, axis=0))
            total -= decay * len(part) * weights[used]
            squares[used] += total**2
            weights[used] += rate * total / np.sqrt(squares[used])
            tsquares += tgradient**2
            transitions += rate * tgradient / np.sqrt(tsquares)
    return Tagger(lexicon, weights.astype(np.float32), transitions)


def _gradient(emitted: np.ndarray, golds: list[np.ndarray], transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observed minus expected counts, for emissions and transitions, by forward-backward over the batch."""
    lengths = np.array([len(g) for g in golds])
    size, longest, k = len(golds), lengths.max(), transitions.shape[0]
    place = np.arange(longest)[:, None] < lengths
    score = np.zeros((longest, size, k))
    score.transpose(1, 0, 2)[place.T] = emitted
    forward, backward = np.zeros_like(score), np.zeros_like(score)
    lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    forward[0] = score[0]
    for t in range(1, longest):
        step = lse(forward[t - 1][:, :, None] + transitions, 1) + score[t]
        forward[t] = np.where(place[t][:, None], step, forward[t - 1])
    for t in range(longest - 2, -1, -1):
        step = lse(transitions + (score[t + 1] + backward[t + 1])[:, None, :], 2)
        backward[t] = np.where(place[t + 1][:, None], step, 0.0)
    norm = lse(forward[-1], 1)
    expected = np.exp(forward + backward - norm[:, None]) * place[:, :, None]
    gold = np.zeros((longest, size), dtype=np.int64)
    gold.T[place.T] = np.concatenate(golds)
    observed = np.eye(k)[gold] * place[:, :, None]
    tgradient = np.zeros((k, k))
    for t in range(1, longest):
        live = place[t]
        pair = forward[t - 1][:, :, None] + transitions + (score[t] + backward[t])[:, None, :] - norm[:, None, None]
        tgradient -= np.exp(pair[live]).sum(axis=0)
        np.add.at(tgradient, (gold[t - 1][live], gold[t][live]), 1.0)
    return (observed - expected).transpose(1, 0, 2)[place.T], tgradient


_END = r"(?:\r\n?|\n|\Z)"
_IN_LINE = r"[^\S\r\n]*"
_SPEECH = re.compile(
    rf"(?<![^\r\n])(?:(?!\ufeff?{_IN_LINE}{_END})(?![^\r\n]*-->)(?!\ufeff?{_IN_LINE}[0-9]+{_IN_LINE}(?:\r\n?|\n)[^\r\n]*-->)[^\r\n]+{_END})+"
)
_HEAD = re.compile(rf"(?:\ufeff?(?:WEBVTT|NOTE|STYLE|REGION){_IN_LINE}{_END})+")


def blocks(text: str) -> Iterator[tuple[int, str]]:
    """The blocks of lines of speech, with where they begin: cue numbers, times and blank lines part them.

    A line of digits is a cue number only before a line with times. Of a WebVTT file, the words that open its blocks are left
    out where they stand alone; titles and comments are read like speech.
    """
    for m in _SPEECH.finditer(text):
        begin, block = m.start(), m[0]
        if block[0] in "WNSR\ufeff" and (head := _HEAD.match(block)):
            begin, block = begin + head.end(), block[head.end() :]
        if block := block.rstrip("\r\n"):
            yield begin, block


def _letters(wanted: str) -> str:
    """The upper- or lower-case letters of the basic plane as a character class."""
    codes = [c for c in range(0x10000) if getattr(chr(c), wanted)()]
    runs: list[list[int]] = []
    for c in codes:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs) + "]"


_CAPITAL = f"{_letters('isupper')}{_letters('islower')}+"
_BESIDE = re.compile(
    rf"(?<![^\W\d_])(?<!\.)({_CAPITAL}(?:-{_CAPITAL})?)(?=(?: {_letters('isupper')}\.)?[ \n]"
    rf"((?:(?:von|van|de|del|da|di|la|le|dos|du) ){{0,2}}(?:[OD]’)?{_CAPITAL}(?:-{_CAPITAL})?)(?![^\W\d_])(?: ({_CAPITAL})(?![^\W\d_]))?)"
)
#: Pairs of words that a task counts before it hands the counts on.
COUNTED = 200_000


def corpus_names(documents: DataFrame, names: DataFrame) -> DataFrame:
    """``name``, ``kind`` and ``n`` of the names of the corpus that stand beside listed ones: new given names before listed
    family names and the reverse.

    Counted over all documents in one pass, per task before they are shuffled; a name must occur in ``SEEN`` documents and
    beside two different listed names. All names that do come back, whatever their number.
    """
    out = ["given", "family", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter = Counter()

        def counted() -> pa.RecordBatch:
            given, family = [a for a, _ in pairs], [b for _, b in pairs]
            batch = pa.RecordBatch.from_arrays([pa.array(given, pa.string()), pa.array(family, pa.string()), pa.array(list(pairs.values()), pa.int64())], names=out)
            pairs.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = set(_BESIDE.findall(text or ""))
                pairs.update({(a, b) for a, b, _ in found} | {(a, f"{b} {c}") for a, b, c in found if c})
            if len(pairs) > COUNTED:
                yield counted()
        yield counted()

    pairs = documents.select("text").mapInArrow(run, "given string, family string, n bigint").groupBy("given", "family").agg(F.sum("n").alias("n"))
    pairs = materialize(pairs, "beside")

    def beside(new: str, listed: str) -> DataFrame:
        known = names.filter(F.col("kind") == listed).select(F.col("name").alias(listed)).distinct()
        counts = pairs.join(known, listed).groupBy(F.col(new).alias("name")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
        return counts.filter((F.col("n") >= SEEN) & (F.col("kinds") >= 2) & ~F.lower("name").isin(*TITLES | PARTICLES)).select("name", F.lit(new).alias("kind"), "n")

    given = beside("given", "family").filter(~F.col("name").contains("-"))
    family = beside("family", "given").filter(F.regexp_replace("name", "^(?:(?:von|van|de|del|da|di|la|le|dos|du) )*", "").contains(" ") == F.lit(False))
    return given.union(family)


def listed_words(names: DataFrame) -> DataFrame:
    """``word``, ``given``, ``family``: the words of ``names`` (``name``, ``kind``), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, k) for n, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in name_words(n)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([k for _, k in rows], pa.string())], names=["word", "kind"])

    words = names.select("name", "kind").mapInArrow(run, "word string, kind string")
    return words.groupBy("word").agg(F.bool_or(F.col("kind") == "given").alias("given"), F.bool_or(F.col("kind") == "family").alias("family"))


def _with_listed(documents: DataFrame, words: DataFrame) -> DataFrame:
    """The documents with ``listed``, the listed words that they have: the way for a list too long to be sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(k, w) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in set(re.findall(r"[^\W\d_]+", (t or "").lower()))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int64()), pa.array([w for _, w in own], pa.string())], names=["key", "word"])

    has = documents.mapInArrow(run, "key bigint, word string").join(words, "word").groupBy("key").agg(F.collect_set(F.struct("word", "given", "family")).alias("listed"))
    return documents.join(has, F.col("doc_id").eqNullSafe(F.col("key")), "left").select("doc_id", "text", "listed")


def mentions(documents: DataFrame, names: DataFrame, with_text: bool = True) -> DataFrame:
    """``doc_id``, ``text`` (if wanted) and ``found``, an array of (start, end, type) in code points.

    ``names`` (``name``, ``kind`` given or family) need not be complete: names that occur beside listed ones in the documents
    are added. The list may have any length: up to ``LISTED`` words it is sent to the workers, beyond that it is joined with the
    words of the documents. Null and empty texts have no mentions.
    """
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("bigint"), "text")
    names = names.filter("name IS NOT NULL AND kind IN ('given', 'family')").select("name", "kind").distinct()
    more = materialize(corpus_names(documents, names), "names")
    listed = names.withColumn("n", F.lit(1 << 62)).unionByName(more)
    drawn = listed.orderBy(F.desc("n"), "name", "kind").limit(DRAWN).collect()
    given, family = ([r["name"] for r in drawn if r["kind"] == k] for k in ("given", "family"))
    tagger = train(Lexicon.of(given, family), Table(given, family))
    words = materialize(listed_words(listed), "listed")
    if words.count() <= LISTED:
        rows = words.collect()
        lexicon = Lexicon(*(_sorted_hashes(r["word"] for r in rows if r[k]) for k in ("given", "family")))
        read = documents.withColumn("listed", F.lit(None).cast("array<struct<word:string,given:boolean,family:boolean>>"))
    else:
        lexicon = Lexicon.of([], [])
        read = _with_listed(documents, words)
    model = spark.sparkContext.broadcast((lexicon, tagger.weights, tagger.transitions))
    columns = ["doc_id", "text"] if with_text else ["doc_id"]
    schema = f"doc_id bigint, {'text string, ' if with_text else ''}found array<struct<start:bigint,end:bigint,type:string>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger, known = Tagger(*model.value), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for own in part.column(2).to_pylist():
                    tagger.lexicon.add((w["word"], w["given"], w["family"]) for w in own or ())
                split = [[(s, b, levelled(b)) for s, b in blocks(t)] if t else [] for t in part.column(1).to_pylist()]
                if len(known) > KEPT:
                    known.clear()
                # No feature looks at the value of a digit, so blocks that differ in those alone have the same result.
                new = {key: b for bs in split for _, b, key in bs if key not in known}
                known |= dict(zip(new, tagger.spans(list(new.values())), strict=True))
                found = [[{"start": s + a, "end": s + e, "type": k} for s, _, key in bs for a, e, k in known[key]] for bs in split]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(found, kind)], names=[*columns, "found"])

    return read.mapInArrow(run, schema)


def redact(found: DataFrame) -> DataFrame:
    """``doc_id`` and ``redacted``: the text with ``[EMAIL]``, ``[PHONE]`` and so on in place of the mentions."""
    cuts = F.concat(F.transform("found", lambda m: m["start"]), F.array(F.length("text").cast("bigint")))
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("found", lambda m: m["end"]))
    kept = F.transform(F.arrays_zip(begins.alias("a"), cuts.alias("b")), lambda p: F.substring("text", (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")))
    marks = F.concat(F.transform("found", lambda m: F.concat(F.lit("["), F.upper(m["type"]), F.lit("]"))), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(kept, marks, lambda a, b: F.concat(a, b)), "")
    return found.select("doc_id", F.when(F.size("found") == 0, F.col("text")).otherwise(joined).alias("redacted"))
