"""Token sizes, packing, mixing, personal information."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pagemill.llm import mixing, packing
from pagemill.llm.mixing import mix
from pagemill.llm.packing import container_fill, divided, dot_product_bins, pack
from pagemill.llm.personal import Lexicon, blocks, checked, corpus_names, mentions, redact, train, viterbi
from pagemill.llm.pii_table import Table
from pagemill.llm.tokens import TOKENIZER, TOKENIZER_DIR, Counter, encoding, pieces_of

CUE = "1\r\n00:00:01,000 --> 00:00:02,500\r\nHello — wörld, it’s 12:30!\r\n\r\n"


def text(rng, n):
    return "".join(rng.choice([CUE, "Привет мир\n", "  indented\n\n  more\n", "a" * 40 + "\n", "\n\n\n", "x\ty\x1cz\u3000w\n", "12 345\n", " - !!\n"]) for _ in range(n))


def test_counts_like_the_tokenizer():
    encode, counter, rng = encoding(TOKENIZER_DIR, TOKENIZER).encode_ordinary, Counter(), random.Random(1)
    for n in range(60):
        t = text(rng, n)
        assert counter.count(t) == len(encode(t))
    assert counter.count("") == 0


def test_pieces():
    parts = list(pieces_of([3, 5, 4, 2], [False, True, False, True], 6))
    assert [(p[1], p[2]) for p in parts] == [(0, 6), (6, 6), (12, 2)]
    assert sum(p[3] for p in parts) == 7 and [p[3] for p in parts] == [3, 2, 2]


def test_bins_hold_their_limits():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 300):
        sizes = rng.uniform(0.01, 0.9, (n, 3)) * [1, 0.1, 0.8]
        bins = dot_product_bins(sizes)
        assert (bins >= 0).all()
        for b in set(bins):
            assert (sizes[bins == b].sum(axis=0) <= 1 + 1e-9).all()
        if n == 300:
            assert len(set(bins)) <= np.ceil(sizes.sum(axis=0).max()) * 1.1


@pytest.mark.parametrize("shard", [4096, 16])
def test_pack(spark, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD", shard)
    rng = random.Random(4)
    docs = [(i, text(rng, rng.randrange(1, 12)), "x") for i in range(60)] + [(60, text(rng, 300), "x"), (61, None, "x"), (62, "", "x"), (63, docs0 := "same text\n", "x"), (64, docs0, "x")]
    capacity = 256
    rows = pack(spark.createDataFrame(docs, "doc_id bigint, text string, container_id string"), capacity, max_segments=5).collect()
    count = Counter()
    for doc, t, _ in docs:
        mine = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert sum(r["tokens"] for r in mine) == count.count(t or "")
        assert len(mine) == 1 or mine[0]["doc_tokens"] > capacity
        assert (mine[0]["container_id"] is None) == (not t)
    by: dict = {}
    for r in rows:
        if r["container_id"] is not None:
            by.setdefault(r["container_id"], []).append(r)
    assert all(sum(r["tokens"] for r in x) <= capacity and len(x) <= 5 for x in by.values())
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, c string")
    assert {r[0] for r in divided(pack(frame, capacity)).collect()} == {d for d, t, _ in docs if count.count(t or "") > capacity}
    fill = container_fill(pack(frame, capacity), capacity).collect()
    assert sum(r["tokens"] for r in fill) / len(fill) / capacity > 0.85
    assert pack(frame.limit(0), capacity).count() == 0


def test_loss_bearing_tokens_limit_a_container(spark):
    rng = random.Random(8)
    docs = [(i if i % 3 else None, text(rng, rng.randrange(1, 10))) for i in range(80)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = [r for r in pack(frame, 256, loss_capacity=100).collect() if r["container_id"] is not None]
    by: dict = {}
    for r in rows:
        by.setdefault(r["container_id"], []).append(r)
    loads = {c: sum(r["loss_tokens"] for r in x) for c, x in by.items()}
    assert all(load <= 100 or len(by[c]) == 1 for c, load in loads.items())
    assert sum(load > 85 for load in loads.values()) > len(loads) / 2  # the limit that binds
    assert len(loads) > len({r["container_id"] for r in pack(frame, 256).collect()})


TARGETS = "source string, target_share double, max_repeats int"


@pytest.mark.parametrize("block", [20_000, 7])
def test_mix(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rng = random.Random(5)
    docs = [(i, rng.choice(["a", " A", "a", "b", "B", "c"]), "word " * rng.randrange(1, 60)) for i in range(600)]
    docs += [(1000, None, "x"), (1001, "z", "x"), (1002, "a", None), (1003, "a", "")]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.18, 4), ("empty", 0.02, 3), (None, 0.1, 1)], TARGETS)
    chosen, report = mix(spark.createDataFrame(docs, "doc_id bigint, source string, text string"), targets)
    rows = chosen.collect()
    caps = {"a": 1, "b": 2, "c": 4}
    assert all(1 <= r["copies"] <= caps[r["source"]] for r in rows)
    assert len({r["doc_id"] for r in rows}) == len(rows)
    shares = {r["source"]: r for r in report.collect()}
    assert set(shares) == {"a", "b", "c", "empty"}
    for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.18)):
        assert abs(shares[s]["actual_share"] - want / 0.98) < 0.002
    assert shares["empty"]["chosen_tokens"] == 0
    small, _ = mix(spark.createDataFrame(docs, "doc_id bigint, source string, text string"), targets, budget=500)
    assert abs(sum(r["copies"] * r["tokens"] for r in small.collect()) - 500) < 60
    none, empty = mix(spark.createDataFrame([], "doc_id bigint, source string, text string"), targets)
    assert none.count() == 0 and empty.count() == 4


NAMES = [("Marlowe", "given"), ("Götz", "given"), ("Nuño", "given"), ("Варвара", "given"), ("Tindrake", "family"), ("O’Karrow", "family"), ("von Eschenkamp", "family"), ("Полесцева", "family"), ("Almendral Ruz", "family")]


@pytest.fixture(scope="module")
def tagger():
    given, family = [n for n, k in NAMES if k == "given"], [n for n, k in NAMES if k == "family"]
    return train(Lexicon.of(given, family), Table(given, family), epochs=4)


def test_held_out_lines(tagger):
    given, family = [n for n, k in NAMES if k == "given"], [n for n, k in NAMES if k == "family"]
    rows = Table(given, family, seed=99).rows(1)
    right = sum({(a, k) for a, _, k in spans} == {(a, k) for a, _, k in got} for (_, spans), got in zip(rows, tagger.spans([t for t, _ in rows]), strict=True))
    assert right / len(rows) > 0.93


def test_viterbi_like_brute_force():
    import itertools

    rng = np.random.default_rng(1)
    transitions = rng.normal(size=(3, 3))
    emitted = [rng.normal(size=(n, 3)) for n in (1, 2, 4, 5)]
    for e, path in zip(emitted, viterbi(emitted, transitions), strict=True):
        score = lambda p: sum(e[i, y] for i, y in enumerate(p)) + sum(transitions[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
        assert abs(score(path) - max(map(score, itertools.product(range(3), repeat=len(e))))) < 1e-9


def test_blocks_and_checks():
    assert [b for _, b in blocks(CUE + "2\n00:01 --> 00:02\na\nb\n")] == ["Hello — wörld, it’s 12:30!", "a\nb"]
    assert all(CUE[a : a + len(b)] == b for a, b in blocks(CUE))
    lexicon = Lexicon.of(["Ann", "Bob"], ["Vale", "Finn"])
    assert checked("Ann, Bob", [(0, 8, "name")], lexicon) == []
    assert checked("- Ann Vale.", [(0, 11, "name")], lexicon) == [(2, 10, "name")]
    assert checked("call 12345 now", [(5, 10, "phone")], lexicon) == []


def test_mentions_and_redaction(spark):
    docs = [
        (1, "1\n00:00:01,000 --> 00:00:02,000\nCall me on +44 20 7946 0541\nbefore noon.\n\n2\n00:00:03,000 --> 00:00:04,000\nMy name is Marlowe Tindrake.\n"),
        (2, "1\n00:00:01,000 --> 00:00:02,000\nWrite to a.b@kontor.example if you find it.\n"), (3, None), (4, ""), (5, "MARLOWE: No.\n\nLot 4471-903, sold.\n"),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = mentions(df, spark.createDataFrame(NAMES, "name string, kind string")).cache()
    got = {(r["doc_id"], m["type"], dict(docs)[r["doc_id"]][m["start"] : m["end"]]) for r in found.collect() for m in r["found"]}
    assert got == {(1, "phone", "+44 20 7946 0541"), (1, "name", "Marlowe Tindrake"), (2, "email", "a.b@kontor.example")}
    texts = {r["doc_id"]: r["redacted"] for r in redact(found).collect()}
    assert "Call me on [PHONE]\nbefore" in texts[1] and "[NAME]." in texts[1] and texts[3] is None and texts[5] == docs[4][1]


def test_values_of_digits_do_not_matter(tagger):
    rng = random.Random(3)
    given, family = [n for n, k in NAMES if k == "given"], [n for n, k in NAMES if k == "family"]
    texts = [t for t, _ in Table(given, family, seed=5).rows(1)][:400]
    other = ["".join(rng.choice("0123456789") if c.isdigit() and c.isascii() else c for c in t) for t in texts]
    assert tagger.spans(texts) == tagger.spans(other)


def test_names_found_beside_listed_ones(spark):
    names = spark.createDataFrame([*NAMES, ("Castell", "family")], "name string, kind string")
    texts = ["Zora Tindrake spoke.", "It was Zora K. Castell", "Zora Almendral Ruz left", "Marlowe Quenby", "Götz von Quenby", "Marlowe de la Sorne", "Götz de la Sorne", "Odd Tindrake", None, ""]
    docs = spark.createDataFrame([(t,) for t in texts * 3], "text string")
    got = {(r["name"], r["kind"], r["n"]) for r in corpus_names(docs, names).collect()}
    assert got == {("Zora", "given", 9), ("de la Sorne", "family", 6)}


@pytest.mark.parametrize("listed", [2_000_000, 0])
def test_long_lists_are_joined(spark, monkeypatch, listed):
    monkeypatch.setattr("pagemill.llm.personal.LISTED", listed)
    docs = [(1, "My name is Marlowe Tindrake."), (1, "Kennst du GÖTZ VON ESCHENKAMP?"), (None, "Ask Nuño Almendral Ruz about it."), (2, "MARLOWE: No."), (3, None)]
    found = mentions(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(NAMES, "name string, kind string")).collect()
    got = sorted((r["text"], [r["text"][m["start"] : m["end"]] for m in r["found"]]) for r in found if r["text"])
    assert got == [("Ask Nuño Almendral Ruz about it.", ["Nuño Almendral Ruz"]), ("Kennst du GÖTZ VON ESCHENKAMP?", ["GÖTZ VON ESCHENKAMP"]), ("MARLOWE: No.", []), ("My name is Marlowe Tindrake.", ["Marlowe Tindrake"])]
    assert len(found) == 5


def test_every_block_is_decoded(spark):
    lines = ["Deliver it to 6B Old Elmfield Street.", "She lives at 4 Kingsmead Road now.", "Она теперь живёт здесь: ул.\nМельничная, д. 5, кв. 4.", "My name is Zoltan Kovacs."]
    docs = [(i, f"1\n00:00:01,000 --> 00:00:02,000\n{x}\n") for i, x in enumerate(lines)]
    found = mentions(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(NAMES, "name string, kind string"))
    got = {(r["doc_id"], m["type"], dict(docs)[r["doc_id"]][m["start"] : m["end"]]) for r in found.collect() for m in r["found"]}
    assert got == {(0, "address", "6B Old Elmfield Street"), (1, "address", "4 Kingsmead Road"), (2, "address", "ул.\nМельничная, д. 5, кв. 4"), (3, "name", "Zoltan Kovacs")}


def test_names_of_no_list():
    lexicon = Lexicon.of(["Ann"], ["Vale"])
    for body in ("Zoltan Kovacs", "Zoltan K. Kovacs", "Kovacs, Zoltan", "Zoltan von Kovacs", "Zoltan O’Kovacs-Lund"):
        assert checked(body, [(0, len(body), "name")], lexicon) == [(0, len(body), "name")]
    for body in ("old ferry", "Zoltan", "Ann, Ann", "Mr. Kovacs", "ХТПЦБК СВМПЛ", "Ð½Ð°Ñ Ð½Ð"):
        assert checked(body, [(0, len(body), "name")], lexicon) == []


def test_digits_alone_are_speech():
    cue = "00:00:01,000 --> 00:00:02,000"
    assert [b for _, b in blocks(f"1\n{cue}\n219379991631041\n\n2\n{cue}\nCall\n02079460541\nnow\n3\n{cue}\n07700900123")] == ["219379991631041", "Call\n02079460541\nnow", "07700900123"]
    assert [b for _, b in blocks(f"WEBVTT\n\nNOTE\nby Ann Vale\n\n{cue}\nNOTE it: 02079460541\nSTYLE\n")] == ["by Ann Vale", "NOTE it: 02079460541\nSTYLE"]
    assert list(blocks("")) == []


def test_number_alone_on_its_line(tagger):
    text = "1\n00:00:01,000 --> 00:00:02,000\n219379991631041\n\n2\n00:00:03,000 --> 00:00:04,000\nNo.\n"
    (begin, block), _ = blocks(text)
    assert [(text[begin + a : begin + b], k) for a, b, k in tagger.spans([block])[0]] == [("219379991631041", "id_number")]
