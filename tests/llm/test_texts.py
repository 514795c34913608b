"""Markup residue, garbled text, languages, repeated runs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm.boilerplate import boilerplate, repeated
from pagemill.llm.garbled import Proposer, damaged, distinct_texts, learn, near_twins, repair, scan, undo, undo_utf8
from pagemill.llm.languages import Reader, documents_languages, fit, language_code, mislabelled, passages, read_batch
from pagemill.llm.markup import clean, convert, families

PLAIN = [
    "5 * 4 * 3", "See #7", "[...]", "Note *", "~20 %", "C#", "3 > 2 > 1", "10^6", "-- 5 --", "R&D", "{?}", "v_2_final", "a_b", "$5–$7", "x == y",
    "A/B", "+++", "…", "I <3 it \\o/", "(3 < 5)", "C:\\temp\\new", "AT&T", "12:30", 'a "quoted" word', "", "it’s", "1 < 2 & 3 > 2",
]
MARKED = [
    ("<p>a</p>", "a"), ("a &amp; b", "a & b"), ("&lt;p&gt;a&lt;/p&gt;", "a"), ("&amp;lt;b&amp;gt;a&amp;lt;/b&amp;gt;", "a"), ("<h2>T</h2><ul><li>x<li>y</ul>", "## T\n\n- x\n- y"),
    ("# T\n\na", "# T\n\na"), ("T\n===\n\na", "# T\n\na"), ("a **b** c", "a b c"), ("a ~~b~~", "a b"), ("[t](http://x.example)", "t"), ("a[^1]\n\n[^1]: n", "a"),
    ("> q\n> r", "q\nr"), ("a:\n- x\n- y", "a:\n- x\n- y"), ("| a | b |\n|---|---|\n| 1 | 2 |", "a\tb\n1\t2"), ("```py\nif a < b:\n```", "```\nif a < b:\n```"),
    ("== T ==\na", "## T\n\na"), ("'''b''' a", "b a"), ("[[x|y]]", "y"), ("{{q|a|b}}", "a — b"), ("\\textbf{b} a", "b a"), ("a $x^2$ b", "a $x^2$ b"),
    ("\\section{T}\na~\\cite{k}", "## T\n\na"), ("\\begin{itemize}\n\\item x\n\\end{itemize}", "- x"), ("a <b", "a"), ("a <a href=\"http", "a"), ("a &nbs", "a"), ("\\[ x \\]", "$$x$$"),
    ("<pre><code>a &lt; b</code></pre>", "```\na < b\n```"), ("a<!-- c -->", "a"), ("a<br>b", "a\nb"),
]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_signs_are_no_markup(text):
    assert families(text) == []
    assert clean(text) == text


@pytest.mark.parametrize(("text", "wanted"), MARKED)
def test_markup(text, wanted):
    assert families(text)
    assert clean(text) == wanted


def test_convert(spark):
    df = spark.createDataFrame([(1, "<b>x</b>", "c"), (2, None, "c"), (3, "", "c"), (4, "y", "c")], "k int, text string, clean string")
    got = {r["k"]: (list(r["families"]), r["clean"]) for r in convert(df, "text").collect()}
    assert got == {1: (["html"], "x"), 2: ([], None), 3: ([], ""), 4: ([], "y")}
    assert convert(df.limit(0), "text").count() == 0
    assert clean("<p>" + "x" * 500_000 + "</p>") == "x" * 500_000


def test_undo():
    for codec in ("cp1252", "cp1250", "cp437", "mac_roman"):
        spoilt = "café — “né”".encode().decode(codec, "replace")
        if "�" not in spoilt:
            assert undo_utf8(spoilt, codec)[0] == "café — “né”"
    assert undo("Ãîðîä", "cp1252", "cp1251") == "Город"
    assert undo_utf8("“Âme & Château” Å ½ Ø ÎLE", "cp1252")[1] == 0


VALUES = "table_name string, row_id bigint, field string, text string"


def values(spark, texts):
    return spark.createDataFrame([("t", i, "f", t) for i, t in enumerate(texts)], VALUES)


def test_garbled_values(spark):
    right = ["Die alte Fähre öffnet die Türen für Gäste.", "The café by the lock is open.", "Старый паром продаёт тёплый хлеб до рассвета.", "La estación está en el río.", "This year’s “very patient” winter."]
    spoil = {
        5: right[0].encode().decode("cp1252"), 6: right[1].encode().decode("mac_roman"), 7: right[2].encode("cp1251").decode("latin-1"), 8: right[3].encode("cp1252").decode("cp437"),
        9: "The caf� by the lock is open.", 10: right[2].encode("koi8-r").decode("cp1251"), 11: right[0].encode().decode("cp1252").encode().decode("cp1252"),
    }
    clean_ones = ["“Âme & Château”", "Å ½ Ø", "½ £ · ¾ €", "45 °C ± 2", "№ 12 «Волна»", "Сёмга и ёлка", None, "", "ascii only"]
    texts = right * 6
    bad = {len(texts) + i: t for i, t in enumerate(spoil.values())}
    df = values(spark, texts + list(spoil.values()) + clean_ones)
    assert near_twins(df).count() >= 4
    found = {r["row_id"] for r in damaged(df).collect()}
    assert found == set(bad)
    fixed = {r["row_id"]: r["repaired"] for r in repair(df).collect()}
    originals = [right[0], right[1], right[2], right[3], right[1], right[2], right[0]]
    assert [fixed[k] for k in sorted(bad)] == originals


def test_copies_do_not_outvote(spark):
    right = ["Старый паром продаёт тёплый хлеб до рассвета.", "Портовая контора ведёт список пропавших фонарей.", "Здесь много лет никого не было и идёт дождь."]
    known = [f"{t} {i}" for i in range(4) for t in right]
    spoil = lambda t: t.encode("cp1251").decode("latin-1")
    hot, rare = spoil("Старый паром ведёт список фонарей."), spoil("Тёплый дождь Квазимодовки.")
    texts = [*known, *known, *map(spoil, right), *[hot] * 300, rare]
    found = {r["row_id"]: r["repaired"] for r in repair(values(spark, texts)).collect()}
    first = 2 * len(known)
    assert set(found) == set(range(first, len(texts)))
    assert found[first + 3] == "Старый паром ведёт список фонарей." and found[len(texts) - 1] == "Тёплый дождь Квазимодовки."


def test_words_hardly_known(spark):
    right = [f"{t} {i}" for i in range(4) for t in ("Старый паром продаёт тёплый хлеб до рассвета.", "Портовая контора ведёт список пропавших фонарей.")]
    garbled = [right[0].encode("cp1251").decode("latin-1"), right[1].encode("cp1251").decode("latin-1"), "Ёлочный базар".encode("cp1251").decode("latin-1")]
    found = {r["row_id"]: r["repaired"] for r in repair(values(spark, [*right, "Вот ёлочный базар.", *garbled])).collect()}
    assert found == {9: right[0], 10: right[1], 11: "Ёлочный базар"}


def misread(text, codec="cp1251"):
    """UTF-8 read as another encoding; undefined bytes stand for themselves."""
    return "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in text.encode())


def test_one_answer_for_each_token(spark):
    twins = ["Ø is a letter of the north", "Øre and Åse live by the river Ærø", "Die alte Fähre öffnet", "Ein Gefäß für Öl und Süßes"]
    texts = [*twins * 4, *map(misread, twins)]
    df = values(spark, texts)
    fixed = {r["row_id"]: r["repaired"] for r in repair(df.union(df)).collect()}
    assert {k: fixed[k] for k in range(16, 20)} == dict(zip(range(16, 20), twins, strict=True))
    assert repair(df.union(df)).count() == 2 * len(fixed) == 8
    rows = Proposer({("cp1251", "utf-8"): 5, ("cp1252", "cp1251"): 9}).rows
    assert rows("Г\x98") == [("Г\x98", "Ø", "cp1251", "utf-8", True, None, None, 0)]
    assert [r[1] for r in rows("x\x98")] == [None]
    assert Proposer({("cp1252", "cp850"): 9, ("cp1252", "cp437"): 4}).rows("f\x81r") == [("f\x81r", "für", "cp1252", "cp850", True, None, None, 0)]
    for token in ("Г\x98", "x�", "Ãîðîä", "РџРµС‚СЊ", "РЎ", "plain"):
        assert len({r[4] for r in rows(token)}) <= 1 and sum(r[4] for r in rows(token)) <= 1


def test_read_back_to_the_end():
    text = "Fähre “öffnet” früh"
    for times in (1, 2, 3, 4):
        spoilt = text
        for _ in range(times):
            spoilt = spoilt.encode().decode("latin-1")
        assert undo_utf8(spoilt, "latin-1")[0] == text
    assert undo_utf8("“" * 5_000 + "Ã©", "cp1252")[0] == "“" * 5_000 + "é"


def test_russian_twins_of_utf8(spark):
    right = ["Старый паром продаёт тёплый хлеб — до рассвета.", "Портовая контора ведёт список пропавших фонарей."]
    garbled = list(map(misread, right))
    learned = learn(scan(distinct_texts(values(spark, right * 3 + garbled))))
    assert learned.get(("cp1251", "utf-8"), 0) >= 10


def test_garbled_nothing(spark):
    assert damaged(values(spark, [])).count() == 0
    assert damaged(values(spark, [None, "", "x"])).count() == 0


SAMPLES = {
    "en": "The old ferry sells warm bread before sunrise|We should have taken the other road|Nobody has been here for years and the rain keeps falling|The harbour office keeps a list of every missing lantern",
    "de": "Die alte Fähre verkauft vor Sonnenaufgang warmes Brot|Wir hätten die andere Straße nehmen sollen|Seit Jahren war niemand mehr hier und es regnet weiter|Das Hafenamt führt eine Liste aller verschwundenen Laternen",
    "es": "El viejo transbordador vende pan caliente antes del amanecer|Tendríamos que haber tomado el otro camino|Hace años que nadie viene por aquí y sigue lloviendo|La oficina del puerto guarda una lista de los faroles perdidos",
    "ru": "Старый паром продаёт тёплый хлеб до рассвета|Надо было ехать другой дорогой|Здесь уже много лет никого не было и идёт дождь|Портовая контора ведёт список всех пропавших фонарей",
}
PAIRS = [(t + ".", lang) for lang, texts in SAMPLES.items() for t in texts.split("|")]


def test_models_and_rejection():
    models = fit(PAIRS)
    entropy, sizes, words = Reader(models).entropies(["Nobody sells bread here.", "Niemand verkauft hier Brot.", "", "12"])
    assert [models.languages[i] for i in entropy[:2].argmin(axis=1)] == ["en", "de"]
    assert list(sizes[2:]) == [0, 0] and list(words) == [4, 4, 0, 0]
    for k, n in enumerate([len(x) for x in models.grams]):
        assert n and (np.diff(models.grams[k].astype(np.float64)) >= 0).all()
    got = read_batch(Reader(models), ["Zxqv wqzx kjqx vvzq.", None], [False, False])
    assert got.languages == ["und"]


def test_held_out_accuracy():
    right = 0
    for i, (text, lang) in enumerate(PAIRS):
        models = fit([p for j, p in enumerate(PAIRS) if j != i])
        right += models.languages[int(Reader(models).entropies([text])[0][0].argmin())] == lang
    assert right >= 15


def test_mislabelled(spark):
    samples = spark.createDataFrame(PAIRS, "text string, lang string")
    texts = [
        ("The old ferry sells bread. Wir nehmen die andere Straße.", "en"), ("The harbour office keeps a list.", "EN_us"), ("The harbour office keeps a list.", "ger"), ("Die alte Fähre", None),
        ("The harbour office keeps a list.", "und"), ("<p>Das Hafenamt führt eine Liste.</p>", "deu"), (None, "en"), ("", ""), ("Старый паром продаёт хлеб.".encode("cp1251").decode("latin-1"), "rus"),
    ]
    df = spark.createDataFrame([(i, t, g, "x") for i, (t, g) in enumerate(texts)], "k int, text string, lang string, passages string")
    found = passages(df, "text", samples)
    got = {(r["k"], r["language"]) for r in mislabelled(found, "lang").collect()}
    assert got == {(0, "en"), (0, "de"), (2, "en"), (4, "en")}
    whole = {r["k"]: r["language"] for r in documents_languages(found).collect()}
    assert (whole[1], whole[5], whole[6], whole[8]) == ("en", "de", "und", "ru")
    assert passages(df.limit(0), "text", samples, "lang").count() == 0


def test_language_codes(spark):
    df = spark.createDataFrame([(x,) for x in ["en-GB", "DE", "fre", "und", "", None, "pt_BR", "x1", "zxx"]], "v string")
    assert [r[0] for r in df.select(language_code(F.col("v"))).collect()] == ["en", "de", "fr", None, None, None, "pt", None, None]


def test_repeated_like_brute_force():
    rng = random.Random(2)
    for _ in range(20):
        n = rng.randrange(1, 60)
        codes = np.array([rng.randrange(3) for _ in range(n)])
        page = np.sort(np.array([rng.randrange(3) for _ in range(n)]))
        got = repeated(codes, page, 3, 2)
        for i in range(n - 2):
            window = tuple(codes[i : i + 3])
            pages = {page[j] for j in range(n - 2) if tuple(codes[j : j + 3]) == window}
            assert got[i] == (len(pages) >= 2)


@pytest.mark.parametrize("shard", [400, 1])
def test_boilerplate(spark, monkeypatch, shard):
    monkeypatch.setattr("pagemill.llm.boilerplate.SHARD", shard)
    menu = "home about contact news legal imprint"
    rows = [("h", p, p * 10 + u, menu if u == 0 else f"own words of page {p} {p * 7} {p * 13} end") for p in range(1, 6) for u in (0, 1)]
    rows += [("h", 9, 90, None), ("g", 7, 70, menu), (None, 8, 80, menu), ("h", 9, 91, " ")]
    got = {r["unit_id"]: r for r in boilerplate(spark.createDataFrame(rows, "host string, page_id bigint, unit_id bigint, text string")).collect()}
    assert len(got) == len(rows)
    assert all(got[p * 10]["kept"] == "" and got[p * 10]["covered"] == 6 for p in range(1, 6))
    assert all(got[p * 10 + 1]["covered"] == 0 for p in range(1, 6))
    assert got[70]["kept"] == got[80]["kept"] == menu
    assert got[90]["tokens"] == got[91]["tokens"] == 0
