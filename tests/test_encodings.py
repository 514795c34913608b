"""Encodings: marks, declarations, frequencies on texts that no sample has."""

from __future__ import annotations

import pytest

from pagemill.sources.encodings import Detection, Detector, decode, detect, detect_all

HELD_OUT = {
    "ru": "Портовая контора ведёт список всех пропавших фонарей, а деревенский хор ищет новых певцов на осень. Мы приехали поздно вечером.",
    "uk": "Старий пором щоранку перевозить теплий хліб, і його діти чекають на березі. Її очі дивляться на річку.",
    "el": "Το παλιό καράβι πουλάει ζεστό ψωμί πριν από την ανατολή του ήλιου και κανείς δεν ξέρει γιατί.",
    "tr": "Eski gemi güneş doğmadan önce sıcak ekmek satıyor ve kimse nedenini bilmiyor, çünkü yağmur yağıyor.",
    "he": "המעבורת הישנה מוכרת לחם חם לפני הזריחה ואיש אינו יודע מדוע.",
    "ar": "تبيع العبارة القديمة الخبز الساخن قبل شروق الشمس ولا أحد يعرف السبب.",
    "pl": "Stary prom sprzedaje ciepły chleb przed świtem, a wójt gminy szuka źródła hałasu; trzeba iść dalej wąską ścieżką.",
    "cs": "Starý přívoz prodává teplý chléb ještě před úsvitem a nikdo neví proč, protože prší už třetí den.",
    "de": "Die alte Fähre verkauft vor Sonnenaufgang warmes Brot, während der Bürgermeister müde über die Brücke läuft.",
    "fr": "Le vieux bac vend du pain chaud avant l’aube, mais personne n’a été prévenu à la mairie où la fête a commencé.",
}
CASES = [
    ("ru", "cp1251"), ("ru", "koi8-r"), ("ru", "cp866"), ("ru", "iso8859-5"), ("uk", "cp1251"), ("uk", "koi8-u"), ("el", "cp1253"), ("tr", "cp1254"), ("he", "cp1255"), ("ar", "cp1256"), ("pl", "cp1250"), ("pl", "iso8859-2"), ("cs", "cp1250"), ("de", "cp1252"), ("fr", "cp1252"), ("de", "cp850"), ("de", "mac_roman"),
]
EAST = {
    "cp932": "古い渡し船は日の出前に温かいパンを売っている。港の事務所は失くなった灯火の一覧を持っています。", "euc_jp": "古い渡し船は日の出前に温かいパンを売っている。港の事務所は失くなった灯火の一覧を持っています。",
    "gb18030": "旧渡船在日出之前出售热面包，港口办公室保存着所有丢失灯笼的名单。", "big5hkscs": "舊渡船在日出之前出售熱麵包，港口辦公室保存著所有丟失燈籠的名單。", "cp949": "오래된 나룻배는 해가 뜨기 전에 따뜻한 빵을 팔고, 항구 사무소는 사라진 등불의 목록을 보관한다.",
}


@pytest.mark.parametrize(("language", "codec"), CASES)
def test_single_bytes(language, codec):
    data = HELD_OUT[language].encode(codec, "ignore")
    found, confidence = detect(data)
    assert data.decode(found, "replace") == data.decode(codec), (found, [(m.codec, m.confidence) for m in detect_all(data)[:4]])
    assert 0 < confidence < 1


@pytest.mark.parametrize("codec", EAST)
def test_several_bytes(codec):
    assert detect(EAST[codec].encode(codec))[0] == codec


def test_declared_and_marked():
    assert detect("é".encode("utf-16"))[0] == "utf-16-le" and detect("é".encode("utf-32"))[0] == "utf-32-le"
    assert detect(b"<?xml version='1.0' encoding='koi8-r'?><a/>")[0] == "koi8-r" and detect(b"\x1b$B$3$s\x1b(B")[0] == "iso2022_jp"
    assert detect("naïve café".encode()[:-1])[0] == "utf-8" and detect(b"x", "windows-1251") == ("cp1251", 0.95) and detect(b"") == ("utf-8", 0.5)
    assert detect_all("é".encode())[0].encoding == "utf-8" and detect_all(b"\xef\xbb\xbfx")[0].bom


def test_options():
    data = "привет".encode("cp1251")
    assert detect(data, options=Detection(tld="example.ru"))[0] == "cp1251"
    assert detect(data, options=Detection(allowed=frozenset(("windows-1252",))))[0] == "cp1252"
    assert "cp1251" not in [m.codec for m in detect_all(data, Detection(excluded=frozenset(("cp1251",))))]
    assert detect_all(data, Detection(threshold=0.999))[0].confidence == 0.0
    whole = Detector()
    for i in range(0, len(data), 2):
        whole.feed(data[i : i + 2])
    assert whole.close().codec == detect(data)[0] and whole.done
    marked = Detector()
    marked.feed(b"\xef\xbb\xbfabc")
    assert marked.done and marked.result.codec == "utf-8"


def test_rows(spark):
    rows = [(1, bytearray(HELD_OUT["ru"].encode("koi8-r")), "a.ru"), (2, bytearray(EAST["gb18030"].encode("gb18030")), None), (3, None, "x"), (4, bytearray(b""), None)]
    df = spark.createDataFrame(rows, "page_id bigint, content binary, host string")
    assert [r["html"] for r in decode(df, "content", tld="host").orderBy("page_id").collect()] == [HELD_OUT["ru"], EAST["gb18030"], None, ""]
