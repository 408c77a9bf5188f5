import pytest

from verbarium.llm import encoding as E

CLEAN = ["Dâ€™abord le café déjà vu à l’été", "слово значит зимняя шуба", "이름이 나란히 적혀 있다", "zónbas tènlisʼā“x”"]


def test_forms_and_pieces():
    pieces = E.Pieces(frozenset("éàā“”ʼслово한"))
    for w in ("é", "ā", "слово", "“", "한"):
        utf = [(f, c) for f, c in E.forms(w) if c.startswith("utf-8") and c.split(">")[1] in E.SINGLE]
        assert utf and all(pieces.cover(f)[0] == w for f, _ in utf)
    assert E.Pieces(frozenset("ÇÃ")).cover("ÇÃ") is None


def test_sieve_keeps_every_form_of_the_corpus():
    words = ["café", "слово", "나란히", "naïve", "über", "日本語"]
    for w in words:
        everything = dict(E.Table().forms(w))
        for f, k in everything.items():
            assert f == E.garble(w, E.CHAINS[k])
            text = f"{E.EDGE}{f}{E.EDGE}"
            own = E.Table({E.pair_bucket(text[i : i + 2]) for i in range(len(text) - 1)}, frozenset(f) | frozenset(w))
            assert f in dict(own.forms(w))
    assert {"cp949", "gbk", "cp932", "big5", "euc_jp"} <= {e for c in E.CHAINS for e in c}


@pytest.fixture(scope="module")
def docs(spark):
    base = ["le café déjà là", "слово значит шуба зимний", "나란히 적혀 있다 이름이", "une fête légère à côté"] * 3
    rows = list(enumerate(base))
    bad = {
        100: "le café".encode().decode("latin-1"),
        101: "слово значит".encode("koi8-r").decode("cp1251"),
        102: "나란히".encode("cp949").decode("latin-1"),
        103: "x " + "légère".encode().decode("cp1252").encode().decode("cp1252"),
        104: "lost � here",
        105: "zenfôlé bôn".encode("latin-1").decode("cp1251"),
        107: "слово " + "зимний".encode("cp1251").decode("cp949", "replace"),
        108: "слово " + "значит".encode().decode("gbk", "replace"),
        106: "plain " * 20000 + "côté".encode().decode("mac_roman"),
    }
    good = {200: "ANOTAÇÃO DA MANHÃ", 201: "", 202: None, 203: "слово ШУБА", 204: "a\xa0b", 205: "ascii only"}
    rows += [*bad.items(), *good.items(), (100, bad[100])]
    return spark.createDataFrame([(k, t, "clash", "n") for k, t in rows], "doc_id long, text string, word string, chain string"), bad


def test_found(docs):
    df, bad = docs
    assert sorted(r[0] for r in E.find_garbled(df, "doc_id", "text").collect()) == sorted(bad)


def test_restored(docs):
    got = {r["doc_id"]: r for r in E.restore(docs[0], "doc_id", "text").collect()}
    assert got[100]["restored"] == "le café" and got[100]["chains"] == ["utf-8>latin-1"]
    assert got[101]["restored"] == "слово значит"
    assert got[102]["restored"] == "나란히"
    assert got[103]["restored"] == "x légère"
    assert got[107]["restored"] == "слово зимний" and got[108]["restored"] == "слово значит" and got[108]["classes"] == ["word"]
    assert got[104]["classes"] == ["lost"] and "pieces" not in got[100]["classes"]
    assert got[104]["n_lost"] == 1 and got[104]["restored"] == "lost � here"
    assert got[105]["restored"] == "zenfôlé bôn"
    assert got[106]["restored"].endswith("plain côté")


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert E.find_garbled(df, "doc_id", "text").count() == 0
    assert E.restore(df, "doc_id", "text").count() == 0


def test_copies_do_not_hide_garbling(spark):
    """A garbled text copied more often than its words are written rightly, and one that stands in many texts of its own."""
    clean = "Глагол получает показатель, когда слово значит барабан"
    koi = clean.encode("koi8-r").decode("cp1251")
    rows = [(k, clean) for k in range(3)] + [(100 + k, koi) for k in range(20)] + [(200 + k, f"{koi} text {'abcdefgh'[k]}") for k in range(8)]
    rows += [(k, "나란히 적혀 있다 이름이") for k in (300, 301)] + [(400 + k, f"{'나란히 적혀'.encode('cp949').decode('latin-1')} {k}") for k in range(9)] + [(500, "Глагол получает ШУБА ЛОДКА")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bad = [k for k, _ in rows if 100 <= k < 300 or 400 <= k < 500]
    assert sorted(r[0] for r in E.find_garbled(df, "doc_id", "text").collect()) == bad
    got = {r["doc_id"]: r["restored"] for r in E.restore(df, "doc_id", "text").collect()}
    assert sorted(got) == bad and got[100] == clean and got[400] == "나란히 적혀 0"


def test_short_stretches(spark):
    """A document whose only garbled stretch is one short word; right words and abbreviations of the same letters stay."""
    clean = ["По дороге", "il est nommé là", "une année", "été à la Île", "слово по воде"] * 3
    bad = {100: "text " + "По".encode("cp1251").decode("cp1252"), 101: "il est " + "nommé".encode("cp1252").decode("mac_roman"), 102: "une ann" + "é".encode("cp1252").decode("cp1251") + "e"}
    good = {200: "ПО РП", 201: "NOMMÉ", 202: "5€ été", 203: "Île À la", 204: "по"}
    rows = [*enumerate(clean), *bad.items(), *good.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r[0] for r in E.find_garbled(df, "doc_id", "text").collect()) == sorted(bad)
    got = {r["doc_id"]: r["restored"] for r in E.restore(df, "doc_id", "text").collect()}
    assert got == {100: "text По", 101: "il est nommé", 102: "une année"}
