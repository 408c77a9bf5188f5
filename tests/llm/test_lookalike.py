import random
import unicodedata

import pytest

from verbarium.llm import lookalike as L


@pytest.mark.parametrize(
    "a, b",
    [
        ("ｆｕｌｌ", "full"), ("café", "café"), ("caf​é", "café"), ("e​́", "é"), ("сора", "copa"), ("a\xa0b　", "a b"),
        ("ﬁn", "fin"), ("난", "난"), ("ս̈", "ü"), ("me'a", "meʼa"), ("ё", "ë"), ("﻿x⁠", "x"),
    ],
)
def test_same(a, b):
    assert L.look_key(a) == L.look_key(b)


@pytest.mark.parametrize("a, b", [("sin", "sỉn"), ("a", "á"), ("A", "a"), ("colour", "color"), ("ӣ", "ѝ"), ("l", "1")])
def test_differ(a, b):
    assert L.look_key(a) != L.look_key(b)


def test_segments_equal_whole_text_and_idempotent():
    rnd = random.Random(1)
    pool = list("abce éñ아난") + ["́", "̈", "̣", "​", "ａ", "ﬁ", "с", "х", "ʼ", "'", "\xa0", "ở", "Å", "ẛ"]
    for _ in range(3000):
        s = "".join(rnd.choices(pool, k=rnd.randrange(12)))
        whole = " ".join(L._form(s, L.LOOKALIKE).split())
        assert L.look_key(s) == whole, ascii(s)
        assert L.look_key(whole) == whole
        assert unicodedata.is_normalized("NFC", whole)


@pytest.mark.parametrize(
    "raw, text",
    [("хорошо", "хорошо"), ("Москва", "Москва"), ("νερό", "νερό"), ("Mосква", "Москва"), ("xoрoшo", "хорошо"), ("hоuse", "house"), ("ｆｕｌｌ e​́ сор", "full é сор"), ("a  b", "a b"), ("Zж", "Zж")],
)
def test_canonical_text_keeps_its_script(raw, text):
    assert L.canonical(raw) == text and L.canonical(text) == text and L.look_key(raw) == L.look_key(text)


def test_classes(spark):
    rows = [(1, "x", "сор"), (2, "x", "cop"), (3, "x", "cop"), (4, "x", "dog"), (5, "y", "сор"), (6, None, "cop"), (7, "x", None), (2, "x", "cop")]
    df = spark.createDataFrame(rows, "rec_id long, language_code string, w string")
    got = {r["rec_id"]: (r["class"], r["links"]) for r in L.same_look_classes(df, "rec_id", "language_code", {"w": "w"}).collect()}
    assert {k: n for k, (_, n) in got.items()} == {1: 2, 2: 1, 3: 1} and len({c for c, _ in got.values()}) == 1
    assert L.same_look_classes(df.limit(0), "rec_id", "language_code", {"w": "w"}).count() == 0


def test_empty_and_long():
    assert L.canonical(None) is None and L.canonical(" ​ ") == ""
    assert L.look_key(None) is None and L.look_key(" ​\xa0") == ""
    assert L.look_key("é" * 200_000 + "ａ") == "é" * 200_000 + "a"


def test_pairs_against_brute_force(spark):
    rnd = random.Random(2)
    rows = []
    for k in range(120):
        word = rnd.choice(["copa", "сора", "ｃopa", "copá", "sin", "si​n", "  ", None])
        ex = [None if rnd.random() < 0.1 else (rnd.choice(["a b", "a\xa0b", "A b", ""]),) for _ in range(rnd.randrange(3))]
        rows.append((k, rnd.choice(["x", "y", None]), word, ex, "clash"))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "rec_id long, language_code string, headword_native string, ex array<struct<target:string>>, raw string")
    want = set()
    for f in ("h", "t"):
        for a in rows:
            for b in rows:
                va = [a[2]] if f == "h" else [e[0] for e in a[3] if e]
                vb = [b[2]] if f == "h" else [e[0] for e in b[3] if e]
                if a[0] < b[0] and a[1] and a[1] == b[1] and any(x and y and x != y and L.look_key(x) and L.look_key(x) == L.look_key(y) for x in va for y in vb):
                    want.add((f, a[0], b[0]))
    for size in (5000, 3):
        got = [tuple(r) for r in L.same_look_pairs(df, "rec_id", "language_code", {"h": "headword_native", "t": "ex.target"}, size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert L.same_look_pairs(df.limit(0), "rec_id", "language_code", {"h": "headword_native"}).count() == 0


def test_canonicalise(spark):
    df = spark.createDataFrame([(1, "ｘ"), (2, None)], "id long, t string")
    assert [r["f"] for r in L.canonicalise(df, {"t": "f"}).orderBy("id").collect()] == ["x", None]
    with pytest.raises(ValueError):
        L.canonicalise(df, {"t": "id"})


def test_canonical_query_takes_headwords_and_sentences(spark, tmp_path):
    """Equal-looking headwords and sentences of every row get one key; nulls and blanks keep their places."""
    from verbarium.llm import queries

    rows = [(1, "сор", [("a\xa0b", "n"), (None, "n"), ("Mосква", "n")]), (2, "cop", [("a b", "n"), None, (" ", "n")]), (3, None, []), (4, "", None)]
    spark.createDataFrame(rows, "rec_id long, headword_native string, example_sentences array<struct<target: string, contact: string>>").write.parquet(str(tmp_path / "vocabulary.parquet"))
    got = {r["rec_id"]: r for r in queries.p3_canonical(spark, str(tmp_path)).collect()}
    assert {k: (r["headword_form"], r["headword_form_key"]) for k, r in got.items()} == {1: ("сор", "cop"), 2: ("cop", "cop"), 3: (None, None), 4: ("", "")}
    assert {k: r["target_form"] for k, r in got.items()} == {1: ["a b", None, "Москва"], 2: ["a b", None, ""], 3: [], 4: None}
    assert {k: r["target_form_key"] for k, r in got.items()} == {1: ["a b", None, L.look_key("Москва")], 2: ["a b", None, ""], 3: [], 4: None}
    assert got[1]["target"] == ["a\xa0b", None, "Mосква"]
