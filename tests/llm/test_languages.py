import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbarium.llm import languages as L

SYL = {"aa": ["ka", "lo", "mi"], "bb": ["tse", "ru", "gon"], "cc": ["ши", "ва", "лок"]}


def sentence(rnd, lang, n=7):
    return " ".join("".join(rnd.choices(SYL[lang], k=rnd.randrange(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def samples(spark):
    rnd = random.Random(1)
    rows = [(lang, " ".join(sentence(rnd, lang) for _ in range(3))) for lang in SYL for _ in range(20)]
    return spark.createDataFrame([*rows, (None, "x"), ("aa", None)], "lang string, text string")


def test_held_out_runs_and_faults(spark, samples):
    rnd = random.Random(2)
    rows, want = [], set()
    for k in range(80):
        langs = [rnd.choice(list(SYL))]
        while rnd.random() < 0.4:
            langs.append(rnd.choice([x for x in SYL if x != langs[-1]]))
        text = "\n".join(" ".join(sentence(rnd, x) for _ in range(rnd.randrange(1, 4))) for x in langs)
        if k % 4 == 0:
            text = "Home | Maps | Help\n" + text.replace(".", ", “kalo”.", 1) + "\nkalo — tsegon"
        label = rnd.choice([None, "und", langs[0], langs[0].upper(), langs[0] + "-XX", "aa", "Gamma"])
        rows.append((k, text, label, 0))
        code = {"Gamma": "cc"}.get(label, (label or "").lower()[:2] if label != "und" else "")
        if len(langs) > 1 or code != langs[0]:
            want |= {(k, i, x) for i, x in enumerate(langs)}
    rows += [(100, None, "aa", 0), (101, "", "aa", 0), (102, "12 - 7", "aa", 0), rows[0], (103, sentence(rnd, "aa") * 3000, "aa", 0)]
    df = spark.createDataFrame(rows, "crawl_id long, content string, label string, doc int")
    names = spark.createDataFrame([("cc", "Gamma"), (None, "x")], "code string, name string")
    got = [tuple(r) for r in L.faulty_labels(df, "crawl_id", "content", "label", samples, "lang", "text", names).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_confidence_and_empty(spark, samples):
    m = L.fit(samples, "lang", "text", per_language=10)
    assert m.names == ["aa", "bb", "cc"]
    df = spark.createDataFrame([(1, "Kalo mika lomi kami. Rutse gonru tserugon rugon gontse. X.")], "id long, t string")
    out = L.segments(df, "id", "t", m).orderBy("seg_pos").collect()
    assert [r["lang"] for r in out] == ["aa", "bb"] and all(0 < r["confidence"] <= 1 for r in out)
    assert L.segments(df.limit(0), "id", "t", m).count() == 0


def test_batch_score_equals_single(samples):
    m = L.fit(samples, "lang", "text")
    items = ["Kalo mi.", "a", "Шива локва.", "", "x" * 5000, "rutse gon"]
    whole, n = m.score(items)
    parts = [m.score([i]) for i in items]
    assert np.allclose(whole, np.vstack([p[0] for p in parts])) and np.allclose(n, np.concatenate([p[1] for p in parts]))
    assert np.allclose(m.score(items, chars=3)[0], whole)


def test_labels(spark):
    said = ["en", "EN", "eng", "English", "en-US", "pt_BR", "und", "", None, "xx", "Español", "qaa", "Klingon", "Kalo", "English"]
    df = spark.createDataFrame(list(enumerate(said)), "k int, label string")
    names = spark.createDataFrame([("qaa", "Kalo"), ("qab", "kalo "), ("zz", "english"), (None, "x"), ("qac", None)], "code string, name string")
    got = [r["code"] for r in L.label_codes(df, L.notation_table(spark, names)).orderBy("k").collect()]
    assert got == ["en", "en", "en", "en", "en", "pt", None, None, None, None, "es", "qaa", "klingon", "qaa", "en"]


def test_model_size_is_checked(samples, monkeypatch):
    monkeypatch.setattr(L, "MODEL_BYTES", 1000)
    with pytest.raises(ValueError, match="fewer bits"):
        L.fit(samples, "lang", "text")
