"""Operators of the archive on small cases: nulls, empty tables, ties, copies, clashing names."""

import random

from pyspark.sql import functions as F

from verbarium.functions import classify as C
from verbarium.functions import media
from verbarium.functions import text as X
from verbarium.operators import archive as A
from verbarium.operators import graph as G
from verbarium.operators import merge as M
from verbarium.operators import nested
from verbarium.operators import retrieval as R


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_boolean(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 5), (3, "b", None), (4, "a", 1)], "k int, t string, n int")
    assert rows(A.boolean(df, must=[F.col("t") == "a"], should=[F.col("n") > 3, F.col("k") == 4], least=1).select("k")) == [(1,), (4,)]
    assert rows(A.boolean(df, must_not=[F.col("t") == "a"]).select("k")) == [(2,), (3,)]


def test_verified_equals_containment(spark):
    e = spark.createDataFrame([("g", w, [(t,)]) for w, t in [("ab", "x"), ("b c", "x"), ("zz", " "), (None, "x"), (" ", "x"), ("c", "x"), ("de f", None), ("ab", "y")]], "glottocode string, headword_native string, definitions array<struct<text:string>>")
    d = spark.createDataFrame([(1, "g", "cab b  c"), (2, "g", "xb cx ab"), (3, "h", "ab"), (4, "g", None), (5, "g", ""), (6, "g", "ab" * 3000)], "doc_id long, glottocode string, text string")
    assert rows(A.verified(e, d, "glottocode", "doc_id", "text")) == [(1, "ab"), (1, "c"), (2, "ab"), (2, "b c"), (2, "c"), (6, "ab")]
    assert A.verified(e.limit(0), d, "glottocode", "doc_id", "text").count() == 0


def test_clips_in_three_stages(spark):
    v = [(1, "clip", "Kalo ", "u1"), (2, "clip", "mirat", "u2"), (3, "clip", "mirat", "u0"), (4, "KALO", None, None), (5, "x", "kalo", ""), (6, "miraz", None, None), (7, "far away", None, None), (8, "k", None, None), (9, None, None, None), (10, "café", None, None), (11, "c", "café", "u3")]
    df = spark.createDataFrame(v, "rec_id long, headword_native string, headword_romanized string, audio_url string")
    assert rows(A.match_clips(df, "rec_id")) == [(10, "u3", "native"), (4, "u1", "native"), (5, "u1", "romanized"), (6, "u0", "fuzzy")]
    assert A.match_clips(df.limit(0), "rec_id").count() == 0


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_clips_against_all_pairs_without_broadcast_forms(spark):
    """Words of 0 to 12 letters in each band of edits; the tables of forms, larger than their estimate, are not broadcast."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abé", k=rnd.randrange(13)))
    heads, clips = {word() for _ in range(250)} - {"", "a"}, {word() for _ in range(60)} - {""}
    heads |= {c[:1] + "x" + c[2:-1] + "y" for c in clips} | {"z" + c + "zz" for c in clips}
    df = spark.createDataFrame([(i, h, None, None) for i, h in enumerate(sorted(heads))] + [(1000 + i, None, c, f"u{c}") for i, c in enumerate(sorted(clips))], "rec_id long, headword_native string, headword_romanized string, audio_url string")
    want = []
    for i, h in enumerate(sorted(heads)):
        most = 1 if len(h) <= 3 else 2 if len(h) <= 6 else 3
        near = [(_lev(h, c), c) for c in clips if _lev(h, c) <= most]
        if near and len(h) > 1 or h in clips:
            want.append((i, f"u{min(near)[1]}", "native" if h in clips else "fuzzy"))
    got = A.match_clips(df, "rec_id")
    assert rows(got) == sorted(want, key=str) and {w[2] for w in want} == {"native", "fuzzy"}
    words = df.where("headword_native is not null").select(F.col("headword_native").alias("w"))
    pairs = R.fuzzy_join(words, words, "w", 3)
    assert {tuple(r) for r in pairs.collect()} == {(a, b) for a in heads for b in heads if _lev(a, b) <= 3}
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_updates_and_unions(spark):
    df = spark.createDataFrame([("a", (1, None), "n"), ("b", None, "n"), (None, (3, "z"), "n")], "k string, s struct<x:int,y:string>, x string")
    new = spark.createDataFrame([("a", 9, None), ("b", None, "q"), ("c", 1, "c")], "k string, x int, y string")
    assert rows(A.update_nested(df, new, "k", "s", ["x", "y"]).select("k", "s.x", "s.y")) == [("a", 9, None), ("b", None, "q"), (None, 3, "z")]
    one = spark.createDataFrame([("u", 1), ("v", 2)], "url string, n int")
    assert rows(A.union_first([one, spark.createDataFrame([("v", 7), ("w", 8), ("w", 8)], "url string, n int")], "url").select("url", "rank", "n")) == [("u", 1, 1), ("v", 1, 2), ("w", 2, 8)]
    t = spark.createDataFrame([(1, "u", "a" * 300), (2, "u", "a" * 300 + "b"), (3, "u", "c"), (4, "v", "a" * 300)], "k int, url string, t string")
    assert rows(A.first_of_alike(t, ["url"], "t", "k").select("k")) == [(1,), (3,), (4,)]
    m = spark.createDataFrame([("## Title here\nrest of it", "u"), ("plain first\n# Later", "u"), ("no", "u"), (None, "u")], "t string, url string")
    assert rows(A.markdown_titles(m, "t", "url", 5).select("title")) == [("Later",), ("Title here",)]


def test_references_and_merge_of_grammar(spark):
    ref = "array<struct<source_title:string,source_url:string,source_type:string,definition:string,notes:string,reliability_score:double>>"
    df = spark.createDataFrame([([("t", "u", "wiki", None, None, 0.5)], ["u", "w"]), (None, ["u"]), (None, None), ([], [])], f"refs {ref}, urls array<string>")
    assert [[x["source_url"] for x in r[0]] for r in df.select(A.append_references(F.col("refs"), F.col("urls"))).collect()] == [["u", "w"], ["u"], [], []]
    g = "id string, seq int, title string, title_native string, category string, description string, rule string, examples array<struct<target:string,english:string>>, related_vocabulary array<string>, differences_from_contact string, source_urls array<string>, confidence string, language_code string, created_at timestamp"
    two = [("g", 1, "T", None, "c", "old", "r", [("a", "1")], ["x"], "d", ["u"], "high", "q", None), ("g", 2, "T", None, None, "new", "", [("a", "2"), ("b", "3"), None], ["y", "x"], None, None, "low", "q", None)]
    got = M.merge_grammar(spark.createDataFrame(two, g)).first()
    assert (got["description"], got["rule"], got["differences_from_contact"], got["confidence"], got["category"]) == ("new", "r", "d", "high", "c")
    assert [tuple(e) for e in got["examples"]] == [("a", "1"), ("b", "3")] and got["related_vocabulary"] == ["x", "y"] and got["source_urls"] == ["u"]


def test_graph_views(spark):
    long = [(k, k + 1) for k in range(30)]
    e = spark.createDataFrame(long + [(40, 41)], "a long, b long")
    assert G.shortest_path(e, 0, 30) == list(range(31)) and G.shortest_path(e, 0, 41) == []
    n = spark.createDataFrame([(k, "w", None, "c" if k < 3 else "", [("fr", "f"), ("en", "x" * 100)] if k else None, [1.0 * k + 1, 1.0]) for k in range(6)], "k long, headword_native string, headword_romanized string, semantic_cluster string, definitions array<struct<language:string,text:string>>, v array<double>").withColumn("cross_references", F.array(F.lit(1)))
    few = e.where("b < 6")
    assert rows(G.adjacency(few, "k").where("k = 1")) == [(1, 0), (1, 2)]
    own, inner = G.induced(n, few, "k", F.col("semantic_cluster") == "c")
    assert own.count() == 3 and rows(inner) == [(0, 1), (1, 2)]
    got = {r["k"]: r for r in G.project(n, few, "k").collect()}
    assert got[0]["definition"] is None and len(got[1]["definition"]) == 80 and got[5]["cluster"] == "uncategorized" and got[1]["degree"] == 2
    ids, edges = G.neighbourhood_graph(n, few, spark.createDataFrame([(0,)], "k long"), "k", "v", depth=1, most=4)
    assert {r["k"]: r["hops"] for r in ids.collect()} == {0: 0, 1: 1, 2: None, 3: None} and edges.count() == 3


def test_rerank_and_search(spark):
    best = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 5), (3, 0.7, None), (4, 0.6, 9)], "k int, score double, n int")
    assert [r["k"] for r in R.rerank(best, "k", F.col("n"), window=3, k=3).collect()] == [2, 1, 3]
    v = spark.createDataFrame([(k, "net" if k < 2 else "other", "c" if k < 4 else "d", [1.0, float(k)]) for k in range(6)], "rec_id long, headword_native string, semantic_cluster string, embedding array<double>")
    v = v.withColumns({c: F.lit(None).cast("string") for c in ("headword_romanized", "ipa", "cultural_context")}).withColumns({"definitions": F.expr("cast(null as array<struct<text:string>>)"), "example_sentences": F.expr("cast(null as array<struct<target:string,contact:string,english:string>>)")})
    got = R.search(v, "rec_id", "net", "embedding", [1.0, 0.0], "semantic_cluster", k=3, window=2).orderBy("pos").collect()
    assert [(r["rec_id"], r["kind"]) for r in got] == [(0, "hit"), (1, "hit"), (2, "cluster")]


def test_extracted_rows(spark):
    import json

    p = json.dumps({"entries": [{"headword_native": " x ", "pos": "Noun", "definitions": ["a", "", {"text": "b"}]}, {"headword_native": "y"}, {"pos": "verb"}, "junk"]})
    raw = spark.createDataFrame([(1, p, "u", "qaa"), (2, "{", "u", "qaa"), (3, None, None, None)], "raw_id long, payload string, url string, language_code string")
    got = A.extracted_entries(nested.flatten_payloads(raw, "raw_id", "payload"), raw.drop("payload"), "raw_id").collect()
    assert [(r["raw_id"], r["headword_native"], r["pos"], r["n_definitions"], r["language_confidence"]) for r in got] == [(1, "x", "noun", 2, "medium")]


def test_small_functions(spark):
    df = spark.createDataFrame([(["Klingon", "Korean"], "qaa", 10, 1500, 59999), (None, "pt", 61, 2_000_000, 61000), ([], None, None, None, None)], "c array<string>, code string, t int, n long, ms long")
    got = df.select(media.speech_language(F.col("c"), F.col("code")), media.byte_size(F.col("n")), media.duration(F.col("ms")), media.chunk_of(F.col("t"), 2)).collect()
    assert [tuple(r) for r in got] == [("ko", "1.5 KB", "59s", 0), ("pt", "1.9 MB", "1m 1s", 1), ("en", None, None, None)] or [tuple(r)[:3] for r in got] == [("ko", "1.5 KB", "59s"), ("pt", "1.9 MB", "1m 1s"), ("en", None, None)]
    t = spark.createDataFrame([("deixis", ""), ("a verb form", ""), ("", "kada"), ("", "ka-"), ("", "x")], "c string, w string")
    assert [r[0] for r in t.select(C.infer_pos(F.col("c"), F.col("w"))).collect()] == ["pronoun", "verb", "verb", "verb", "unknown"]
    assert C.TIERS[1] == spark.createDataFrame([("https://www.jstor.org/x",)], "u string").select(C.domain_tier(F.col("u"))).first()[0]
    lines = spark.createDataFrame([("Home",), (" ",), ("https://a.b/c",), ("Two words, here",), ("한글",)], "l string")
    assert [r[0] for r in lines.select(X.line_class(F.col("l"))).collect()] == ["stub", "blank", "address", "text", "text"]
    A.register_functions(spark)
    assert tuple(spark.sql("SELECT verbarium_slug('A b'), verbarium_confidence('high'), verbarium_video_id('https://youtu.be/abcdefghijk')").first()) == ("a-b", 3, "abcdefghijk")
