import json

import pytest
from pyspark.sql import functions as F

from verbarium.functions import classify as C
from verbarium.functions import text as X
from verbarium.operators import etl, graph, retrieval, webtext
from verbarium.plans import runtime
from verbarium.sources import sinks


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expr.alias("o")).orderBy("i").select("o").collect()]


def test_romanize_and_fold(spark):
    assert col(spark, ["halmŏni", "ŋa", "ʔaː", "É", "naïve", None], X.romanize(F.col("v"))) == ["halmoni", "nga", "a", "e", "naive", None]
    assert col(spark, ["/pwa.ˈda/"], X.ipa_key(F.col("v"))) == ["pwada"]
    assert col(spark, ["a bc def"], X.edge_ngrams(X.tokens(F.col("v")))) == [["bc", "de", "def"]]


def test_clean_page(spark):
    got = col(spark, ["Home\nWe use cookies here.\nhttps://x.y/z\nword list, ok\n한글\n\n\n\nText  with   gaps. Skip to content"], X.clean_page(F.col("v")))
    assert got == ["here.\n\nword list, ok\n한글\n\nText with gaps."]


def test_chunks():
    assert X.chunk_text("x" * 10, 10) == ["x" * 10] and X.chunk_text("", 10) == [""]
    assert X.chunk_text("a" * 7 + "\n\n" + "b" * 8, 10) == ["a" * 7, "b" * 8]
    assert X.chunk_text("a\n" + "b" * 20, 10) == ["a\n" + "b" * 8, "b" * 10, "bb"]
    for t in ("ab \n\ncd " * 50, "x" * 101):
        assert "".join("".join(X.chunk_text(t, 20)).split()) == "".join(t.split()) and all(len(c) <= 20 for c in X.chunk_text(t, 20))


def test_script_language(spark):
    lang, conf = C.script_language(C.script_counts(F.col("v")))
    assert col(spark, ["", "한국어 글", "слово", "plain", "하르방 이야기"], lang) == ["en", "ko", "ru", "en", "jje"]
    assert col(spark, ["", "plain"], conf) == [0.0, 1.0]


def test_fuzzy_and_auto(spark):
    assert [retrieval.auto_distance(t) for t in ("ab", "abc", "abcdef")] == [0, 1, 2]
    assert col(spark, ["the harpon", "other", None], retrieval.fuzzy(X.tokens(F.col("v")), "harpoon")) == [True, False, False]


def test_links_and_html(spark):
    page = '<a href="#x">a</a><a href="/p">T <b>b</b></a><a href="/p">again</a><a href="javascript:1">j</a>'
    assert webtext.page_links(page, "https://h.t/q/") == [("https://h.t/p", "T b")]
    title, text, audio = webtext.read_html('<title>T</title><body><nav>n</nav><main>m <p>x</p></main><audio src="a.mp3"></audio><a href="/b.ogg">b</a></body>', "https://h.t/")
    assert (title, text, audio) == ("T", "m x", ["https://h.t/a.mp3", "https://h.t/b.ogg"])
    assert webtext.citations("One fact [1]. Two facts [2][9]. Again [1].", ["u", "v"]) == [("u", "One fact. Again."), ("v", "Two facts.")]
    assert col(spark, ['<t><text start="1">a &amp; b</text> <text>c</text></t>'], webtext.caption_text(F.col("v"))) == ["a & b c"]


def test_graph_paths(spark):
    e = spark.createDataFrame([(1, 2, 1.0, "related"), (2, 1, 0.9, "embedding"), (2, 3, 0.5, "cluster"), (3, 4, 0.7, "embedding"), (1, 5, 1.0, "related"), (5, 4, 1.0, "related"), (7, 7, 1.0, "related")], "a long, b long, weight double, type string")
    u = graph.undirected(e)
    assert {(r["a"], r["b"], r["type"]) for r in u.collect()} == {(1, 2, "related"), (2, 3, "cluster"), (3, 4, "embedding"), (1, 5, "related"), (4, 5, "related")}
    assert graph.shortest_path(u, 1, 4) == [1, 5, 4] and graph.shortest_path(u, 1, 1) == [1] and graph.shortest_path(u, 1, 7) == []
    nodes = spark.createDataFrame([(k,) for k in range(1, 8)], "k long")
    assert {r["k"]: r["degree"] for r in graph.degrees(nodes, u, "k").collect()} == {1: 2, 2: 2, 3: 2, 4: 2, 5: 2, 6: 0, 7: 0}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 0.0]), (4, None)], "k long, v array<double>")
    assert [(r["a"], r["b"]) for r in graph.similar_edges(v, "k", "v").collect()] == [(1, 2)]


def test_language_table(spark, tmp_path):
    (tmp_path / "l.csv").write_text('ID,Name,Macroarea,Latitude,Longitude,Glottocode,ISO639P3code,Level,Countries,Family_ID\n1,Ana,Africa;Asia,1.5,x,ana1,aaa,language,XA; XB,9\n2,Bo,,,,bo1,,language,,\n3,Di,,,,d,,dialect,,\n4,Em,,,,e,,language,,8\n9,Fam,,,,f,,family,,\n')
    (tmp_path / "v.csv").write_text("ID,Language_ID,Parameter_ID,Value,Code_ID\na,1,aes,x,aes-threatened\nb,1,aes,x,aes-extinct\nc,2,aes,x,aes-moribund\nd,4,aes,x,aes-not_endangered\n")
    (tmp_path / "n.csv").write_text("ID,Language_ID,Name,Provider\n1,1, An ,p\n2,1,Ana,p\n3,1,An,p\n4,1,Zed,p\n")
    read = lambda f, c=(): etl.read_csv(spark, str(tmp_path / f), c)
    got = {r["glottocode"]: r for r in etl.language_table(read("l.csv", etl.COLUMNS), read("v.csv"), read("n.csv"), {"XA": ["en"], "XB": ["fr", "en"]}).collect()}
    assert set(got) == {"ana1", "bo1"}
    a, b = got["ana1"], got["bo1"]
    assert (a["endangerment_level"], a["language_family"], a["alternate_names"], a["contact_languages"], a["macroarea"], a["latitude"], a["longitude"]) == (6, "Fam", ["An", "Zed"], ["en", "fr"], "Africa", 1.5, None)
    assert (b["language_family"], b["macroarea"], b["iso_code"], b["countries"]) == ("Isolate", "Unknown", None, [])
    with pytest.raises(ValueError):
        read("n.csv", ("Nope",))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "qaa", [("en", 'x "q"'), ("fr", "y\nz"), ("en", "w")]), ("b", "qab", None)], "id string, language_code string, definitions array<struct<language:string,text:string>>")
    flat = sinks.export_columns(df, "id", ["fr", "en"])
    assert flat.columns == ["id", "definitions_en", "definitions_fr"]
    sinks.write_csv(flat, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, multiLine=True, escape='"')
    assert {tuple(x or "" for x in r) for r in back.collect()} == {("a", 'x "q"; w', "y\nz"), ("b", "", "")}
    assert sinks.write_backup(df, str(tmp_path / "bk"), "n1").first()["total"] == 2
    assert sinks.read_backup(spark, str(tmp_path / "bk"), df.schema).count() == 2
    sinks.switch_version(df, str(tmp_path / "t"), 1)
    sinks.switch_version(df.limit(1), str(tmp_path / "t"), 2)
    assert sinks.read_version(spark, str(tmp_path / "t")).count() == 1
    ring = spark.createDataFrame([([[float(i), i / 3] for i in range(20)],)], "r array<array<double>>").select(etl.simplify_ring(F.col("r"))).first()[0]
    assert ring == [[0.0, 0.0], [8.0, 2.7], [16.0, 5.3], [0.0, 0.0]]
    f = etl.geojson_features(spark.createDataFrame([("g", "n", 1.0, 2.0, None, None, None, None), ("h", "m", None, 2.0, 1, 1, "a", "b")], "glottocode string, name string, latitude double, longitude double, endangerment_level int, speaker_count long, macroarea string, language_family string")).collect()
    assert len(f) == 1 and json.loads(f[0]["feature"])["properties"]["s"] == 0


def test_runtime(spark, tmp_path):
    df = spark.range(10)
    assert runtime.stored(df, "t").count() == 10 and runtime.cut(df).count() == 10
    assert "broadcast" in runtime.small(df, 10)._jdf.queryExecution().toString().lower()
    assert "ResolvedHint" not in runtime.small(df, 9)._jdf.queryExecution().toString()


def test_spread(spark):
    few = spark.range(10)
    assert runtime.spread(few).rdd.getNumPartitions() == runtime.width(spark)
    assert runtime.spread(spark.createDataFrame([(1,)], "a int")).count() == 1


def _score(docs, query):
    """BM25 of word lists, by the published formula."""
    import math

    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    out = []
    for d in docs:
        t = 0.0
        for q in dict.fromkeys(query):
            df = sum(q in x for x in docs)
            tf = d.count(q)
            t += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
        out.append(t)
    return out


def test_entry_search_against_formula(spark):
    ex = "array<struct<target:string,contact:string,english:string>>"
    rows = [
        (1, "fishing net", "fishing net", None, "a net", [("en", "fishing net")], [("t", None, "the net")]),
        (2, "tol", "nets", "/net/", None, [("en", "net of fishing boats"), ("fr", None)], None),
        (3, None, None, None, None, None, []),
        (4, "other", "other", "/o/", "none", [("en", "stone")], [(None, "net", None)]),
    ]
    df = spark.createDataFrame(rows, f"rec_id long, headword_native string, headword_romanized string, ipa string, cultural_context string, definitions array<struct<language:string,text:string>>, example_sentences {ex}")
    got = {r["rec_id"]: r["score"] for r in retrieval.entry_search(df, "rec_id", "fishing net").collect()}
    w = lambda t: (t or "").lower().split()
    pre = lambda t: [x[:k] for x in w(t) for k in range(2, min(15, len(x)) + 1)]
    q = ["fishing", "net"]
    nested = lambda r, at, f: [x for e in r[at] or [] for x in w(e[f])]
    ipa = lambda t: [t.replace("/", "")] if t is not None else [None]
    clauses = [([[r[1]] for r in rows], ["fishing net"], 3), ([w(r[1]) for r in rows], q, 2), ([pre(r[1]) for r in rows], q, 1.5), ([[r[2]] for r in rows], ["fishing net"], 3), ([w(r[2]) for r in rows], q, 2),
               ([w(r[2]) for r in rows], q, 2.5), ([ipa(r[3]) for r in rows], ["fishing net"], 1.5), ([w(r[4]) for r in rows], q, 1)]
    best = [max(c[k] for c in [[s * b for s in _score(d, qq)] for d, qq, b in clauses]) for k in range(4)]
    rest = [(_score([w(r[2]) for r in rows], q), 3.5), (_score([nested(r, 5, 1) for r in rows], q), 2), (_score([nested(r, 6, 0) for r in rows], q), 1.5), (_score([nested(r, 6, 1) for r in rows], q), 1.5), (_score([nested(r, 6, 2) for r in rows], q), 1)]
    want = {r[0]: best[k] + sum(s[k] * b for s, b in rest) for k, r in enumerate(rows)}
    assert got == {k: pytest.approx(v) for k, v in want.items() if v > 0}


def test_rank_fusion_ignores_list_order(spark):
    a = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 1.0)], "k long, score double")
    b = spark.createDataFrame([(3, 9.0), (4, 8.0)], "k long, score double")
    one = {r["k"]: r["rrf"] for r in retrieval.rank_fusion([a, b], "k").collect()}
    assert one == pytest.approx({1: 1 / 21, 2: 1 / 22, 3: 1 / 23 + 1 / 21, 4: 1 / 22})
    assert {r["k"]: r["rrf"] for r in retrieval.rank_fusion([b, a], "k").collect()} == pytest.approx(one)


def test_fuzzy_join_against_all_pairs(spark):
    words = ["loom", "room", "boom", "lamp", "lamps", "clamp", "a", "ab", "stone", "stoen", "atone", "", "x"]
    df = spark.createDataFrame([(w,) for w in words] + [(None,), ("loom",)], "w string")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    for d in (1, 2):
        got = {tuple(r) for r in retrieval.fuzzy_join(df, df, "w", d).select("w_l", "w_r").collect()}
        assert got == {(a, b) for a in words for b in words if lev(a, b) <= d}


def test_fuzzy_join_of_one_table_shuffles_its_forms_once(spark):
    """The forms, larger than their estimate, are neither broadcast nor made twice; pairs stay inside their scope."""
    words = [("x", "loom"), ("x", "room"), ("y", "loom"), ("y", "lamp"), ("y", "lamps"), ("x", ""), ("y", "a"), (None, "loom"), ("x", None)]
    df = spark.createDataFrame(words, "s string, w string")
    for d in (1, 2):
        pairs = retrieval.fuzzy_join(df, df, "w", d, "s")
        got = {(r["s_l"], r["w_l"], r["w_r"]) for r in pairs.collect()}
        same = {(s, w, w) for s, w in words if s and w is not None}
        assert got == same | {("x", "loom", "room"), ("x", "room", "loom"), ("y", "lamp", "lamps"), ("y", "lamps", "lamp")}
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "ReusedExchange" in plan


def test_fuzzy_queries_take_every_word(spark, tmp_path):
    """Short, long, accented and foreign words and headwords, against all pairs."""
    from verbarium.queries import search

    texts = {"en": "an ax fisherwoman fisherwomen café cafe", "ru": "лодка лодки", "fr": "pêcheur pêcheurs"}
    heads = ["ka", "kä", "tse mi lo karu", "tse mi lo kar", "слово", "слова", None]
    rows = [(h, [(k, t) for k, t in texts.items()]) for h in heads]
    spark.createDataFrame(rows, "headword_native string, definitions array<struct<language string, text string>>").write.parquet(str(tmp_path / "vocabulary.parquet"))

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    for name, words in (("fuzzy_definition_join", " ".join(texts.values()).split()), ("fuzzy_headword_join", [h for h in heads if h])):
        got = sorted(tuple(r) for r in search.QUERIES[name](spark, str(tmp_path)).select("a", "b").collect())
        assert got and got == sorted((a, b) for a in words for b in words if a < b and lev(a, b) <= 2)


def test_chunk_contents_takes_whole_texts(spark, tmp_path):
    from verbarium.queries import text

    content = "\n".join(f"line {i}" for i in range(30_000))
    spark.createDataFrame([(1, content), (2, "short"), (3, None)], "crawl_id long, content string").write.parquet(str(tmp_path / "crawl_results.parquet"))
    rows = text.QUERIES["chunk_contents"](spark, str(tmp_path)).collect()
    n = [r["n"] for r in rows if r["crawl_id"] == 1]
    assert len(content) > 200_000 and sum(n) + len(n) - 1 == len(content) and {r["crawl_id"] for r in rows} == {1, 2}
