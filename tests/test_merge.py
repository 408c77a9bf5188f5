import random

from pyspark.sql import functions as F

from verbarium.operators import merge as M

S = ("id string, rec_id long, headword_native string, headword_romanized string, pos string, audio_url string, ipa string, semantic_cluster string, cultural_context string, "
     "grammar_notes string, language_code string, glottocode string, language_name string, pronunciation_video_url string, morphology struct<root:string>, usage struct<register:string>, "
     "language_confidence string, created_at timestamp, definitions array<struct<language:string,text:string>>, example_sentences array<struct<target:string,english:string>>, "
     "conjugations array<struct<form:string,native:string>>, cross_references array<struct<source_url:string,reliability_score:double>>, related_terms array<string>")  # fmt: skip
RANK = {"low": 1, "medium": 2, "high": 3}


def rows(n, seed):
    r = random.Random(seed)
    pick = lambda *x: r.choice(x)
    arr = lambda f: pick(None, [f() for _ in range(r.randrange(4))], [f() for _ in range(r.randrange(4))])
    out = []
    for k in range(n):
        out.append(
            (f"e{r.randrange(6)}", k, pick("h", "h", " ", None), pick("r1", "r2", "", None), pick("noun", None), pick("a", "", None), pick("i", "", None), pick("c", "", None), pick("x", None),
             pick("g", ""), "qaa", pick("q", None), "n", pick(None, "v"), pick(None, ("m",)), pick(None, ("u",)), pick(None, "low", "medium", "high", "odd"), None,
             arr(lambda: (pick("en", "fr"), pick("a", "b", None))), arr(lambda: (pick("t1", "t2", None), "e")), arr(lambda: (pick("past", "fut"), "n")),
             arr(lambda: (pick("u1", "u2"), pick(None, 0.1, 0.5, 0.9))), arr(lambda: pick("x", "y", "z")))
        )
    return out


def fold(own):
    """The rules, one version after the other."""
    name = [c.split()[0] for c in S.replace("struct<language:string,text:string>", "").split(", ")]
    cur = None
    for row in own:
        v = dict(zip(name, row))
        if cur is None:
            cur = {k: (list(x) if isinstance(x, list) else x) for k, x in v.items()}
            cur["source_count"] = len(v["cross_references"] or [])
            continue
        for a, key in (("definitions", lambda x: f"{x[0]}::{x[1]}" if x[1] is not None else x[0]), ("example_sentences", lambda x: x[0]), ("conjugations", lambda x: x[0]), ("cross_references", lambda x: x[0])):
            have = cur[a] or []
            seen = {key(x) for x in have}
            for x in v[a] or []:
                if key(x) not in seen:
                    have.append(x)
                    seen.add(key(x))
            cur[a] = have or None
        for f in ("headword_romanized", "audio_url", "ipa", "grammar_notes", "glottocode", "pronunciation_video_url"):
            if v[f]:
                cur[f] = v[f]
        for f in ("semantic_cluster", "cultural_context", "morphology", "usage", "pos"):
            if v[f] is not None:
                cur[f] = v[f]
        c = v["language_confidence"]
        if c is not None and (cur["language_confidence"] is None or RANK.get(c, 0) > RANK.get(cur["language_confidence"], 0)):
            cur["language_confidence"] = c
        offered = {u: s for u, s in v["cross_references"] or [] if s is not None}
        cur["cross_references"] = [(u, max([s for s in (s, offered.get(u)) if s is not None], default=None)) for u, s in cur["cross_references"] or []] or None
        cur["related_terms"] = sorted({*(cur["related_terms"] or []), *(v["related_terms"] or [])}) or None
    cur["related_terms"] = sorted(set(cur["related_terms"] or [])) or None
    cur["source_count"] = len(cur["cross_references"] or [])
    return cur


def test_fold(spark):
    for seed in range(3):
        data = rows(60, seed)
        got = {r["id"]: r.asDict(recursive=True) for r in M.merge_entries(spark.createDataFrame(data, S)).collect()}
        live = [x for x in data if (x[2] or "").strip()]
        assert set(got) == {x[0] for x in live}
        for i in got:
            want = fold([x for x in live if x[0] == i])
            g = got[i]
            for f in ("headword_romanized", "audio_url", "ipa", "semantic_cluster", "language_confidence", "source_count", "glottocode"):
                assert g[f] == want[f], (i, f)
            assert [tuple(x.values()) for x in g["definitions"] or []] == (want["definitions"] or [])
            assert [x["target"] for x in g["example_sentences"] or []] == [x[0] for x in want["example_sentences"] or []]
            assert [tuple(x.values()) for x in g["cross_references"] or []] == (want["cross_references"] or [])
            assert (g["related_terms"] or []) == (want["related_terms"] or [])


def test_idempotent_upsert(spark):
    df = spark.createDataFrame(rows(40, 9), S)
    once = M.merge_entries(df)
    again = M.upsert(once.withColumn("rec_id", F.lit(0)).drop("source_count"), df.limit(0), "id", "rec_id")
    key = lambda d: sorted((r["id"], r["source_count"], r["headword_romanized"] or "") for r in d.collect())
    assert key(once) == key(again)
