import os
import random

import pytest

from verbarium.llm import mixing as M

TARGETS = "source string, target_share double, max_repeats int"


def docs(spark, n=600, seed=1):
    rnd = random.Random(seed)
    src = ["big"] * 20 + ["mid"] * 6 + ["small"]
    rows = [(k, rnd.choice(src), "word " * rnd.randrange(1, 60), "x") for k in range(n)]
    rows += [(9001, None, "word", "x"), (9002, "other", "word", "x"), (9003, "big", None, "x"), (9004, "big", "", "x")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, tokens string")


def test_water_fill():
    def run(items, budget):
        return [a.given for a in M.water_fill([M.Allotment(str(i), *x) for i, x in enumerate(items)], budget)]

    assert run([(0.5, 100, 100), (0.5, 100, 100)], 100) == [50, 50]
    assert run([(0.5, 10, 20), (0.25, 100, 100), (0.25, 100, 100)], 100) == [20, 40, 40]
    assert run([(0.5, 10, 20), (0.5, 10, 30)], 100) == [20, 30]
    assert run([(0.0, 10, 20), (1.0, 0, 0)], 100) == [0, 0]
    assert run([(0.6, 10, 10), (0.3, 20, 40), (0.1, 100, 100)], 100) == [10, 40, 50]


def test_mix_meets_targets(spark):
    d = docs(spark)
    t = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.35, 3), ("small", 0.25, 2), ("none", 0.1, 5)], TARGETS)
    sel, shares = M.mix(d, "doc_id", "source", "text", t, seed=3)
    got = {r["source"]: r for r in shares.collect()}
    size = {r[0]: r[1] for r in M.token_counts(d, ["source"], "text").groupBy("source").sum("tokens").collect()}
    for s in ("big", "mid", "small"):
        r = got[s]
        assert r["tokens_available"] == size[s] and abs(r["tokens_taken"] - r["tokens_allotted"]) <= 120
        assert r["passes"] <= {"big": 1, "mid": 3, "small": 2}[s] + 1e-9
    assert got["none"]["tokens_taken"] == 0 and abs(sum(r["share_reached"] for r in got.values()) - 1) < 1e-9
    rows = sel.collect()
    assert sum(r["tokens"] * r["copies"] for r in rows) == sum(r["tokens_taken"] for r in got.values())
    assert {r["source"] for r in rows} <= {"big", "mid", "small"}
    whole = got["small"]["tokens_allotted"] // size["small"]
    assert {r["copies"] for r in rows if r["source"] == "small"} <= {whole, whole + 1}
    assert M.expand(sel).count() == sum(r["copies"] for r in rows)


def test_seed_and_budget(spark):
    d = docs(spark)
    t = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    pick = lambda s: sorted(r["doc_id"] for r in M.mix(d, "doc_id", "source", "text", t, budget=2000, seed=s)[0].collect())
    assert pick(1) == pick(1) != pick(2)
    r = M.mix(d, "doc_id", "source", "text", t, budget=2000)[1].first()
    assert abs(r["tokens_taken"] - 2000) <= 120


def test_whole_long_text_and_empty(spark):
    d = spark.createDataFrame([(1, "s", "a" * 300_000 + " b")], "doc_id long, source string, text string")
    assert M.token_counts(d, ["doc_id"], "text").first()["tokens"] > 1000
    t = spark.createDataFrame([("s", None, None), (None, 0.5, 1)], TARGETS)
    sel, shares = M.mix(d, "doc_id", "source", "text", t)
    assert sel.count() == 0 and shares.count() == 1
    sel, shares = M.mix(d.limit(0), "doc_id", "source", "text", spark.createDataFrame([("s", 1.0, 1)], TARGETS))
    assert sel.count() == 0 and shares.first()["share_reached"] == 0
    with pytest.raises(ValueError):
        M.mix(d, "doc_id", "source", "text", spark.createDataFrame([("s", 1.0, 1), ("s", 0.5, 1)], TARGETS))


def test_counts_agree_with_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(M.tokenizer_file())
    texts = ["The plural is formed.", "слово значит", "이름이", "<|endoftext|>", "  ", "naïve\n\ncafé"]
    got = {r["doc_id"]: r["tokens"] for r in M.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string"), ["doc_id"], "t").collect()}
    tok.encode_special_tokens = True
    assert [got[i] for i in range(len(texts))] == [len(tok.encode(t, add_special_tokens=False)) for t in texts]
    assert os.path.exists(M.tokenizer_file("byte_bpe_50k.tiktoken"))
