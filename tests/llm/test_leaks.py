import random
import re

from verbarium.llm import leaks


def brute(docs, items, n):
    def tok(t):
        return re.findall(r"[^\W_]+", t.lower())

    out = set()
    for i, it in items:
        a = tok(it or "")
        grams = {tuple(a[k : k + n]) for k in range(len(a) - n + 1)}
        for d, t in docs:
            b = tok(t or "")
            if any(tuple(b[k : k + n]) in grams for k in range(len(b) - n + 1)):
                out.add((i, d))
    return out


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item long"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def test_against_brute_force(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choices(vocab, k=30))) for i in range(6)]
    docs = []
    for d in range(60):
        t = rnd.choices(vocab, k=20)
        if d % 3 == 0:
            src = items[d % 6][1].split()
            at, n = rnd.randrange(20), rnd.choice([6, 7, 8, 9, 12])
            t += [f"**{w.upper()}**," for w in src[at : at + n]] + rnd.choices(vocab, k=5)
        docs.append((d, "\n ".join(t)))
    docs += [(90, None), (91, ""), (92, items[0][1]), (92, items[0][1]), (93, "x " * 30000 + items[1][1])]
    items += [(7, None), (8, "too short"), (0, items[0][1])]
    d, i = frames(spark, docs, items)
    got = [tuple(r) for r in leaks.find_leaks(d, "doc_id", "text", i, "item_id", "text", 8).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items, 8)


def test_report_kinds(spark):
    words = [f"t{i}" for i in range(30)]
    changed = [w if k not in (14, 22) else "other" for k, w in enumerate(words)]
    d, i = frames(spark, [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[:13]))], [(5, " ".join(words))])
    got = {r["doc_id"]: (r["match"], r["longest"], r["covered"]) for r in leaks.report(d, "doc_id", "text", i, "item_id", "text").collect()}
    assert got == {1: ("exact", 30, 30), 2: ("proximity", 14, 28), 3: ("phrase", 13, 13)}


def test_proximity_without_a_run(spark):
    """Copies with every tenth word replaced, with words put in and left out; a text of the same words in another order is none."""
    words = [f"t{i}" for i in range(40)]
    tenth = [w if k % 10 else f"o{k}" for k, w in enumerate(words)]
    fifth = [w if k % 5 else f"o{k}" for k, w in enumerate(words)]
    put = [*words[:10], "so", *words[10:20], *words[21:31], "very", *words[31:]]
    half = [w if k % 2 else f"o{k}" for k, w in enumerate(words)]
    docs = [(1, " ".join(tenth)), (2, " ".join(fifth)), (3, "x y " + " ".join(put) + " z"), (4, " ".join(half)), (5, " ".join(words[::-1])), (6, " ".join(words[20:] + words[:20]))]
    d, i = frames(spark, docs, [(5, " ".join(words))])
    got = {r["doc_id"]: (r["match"], r["longest"], r["covered"]) for r in leaks.report(d, "doc_id", "text", i, "item_id", "text").collect()}
    assert got == {1: ("proximity", 9, 36), 2: ("proximity", 4, 32), 3: ("proximity", 10, 39), 6: ("phrase", 20, 20)}
    assert {r["doc_id"] for r in leaks.find_leaks(d, "doc_id", "text", i, "item_id", "text").collect()} == {6}


def test_unicode_forms_and_empty(spark):
    item = "réponse " + " ".join(f"x{k}" for k in range(12))
    import unicodedata

    d, i = frames(spark, [(1, unicodedata.normalize("NFD", item)), (2, "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in item))], [(1, item)])
    assert {r["doc_id"] for r in leaks.find_leaks(d, "doc_id", "text", i, "item_id", "text", 13).collect()} == {1, 2}
    e, _ = frames(spark, [], [])
    assert leaks.find_leaks(e, "doc_id", "text", i, "item_id", "text").count() == 0
    assert leaks.find_leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0
