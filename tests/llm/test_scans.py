import random
import re

from pyspark.sql import functions as F

from verbarium.llm import scans as S

NOUNS = ["market", "stone", "river", "garden", "basket", "winter", "harvest", "children", "speaker", "village"]


def article(rnd, n):
    one = lambda: rnd.choice(NOUNS)
    return " ".join(f"The {one()} of the {one()} recalls a distant {one()} near the {one()}." for _ in range(n))


def scan(rnd, head="Songs Of The River"):
    """A scanned text with its faults, {(line, fault)}, and the text as it was."""
    words, faults, lines, page, clean = article(rnd, 14).split(), set(), [], rnd.randrange(20, 300), []
    line: list[str] = []
    wrong = False

    def put(text):
        lines.append(text)
        if wrong:
            faults.add((len(lines) - 1, "misread"))

    for w in words:
        clean.append(w)
        bad = w
        if rnd.random() < 0.06 and re.search("[oeis]", w[1:]):
            bad = w[0] + w[1:].replace("o", "0", 1) if "o" in w[1:] else w[0] + w[1:].replace("e", "c", 1)
        if sum(map(len, line)) + len(line) + len(w) > 45:
            if len(w) > 6 and bad == w and rnd.random() < 0.7:
                put(" ".join([*line, w[:3] + "-"]))
                faults.add((len(lines) - 1, "broken_word"))
                line, wrong = [w[3:]], False
            else:
                put(" ".join(line))
                line, wrong = [bad], bad != w
            if len(lines) % 9 == 4:
                page += 1
                faults.add((len(lines), "running_head"))
                if page % 2:
                    lines.append(f"{page}   {head}")
                else:
                    lines.append(head.upper())
                    faults.add((len(lines), "page_number"))
                    lines.append(f"- {page} -")
        else:
            line.append(bad)
            wrong |= bad != w
    put(" ".join(line))
    return "\n".join(lines), faults, " ".join(clean)


def corpus(spark):
    rnd = random.Random(8)
    rows, truth, texts = [], set(), {}
    for k in range(60):
        t, f, c = scan(rnd)
        rows.append((k, t, "clash", 0))
        truth |= {(k, *x) for x in f}
        texts[k] = c
    rows += [(100 + k, article(rnd, 4) + "\n" + article(rnd, 3), "", 0) for k in range(40)]
    rows += [(200, None, "", 0), (201, "", "", 0), (202, "word " * 50000, "", 0), rows[0]]
    return spark.createDataFrame(rows, "crawl_id long, content string, word string, doc int"), truth, texts


def test_held_out_faults(spark):
    df, truth, _ = corpus(spark)
    rows = [tuple(r) for r in S.faulty_lines(df, "crawl_id", "content", sample=30).collect()]
    got = set(rows)
    assert len(rows) == len(got) and not any(k >= 100 for k, _, _ in got)
    for fault in ("running_head", "page_number", "broken_word", "misread"):
        a, b = {x for x in got if x[2] == fault}, {x for x in truth if x[2] == fault}
        assert b and len(a & b) / len(b) > 0.95 and len(a & b) / len(a) > 0.95, (fault, len(a), len(b), len(a & b), list(b - a)[:3], list(a - b)[:3])


def test_repair(spark):
    df, _, texts = corpus(spark)
    got = {r["crawl_id"]: r["repaired"] for r in S.repair(df, "crawl_id", "content", sample=30).collect()}
    assert set(got) == set(texts)
    same = sum(x == y for k in texts for x, y in zip(got[k].split(), texts[k].split()))
    assert same / sum(len(t.split()) for t in texts.values()) > 0.98


def test_words():
    assert S.words_of("the jo- word and -ka or well-known d’objet") == ["the", "word", "and", "or", "well", "known", "d’objet"]
    assert "market" in S.undo("rnarkct") and "recently" in S.undo("recenf1y")
    assert len(S.undo("cl" * 30)) < 20000


def test_long_words_are_judged_like_short_ones(spark):
    rnd = random.Random(3)
    for _ in range(200):
        w = "".join(rnd.choice(["rn", "m", "cl", "d", "li", "h", "ii", "n", "1", "o", "a", "c", "s"]) for _ in range(rnd.randrange(2, 9)))
        near = S.undo(w)
        assert all(S.undone(w, o) for o in near)
        other = [x for o in list(near)[:20] for x in S.undo(o)]
        assert all(S.undone(w, o) == (o in near) for o in other if o != w)
    df = spark.createDataFrame([(w,) for w in ["modern", "rnodem", "rock", "dock", "ﬁne", "fine", "win", "vvii1"]], "w string")
    k = [r[0] for r in df.select(S.skeleton(F.col("w"))).collect()]
    assert k[0] == k[1] and k[4] == k[5] and k[2] != k[3]
    long = "kalo" * 20
    text = "The word is broken off in the middle of every\nline of this page because it was printed in\ncolumns and the " + long.replace("o", "0", 1) + " of nobody\nis what they know about it in the\nlast and longest line of all"
    rows = [(k, f"Plain {long} here number {k}.") for k in range(4)] + [(9, text)]
    got = S.faulty_lines(spark.createDataFrame(rows, "crawl_id long, content string"), "crawl_id", "content").collect()
    assert (9, 2, "misread") in {tuple(r) for r in got}


def test_empty(spark):
    df = spark.createDataFrame([], "crawl_id long, content string")
    assert S.faulty_lines(df, "crawl_id", "content").count() == 0
    assert S.repair(df, "crawl_id", "content").count() == 0


def test_page_numbers():
    assert all(map(S.is_number, ["12", "- 12 -", "[l00]", "p. 9", "Page 31", "xxiv", "XI", "- lOO -", "l0", "pag. 7"]))
    assert not any(map(S.is_number, ["solo", "sol.", "1954.", "los", "lo", "mix it", "el 12", "", "abc", "12 13"]))
