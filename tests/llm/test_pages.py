import random

from pyspark.sql import functions as F

from verbarium.llm import pages as P


def corpus(n=60, hosts=3):
    rnd = random.Random(5)
    glosses = ["Oven", "Reed mat", "Canoe", "Salt pan", "Drum", "Root crop"]
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "tse", "ru"]) for _ in range(4))
    rows, truth = [], set()
    for k in range(n):
        host = f"site{k % hosts}.test"
        lines: list[tuple[str, bool]] = [(f"Site{k % hosts}", True), ("Home | Maps | Help | Search", True), (f"Home » Maps » {word()}", True), ("", False)]
        lines += [(f"{rnd.choice(glosses)} – {word()}", False), ("", False)]
        for _ in range(3):
            lines += [(rnd.choice(glosses), False), (f"The word {word()} belongs with a {word()}, and nobody in {word()} explains why it is so.", False)]
        lines += [(f"{word()} — {rnd.choice(glosses).lower()}", False) for _ in range(3)] + [("", False)]
        lines += [("Related pages", True), (f"› {rnd.choice(glosses)}", True), (word(), True), (f"{word()} – {rnd.choice(glosses).lower()}", True), ("", False)]
        lines += [("Share this page", True), (f"{rnd.randrange(30)} comments", True), (f"© {2000 + k % 20} Site{k % hosts}. All rights reserved.", True), (f"Page last changed: {k}/1/2020", True)]
        rows.append((k, f"https://{host}/{k}", "\n".join(x for x, _ in lines), "clash"))
        truth |= {(k, i) for i, (_, s) in enumerate(lines) if s}
    return rows, truth


def frame(spark, rows):
    return spark.createDataFrame(rows, "crawl_id long, url string, content string, host string")


def test_held_out_pages(spark):
    rows, truth = corpus()
    scan = "The word is broken off in the middle of every\nline of this page because it was printed in\ncolumns and scanned from a book that nobody\nknows, and Related pages never appear in it.\n- 12 -"
    rows += [(1000, None, "Plain article text. It has two sentences.\nAnd a line."), (1001, "https://site0.test/s", scan), (1002, "u", None), (1003, "u", ""), (1004, "u", "x " * 50000)]
    rows = [(*r[:3], "clash") for r in rows]
    got = {tuple(r) for r in P.site_lines(frame(spark, rows + rows[:4]), "crawl_id", "url", "content").collect()}
    hit = len(got & truth)
    assert hit / len(truth) > 0.97 and hit / len(got) > 0.97
    assert not {d for d, _ in got} & {1000, 1001, 1002, 1003, 1004}


def test_rare_site_lines(spark):
    """A site line on 5 % of a big site's pages, in a block of site lines, is found by its ratio; the article's own headings stay."""
    rows, truth = corpus(420, 1)
    for k in range(0, 420, 20):
        lines = rows[k][2].split("\n")
        at = lines.index("Share this page") + 1
        rows[k] = (k, rows[k][1], "\n".join([*lines[:at], "Guest book open", *lines[at:]]), "clash")
        truth = {(d, i + (d == k and i >= at)) for d, i in truth} | {(k, at)}
    got = {tuple(r) for r in P.site_lines(frame(spark, rows), "crawl_id", "url", "content").collect()}
    rare = {(k, i) for k in range(0, 420, 20) for i, x in enumerate(rows[k][2].split("\n")) if x == "Guest book open"}
    assert len(rare) == 21 and rare <= got
    assert len(got & truth) / len(truth) > 0.97 and len(got & truth) / len(got) > 0.97


def test_the_ratio_decides(spark, monkeypatch):
    """Without the ratios most site lines are lost; a higher threshold takes in the article."""
    rows, truth = corpus()
    found = lambda: {tuple(r) for r in P.site_lines(frame(spark, rows), "crawl_id", "url", "content").collect()}
    real = P.ratio
    monkeypatch.setattr(P, "ratio", lambda mass, pages, of, prose: F.lit(P.ALONE))
    assert len(found() & truth) < 0.7 * len(truth)
    monkeypatch.setattr(P, "ratio", real)
    monkeypatch.setattr(P, "LOW", P.ALONE + 1)
    assert len(found() - truth) > len(truth) / 2


def test_ratio_and_fusion(spark):
    df = spark.createDataFrame([(20.0, 10, 100, False), (200.0, 10, 100, True), (20.0, 1, 100, False), (200.0, 2, 4, True), (20.0, 100, 100, False)], "mass double, pages long, n long, prose boolean")
    got = [r[0] for r in df.select(P.ratio(F.col("mass"), F.col("pages"), F.col("n"), F.col("prose"))).collect()]
    assert got[0] < got[1] < P.LOW < P.ALONE == got[2] == got[3] and got[4] < got[0]
    # a path that is rare on one site and common on another takes the lower, common ratio
    line = lambda h, p, path: (h, p, path, P.SHORT, 10, 0, [], [])
    rows = [line(1, k, 7) for k in range(50)] + [line(2, 100 + k, 1000 + k) for k in range(60)] + [line(2, 100, 7)]
    lines = spark.createDataFrame(rows, "host long, page long, path long, form int, chars int, marks int, pieces array<long>, gloss array<long>")
    got = {(r["host"], r["path"]): r["ratio"] for r in P.path_ratios(lines).collect()}
    assert got[1, 7] < got[2, 7] < P.LOW and got[2, 1001] == P.ALONE


def test_smoothing(spark):
    rows = [(1, 0, 2.0, True), (1, 1, 5.0, False), (1, 2, 2.0, False), (1, 4, 5.0, True), (1, 5, 6.9, False), (2, 0, 5.0, True)]
    df = spark.createDataFrame(rows, "doc long, line_no int, ratio double, gap boolean")
    got = [round(r[0], 3) for r in df.select("doc", "line_no", P.smoothed().alias("s")).orderBy("doc", "line_no").select("s").collect()]
    assert got == [2.3, 4.4, 2.3, 5.19, 6.71, 5.0]  # the second line is drawn under LOW by its block, the fourth is not


def test_main_content(spark):
    rows, truth = corpus(30)
    got = {r["crawl_id"]: r["body"] for r in P.main_content(frame(spark, rows + [(99, "u", None, "")]), "crawl_id", "url", "content").collect()}
    assert got[99] is None and len(got) == 31
    assert "comments" not in got[3] and "explains why" in got[3] and "\n\n\n" not in got[3]


def test_empty(spark):
    f = frame(spark, corpus(1)[0]).limit(0)
    assert P.site_lines(f, "crawl_id", "url", "content").count() == 0


def test_paths():
    assert P.path_of("Page 12 »", "h.x")[:2] == ("short", "page 0")
    assert P.path_of("Home » Maps » kalo", "h.x")[:3] == ("crumbs", "home » maps » *", ["home", "maps"])
    assert P.path_of("kalo — reed mat", "h.x")[0] == "listed"
    assert P.is_scan(["The plural is formed by doubling the", "first syllable as in the name of the", "drum that was lost by the old sea"])
