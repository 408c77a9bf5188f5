import itertools
import random

from pyspark.sql import functions as F

from verbarium.llm import survivors as S

SCHEMA = "id string, rec_id long, a string, b string, trust double, at timestamp, g int, n int"


def bundles():
    return [S.Bundle(c, S.usable(F.col(c)), F.length(c), F.col(c)) for c in ("a", "b")]


def make(spark, n, seed):
    rnd = random.Random(seed)
    import datetime as dt

    rows = []
    for k in range(n):
        at = None if rnd.random() < 0.2 else dt.datetime(2024, 1, rnd.randrange(1, 4))
        rows.append((f"i{rnd.randrange(8)}", k, rnd.choice(["x", "yy", "zzz", "n/a", "", None]), rnd.choice(["p", "qq", "rrr", "?", None]), rnd.choice([None, 0.1, 0.5, 0.9]), at, 0, 0))
    return spark.createDataFrame(rows, SCHEMA), rows


def vec(r, c):
    t = S.NO_TRUST if r[4] is None else round(r[4] * 1e6)
    import datetime as dt

    at = S.NO_TIME if r[5] is None else (r[5] - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    return (t, at, len(r[c]), -r[1])


def ok(v):
    return v is not None and any(ch.isalnum() for ch in v) and v.lower() not in S.STAND_INS


def test_usable(spark):
    vals = ["x", " N/A ", "", None, "…", "—", "?", "TODO", "[missing]", "\xa0", "na", "0"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    assert [r[0] for r in df.select(S.usable(F.col("v"))).collect()] == [True] + [False] * 9 + [True, True]


def test_root_bound(spark):
    df, rows = make(spark, 60, 1)
    got = {(r["id"], r["bundle"]): r["row"] for r in S.choose(df, "id", "rec_id", bundles(), F.col("trust"), F.col("at")).collect()}
    want = {}
    for i, c in itertools.product({r[0] for r in rows}, (2, 3)):
        own = [r for r in rows if r[0] == i]
        if len(own) > 1 and (use := [r for r in own if ok(r[c])]):
            want[i, "ab"[c - 2]] = max(use, key=lambda r: vec(r, c))[1]
    assert got == want


def test_dependency_against_all_assignments(spark):
    for seed in range(3):
        df, rows = make(spark, 40, 10 + seed)
        fds = [S.Dependency(("a", F.col("a")), ("b", F.col("b")))]
        out = S.choose(df, "id", "rec_id", bundles(), F.col("trust"), F.col("at"), fds, least=1)
        got = {}
        for r in out.collect():
            got.setdefault(r["id"], {})[r["bundle"]] = r["row"]
        for i in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == i]
            aa, bb = [r for r in own if ok(r[2])], [r for r in own if ok(r[3])]
            both = {(r[2], r[3]) for r in own if ok(r[2]) and ok(r[3])}
            if aa and bb:
                pairs = [(x, y) for x in aa for y in bb if (x[2], y[3]) in both]
                if not pairs:
                    continue
                score = lambda p: tuple(u + v for u, v in zip(vec(p[0], 2), vec(p[1], 3)))
                best = max(pairs, key=score)
                byid = {r[1]: r for r in own}
                have = (byid[got[i]["a"]], byid[got[i]["b"]])
                assert score(have) == score(best) and (have[0][2], have[1][3]) in both
            else:
                assert set(got.get(i, {})) == ({"a"} if aa else set()) | ({"b"} if bb else set())


def check(rows, out, deps):
    """Every group against all assignments; ``deps``: pairs of columns that must occur together."""
    got = {}
    for r in out.collect():
        got.setdefault(r["id"], []).append((r["bundle"], r["row"], r["consistent"]))
    col = {"a": 2, "b": 3, "c": 8}
    marked = 0
    for i in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == i]
        bids = {n: [r for r in own if ok(r[c])] for n, c in col.items()}
        names = [n for n in col if bids[n]]
        seen = {d: {(r[col[d[0]]], r[col[d[1]]]) for r in own if ok(r[col[d[0]]]) and ok(r[col[d[1]]])} for d in deps}
        score = lambda p: tuple(map(sum, zip(*(vec(r, col[n]) for n, r in p.items()))))  # noqa: B023, E731
        fits = lambda p: all((p[x][col[x]], p[y][col[y]]) in seen[x, y] for x, y in deps if x in p and y in p)  # noqa: B023, E731
        all_ = [dict(zip(names, c)) for c in itertools.product(*(bids[n] for n in names))]
        good = [p for p in all_ if fits(p)]
        have = {b: next(r for r in own if r[1] == k) for b, k, _ in got.get(i, [])}
        assert set(have) == set(names)
        if names:
            assert {c for *_, c in got[i]} == {bool(good)}
            marked += not good
            assert score(have) == max(map(score, good or all_))
            assert fits(have) or not good
    return marked


def test_chains_and_cycles(spark):
    marked = 0
    for seed, deps in enumerate([[("a", "b"), ("b", "c")], [("a", "b"), ("b", "c"), ("a", "c")], [("b", "a")], []]):
        rnd = random.Random(seed)
        _, rows = make(spark, 46, 30 + seed)
        rows = [(*r[:6], 0, 0, rnd.choice(["u", "vv", "www", None, ""])) for r in rows]
        df = spark.createDataFrame(rows, SCHEMA + ", c string")
        three = [S.Bundle(c, S.usable(F.col(c)), F.length(c), F.col(c)) for c in ("a", "b", "c")]
        fds = [S.Dependency((x, F.col(x)), (y, F.col(y))) for x, y in deps]
        marked += check(rows, S.choose(df, "id", "rec_id", three, F.col("trust"), F.col("at"), fds, least=1), deps)
    assert marked >= 0


def test_no_assignment_is_marked(spark):
    df = spark.createDataFrame([("k", 1, "x", None, None, None, 0, 0), ("k", 2, None, "p", None, None, 0, 0)], SCHEMA)
    fds = [S.Dependency(("a", F.col("a")), ("b", F.col("b")))]
    out = S.choose(df, "id", "rec_id", bundles(), F.col("trust"), F.col("at"), fds)
    assert {(r["bundle"], r["row"], r["consistent"]) for r in out.collect()} == {("a", 1, False), ("b", 2, False)}


def test_order_finishes_a_part_before_the_next():
    assert S.plan_order(5, [(3, 1), (1, 4)]) == [1, 3, 4, 0, 2]
    assert sorted(S.plan_order(3, [])) == [0, 1, 2]


def test_edges(spark):
    df = spark.createDataFrame([], SCHEMA)
    args = ("id", "rec_id", bundles(), F.col("trust"), F.col("at"))
    assert S.choose(df, *args).count() == 0
    fds = [S.Dependency(("a", F.col("a")), ("b", F.col("b")))]
    assert S.choose(df, *args, fds).count() == 0
    same = spark.createDataFrame([("k", 2, "x", "p", None, None, 0, 0)] * 2 + [("k", 1, "x", "p", None, None, 0, 0), (None, 5, "x", "p", 1.0, None, 0, 0)], SCHEMA)
    assert {(r["id"], r["bundle"], r["row"], r["value"]) for r in S.choose(same, *args).collect()} == {("k", "a", 1, "x"), ("k", "b", 1, "p")}
    long = spark.createDataFrame([("k", 1, "w" * 100000, "p", 0.5, None, 0, 0), ("k", 2, "v", "p", 0.5, None, 0, 0)], SCHEMA)
    assert S.choose(long, *args).where("bundle = 'a'").first()["row"] == 1
