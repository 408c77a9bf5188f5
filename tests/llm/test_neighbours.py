import numpy as np
import pytest

from verbarium.llm import neighbours as N


def brute(rows, k):
    use = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v is not None and len(v) == 8 and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    out = {}
    for i, v in use:
        c = sorted((-round(float(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)), 12), j) for j, w in use if j != i)
        out[i] = [j for _, j in c[:k]]
    return out


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    centre = r.normal(size=(12, 8))
    out = [(i, [float(x) for x in centre[i % 12] + 0.2 * r.normal(size=8)]) for i in range(300)]
    out += [(300 + i, out[5][1]) for i in range(20)]  # a group of copies
    out += [(400 + i, [2 * x for x in out[5][1]]) for i in range(3)]  # the same direction
    return out + [(500, None), (501, [0.0] * 8), (502, [1.0]), (503, [float("nan")] * 8), (504, [])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "rec_id long, embedding array<double>, v string, key int")


def test_recall_and_order(spark, rows):
    want = brute(rows, 5)
    for block in (4096, 40):
        got = {}
        for r in N.nearest(frame(spark, rows), "rec_id", "embedding", 5, dim=8, per_pivot=16, block=block).orderBy("rec_id", "rank").collect():
            got.setdefault(r["rec_id"], []).append(r["nn"])
        assert set(got) == set(want)
        assert all(len(set(v)) == 5 and k not in v for k, v in got.items())
        hits = sum(len(set(got[k]) & set(want[k])) for k in want)
        assert hits / (5 * len(want)) >= 0.95
        assert got[310] == want[310]  # copies: ties to the smaller key


def test_levels_of_pivots(spark, rows):
    want = brute(rows, 5)
    got = {}
    for r in N.nearest(frame(spark, rows), "rec_id", "embedding", 5, dim=8, per_pivot=10, fan=4).collect():  # three levels: 4, 16, 31 pivots
        got.setdefault(r["rec_id"], []).append(r["nn"])
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[k]) & set(want[k])) for k in want) / (5 * len(want)) >= 0.9


def test_only_candidates_are_compared_and_rows_are_complete(spark, rows):
    want = brute(rows, 5)
    few = N.nearest(frame(spark, rows), "rec_id", "embedding", 5, dim=8, per_pivot=16, candidates=6, prefix=6).collect()
    assert sum(r["nn"] in want[r["rec_id"]] for r in few) < 0.95 * len(few)  # the cut by footrule is felt
    lone = N.nearest(frame(spark, rows), "rec_id", "embedding", 5, dim=8, per_pivot=2, posts=1, prefix=1).groupBy("rec_id").count().collect()
    assert {r["rec_id"]: r["count"] for r in lone} == dict.fromkeys(want, 5)


def test_small_and_empty(spark):
    f = frame(spark, [(1, [1.0] + [0.0] * 7), (2, [1.0] * 8)])
    assert {(r["rec_id"], r["nn"]) for r in N.nearest(f, "rec_id", "embedding", 5, dim=8).collect()} == {(1, 2), (2, 1)}
    assert N.nearest(f.limit(0), "rec_id", "embedding", 5, dim=8).count() == 0


def test_footrule():
    a, b = np.array([[1, 2, 3, 4]]), np.array([[1, 2, 3, 4], [4, 3, 2, 1], [5, 6, 7, 8], [2, 1, 9, 3]])
    got = N.footrule_agreement(a, b)[0]

    def rule(x, y):
        place = lambda z, p: list(z).index(p) if p in z else 4
        return sum(abs(place(x, p) - place(y, p)) for p in {*x, *y})

    assert [20 - 2 * g for g in got] == [rule(a[0], y) for y in b]


def test_footrule_of_long_prefixes():
    r = np.random.default_rng(1)
    for length in (15, 16, 20, 300):
        a, b = (np.array([r.permutation(2 * length)[:length] for _ in range(4)]) for _ in "ab")
        got = N.footrule_agreement(np.vstack([a, b[:1]]), b)
        place = lambda z, p: int(np.flatnonzero(z == p)[0]) if p in z else length  # noqa: B023, E731
        for i, x in enumerate([*a, b[0]]):
            for j, y in enumerate(b):
                assert length * (length + 1) - 2 * int(got[i, j]) == sum(abs(place(x, p) - place(y, p)) for p in {*x, *y})
