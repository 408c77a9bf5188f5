"""The k most similar vectors of every vector: a permutation index over pivots.

Every distinct vector is represented by the ordered list of its nearest pivots (the first ``prefix`` places of its
permutation) and posted in the inverted files of the first ``posts`` of them. Within an inverted file the footrule distance of a
query to every member is summed up from the postings of the pivots they share (an absent pivot stands one place behind the
prefix); the ``candidates`` nearest by footrule, and no others, are reranked by cosine, in double precision for the final
order. A pair that meets in several files is looked at in the first of the query's order only.

* Pivots are a hash sample of the distinct vectors and grow with them, one for each ``per_pivot``, so files keep their mean
  length and the work grows as n log n. At most ``fan`` pivots are ever sent to the executors: they are the cells of the first
  level, and each further level ranks a vector against the pivots of its nearest ``beam`` cells of the level before.
* Exact copies are indexed once; at most k+1 of their keys are carried along, so a group of copies of any size costs one
  entry. Every row is a query nevertheless.
* An inverted file beyond ``block`` members is dealt to blocks of queries times blocks of members: whole, no cap; every block
  reranks its own nearest ``candidates``, so no candidate of the whole file is passed over.
* A vector whose files hold fewer than k others is compared with all vectors, such queries being taken in blocks.
* Cosine is rounded to 12 decimals, ties go to the smaller key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbarium.plans.runtime import stored


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """A binary column of ``dim`` float32 values each as a matrix."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.float32).reshape(-1, dim)


def _one(col: pa.ChunkedArray | pa.Array) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def footrule_agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For permutation prefixes (rows of pivot numbers, distinct in a row), L(L+1) minus the footrule distance, halved: the sum
    over shared pivots of the places left behind the later of the two positions. Greater means nearer.

    Summed from the postings: for each place of the queries' prefixes one row of (member -> places left) per pivot is added.
    """
    length = a.shape[1]
    pivots, at = np.unique(b, return_inverse=True)
    at = at.reshape(b.shape)
    kind = np.int8 if length * (length + 1) // 2 < 128 else np.int16 if length < 256 else np.int64
    left = np.zeros((len(pivots) + 1, len(b)), dtype=kind)  # the last row: a pivot no member has
    for j in range(length):
        left[at[:, j], np.arange(len(b))] = length - j
    mine = np.searchsorted(pivots, a)
    mine[(mine == len(pivots)) | (pivots[np.minimum(mine, len(pivots) - 1)] != a)] = len(pivots)
    out = np.zeros((len(a), len(b)), dtype=kind)
    for i in range(length):
        out += np.minimum(left[mine[:, i]], kind(length - i))
    return out


def _rerank(vec: np.ndarray, perm: np.ndarray, keys: np.ndarray, q: np.ndarray, m: np.ndarray, k: int, candidates: int, posts: int, file: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top k members (rows ``m``) of each query (rows ``q``) of the inverted file of pivot ``file``: (query, member, cosine)."""
    norm = np.sqrt(np.einsum("ij,ij->i", vec.astype(np.float64), vec.astype(np.float64)))
    unit = (vec / norm[:, None]).astype(np.float32)
    most, outs = min(len(m), candidates), []
    top = min(most, k + 7)
    pivots, at = np.unique(perm[m][:, :posts], return_inverse=True)
    holds = np.zeros((len(pivots) + 1, len(m)), dtype=bool)
    at = at.reshape(len(m), -1)
    for j in range(at.shape[1]):
        holds[at[:, j], np.arange(len(m))] = True
    for start in range(0, len(q), 256):
        rows = q[start : start + 256]
        agree = footrule_agreement(perm[rows], perm[m]).astype(np.int16)
        # members that share an earlier file with the query were met there
        for j in range(posts - 1):
            before = (perm[rows][:, : j + 1] != file).all(1)
            if not before.any():
                break
            mine = np.searchsorted(pivots, perm[rows, j])
            mine[(mine == len(pivots)) | (pivots[np.minimum(mine, len(pivots) - 1)] != perm[rows, j])] = len(pivots)
            agree[holds[mine] & before[:, None]] = -1
        agree[keys[rows][:, None] == keys[m][None, :]] = -1
        cand = np.argpartition(agree, len(m) - most, axis=1)[:, len(m) - most :] if most < len(m) else np.broadcast_to(np.arange(len(m)), agree.shape)
        ok = np.take_along_axis(agree, cand, 1) >= 0
        cos = np.matmul(unit[m[cand]], unit[rows][:, :, None])[:, :, 0]
        cos[~ok] = -2
        best = np.argpartition(cos, most - top, axis=1)[:, most - top :] if top < most else np.broadcast_to(np.arange(most), cos.shape)
        ok = np.take_along_axis(ok, best, 1)
        cols = m[np.take_along_axis(cand, best, 1)]
        exact = np.einsum("ij,ikj->ik", vec[rows].astype(np.float64), vec[cols].astype(np.float64)) / (norm[rows][:, None] * norm[cols])
        exact = np.where(ok, np.round(exact, 12), -9.0)
        order = np.lexsort((keys[cols], -exact), axis=1)[:, :k]
        exact, cols = np.take_along_axis(exact, order, 1), np.take_along_axis(cols, order, 1)
        keep = exact > -9
        outs.append((np.broadcast_to(keys[rows][:, None], cols.shape)[keep], keys[cols][keep], exact[keep]))
    return tuple(np.concatenate([o[i] for o in outs]) for i in range(3)) if outs else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _nearest_pivots(vec: np.ndarray, pivot: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the ``length`` pivots (unit rows) nearest to each vector, nearest first."""
    length = min(length, len(pivot))
    norm = np.sqrt(np.einsum("ij,ij->i", vec.astype(np.float64), vec.astype(np.float64)))
    unit = (vec / norm[:, None]).astype(np.float32)
    near, sim = np.empty((len(vec), length), dtype=np.int64), np.empty((len(vec), length), dtype=np.float32)
    for at in range(0, len(vec), 2048):
        d = -(unit[at : at + 2048] @ pivot.T)
        part = np.argpartition(d, length - 1, axis=1)[:, :length] if length < len(pivot) else np.broadcast_to(np.arange(len(pivot)), d.shape)
        by = np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable")
        part = np.take_along_axis(part, by, 1)
        near[at : at + 2048], sim[at : at + 2048] = ids[part], -np.take_along_axis(d, part, 1)
    return near, sim


def _units(vec: np.ndarray) -> np.ndarray:
    return (vec / np.linalg.norm(vec.astype(np.float64), axis=1)[:, None]).astype(np.float32) if len(vec) else vec


def permutations(distinct: DataFrame, n: int, dim: int, prefix: int, per_pivot: int, fan: int, beam: int, block: int) -> DataFrame:
    """(``vid``, ``vec``, ``perm``): every vector with the ids of its nearest pivots, nearest first."""
    m = max(1, math.ceil(n / per_pivot))
    first = distinct.orderBy("k1", "k2").limit(min(m, fan)).select("vid", "v").collect()  # at most ``fan`` rows
    ids = np.array([r["vid"] for r in first], dtype=np.int64)
    pivot = _units(np.array([r["v"] for r in first], dtype=np.float32).reshape(-1, dim))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vec = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            near, _ = _nearest_pivots(vec, pivot, ids, prefix)
            raw = vec.tobytes()
            cells = pa.ListArray.from_arrays(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vid"), pa.array([raw[i : i + 4 * dim] for i in range(0, len(raw), 4 * dim)], pa.binary()), cells], names=["vid", "vec", "perm"])

    out = stored(distinct.select("vid", "v").mapInArrow(assign, "vid long, vec binary, perm array<bigint>"), "p5-permutations")
    size = fan
    while size < m:
        size = min(m, size * fan)
        drawn = F.pmod(F.xxhash64(F.lit(7), "vid"), F.lit(1 << 40)) < int((1 << 40) * size / n)
        pivots = out.where(drawn).select(F.element_at("perm", 1).alias("cell"), F.col("vid").alias("pid"), F.col("vec").alias("pvec"))
        rows = out.select("vid", "vec", F.explode(F.slice("perm", 1, beam)).alias("cell"))
        parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / (16 * block)).cast("int").alias("parts"))
        rows = rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int")).drop("parts")
        pivots = pivots.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        def refine(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return pa.table({"vid": np.zeros(0, np.int64), "pid": np.zeros(0, np.int64), "sim": np.zeros(0, np.float32)})
            near, sim = _nearest_pivots(_matrix(left.column("vec"), dim), _units(_matrix(right.column("pvec"), dim)), right.column("pid").to_numpy(), prefix)
            return pa.table({"vid": np.repeat(left.column("vid").to_numpy(), near.shape[1]), "pid": near.ravel(), "sim": sim.ravel()})

        met = rows.groupBy("cell", "part").cogroup(pivots.groupBy("cell", "part")).applyInArrow(refine, "vid long, pid long, sim float")
        best = met.groupBy("vid").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("d"), "pid"))), 1, prefix), lambda x: x["pid"]).alias("fine"))  # beam * prefix items
        out = stored(out.join(best, "vid", "left").select("vid", "vec", F.coalesce("fine", "perm").alias("perm")), "p5-permutations")
    return out


def usable_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """Rows (``key``, ``vector``) whose vector has ``dim`` finite elements, not all of them zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = (F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0)
    return df.select(F.col(key).cast("long").alias("key"), v.cast("array<float>").alias("v")).where(F.col("key").isNotNull() & F.coalesce(ok, F.lit(False)))


def nearest(
    df: DataFrame, key: str, vector: str, k: int = 5, dim: int = 64, prefix: int = 12, posts: int = 4, per_pivot: int = 192, candidates: int = 192, block: int = 4096,
    fan: int = 4096, beam: int = 4,
) -> DataFrame:
    """(``key``, ``nn``, ``cosine``, ``rank``): the ``k`` most similar other rows of every usable row.

    Null, zero, non-finite vectors and those of another length are neither queries nor neighbours. ``key`` identifies a
    row. Every row gets ``k`` neighbours, or all others if there are fewer.
    """
    spark = df.sparkSession
    base = usable_vectors(df, key, vector, dim).withColumns({"k1": F.xxhash64("v"), "k2": F.hash("v")})
    same = ["k1", "k2"]
    distinct = stored(base.groupBy(*same).agg(F.min("key").alias("vid"), F.any_value("v").alias("v")), "p5-distinct")
    n = distinct.count()
    posted = permutations(distinct, n, dim, prefix, per_pivot, fan, beam, block)
    files = F.slice("perm", 1, posts)
    long = posted.select(F.explode(files).alias("p")).groupBy("p").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1")
    lists = posted.select("vid", "vec", "perm", F.explode(files).alias("p")).join(long, "p", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    lists = lists.withColumn("own", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int"))
    blocks = F.expr("concat(transform(sequence(0, parts - 1), x -> struct(own as qp, x as mp)), transform(filter(sequence(0, parts - 1), x -> x <> own), x -> struct(x as qp, own as mp)))")
    lists = lists.select("p", "vid", "vec", "perm", "own", F.inline(blocks))

    def compare(keys: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("vid")
        own = t.column("own").to_numpy()
        file, qp, mp = (x.as_py() for x in keys)
        sizes = _one(t.column("perm")).value_lengths().to_numpy()
        flat = _one(t.column("perm")).flatten().to_numpy(zero_copy_only=False)
        perm = np.arange(-1, -1 - len(sizes) * sizes.max(), -1, dtype=np.int64).reshape(len(sizes), -1)  # places without a pivot agree with none
        perm[np.arange(sizes.max())[None, :] < sizes[:, None]] = flat
        q, m, c = _rerank(_matrix(t.column("vec"), dim), perm, t.column("vid").to_numpy(), np.flatnonzero(own == qp), np.flatnonzero(own == mp), k, candidates, posts, file)
        return pa.table({"q": q.astype(np.int64), "m": m.astype(np.int64), "c": c.astype(np.float64)})

    pairs = lists.groupBy("p", "qp", "mp").applyInArrow(compare, "q long, m long, c double")
    item = "array<struct<d:double,m:long>>"
    take = lambda x: F.slice(F.array_sort(F.collect_set(F.struct((-F.col("c")).alias("d"), "m"))), 1, k)
    best = stored(distinct.select(F.col("vid").alias("q")).join(pairs.groupBy("q").agg(take(pairs).alias("near")), "q", "left").select("q", F.coalesce("near", F.array().cast(item)).alias("near")), "p5-best")
    whole = _exact(spark, distinct, best.where(F.size("near") < min(k, n - 1)).select(F.col("q").alias("vid")), k, dim) if n > 1 else None
    if whole is not None:
        whole = whole.groupBy("q").agg(take(whole).alias("all"))
        best = best.join(whole, "q", "left").select("q", F.coalesce("all", "near").alias("near"))
    near = best.select("q", F.inline(F.concat(F.array(F.struct(F.lit(-1.0).alias("d"), F.col("q").alias("m"))), "near")))

    # back to rows: at most k+1 keys stand for each group of copies
    keyed = base.select("key", *same).join(distinct.select(*same, "vid"), same).select("key", "vid")
    keyed = stored(keyed, "p5-keys")
    first = keyed.withColumn("r", F.row_number().over(Window.partitionBy("vid").orderBy("key"))).where(F.col("r") <= k + 1).select(F.col("vid").alias("m"), "key")
    ranked = near.join(first, "m").groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "key"))), 1, k + 1).alias("near"))
    mine = keyed.join(ranked, keyed["vid"] == ranked["q"]).select("key", F.slice(F.expr("filter(near, x -> x.key <> key)"), 1, k).alias("near"))
    out = mine.select(F.col("key").alias(key), F.posexplode("near").alias("rank", "x"))
    return out.select(key, F.col("x.key").alias("nn"), (-F.col("x.d")).alias("cosine"), (F.col("rank") + 1).alias("rank"))


def _exact(spark: SparkSession, distinct: DataFrame, few: DataFrame, k: int, dim: int, block: int = 1024) -> DataFrame | None:
    """(``q``, ``m``, ``c``) by comparison with all vectors for the queries ``few``, ``block`` of them at a time; None if there are none."""
    few = stored(few, "p5-few")
    out, last = None, None
    while True:
        take = few.join(distinct, "vid").select("vid", "v")
        take = (take if last is None else take.where(F.col("vid") > last)).orderBy("vid").limit(block).collect()
        if not take:
            return out
        last = take[-1]["vid"]
        ids, vec = np.array([r["vid"] for r in take]), np.array([r["v"] for r in take], dtype=np.float64).reshape(-1, dim)
        vec /= np.linalg.norm(vec, axis=1)[:, None]

        def scan(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, vec: np.ndarray = vec) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                keys = b.column("vid").to_numpy()
                own = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                cos = np.round(vec @ (own / np.linalg.norm(own, axis=1)[:, None]).T, 12)
                cos[ids[:, None] == keys[None, :]] = -9
                order = np.lexsort((np.broadcast_to(keys, cos.shape), -cos), axis=1)[:, :k]
                c = np.take_along_axis(cos, order, 1)
                keep = c > -9
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], c.shape)[keep]), pa.array(keys[order][keep]), pa.array(c[keep])], names=["q", "m", "c"])

        one = distinct.select("vid", "v").mapInArrow(scan, "q long, m long, c double")
        out = one if out is None else out.unionByName(one)
