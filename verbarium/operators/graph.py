"""Graphs over entries: typed edges, degree, top nodes, neighbourhood, shortest path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbarium.plans.runtime import cut, small

#: Of two edges between the same nodes the first type stays.
TYPES = ("related", "cluster", "embedding")
#: Nodes a graph is built from at most: its feature, as is the number shown.
FETCH = 1500


def related_edges(nodes: DataFrame, key: str, headword: str, terms: str) -> DataFrame:
    """Terms resolved to headwords; of equal headwords the last key wins."""
    h = nodes.where(F.col(headword).isNotNull()).groupBy(F.col(headword).alias("t")).agg(F.max(key).alias("b"))
    e = nodes.select(F.col(key).alias("a"), F.explode(terms).alias("t")).join(h, "t").where("a <> b")
    return e.select("a", "b", F.lit(1.0).alias("weight"), F.lit("related").alias("type"))


def star_edges(nodes: DataFrame, key: str, cluster: str, spokes: int = 10) -> DataFrame:
    """The first node of a cluster joined to its second to tenth; null is a cluster of its own."""
    c = F.coalesce(cluster, F.lit("uncategorized"))
    w = Window.partitionBy("c").orderBy(key)
    r = nodes.select(c.alias("c"), key).withColumn("r", F.row_number().over(w)).where(F.col("r") <= spokes)
    hub = r.where("r = 1").select("c", F.col(key).alias("a"))
    return r.where("r > 1").join(hub, "c").select("a", F.col(key).alias("b"), F.lit(0.3).alias("weight"), F.lit("cluster").alias("type"))


def similar_edges(nodes: DataFrame, key: str, vector: str, threshold: float = 0.6, fetch: int = FETCH) -> DataFrame:
    """Edges of cosine above the threshold among at most ``fetch`` nodes (smallest keys). The bounded matrix goes to the
    executors; each task multiplies its rows with it and emits edges only."""
    use = nodes.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v")).orderBy("k").limit(fetch)
    rows = use.collect()
    ids = np.array([r["k"] for r in rows])
    m = np.array([r["v"] for r in rows], dtype=np.float64).reshape(len(rows), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True) if len(rows) else m
    unit = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.searchsorted(ids, b["k"].to_numpy())
            s = np.round(unit[at] @ unit.T, 9)
            i, j = np.nonzero((s > threshold) & (ids[None, :] > ids[at][:, None]))
            yield pd.DataFrame({"a": ids[at[i]], "b": ids[j], "weight": s[i, j]})

    kind = nodes.schema[key].dataType.simpleString()
    return use.select("k").mapInPandas(run, f"a {kind}, b {kind}, weight double").withColumn("type", F.lit("embedding"))


def undirected(edges: DataFrame) -> DataFrame:
    """One edge for each pair: the first type in order, then the greatest weight; no self-loops."""
    rank = F.array_position(F.array(*(F.lit(t) for t in TYPES)), F.col("type"))
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight", "type", rank.alias("rank"))
    best = F.min_by(F.struct("weight", "type"), F.struct("rank", -F.col("weight")))
    return e.groupBy("a", "b").agg(best.alias("x")).select("a", "b", "x.weight", "x.type")


def degrees(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(``key``, ``degree``), 0 for isolated nodes."""
    ends = edges.select(F.explode(F.array("a", "b")).alias(key)).groupBy(key).agg(F.count("*").alias("degree"))
    return nodes.select(key).distinct().join(ends, key, "left").select(key, F.coalesce("degree", F.lit(0)).alias("degree"))


def top_graph(nodes: DataFrame, edges: DataFrame, key: str, most: int = 400, per_node: float = 2.5) -> tuple[DataFrame, DataFrame]:
    """The ``most`` nodes of highest degree and the heaviest edges among them, ``per_node`` times as many."""
    n = min(1500, max(50, most))
    best = degrees(nodes, edges, key).orderBy(F.desc("degree"), key).limit(n)
    ids = F.broadcast(best.select(key))  # at most 1,500 rows
    e = edges.join(ids.withColumnRenamed(key, "a"), "a", "left_semi").join(ids.withColumnRenamed(key, "b"), "b", "left_semi")
    return best, e.orderBy(F.desc("weight"), "a", "b").limit(int(per_node * n + 0.5)).select("a", "b", "weight", "type")


def neighbourhood(edges: DataFrame, roots: DataFrame, key: str, depth: int = 2, most: int = 50) -> DataFrame:
    """(``key``, ``hops``): nodes within ``depth`` hops of the roots, nearest first, at most ``most`` (the feature's cap)."""
    sym = cut(edges.select("a", "b").union(edges.select("b", "a")))
    seen = roots.select(key).distinct().withColumn("hops", F.lit(0))
    front = seen
    for h in range(1, depth + 1):
        step = sym.join(small(front.select(F.col(key).alias("a"))), "a", "left_semi").select(F.col("b").alias(key)).distinct()
        front = cut(step.join(small(seen.select(key)), key, "left_anti").withColumn("hops", F.lit(h)))
        seen = seen.unionByName(front)
    return seen.orderBy("hops", key).limit(most)


def shortest_path(edges: DataFrame, start, goal) -> list:
    """Keys along a shortest path, [] if there is none; of equal paths the smallest predecessors win.

    One frontier join per hop with the lineage cut, until the goal is met or the frontier is empty: as many hops as the part of the graph
    needs. The way back is one join per hop too; only the path itself comes to the driver.
    """
    if start == goal:
        return [start]
    spark = edges.sparkSession
    sym = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    kind = sym.schema["a"].dataType.simpleString()
    layers = [cut(spark.createDataFrame([(start, None)], f"node {kind}, via {kind}"))]
    seen = layers[0].select("node")
    while True:
        nxt = sym.join(small(layers[-1].select(F.col("node").alias("a"))), "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("via"))
        layers.append(cut(nxt.join(seen, "node", "left_anti")))
        met = layers[-1].agg(F.count("*").alias("n"), F.max(F.col("node") == goal).alias("goal")).first()
        if not met["n"]:
            return []
        if met["goal"]:
            break
        seen = cut(seen.unionByName(layers[-1].select("node"))) if len(layers) % 8 == 0 else seen.unionByName(layers[-1].select("node"))
    path = [goal]
    for layer in reversed(layers[1:]):
        path.append(layer.where(F.col("node") == path[-1]).first()["via"])
    return path[::-1]


def adjacency(edges: DataFrame, key: str) -> DataFrame:
    """(``key``, ``neighbour``): every edge from both of its ends, each neighbour once. A hub's neighbours stay rows."""
    return edges.select(F.col("a").alias(key), F.col("b").alias("neighbour")).union(edges.select("b", "a")).distinct()


def induced(nodes: DataFrame, edges: DataFrame, key: str, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The nodes for which ``keep`` holds and the edges among them."""
    own = nodes.where(F.coalesce(keep, F.lit(False)))
    ids = own.select(key).distinct()
    inner = edges.join(ids.withColumnRenamed(key, "a"), "a", "left_semi").join(ids.withColumnRenamed(key, "b"), "b", "left_semi")
    return own, inner.select(*edges.columns)


def project(nodes: DataFrame, edges: DataFrame, key: str, language: str = "en", most: int = 80) -> DataFrame:
    """What a graph shows of a node: headword, romanisation, cluster, number of references, the first definition in ``language`` cut to
    ``most`` characters (null if empty), degree."""
    first = F.get(F.filter("definitions", lambda x: x["language"] == language), F.lit(0))["text"]
    out = nodes.select(
        key, "headword_native", "headword_romanized", F.coalesce(F.nullif(F.col("semantic_cluster"), F.lit("")), F.lit("uncategorized")).alias("cluster"),
        F.coalesce(F.size("cross_references"), F.lit(0)).alias("n_sources"), F.nullif(F.substring(first, 1, most), F.lit("")).alias("definition"),
    )
    return out.join(degrees(nodes, edges, key), key)


def neighbourhood_graph(nodes: DataFrame, edges: DataFrame, root: DataFrame, key: str, vector: str, depth: int = 2, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the neighbourhood of ``root`` (one row), filled up to ``most`` nodes (the feature's cap) with those nearest to its vector,
    and the edges among them. ``hops`` is null for nodes that only the vector brought in."""
    near = cut(neighbourhood(edges, root, key, depth, most))
    have = near.agg(F.count("*").alias("have"))
    q = nodes.join(F.broadcast(root.select(key)), key, "left_semi").where(F.col(vector).isNotNull()).select(F.col(vector).alias("q")).limit(1)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cosine = F.try_divide(dot(F.col(vector), F.col("q")), F.sqrt(dot(F.col(vector), F.col(vector)) * dot(F.col("q"), F.col("q"))))
    rest = nodes.join(small(near.select(key)), key, "left_anti").join(F.broadcast(q)).select(key, F.round(cosine, 9).alias("s")).where("s is not null").orderBy(F.desc("s"), key).limit(most)  # q: one row
    rest = rest.withColumn("r", F.row_number().over(Window.orderBy(F.desc("s"), key))).join(F.broadcast(have)).where(F.col("r") <= most - F.col("have")).select(key, F.lit(None).cast("int").alias("hops"))  # ``most`` rows
    ids = cut(near.select(key, "hops").unionByName(rest))
    own = F.broadcast(ids.select(key))  # at most ``most`` rows
    return ids, edges.join(own.withColumnRenamed(key, "a"), "a", "left_semi").join(own.withColumnRenamed(key, "b"), "b", "left_semi")


def edge_histogram(edges: DataFrame, key: str) -> DataFrame:
    """Edges of each type at each node."""
    x = edges.select(F.explode(F.array("a", "b")).alias(key), "type")
    return x.groupBy(key).pivot("type", list(TYPES)).count().fillna(0)
