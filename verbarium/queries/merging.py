"""Merge-upsert and graph queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbarium.operators import graph as G
from verbarium.operators import merge as M
from verbarium.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ITEMS = """WITH f AS (SELECT id, min(rec_id) AS first FROM vocabulary GROUP BY id),
    x AS (SELECT v.id, v.rec_id, generate_subscripts(v.{a}, 1) AS atx, unnest(v.{a}) AS x, f.first FROM vocabulary v JOIN f USING (id)),
    y AS (SELECT *, coalesce({k}, chr(1)) AS k FROM x WHERE x IS NOT NULL),
    z AS (SELECT *, max((rec_id = first)::INT) OVER (PARTITION BY id, k) AS has, row_number() OVER (PARTITION BY id, k ORDER BY rec_id, atx) AS r FROM y)
    """


@query(ITEMS.format(a="definitions", k="concat_ws('::', x.language, x.text)") + "SELECT id, string_agg(k, '|' ORDER BY rec_id, atx) AS defs FROM z WHERE rec_id = first OR (has = 0 AND r = 1) GROUP BY id")
def merge_definitions(s, d):
    k = lambda x: F.concat_ws("::", x["language"], x["text"])
    x = M.merged_array(table(s, d, "vocabulary"), "id", "rec_id", "definitions", k)
    return x.select("id", F.array_join(F.transform("definitions", k), "|").alias("defs"))


@query(ITEMS.format(a="example_sentences", k="x.target") + "SELECT id, string_agg(coalesce(x.target, '-'), '|' ORDER BY rec_id, atx) AS examples FROM z WHERE rec_id = first OR (has = 0 AND r = 1) GROUP BY id")
def merge_examples(s, d):
    x = M.merged_array(table(s, d, "vocabulary"), "id", "rec_id", "example_sentences", lambda x: x["target"])
    return x.select("id", F.array_join(F.transform("example_sentences", lambda e: F.coalesce(e["target"], F.lit("-"))), "|").alias("examples"))


@query(ITEMS.format(a="cross_references", k="x.source_url") + """, s AS (SELECT id, k, max(s) AS offered FROM (SELECT id, rec_id, k, arg_max(x.reliability_score, atx) AS s FROM y WHERE rec_id > first AND x.reliability_score IS NOT NULL GROUP BY id, rec_id, k) GROUP BY id, k)
    SELECT id, count(*) AS source_count, string_agg(coalesce(x.source_url, '-') || '=' || coalesce(round(greatest(x.reliability_score, offered) * 100)::INT::VARCHAR, '-'), '|' ORDER BY rec_id, atx) AS refs FROM z LEFT JOIN s USING (id, k) WHERE rec_id = first OR (has = 0 AND r = 1) GROUP BY id""")
def merge_references(s, d):
    x = M.merge_references(table(s, d, "vocabulary"), "id", "rec_id")
    ref = lambda r: F.concat(F.coalesce(r["source_url"], F.lit("-")), F.lit("="), F.coalesce(F.round(r["reliability_score"] * 100).cast("int").cast("string"), F.lit("-")))
    return x.select("id", "source_count", F.array_join(F.transform("cross_references", ref), "|").alias("refs"))


@query("""WITH f AS (SELECT *, rec_id = min(rec_id) OVER (PARTITION BY id) AS first FROM vocabulary)
    SELECT id, arg_max(headword_romanized, rec_id) FILTER (WHERE headword_romanized IS NOT NULL AND headword_romanized <> '') AS headword_romanized, arg_max(ipa, rec_id) FILTER (WHERE ipa IS NOT NULL AND ipa <> '') AS ipa,
    arg_max(semantic_cluster, rec_id) FILTER (WHERE semantic_cluster IS NOT NULL) AS semantic_cluster,
    arg_max(language_confidence, (CASE language_confidence WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 0 END) * 1000000000::BIGINT - rec_id) FILTER (WHERE language_confidence IS NOT NULL) AS language_confidence FROM f GROUP BY id""")
def merge_scalars(s, d):
    x = M.merge_scalars(table(s, d, "vocabulary"), "id", "rec_id", ["headword_romanized", "ipa"], ["semantic_cluster"], "language_confidence")
    e = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return x.select("id", e("headword_romanized"), e("ipa"), "semantic_cluster", "language_confidence")


@query("SELECT id, string_agg(t, '|' ORDER BY t) AS terms FROM (SELECT DISTINCT id, unnest(related_terms) AS t FROM vocabulary) WHERE t IS NOT NULL GROUP BY id")
def merge_terms(s, d):
    return M.union_terms(table(s, d, "vocabulary"), "id", "related_terms").where("size(related_terms) > 0").select("id", F.array_join("related_terms", "|").alias("terms"))


@query()
def merge_entries(s, d):
    """The whole merged archive, one row per id."""
    return M.merge_entries(table(s, d, "vocabulary").drop("embedding"))


@query("""SELECT g.id, count(*) AS n, string_agg(u, '|' ORDER BY u) AS urls FROM (SELECT DISTINCT id, unnest(source_urls) AS u FROM grammar) g GROUP BY g.id""")
def merge_grammar_urls(s, d):
    x = M.union_terms(table(s, d, "grammar"), "id", "source_urls")
    return x.select("id", F.size("source_urls").cast("long").alias("n"), F.array_join("source_urls", "|").alias("urls")).where("n > 0")


def _nodes(s, d):
    v = table(s, d, "vocabulary").where("language_code = 'qaa'").orderBy("rec_id").limit(G.FETCH)
    return v.select("rec_id", "headword_native", "semantic_cluster", "related_terms", "embedding")


def _edges(s, d):
    n = _nodes(s, d)
    e = G.related_edges(n, "rec_id", "headword_native", "related_terms").unionByName(G.star_edges(n, "rec_id", "semantic_cluster"))
    return n, G.undirected(e.unionByName(G.similar_edges(n, "rec_id", "embedding")))


GRAPH = """WITH n AS (SELECT rec_id, headword_native, semantic_cluster, related_terms, embedding FROM vocabulary WHERE language_code = 'qaa' ORDER BY rec_id LIMIT 1500),
    h AS (SELECT headword_native AS t, max(rec_id) AS b FROM n WHERE headword_native IS NOT NULL GROUP BY 1),
    rel AS (SELECT a, b, 1.0 AS weight, 1 AS rank, 'related' AS type FROM (SELECT rec_id AS a, unnest(related_terms) AS t FROM n) JOIN h USING (t) WHERE a <> b),
    c AS (SELECT coalesce(semantic_cluster, 'uncategorized') AS c, rec_id, row_number() OVER (PARTITION BY coalesce(semantic_cluster, 'uncategorized') ORDER BY rec_id) AS r FROM n),
    star AS (SELECT h.rec_id AS a, c.rec_id AS b, 0.3 AS weight, 2 AS rank, 'cluster' AS type FROM c JOIN c h ON h.c = c.c AND h.r = 1 WHERE c.r BETWEEN 2 AND 10),
    u AS (SELECT rec_id, CAST(embedding AS DOUBLE[]) AS e FROM n WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    sim AS (SELECT p.rec_id AS a, q.rec_id AS b, round(list_cosine_similarity(p.e, q.e), 9) AS weight, 3 AS rank, 'embedding' AS type FROM u p JOIN u q ON p.rec_id < q.rec_id WHERE round(list_cosine_similarity(p.e, q.e), 9) > 0.6),
    al AS (SELECT least(a, b) AS a, greatest(a, b) AS b, weight, rank, type FROM (SELECT * FROM rel UNION ALL SELECT * FROM star UNION ALL SELECT * FROM sim)),
    e AS (SELECT a, b, weight, type FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY rank, weight DESC) AS r FROM al) WHERE r = 1)
    """
DEG = "dg AS (SELECT n.rec_id, coalesce(k, 0)::BIGINT AS degree FROM n LEFT JOIN (SELECT rec_id, count(*) AS k FROM (SELECT a AS rec_id FROM e UNION ALL SELECT b FROM e) GROUP BY 1) USING (rec_id))"


@query(GRAPH + "SELECT a, b, round(weight, 6)::DOUBLE AS weight, type FROM e")
def graph_edges(s, d):
    return _edges(s, d)[1].select("a", "b", F.round("weight", 6).alias("weight"), "type")


@query(GRAPH + ", " + DEG + " SELECT rec_id, degree FROM dg ORDER BY degree DESC, rec_id LIMIT 50")
def graph_degree_topn(s, d):
    n, e = _edges(s, d)
    return G.top_graph(n, e, "rec_id", 50)[0]


@query(GRAPH + ", " + DEG + ", t AS (SELECT rec_id FROM dg ORDER BY degree DESC, rec_id LIMIT 50) SELECT a, b, type FROM e WHERE a IN (SELECT rec_id FROM t) AND b IN (SELECT rec_id FROM t) ORDER BY weight DESC, a, b LIMIT 125")
def graph_induced_edges(s, d):
    n, e = _edges(s, d)
    return G.top_graph(n, e, "rec_id", 50)[1].select("a", "b", "type")


def _all_edges(s, d):
    """Related and cluster edges over the whole archive."""
    n = table(s, d, "vocabulary").select("rec_id", "headword_native", "semantic_cluster", "related_terms")
    return G.undirected(G.related_edges(n, "rec_id", "headword_native", "related_terms").unionByName(G.star_edges(n, "rec_id", "semantic_cluster")))


GRAPH_ALL = GRAPH[: GRAPH.index("    u AS")].replace(" WHERE language_code = 'qaa' ORDER BY rec_id LIMIT 1500", "") + """    al AS (SELECT least(a, b) AS a, greatest(a, b) AS b, weight, rank, type FROM (SELECT * FROM rel UNION ALL SELECT * FROM star)),
    e AS (SELECT a, b, weight, type FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY rank, weight DESC) AS r FROM al) WHERE r = 1)
    """


@query(GRAPH_ALL + """, sy AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT min(a) AS k FROM e), h1 AS (SELECT DISTINCT b AS k FROM sy WHERE a IN (SELECT k FROM r) AND b NOT IN (SELECT k FROM r)),
    h2 AS (SELECT DISTINCT b AS k FROM sy WHERE a IN (SELECT k FROM h1) AND b NOT IN (SELECT k FROM h1) AND b NOT IN (SELECT k FROM r))
    SELECT k AS rec_id, hops FROM (SELECT k, 0 AS hops FROM r UNION ALL SELECT k, 1 FROM h1 UNION ALL SELECT k, 2 FROM h2) ORDER BY hops, k LIMIT 50""")
def bfs_depth2(s, d):
    e = _all_edges(s, d)
    return G.neighbourhood(e, e.agg(F.min("a").alias("rec_id")), "rec_id")


@query(GRAPH_ALL + "SELECT rec_id, count(*) FILTER (WHERE type = 'related') AS related, count(*) FILTER (WHERE type = 'cluster') AS cluster, count(*) FILTER (WHERE type = 'embedding') AS embedding FROM (SELECT a AS rec_id, type FROM e UNION ALL SELECT b, type FROM e) GROUP BY rec_id")
def edge_histogram(s, d):
    return G.edge_histogram(_all_edges(s, d), "rec_id")


@query("SELECT a, b FROM (WITH c AS (SELECT coalesce(semantic_cluster, 'uncategorized') AS c, rec_id, row_number() OVER (PARTITION BY coalesce(semantic_cluster, 'uncategorized') ORDER BY rec_id) AS r FROM vocabulary) SELECT h.rec_id AS a, c.rec_id AS b FROM c JOIN c h ON h.c = c.c AND h.r = 1 WHERE c.r BETWEEN 2 AND 10)")
def cluster_star(s, d):
    return G.star_edges(table(s, d, "vocabulary"), "rec_id", "semantic_cluster").select("a", "b")


@query()
def shortest_path(s, d):
    """A shortest path from the smallest to the greatest connected node."""
    e = _all_edges(s, d)
    ends = e.agg(F.min("a").alias("x"), F.max("b").alias("y")).first()
    path = G.shortest_path(e, ends["x"], ends["y"]) if ends["x"] is not None else []
    return s.createDataFrame(list(enumerate(path)), "step int, rec_id long")


QUERIES = Q
