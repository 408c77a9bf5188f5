"""Retrieval queries (full text, vectors, fusion, facets of relevance) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbarium.functions import text as X
from verbarium.operators import retrieval as R
from verbarium.sources.tables import table

QUERY = "river stone"
WORDS = QUERY.split()
TOK = r"[\p{L}\p{N}\p{M}]+"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "source", "lang")


def bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    x = R.bm25(_docs(spark, d), "doc_id", X.tokens(F.col("text")), WORDS).where("score > 0")
    return R.top(x.select("doc_id", R.round_score("score").alias("score")), F.col("score"), "doc_id", 50)


def _bm25_sql(table_: str, key: str, words: str, query: list[str], name: str = "score") -> str:
    """A SELECT of (key, name) for all rows: the same formula over a word-list expression."""
    n = f"(SELECT count(*) FROM {table_})"
    avg = f"(SELECT avg(coalesce(len({words}), 0)) FROM {table_})"
    terms = []
    for q in dict.fromkeys(query):
        tf = f"coalesce(len(list_filter({words}, lambda z: z = '{q}')), 0)"
        df = f"(SELECT count(*) FROM {table_} WHERE {tf} > 0)"
        terms.append(f"ln(1 + ({n} - {df} + 0.5) / ({df} + 0.5)) * ({tf} * 2.2) / ({tf} + 1.2 * (0.25 + 0.75 * coalesce(len({words}), 0) / {avg}))")
    return f"SELECT {key}, {' + '.join(terms)} AS {name} FROM {table_}"


BM25_SQL = f"""WITH t AS ({_bm25_sql('documents', 'doc_id', f"regexp_extract_all(lower(text), '{TOK}')", WORDS)})
    SELECT doc_id, round(score, 6) AS score FROM t WHERE score > 0 ORDER BY round(score, 6) DESC, doc_id LIMIT 50"""


def definition_bm25(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vocabulary").select("rec_id", "definitions")
    words = F.flatten(F.transform("definitions", lambda x: F.coalesce(X.tokens(x["text"]), F.array().cast("array<string>"))))
    x = R.bm25(v, "rec_id", words, ["fishing", "net"]).where("score > 0").select("rec_id", R.round_score("score").alias("score"))
    return R.top(x, F.col("score"), "rec_id", 50)


DEFINITION_SQL = f"""WITH v AS (SELECT rec_id, coalesce(flatten(list_transform(definitions, lambda x: coalesce(regexp_extract_all(lower(x.text), '{TOK}'), []))), []) AS w FROM vocabulary),
    t AS ({_bm25_sql('v', 'rec_id', 'w', ['fishing', 'net'])}) SELECT rec_id, round(score, 6) AS score FROM t WHERE score > 0 ORDER BY round(score, 6) DESC, rec_id LIMIT 50"""


def multi_field_best(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vocabulary").select("rec_id", "headword_native", "headword_romanized", "ipa", "cultural_context")
    q = "fishing net"
    clauses = tuple(c for c in R.ENTRY_FIELDS if c[1] in ("exact", "tokens", "ipa"))
    x = R.best_fields(v, "rec_id", q, clauses).where("best > 0").select("rec_id", R.round_score("best").alias("score"))
    return R.top(x, F.col("score"), "rec_id", 50)


def _fields_sql() -> str:
    q, parts = "fishing net", []
    for i, (f, how, w) in enumerate(c for c in R.ENTRY_FIELDS if c[1] in ("exact", "tokens", "ipa")):
        words = {"exact": f"[{f}]", "tokens": f"regexp_extract_all(lower({f}), '{TOK}')", "ipa": f"[lower(regexp_replace({f}, '[/\\[\\]ˈˌːˑ.‿]', '', 'g'))]"}[how]
        query = [q] if how == "exact" else ["fishing net"] if how == "ipa" else q.split()
        parts.append(f"SELECT rec_id, s * {w} AS s FROM ({_bm25_sql('vocabulary', 'rec_id', words, query, 's')})")
    return f"WITH t AS ({' UNION ALL '.join(parts)}), b AS (SELECT rec_id, round(max(s), 6) AS score FROM t GROUP BY rec_id) SELECT rec_id, score FROM b WHERE score > 0 ORDER BY score DESC, rec_id LIMIT 50"


def prefix_match(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vocabulary").select("rec_id", "headword_native")
    return v.where(F.array_contains(X.edge_ngrams(X.tokens(F.col("headword_native"))), "tse"))


def romanize(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vocabulary").select("rec_id", "headword_romanized").where(F.col("headword_romanized").isNotNull())
    return v.select("rec_id", F.array_join(X.roman_tokens(F.col("headword_romanized")), " ").alias("folded"))


def fuzzy_ascii(spark: SparkSession, d: str) -> DataFrame:
    """Words of ASCII definitions within the automatic edit distance of a misspelt term."""
    v = table(spark, d, "vocabulary").select("rec_id", F.explode("definitions").alias("d")).where("d.language = 'en'")
    w = v.select("rec_id", F.explode(X.tokens(F.col("d.text"))).alias("word")).where(~F.col("word").rlike(r"[^a-z]"))
    return w.where((F.abs(F.length("word") - 6) <= 2) & (F.levenshtein("word", F.lit("harpom"), 2) >= 0) | (F.levenshtein("word", F.lit("basked"), 2) >= 0)).distinct()


def edge_ngrams(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "languages").select("glottocode", "name")
    return v.select("glottocode", F.explode(X.edge_ngrams(X.tokens(F.col("name")))).alias("gram")).distinct()


def ipa_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vocabulary").where("ipa is not null").select("rec_id", X.ipa_key(F.col("ipa")).alias("ipa_key"))


def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    q = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    x = v.join(F.broadcast(q)).withColumn("similarity", F.round(R.cosine(F.col("embedding"), F.col("q")), 6))  # q: one row
    return R.top(x.select("vec_id", "similarity"), F.col("similarity"), "vec_id", 20)


def similar_entries(spark: SparkSession, d: str) -> DataFrame:
    """Nearest entries to one entry, other headwords only."""
    v = table(spark, d, "vocabulary").select("rec_id", "headword_native", "embedding")
    q = v.where("embedding is not null").orderBy("rec_id").limit(1).select(F.col("headword_native").alias("h"), F.col("embedding").alias("q"))
    x = v.where("embedding is not null").join(F.broadcast(q)).where("not headword_native <=> h")  # q: one row
    x = x.select("rec_id", F.round(R.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
    return R.top(x, F.col("similarity"), "rec_id", 10)


def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    docs = R.bm25(_docs(spark, d), "doc_id", X.tokens(F.col("text")), WORDS).where("score > 0").select("doc_id", R.round_score("score").alias("score"))
    vec = knn_cosine(spark, d).select(F.col("vec_id").alias("doc_id"), F.col("similarity").alias("score"))
    x = R.rank_fusion([docs, vec], "doc_id").select("doc_id", F.round("rrf", 9).alias("rrf"))
    return R.top(x, F.col("rrf"), "doc_id", 10)


COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
KNN_SQL = f"""SELECT e.vec_id, round({COS.format(a='e.embedding', b='q.embedding')}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY similarity DESC, vec_id LIMIT 20"""


def entry_search(spark: SparkSession, d: str) -> DataFrame:
    """The whole clause sum over vocabulary rows."""
    x = R.entry_search(table(spark, d, "vocabulary").drop("embedding"), "rec_id", "fishing net")
    return R.top(x.select("rec_id", R.round_score("score").alias("score")), F.col("score"), "rec_id", 20)


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vocabulary")
    q = v.where("embedding is not null").orderBy("rec_id").select("embedding").first()
    return R.hybrid(v, "rec_id", "fishing net", "embedding", list(q[0]) if q else [0.0] * 64).select("rec_id", F.round("rrf", 9).alias("rrf"))


def cluster_fill(spark: SparkSession, d: str) -> DataFrame:
    """A short page of hits filled with other entries of the hits' clusters, up to twelve rows."""
    v = table(spark, d, "vocabulary").select("rec_id", "headword_native", "semantic_cluster")
    hits = v.where(F.col("headword_native").startswith("ka")).orderBy("rec_id").limit(5)
    own = hits.select("semantic_cluster").where("semantic_cluster is not null").distinct()
    more = v.join(F.broadcast(own), "semantic_cluster", "left_semi").join(F.broadcast(hits.select("rec_id")), "rec_id", "left_anti")  # five rows
    n = hits.agg(F.count("*").alias("have"))
    extra = more.orderBy("rec_id").limit(12).withColumn("r", F.row_number().over(R.Window.orderBy("rec_id"))).join(F.broadcast(n)).where("r <= 12 - have")
    return hits.select("rec_id", F.lit("hit").alias("kind")).unionByName(extra.select("rec_id", F.lit("cluster").alias("kind")))


def significant_terms(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vocabulary").select("language_code", "semantic_cluster")
    x = R.significant_terms(v, F.col("semantic_cluster"), F.col("language_code") == "qaa")
    return x.select("term", "fg", "bg", R.round_score("score").alias("score"))


def significant_related(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vocabulary").select("pos", "related_terms")
    x = R.significant_terms(v, F.col("related_terms"), F.col("pos") == "verb")
    return x.select("term", "fg", "bg", R.round_score("score").alias("score"))


def grammar_search(spark: SparkSession, d: str) -> DataFrame:
    """Hits in any text field or nested example, newest first: the score does not order them."""
    g = table(spark, d, "grammar")
    words = F.concat(*(F.coalesce(X.tokens(F.col(c)), F.array().cast("array<string>")) for c in ("title", "description", "rule", "category")),
                     F.coalesce(F.flatten(F.transform("examples", lambda x: F.coalesce(X.tokens(x["english"]), F.array().cast("array<string>")))), F.array().cast("array<string>")))
    x = g.where(F.arrays_overlap(words, F.array(F.lit("harvest"), F.lit("verb"))))
    return x.select("id", "title", "created_at").distinct().orderBy(F.col("created_at").desc_nulls_last(), "id", "title").limit(20)


def language_search(spark: SparkSession, d: str) -> DataFrame:
    """Fuzzy best field or phrase prefix over names; score is the best weighted hit."""
    v = table(spark, d, "languages")
    q = "tol"
    names = F.concat(F.array("name"), F.coalesce("alternate_names", F.array().cast("array<string>")))
    prefix = F.exists(names, lambda n: F.exists(X.tokens(n), lambda w: w.startswith(q)))
    fields = (("name", 3), ("iso_code", 3), ("glottocode", 3), ("language_family", 1))
    hit = lambda c: F.coalesce(F.array_contains(X.tokens(F.col(c)), q), F.lit(False))
    score = F.greatest(*(F.when(hit(c), w).otherwise(0) for c, w in fields), F.when(F.coalesce(prefix, F.lit(False)), 2).otherwise(0))
    return v.select("glottocode", "name", score.alias("score")).where("score > 0")


def quick_search(spark: SparkSession, d: str) -> DataFrame:
    """The first five hits of each kind in one result."""
    q = "%son%"
    lang = table(spark, d, "languages").where(F.lower("name").like(q)).orderBy("glottocode").limit(5).select(F.lit("language").alias("kind"), F.col("glottocode").alias("key"), F.col("name").alias("label"))
    voc = table(spark, d, "vocabulary").where(F.lower("headword_native").like(q)).orderBy("rec_id").limit(5).select(F.lit("entry"), F.col("rec_id").cast("string"), "headword_native")
    gra = table(spark, d, "grammar").where(F.lower("title").like(q)).select("id", "title").distinct().orderBy("id", "title").limit(5).select(F.lit("grammar"), "id", "title")
    return lang.union(voc).union(gra)


def fuzzy_word_join(spark: SparkSession, d: str) -> DataFrame:
    """Different words of English definitions up to two edits apart."""
    v = table(spark, d, "vocabulary").select(F.explode("definitions").alias("d")).where("d.language = 'en'")
    w = v.select(F.explode(X.tokens(F.col("d.text"))).alias("w")).where(F.col("w").rlike("^[a-z]{3,8}$")).distinct()
    return R.fuzzy_join(w, w, "w", 2).where("w_l < w_r").select(F.col("w_l").alias("a"), F.col("w_r").alias("b"))


def _close(words: DataFrame) -> DataFrame:
    """Different words ``w`` up to two edits apart, each pair once."""
    return R.fuzzy_join(words, words, "w", 2).where("w_l < w_r").select(F.col("w_l").alias("a"), F.col("w_r").alias("b"))


def fuzzy_definition_join(spark: SparkSession, d: str) -> DataFrame:
    """Different words of all definitions up to two edits apart, of any length, script and language."""
    v = table(spark, d, "vocabulary").select(F.explode("definitions").alias("d"))
    return _close(v.select(F.explode(X.tokens(F.col("d.text"))).alias("w")))


def fuzzy_headword_join(spark: SparkSession, d: str) -> DataFrame:
    """Different headwords up to two edits apart, whole and as they stand."""
    return _close(table(spark, d, "vocabulary").select(F.col("headword_native").alias("w")))


def substring_search(spark: SparkSession, d: str) -> DataFrame:
    """Case-insensitive containment over the joined fields of an entry."""
    text = F.lower(F.concat_ws(" ", "headword_native", "headword_romanized", "semantic_cluster", F.array_join(F.transform("definitions", lambda x: x["text"]), " ")))
    return table(spark, d, "vocabulary").where(text.contains("fishing net")).select("rec_id")


QUERIES = {f.__name__: f for f in (
    bm25_documents, definition_bm25, multi_field_best, prefix_match, romanize, fuzzy_ascii, edge_ngrams, ipa_key, knn_cosine, similar_entries, rrf_hybrid,
    entry_search, hybrid_search, cluster_fill, significant_terms, significant_related, grammar_search, language_search, quick_search, fuzzy_word_join, fuzzy_definition_join, fuzzy_headword_join, substring_search,
)}


def _sig(n: str, x: str, cond: str) -> str:
    return f"""WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE {cond}) AS nf FROM vocabulary),
        x AS ({x}), g AS (SELECT t AS term, count(*) FILTER (WHERE f) AS fg, count(*) AS bg FROM x WHERE t IS NOT NULL GROUP BY t)
        SELECT term, fg, bg, round((fg / nf - bg / n) * ((fg / nf) / (bg / n)), 6) AS score FROM g, n WHERE fg >= 2 AND (fg / nf - bg / n) > 0"""


def _romanize_sql() -> str:
    """The same letter tables, and accents taken off by DuckDB's own rule."""
    x = "headword_romanized"
    for a, b in {**X.ROMAN_TWO, **X.ROMAN_ONE}.items():
        x = f"replace({x}, '{a}', '{b}')"
    return f"SELECT rec_id, array_to_string(regexp_extract_all(strip_accents(lower({x})), '{TOK}'), ' ') AS folded FROM vocabulary WHERE headword_romanized IS NOT NULL"


def _entry_search_sql(query: str = "fishing net") -> str:
    """The clause sum: the best weighted field, then the other clauses, each the same formula over its own words."""
    roman = _romanize_sql().split("regexp_extract_all(")[1].rsplit(", '" + TOK, 1)[0]
    words = lambda c: f"regexp_extract_all(lower({c}), '{TOK}')"
    made = {
        "exact": lambda c: f"[{c}]", "tokens": words, "roman": lambda c: f"regexp_extract_all({roman}, '{TOK}')",
        "prefix": lambda c: f"flatten(list_transform({words(c)}, lambda w: list_transform(range(2, least(15, length(w)) + 1), lambda n: substr(w, 1, n))))",
        "ipa": lambda c: f"[lower(regexp_replace({c}, '[/\\[\\]ˈˌːˑ.‿]', '', 'g'))]",
    }
    nested = lambda c, f: f"flatten(list_transform({c}, lambda x: coalesce(regexp_extract_all(lower(x.{f}), '{TOK}'), [])))"
    parts = [(f"b{i}", made[how](f), [query] if how in ("exact", "ipa") else query.split(), w, "best") for i, (f, how, w) in enumerate(R.ENTRY_FIELDS)]
    parts += [("r0", made["roman"](""), query.split(), 3.5, "sum"), ("r1", nested("definitions", "text"), query.split(), 2.0, "sum")]
    parts += [(f"r{i + 2}", nested("example_sentences", f), query.split(), w, "sum") for i, (f, w) in enumerate((("target", 1.5), ("contact", 1.5), ("english", 1.0)))]
    cols = ", ".join(f"coalesce({x}, []) AS {n}" for n, x, *_ in parts)
    each = " UNION ALL ".join(f"SELECT rec_id, '{k}' AS k, s * {w} AS s FROM ({_bm25_sql('v', 'rec_id', n, q, 's')})" for n, _, q, w, k in parts)
    near = f"3 * (len(list_filter(coalesce({words('headword_romanized')}, []), lambda w: levenshtein(w, '{query}') <= 2)) > 0)::INT"
    return f"""WITH v AS MATERIALIZED (SELECT rec_id, {near} AS near, {cols} FROM vocabulary), t AS ({each}),
        z AS (SELECT rec_id, max(s) FILTER (WHERE k = 'best') + sum(s) FILTER (WHERE k = 'sum') AS s FROM t GROUP BY rec_id)
        SELECT rec_id, round(s + near, 6) AS score FROM z JOIN v USING (rec_id) WHERE s + near > 0 ORDER BY score DESC, rec_id LIMIT 20"""


SQL = {
    "entry_search": _entry_search_sql(),
    "fuzzy_word_join": f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(d.text), '{TOK}')) AS w FROM (SELECT unnest(definitions) AS d FROM vocabulary) WHERE d.language = 'en'), v AS (SELECT w FROM w WHERE regexp_matches(w, '^[a-z]{{3,8}}$'))
        SELECT x.w AS a, y.w AS b FROM v x JOIN v y ON x.w < y.w AND levenshtein(x.w, y.w) <= 2""",
    "substring_search": "SELECT rec_id FROM vocabulary WHERE contains(lower(concat_ws(' ', headword_native, headword_romanized, semantic_cluster, array_to_string(list_transform(definitions, lambda x: x.text), ' '))), 'fishing net')",
    "bm25_documents": BM25_SQL,
    "definition_bm25": DEFINITION_SQL,
    "multi_field_best": _fields_sql(),
    "romanize": _romanize_sql(),
    "prefix_match": f"SELECT rec_id, headword_native FROM vocabulary WHERE len(list_filter(regexp_extract_all(lower(headword_native), '{TOK}'), lambda w: starts_with(w, 'tse'))) > 0",
    "edge_ngrams": f"SELECT DISTINCT glottocode, g AS gram FROM (SELECT glottocode, w, unnest(range(2, least(15, length(w)) + 1)) AS n, substr(w, 1, n) AS g FROM (SELECT glottocode, unnest(regexp_extract_all(lower(name), '{TOK}')) AS w FROM languages))",
    "ipa_key": r"SELECT rec_id, lower(regexp_replace(ipa, '[/\[\]ˈˌːˑ.‿]', '', 'g')) AS ipa_key FROM vocabulary WHERE ipa IS NOT NULL",
    "fuzzy_ascii": f"""SELECT DISTINCT rec_id, word FROM (SELECT rec_id, unnest(regexp_extract_all(lower(d.text), '{TOK}')) AS word FROM (SELECT rec_id, unnest(definitions) AS d FROM vocabulary) WHERE d.language = 'en')
        WHERE NOT regexp_matches(word, '[^a-z]') AND (levenshtein(word, 'harpom') <= 2 OR levenshtein(word, 'basked') <= 2)""",
    "knn_cosine": KNN_SQL,
    "similar_entries": f"""WITH q AS (SELECT headword_native AS h, embedding AS qv FROM vocabulary WHERE embedding IS NOT NULL ORDER BY rec_id LIMIT 1)
        SELECT rec_id, round(coalesce(CASE WHEN isnan({COS.format(a='embedding', b='qv')}) THEN 0 ELSE {COS.format(a='embedding', b='qv')} END, 0), 6) AS similarity FROM vocabulary, q
        WHERE embedding IS NOT NULL AND headword_native IS DISTINCT FROM h ORDER BY similarity DESC, rec_id LIMIT 10""",
    "rrf_hybrid": f"""WITH t AS ({_bm25_sql('documents', 'doc_id', f"regexp_extract_all(lower(text), '{TOK}')", WORDS)}),
        a AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS r FROM t WHERE score > 0), k AS ({KNN_SQL}),
        b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS r FROM k),
        u AS (SELECT * FROM a WHERE r <= 50 UNION ALL SELECT * FROM b WHERE r <= 50)
        SELECT doc_id, round(sum(1.0 / (20 + r)), 9) AS rrf FROM u GROUP BY doc_id ORDER BY rrf DESC, doc_id LIMIT 10""",
    "cluster_fill": """WITH h AS (SELECT rec_id, semantic_cluster FROM vocabulary WHERE starts_with(headword_native, 'ka') ORDER BY rec_id LIMIT 5),
        m AS (SELECT rec_id, row_number() OVER (ORDER BY rec_id) AS r FROM vocabulary WHERE semantic_cluster IN (SELECT semantic_cluster FROM h WHERE semantic_cluster IS NOT NULL) AND rec_id NOT IN (SELECT rec_id FROM h))
        SELECT rec_id, 'hit' AS kind FROM h UNION ALL SELECT rec_id, 'cluster' FROM m WHERE r <= 12 - (SELECT count(*) FROM h)""",
    "significant_terms": _sig("a", "SELECT coalesce(language_code = 'qaa', false) AS f, semantic_cluster AS t FROM vocabulary", "language_code = 'qaa'"),
    "significant_related": _sig("b", "SELECT coalesce(pos = 'verb', false) AS f, unnest(list_distinct(related_terms)) AS t FROM vocabulary", "pos = 'verb'"),
    "grammar_search": f"""SELECT DISTINCT id, title, created_at FROM grammar WHERE list_has_any(regexp_extract_all(lower(concat_ws(' ', title, description, rule, category, array_to_string(list_transform(examples, lambda x: x.english), ' '))), '{TOK}'), ['harvest', 'verb'])
        ORDER BY created_at DESC NULLS LAST, id, title LIMIT 20""",
    "quick_search": """SELECT * FROM (SELECT 'language' AS kind, glottocode AS key, name AS label FROM languages WHERE lower(name) LIKE '%son%' ORDER BY glottocode LIMIT 5)
        UNION ALL SELECT * FROM (SELECT 'entry', CAST(rec_id AS VARCHAR), headword_native FROM vocabulary WHERE lower(headword_native) LIKE '%son%' ORDER BY rec_id LIMIT 5)
        UNION ALL SELECT * FROM (SELECT 'grammar', id, title FROM (SELECT DISTINCT id, title FROM grammar WHERE lower(title) LIKE '%son%') ORDER BY id, title LIMIT 5)""",
    "language_search": f"""SELECT * FROM (SELECT glottocode, name, CAST(greatest(CASE WHEN list_contains(regexp_extract_all(lower(name), '{TOK}'), 'tol') THEN 3 ELSE 0 END, CASE WHEN lower(iso_code) = 'tol' THEN 3 ELSE 0 END,
        CASE WHEN lower(glottocode) = 'tol' THEN 3 ELSE 0 END, CASE WHEN list_contains(regexp_extract_all(lower(language_family), '{TOK}'), 'tol') THEN 1 ELSE 0 END,
        CASE WHEN len(list_filter(flatten(list_transform(list_prepend(name, coalesce(alternate_names, [])), lambda n: regexp_extract_all(lower(n), '{TOK}'))), lambda w: starts_with(w, 'tol'))) > 0 THEN 2 ELSE 0 END) AS INT) AS score FROM languages) WHERE score > 0""",
}
