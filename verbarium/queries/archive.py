"""Archive queries: filters, verification, clip matching, updates, rollups, graph views, extraction answers; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbarium.functions import classify as C
from verbarium.functions import media
from verbarium.functions import text as X
from verbarium.operators import archive as A
from verbarium.operators import graph as G
from verbarium.operators import merge as M
from verbarium.operators import nested
from verbarium.operators import retrieval as R
from verbarium.plans.runtime import spread
from verbarium.queries.merging import GRAPH, _edges
from verbarium.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}
TOK = r"[\p{L}\p{N}\p{M}]+"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# predicates


@query("SELECT glottocode, name, endangerment_level FROM languages WHERE macroarea IS NOT NULL AND endangerment_status IS DISTINCT FROM 'extinct' AND (coalesce(speaker_count, 0) > 1000 OR coalesce(len(countries), 0) > 1) ORDER BY endangerment_level DESC NULLS LAST, glottocode LIMIT 30")
def boolean_tree(s: SparkSession, d: str) -> DataFrame:
    """must, must_not and should of which one must hold."""
    x = A.boolean(table(s, d, "languages"), must=[F.col("macroarea").isNotNull()], must_not=[F.col("endangerment_status") == "extinct"], should=[F.col("speaker_count") > 1000, F.size("countries") > 1], least=1)
    return x.select("glottocode", "name", "endangerment_level").orderBy(F.col("endangerment_level").desc_nulls_last(), "glottocode").limit(30)


_SORTS = {"name": "name", "level": "endangerment_level", "speakers": "speaker_count", "countries": "list_aggregate(countries, 'min')"}


def _sorted(by: str, descending: bool):
    def run(s: SparkSession, d: str) -> DataFrame:
        return A.sorted_languages(table(s, d, "languages"), by, descending).limit(25).select("glottocode", "name")

    return run


for _by, _sql in _SORTS.items():
    for _desc in (False, True):
        _name = f"sort_{_by}_{'desc' if _desc else 'asc'}"
        Q[_name] = _sorted(_by, _desc)
        SQL[_name] = f"SELECT glottocode, name FROM languages ORDER BY {_sql.replace('min', 'max') if _desc else _sql} {'DESC' if _desc else 'ASC'} NULLS LAST, glottocode LIMIT 25"


@query("SELECT rec_id, headword_native FROM vocabulary WHERE semantic_cluster = 'kinship' AND len(list_filter(cross_references, lambda x: x.source_type = 'wiki')) > 0 ORDER BY rec_id LIMIT 20 OFFSET 20")
def cluster_source_page(s, d):
    v = table(s, d, "vocabulary").where("semantic_cluster = 'kinship'").where(F.exists("cross_references", lambda x: x["source_type"] == "wiki"))
    return v.select("rec_id", "headword_native").orderBy("rec_id").offset(20).limit(20)


@query("SELECT DISTINCT id, title FROM grammar WHERE confidence = 'high' AND len(examples) > 0")
def grammar_filters(s, d):
    return table(s, d, "grammar").where("confidence = 'high' and size(examples) > 0").select("id", "title").distinct()


@query("SELECT rec_id, headword_native, headword_romanized FROM vocabulary WHERE contains(lower(headword_native), 'tse') OR contains(lower(headword_romanized), 'tse') ORDER BY rec_id LIMIT 5")
def graph_search(s, d):
    has = lambda c: F.coalesce(F.lower(c).contains("tse"), F.lit(False))
    return table(s, d, "vocabulary").select("rec_id", "headword_native", "headword_romanized").where(has("headword_native") | has("headword_romanized")).orderBy("rec_id").limit(5)


@query("SELECT rec_id, audio_url FROM vocabulary WHERE starts_with(audio_url, 'http') AND NOT starts_with(audio_url, 'https://audio.example/qaa') ORDER BY rec_id LIMIT 200")
def external_audio(s, d):
    v = table(s, d, "vocabulary").select("rec_id", "audio_url")
    return v.where(F.col("audio_url").startswith("http") & ~F.col("audio_url").startswith("https://audio.example/qaa")).orderBy("rec_id").limit(200)


@query("""SELECT crawl_id, length(trim(content)) >= 300 AS extract, length(trim(content)) >= 200 OR coalesce(metadata.type = 'video', false) AS accept, length(trim(content)) >= 100 AS site_page, length(trim(content)) < 50 AS triage FROM crawl_results WHERE content IS NOT NULL""")
def content_gates(s, d):
    return A.content_gates(table(s, d, "crawl_results").where("content is not null"), "content", F.col("metadata.type")).select("crawl_id", "extract", "accept", "site_page", "triage")


@query("""SELECT DISTINCT d.doc_id, v.headword_native FROM documents d JOIN (SELECT DISTINCT headword_native, glottocode FROM vocabulary WHERE trim(coalesce(headword_native, '')) <> '' AND len(list_filter(definitions, lambda x: trim(coalesce(x.text, '')) <> '')) > 0) v ON v.glottocode = d.glottocode AND contains(d.text, v.headword_native)""")
def verified_in_text(s, d):
    """Headwords with a definition that their language's documents really contain."""
    return A.verified(table(s, d, "vocabulary"), table(s, d, "documents"), "glottocode", "doc_id", "text")


# joins


@query(r"""WITH n AS (SELECT rec_id, lower(nfc_normalize(regexp_replace(coalesce(headword_native, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))) AS n, lower(nfc_normalize(regexp_replace(coalesce(headword_romanized, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))) AS r, audio_url FROM vocabulary),
    c AS (SELECT r AS w, min(audio_url) AS url FROM n WHERE audio_url <> '' AND r <> '' GROUP BY 1), v AS (SELECT rec_id, n, r FROM n WHERE coalesce(audio_url, '') = ''),
    e AS (SELECT rec_id, n, a.url AS u1, b.url AS u2 FROM v LEFT JOIN c a ON a.w = v.n LEFT JOIN c b ON b.w = v.r),
    o AS (SELECT DISTINCT n FROM e WHERE u1 IS NULL AND u2 IS NULL AND length(n) > 1),
    p AS (SELECT n, w, levenshtein(n, w) AS dist FROM o JOIN c ON abs(length(n) - length(w)) <= 3), q AS (SELECT n, arg_min(w, dist * 1000000 + rk) AS w FROM (SELECT *, dense_rank() OVER (ORDER BY w) AS rk FROM p WHERE dist <= CASE WHEN length(n) <= 3 THEN 1 WHEN length(n) <= 6 THEN 2 ELSE 3 END) GROUP BY n)
    SELECT rec_id, coalesce(u1, u2, c.url) AS url, CASE WHEN u1 IS NOT NULL THEN 'native' WHEN u2 IS NOT NULL THEN 'romanized' ELSE 'fuzzy' END AS how FROM e LEFT JOIN q USING (n) LEFT JOIN c ON c.w = q.w WHERE coalesce(u1, u2, c.url) IS NOT NULL""")
def clip_match(s, d):
    """Clips for entries without audio in three stages: native headword, romanised one, then the nearest by edit distance."""
    return A.match_clips(table(s, d, "vocabulary").select("rec_id", "headword_native", "headword_romanized", "audio_url"), "rec_id")


@query("SELECT DISTINCT rec_id FROM (SELECT rec_id, unnest(cross_references).source_url AS url FROM vocabulary) WHERE url IN (SELECT unnest(cross_references).source_url FROM vocabulary WHERE language_code = 'qaa')")
def entries_citing(s, d):
    """Entries that cite a source the first language cites."""
    v = table(s, d, "vocabulary")
    refs = lambda x: x.select("rec_id", F.explode("cross_references").alias("r")).select("rec_id", F.col("r.source_url").alias("url")).where("url is not null")
    return refs(v).join(refs(v.where("language_code = 'qaa'")).select("url").distinct(), "url", "left_semi").select("rec_id").distinct()


@query(r"SELECT DISTINCT url FROM crawl_results WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM source_outcomes WHERE url IS NOT NULL) AND NOT regexp_matches(lower(url), '^https?://([^/]*\.)?(facebook|twitter|instagram|pinterest)\.')")
def unreported_urls(s, d):
    """Addresses not yet reported on and not on a denied host."""
    x = table(s, d, "crawl_results").select("url").where("url is not null").distinct()
    x = x.where(~F.lower("url").rlike(r"^https?://([^/]*\.)?(facebook|twitter|instagram|pinterest)\."))
    return x.join(table(s, d, "source_outcomes").select("url").where("url is not null").distinct(), "url", "left_anti")


@query("WITH c AS (SELECT country, count(*) AS n, max(endangerment_level) AS worst FROM (SELECT unnest(countries) AS country, endangerment_level FROM languages) GROUP BY 1) SELECT p.iso, coalesce(n, 0) AS n, coalesce(worst, 0) AS worst FROM (SELECT unnest(['XA', 'XB', 'XC', 'XD', 'XE', 'ZZ']) AS iso) p LEFT JOIN c ON c.country = p.iso")
def country_polygons(s, d):
    """Every shape of a map with its country's figures, 0 where there are none."""
    shapes = s.createDataFrame([(x,) for x in ("XA", "XB", "XC", "XD", "XE", "ZZ")], "iso string")
    c = table(s, d, "languages").select(F.explode("countries").alias("iso"), "endangerment_level").groupBy("iso").agg(F.count("*").alias("n"), F.max("endangerment_level").alias("worst"))
    return shapes.join(c, "iso", "left").fillna(0)


@query("""WITH w AS (SELECT DISTINCT language_code, headword_native AS w FROM vocabulary WHERE semantic_cluster = 'kinship' AND headword_native IS NOT NULL), g AS (SELECT language_code, id, title, related_vocabulary FROM grammar WHERE id IS NOT NULL),
    x AS (SELECT language_code, id, unnest(related_vocabulary) AS w FROM g), hit AS (SELECT DISTINCT language_code, id FROM x JOIN w USING (language_code, w))
    SELECT g.language_code, min(struct_pack(miss := (hit.id IS NULL)::INT, id := g.id)).id AS id, bool_or(hit.id IS NOT NULL) AS overlaps FROM g LEFT JOIN hit ON hit.language_code = g.language_code AND hit.id = g.id WHERE g.language_code IS NOT NULL GROUP BY 1""")
def lesson_pattern(s, d):
    """For each language the grammar pattern that shares a word with its kinship lesson, else its first one."""
    words = table(s, d, "vocabulary").where("semantic_cluster = 'kinship' and headword_native is not null").select("language_code", F.col("headword_native").alias("w")).distinct()
    g = table(s, d, "grammar").where("id is not null and language_code is not null")
    hit = g.select("language_code", "id", F.explode("related_vocabulary").alias("w")).join(words, ["language_code", "w"], "left_semi").select("language_code", "id").distinct().withColumn("hit", F.lit(True))
    x = g.select("language_code", "id").join(hit, ["language_code", "id"], "left")
    miss = F.when(F.col("hit"), 0).otherwise(1)
    return x.groupBy("language_code").agg(F.min(F.struct(miss.alias("miss"), "id")).alias("m"), F.coalesce(F.max("hit"), F.lit(False)).alias("overlaps")).select("language_code", "m.id", "overlaps")


@query("""WITH n AS (SELECT language_code, list_slice(list_sort(list(DISTINCT u)), 1, 3) AS us FROM (SELECT language_code, unnest(source_urls) AS u FROM grammar) GROUP BY 1)
    SELECT rec_id, coalesce(len(cross_references), 0) + coalesce(len(list_filter(us, lambda u: NOT coalesce(list_contains(list_transform(cross_references, lambda x: x.source_url), u), false))), 0) AS n_refs FROM vocabulary LEFT JOIN n USING (language_code)""")
def citations_appended(s, d):
    """References with the first three grammar sources of the language appended where their address is not there yet."""
    u = table(s, d, "grammar").select("language_code", F.explode("source_urls").alias("u")).distinct()
    w = Window.partitionBy("language_code").orderBy("u")
    n = u.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("language_code").agg(F.array_sort(F.collect_list("u")).alias("urls"))
    v = table(s, d, "vocabulary").select("rec_id", "language_code", "cross_references").join(n, "language_code", "left")
    return v.select("rec_id", F.size(A.append_references(F.col("cross_references"), F.col("urls"))).cast("long").alias("n_refs"))


# aggregations


@query("""SELECT (SELECT count(*) FROM vocabulary) AS entries, (SELECT count(*) FROM grammar) AS grammar, (SELECT count(DISTINCT semantic_cluster) FROM vocabulary) AS clusters, floor((SELECT count(*) FROM vocabulary) / 20000.0 * 1000 + 0.5) / 10 AS coverage,
    count(*) AS sources, count(*) FILTER (WHERE t = 'dictionary') AS dictionary, count(*) FILTER (WHERE t = 'academic') AS academic, count(*) FILTER (WHERE t = 'video') AS video, count(*) FILTER (WHERE t = 'archive') AS archive, count(*) FILTER (WHERE t = 'wiki') AS wiki FROM (SELECT unnest(cross_references).source_type AS t FROM vocabulary)""")
def archive_stats(s, d):
    """The whole bundle: a source of an unknown type counts in the total and in no type."""
    return A.archive_stats(table(s, d, "vocabulary"), table(s, d, "grammar"))


@query("SELECT country, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE st = '{x}') AS {x}" for x in ("not_endangered", "vulnerable", "definitely_endangered", "severely_endangered", "critically_endangered", "extinct")) + ", round(avg(lv), 9) AS avg_level FROM (SELECT unnest(countries) AS country, endangerment_status AS st, endangerment_level AS lv FROM languages) GROUP BY country")
def country_status(s, d):
    x = table(s, d, "languages").select(F.explode("countries").alias("country"), "endangerment_status", "endangerment_level")
    return x.groupBy("country").agg(F.count("*").alias("total"), *(F.count_if(F.col("endangerment_status") == k).alias(k) for k, _ in C.ENDANGERMENT.values()), F.round(F.avg("endangerment_level"), 9).alias("avg_level"))


@query("SELECT k AS pos, status, coalesce(n, 0) AS n FROM (SELECT * FROM (VALUES (1, 'not_endangered'), (2, 'vulnerable'), (3, 'definitely_endangered'), (4, 'severely_endangered'), (5, 'critically_endangered'), (6, 'extinct')) t(k, status)) LEFT JOIN (SELECT endangerment_status AS status, count(*) AS n FROM languages GROUP BY 1) USING (status)")
def ingest_status(s, d):
    """Languages by status in the fixed order of the levels."""
    order = s.createDataFrame([(n, k) for k, n in C.ENDANGERMENT.values()], "pos int, status string")
    n = table(s, d, "languages").groupBy(F.col("endangerment_status").alias("status")).agg(F.count("*").alias("n"))
    return order.join(n, "status", "left").select("pos", "status", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT macroarea, count(*) AS n FROM languages GROUP BY 1")
def ingest_macroarea(s, d):
    return table(s, d, "languages").groupBy("macroarea").agg(F.count("*").alias("n"))


@query("SELECT language_family, count(*) AS n FROM languages WHERE language_family IS NOT NULL GROUP BY 1 ORDER BY n DESC, language_family LIMIT 10")
def top_families(s, d):
    return table(s, d, "languages").where("language_family is not null").groupBy("language_family").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language_family").limit(10)


# updates


@query("""WITH r AS (SELECT language_code AS iso_code, count(DISTINCT url) AS n, max(pipeline_run_at) AS at FROM source_outcomes GROUP BY 1)
    SELECT glottocode, coalesce(r.n, preservation_status.sources_discovered)::INT AS sources_discovered, coalesce(r.at, preservation_status.last_pipeline_run) AS last_run, preservation_status.audio_clips AS audio_clips FROM languages LEFT JOIN r USING (iso_code)""")
def partial_update(s, d):
    """Nested fields replaced by what a run found, the others as they stood."""
    r = table(s, d, "source_outcomes").groupBy(F.col("language_code").alias("iso_code")).agg(F.count_distinct("url").cast("int").alias("sources_discovered"), F.max("pipeline_run_at").alias("last_pipeline_run"))
    x = A.update_nested(table(s, d, "languages"), r, "iso_code", "preservation_status", ["sources_discovered", "last_pipeline_run"])
    p = F.col("preservation_status")
    return x.select("glottocode", p["sources_discovered"].alias("sources_discovered"), p["last_pipeline_run"].alias("last_run"), p["audio_clips"].alias("audio_clips"))


@query("""SELECT rec_id, CASE WHEN coalesce(audio_url, '') = '' AND len(list_filter(cross_references, lambda x: x.source_url = m.u)) > 0 THEN 'https://clips.example/a.mp3' ELSE audio_url END AS audio_url
    FROM vocabulary, (SELECT min(u) AS u FROM (SELECT unnest(cross_references).source_url AS u FROM vocabulary)) m""")
def fill_audio_by_source(s, d):
    """Entries that cite a given source get its clip if they have none."""
    v = table(s, d, "vocabulary").select("rec_id", "cross_references", "audio_url")
    u = v.select(F.explode("cross_references").alias("x")).agg(F.min("x.source_url").alias("u"))  # one row
    cites = F.coalesce(F.exists("cross_references", lambda x: x["source_url"] == F.col("u")), F.lit(False))
    return v.join(F.broadcast(u)).select("rec_id", F.when((F.coalesce("audio_url", F.lit("")) == "") & cites, "https://clips.example/a.mp3").otherwise(F.col("audio_url")).alias("audio_url"))


@query("SELECT url, min(rank) AS rank FROM (SELECT url, 1 AS rank FROM source_outcomes WHERE url IS NOT NULL UNION ALL SELECT url, 2 FROM crawl_results WHERE url IS NOT NULL) GROUP BY url")
def union_precedence(s, d):
    """Addresses of two lists, each with the first list that has it."""
    url = lambda t: table(s, d, t).select("url").where("url is not null")
    return A.union_first([url("source_outcomes"), url("crawl_results")], "url").select("url", "rank")


@query("""WITH g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at NULLS FIRST, title, confidence NULLS FIRST, description NULLS FIRST) AS seq FROM grammar WHERE id IS NOT NULL),
    f AS (SELECT id, arg_max(description, seq) FILTER (WHERE (description IS NOT NULL AND description <> '') OR seq = 1) AS d1, arg_max(rule, seq) FILTER (WHERE (rule IS NOT NULL AND rule <> '') OR seq = 1) AS r1, arg_max(differences_from_contact, seq) FILTER (WHERE differences_from_contact IS NOT NULL) AS c1, max(created_at) AS m1 FROM g GROUP BY id),
    e AS (SELECT id, count(DISTINCT coalesce(t, '')) AS n FROM (SELECT id, unnest(examples).target AS t FROM g) GROUP BY id), v AS (SELECT id, count(DISTINCT t) AS n FROM (SELECT id, unnest(related_vocabulary) AS t FROM g) GROUP BY id), u AS (SELECT id, count(DISTINCT t) AS n FROM (SELECT id, unnest(source_urls) AS t FROM g) GROUP BY id)
    SELECT f.id, coalesce(nullif(d1, ''), '') AS description, coalesce(nullif(r1, ''), '') AS rule, c1 AS differences, coalesce(e.n, 0) AS n_examples, coalesce(v.n, 0) AS n_vocabulary, coalesce(u.n, 0) AS n_urls FROM f LEFT JOIN e USING (id) LEFT JOIN v USING (id) LEFT JOIN u USING (id)""")
def merge_grammar(s, d):
    g = table(s, d, "grammar").where("id is not null")
    w = Window.partitionBy("id").orderBy(F.col("created_at").asc_nulls_first(), "title", F.col("confidence").asc_nulls_first(), F.col("description").asc_nulls_first())
    m = M.merge_grammar(g.withColumn("seq", F.row_number().over(w)), "id", "seq")
    keys = lambda c: F.size(F.array_distinct(F.transform(c, lambda x: F.coalesce(x["target"], F.lit("")))))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return m.select("id", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("rule", F.lit("")).alias("rule"), F.col("differences_from_contact").alias("differences"), F.coalesce(keys("examples"), F.lit(0)).cast("long").alias("n_examples"), n("related_vocabulary").alias("n_vocabulary"), n("source_urls").alias("n_urls"))


@query("SELECT DISTINCT title, 'gram-' || substr(sha256(title), 1, 16) AS gram_id FROM grammar WHERE title IS NOT NULL")
def grammar_ids(s, d):
    return table(s, d, "grammar").where("title is not null").select("title", F.concat(F.lit("gram-"), F.substring(F.sha2("title", 256), 1, 16)).alias("gram_id")).distinct()


@query("SELECT language_code, u AS url FROM (SELECT *, row_number() OVER (PARTITION BY language_code ORDER BY u) AS r FROM (SELECT DISTINCT language_code, unnest(source_urls) AS u FROM grammar)) WHERE r <= 3")
def first_urls(s, d):
    """The first three different addresses of each language."""
    u = table(s, d, "grammar").select("language_code", F.explode("source_urls").alias("url")).distinct()
    return u.withColumn("r", F.row_number().over(Window.partitionBy("language_code").orderBy("url"))).where("r <= 3").select("language_code", "url")


# graph


@query(GRAPH + "SELECT DISTINCT a AS rec_id, b AS neighbour FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)")
def adjacency(s, d):
    return G.adjacency(_edges(s, d)[1], "rec_id")


@query(GRAPH + ", k AS (SELECT rec_id FROM n WHERE semantic_cluster IN ('kinship', 'body')) SELECT a, b, type FROM e WHERE a IN (SELECT rec_id FROM k) AND b IN (SELECT rec_id FROM k)")
def induced_cluster(s, d):
    n, e = _edges(s, d)
    return G.induced(n, e, "rec_id", F.col("semantic_cluster").isin("kinship", "body"))[1].select("a", "b", "type")


@query("""SELECT rec_id, headword_native, headword_romanized, coalesce(nullif(semantic_cluster, ''), 'uncategorized') AS cluster, coalesce(len(cross_references), 0)::INT AS n_sources, nullif(substr(list_filter(definitions, lambda x: x.language = 'en')[1].text, 1, 80), '') AS definition, 0::BIGINT AS degree FROM vocabulary""")
def node_projection(s, d):
    none = s.createDataFrame([], "a long, b long")
    return G.project(table(s, d, "vocabulary"), none, "rec_id")


@query()
def neighbourhood_graph(s, d):
    """The neighbourhood of one entry filled by vectors, with the edges among its nodes."""
    n, e = _edges(s, d)
    return G.neighbourhood_graph(n, e, e.agg(F.min("a").alias("rec_id")), "rec_id", "embedding")[1].select("a", "b", "type")


# functions


@query("""SELECT rec_id, CASE WHEN contains(t, 'pronoun') OR contains(t, 'deixis') THEN 'pronoun' WHEN contains(t, 'verb') THEN 'verb' WHEN contains(t, 'noun') OR contains(t, 'kinship') THEN 'noun' WHEN contains(t, 'particle') THEN 'particle' WHEN ends_with(w, '-') OR ends_with(w, 'da') THEN 'verb' ELSE 'unknown' END AS pos,
    CASE WHEN contains(t, 'kinship') THEN 'kinship' WHEN regexp_matches(t, 'phonolog|consonant|vowel|prosody') THEN 'phonology' WHEN regexp_matches(t, 'grammar|noun|verb|pronoun|particle|deixis') THEN 'grammar' WHEN regexp_matches(t, 'vocabulary|sound symbolism|cultural') THEN 'vocabulary' WHEN contains(t, 'orthography') THEN 'orthography' END AS cluster
    FROM (SELECT rec_id, lower(concat_ws(' ', pos, semantic_cluster, grammar_notes)) AS t, lower(coalesce(headword_romanized, '')) AS w FROM vocabulary)""")
def inferred_labels(s, d):
    """Word class and cluster from the words around an entry."""
    context = F.lower(F.concat_ws(" ", "pos", "semantic_cluster", "grammar_notes"))
    word = F.lower(F.coalesce("headword_romanized", F.lit("")))
    return table(s, d, "vocabulary").select("rec_id", C.infer_pos(context, word).alias("pos"), C.infer_cluster(context).alias("cluster"))


@query("SELECT glottocode, coalesce(list_filter(list_transform(contact_languages, lambda x: CASE x WHEN 'Korean' THEN 'ko' WHEN 'Russian' THEN 'ru' WHEN 'French' THEN 'fr' END), lambda x: x IS NOT NULL)[1], CASE WHEN length(iso_code) = 2 THEN iso_code ELSE 'en' END) AS asr FROM languages")
def speech_language(s, d):
    """The language a recogniser is asked for."""
    return table(s, d, "languages").select("glottocode", media.speech_language(F.col("contact_languages"), F.col("iso_code")).alias("asr"))


@query("SELECT crawl_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0) ELSE printf('%.1f MB', b / 1048576.0) END AS size, CASE WHEN ms < 60000 THEN (ms // 1000) || 's' ELSE (ms // 60000) || 'm ' || ((ms % 60000) // 1000) || 's' END AS took FROM (SELECT crawl_id, metadata.content_length_bytes AS b, metadata.crawl_duration_ms AS ms FROM crawl_results)")
def formatted_sizes(s, d):
    m = F.col("metadata")
    return table(s, d, "crawl_results").select("crawl_id", media.byte_size(m["content_length_bytes"]).alias("size"), media.duration(m["crawl_duration_ms"]).alias("took"))


@query("SELECT crawl_id, crawled_at - to_milliseconds(coalesce(metadata.crawl_duration_ms, 0)) AS started_at FROM crawl_results WHERE crawled_at IS NOT NULL")
def run_start(s, d):
    """When a run started: its end less its duration."""
    at = F.timestamp_micros(F.unix_micros("crawled_at") - F.coalesce(F.col("metadata.crawl_duration_ms"), F.lit(0)) * 1000)
    return table(s, d, "crawl_results").where("crawled_at is not null").select("crawl_id", at.alias("started_at"))


@query("SELECT event_id, least(floor((event_id % 1000) / 30.0), 19)::INT AS chunk FROM events")
def chunk_index(s, d):
    """The thirty-second chunk of a time, of twenty."""
    return table(s, d, "events").select("event_id", media.chunk_of(F.col("event_id") % 1000, 20).cast("int").alias("chunk"))


@query("SELECT crawl_id, (3 + greatest(0, ceil((length(content) - 50000) / 50000.0)) + CASE WHEN metadata.type = 'video' THEN 7 ELSE 0 END + CASE WHEN metadata.type = 'academic' THEN 5 ELSE 0 END)::INT AS minutes FROM crawl_results WHERE content IS NOT NULL")
def time_limit(s, d):
    """Minutes a source may take, with the surcharges of videos and of scans (academic sources here)."""
    kind = F.col("metadata.type")
    return table(s, d, "crawl_results").where("content is not null").select("crawl_id", media.time_limit(F.length("content"), kind == "video", kind == "academic").alias("minutes"))


@query(r"""SELECT crawl_id, coalesce(nullif(trim(regexp_extract(md, '(?m)^#{1,3}[ \t]+(.+)$', 1)), ''), nullif(trim(substr(split_part(md, chr(10), 1), 1, 200)), ''), url) AS title FROM (SELECT crawl_id, url, '## ' || coalesce(metadata.title, '') || chr(10) || content AS md FROM crawl_results WHERE content IS NOT NULL) WHERE length(trim(md)) >= 200""")
def markdown_title(s, d):
    md = F.concat(F.lit("## "), F.coalesce("metadata.title", F.lit("")), F.lit("\n"), F.col("content"))
    x = table(s, d, "crawl_results").where("content is not null").select("crawl_id", "url", md.alias("md"))
    return A.markdown_titles(x, "md", "url", 200).select("crawl_id", "title")


@query("SELECT crawl_id FROM (SELECT crawl_id, row_number() OVER (PARTITION BY url, substr(content, 1, 200) ORDER BY crawl_id) AS r FROM crawl_results WHERE content IS NOT NULL AND url IS NOT NULL) WHERE r = 1")
def chunk_dedup(s, d):
    """Of the pieces of a page that begin alike the first (a repeated crawl begins alike)."""
    return A.first_of_alike(table(s, d, "crawl_results").where("content is not null and url is not null"), ["url"], "content", "crawl_id").select("crawl_id")


# search


@query(rf"""WITH t AS (SELECT glottocode, name, iso_code, language_family, coalesce(alternate_names, []) AS alt, coalesce(countries, []) AS countries FROM languages),
    w AS (SELECT glottocode, f, b, lower(w) AS w, full_name FROM (SELECT glottocode, 'name' AS f, 3 AS b, unnest(regexp_extract_all(lower(name), '{TOK}')) AS w, lower(name) AS full_name FROM t UNION ALL SELECT glottocode, 'exact', 4, lower(name), lower(name) FROM t
        UNION ALL SELECT glottocode, 'alt', 2, unnest(regexp_extract_all(lower(array_to_string(alt, ' ')), '{TOK}')), '' FROM t UNION ALL SELECT glottocode, 'iso', 3, lower(iso_code), '' FROM t UNION ALL SELECT glottocode, 'glotto', 3, lower(glottocode), '' FROM t
        UNION ALL SELECT glottocode, 'family', 1, unnest(regexp_extract_all(lower(language_family), '{TOK}')), '' FROM t UNION ALL SELECT glottocode, 'country', 1, lower(unnest(countries)), '' FROM t) WHERE w IS NOT NULL),
    fz AS (SELECT glottocode, max(b) AS s FROM w WHERE levenshtein(w, 'vatoluik') <= 2 GROUP BY 1), px AS (SELECT glottocode, max(b) AS s FROM w WHERE f IN ('name', 'alt', 'family') AND starts_with(w, 'vatoluik') GROUP BY 1)
    SELECT glottocode, (coalesce(fz.s, 0) + coalesce(px.s, 0))::INT AS score FROM languages LEFT JOIN fz USING (glottocode) LEFT JOIN px USING (glottocode) WHERE coalesce(fz.s, 0) + coalesce(px.s, 0) > 0""")
def language_fuzzy_search(s, d):
    """Fuzzy best field or prefix of the last word."""
    return A.language_search(table(s, d, "languages"), "vatoluik").select("glottocode", "score")


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM vocabulary WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 ORDER BY rec_id LIMIT 1),
    k AS (SELECT rec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 9) AS sim FROM vocabulary, q WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 ORDER BY sim DESC, rec_id LIMIT 50)
    SELECT rec_id FROM (SELECT rec_id, coalesce(len(cross_references), 0) AS refs, sim FROM k JOIN vocabulary USING (rec_id)) ORDER BY refs DESC, sim DESC, rec_id LIMIT 10""")
def rerank_window(s, d):
    """The fifty best by vector, reordered by a scorer (the number of references), the first ten kept."""
    v = table(s, d, "vocabulary").where(F.exists("embedding", lambda x: x != 0))
    q = v.orderBy("rec_id").limit(1).select("embedding").first()
    best = R.knn(v, "rec_id", "embedding", list(q[0]) if q else [0.0] * 64, 50).withColumnRenamed("similarity", "score")
    return R.rerank(best, "rec_id", F.coalesce(F.size("cross_references"), F.lit(0)), window=50, k=10).select("rec_id")


@query()
def search_pipeline(s, d):
    """Hybrid search, rerank of the window, and a page filled from the hits' clusters."""
    v = table(s, d, "vocabulary")
    q = v.where(F.exists("embedding", lambda x: x != 0)).orderBy("rec_id").select("embedding").first()
    return R.search(v, "rec_id", "fishing net", "embedding", list(q[0]) if q else [0.0] * 64, "semantic_cluster", k=12)


@query()
def extracted_entries(s, d):
    """Vocabulary rows from the extraction answers: entries with a headword and a word class, defaults filled in."""
    raw = table(s, d, "raw_entries").select("raw_id", "payload")
    nodes = nested.flatten_payloads(spread(raw), "raw_id", "payload")
    return A.extracted_entries(nodes, table(s, d, "raw_entries").select("raw_id", "url", "language_code"), "raw_id")


@query("SELECT glottocode, lower(regexp_replace(strip_accents(name), '[^a-zA-Z0-9]+', '-', 'g')) AS slug FROM languages WHERE regexp_matches(name, '^[ -~]*$')")
def sql_functions(s, d):
    """A registered SQL function used in SQL text."""
    A.register_functions(s)
    table(s, d, "languages").createOrReplaceTempView("verbarium_languages")
    return s.sql("SELECT glottocode, verbarium_slug(name) AS slug FROM verbarium_languages WHERE name RLIKE '^[ -~]*$'")


QUERIES = Q
