"""Scans, filters, joins, aggregations, windows and deduplication over the archive tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbarium.functions import classify as C
from verbarium.functions.text import round_half_up
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


def _v(s, d):
    return table(s, d, "vocabulary")


def _l(s, d):
    return table(s, d, "languages")


# scans and predicates


@query("SELECT rec_id, id, headword_native, created_at FROM vocabulary WHERE language_code = 'qaa' ORDER BY created_at DESC NULLS LAST, rec_id LIMIT 20 OFFSET 20")
def browse_recent(s: SparkSession, d: str) -> DataFrame:
    """Second page of a language's entries, newest first."""
    x = _v(s, d).where("language_code = 'qaa'").select("rec_id", "id", "headword_native", "created_at")
    return x.orderBy(F.col("created_at").desc_nulls_last(), "rec_id").offset(20).limit(20)


@query("SELECT glottocode, name, speaker_count FROM languages WHERE glottocode = (SELECT min(glottocode) FROM languages)")
def point_lookup(s, d):
    k = _l(s, d).agg(F.min("glottocode").alias("glottocode"))
    return _l(s, d).join(F.broadcast(k), "glottocode", "left_semi").select("glottocode", "name", "speaker_count")


@query("SELECT rec_id, id FROM vocabulary WHERE rec_id > 500 ORDER BY rec_id LIMIT 100")
def keyset_page(s, d):
    return _v(s, d).where("rec_id > 500").select("rec_id", "id").orderBy("rec_id").limit(100)


@query("SELECT count(*) AS n FROM vocabulary WHERE trim(coalesce(headword_native, '')) <> ''")
def count_filtered(s, d):
    return _v(s, d).where("trim(coalesce(headword_native, '')) <> ''").agg(F.count("*").alias("n"))


@query("SELECT rec_id, id, headword_native, pos, language_code FROM vocabulary WHERE trim(coalesce(headword_native, '')) <> ''")
def scroll_entries(s, d):
    """The full scan behind exports: blank headwords left out, no vector read."""
    return _v(s, d).where("trim(coalesce(headword_native, '')) <> ''").select("rec_id", "id", "headword_native", "pos", "language_code")


@query("SELECT glottocode, name FROM languages WHERE endangerment_status IN ('extinct', 'critically_endangered') AND macroarea IN ('Africa', 'Eurasia', 'Australia') AND speaker_count BETWEEN 100 AND 100000")
def filter_terms_range(s, d):
    return _l(s, d).where(F.col("endangerment_status").isin("extinct", "critically_endangered") & F.col("macroarea").isin("Africa", "Eurasia", "Australia") & F.col("speaker_count").between(100, 100000)).select("glottocode", "name")


@query("SELECT rec_id FROM vocabulary WHERE len(list_filter(cross_references, lambda x: x.source_type = 'archive' AND x.reliability_score > 0.8)) > 0")
def nested_exists(s, d):
    hit = F.exists("cross_references", lambda x: (x["source_type"] == "archive") & (x["reliability_score"] > 0.8))
    return _v(s, d).where(hit).select("rec_id")


@query("SELECT rec_id FROM vocabulary WHERE audio_url IS NOT NULL AND audio_url <> '' AND starts_with(audio_url, 'https://audio.') AND pronunciation_video_url IS NULL")
def exists_prefix(s, d):
    return _v(s, d).where("audio_url is not null and audio_url <> '' and startswith(audio_url, 'https://audio.') and pronunciation_video_url is null").select("rec_id")


@query("SELECT rec_id FROM vocabulary WHERE list_contains(related_terms, headword_native) OR list_has_any(related_terms, ['a', 'b'])")
def array_terms(s, d):
    return _v(s, d).where("array_contains(related_terms, headword_native) or arrays_overlap(related_terms, array('a', 'b'))").select("rec_id")


def geo_box(df: DataFrame, north: float, south: float, east: float, west: float) -> DataFrame:
    """Rows inside the box, borders included; a box whose west lies east of its east crosses the antimeridian."""
    lon = F.col("longitude")
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return df.where(F.col("latitude").between(south, north) & across)


@query("SELECT glottocode, latitude, longitude FROM languages WHERE latitude BETWEEN -30 AND 40 AND longitude BETWEEN -20 AND 120")
def geo_bbox(s, d):
    return geo_box(_l(s, d), 40, -30, 120, -20).select("glottocode", "latitude", "longitude")


@query("SELECT glottocode, latitude, longitude FROM languages WHERE latitude BETWEEN -60 AND 60 AND (longitude >= 100 OR longitude <= -100)")
def geo_antimeridian(s, d):
    return geo_box(_l(s, d), 60, -60, -100, 100).select("glottocode", "latitude", "longitude")


@query("SELECT id, action, status FROM agent_events WHERE contains(lower(concat_ws(' ', agent, replace(action, '_', ' '), data.message)), 'crawl') GROUP BY ALL")
def event_search(s, d):
    text = F.lower(F.concat_ws(" ", "agent", F.replace(F.col("action"), F.lit("_"), F.lit(" ")), "data.message"))
    return table(s, d, "agent_events").where(text.contains("crawl")).select("id", "action", "status").distinct()


@query("SELECT rec_id, len(cross_references) AS n FROM vocabulary WHERE len(cross_references) >= 2 AND audio_url IS NOT NULL AND pos = 'noun'")
def facet_filters(s, d):
    return _v(s, d).where("size(cross_references) >= 2 and audio_url is not null and pos = 'noun'").select("rec_id", F.size("cross_references").cast("long").alias("n"))


@query("SELECT glottocode FROM languages WHERE list_has_any(regexp_extract_all(lower(language_family), '[\\p{L}\\p{N}]+'), ['vatoluic', 'malunoic'])".replace("\\\\", "\\"))
def family_match(s, d):
    from verbarium.functions.text import tokens

    return _l(s, d).where(F.arrays_overlap(tokens(F.col("language_family")), F.array(F.lit("vatoluic"), F.lit("malunoic")))).select("glottocode")


@query("SELECT DISTINCT id FROM vocabulary WHERE coalesce(language_confidence, '') <> 'low' AND len(list_filter(definitions, lambda x: trim(coalesce(x.text, '')) <> '')) > 0")
def verified_entries(s, d):
    return _v(s, d).where(F.coalesce("language_confidence", F.lit("")) != "low").where(F.exists("definitions", lambda x: F.trim(F.coalesce(x["text"], F.lit(""))) != "")).select("id").distinct()


@query("SELECT rec_id, len(list_filter(cross_references, lambda x: x.notes IS NOT NULL AND x.notes <> '')) AS n FROM vocabulary WHERE len(list_filter(cross_references, lambda x: x.notes IS NOT NULL AND x.notes <> '')) > 0")
def provenance_notes(s, d):
    n = F.size(F.filter("cross_references", lambda x: x["notes"].isNotNull() & (x["notes"] != ""))).cast("long")
    return _v(s, d).select("rec_id", n.alias("n")).where("n > 0")


# joins


@query("SELECT DISTINCT id FROM (SELECT id, unnest(source_urls) AS url FROM grammar) WHERE url IN (SELECT url FROM source_outcomes WHERE lower(status) = 'complete')")
def semi_join_source(s, d):
    """Grammar patterns that cite a source with a complete outcome."""
    x = table(s, d, "grammar").select("id", F.explode("source_urls").alias("url"))
    done = table(s, d, "source_outcomes").where("lower(status) = 'complete'").select("url").distinct()
    return x.join(done, "url", "left_semi").select("id").distinct()


@query("SELECT DISTINCT url FROM crawl_results WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM source_outcomes WHERE url IS NOT NULL AND entry_count > 0)")
def anti_join_processed(s, d):
    done = table(s, d, "source_outcomes").where("url is not null and entry_count > 0").select("url").distinct()
    return table(s, d, "crawl_results").select("url").where("url is not null").distinct().join(done, "url", "left_anti")


@query("SELECT rec_id, coalesce(nullif(v.glottocode, ''), l.g) AS glottocode FROM vocabulary v LEFT JOIN (SELECT iso_code, min(glottocode) AS g FROM languages WHERE iso_code <> '' GROUP BY iso_code) l ON v.language_code = l.iso_code")
def metadata_autofill(s, d):
    """A given value stays, else the reference table's."""
    ref = _l(s, d).where("iso_code <> ''").groupBy("iso_code").agg(F.min("glottocode").alias("g"))
    x = _v(s, d).select("rec_id", "glottocode", F.col("language_code").alias("iso_code")).join(ref, "iso_code", "left")
    return x.select("rec_id", F.coalesce(F.nullif(F.col("glottocode"), F.lit("")), F.col("g")).alias("glottocode"))


@query("""WITH e AS (SELECT rec_id, headword_native AS h, unnest(related_terms) AS t FROM vocabulary), h AS (SELECT headword_native, language_code, max(rec_id) AS target FROM vocabulary WHERE headword_native IS NOT NULL GROUP BY ALL)
    SELECT e.rec_id AS source, h.target, v.language_code FROM e JOIN vocabulary v USING (rec_id) JOIN h ON h.headword_native = e.t AND h.language_code = v.language_code WHERE h.target <> e.rec_id GROUP BY ALL""")
def term_headword_join(s, d):
    """Related terms resolved to entries of the language; of equal headwords the last row wins."""
    v = _v(s, d).select("rec_id", "headword_native", "language_code", "related_terms")
    h = v.where("headword_native is not null").groupBy("headword_native", "language_code").agg(F.max("rec_id").alias("target"))
    e = v.select(F.col("rec_id").alias("source"), "language_code", F.explode("related_terms").alias("headword_native"))
    return e.join(h, ["headword_native", "language_code"]).where("target <> source").select("source", "target", "language_code").distinct()


@query("""WITH c AS (SELECT lower(trim(headword_romanized, ' ')) AS w, min(audio_url) AS url FROM vocabulary WHERE audio_url <> '' AND headword_romanized IS NOT NULL GROUP BY 1), v AS (SELECT rec_id, lower(trim(headword_native, ' ')) AS n, lower(trim(headword_romanized, ' ')) AS r FROM vocabulary WHERE audio_url IS NULL OR audio_url = '')
    SELECT rec_id, coalesce(a.url, b.url) AS url, CASE WHEN a.url IS NOT NULL THEN 'native' ELSE 'romanized' END AS how FROM v LEFT JOIN c a ON a.w = v.n LEFT JOIN c b ON b.w = v.r WHERE coalesce(a.url, b.url) IS NOT NULL""")
def clip_cascade_match(s, d):
    """Clips for entries without audio: by native headword, else by romanised one (equi joins only)."""
    v = _v(s, d).select("rec_id", F.lower(F.trim("headword_native")).alias("n"), F.lower(F.trim("headword_romanized")).alias("r"), "audio_url")
    c = v.where("audio_url <> '' and r is not null").groupBy(F.col("r").alias("w")).agg(F.min("audio_url").alias("url"))
    x = v.where("audio_url is null or audio_url = ''").select("rec_id", "n", "r")
    x = x.join(c.select(F.col("w").alias("n"), F.col("url").alias("u1")), "n", "left").join(c.select(F.col("w").alias("r"), F.col("url").alias("u2")), "r", "left")
    return x.where("coalesce(u1, u2) is not null").select("rec_id", F.coalesce("u1", "u2").alias("url"), F.when(F.col("u1").isNotNull(), "native").otherwise("romanized").alias("how"))


@query("""WITH g AS (SELECT id, title, related_vocabulary, language_code FROM grammar), w AS (SELECT language_code, list(DISTINCT headword_native) AS ws FROM vocabulary WHERE headword_native IS NOT NULL GROUP BY language_code)
    SELECT DISTINCT g.id, g.title FROM g JOIN w USING (language_code) WHERE list_has_any(g.related_vocabulary, w.ws)""")
def term_overlap_lesson(s, d):
    """Grammar patterns that share a word with the archive of their language (exploded equi join, no array per language)."""
    g = table(s, d, "grammar").select("id", "title", "language_code", F.explode("related_vocabulary").alias("headword_native"))
    return g.join(_v(s, d).select("language_code", "headword_native").distinct(), ["language_code", "headword_native"], "left_semi").select("id", "title").distinct()


# aggregations


@query("""SELECT count(*) AS total, count(DISTINCT semantic_cluster) AS clusters, count(*) FILTER (WHERE audio_url IS NOT NULL AND audio_url <> '') AS with_audio, floor(count(*) / 20000.0 * 1000 + 0.5) / 10 AS coverage,
    (SELECT count(*) FROM (SELECT unnest(cross_references) FROM vocabulary)) AS total_sources, (SELECT count(DISTINCT x.source_url) FROM (SELECT unnest(cross_references) AS x FROM vocabulary)) AS unique_sources FROM vocabulary""")
def stats_bundle(s, d):
    v = _v(s, d).select("semantic_cluster", "audio_url", "cross_references")
    one = v.agg(
        F.count("*").alias("total"), F.count_distinct("semantic_cluster").alias("clusters"),
        F.count_if((F.col("audio_url") != "") & F.col("audio_url").isNotNull()).alias("with_audio"), F.sum(F.coalesce(F.size("cross_references"), F.lit(0))).alias("total_sources"),
    )
    urls = v.select(F.explode("cross_references").alias("x")).agg(F.count_distinct("x.source_url").alias("unique_sources"))
    return one.join(F.broadcast(urls)).select("total", "clusters", "with_audio", round_half_up(F.col("total") / 20000.0 * 100, 1).alias("coverage"), "total_sources", "unique_sources")  # one row each


@query("SELECT x.source_type AS source_type, count(*) AS n FROM (SELECT unnest(cross_references) AS x FROM vocabulary) WHERE x.source_type IS NOT NULL GROUP BY 1")
def stats_by_source_type(s, d):
    return _v(s, d).select(F.explode("cross_references").alias("x")).where("x.source_type is not null").groupBy(F.col("x.source_type").alias("source_type")).agg(F.count("*").alias("n"))


@query("SELECT category, count(*) AS n FROM grammar WHERE category IS NOT NULL GROUP BY category ORDER BY n DESC, category LIMIT 20")
def category_histogram(s, d):
    return table(s, d, "grammar").where("category is not null").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(20)


@query("SELECT count(*) AS total, count(*) FILTER (WHERE endangerment_status = 'critically_endangered') AS critical, count(*) FILTER (WHERE endangerment_status = 'extinct') AS extinct, count(*) FILTER (WHERE preservation_status.vocabulary_entries > 0) AS preserved FROM languages")
def browser_stats(s, d):
    st = F.col("endangerment_status")
    return _l(s, d).agg(F.count("*").alias("total"), F.count_if(st == "critically_endangered").alias("critical"), F.count_if(st == "extinct").alias("extinct"), F.count_if(F.col("preservation_status.vocabulary_entries") > 0).alias("preserved"))


@query("SELECT country, count(*) AS total, round(avg(endangerment_level), 9) AS avg_level, count(*) FILTER (WHERE endangerment_status = 'extinct') AS extinct, count(*) FILTER (WHERE endangerment_status = 'vulnerable') AS vulnerable FROM (SELECT unnest(countries) AS country, * FROM languages) GROUP BY country")
def country_rollup(s, d):
    x = _l(s, d).select(F.explode("countries").alias("country"), "endangerment_level", "endangerment_status")
    st = F.col("endangerment_status")
    return x.groupBy("country").agg(F.count("*").alias("total"), F.round(F.avg("endangerment_level"), 9).alias("avg_level"), F.count_if(st == "extinct").alias("extinct"), F.count_if(st == "vulnerable").alias("vulnerable"))


@query("""WITH x AS (SELECT x.source_url AS url, x.source_title AS title, x.source_type AS kind FROM (SELECT unnest(cross_references) AS x FROM vocabulary) WHERE x.source_url IS NOT NULL),
    t AS (SELECT url, title, row_number() OVER (PARTITION BY url ORDER BY count(*) DESC, title) AS r FROM x WHERE title IS NOT NULL GROUP BY url, title), k AS (SELECT url, kind, row_number() OVER (PARTITION BY url ORDER BY count(*) DESC, kind) AS r FROM x WHERE kind IS NOT NULL GROUP BY url, kind),
    n AS (SELECT url, count(*) AS n FROM x GROUP BY url ORDER BY n DESC, url LIMIT 500)
    SELECT n.url, n.n, t.title, k.kind FROM n LEFT JOIN t ON t.url = n.url AND t.r = 1 LEFT JOIN k ON k.url = n.url AND k.r = 1""")
def source_top_mode(s, d):
    """The 500 most cited sources with their most frequent title and type."""
    x = _v(s, d).select(F.explode("cross_references").alias("x")).where("x.source_url is not null").selectExpr("x.source_url as url", "x.source_title as title", "x.source_type as kind")
    top = x.groupBy("url").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "url").limit(500)
    x = x.join(F.broadcast(top.select("url")), "url", "left_semi")  # 500 rows

    def mode(c: str) -> DataFrame:
        g = x.where(F.col(c).isNotNull()).groupBy("url", c).agg(F.count("*").alias("k"))
        return g.groupBy("url").agg(F.min_by(c, F.struct(-F.col("k"), c)).alias(c))

    return top.join(mode("title"), "url", "left").join(mode("kind"), "url", "left").select("url", "n", "title", "kind")


@query("SELECT 'cluster' AS facet, semantic_cluster AS value, count(*) AS n FROM vocabulary WHERE semantic_cluster IS NOT NULL GROUP BY 2 UNION ALL SELECT 'pos', pos, count(*) FROM vocabulary WHERE pos IS NOT NULL GROUP BY 2")
def facet_counts(s, d):
    pairs = F.array(F.struct(F.lit("cluster").alias("facet"), F.col("semantic_cluster").alias("value")), F.struct(F.lit("pos").alias("facet"), F.col("pos").alias("value")))
    return _v(s, d).select(F.inline(pairs)).where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


@query("SELECT c.category, coalesce(n, 0) AS n FROM (SELECT unnest(['verb_conjugation', 'negation', 'sentence_structure', 'phonological_rule', 'particle_usage', 'honorific_system', 'question_formation', 'morphology', 'other']) AS category) c LEFT JOIN (SELECT category, count(*) AS n FROM grammar GROUP BY category) g USING (category)")
def fixed_category_facet(s, d):
    names = ["verb_conjugation", "negation", "sentence_structure", "phonological_rule", "particle_usage", "honorific_system", "question_formation", "morphology", "other"]
    g = table(s, d, "grammar").groupBy("category").agg(F.count("*").alias("n"))
    return s.createDataFrame([(x,) for x in names], "category string").join(F.broadcast(g.where(F.col("category").isin(names))), "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))  # nine rows


@query("SELECT x.source_url AS url, count(*) AS n FROM (SELECT unnest(cross_references) AS x FROM vocabulary) WHERE x.source_url IS NOT NULL GROUP BY 1 ORDER BY n DESC, url LIMIT 10000")
def processed_urls(s, d):
    return _v(s, d).select(F.explode("cross_references").alias("x")).where("x.source_url is not null").groupBy(F.col("x.source_url").alias("url")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "url").limit(10000)


@query("SELECT metadata.crawl_method AS method, count(*) AS n, sum(metadata.content_length_bytes)::BIGINT AS bytes, coalesce(floor(avg(metadata.crawl_duration_ms) + 0.5), 0)::BIGINT AS mean_ms FROM crawl_results GROUP BY 1")
def crawl_attribution(s, d):
    m = F.col("metadata.crawl_duration_ms")
    return table(s, d, "crawl_results").groupBy(F.col("metadata.crawl_method").alias("method")).agg(F.count("*").alias("n"), F.sum("metadata.content_length_bytes").alias("bytes"), F.coalesce(F.floor(F.avg(m) + 0.5), F.lit(0)).cast("long").alias("mean_ms"))


@query("SELECT lower(status) AS status, count(*) AS n, sum(entry_count)::BIGINT AS entries, sum(grammar_count)::BIGINT AS grammar, sum(audio_count)::BIGINT AS audio FROM source_outcomes GROUP BY 1")
def run_totals(s, d):
    return table(s, d, "source_outcomes").groupBy(F.lower("status").alias("status")).agg(F.count("*").alias("n"), F.sum("entry_count").alias("entries"), F.sum("grammar_count").alias("grammar"), F.sum("audio_count").alias("audio"))


@query("SELECT macroarea, endangerment_status, count(*) AS n, grouping(macroarea)::INT AS g1, grouping(endangerment_status)::INT AS g2 FROM languages GROUP BY ROLLUP (macroarea, endangerment_status)")
def rollup_summary(s, d):
    return _l(s, d).rollup("macroarea", "endangerment_status").agg(F.count("*").alias("n"), F.grouping("macroarea").cast("int").alias("g1"), F.grouping("endangerment_status").cast("int").alias("g2"))


@query("SELECT iso_code, max(speaker_count) AS speakers FROM languages WHERE iso_code <> '' GROUP BY iso_code")
def max_speakers(s, d):
    return _l(s, d).where("iso_code <> ''").groupBy("iso_code").agg(F.max("speaker_count").alias("speakers"))


@query("SELECT language_code, count(DISTINCT semantic_cluster) AS clusters FROM vocabulary GROUP BY language_code")
def clusters_touched(s, d):
    return _v(s, d).groupBy("language_code").agg(F.count_distinct("semantic_cluster").alias("clusters"))


@query("SELECT DISTINCT x.language AS language FROM (SELECT unnest(definitions) AS x FROM vocabulary) WHERE x.language IS NOT NULL")
def definition_languages(s, d):
    return _v(s, d).select(F.explode("definitions").alias("x")).where("x.language is not null").select(F.col("x.language").alias("language")).distinct()


# ranking and deduplication


@query("SELECT glottocode, speaker_count, row_number() OVER (ORDER BY speaker_count DESC NULLS LAST, glottocode) AS pos FROM languages ORDER BY speaker_count DESC NULLS LAST, glottocode LIMIT 30")
def sort_speakers(s, d):
    x = _l(s, d).select("glottocode", "speaker_count").orderBy(F.col("speaker_count").desc_nulls_last(), "glottocode").limit(30)
    return x.withColumn("pos", F.row_number().over(Window.orderBy(F.col("speaker_count").desc_nulls_last(), "glottocode")))  # thirty rows


@query("SELECT id, url, entry_count, grammar_count FROM (SELECT DISTINCT id, url, entry_count, grammar_count FROM source_outcomes) ORDER BY entry_count DESC NULLS LAST, grammar_count DESC NULLS LAST, id, url LIMIT 500")
def sources_by_yield(s, d):
    x = table(s, d, "source_outcomes").select("id", "url", "entry_count", "grammar_count").distinct()
    return x.orderBy(F.col("entry_count").desc_nulls_last(), F.col("grammar_count").desc_nulls_last(), "id", "url").limit(500)


@query("SELECT rec_id, (CASE WHEN semantic_cluster IN ('maritime', 'rituals', 'kinship', 'agriculture', 'food', 'nature', 'weather', 'animals', 'plants', 'geography') THEN 10 ELSE 0 END + coalesce(len(definitions), 0))::INT AS score FROM vocabulary ORDER BY score DESC, rec_id LIMIT 20")
def enrichment_priority(s, d):
    rich = ["maritime", "rituals", "kinship", "agriculture", "food", "nature", "weather", "animals", "plants", "geography"]
    score = F.when(F.col("semantic_cluster").isin(rich), 10).otherwise(0) + F.coalesce(F.size("definitions"), F.lit(0))
    return _v(s, d).select("rec_id", score.alias("score")).orderBy(F.desc("score"), "rec_id").limit(20)


@query("SELECT rec_id, (audio_url IS NOT NULL AND audio_url <> '') AS has_audio, coalesce(len(cross_references), 0)::INT AS refs FROM vocabulary ORDER BY has_audio DESC, refs DESC, rec_id LIMIT 5")
def pronunciation_priority(s, d):
    x = _v(s, d).select("rec_id", F.coalesce(F.col("audio_url") != "", F.lit(False)).alias("has_audio"), F.coalesce(F.size("cross_references"), F.lit(0)).alias("refs"))
    return x.orderBy(F.desc("has_audio"), F.desc("refs"), "rec_id").limit(5)


@query("SELECT language_code, rec_id FROM (SELECT *, row_number() OVER (PARTITION BY language_code ORDER BY created_at DESC NULLS LAST, rec_id) AS r FROM vocabulary) WHERE r <= 3")
def first_per_group(s, d):
    """The three newest of each language: rows beyond the rank are cut before the shuffle (window group limit)."""
    w = Window.partitionBy("language_code").orderBy(F.col("created_at").desc_nulls_last(), "rec_id")
    return _v(s, d).select("language_code", "rec_id", "created_at").withColumn("r", F.row_number().over(w)).where("r <= 3").select("language_code", "rec_id")


@query("SELECT language_code, headword_native, min(rec_id) AS rec_id FROM vocabulary WHERE trim(coalesce(headword_native, '')) <> '' GROUP BY 1, 2")
def dedup_first(s, d):
    """First row of each headword (an aggregation, as the first is the smallest arrival number)."""
    return _v(s, d).where("trim(coalesce(headword_native, '')) <> ''").groupBy("language_code", "headword_native").agg(F.min("rec_id").alias("rec_id"))


@query("SELECT sha256(text) AS hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def content_hash_dedup(s, d):
    return table(s, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1")


@query("SELECT rec_id, 'voc-' || substr(sha256(concat_ws('::', language_code, headword_native, pos)), 1, 12) AS entry_id, 'so-' || substr(sha256(concat_ws('::', language_code, audio_url)), 1, 16) AS source_id FROM vocabulary")
def hash_id(s, d):
    h = lambda n, *c: F.substring(F.sha2(F.concat_ws("::", *c), 256), 1, n)
    return _v(s, d).select("rec_id", F.concat(F.lit("voc-"), h(12, "language_code", "headword_native", "pos")).alias("entry_id"), F.concat(F.lit("so-"), h(16, "language_code", "audio_url")).alias("source_id"))


@query("""SELECT id, url, status, pipeline_run_at FROM (SELECT DISTINCT id, url, status, pipeline_run_at, row_number() OVER (PARTITION BY id ORDER BY pipeline_run_at DESC NULLS LAST, url, status) AS r FROM source_outcomes) WHERE r = 1""")
def last_outcome(s, d):
    """Idempotent replace by id: of the rows of one id the latest run stays."""
    w = Window.partitionBy("id").orderBy(F.col("pipeline_run_at").desc_nulls_last(), F.col("url").asc_nulls_last(), F.col("status").asc_nulls_last())
    return table(s, d, "source_outcomes").select("id", "url", "status", "pipeline_run_at").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


@query("SELECT rec_id, CASE WHEN coalesce(audio_url, '') = '' AND len(list_filter(cross_references, lambda x: x.source_type = 'video')) > 0 THEN 'filled' ELSE audio_url END AS audio_url FROM vocabulary")
def fill_if_empty(s, d):
    empty = F.coalesce("audio_url", F.lit("")) == ""
    cites = F.exists("cross_references", lambda x: x["source_type"] == "video")
    return _v(s, d).select("rec_id", F.when(empty & F.coalesce(cites, F.lit(False)), "filled").otherwise(F.col("audio_url")).alias("audio_url"))


@query("SELECT source_url, url IS NOT NULL AS crawled FROM (SELECT DISTINCT unnest(source_urls) AS source_url FROM grammar) g LEFT JOIN (SELECT DISTINCT url FROM crawl_results) c ON c.url = g.source_url")
def citation_check(s, d):
    g = table(s, d, "grammar").select(F.explode("source_urls").alias("source_url")).distinct()
    c = table(s, d, "crawl_results").select(F.col("url").alias("source_url")).where("url is not null").distinct().withColumn("hit", F.lit(True))
    return g.join(c, "source_url", "left").select("source_url", F.coalesce("hit", F.lit(False)).alias("crawled"))


@query("(SELECT iso_code AS code FROM languages WHERE iso_code <> '' INTERSECT SELECT language_code FROM vocabulary) EXCEPT SELECT language_code FROM grammar")
def set_operations(s, d):
    a = _l(s, d).where("iso_code <> ''").select(F.col("iso_code").alias("code"))
    return a.intersect(_v(s, d).select("language_code")).exceptAll(table(s, d, "grammar").select("language_code").distinct())


@query("""WITH e AS (SELECT e.user_id, e.event_id, e.ts, o.o_orderkey, row_number() OVER (PARTITION BY e.event_id ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS r FROM events e JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts)
    SELECT event_id, o_orderkey FROM e WHERE r = 1""")
def asof_join(s, d):
    """Latest order of the user before each event: union of both sides on one key, last order carried along a window; one
    shuffle by key and no pairs (an extension, the reference has no such join)."""
    e = table(s, d, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), F.lit(1).alias("side"), "event_id", F.lit(None).cast("long").alias("o_orderkey"))
    o = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("event_id"), "o_orderkey")
    w = Window.partitionBy("k").orderBy("t", "side", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    x = e.unionByName(o).withColumn("o_orderkey", F.last("o_orderkey", ignorenulls=True).over(w))
    return x.where("event_id is not null and o_orderkey is not null").select("event_id", "o_orderkey")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(s, d):
    return table(s, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1 GROUP BY n_name")
def revenue_by_nation(s, d):
    n = table(s, d, "nation").join(table(s, d, "region").where("r_regionkey = 1"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    o = table(s, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    x = table(s, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT rec_id, " + "CASE language_confidence WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 0 END AS rank FROM vocabulary")
def confidence_rank(s, d):
    return _v(s, d).select("rec_id", C.confidence_rank(F.col("language_confidence")).alias("rank"))


QUERIES = Q
