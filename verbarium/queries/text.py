"""Scalar functions, classifiers, cleaning and web-text queries with their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from verbarium.functions import classify as C
from verbarium.functions import text as X
from verbarium.operators import webtext as W
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


def _crawls(s, d):
    return table(s, d, "crawl_results")


def _case(value: str, rules, default) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN regexp_matches({value}, '{p}') THEN {lit(v)}" for p, v in rules) + f" ELSE {lit(default)} END"


@query(f"SELECT doc_id, {_case('lower(concat_ws(chr(32), url, source))', C.SOURCE_TYPES, 'archive')} AS kind FROM documents")
def source_type_classify(s, d):
    return table(s, d, "documents").select("doc_id", C.source_type(F.col("url"), F.col("source")).alias("kind"))


@query(f"SELECT doc_id, {_case('lower(text)', C.RELIABILITY, 0.6)}::DOUBLE AS score FROM documents WHERE text IS NOT NULL")
def reliability_score(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", C.reliability(F.col("text")).alias("score"))


@query(f"""SELECT crawl_id, CASE WHEN regexp_matches(lower(url), '{"|".join(C.CHEAP_SITES)}') THEN 'cheerio_first' WHEN regexp_matches(lower(url), '{"|".join(C.HARD_SITES)}') THEN 'brightdata_first' ELSE 'cheerio_first' END AS tier,
    {_case('lower(url)', C.ROUTES, 'generic')} AS route FROM crawl_results""")
def domain_tier(s, d):
    return _crawls(s, d).select("crawl_id", C.domain_tier(F.col("url")).alias("tier"), C.crawler_route(F.col("url")).alias("route"))


@query("SELECT crawl_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM crawl_results WHERE url IS NOT NULL")
def url_parts(s, d):
    u = F.col("url")
    return _crawls(s, d).where("url is not null").select("crawl_id", F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit("")).alias("host"), F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")).alias("path"))


_SCRIPT = {"ko": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}", "ru": r"\x{0400}-\x{04FF}"}


def _share(k: str, of: str) -> str:
    return f"length(regexp_replace({of}, '[^{_SCRIPT[k]}]', '', 'g'))"


_JEJU = f"(len(regexp_extract_all(text, '{C.JEJU}')) + len(regexp_extract_all(text, 'ᆞ')))"


@query(f"""WITH t AS (SELECT doc_id, text, {_JEJU} AS j, length(regexp_replace(text, '\\s', '', 'g')) AS n FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN n = 0 THEN 'en' WHEN j > 0 THEN 'jje' WHEN {_share('ko', 'text')} / n > 0.3 THEN 'ko' WHEN {_share('ru', 'text')} / n > 0.3 THEN 'ru' ELSE 'en' END AS script_lang,
    CASE WHEN n = 0 THEN 0 WHEN j > 0 THEN floor(least(0.95, 0.6 + j * 0.1) * 1000 + 0.5) / 1000 WHEN {_share('ko', 'text')} / n > 0.3 THEN floor(least(0.95, {_share('ko', 'text')} / n + 0.2) * 1000 + 0.5) / 1000
    WHEN {_share('ru', 'text')} / n > 0.3 THEN floor(least(0.95, {_share('ru', 'text')} / n + 0.2) * 1000 + 0.5) / 1000 ELSE floor(greatest(0.5, 1 - {_share('ko', 'text')} / n * 2) * 1000 + 0.5) / 1000 END::DOUBLE AS confidence FROM t""")
def lang_detect_script(s, d):
    lang, conf = C.script_language(F.col("counts"))
    x = table(s, d, "documents").where("text is not null").select("doc_id", C.script_counts(F.col("text")).alias("counts"))
    return x.select("doc_id", lang.alias("script_lang"), conf.cast("double").alias("confidence"))


@query(f"""SELECT doc_id, CASE WHEN lang IS NOT NULL AND lang <> '' THEN lang WHEN {_share('ko', 'substr(text, 1, 1000)')} > length(regexp_replace(substr(text, 1, 1000), '\\s', '', 'g')) * 0.15 THEN 'ko'
    WHEN {_share('ru', 'substr(text, 1, 1000)')} > length(regexp_replace(substr(text, 1, 1000), '\\s', '', 'g')) * 0.15 THEN 'ru' ELSE 'en' END AS lang_b FROM documents WHERE text IS NOT NULL""".replace("\\\\s", "\\s"))
def lang_detect_short(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", C.script_language_short(F.col("text"), F.col("lang")).alias("lang_b"))


@query("SELECT glottocode, CASE WHEN n <= 0 THEN 0 WHEN n <= 1 THEN 1 WHEN n <= 4 THEN 2 WHEN n <= 9 THEN 3 WHEN n <= 24 THEN 4 WHEN n <= 49 THEN 5 WHEN n <= 99 THEN 6 ELSE 7 END AS bucket FROM (SELECT glottocode, preservation_status.vocabulary_entries AS n FROM languages) WHERE n IS NOT NULL")
def choropleth_bucket(s, d):
    return table(s, d, "languages").selectExpr("glottocode", "preservation_status.vocabulary_entries as n").where("n is not null").select("glottocode", C.bucket(F.col("n")).alias("bucket"))


@query("SELECT glottocode, latitude, longitude, round(0.3 + (endangerment_level - 2) / 4.0 * 0.7, 9) AS intensity FROM languages WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def heat_intensity(s, d):
    return table(s, d, "languages").where("latitude is not null and longitude is not null").select("glottocode", "latitude", "longitude", F.round(C.heat(F.col("endangerment_level")), 9).alias("intensity"))


@query("SELECT crawl_id, length(content)::BIGINT AS n, length(content) >= 300 AS extract, length(content) >= 200 OR coalesce(metadata.type, '') = 'video' AS accept FROM crawl_results WHERE content IS NOT NULL")
def content_gate(s, d):
    n = F.length("content")
    return _crawls(s, d).where("content is not null").select("crawl_id", n.cast("long").alias("n"), (n >= 300).alias("extract"), ((n >= 200) | (F.coalesce("metadata.type", F.lit("")) == "video")).alias("accept"))


@query()
def clean_text(s, d):
    return _crawls(s, d).where("content is not null").select("crawl_id", X.clean_page(F.col("content")).alias("cleaned"))


@query()
def chunk_contents(s, d):
    """Whole contents in pieces of at most 1,000 characters (the limit is the operator's parameter)."""
    x = _crawls(s, d).where("content is not null").select("crawl_id", F.posexplode(X.chunks(F.col("content"), 1000)).alias("chunk", "piece"))
    return x.select("crawl_id", "chunk", F.length("piece").alias("n"), F.md5("piece").alias("md5"))


@query("SELECT crawl_id, CASE WHEN regexp_matches(lower(content), 'pagination|page\\s*[0-9]|next\\s*page|previous|»|›') THEN 'paginated' WHEN regexp_matches(lower(content), 'search|filter|query|find') THEN 'searchable' WHEN regexp_matches(lower(content), 'scroll|load\\s*more|infinite|show\\s*more') THEN 'scrollable' ELSE 'simple' END AS strategy FROM crawl_results".replace("\\\\s", "\\s"))
def page_strategy(s, d):
    return _crawls(s, d).select("crawl_id", C.page_strategy(F.col("content")).alias("strategy"))


@query(r"""WITH t AS (SELECT crawl_id, content, metadata.type AS kind, length(content) AS n, strlen(content) / 1024.0 AS kb, regexp_replace(content, '\s', '', 'g') AS bare FROM crawl_results WHERE content IS NOT NULL),
    r AS (SELECT *, CASE WHEN length(bare) = 0 THEN 0 ELSE length(regexp_replace(bare, '[^a-zA-Z0-9.,;:!?()''"-]', '', 'g')) / length(bare) END AS q FROM t)
    SELECT crawl_id, CASE WHEN n < 50 OR q < 0.4 THEN 'degraded' WHEN n >= 200 AND q > 0.8 THEN 'clean' WHEN kb < 500 AND n >= 100 AND q > 0.7 THEN 'clean' WHEN kind IN ('academic', 'wiki') AND n >= 150 AND q > 0.75 THEN 'clean' ELSE 'unknown' END AS quality FROM r""")
def scan_quality(s, d):
    return _crawls(s, d).where("content is not null").select("crawl_id", C.scan_quality(F.col("content"), F.octet_length("content"), F.col("metadata.type")).alias("quality"))


@query("""WITH w AS (SELECT rec_id, list_distinct(list_filter(string_split_regex(regexp_replace(lower(x.text), '[^a-z0-9가-힣\\s]', '', 'g'), '\\s+'), lambda z: z <> '')) AS ws FROM (SELECT rec_id, unnest(definitions) AS x FROM vocabulary) WHERE x.text IS NOT NULL),
    n AS (SELECT rec_id, count(*) AS n FROM w GROUP BY rec_id), c AS (SELECT rec_id, unnest(ws) AS word FROM w) SELECT c.rec_id, word FROM c JOIN n USING (rec_id) GROUP BY c.rec_id, word, n.n HAVING count(*) = n.n AND n.n > 1""".replace("\\\\s", "\\s"))
def word_set_common(s, d):
    """Words that all definitions of an entry share."""
    sets = F.transform(F.filter("definitions", lambda x: x["text"].isNotNull()), lambda x: X.words_of_definition(x["text"]))
    v = table(s, d, "vocabulary").select("rec_id", sets.alias("sets")).where("size(sets) > 1")
    both = F.aggregate(F.slice("sets", 2, F.size("sets")), F.get("sets", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return v.select("rec_id", F.explode(both).alias("word"))


@query("SELECT rec_id, concat_ws(' | ', headword_native, headword_romanized, pos, array_to_string(list_transform(definitions, lambda x: x.text), '; '), semantic_cluster) AS embedding_text FROM vocabulary")
def embedding_text(s, d):
    defs = F.array_join(F.transform("definitions", lambda x: x["text"]), "; ")
    return table(s, d, "vocabulary").select("rec_id", F.concat_ws(" | ", "headword_native", "headword_romanized", "pos", defs, "semantic_cluster").alias("embedding_text"))


@query("SELECT glottocode, CASE WHEN speaker_count IS NULL THEN 'Unknown' WHEN speaker_count = 0 THEN '—' ELSE '~' || speaker_count END AS speakers, least(1000 * pow(2, coalesce(endangerment_level, 1) - 1), 16000)::BIGINT AS backoff FROM languages")
def display_values(s, d):
    n = F.col("speaker_count")
    return table(s, d, "languages").select("glottocode", F.when(n.isNull(), "Unknown").when(n == 0, "—").otherwise(F.concat(F.lit("~"), n.cast("string"))).alias("speakers"), F.least(1000 * F.pow(F.lit(2.0), F.coalesce("endangerment_level", F.lit(1)) - 1), F.lit(16000)).cast("long").alias("backoff"))


@query("SELECT crawl_id, (metadata.crawl_duration_ms // 60000)::BIGINT || ':' || lpad(((metadata.crawl_duration_ms // 1000) % 60)::BIGINT::VARCHAR, 2, '0') AS mss, 180 + greatest(0, ceil((length(content) - 50000) / 50000.0))::BIGINT * 60 + CASE WHEN metadata.type = 'video' THEN 420 ELSE 0 END AS timeout_s FROM crawl_results WHERE metadata.crawl_duration_ms IS NOT NULL AND content IS NOT NULL")
def durations(s, d):
    ms = F.col("metadata.crawl_duration_ms")
    extra = F.greatest(F.lit(0), F.ceil((F.length("content") - 50000) / 50000.0)).cast("long")
    x = _crawls(s, d).where(ms.isNotNull() & F.col("content").isNotNull())
    return x.select("crawl_id", F.concat(F.floor(ms / 60000).cast("string"), F.lit(":"), F.lpad((F.floor(ms / 1000) % 60).cast("string"), 2, "0")).alias("mss"), (F.lit(180) + extra * 60 + F.when(F.col("metadata.type") == "video", 420).otherwise(0)).alias("timeout_s"))


@query("SELECT doc_id, list_transform(range(0, greatest(1, ((length(text) + 119) // 120)::BIGINT)), lambda i: substr(text, (i * 120 + 1)::BIGINT, 120)) AS parts FROM documents WHERE text IS NOT NULL AND text <> ''")
def stream_parts(s, d):
    """Texts cut to pieces of 120 characters for sending."""
    n = F.ceil(F.length("text") / 120).cast("int")
    return table(s, d, "documents").where("text is not null and text <> ''").select("doc_id", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("text"), i * 120 + 1, F.lit(120))).alias("parts"))


@query("SELECT glottocode, array_to_string(list_filter([name || ' dictionary', name || ' grammar', name || ' word list', CASE WHEN len(alternate_names) > 0 THEN alternate_names[1] || ' language' END, CASE WHEN len(countries) > 0 THEN name || ' ' || countries[1] END, language_family || ' language family'], lambda x: x IS NOT NULL), '; ') AS queries FROM languages")
def seed_queries(s, d):
    name = F.col("name")
    q = F.array_compact(F.array(F.concat(name, F.lit(" dictionary")), F.concat(name, F.lit(" grammar")), F.concat(name, F.lit(" word list")), F.concat(F.get("alternate_names", F.lit(0)), F.lit(" language")),
                                F.concat(name, F.lit(" "), F.get("countries", F.lit(0))), F.concat("language_family", F.lit(" language family"))))
    return table(s, d, "languages").select("glottocode", F.array_join(q, "; ").alias("queries"))


@query()
def page_links(s, d):
    """Links of an HTML page made from each crawl's URL and title (the table holds text, so the markup is built here)."""
    html = F.concat(F.lit('<p><a href="/about#x">About</a> <a class="n" href="'), "url", F.lit('?p=2"><b>Next</b></a> <a href="#top">top</a> <a href="mailto:a@b.c">m</a> <a href="/about#x">again</a></p>'))
    return W.links(_crawls(s, d).where("url is not null").select("crawl_id", "url", html.alias("html")), "crawl_id", "url", "html")


@query()
def page_text(s, d):
    html = F.concat(F.lit("<html><head><title>"), F.coalesce("metadata.title", F.lit("")), F.lit("</title><style>p{}</style></head><body><nav>menu</nav><article><h1>t</h1><p>"), F.regexp_replace(F.coalesce("content", F.lit("")), "[<>&]", " "), F.lit("</p></article><footer>f</footer></body></html>"))
    return W.html_text(_crawls(s, d).select("crawl_id", "url", html.alias("html")), "crawl_id", "url", "html")


@query(r"""WITH x AS (SELECT crawl_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no FROM crawl_results WHERE content IS NOT NULL)
    SELECT crawl_id, line_no::INT AS line_no, trim(regexp_extract(line, '^\s*(\S.*?)\s+[—–-]\s+(\S.*?)\s*$', 1), ' ') AS word, trim(regexp_extract(line, '^\s*(\S.*?)\s+[—–-]\s+(\S.*?)\s*$', 2), ' ') AS gloss FROM x WHERE length(line) BETWEEN 3 AND 500 AND regexp_matches(line, '^\s*\S.*?\s+[—–-]\s+\S.*?\s*$')""")
def dictionary_lines(s, d):
    """Word-gloss pairs on the lines of pages."""
    return W.gloss_lines(_crawls(s, d), "crawl_id", "content")


@query("SELECT raw_id, json_valid(payload) AS readable FROM raw_entries WHERE payload IS NOT NULL")
def json_readable(s, d):
    """Whether an answer parses as JSON (VARIANT)."""
    x = table(s, d, "raw_entries").where("payload is not null")
    return x.select("raw_id", F.try_parse_json("payload").isNotNull().alias("readable"))


QUERIES = Q
