"""ETL and export queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbarium.operators import etl
from verbarium.sources import sinks
from verbarium.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}
LANGS = ["en", "es", "fr", "id", "ko", "pt", "ru"]
CONTACT = {"XA": ["en", "fr"], "XB": ["es"], "XC": ["ru", "en"], "XD": ["id"]}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT rec_id, " + ", ".join(f"coalesce(array_to_string(list_transform(list_filter(definitions, lambda x: x.language = '{x}'), lambda x: x.text), '; '), '') AS definitions_{x}" for x in LANGS) + " FROM vocabulary")
def csv_pivot_export(s, d):
    """One column for each language the definitions have (found by one scan; the SQL names those of the test tables)."""
    v = table(s, d, "vocabulary").select("rec_id", "definitions")
    return sinks.export_columns(v, "rec_id", sinks.definition_languages(v))


@query("SELECT glottocode, latitude, longitude, coalesce(endangerment_level, 0) AS l, coalesce(speaker_count, 0) AS s FROM languages WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def geojson_rows(s, d):
    f = etl.geojson_features(table(s, d, "languages"))
    j = F.from_json("feature", "geometry struct<coordinates:array<double>>, properties struct<l:int,s:bigint>")
    x = f.select("glottocode", j.alias("j"))
    return x.select("glottocode", F.col("j.geometry.coordinates")[1].alias("latitude"), F.col("j.geometry.coordinates")[0].alias("longitude"), "j.properties.l", "j.properties.s")


@query("""WITH m AS (SELECT * FROM (VALUES ('XA', ['en', 'fr']), ('XB', ['es']), ('XC', ['ru', 'en']), ('XD', ['id'])) t(c, ls)), x AS (SELECT glottocode, unnest(countries) AS c, generate_subscripts(countries, 1) AS i FROM languages), y AS (SELECT glottocode, i, unnest(ls) AS l, generate_subscripts(ls, 1) AS k FROM x JOIN m USING (c))
    SELECT glottocode, string_agg(l, ',' ORDER BY i, k) AS contact FROM (SELECT *, row_number() OVER (PARTITION BY glottocode, l ORDER BY i, k) AS r FROM y) WHERE r = 1 GROUP BY glottocode""")
def contact_lookup(s, d):
    x = table(s, d, "languages").select("glottocode", F.array_join(etl.contact_languages(F.col("countries"), CONTACT), ",").alias("contact"))
    return x.where("contact <> ''")


@query("""WITH c AS (SELECT glottocode, iso_code, speaker_count AS s FROM languages WHERE speaker_count_confidence = 'medium'), g AS (SELECT glottocode, max(s) AS a FROM c GROUP BY 1), i AS (SELECT iso_code, max(s) AS b FROM c WHERE iso_code <> '' GROUP BY 1)
    SELECT l.glottocode, coalesce(a, b) AS speaker_count, CASE WHEN a IS NOT NULL THEN 'medium' ELSE 'low' END AS speaker_count_confidence FROM languages l LEFT JOIN g USING (glottocode) LEFT JOIN i ON i.iso_code = l.iso_code WHERE coalesce(a, b) IS NOT NULL""")
def speaker_priority_join(s, d):
    lang = table(s, d, "languages")
    return etl.speaker_counts(lang, lang.where("speaker_count_confidence = 'medium'").selectExpr("glottocode", "iso_code", "speaker_count as speakers"))


@query("SELECT n_nationkey, n_name, coalesce(r_name, 'Unknown') AS family FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def family_join(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"], "left").select("n_nationkey", "n_name", F.coalesce("r_name", F.lit("Unknown")).alias("family"))


@query("SELECT rec_id, substr(sha256('code=' || language_code || '&id=' || id), 1, 12) AS cache_key FROM vocabulary WHERE language_code IS NOT NULL AND id IS NOT NULL")
def cache_keys(s, d):
    v = table(s, d, "vocabulary").where("language_code is not null and id is not null")
    return v.select("rec_id", sinks.cache_key({"id": F.col("id"), "code": F.col("language_code")}).alias("cache_key"))


@query("SELECT glottocode, coalesce(len(list_distinct(list_filter(alternate_names, lambda x: x <> name))), 0)::INT AS n FROM languages")
def alt_names_agg(s, d):
    n = F.size(F.array_distinct(F.array_remove(F.coalesce("alternate_names", F.array().cast("array<string>")), F.col("name"))))
    return table(s, d, "languages").select("glottocode", n.alias("n"))


QUERIES = Q
