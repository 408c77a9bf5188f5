"""Reference-data ETL: the language table from its three raw files, contact languages, speaker counts, map features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbarium.functions.classify import ENDANGERMENT

COLUMNS = ("ID", "Name", "Macroarea", "Latitude", "Longitude", "Glottocode", "ISO639P3code", "Level", "Countries", "Family_ID")


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with a header, all text, lines of odd width kept; missing columns fail at once."""
    df = spark.read.csv(path, header=True, multiLine=True, mode="PERMISSIVE", escape='"')
    if lost := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {lost}")
    return df


def split_list(c: Column) -> Column:
    """The parts of a semicolon list, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def contact_languages(countries: Column, mapping: dict[str, list[str]]) -> Column:
    """The contact languages of the countries in order, each once. ``mapping`` is a parameter of bounded size."""
    pairs = [x for k, v in sorted(mapping.items()) for x in (F.lit(k), F.array(*(F.lit(y) for y in v)))]
    m = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<string>>")
    return F.array_distinct(F.flatten(F.filter(F.transform(countries, lambda c: m[c]), lambda x: x.isNotNull())))


def language_table(languages: DataFrame, values: DataFrame, names: DataFrame, mapping: dict[str, list[str]] | None = None, zero_coordinates: bool = False) -> DataFrame:
    """Languages of level ``language`` whose endangerment is known and above the lowest: status and level (the last value of a
    language wins), family name (none: Isolate, unknown id: Unknown), alternate names in order without the main one,
    countries, contact languages, coordinates (null where missing, 0 with ``zero_coordinates``)."""
    codes = F.create_map(*(y for k, (st, lv) in ENDANGERMENT.items() for y in (F.lit(k), F.struct(F.lit(st).alias("status"), F.lit(lv).alias("level")))))
    v = values.where("Parameter_ID = 'aes'").select("Language_ID", codes[F.col("Code_ID")].alias("e"), F.monotonically_increasing_id().alias("at")).where("e is not null")
    e = v.groupBy(F.col("Language_ID").alias("ID")).agg(F.max_by("e", "at").alias("e"))
    family = languages.select(F.col("ID").alias("Family_ID"), F.col("Name").alias("family"))
    alt = names.select("Language_ID", F.trim("Name").alias("n"), F.monotonically_increasing_id().alias("at")).where("n <> ''")
    alt = alt.groupBy(F.col("Language_ID").alias("ID")).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"])).alias("alt"))
    x = languages.where("Level = 'language'").join(e, "ID").where("e.level > 1").join(family, "Family_ID", "left").join(alt, "ID", "left")
    none = F.array().cast("array<string>")
    countries = split_list(F.col("Countries"))
    num = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if zero_coordinates else F.col(c).try_cast("double")
    return x.select(
        F.col("Glottocode").alias("glottocode"), F.col("Name").alias("name"), F.nullif(F.col("ISO639P3code"), F.lit("")).alias("iso_code"),
        F.array_remove(F.coalesce("alt", none), F.col("Name")).alias("alternate_names"), F.coalesce(F.get(split_list(F.col("Macroarea")), F.lit(0)), F.lit("Unknown")).alias("macroarea"),
        num("Latitude").alias("latitude"), num("Longitude").alias("longitude"),
        F.when(F.coalesce("Family_ID", F.lit("")) == "", "Isolate").otherwise(F.coalesce("family", F.lit("Unknown"))).alias("language_family"),
        F.col("e.status").alias("endangerment_status"), F.col("e.level").alias("endangerment_level"), countries.alias("countries"),
        contact_languages(countries, mapping or {}).alias("contact_languages"),
    )


def speaker_counts(languages: DataFrame, claims: DataFrame) -> DataFrame:
    """(``glottocode``, ``speaker_count``, ``speaker_count_confidence``): the greatest claim for the glottocode (medium), else for
    the ISO code (low); languages without a claim are left out. ``claims``: glottocode, iso_code, speakers."""
    g = claims.where("glottocode <> ''").groupBy("glottocode").agg(F.max("speakers").alias("a"))
    i = claims.where("iso_code <> ''").groupBy("iso_code").agg(F.max("speakers").alias("b"))
    x = languages.select("glottocode", "iso_code").join(g, "glottocode", "left").join(i, "iso_code", "left").where("coalesce(a, b) is not null")
    return x.select("glottocode", F.coalesce("a", "b").alias("speaker_count"), F.when(F.col("a").isNotNull(), "medium").otherwise("low").alias("speaker_count_confidence"))


def geojson_features(df: DataFrame) -> DataFrame:
    """One GeoJSON feature text per language with coordinates, short property names, defaults for missing values."""
    point = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    p = F.struct(
        F.col("glottocode").alias("g"), F.col("name").alias("n"), F.coalesce("endangerment_level", F.lit(0)).alias("l"), F.coalesce("speaker_count", F.lit(0)).alias("s"),
        F.coalesce("macroarea", F.lit("")).alias("m"), F.coalesce("language_family", F.lit("")).alias("f"),
    )
    f = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), p.alias("properties"))
    return df.where("latitude is not null and longitude is not null").select("glottocode", F.to_json(f).alias("feature"))


def simplify_ring(ring: Column, every: int = 8) -> Column:
    """Every n-th point of a ring rounded to one decimal, closed again."""
    points = F.transform(F.filter(F.sequence(F.lit(0), F.size(ring) - 1), lambda i: i % every == 0), lambda i: F.transform(F.get(ring, i), lambda x: F.round(x, 1)))
    first = F.get(points, F.lit(0))
    return F.when(F.element_at(points, -1) == first, points).otherwise(F.concat(points, F.array(first)))
