"""Operators of the archive: boolean filters, sorting, verification, clip matching, updates, statistics, extraction rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbarium.functions import text as X
from verbarium.operators import retrieval as R
from verbarium.plans.runtime import small, stored


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def boolean(df: DataFrame, must: list[Column] = (), must_not: list[Column] = (), should: list[Column] = (), least: int = 0) -> DataFrame:
    """Rows for which all of ``must``, none of ``must_not`` and at least ``least`` of ``should`` hold; null is no hit."""
    out = reduce(lambda d, c: d.where(_true(c)), must, df)
    out = reduce(lambda d, c: d.where(~_true(c)), must_not, out)
    return out.where(sum((_true(c).cast("int") for c in should), F.lit(0)) >= least) if least else out


def sorted_languages(df: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Languages by name, level, speakers or countries (the smallest of them, the greatest if descending); nulls last both ways."""
    key = {"name": F.col("name"), "level": F.col("endangerment_level"), "speakers": F.col("speaker_count"), "countries": (F.array_max if descending else F.array_min)("countries")}[by]
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "glottocode")


def content_gates(df: DataFrame, content: str, kind: Column) -> DataFrame:
    """Whether a content is long enough to extract from, to accept, as a page of a known site, and whether it is hardly any text."""
    n = F.length(F.trim(content))
    return df.withColumns({"extract": n >= 300, "accept": (n >= 200) | _true(kind == "video"), "site_page": n >= 100, "triage": n < 50})


def verified(entries: DataFrame, texts: DataFrame, scope: str, key: str, text: str) -> DataFrame:
    """(``key``, ``headword_native``): headwords with a definition that is not blank which a text of their ``scope`` contains.

    Texts of many words would meet each headword of their language; instead every substring position is looked up by the headword's
    first word: both sides are joined on (scope, first word), then the whole headword is checked.
    """
    has = F.exists("definitions", lambda x: F.trim(F.coalesce(x["text"], F.lit(""))) != "")
    e = entries.where(_true(has) & (F.trim(F.coalesce("headword_native", F.lit(""))) != "")).select(scope, "headword_native").distinct()
    # a substring begins inside some run without a space: the headword's first run is looked up among the ends of the text's runs
    e = e.withColumn("head", F.regexp_extract("headword_native", r"^\S+|^\s+\S*", 0))
    size = e.select(F.length("head").alias("n")).distinct()
    runs = texts.select(scope, key, F.explode(F.array_distinct(F.split(text, r"\s+"))).alias("run"))
    sizes = F.broadcast(size.agg(F.collect_set("n").alias("ns")))  # one row: the lengths of first runs
    grams = runs.join(sizes).select(scope, key, F.explode(F.flatten(F.transform("ns", lambda n: F.when(F.length("run") >= n, F.transform(F.sequence(F.lit(1), F.length("run") - n + 1), lambda i: F.substring(F.col("run"), i, n))).otherwise(F.array().cast("array<string>"))))).alias("head"))
    met = grams.distinct().join(e, [scope, "head"]).select(scope, key, "headword_native").distinct()
    return met.join(texts.select(key, F.col(text).alias("__t")), key).where(F.col("__t").contains(F.col("headword_native"))).select(key, "headword_native").distinct()


#: Shortest and longest word, edits allowed.
CLIP_EDITS = ((0, 3, 1), (4, 6, 2), (7, None, 3))


def match_clips(df: DataFrame, key: str) -> DataFrame:
    """(``key``, ``url``, ``how``): a clip for each entry without one: by its native headword, else by its romanised one, else by the clip
    word nearest to the native headword within the edits its length allows (ties: the smaller word). Words are compared composed,
    trimmed and in lower case; clips are the rows with audio, by romanised headword."""
    n = df.select(key, X.nfc_key(F.coalesce("headword_native", F.lit(""))).alias("n"), X.nfc_key(F.coalesce("headword_romanized", F.lit(""))).alias("r"), "audio_url")
    clips = n.where("audio_url <> '' and r <> ''").groupBy(F.col("r").alias("w")).agg(F.min("audio_url").alias("url"))
    clips = stored(clips, "clips")
    x = n.where("coalesce(audio_url, '') = ''").drop("audio_url")
    x = x.join(clips.select(F.col("w").alias("n"), F.col("url").alias("u1")), "n", "left").join(clips.select(F.col("w").alias("r"), F.col("url").alias("u2")), "r", "left")
    x = stored(x, "clip-entries")
    open_ = x.where("u1 is null and u2 is null and length(n) > 1").select(F.col("n").alias("w")).distinct()
    near = R.fuzzy_join(open_, clips.select("w"), "w", CLIP_EDITS).withColumn("dist", F.levenshtein("w_l", "w_r"))
    best = near.groupBy(F.col("w_l").alias("n")).agg(F.min_by("w_r", F.struct("dist", "w_r")).alias("w")).join(clips, "w").select("n", F.col("url").alias("u3"))
    x = x.join(best, "n", "left")
    how = F.when(F.col("u1").isNotNull(), "native").when(F.col("u2").isNotNull(), "romanized").otherwise("fuzzy")
    return x.where("coalesce(u1, u2, u3) is not null").select(key, F.coalesce("u1", "u2", "u3").alias("url"), how.alias("how"))


def append_references(refs: Column, urls: Column) -> Column:
    """The references with one more for each address that none of them has."""
    had = F.coalesce(F.transform(refs, lambda x: x["source_url"]), F.array().cast("array<string>"))
    new = F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: ~F.coalesce(F.array_contains(had, u), F.lit(False)))
    made = F.transform(new, lambda u: F.struct(F.lit(None).cast("string").alias("source_title"), u.alias("source_url"), F.lit("archive").alias("source_type"), F.lit(None).cast("string").alias("definition"), F.lit(None).cast("string").alias("notes"), F.lit(None).cast("double").alias("reliability_score")))
    return F.concat(F.coalesce(refs, F.filter(made, lambda x: F.lit(False))), made)


def archive_stats(entries: DataFrame, grammar: DataFrame, goal: float = 20_000.0) -> DataFrame:
    """One row: entries, grammar, clusters, coverage of ``goal`` in per cent, sources in all and of each known type."""
    kinds = ("dictionary", "academic", "video", "archive", "wiki")
    one = entries.agg(F.count("*").alias("entries"), F.count_distinct("semantic_cluster").alias("clusters"))
    refs = entries.select(F.explode("cross_references").alias("x")).agg(F.count("*").alias("sources"), *(F.count_if(F.col("x.source_type") == k).alias(k) for k in kinds))
    out = one.join(F.broadcast(refs)).join(F.broadcast(grammar.agg(F.count("*").alias("grammar"))))  # one row each
    return out.select("entries", "grammar", "clusters", X.round_half_up(F.col("entries") / goal * 100, 1).alias("coverage"), "sources", *kinds)


def update_nested(df: DataFrame, new: DataFrame, key: str, struct: str, fields: list[str]) -> DataFrame:
    """``df`` with the ``fields`` of its column ``struct`` replaced by those of ``new`` (one row per key) where they are not null."""
    x = df.join(new.select(key, *(F.col(f).alias(f"__{f}") for f in fields)), key, "left")
    kind = df.schema[struct].dataType
    made = F.struct(*((F.coalesce(F.col(f"__{f.name}").cast(f.dataType), F.col(struct)[f.name]) if f.name in fields else F.col(struct)[f.name]).alias(f.name) for f in kind.fields))
    return x.withColumn(struct, made).select(*df.columns)


def union_first(lists: list[DataFrame], key: str) -> DataFrame:
    """The rows of several lists of one schema, each key from the first list that has it, with its ``rank`` (from 1). Equal keys of one list
    give one row."""
    both = reduce(DataFrame.unionByName, (d.withColumn("rank", F.lit(i + 1)) for i, d in enumerate(lists)))
    return both.groupBy(key).agg(F.min(F.struct("rank", *(c for c in both.columns if c not in (key, "rank")))).alias("m")).select(key, "m.*")


def markdown_titles(df: DataFrame, text: str, fallback: str, least: int) -> DataFrame:
    """``df`` with the ``title`` of its Markdown: the first heading of up to three marks, else the first line, else ``fallback``; texts of fewer
    than ``least`` characters are left out."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    title = F.coalesce(full(F.regexp_extract(text, r"(?m)^#{1,3}[ \t]+(.+)$", 1)), full(F.substring(F.get(F.split(text, "\n", 2), F.lit(0)), 1, 200)), F.col(fallback))
    return df.where(F.length(F.trim(text)) >= least).withColumn("title", title)


def first_of_alike(df: DataFrame, keys: list[str], text: str, order: str, most: int = 200) -> DataFrame:
    """Of the rows of equal ``keys`` whose texts begin with the same ``most`` characters the one that comes first (the key is the feature's:
    it is hashed, so no text is shuffled)."""
    h = F.struct(F.xxhash64(F.substring(text, 1, most)), F.hash(F.substring(text, 1, most)))
    first = df.select(*keys, h.alias("__h"), order).groupBy(*keys, "__h").agg(F.min(order).alias(order))
    return df.join(small(first.select(order)), order, "left_semi")


#: Fields of language search with their weights; the first counts whole, others by word.
LANGUAGE_FIELDS = (("name", 3), ("alternate_names", 2), ("language_family", 1))
LANGUAGE_KEYS = (("name", 4), ("iso_code", 3), ("glottocode", 3))


def language_search(df: DataFrame, query: str) -> DataFrame:
    """Languages with a ``score``: the best weighted field with a word within the edits allowed for each query word, plus the best with a word
    that the last query word begins."""
    words = query.lower().split()
    empty = F.array().cast("array<string>")
    tokens = {c: F.coalesce(X.tokens(F.array_join(F.col(c), " ") if df.schema[c].dataType.typeName() == "array" else F.col(c)), empty) for c, _ in LANGUAGE_FIELDS}
    near = lambda ws: reduce(lambda a, b: a | b, (R.fuzzy(ws, w) for w in words))
    hits = [F.when(near(tokens[c]), b).otherwise(0) for c, b in LANGUAGE_FIELDS]
    hits += [F.when(R.fuzzy(F.array(F.lower(F.coalesce(c, F.lit("")))), query.lower()), b).otherwise(0) for c, b in LANGUAGE_KEYS]
    hits.append(F.when(near(F.transform(F.coalesce("countries", empty), lambda x: F.lower(x))), 1).otherwise(0))
    starts = [F.when(F.exists(tokens[c], lambda w: w.startswith(words[-1])), b).otherwise(0) for c, b in LANGUAGE_FIELDS]
    return df.withColumn("score", F.greatest(*hits) + F.greatest(*starts)).where("score > 0")


# Word classes, and the levels of confidence and register with their defaults.
LEVELS = ("low", "medium", "high")


def extracted_entries(nodes: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Vocabulary rows from the nodes of extraction answers (:func:`nested.flatten_payloads`): entries with a headword and a word class, texts
    trimmed, a deterministic id, confidence ``medium``, register ``dialectal``, one source; ``n_definitions`` counts the definitions that hold a text."""
    t = lambda c: F.nullif(F.trim(c), F.lit(""))
    e = nodes.where("child = 'entries'").select(F.col("record").alias(key), "entry_pos", t("headword_native").alias("headword_native"), t("headword_romanized").alias("headword_romanized"), F.lower(t("pos")).alias("pos"))
    d = nodes.where("child = 'definitions' and filled").groupBy(F.col("record").alias(key), "entry_pos").agg(F.count("*").alias("n_definitions"))
    e = e.where("headword_native is not null and pos is not null").join(d, [key, "entry_pos"], "left").join(answers, key)
    eid = F.concat(F.lit("voc-"), F.substring(F.sha2(F.concat_ws("::", "language_code", "headword_native", "pos"), 256), 1, 12))
    return e.select(key, "entry_pos", eid.alias("id"), "headword_native", "headword_romanized", "pos", F.coalesce("n_definitions", F.lit(0)).alias("n_definitions"), "url", "language_code",
                    F.lit("medium").alias("language_confidence"), F.lit("dialectal").alias("register"), F.lit(1).alias("source_count"))


def register_functions(spark: SparkSession) -> None:
    """SQL functions of this package, all of them expressions: ``verbarium_slug``, ``verbarium_video_id``, ``verbarium_confidence``."""
    for name, args, kind, body in (
        ("verbarium_slug", "t STRING", "STRING", "lower(regexp_replace(t, '[^a-zA-Z0-9]+', '-'))"),
        ("verbarium_video_id", "u STRING", "STRING", "nullif(regexp_extract(u, '(?:v=|youtu[.]be/|/embed/|/shorts/)([A-Za-z0-9_-]{11})', 1), '')"),
        ("verbarium_confidence", "c STRING", "INT", "CASE c WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 0 END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
