"""Keyed merge-upserts of nested records, as aggregations instead of an ordered fold.

Rows of one id are its versions in arrival order; the first is the stored record, taken as it is. Folding the others in
order with per-field rules gives the same as: *arrays*: the first record's items plus, for each key it lacks, the earliest
item with that key; *scalars*: the latest value that counts; *confidence*: the highest rank, the earliest of equals;
*reliability*: the greatest score offered for the address. Each is a partial aggregation over (id, key), so a hot id is
combined on the map side and no version list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbarium.functions.classify import confidence_rank


def first_rows(df: DataFrame, key: str, seq: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(seq).alias("__first"))


def merge_items(df: DataFrame, key: str, seq: str, array: str, item_key) -> DataFrame:
    """(``key``, ``pos``, ``item``): the merged items in order. ``item_key``: item column -> key column; null keys are one key.
    Items that the first record repeats stay repeated; null items are dropped."""
    x = df.select(key, seq, F.posexplode(array).alias("at", "item")).where("item is not null").join(first_rows(df, key, seq), key)
    x = x.withColumn("k", F.coalesce(item_key(F.col("item")), F.lit("\0")))
    base = F.col(seq) == F.col("__first")
    kept = x.where(base).select(key, seq, "at", "item")
    later = x.groupBy(key, "k").agg(F.max(base).alias("has"), F.min(F.struct(seq, "at", "item")).alias("m")).where("not has").select(key, f"m.{seq}", "m.at", "m.item")
    return kept.unionByName(later).withColumn("pos", F.struct(seq, "at")).select(key, "pos", "item")


def merged_array(df: DataFrame, key: str, seq: str, array: str, item_key) -> DataFrame:
    """(``key``, ``array``): as :func:`merge_items`, one array per id (bounded by its distinct items)."""
    x = merge_items(df, key, seq, array, item_key)
    return x.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda y: y["item"]).alias(array))


def latest(value: Column, counts: Column, seq: str) -> Column:
    """The latest value for which ``counts`` holds."""
    return F.max_by(value, F.when(F.coalesce(counts, F.lit(False)), F.col(seq)))


def merge_scalars(df: DataFrame, key: str, seq: str, non_empty: list[str], non_null: list[str], confidence: str | None = None, stamp: str | None = None) -> DataFrame:
    """One row per id. ``non_empty`` fields are replaced by later texts that are not empty, ``non_null`` ones by any later
    value; the first record counts as it is. ``confidence`` only ever rises; ``stamp`` is the last version's."""
    x = df.join(first_rows(df, key, seq), key)
    first = F.col(seq) == F.col("__first")
    aggs = [latest(F.col(c), (F.col(c).isNotNull() & (F.col(c) != "")) | first, seq).alias(c) for c in non_empty]
    aggs += [latest(F.col(c), F.col(c).isNotNull() | first, seq).alias(c) for c in non_null]
    if confidence:
        c = F.col(confidence)
        aggs.append(F.max_by(c, F.when(c.isNotNull(), F.struct(confidence_rank(c).alias("r"), (-F.col(seq)).alias("s")))).alias(confidence))
    if stamp:
        aggs.append(F.max_by(F.col(stamp), F.col(seq)).alias(stamp))
    return x.groupBy(key).agg(*aggs)


def merge_references(df: DataFrame, key: str, seq: str, array: str = "cross_references") -> DataFrame:
    """(``key``, ``array``, ``source_count``): references merged by address; each gets the greatest score that a later
    version offers for its address if that beats its own."""
    later = df.select(key, seq, F.posexplode(array).alias("at", "x")).join(first_rows(df, key, seq), key).where(F.col(seq) > F.col("__first"))
    per = later.where("x.reliability_score is not null").groupBy(key, seq, F.col("x.source_url").alias("url")).agg(F.max_by("x.reliability_score", "at").alias("s"))
    best = per.groupBy(key, "url").agg(F.max("s").alias("offered"))
    items = merge_items(df, key, seq, array, lambda x: x["source_url"]).withColumn("url", F.col("item.source_url"))
    x = items.join(best, [key, "url"], "left")
    item = F.col("item").withField("reliability_score", F.greatest(F.col("item.reliability_score"), F.col("offered")))
    x = x.select(key, F.struct("pos", item.alias("item")).alias("p"))
    return x.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("p")), lambda y: y["item"]).alias(array), F.count("*").alias("source_count"))


def union_terms(df: DataFrame, key: str, array: str) -> DataFrame:
    """(``key``, ``array``): the sorted set of all versions' terms."""
    return df.select(key, F.explode(array).alias("t")).groupBy(key).agg(F.array_sort(F.collect_set("t")).alias(array))


def merge_entries(df: DataFrame, key: str = "id", seq: str = "rec_id") -> DataFrame:
    """The merged vocabulary: one row per id with a headword that is not blank."""
    rows = df.where("trim(coalesce(headword_native, '')) <> ''")
    scalars = merge_scalars(
        rows, key, seq, ["headword_romanized", "audio_url", "ipa", "grammar_notes", "language_code", "glottocode", "language_name", "pronunciation_video_url"],
        ["headword_native", "pos", "semantic_cluster", "cultural_context", "morphology", "usage"], "language_confidence", "created_at",
    )
    out = scalars
    for part in (
        merged_array(rows, key, seq, "definitions", lambda x: F.concat_ws("::", x["language"], x["text"])),
        merged_array(rows, key, seq, "example_sentences", lambda x: x["target"]), merged_array(rows, key, seq, "conjugations", lambda x: x["form"]),
        merge_references(rows, key, seq), union_terms(rows, key, "related_terms"),
    ):
        out = out.join(part, key, "left")
    return out.withColumn("source_count", F.coalesce("source_count", F.lit(0)))


def upsert(stored: DataFrame, incoming: DataFrame, key: str, seq: str) -> DataFrame:
    """Stored and incoming versions merged; stored records come first whatever their numbers."""
    low = F.lit(-1).cast("long")
    both = stored.withColumn(seq, low).unionByName(incoming, allowMissingColumns=True)
    return merge_entries(both, key, seq)


def merge_grammar(df: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The merged grammar patterns, one row per id: examples by target, vocabulary and sources as sets, description and rule by the latest text
    that is not empty, the difference by the latest that is not null, the last version's time."""
    rows = df.withColumnRenamed("examples", "__examples").withColumn("examples", F.filter("__examples", lambda x: x.isNotNull())).drop("__examples")
    out = merge_scalars(rows, key, seq, ["description", "rule"], ["title", "title_native", "category", "differences_from_contact", "language_code"], "confidence", "created_at")
    for part in (merged_array(rows, key, seq, "examples", lambda x: F.coalesce(x["target"], F.lit(""))), union_terms(rows, key, "related_vocabulary"), union_terms(rows, key, "source_urls")):
        out = out.join(part, key, "left")
    return out
