"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbarium.llm import encoding, languages, leaks, lookalike, mixing, neighbours, pages, scans, survivors
from verbarium.sources.tables import table


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "source", "text", table(spark, sf_dir, "mix_targets"))


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.expand(_mix(spark, sf_dir)[0])


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.find_garbled(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.restore(table(spark, sf_dir, "documents"), "doc_id", "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.site_lines(table(spark, sf_dir, "crawl_results"), "crawl_id", "url", "content")


def p4_main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_content(table(spark, sf_dir, "crawl_results"), "crawl_id", "url", "content")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "vocabulary"), "rec_id", "embedding").selectExpr("rec_id", "nn as nn_rec_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.faulty_lines(table(spark, sf_dir, "crawl_results"), "crawl_id", "content")


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repair(table(spark, sf_dir, "crawl_results"), "crawl_id", "content")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.report(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


P8_SQL = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}\p{M}]+') AS w FROM documents),
         i AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}\p{M}]+') AS w FROM eval_items),
         dg AS (SELECT doc_id, list_aggregate(w[k : k + 11], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
         ig AS (SELECT item_id, list_aggregate(w[k : k + 11], 'string_agg', ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
    SELECT DISTINCT item_id, doc_id FROM dg JOIN ig USING (g)"""


REFS = "cross_references"


def _trust():
    return F.array_max(F.transform(REFS, lambda x: x["reliability_score"]))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bundles of one field each. TESTDATA.md binds them by no dependency, so a search level has one open node a group."""
    v = table(spark, sf_dir, "vocabulary").select("id", "rec_id", "headword_romanized", REFS, "created_at")
    longest = F.array_max(F.transform(F.filter(REFS, lambda x: survivors.usable(x["definition"])), lambda x: F.length(x["definition"])))
    head = F.col("headword_romanized")
    bundles = [
        survivors.Bundle("headword_romanized", survivors.usable(head), F.length(head), F.lit(None)),
        survivors.Bundle("definition", longest.isNotNull(), longest, F.lit(None)),
        survivors.Bundle("reliability_score", _trust().isNotNull(), F.lit(0), F.lit(None)),
    ]
    out = survivors.choose(v, "id", "rec_id", bundles, _trust(), F.col("created_at"))
    return out.selectExpr("id", "bundle as field", "row as rec_id")


def p1_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors as consistent bundles: the headword forms, the word class, and the best cross-reference taken whole.
    The native headword determines the romanised one, and the word class goes with a headword it was seen with."""
    v = table(spark, sf_dir, "vocabulary").select("id", "rec_id", "headword_native", "headword_romanized", "pos", REFS, "created_at")
    ref = F.array_max(F.transform(F.filter(REFS, lambda x: survivors.usable(x["definition"])), lambda x: F.struct(x["reliability_score"], F.length(x["definition"]).alias("n"), x.alias("x"))))
    v = v.withColumn("ref", ref)
    native, roman, pos = F.col("headword_native"), F.col("headword_romanized"), F.col("pos")
    text = lambda **kw: F.to_json(F.struct(*(c.alias(k) for k, c in kw.items())))
    bundles = [
        survivors.Bundle("native", survivors.usable(native), F.length(native), text(headword_native=native)),
        survivors.Bundle("romanized", survivors.usable(roman), F.length(roman), text(headword_romanized=roman)),
        survivors.Bundle("pos", survivors.usable(pos), F.length(pos), text(pos=pos)),
        survivors.Bundle("reference", F.col("ref").isNotNull(), F.col("ref.n"), F.to_json("ref.x")),
    ]
    fds = [survivors.Dependency(("native", native), ("romanized", roman)), survivors.Dependency(("native", native), ("pos", pos))]
    out = survivors.choose(v, "id", "rec_id", bundles, _trust(), F.col("created_at"), fds, least=1)
    return out.selectExpr("id", "bundle", "row as rec_id", "value", "consistent")


P1_SQL = r"""
    WITH v AS (SELECT id, rec_id, created_at, headword_romanized AS h, list_max(list_transform(cross_references, lambda x: x.reliability_score)) AS trust,
                      list_max(list_transform(list_filter(cross_references, lambda x: coalesce(regexp_matches(x.definition, '[\p{L}\p{N}]') AND trim(lower(x.definition)) NOT IN ({BAD}), false)), lambda x: length(x.definition))) AS d
               FROM vocabulary),
         c AS (SELECT id, rec_id, created_at, trust, 'headword_romanized' AS field, length(h) AS n FROM v WHERE regexp_matches(h, '[\p{L}\p{N}]') AND trim(lower(h)) NOT IN ({BAD})
               UNION ALL SELECT id, rec_id, created_at, trust, 'definition', d FROM v WHERE d IS NOT NULL
               UNION ALL SELECT id, rec_id, created_at, trust, 'reliability_score', 0 FROM v WHERE trust IS NOT NULL),
         r AS (SELECT *, row_number() OVER (PARTITION BY id, field ORDER BY trust DESC NULLS LAST, created_at DESC NULLS LAST, n DESC, rec_id) AS k FROM c)
    SELECT id, field, rec_id FROM r WHERE k = 1 AND id IN (SELECT id FROM vocabulary GROUP BY id HAVING count(*) > 1)""".replace("{BAD}", ", ".join(f"'{x}'" for x in survivors.STAND_INS))

def _language_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "languages").selectExpr("iso_code as code", "explode(concat(array(name), coalesce(alternate_names, array()))) as name")
    return t.where("code <> ''").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawls, samples = table(spark, sf_dir, "crawl_results"), table(spark, sf_dir, "lang_samples")
    return languages.faulty_labels(crawls, "crawl_id", "content", "metadata.language", samples, "lang", "text", _language_names(spark, sf_dir))


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = languages.fit(table(spark, sf_dir, "lang_samples"), "lang", "text")
    return languages.segments(table(spark, sf_dir, "crawl_results"), "crawl_id", "content", model).withColumnRenamed("doc", "crawl_id")


P3_FIELDS = {"headword_native": "headword_native", "target": "example_sentences.target"}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lookalike.same_look_pairs(table(spark, sf_dir, "vocabulary"), "rec_id", "language_code", P3_FIELDS)
    return pairs.selectExpr("field", "a as rec_a", "b as rec_b")


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with look-alikes by class, with their number of links."""
    return lookalike.same_look_classes(table(spark, sf_dir, "vocabulary"), "rec_id", "language_code", P3_FIELDS)


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each headword and each example sentence (arrays in the order of ``example_sentences``) with its canonical text and its key."""
    texts = table(spark, sf_dir, "vocabulary").select("rec_id", *(F.expr(e).alias(name) for name, e in P3_FIELDS.items()))
    return lookalike.canonicalise(texts, {"headword_native": "headword_form", "target": "target_form"})


QUERIES = {
    "p1_found": p1_found,
    "p1_entries": p1_entries,
    "p2_found": p2_found,
    "p2_segments": p2_segments,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p3_canonical": p3_canonical,
    "p4_found": p4_found,
    "p4_main_content": p4_main_content,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_repaired": p6_repaired,
    "p8_found": p8_found,
    "p8_report": p8_report,
    "p9_selection": p9_selection,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}
SQL: dict[str, str] = {
    "p1_found": P1_SQL,
    "p8_found": P8_SQL,
}
