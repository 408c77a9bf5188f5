"""p7: nested records as related flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verbarium.operators import nested
from verbarium.plans.runtime import spread
from verbarium.sources.tables import table


def _nodes(spark: SparkSession, sf_dir: str, typed: bool = True) -> DataFrame:
    raw = table(spark, sf_dir, "raw_entries").select("raw_id", "payload")
    return nested.flatten_payloads(spread(raw), "raw_id", "payload", typed)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir, typed=False).where("filled and child <> 'entries'")
    return nodes.selectExpr("record as raw_id", "entry_pos", "child", "child_pos")


def _raw(kind: str):
    return lambda spark, sf_dir: nested.payload_tables(_nodes(spark, sf_dir), "raw_id")[kind]


def _voc(column: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nested.child_table(table(spark, sf_dir, "vocabulary"), ["rec_id"], column)

    return run


def p7_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many children of each kind have each structural variant."""
    return _nodes(spark, sf_dir, typed=False).groupBy("child", "variant", "filled").count().withColumnRenamed("count", "n")


def _voc_sql(column: str, fields: dict[str, str]) -> str:
    filled = ", ".join(
        f"CASE WHEN {f'c.{f} IS NOT NULL' if t == 'n' else f'length(trim(c.{f})) > 0'} THEN '{f}' END" for f, t in fields.items()
    )
    return f"""
        WITH x AS (SELECT rec_id, unnest({column}) AS c, generate_subscripts({column}, 1) - 1 AS child_pos FROM vocabulary),
             y AS (SELECT rec_id, CAST(child_pos AS INT) AS child_pos, concat_ws('+', {filled}) AS variant, {', '.join(f'c.{f} AS {f}' for f in fields)} FROM x)
        SELECT * FROM y WHERE variant <> ''"""


QUERIES = {
    "p7_found": p7_found,
    "p7_raw_entries": _raw("entries"),
    "p7_raw_definitions": _raw("definitions"),
    "p7_raw_example_sentences": _raw("example_sentences"),
    "p7_raw_cross_references": _raw("cross_references"),
    "p7_variants": p7_variants,
    "p7_voc_definitions": _voc("definitions"),
    "p7_voc_example_sentences": _voc("example_sentences"),
    "p7_voc_cross_references": _voc("cross_references"),
}
SQL = {
    "p7_voc_definitions": _voc_sql("definitions", {"language": "s", "text": "s"}),
    "p7_voc_example_sentences": _voc_sql("example_sentences", {"target": "s", "contact": "s", "english": "s", "source_url": "s"}),
    "p7_voc_cross_references": _voc_sql(
        "cross_references",
        {"source_title": "s", "source_url": "s", "source_type": "s", "definition": "s", "notes": "s", "reliability_score": "n"},
    ),
}
