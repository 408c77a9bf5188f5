"""Sinks: exports, backups, run artifacts, versioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def export_columns(df: DataFrame, key: str, languages: list[str]) -> DataFrame:
    """One ``definitions_<lang>`` column per language, English first and the others sorted; the texts of a language in their
    order, joined by ``; ``; absent languages are empty. Array expressions only, no pivot and no shuffle."""
    order = [x for x in ("en",) if x in languages] + sorted(x for x in languages if x != "en")

    def texts(lang: str) -> Column:
        own = F.filter("definitions", lambda x: x["language"] == lang)
        return F.coalesce(F.array_join(F.transform(own, lambda x: x["text"]), "; "), F.lit(""))

    return df.select(key, *(texts(x).alias(f"definitions_{x}") for x in order))


def definition_languages(df: DataFrame, most: int = 10_000) -> list[str]:
    """The languages of all definitions, sorted. More than ``most`` would not fit a table's columns and are an error."""
    rows = df.select(F.explode("definitions").alias("x")).select("x.language").where("language is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} languages of definitions")
    return sorted(r["language"] for r in rows)


def export_json(df: DataFrame, path: str) -> None:
    """``{"entries": [...], "total": n}`` as line-wise JSON parts: the rows, and the envelope with their number."""
    df.write.mode("overwrite").json(f"{path}/entries")
    df.sparkSession.read.schema(df.schema).json(f"{path}/entries").agg(F.count("*").alias("total")).coalesce(1).write.mode("overwrite").json(f"{path}/envelope")


def read_runs(spark: SparkSession, path: str, schema, language_code: str, k: int = 10) -> DataFrame:
    """The newest ``k`` runs of one language that did not fail; unreadable artifacts are dropped."""
    x = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where((F.col("language_code") == language_code) & F.col("id").isNotNull())
    return x.where("lower(coalesce(status, '')) <> 'error'").orderBy(F.col("started_at").desc_nulls_last(), "id").limit(k)


def write_csv(df: DataFrame, path: str) -> None:
    """All cells quoted, quotes doubled, line ends kept."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_backup(df: DataFrame, path: str, name: str) -> DataFrame:
    """Rows as JSON under ``path/name`` and one manifest row (name, rows) that the reader goes by; the manifest is written
    last, so an unfinished backup is never the latest."""
    df.write.mode("overwrite").json(f"{path}/{name}")
    manifest = df.sparkSession.createDataFrame([(name, df.sparkSession.read.json(f"{path}/{name}").count())], "name string, total long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/latest")
    return manifest


def read_backup(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the latest backup, each with its own language code."""
    name = spark.read.schema("name string, total long").json(f"{path}/latest").first()["name"]
    return spark.read.schema(schema).json(f"{path}/{name}")


def write_runs(df: DataFrame, path: str) -> None:
    """Run artifacts as JSON, one directory per language."""
    df.write.mode("append").partitionBy("language_code").json(path)


def latest_runs(spark: SparkSession, path: str, schema, language_code: str, k: int = 10) -> DataFrame:
    """The newest runs of one language (partition pruning), at most ``k``."""
    x = spark.read.schema(schema).json(path).where(F.col("language_code") == language_code)
    return x.orderBy(F.col("started_at").desc_nulls_last(), "id").limit(k)


def switch_version(df: DataFrame, path: str, version: int) -> None:
    """Write a new version beside the old ones, then point ``current`` at it: readers never see a dropped table."""
    df.write.mode("overwrite").parquet(f"{path}/v={version}")
    df.sparkSession.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/current")


def read_version(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v={spark.read.parquet(f'{path}/current').first()['version']}")


def cache_key(parts: dict[str, Column]) -> Column:
    """A short key of sorted ``name=value`` pairs."""
    text = F.concat_ws("&", *(F.concat(F.lit(f"{k}="), parts[k].cast("string")) for k in sorted(parts)))
    return F.substring(F.sha2(text, 256), 1, 12)
