"""Event streams: upsert state, ring buffer, counters, windows, rate breaches; the same expressions serve batch and stream.

Events carry ``seq`` (arrival order). In a stream the upsert state is kept per id by arrival number, so a replayed file or a
late delivery changes nothing; windowed results use a watermark on the event time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The statuses in the order in which they win when a run has several.
PRECEDENCE = {"cancelled": 4, "complete": 3, "error": 2, "running": 1}
KNOWN = ("running", "complete", "error", "pending", "cancelled")


def event_key() -> Column:
    """What makes two rows versions of one event: the id; a null id is an event of its own."""
    return F.coalesce("id", F.concat(F.lit("\0"), F.col("seq").cast("string")))


def upsert_by_id(df: DataFrame) -> DataFrame:
    """The latest version of each event id at the place of its first (``first_seen``); repeated deliveries change nothing.
    One partial aggregation, no sort. A null id is an event of its own."""
    k = event_key()
    last = F.max_by(F.struct(*df.columns), F.col("seq")).alias("e")
    x = df.groupBy(k.alias("__k")).agg(F.min("seq").alias("first_seen"), last)
    return x.select("first_seen", "e.*")


def ring_buffer(df: DataFrame, size: int = 200) -> DataFrame:
    """The newest ``size`` events by place in the upserted history (the buffer's own limit)."""
    return upsert_by_id(df).orderBy(F.desc("first_seen")).limit(size)


def counters(df: DataFrame) -> DataFrame:
    """Running counters over the upserted events."""
    done = F.col("status") == "complete"
    n = F.coalesce("data.count", F.lit(0))
    return df.agg(
        F.count_if(done & (F.col("action") == "crawl")).alias("crawled"), F.sum(F.when(done & (F.col("agent") == "extraction"), n).otherwise(0)).alias("extracted"),
        F.count_if(F.coalesce("data.brightdata_unlocked", F.lit(False))).alias("unlocked"), F.count_if(F.col("data.discovered_via").isNotNull()).alias("discovered"), F.count_if(F.col("status") == "error").alias("errors"),
    )


def status_of(df: DataFrame, by: str) -> DataFrame:
    """(``by``, ``status``): the winning status of each group's latest versions; null and unknown ones count least."""
    m = F.create_map(*(F.lit(x) for kv in PRECEDENCE.items() for x in kv))
    s = F.lower("status")
    return upsert_by_id(df).groupBy(by).agg(F.max_by(s, F.struct(F.coalesce(m[s], F.lit(0)), s)).alias("status"))


def settled(status: Column, last_seen: Column, now: Column, stale: str = "INTERVAL 10 MINUTES") -> Column:
    """``status`` with a ``running`` that was not heard of for ``stale`` resolved to ``complete``."""
    return F.when((status == "running") & (last_seen + F.expr(stale) < now), "complete").otherwise(status)


def tumbling(df: DataFrame, width: str, ts: str = "timestamp") -> DataFrame:
    """Events per window and status."""
    x = df.groupBy(F.window(ts, width).alias("w"), F.lower("status").alias("status")).agg(F.count("*").alias("n"))
    return x.select(F.col("w.start").alias("start"), "status", "n")


def sessions(df: DataFrame, gap: str, by: str, ts: str = "timestamp") -> DataFrame:
    x = df.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return x.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def rate_breaches(df: DataFrame, width: str, most: int, by: str, ts: str = "timestamp") -> DataFrame:
    """Windows in which a sender had more than ``most`` events."""
    x = df.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return x.select(F.col("w.start").alias("start"), by, "n")


def activity_feed(df: DataFrame, size: int = 8) -> DataFrame:
    return upsert_by_id(df).orderBy(F.desc("seq")).select("seq", "id", "agent", "action", "status").limit(size)


# streams


def read_events(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A file stream of events, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_windows(df: DataFrame, width: str, late: str, ts: str = "timestamp") -> DataFrame:
    """Windowed counts of distinct events under a watermark: repeats within it are dropped, rows behind it ignored."""
    x = df.where(F.col(ts).isNotNull()).withWatermark(ts, late).dropDuplicatesWithinWatermark(["id", "status"])
    return x.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))


def upsert_sink(state_path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the upserted history as versions of a table: batch n writes version n from
    version n-1, so a retried batch writes the same version again (idempotent, survives lost executors)."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if n > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{state_path}/v={n - 1}").unionByName(batch)
        rows = rows.withColumn("__k", event_key())
        first = rows.groupBy("__k").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
        # of each event the first version (its place) and the latest one (its state)
        keep = rows.join(first, "__k").where("seq = lo or seq = hi").dropDuplicates(["__k", "seq"]).drop("lo", "hi", "__k")
        keep.write.mode("overwrite").parquet(f"{state_path}/v={n}")

    return write


def replay_then_live(spark, state_path: str, version: int, path: str, schema) -> tuple[DataFrame, DataFrame]:
    """For a late joiner: the upserted history as of ``version`` of :func:`upsert_sink`, and the stream of the events after it."""
    history = upsert_by_id(spark.read.schema(schema).parquet(f"{state_path}/v={version}"))
    last = history.agg(F.max("seq")).first()[0]
    return history, read_events(spark, path, schema).where(F.col("seq") > F.lit(-1 if last is None else last))


def running_counts(df: DataFrame) -> DataFrame:
    """Update-mode counts by action and status."""
    return df.groupBy("action", "status").agg(F.count("*").alias("n"))


def latest_first(df: DataFrame) -> DataFrame:
    """Each event's place in its agent's history, newest first."""
    return df.withColumn("r", F.row_number().over(Window.partitionBy("agent").orderBy(F.desc("seq"))))
