"""Mixing sources to target weights: capped water-filling and seeded repetition.

Sizes are tokens of a public tokenizer over whole texts. Each source gets its target share of the budget, clamped at its
tokens times the repetitions it is allowed; what clamped sources leave is dealt to the others in proportion to their
targets until nothing overflows. A source's allotment is a number of whole passes plus a part of one: the part is the set
of records below a threshold of a seeded hash, and the threshold is found by two rounds of a histogram over the hash, so
that the tokens taken meet the allotment to within a cell, without sorting or moving the records.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbarium.plans.runtime import spread, stored

#: Cells of one round of the histogram; a cell of the last round holds 1 / CELLS**2 of a source.
CELLS = 4096


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary ``name`` lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(df: DataFrame, keys: list[str], text: str, tokenizer: str | None = None) -> DataFrame:
    """``keys`` and ``tokens`` of every row; a null text has 0. ``tokenizer``: a vocabulary file of the driver, sent to the executors."""
    at = tokenizer or tokenizer_file()
    df.sparkSession.sparkContext.addFile(at)
    name = os.path.basename(at)
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import SparkFiles
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = Tokenizer.from_file(SparkFiles.get(name))
        tok.encode_special_tokens = True
        for b in batches:
            n: list[int] = []
            part: list[str] = []
            size = 0
            for t in [*b["__text"], None]:  # by size, so that long texts don't add up in memory
                if t is not None:
                    part.append(t)
                    size += len(t)
                if part and (t is None or size > 200_000):
                    n += [len(e) for e in tok.encode_batch(part, add_special_tokens=False)]
                    part, size = [], 0
            yield b.drop(columns="__text").assign(tokens=n)

    src = df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return spread(src).mapInPandas(run, schema)


@dataclass
class Allotment:
    """A source's part of the mix, in tokens."""

    source: str
    share: float
    size: int
    cap: float
    given: float = 0.0


def water_fill(sources: list[Allotment], budget: float) -> list[Allotment]:
    """Fill ``given`` of each source: the target share of the budget, clamped at ``cap``, with the excess dealt in proportion
    to the targets of the sources that still have room. The rest stays unspent if all are full."""
    open_ = [s for s in sources if s.share > 0 and s.cap > 0]
    left = budget
    while open_ and left > 0:
        weight = sum(s.share for s in open_)
        full = [s for s in open_ if s.share / weight * left >= s.cap]
        if not full:
            for s in open_:
                s.given = s.share / weight * left
            break
        for s in full:
            s.given = s.cap
            left -= s.cap
        open_ = [s for s in open_ if s not in full]
    return sources


def _thresholds(counted: DataFrame, source: str, parts: dict[str, float]) -> DataFrame:
    """(``source``, ``cut``): the hash value below which a source's records make up the tokens asked for in ``parts``."""
    spark = counted.sparkSession
    want = spark.createDataFrame([(s, float(p)) for s, p in parts.items()] or [], "s string, want double")
    cells = counted.select(F.col(source).alias("s"), F.floor(F.col("u") * CELLS).cast("int").alias("c1"), F.floor(F.col("u") * CELLS * CELLS).cast("long").alias("c2"), "tokens")
    w = Window.partitionBy("s").orderBy("c")

    def reach(hist: DataFrame) -> DataFrame:
        """Cells in order with the tokens before them; at most CELLS rows a source."""
        return hist.withColumn("before", F.coalesce(F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    one = reach(cells.groupBy("s", F.col("c1").alias("c")).agg(F.sum("tokens").alias("t"))).join(F.broadcast(want), "s")
    edge = one.where((F.col("before") <= F.col("want")) & (F.col("want") < F.col("before") + F.col("t"))).groupBy("s").agg(F.min(F.struct("c", "before", "want")).alias("e"))
    edge = stored(edge.select("s", F.col("e.c").alias("c1"), (F.col("e.want") - F.col("e.before")).alias("want")), "p9-edge")
    inner = cells.join(F.broadcast(edge), ["s", "c1"]).groupBy("s", F.col("c2").alias("c")).agg(F.sum("tokens").alias("t"), F.first("want").alias("want"))
    two = reach(inner)
    # a cell is taken if more than half of it is wanted
    last = two.where(F.col("before") + F.col("t") / 2 <= F.col("want")).groupBy("s").agg(F.max("c").alias("c"))
    cut = edge.join(last, "s", "left").select("s", F.coalesce((F.col("c") + 1) / float(CELLS * CELLS), F.col("c1") / float(CELLS)).alias("cut"))
    return want.select("s").join(cut, "s", "left").select(F.col("s").alias(source), F.coalesce("cut", F.lit(1.0)).alias("cut"))


def mix(
    docs: DataFrame, key: str, source: str, text: str, targets: DataFrame, share: str = "target_share", repeats: str = "max_repeats",
    budget: float | None = None, seed: int = 0, tokenizer: str | None = None, most_sources: int = 10_000,
) -> tuple[DataFrame, DataFrame]:
    """(selection, shares).

    ``selection``: ``key``, ``source``, ``tokens``, ``copies`` of every record taken at least once (:func:`expand` writes the
    copies out). ``shares``: for each target source the tokens it has, its cap, allotment, the tokens taken, the share
    reached and the passes over it. ``budget``: tokens of the mix, by default all tokens of the target sources. Records of
    other or null sources are not taken; a null share is 0, null repetitions are 1; repeated keys are records of their own,
    equal copies get the same fate. A source listed twice is an error, as are more than ``most_sources`` targets.
    """
    rows = targets.select(F.col(source).alias("s"), F.coalesce(F.col(share), F.lit(0.0)).cast("double").alias("w"), F.coalesce(F.col(repeats), F.lit(1)).cast("double").alias("r")).where("s is not null").limit(most_sources + 1).collect()
    if len(rows) > most_sources or len({r["s"] for r in rows}) < len(rows):
        raise ValueError("too many or repeated target sources")
    spark = docs.sparkSession
    goal = spark.createDataFrame([(r["s"], r["w"], r["r"]) for r in rows], f"{source} string, w double, r double")
    counted = token_counts(docs.join(F.broadcast(goal.select(source)), source, "left_semi"), [key, source], text, tokenizer)
    u = (F.xxhash64(F.lit(seed), F.col(key).cast("string")).bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53)
    counted = stored(counted.withColumn("u", u), "p9-tokens")
    sizes = {r[source]: r["n"] for r in counted.groupBy(source).agg(F.sum("tokens").alias("n")).collect()}
    plan = [Allotment(r["s"], max(0.0, r["w"]), int(sizes.get(r["s"]) or 0), max(0.0, r["r"]) * (sizes.get(r["s"]) or 0)) for r in rows]
    water_fill(plan, float(sum(a.size for a in plan)) if budget is None else float(budget))
    whole = {a.source: int(a.given // a.size) if a.size else 0 for a in plan}
    part = {a.source: a.given - whole[a.source] * a.size for a in plan if a.size}
    cuts = _thresholds(counted, source, {s: p for s, p in part.items() if p > 0})
    passes = spark.createDataFrame([(a.source, whole[a.source]) for a in plan], f"{source} string, whole int")
    selection = (
        counted.join(F.broadcast(passes), source).join(F.broadcast(cuts), source, "left")
        .withColumn("copies", F.col("whole") + F.coalesce((F.col("u") < F.col("cut")).cast("int"), F.lit(0)))
        .where("copies > 0").select(key, source, "tokens", "copies")
    )
    taken = selection.groupBy(source).agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken"), F.count("*").alias("records"), F.sum("copies").alias("n"))
    frame = spark.createDataFrame([(a.source, a.share, a.size, a.cap, a.given) for a in plan], f"{source} string, target_share double, tokens_available long, tokens_cap double, tokens_allotted double")
    got = F.coalesce("taken", F.lit(0))
    shares = frame.join(taken, source, "left").select(
        source, "target_share", "tokens_available", "tokens_cap", "tokens_allotted", got.alias("tokens_taken"), F.coalesce("records", F.lit(0)).alias("records_taken"),
        F.coalesce("n", F.lit(0)).alias("copies_taken"), F.coalesce(F.try_divide(got, F.sum(got).over(Window.partitionBy(F.lit(1)))), F.lit(0.0)).alias("share_reached"),
        F.coalesce(F.try_divide(got, F.col("tokens_available")), F.lit(0.0)).alias("passes"),
    )
    return selection, shares


def expand(selection: DataFrame) -> DataFrame:
    """The selection with one row per copy, ``copy`` counted from 1."""
    return selection.select(*(c for c in selection.columns if c != "copies"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
