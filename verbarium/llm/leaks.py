"""Evaluation texts leaking into training text: a distributed positional inverted index and phrase intersection.

The index holds a posting (term, document, position) for every token of every whole document. For a query the postings
are pruned to the terms of the test items (a semi join; broadcast only when counted small). Every window of ``words``
consecutive item terms is anchored on its rarest term, so any leak of that length meets an anchor; the posting list of
the second-rarest term, shifted by its offset, is intersected with it; the surviving alignments (document, item, shift)
are verified against all item postings of the document, and runs of consecutive hits are measured exactly.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbarium.plans.runtime import small, stored

WORD = r"[\p{L}\p{N}\p{M}]+"
#: Characters without width, and those whose compatibility form may differ.
INVISIBLE = r"[\u00AD\u200B-\u200D\u2060\uFEFF]"
UNSTABLE = r"[\p{M}\u1100-\u11FF\u2100-\u218F\u3000\uFB00-\uFB06\uFF01-\uFFEE]"


def terms(text: Column) -> Column:
    """Lower-case words of a text in order; punctuation, markup and layout separate words and are dropped."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, INVISIBLE, "")), F.lit(WORD), 0)


def _normalised(df: DataFrame, text: str) -> DataFrame:
    """Compatibility-composed text. Only rows that hold an unstable character leave the JVM."""

    def nfkc(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{text: [unicodedata.normalize("NFKC", t) for t in b[text]]})

    odd = F.coalesce(F.col(text).rlike(UNSTABLE), F.lit(False))
    return df.where(~odd).unionByName(df.where(odd).mapInPandas(nfkc, df.schema))


def postings(docs: DataFrame, key: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """The index: one row (``term``, ``doc``, ``pos``) per token, from whole texts; ``only``: a DataFrame of terms kept."""
    src = _normalised(docs.select(F.col(key).alias("doc"), F.col(text).alias("t")), "t")
    out = src.select("doc", F.posexplode(terms(F.col("t"))).alias("pos", "term"))
    return out if only is None else out.join(small(only), "term", "left_semi")


def alignments(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, words: int = 12, near: float | None = None, slack: int = 2) -> DataFrame:
    """(``item``, ``doc``, ``shift``, ``longest``, ``covered``, ``length``): every alignment of an item with a document that
    has a run of at least ``words`` equal consecutive words; ``covered`` counts all item words that stand at that shift. With ``near``
    also those without such a run that hold at least that share of the item's words within ``slack`` places of the shift (words put in
    or left out move the rest): they are anchored on the runs of ``ceil(near / (1 - near)) - 1`` words that such a copy must have."""
    least = words if near is None else min(words, max(1, math.ceil(near / (1 - near) - 1e-9) - 1))
    src = _normalised(items.select(F.col(item_key).alias("item"), F.col(item_text).alias("t")).distinct(), "t")
    it = stored(src.select("item", F.posexplode(terms(F.col("t"))).alias("at", "term")), "p8-items")
    index = stored(postings(docs, key, text, it.select("term").distinct()), "p8-postings")
    seen = index.groupBy("term").agg(F.count("*").alias("df"))
    ranked = it.join(small(seen), "term", "left").fillna(0, ["df"])

    order = F.struct("df", "term", "at")
    by_item = Window.partitionBy("item").orderBy("at")
    span = by_item.rowsBetween(0, least - 1)
    win = ranked.select(
        "item",
        F.size(F.collect_list("at").over(span)).alias("n"),
        F.slice(F.array_sort(F.collect_list(order).over(span)), 1, 2).alias("rare"),
    ).where((F.col("n") == least) & (F.col("rare")[0]["df"] > 0))
    second = F.get(F.col("rare"), F.lit(1 if least > 1 else 0))
    anchors = win.select(
        "item", F.col("rare")[0]["term"].alias("term"), F.col("rare")[0]["at"].alias("at"), second["term"].alias("term2"), second["at"].alias("at2")
    ).distinct()

    first = index.join(small(anchors), "term").select("item", "doc", (F.col("pos") - F.col("at")).alias("shift"), "term2", (F.col("pos") - F.col("at") + F.col("at2")).alias("pos2"))
    first = stored(first, "p8-first")
    other = index.select("doc", F.col("term").alias("term2"), F.col("pos").alias("pos2"))
    met = other.join(small(first.select("doc", "term2", "pos2").distinct()), ["doc", "term2", "pos2"], "left_semi").distinct()
    candidates = stored(first.join(small(met), ["doc", "term2", "pos2"], "left_semi").select("item", "doc", "shift").distinct(), "p8-candidates")

    reach = 0 if near is None else slack
    placed = index.join(small(candidates), "doc").join(small(it), ["item", "term"]).withColumn("off", F.abs(F.col("pos") - F.col("shift") - F.col("at")))
    hits = placed.where(F.col("off") <= reach).groupBy("item", "doc", "shift").agg(
        F.array_sort(F.collect_set(F.when(F.col("off") == 0, F.col("at")))).alias("ats"), F.count_distinct("at").alias("covered")
    )
    longest = F.expr("aggregate(ats, struct(0 as run, -9 as last, 0 as best), (a, x) -> struct(if(x = a.last + 1, a.run + 1, 1) as run, x as last, greatest(a.best, if(x = a.last + 1, a.run + 1, 1)) as best), a -> a.best)")
    size = it.groupBy("item").agg(F.max("at").alias("length"))
    return (
        hits.select("item", "doc", "shift", longest.alias("longest"), F.col("covered").cast("int").alias("covered"))
        .join(small(size), "item")
        .withColumn("length", F.col("length") + 1)
        .where((F.col("longest") >= words) | ((F.col("length") >= words) & (F.col("covered") >= near * F.col("length")) if near is not None else F.lit(False)))
    )


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, words: int = 12) -> DataFrame:
    """(``item_key``, ``key``) once for every document that holds ``words`` or more consecutive words of the item.

    Null and empty texts on either side match nothing, items shorter than ``words`` neither; repeated rows count once;
    other columns are not read.
    """
    found = alignments(docs, key, text, items, item_key, item_text, words)
    return found.select(F.col("item").alias(item_key), F.col("doc").alias(key)).distinct()


def report(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, words: int = 12, near: float = 0.8) -> DataFrame:
    """Best alignment of each leaked (item, document): ``match`` is ``exact`` (the whole item), ``proximity`` (at least the
    share ``near`` of its words in place, with or without a run of ``words``) or ``phrase``; with the longest run and the words covered."""
    a = alignments(docs, key, text, items, item_key, item_text, words, near)
    best = a.groupBy("item", "doc").agg(F.max(F.struct("covered", "longest", "length")).alias("b"))
    match = F.when(F.col("b.longest") == F.col("b.length"), "exact").when(F.col("b.covered") >= near * F.col("b.length"), "proximity").otherwise("phrase")
    return best.select(F.col("item").alias(item_key), F.col("doc").alias(key), match.alias("match"), "b.longest", "b.covered", "b.length")
