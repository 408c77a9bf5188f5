"""Ranked retrieval: BM25 over fields, fuzzy and prefix clauses, exact vectors, rank fusion, significant terms.

Every operator reads its table in scans without a shuffle of rows: collection statistics are one partial aggregation to a
single row, scores are expressions over array columns, and top-k is ``TakeOrderedAndProject``. Filters come before ranking.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbarium.functions import text as X
from verbarium.plans.runtime import stored, width

K1, B = 1.2, 0.75
#: Field, tokeniser and weight of the clauses of entry search; the best one counts.
ENTRY_FIELDS = (
    ("headword_native", "exact", 3.0), ("headword_native", "tokens", 2.0), ("headword_native", "prefix", 1.5), ("headword_romanized", "exact", 3.0),
    ("headword_romanized", "tokens", 2.0), ("headword_romanized", "roman", 2.5), ("ipa", "ipa", 1.5), ("cultural_context", "tokens", 1.0),
)


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _count(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == term))


def bm25_many(df: DataFrame, clauses: list[tuple[str, Column, list[str]]]) -> DataFrame:
    """``df`` with one BM25 score column for each clause (name, array of words, query words): one statistics scan for all
    clauses together, one scoring scan. No hit scores 0; a null array is empty."""
    clauses = [(n, w, list(dict.fromkeys(q))) for n, w, q in clauses]
    empty = F.array().cast("array<string>")
    base = df.withColumns({f"__w{i}": F.coalesce(w, empty) for i, (_, w, _) in enumerate(clauses)})
    base = base.withColumns({f"__t{i}": F.struct(F.size(f"__w{i}").alias("len"), *(_count(f"__w{i}", t).alias(f"q{k}") for k, t in enumerate(q))) for i, (_, _, q) in enumerate(clauses)})
    base = base.drop(*(f"__w{i}" for i in range(len(clauses))))
    stats = base.agg(
        F.count("*").alias("__n"),
        *(F.avg(f"__t{i}.len").alias(f"__a{i}") for i in range(len(clauses))),
        *(F.count_if(F.col(f"__t{i}.q{k}") > 0).alias(f"__d{i}_{k}") for i, (_, _, q) in enumerate(clauses) for k in range(len(q))),
    )
    out = base.crossJoin(F.broadcast(stats))  # one row
    for i, (name, _, q) in enumerate(clauses):
        norm = K1 * (1 - B + B * F.coalesce(F.try_divide(F.col(f"__t{i}.len"), F.col(f"__a{i}")), F.lit(1.0)))
        score = F.lit(0.0)
        for k in range(len(q)):
            tf = F.col(f"__t{i}.q{k}")
            score = score + idf(F.col("__n"), F.col(f"__d{i}_{k}")) * (tf * (K1 + 1)) / (tf + norm)
        out = out.withColumn(name, score)
    return out.drop(*(c for c in out.columns if c.startswith("__")))


def bm25(df: DataFrame, key: str, words: Column, query: list[str], out: str = "score") -> DataFrame:
    """``df`` with the BM25 score of an array of words for the query words."""
    return bm25_many(df, [(out, words, query)])


def top(df: DataFrame, score: Column, key: str, k: int) -> DataFrame:
    return df.orderBy(score.desc(), F.col(key).asc()).limit(k)


def auto_distance(term: str) -> int:
    """Edits allowed for a term of this length."""
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def fuzzy(words: Column, term: str, most: int | None = None) -> Column:
    """Whether some word is within the edits allowed; lengths are compared first."""
    d = auto_distance(term) if most is None else most
    return F.coalesce(F.exists(words, lambda w: (F.abs(F.length(w) - len(term)) <= d) & (F.levenshtein(w, F.lit(term), d) >= 0)), F.lit(False))


def field_words(field: str, how: str) -> Column:
    c = F.col(field)
    return {"exact": lambda: F.array(c), "tokens": lambda: X.tokens(c), "prefix": lambda: X.edge_ngrams(X.tokens(c)), "roman": lambda: X.roman_tokens(c), "ipa": lambda: F.array(X.ipa_key(c))}[how]()


def _clause(i: int, clause: tuple[str, str, float], query: str) -> tuple[str, Column, list[str]]:
    field, how, _ = clause
    q = [query] if how == "exact" else ["".join(c for c in query.lower() if c not in X.IPA_MARKS)] if how == "ipa" else query.lower().split()
    return f"s{i}_{how}_score", field_words(field, how), q


def best_fields(df: DataFrame, key: str, query: str, clauses=ENTRY_FIELDS) -> DataFrame:
    """``best``: the greatest weighted BM25 over the clauses, each with its own tokeniser."""
    made = [_clause(i, c, query) for i, c in enumerate(clauses)]
    out = bm25_many(df, made)
    return out.withColumn("best", F.greatest(*(F.col(n) * c[2] for (n, _, _), c in zip(made, clauses)))).drop(*(n for n, _, _ in made))


def entry_search(df: DataFrame, key: str, query: str) -> DataFrame:
    """The full clause sum of entry search: best field, exact romanised form, fuzzy romanised form, nested definitions and
    examples (all texts of an entry taken together); rows without a hit are left out."""
    words = query.lower().split()
    nested = lambda c, f: F.flatten(F.transform(c, lambda x: F.coalesce(X.tokens(x[f]), F.array().cast("array<string>"))))
    made = [_clause(i, c, query) for i, c in enumerate(ENTRY_FIELDS)]
    rest = [
        ("rom_score", X.roman_tokens(F.col("headword_romanized")), words, 3.5), ("def_score", nested("definitions", "text"), words, 2.0),
        ("target_score", nested("example_sentences", "target"), words, 1.5), ("contact_score", nested("example_sentences", "contact"), words, 1.5),
        ("english_score", nested("example_sentences", "english"), words, 1.0),
    ]
    out = bm25_many(df, made + [r[:3] for r in rest])
    total = F.greatest(*(F.col(n) * c[2] for (n, _, _), c in zip(made, ENTRY_FIELDS))) + 3 * fuzzy(X.tokens(F.col("headword_romanized")), query.lower(), 2).cast("double")
    for name, _, _, weight in rest:
        total = total + weight * F.col(name)
    return out.withColumn("score", total).where("score > 0").drop(*(n for n, _, _ in made), *(r[0] for r in rest))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a norm is 0."""
    d = lambda x: x.cast("double")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + d(x) * d(x)))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def knn(df: DataFrame, key: str, vector: str, query: list[float] | Column, k: int) -> DataFrame:
    """The k rows nearest to one query vector, exactly: one scan, top-k per task."""
    q = query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query))
    scored = df.where(F.col(vector).isNotNull()).withColumn("similarity", F.round(cosine(F.col(vector), q), 9))
    return top(scored, F.col("similarity"), key, k)


def rank_fusion(lists: list[DataFrame], key: str, window: int = 50, constant: int = 20) -> DataFrame:
    """Reciprocal rank fusion of ranked lists with columns ``key`` and ``score``; ``rrf`` sums 1 / (constant + rank)."""
    parts = []
    for d in lists:
        cut = d.select(key, "score").orderBy(F.col("score").desc(), key).limit(window)
        parts.append(cut.withColumn("r", F.row_number().over(Window.orderBy(F.col("score").desc(), key))))  # at most ``window`` rows
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum(1.0 / (constant + F.col("r"))).alias("rrf"))


def significant_terms(df: DataFrame, term: Column, foreground: Column, least: int = 2) -> DataFrame:
    """(``term``, ``fg``, ``bg``, ``score``): terms more frequent among the foreground rows than in all (share difference
    times share ratio), one aggregation over the exploded terms."""
    x = df.select(F.coalesce(foreground, F.lit(False)).alias("f"), term.alias("t"))
    if x.schema["t"].dataType.typeName() == "array":
        x = x.select("f", F.explode(F.array_distinct("t")).alias("t"))
    x = x.where("t is not null")
    n = df.agg(F.count("*").alias("n"), F.count_if(foreground).alias("nf"))
    g = x.groupBy(F.col("t").alias("term")).agg(F.count_if("f").alias("fg"), F.count("*").alias("bg")).where(F.col("fg") >= least)
    f, b = F.col("fg") / F.col("nf"), F.col("bg") / F.col("n")
    return g.crossJoin(F.broadcast(n)).withColumn("score", (f - b) * (f / b)).where("score > 0").drop("n", "nf")  # one row


def hybrid(df: DataFrame, key: str, query: str, vector: str, query_vector, k: int = 10, window: int = 50, keep: Column | None = None) -> DataFrame:
    """Text and vector lists over the same filtered rows, fused; ties by key."""
    src = df if keep is None else df.where(keep)
    text = entry_search(src, key, query).select(key, "score")
    vec = knn(src.select(key, vector), key, vector, query_vector, window).select(key, F.col("similarity").alias("score"))
    return top(rank_fusion([text, vec], key, window), F.round("rrf", 12), key, k)


def rerank(best: DataFrame, key: str, scorer: Column, window: int = 50, k: int = 10) -> DataFrame:
    """The first ``window`` rows of a ranked list (column ``score``), reordered by ``scorer`` (any expression, a Pandas UDF of a model too); where
    it is null or equal the list's own order stays. The first ``k`` are kept."""
    head = best.orderBy(F.col("score").desc(), key).limit(window).withColumn("rerank_score", scorer)
    return head.orderBy(F.col("rerank_score").desc_nulls_last(), F.col("score").desc(), key).limit(k)


def search(df: DataFrame, key: str, query: str, vector: str, query_vector, cluster: str, k: int = 12, window: int = 50, scorer: Column | None = None, keep: Column | None = None) -> DataFrame:
    """(``key``, ``kind``, ``pos``): the whole search: text and vector lists over the filtered rows, fused; the window reranked (by the fused score
    if no ``scorer`` is given); a page shorter than ``k`` filled with other rows of the hits' clusters. ``kind``: hit or cluster."""
    src = df if keep is None else df.where(keep)
    fused = hybrid(src, key, query, vector, query_vector, window, window).withColumnRenamed("rrf", "score")
    wide = fused if scorer is None else fused.join(src, key)
    hits = rerank(wide, key, F.col("score") if scorer is None else scorer, window, k).select(key, "rerank_score", "score")
    hits = stored(hits, "search-hits")  # at most k rows
    own = src.join(F.broadcast(hits.select(key)), key, "left_semi").select(cluster).where(F.col(cluster).isNotNull()).distinct()
    more = src.select(key, cluster).join(F.broadcast(own), cluster, "left_semi").join(F.broadcast(hits.select(key)), key, "left_anti").orderBy(key).limit(k).select(key)
    both = hits.select(key, F.lit("hit").alias("kind"), F.col("rerank_score").alias("a"), F.col("score").alias("b")).unionByName(more.select(key, F.lit("cluster").alias("kind"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b")))
    w = Window.orderBy(F.col("kind").desc(), F.col("a").desc_nulls_last(), F.col("b").desc_nulls_last(), key)  # at most 2k rows
    return both.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select(key, "kind", "pos")


def round_score(c: str) -> Column:
    return F.round(F.col(c), 6)




def _deletions(word: Column, edits: int) -> Column:
    """The word and all forms with up to ``edits`` characters taken out."""
    out = F.array(word)
    for _ in range(edits):
        out = F.array_distinct(F.flatten(F.transform(out, lambda w: F.concat(F.array(w), F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))))
    return out


def _own_halves(word: Column, edits: int) -> Column:
    """The keys of a word by its halves: side, length of the half, and the half with up to ``edits // 2`` characters taken out."""
    first = F.floor(F.length(word) / 2).cast("int")
    last = F.length(word) - first
    key = lambda side, n, half: F.transform(_deletions(half, edits // 2), lambda f: F.xxhash64(F.lit(side), n, f))
    return F.concat(key("first", first, F.substring(word, F.lit(1), first)), key("last", last, F.substring(word, first + 1, last)))


def _met_halves(word: Column, edits: int, least: int) -> Column:
    """The keys under which a word is met by all words of ``least`` letters and more within ``edits`` edits: for each length a half of those may
    have, the beginnings (ends) up to ``edits // 2`` longer or shorter, with as many characters taken out."""
    m, n = edits // 2, F.length(word)
    lengths = F.sequence(F.greatest(n - edits, F.lit(least)), n + edits)

    def keys(side: str, halves: Column, part) -> Column:
        def of(h: Column) -> Column:
            forms = F.flatten(F.transform(F.sequence(F.greatest(h - m, F.lit(0)), h + m), lambda q: _deletions(part(F.least(q, n)), m)))
            return F.transform(F.filter(F.array_distinct(forms), lambda f: F.length(f).between(h - m, h)), lambda f: F.xxhash64(F.lit(side), h, f))

        return F.flatten(F.transform(F.array_distinct(halves), of))

    first = keys("first", F.transform(lengths, lambda k: F.floor(k / 2).cast("int")), lambda q: F.substring(word, F.lit(1), q))
    last = keys("last", F.transform(lengths, lambda k: k - F.floor(k / 2).cast("int")), lambda q: F.substring(word, n - q + 1, q))
    return F.concat(first, last)


def fuzzy_join(left: DataFrame, right: DataFrame, word: str, edits: int | tuple[tuple[int, int | None, int], ...] = 1, scope: str | None = None) -> DataFrame:
    """Pairs of words within ``edits`` edits, exactly, by a hash join on forms that close words share. ``edits`` is a number, or bands (shortest,
    longest, edits) by the length of the left word. Columns of the sides get the suffixes ``_l`` and ``_r``; words are made distinct.

    Up to two edits, and for short words, the forms are the words with up to ``edits`` characters taken out (words of up to ``edits`` letters all share
    the empty form). From three edits on these are hundreds a word; there the left word is halved: one half meets the beginning or end of any word
    within ``edits`` edits by half of them at most. The form tables are many times larger than Spark takes them for, so neither is broadcast.
    """
    if isinstance(edits, int):
        edits = ((0, None, edits),) if edits < 3 else ((0, 2 * edits, edits), (2 * edits + 1, None, edits))
    least = lambda w, lo: F.length(w) >= lo if lo > 0 else F.lit(True)
    within = lambda w, lo, hi: least(w, lo) if hi is None else least(w, lo) & (F.length(w) <= hi)
    none = F.array().cast("array<bigint>")

    def forms(w: str, left_side: bool) -> Column:
        out = []
        for i, (lo, hi, e) in enumerate(edits):
            whole = F.transform(_deletions(F.col(w), e), lambda f: F.xxhash64(F.lit(i), f))
            made = whole if e < 3 or lo <= 2 * e else _own_halves(F.col(w), e) if left_side else _met_halves(F.col(w), e, lo)
            taken = within(w, lo, hi) if left_side else within(w, lo - e, None if hi is None else hi + e)
            out.append(F.when(taken, made).otherwise(none))
        return F.concat(*out) if len(out) > 1 else out[0]

    keys = [word] + ([scope] if scope else [])
    parts = width(left.sparkSession)

    def side(d: DataFrame, s: str) -> DataFrame:
        words = d.select(*(F.col(k).alias(k + s) for k in keys)).where(F.col(word + s).isNotNull()).distinct()
        # few bytes become many forms: dealt to all cores (by a hash, as the optimizer drops a second partitioning by the word itself)
        return words.repartition(parts, F.xxhash64(word + s)).withColumn("form" + s, F.explode(forms(word + s, s != "_r")))

    if left is right and [x[:2] for x in edits] == [(0, None)]:
        own = side(left, "")  # one table of forms, shuffled once
        a, b = (own.select(*(F.col(c).alias(c + s) for c in own.columns)) for s in ("_l", "_r"))
    else:
        a, b = side(left, "_l"), side(right, "_r")
    on = (F.col("form_l") == F.col("form_r")) & ((F.col(scope + "_l") == F.col(scope + "_r")) if scope else F.lit(True))
    x = a.join(b.hint("merge"), on).drop("form_l", "form_r").distinct()
    close = [within(word + "_l", lo, hi) & (F.levenshtein(word + "_l", word + "_r", e) >= 0) for lo, hi, e in edits]
    return x.where(reduce(or_, close))
