"""Language of documents and of the stretches of mixed ones: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities (buckets x languages), fitted on a bounded sample of labelled texts and shipped to
the executors once (its size is fixed by ``bits`` and the number of languages). Texts are cut into sentences; all sentences
of a batch are scored together: n-gram hashes are computed with numpy over the code points of the whole batch, the matrix
rows they name are summed per sentence. A Viterbi pass per text with a price for changing the language gives its runs:
a short piece without clear evidence of its own takes its neighbours' language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbarium.llm.pages import is_scan, path_of
from verbarium.plans.runtime import spread

GRAMS = (1, 2, 3, 4)
_SENTENCE = re.compile(r"[^.!?…。]*(?:[.!?…。]+[”»\"’')\]]*(?=\s|$)|[.!?…。]+|$)", re.S)
_LETTERS = re.compile(r"[^\W\d_]+(?:[’'ʼ][^\W\d_]+)*")
_ENDS = re.compile(r"[.!?…。][”»\"’')\]]*\s*$")
_HYPHEN = re.compile(r"(?<=\w)[-­‐¬]\s*\n\s*(?=\w)")

# What a label says when it says nothing, and other notations of the languages of wider communication.
UNDEFINED = ("", "und", "unknown", "xx", "null", "none", "n/a", "mul", "zxx", "mis", "?", "-", "undefined", "undetermined", "multiple")
NOTATIONS = {
    "en": ("eng", "english"), "es": ("spa", "spanish", "español", "castellano", "espanol"), "fr": ("fra", "fre", "french", "français", "francais"),
    "pt": ("por", "portuguese", "português", "portugues"), "id": ("ind", "indonesian", "bahasa indonesia", "in"),
    "ru": ("rus", "russian", "русский"), "ko": ("kor", "korean", "한국어"), "de": ("deu", "ger", "german", "deutsch"),
    "zh": ("zho", "chi", "chinese", "中文"), "ja": ("jpn", "japanese", "日本語"), "ar": ("ara", "arabic", "العربية"), "it": ("ita", "italian", "italiano"),
}


#: The model is broadcast: more languages than fit (4,096 with 16 bits) need fewer ``bits``; a larger model is refused.
MODEL_BYTES = 1 << 30


def sentences(text: str) -> list[str]:
    """The sentences of a text in reading order. Printed lines of a scan are joined first; elsewhere a line ends a sentence.
    Menus, word lists and lines of fewer than six words that end no sentence are left out if anything else is there;
    of a word list only the glosses count then."""
    lines = text.split("\n")
    scan = is_scan(lines)
    if scan:
        paragraphs = [_HYPHEN.sub("", text).replace("\n", " ")]
    else:
        paragraphs = lines
    full, short = [], []
    for p in paragraphs:
        if p.strip() and not scan and path_of(p, "")[0] not in ("prose", "short", "label"):
            glosses = path_of(p, "")[3]
            if _LETTERS.search(p):
                short.append(glosses[0] if glosses else p.strip())
            continue
        for s in _SENTENCE.findall(p):
            words = len(_LETTERS.findall(s))
            if words:
                (full if _ENDS.search(s) and words >= 2 or words >= 6 else short).append(s.strip())
    return full or ([" ".join(short)] if short else [])


def _codes(sentence: str) -> np.ndarray:
    s = " " + " ".join(_LETTERS.findall(sentence.lower())) + " "
    return np.frombuffer(s.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)


def _hashes(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of each window of ``n`` code points."""
    h = np.full(len(codes) - n + 1, 0x9E3779B97F4A7C15 * n & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    """Languages, log probabilities (buckets x languages) and log priors."""

    names: list[str]
    logp: np.ndarray
    prior: np.ndarray
    bits: int

    def score(self, items: list[str], chars: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
        """(log joint probability of each sentence and language, number of n-grams), ``chars`` code points at a time."""
        out, count = np.zeros((len(items), len(self.names))), np.zeros(len(items))
        at = 0
        while at < len(items):
            codes, size, end = [], 0, at
            while end < len(items) and (not codes or size < chars):
                codes.append(_codes(items[end]))
                size += len(codes[-1])
                end += 1
            flat = np.concatenate(codes)
            owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
            for n in GRAMS:
                if len(flat) < n:
                    continue
                for a in range(0, len(flat) - n + 1, 2 * chars):
                    piece = flat[a : a + 2 * chars + n - 1]
                    idx, own = _hashes(piece, n, self.bits), owner[a : a + len(piece)]
                    inside = own[: len(idx)] == own[n - 1 :]
                    idx, own = idx[inside], own[: len(inside)][inside]
                    if len(idx):
                        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                        out[at + own[first]] += np.add.reduceat(self.logp[idx], first, axis=0)
                        count[at + own[first]] += np.diff(np.r_[first, len(own)])
            at = end
        return out + self.prior, count


def fit(samples: DataFrame, lang: str, text: str, per_language: int = 200, bits: int = 16, alpha: float = 0.1) -> Model:
    """The model, fitted on at most ``per_language`` texts of each language, taken in hash order. Null texts and languages
    are left out."""
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    rows = (
        samples.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null").distinct()
        .withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_language).select("lang", "text").collect()
    )
    names = sorted({r["lang"] for r in rows})
    if (len(names) << bits) * 4 > MODEL_BYTES:
        raise ValueError(f"a model of {len(names)} languages and 2**{bits} buckets is over {MODEL_BYTES} bytes: fewer bits are needed")
    counts = np.zeros((1 << bits, max(1, len(names))))
    for r in rows:
        c = _codes(r["text"])
        for n in GRAMS:
            if len(c) >= n:
                np.add.at(counts[:, names.index(r["lang"])], _hashes(c, n, bits), 1)
    logp = np.log((counts + alpha) / (counts.sum(0) + alpha * (1 << bits))).astype(np.float32)
    return Model(names, logp, np.full(max(1, len(names)), -np.log(max(1, len(names)))), bits)


def runs(score: np.ndarray, count: np.ndarray, price: float = 12.0) -> list[tuple[int, int, int, float]]:
    """(first, end, language, confidence) of the longest runs of sentences in one language.

    The four orders of n-grams tell the same thing four times, so the evidence counts a fourth. ``price``: the log
    probability that a change of language costs. Confidence is the mean probability of the language per
    sentence, with the evidence of a sentence scaled down to that of ten independent n-grams (n-grams overlap).
    """
    n, k = score.shape
    score = score / len(GRAMS)
    total, back = score[0].copy(), np.zeros((n, k), dtype=np.int32)
    for t in range(1, n):
        best = int(total.argmax())
        stay = total >= total[best] - price
        back[t] = np.where(stay, np.arange(k), best)
        total = np.where(stay, total, total[best] - price) + score[t]
    y = np.zeros(n, dtype=np.int32)
    y[-1] = int(total.argmax())
    for t in range(n - 1, 0, -1):
        y[t - 1] = back[t, y[t]]
    soft = (score - score.max(1, keepdims=True)) * (10.0 * len(GRAMS) / np.maximum(count, 10.0 * len(GRAMS)))[:, None]
    prob = np.exp(soft) / np.exp(soft).sum(1, keepdims=True)
    edges = [0, *(np.flatnonzero(np.diff(y)) + 1).tolist(), n]
    return [(a, b, int(y[a]), float(prob[a:b, y[a]].mean())) for a, b in zip(edges, edges[1:])]


SEGMENTS = "doc long, seg_pos int, lang string, confidence double, n_sentences int, n_chars long"


def segments(df: DataFrame, key: str, content: str, model: Model, price: float = 12.0) -> DataFrame:
    """One row for each run of sentences in one language (``SEGMENTS``; ``doc`` is the key), numbered in reading order.

    Null texts and texts without a letter have no run. The key is not made unique: repeated rows repeat their runs.
    """
    spark = df.sparkSession
    shipped = spark.sparkContext.broadcast(model)  # 2**bits x languages float32

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shipped.value
        for b in batches:
            items, owner = [], []
            for i, t in enumerate(b["content"]):
                s = sentences(t)
                items += s
                owner += [i] * len(s)
            rows = []
            if items and m.names:
                score, count = m.score(items)
                own = np.array(owner)
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                for a, z in zip(first, [*first[1:], len(own)]):
                    doc = b["doc"].iloc[own[a]]
                    for pos, (f, e, lang, conf) in enumerate(runs(score[a:z], count[a:z], price)):
                        rows.append((doc, pos, m.names[lang], conf, e - f, sum(len(items[a + j]) for j in range(f, e))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    src = df.where(F.col(content).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(content).alias("content"))
    return spread(src).mapInPandas(run, SEGMENTS)


def notation_table(spark: SparkSession, names: DataFrame | None = None) -> DataFrame:
    """(``notation``, ``code``): lower-case notations, each once; fixed ones first, then of ``names`` (``code``, ``name``) the smallest code."""
    fixed = spark.createDataFrame([(x, c, 0) for c, xs in NOTATIONS.items() for x in (c, *xs)], "notation string, code string, r int")
    if names is not None:
        n = names.where("code is not null and name is not null").select("code", F.explode(F.array(F.lower(F.trim("name")), F.lower(F.trim("code")))).alias("notation"))
        fixed = fixed.unionByName(n.select("notation", "code", F.lit(1).alias("r")))
    return fixed.groupBy("notation").agg(F.min(F.struct("r", "code"))["code"].alias("code"))


def label_codes(labels: DataFrame, notations: DataFrame) -> DataFrame:
    """``labels`` (with a column ``label``) and the ``code`` a label means (null: missing or undefined; a label in no known notation stays as
    it is, in lower case). Distinct labels are joined with the notations, whatever their number."""
    low = F.lower(F.trim("label"))
    base = F.nullif(F.regexp_extract(low, r"^([\p{L}]{2,3})[-_][\p{L}\p{N}_-]+$", 1), F.lit(""))
    said = labels.select("label").distinct().withColumns({"low": low, "base": base})
    said = said.join(notations.select(F.col("notation").alias("low"), F.col("code").alias("c1")), "low", "left")
    said = said.join(notations.select(F.col("notation").alias("base"), F.col("code").alias("c2")), "base", "left")
    code = F.when(F.col("low").isNotNull() & ~F.col("low").isin(*UNDEFINED), F.coalesce("c1", "c2", "base", "low"))
    return labels.join(said.select("label", code.alias("code")), "label", "left")


def faulty_labels(df: DataFrame, key: str, content: str, label: str, samples: DataFrame, lang: str, text: str, names: DataFrame | None = None) -> DataFrame:
    """(``key``, ``seg_pos``, ``lang``): all runs of the texts whose label is missing, undefined or not the language of their
    first run, and of those with several runs. Repeated rows of a key count once."""
    seg = segments(df, key, content, fit(samples, lang, text))
    labels = df.select(F.col(key).cast("long").alias("doc"), F.expr(label).alias("label"))
    one = label_codes(labels, notation_table(df.sparkSession, names)).groupBy("doc").agg(F.max("code").alias("code"))
    per = seg.groupBy("doc").agg(F.max("seg_pos").alias("last"), F.array_sort(F.collect_set(F.struct("seg_pos", "lang"))).alias("runs"))
    bad = per.join(one, "doc").where((F.col("last") > 0) | F.col("code").isNull() | (F.col("code") != F.col("runs")[0]["lang"]))
    return bad.select(F.col("doc").alias(key), F.inline("runs"))
