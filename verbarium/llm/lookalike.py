"""One form for text that looks the same: width, invisible characters, spaces, composition, look-alike letters.

A character is *stable* when it is its own form and never composes with the one before it (quick-check "yes" for
compatibility composition, and no look-alike). A text is scanned once for unstable segments; each is taken with its
boundary context (the starter before it and all that can compose after it, across invisible characters), brought to its form and
spliced between the unchanged stretches. A text without such a segment is returned as it is.

Two forms are made. The *canonical text* stays readable: in it a letter is exchanged for its look-alike only where it stands in a word
of another script, so ``Москва`` stays and ``Mосква`` becomes it. The *key*, by which texts are compared, folds all look-alikes to
one letter.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbarium.plans.runtime import small, stored

# Letters that look like a Latin letter (a public notion of confusables, reduced to near-identical glyphs).
LOOKALIKE = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ӏ": "l",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ѵ": "v", "ҽ": "e", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I",
    "Ј": "J", "Ѕ": "S", "Ү": "Y", "У": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӏ": "I", "Ѵ": "V",
    # Greek
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "χ": "x", "υ": "u", "ι": "i", "γ": "y", "κ": "k", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X",
    # Armenian
    "օ": "o", "հ": "h", "ս": "u", "ց": "g", "զ": "q", "յ": "j", "ք": "p", "Տ": "S", "Օ": "O", "Լ": "L",
    # Latin outside the alphabet
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʋ": "v", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
    # apostrophes and primes
    "'": "ʼ", "’": "ʼ", "‘": "ʼ", "ʹ": "ʼ", "ʻ": "ʼ", "ʾ": "ʼ", "ˈ": "ʼ", "′": "ʼ", "՚": "ʼ", "`": "ʼ", "´": "ʼ", "ꞌ": "ʼ", "‛": "ʼ",
    # dashes
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
#: Code points without any glyph (besides the format characters, category Cf).
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x180F), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def _invisible(c: str) -> bool:
    return ord(c) in INVISIBLE or unicodedata.category(c) in ("Cf", "Cc") and not c.isspace()


@lru_cache(1)
def _scanner() -> re.Pattern:
    """The pattern of unstable segments, from the properties of every code point."""
    odd, marks, gone = [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0x3400 <= cp <= 0x9FFF or 0x20000 <= cp <= 0x2F7FF or 0xD800 <= cp <= 0xF8FF or cp > 0xE01EF:
            continue
        c = chr(cp)
        if unicodedata.combining(c) or 0x1161 <= cp <= 0x1175 or 0x11A8 <= cp <= 0x11C2:
            marks.append(cp)
        if _invisible(c):
            gone.append(cp)
        if c in LOOKALIKE or _invisible(c) or c.isspace() or unicodedata.normalize("NFKC", c) != c or unicodedata.normalize("NFKD", c)[0] in LOOKALIKE:
            odd.append(cp)
    odd += [ord(c) for c in LOOKALIKE if c.isascii()] + [c for c in range(32) if c not in (9, 10, 13)] + [127]

    def ranges(cps: list[int]) -> str:
        out, start = [], None
        for a, b in zip(cps, cps[1:] + [None]):
            start = a if start is None else start
            if b != a + 1:
                out.append(f"{re.escape(chr(start))}-{re.escape(chr(a))}" if a > start else re.escape(chr(start)))
                start = None
        return "".join(out)

    gone += [c for c in range(32) if c not in (9, 10, 13)] + [127]
    u, m = ranges(sorted({*odd, *marks})), ranges(sorted({*marks, *gone}))  # a mark may follow its base across invisible characters
    return re.compile(f"[^{u}]?[{m}][{u}]*|[{u}]+", re.S)


_LETTERS = {c: x for c, x in LOOKALIKE.items() if c.isalpha() and x.isascii() and x.isalpha()}
_SIGNS = {c: x for c, x in LOOKALIKE.items() if c not in _LETTERS}
_WORD = re.compile(r"[^\W\d_]+")


def _script(c: str) -> str:
    return "LATIN" if c.isascii() else unicodedata.name(c, "?").split(" ")[0]


@lru_cache(None)
def _twins(script: str) -> dict[str, str]:
    """Latin letter -> its look-alike in ``script``; of several the first."""
    out: dict[str, str] = {}
    for c, x in _LETTERS.items():
        if _script(c) == script:
            out.setdefault(x, c)
    return out


def _one_script(m: re.Match) -> str:
    """A word of mixed scripts in the script, the commonest first, to which look-alikes bring all of it; else as it is."""
    word = m.group()
    if word.isascii():
        return word
    held = [_script(c) for c in word]
    if len(set(held)) < 2:
        return word
    for main in sorted(set(held), key=lambda s: (-held.count(s), s == "LATIN", s)):
        back = _twins(main)
        out = [c if s == main else _LETTERS.get(c, c) if main == "LATIN" else back.get(_LETTERS.get(c, c), c) for c, s in zip(word, held)]
        if all(_script(x) == main for x in out):
            return "".join(out)
    return word


def _form(segment: str, fold: dict[str, str]) -> str:
    s = unicodedata.normalize("NFKD", segment)
    s = "".join(fold.get(c, c) for c in s if not _invisible(c))
    return unicodedata.normalize("NFKC", s)


def _spliced(text: str, fold: dict[str, str]) -> str:
    scan = _scanner()
    if scan.search(text):
        out, at = [], 0
        for m in scan.finditer(text):
            if m.start() < at:
                continue
            a, b = m.span()
            if a and a > at and unicodedata.combining(text[a]):
                a -= 1
            out.append(text[at:a])
            out.append(_form(text[a:b], fold))
            at = b
        out.append(text[at:])
        text = "".join(out)
    return " ".join(text.split())


def look_key(text: str | None) -> str | None:
    """The key of a text, equal for all texts that look the same: null stays null, blank gives ``''``."""
    return None if text is None else _spliced(text, LOOKALIKE)


def canonical(text: str | None) -> str | None:
    """The one readable form of a text: null stays null, blank gives ``''``; spaces at the ends go, any run of spaces is one."""
    if text is None:
        return None
    text = _spliced(text, _SIGNS)
    return text if text.isascii() else _WORD.sub(_one_script, text)


@F.pandas_udf(T.StringType())
def canonical_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([canonical(t) for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def key_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([look_key(t) for t in texts], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def canonicals_udf(lists: pd.Series) -> pd.Series:
    return pd.Series([None if ts is None else [canonical(t) for t in ts] for ts in lists], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def keys_udf(lists: pd.Series) -> pd.Series:
    return pd.Series([None if ts is None else [look_key(t) for t in ts] for ts in lists], dtype=object)


def canonicalise(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with, for each text column named, its canonical text in the given new column and its key in ``<new>_key``; for an array of
    texts both are arrays with the same places. A new name that is taken fails."""
    array = {old: df.schema[old].dataType.typeName() == "array" for old in columns}
    made = {new: (canonicals_udf if array[old] else canonical_udf)(F.col(old)) for old, new in columns.items()}
    made |= {f"{new}_key": (keys_udf if array[old] else key_udf)(F.col(old)) for old, new in columns.items()}
    if taken := set(made) & set(df.columns):
        raise ValueError(f"columns exist: {sorted(taken)}")
    return df.withColumns(made)


def values(df: DataFrame, key: str, scope: str, fields: dict[str, str]) -> DataFrame:
    """(``field``, ``scope``, ``key``, ``raw``) of every non-null value; a field's expression gives one text or an array."""
    parts = []
    for name, expr in fields.items():
        v = df.select(F.lit(name).alias("field"), F.col(scope).alias("scope"), F.col(key).alias("key"), F.expr(expr).alias("v"))
        parts.append(v.select("field", "scope", "key", (F.explode("v") if v.schema["v"].dataType.typeName() == "array" else F.col("v")).alias("raw")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("raw").isNotNull())


def keyed_values(df: DataFrame, key: str, scope: str, fields: dict[str, str]) -> DataFrame:
    """(``field``, ``scope``, ``key``, ``raw``, ``form``, ``g``) of every value that is not blank; ``g`` numbers the class."""

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["form"] = [look_key(t) for t in b["raw"]]
            yield b[b["form"] != ""]

    v = values(df, key, scope, fields).where(F.col("scope").isNotNull())
    v = v.mapInPandas(forms, "field string, scope string, key long, raw string, form string")
    return stored(v.withColumn("g", F.xxhash64("field", "scope", "form")), "p3-values")


def same_look_classes(df: DataFrame, key: str, scope: str, fields: dict[str, str]) -> DataFrame:
    """(``field``, ``key``, ``class``, ``links``): every row that has a value with a look-alike, with its class (rows of one scope whose
    values look the same) and its number of links: rows of the class that spell it otherwise. Counts only, no pairs are made."""
    v = keyed_values(df, key, scope, fields)
    per = v.groupBy("g", "raw").agg(F.count_distinct("key").alias("same"))
    total = v.groupBy("g").agg(F.count_distinct("key").alias("rows"), F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("g", "rows")
    own = v.join(total, "g").join(per, ["g", "raw"]).groupBy("field", "key", "g").agg(F.max(F.greatest(F.col("rows") - F.col("same"), F.lit(1))).alias("links"))
    return own.select("field", F.col("key").alias(key), F.col("g").alias("class"), "links")


def same_look_pairs(df: DataFrame, key: str, scope: str, fields: dict[str, str], group_rows: int = 5000) -> DataFrame:
    """(``field``, ``a``, ``b``), a < b: two keys of one scope with values of equal form and different characters.

    Only forms with two or more spellings are paired; spellings are compared by equi-join on the form. A form with more
    than ``group_rows`` rows is dealt to several tasks (one side salted, the other repeated), so no group meets in one
    task. Rows of null scope pair with none; blank values are no case; repeated rows and values give each pair once.
    """

    v = keyed_values(df, key, scope, fields)
    groups = (
        v.select("g", F.xxhash64("raw").alias("r"))
        .groupBy("g")
        .agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"))
        .where("lo <> hi")
        .select("g", F.ceil(F.col("n") / group_rows).cast("int").alias("parts"))
    )
    kept = stored(v.join(small(groups), "g").distinct(), "p3-kept")
    a = kept.withColumn("part", F.pmod(F.xxhash64("key", "raw"), F.col("parts")).cast("int"))
    b = kept.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    on = ["g", "part", "field", "scope", "form"]
    pairs = a.select(*on, F.col("key").alias("a"), F.col("raw").alias("raw_a")).join(b.select(*on, F.col("key").alias("b"), F.col("raw").alias("raw_b")), on)
    return pairs.where("a < b and raw_a <> raw_b").select("field", "a", "b").distinct()
