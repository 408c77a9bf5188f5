"""Text analysis as column expressions: tokenisers, folding, n-grams, cleaning, chunking."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}\p{M}]+"

# Romanisation letters and what they are searched as (an empty value drops the character).
ROMAN_ONE = {
    "ŏ": "o", "ǒ": "o", "ō": "o", "ö": "o", "ø": "o", "ŭ": "u", "ǔ": "u", "ū": "u", "ü": "u", "ă": "a", "ǎ": "a", "ā": "a", "ä": "a",
    "ĕ": "e", "ě": "e", "ē": "e", "ĭ": "i", "ǐ": "i", "ī": "i", "ə": "a", "ɛ": "e", "ɔ": "o", "ɨ": "i", "ʉ": "u", "ɸ": "f", "β": "v",
    "ɾ": "r", "ɹ": "r", "ñ": "n", "ʔ": "", "ʼ": "", "ʻ": "", "ˀ": "", "ː": "", "ˑ": "", "́": "", "̀": "", "̂": "",
    "̌": "", "̄": "",
}
ROMAN_TWO = {"ŋ": "ng", "ɲ": "ny", "ɟ": "dy", "ɣ": "gh", "ʃ": "sh", "ʒ": "zh", "θ": "th", "ð": "dh", "ɬ": "lh"}
IPA_MARKS = "/[]ˈˌːˑ.‿"


def tokens(c: Column) -> Column:
    """Lower-case words, no stop words; null for null."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


@lru_cache(1)
def _fold_table() -> tuple[str, str]:
    """Accented Latin letters and the ASCII letter they are built on, by the decomposition rule."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(cp))[0]
        if base.isascii() and base.isalpha() and base != chr(cp):
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


def ascii_fold(c: Column) -> Column:
    """Accents off: precomposed letters by table, combining marks dropped, the few two-letter ligatures spelled out."""
    src, dst = _fold_table()
    out = F.translate(F.regexp_replace(c, r"[̀-ͯ]", ""), src, dst)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("ł", "l"), ("đ", "d"), ("þ", "th"), ("ı", "i"), ("ħ", "h")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def romanize(c: Column) -> Column:
    """The search form of a romanised text, before it is cut into tokens."""
    out = c
    for a, b in ROMAN_TWO.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    keep = {k: v for k, v in ROMAN_ONE.items() if v}
    drop = [k for k, v in ROMAN_ONE.items() if not v]
    out = F.translate(out, "".join([*keep, *drop]), "".join(keep.values()))
    return ascii_fold(F.lower(out))


def roman_tokens(c: Column) -> Column:
    return F.regexp_extract_all(romanize(c), F.lit(WORD), F.lit(0))


def edge_ngrams(words: Column, least: int = 2, most: int = 15) -> Column:
    """All prefixes of ``least`` to ``most`` characters of each word; a shorter word has none."""
    return F.flatten(F.transform(words, lambda w: F.when(F.length(w) >= least, F.transform(F.sequence(F.lit(least), F.least(F.lit(most), F.length(w))), lambda n: F.substring(w, F.lit(1), n))).otherwise(F.array().cast("array<string>"))))


def ipa_key(c: Column) -> Column:
    """The whole transcription as one key without its notation marks."""
    return F.lower(F.translate(c, IPA_MARKS, ""))


def words_of_definition(c: Column) -> Column:
    """Distinct ASCII and Hangul words of a definition."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9가-힣\s]", ""), r"\s+"), lambda w: w != ""))


# Phrases of consent banners, newsletters and page furniture; # stands for a number.
PHRASES = (
    "accept cookies", "accept all cookies", "cookie policy", "cookie settings", "cookie preferences", "we use cookies", "manage consent",
    "newsletter signup", "newsletter sign up", "subscribe to newsletter", "subscribe to our newsletter", "share on facebook", "share on twitter",
    "share on linkedin", "share on email", "share via facebook", "share via twitter", "share via linkedin", "share via email", "follow us on",
    "skip to content", "skip to main content", "back to top", "loading...", "page # of #", "all rights reserved", "copyright #", "terms of service",
    "terms of use", "privacy policy",
)


def line_class(line: Column) -> Column:
    """What a line of a page is: ``blank``, ``address`` (nothing but a URL), ``stub`` (up to 20 ASCII characters in up to three words
    without punctuation, as in menus) or ``text``."""
    t = F.regexp_replace(line, r"^\s+|\s+$", "")
    few = F.size(F.split(t, r"\s+")) <= 3
    return F.when(t == "", "blank").when(t.rlike(r"^https?://\S+$"), "address").when((F.length(line) <= 20) & few & t.rlike(r"^[\x00-\x7F&&[^.!?;:,]]+$"), "stub").otherwise("text")


def clean_page(c: Column, phrases: tuple[str, ...] = PHRASES) -> Column:
    """Page text without the phrases, without lines that are addresses or stubs; runs of blanks and of empty lines reduced, ends
    trimmed."""
    longest_first = sorted(phrases, key=len, reverse=True)
    found = "|".join(r"\s+".join(r"\d+" if w == "#" else re.escape(w) for w in p.split()) for p in longest_first)
    lines = F.transform(F.split(c, "\n", -1), lambda x: F.regexp_replace(F.regexp_replace(x, f"(?i)(?:{found})", ""), r"[ \t]{2,}", " "))
    body = F.array_join(F.transform(lines, lambda x: F.when(line_class(x) == "text", x).otherwise("")), "\n")
    return F.regexp_replace(F.regexp_replace(body, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def chunk_text(text: str, size: int) -> list[str]:
    """Pieces of at most ``size`` characters: broken at the last blank line, else the last line end, else hard; a break in the
    first half of a piece is not used. The break positions of the text are found once and looked up by bisection."""
    lines = [m.start() for m in re.finditer("\n", text)]
    blanks = [i for i in lines if text[i + 1 : i + 2] == "\n"]
    solid = re.compile(r"\S")
    out: list[str] = []
    start, end = 0, len(text)
    while end - start > size:
        half, stop = start + (size + 1) // 2, start + size
        cut = next((marks[k - 1] for marks in (blanks, lines) if (k := bisect_right(marks, stop)) and marks[k - 1] >= half), stop)
        out.append(text[start:cut])
        m = solid.search(text, cut)
        start = m.start() if m else end
    if start < end or not out:
        out.append(text[start:])
    return out


def chunks(c: Column, size: int = 50_000, most: int | None = None) -> Column:
    """Array of pieces of the text, cut to ``most`` characters if that is given; null for null."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else chunk_text(t[:most], size) for t in texts], dtype=object)

    return run(c)


@F.pandas_udf(T.StringType())
def nfc_key(texts: pd.Series) -> pd.Series:
    """Composed, trimmed, lower-case form, by which clips and headwords are compared."""
    return pd.Series([None if t is None else unicodedata.normalize("NFC", t.strip()).lower() for t in texts], dtype=object)


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Round with halves towards plus infinity."""
    f = 10**digits
    return F.floor(c * f + 0.5) / f
