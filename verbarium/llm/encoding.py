"""Text read with the wrong character encoding: garbled forms of the clean corpus words, hash-joined with the tokens.

Words are white-space tokens without ASCII punctuation at their ends; only words with a non-ASCII character take part.

1. Per distinct word, the distinct texts and the rows that hold it (copies of a text are one text; one shuffle of words).
2. Clean words (letters of the corpus, no control or replacement character) are written under every chain
   *right encoding -> wrong encoding*, East Asian ones included, and every double chain through UTF-8. A form with a pair of
   neighbouring characters that no word of the corpus has cannot match and is left out at once: exact, and as almost every chain works
   character by character it is decided for all chains together from the pairs of the word, before any form is made.
3. The forms are hash-joined with the distinct words; only hashes are shuffled, the words of the hits are fetched
   afterwards and each hit is verified. Any text can be read back through a one-byte chain, so such forms count by the evidence of a
   document: over its words that one chain explains, the non-ASCII characters of words that stand in fewer texts
   than their originals must come to three, or the shapes that no writing has (see ``oddity``) must outweigh those of the
   originals, however often the garbled words occur in the corpus. A document with a word of good shape whose
   "original" has an impossible one contradicts the chain: counts alone then show nothing.
4. Words without a clean twin in the corpus (names, rare forms) are a class of their own, ``pieces``: the same table, of the forms
   of the single letters of the corpus, must cover a non-ASCII run of the word. What was lost (U+FFFD, stray control
   characters) and single letters impossible in their place are the classes ``lost``, ``unknown`` and ``shape``.
5. Affected words are joined back to the documents; originals that were verified replace them.

The alphabet and the hashed pairs of neighbouring characters are the only things collected: their sizes are bounded by the code
points in use and by ``PAIRS``, not by the rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbarium.plans.runtime import small, spread, stored

# The encodings whose confusion is tried.
MULTI = "utf-8"
SINGLE = ("latin-1", "cp1252", "cp1251", "cp437", "cp866", "mac_roman", "koi8-r", "cp1250", "cp850", "iso8859-5", "mac_cyrillic")
WIDE = ("cp949", "gbk", "cp932", "big5", "euc_jp")
#: (right, wrong[, right, wrong]): chains whose wrong encodings have one byte a character work character by character ...
BY_CHAR = (
    *((MULTI, e) for e in SINGLE), *((MULTI, e, MULTI, f) for e in SINGLE for f in SINGLE), *((r, e) for r in (*SINGLE, *WIDE) for e in SINGLE if r != e),
)
#: ... the others by bytes that may straddle characters.
BY_RUN = (*((MULTI, w) for w in WIDE), *((r, w) for r in (*SINGLE, *WIDE) for w in WIDE if r != w))
CHAINS = (*BY_CHAR, *BY_RUN)
#: Buckets of the hashed pairs of neighbouring characters.
PAIRS = 1 << 22
#: Non-ASCII characters by which a document's rarer words confirm a one-byte chain by counts alone.
DENSE = 3
TYPOGRAPHIC = set("’‘“”„«»‹›—–…¿¡·ʼ№°§")

_RUN = re.compile("[^\x00-\x7f]+")
_BAD = re.compile("[\x80-\x9f�]")
_EDGE = r"^[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+$"


@lru_cache(None)
def _tables(name: str) -> tuple[dict[int, str], dict[int, str]]:
    """(byte -> character, character -> byte), both as ``str.translate`` tables over Latin-1; holes keep their byte."""
    there = {}
    for b in range(128, 256):
        try:
            there[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            there[b] = chr(b)
    back = {ord(c): chr(b) for b, c in there.items()}
    return there, back


def misread(raw: bytes, wrong: str) -> str:
    """The text that ``raw`` shows when it is read as ``wrong``."""
    return raw.decode("latin-1").translate(_tables(wrong)[0])


def unread(text: str, wrong: str) -> bytes | None:
    """The bytes that show as ``text`` under ``wrong``, or None."""
    back = _tables(wrong)[1]
    if any(ord(c) > 127 and ord(c) not in back for c in text):
        return None
    return text.translate(back).encode("latin-1")


def garble(word: str, chain: tuple[str, ...]) -> str | None:
    """``word`` written in the chain's right encodings and read in its wrong ones; None if it cannot be written so."""
    for right, wrong in zip(chain[::2], chain[1::2]):
        try:
            raw = word.encode(right)
        except UnicodeEncodeError:
            return None
        word = raw.decode(wrong, "replace") if wrong in WIDE else misread(raw, wrong)
    return word


def pair_bucket(pair: str) -> int:
    return zlib.crc32(pair.encode(MULTI, "surrogatepass")) % PAIRS


EDGE = "\n"


class Table:
    """The forms of words under all chains that can stand in the corpus.

    ``pairs``: buckets of the pairs of neighbouring characters in its words, ``EDGE`` standing for their ends; ``known``: its
    characters; None: all can.
    """

    def __init__(self, pairs: set[int] | None = None, known: frozenset[str] | None = None):
        self.pairs = pairs
        self.known = known
        self.near: dict[str, bool] = {}
        self.image: dict[str, list[str]] = {}
        self.inner: dict[str, int] = {}
        self.mask: dict[str, int] = {}
        self.start: dict[str, int] = {}

    def images(self, c: str) -> list[str]:
        """The form of one character under each chain of ``BY_CHAR``; empty if there is none that can stand in the corpus."""
        got = self.image.get(c)
        if got is None:
            got = [c] * len(BY_CHAR) if c == EDGE or c.isascii() else [x if (x := garble(c, chain)) and self.fits(x) else "" for chain in BY_CHAR]
            self.image[c] = got
            self.inner[c] = sum(1 << k for k, x in enumerate(got) if x)
        return got

    def beside(self, pair: str) -> bool:
        """Whether two characters stand side by side in the corpus."""
        got = self.near.get(pair)
        if got is None:
            got = self.near[pair] = self.pairs is None or pair_bucket(pair) in self.pairs
        return got

    def fits(self, form: str) -> bool:
        return all([self.beside(form[i : i + 2]) for i in range(len(form) - 1)])

    def chains_of(self, pair: str) -> int:
        """The chains (as bits) under which the form of two neighbouring characters can stand in the corpus."""
        got = self.mask.get(pair)
        if got is None:
            xs, ys = self.images(pair[0]), self.images(pair[1])
            bits = self.inner[pair[0]] & self.inner[pair[1]]
            got, k = 0, 0
            while bits >> k:
                if bits >> k & 1 and self.beside(xs[k][-1] + ys[k][0]):
                    got |= 1 << k
                k += 1
            self.mask[pair] = got
        return got

    def starts_of(self, run: str) -> int:
        """The chains of ``BY_RUN`` (as bits) whose form of the first characters of a run can stand in the corpus."""
        got = self.start.get(run)
        if got is None:
            got = 0
            for k, chain in enumerate(BY_RUN):
                form = garble(run, chain)
                sure = form[:-1] if form else ""  # the last character may take in bytes of the next one
                if form and (self.known is None or self.known.issuperset(sure) and self.fits(sure)):
                    got |= 1 << k
            self.start[run] = got
        return got

    def forms(self, word: str) -> Iterator[tuple[str, int]]:
        """(garbled form, number of its chain in ``CHAINS``); a form that equals the word is none, equal forms are one."""
        seen = {word}
        whole = f"{EDGE}{word}{EDGE}"
        bits = -1
        for i in range(len(whole) - 1):
            bits &= self.chains_of(whole[i : i + 2])
            if not bits:
                break
        images = [self.images(c) for c in word] if bits else []
        while bits:
            low = bits & -bits
            bits ^= low
            k = low.bit_length() - 1
            form = "".join([x[k] for x in images])
            if form not in seen:
                seen.add(form)
                yield form, k
        first = _RUN.search(word)
        bits = self.starts_of(word[first.start() : first.start() + 3]) if first else 0
        while bits:
            low = bits & -bits
            bits ^= low
            form = garble(word, BY_RUN[low.bit_length() - 1])
            if form and form not in seen and self.fits(f"{EDGE}{form}{EDGE}"):
                seen.add(form)
                yield form, len(BY_CHAR) + low.bit_length() - 1


def forms(word: str) -> Iterator[tuple[str, str]]:
    """(garbled form, chain) under all chains."""
    for form, k in Table().forms(word):
        yield form, ">".join(CHAINS[k])


class Pieces:
    """The forms of single letters, by which words without a clean twin are covered: chain -> form -> letter."""

    def __init__(self, alphabet: frozenset[str]):
        self.first: dict[str, dict[tuple[str, ...], dict[str, str]]] = {}
        for chain in sorted(BY_CHAR, key=len, reverse=True):
            if chain[0] != MULTI:
                continue
            for c in alphabet:
                form = garble(c, chain)
                if form and form != c:
                    self.first.setdefault(form[0], {}).setdefault(chain, {})[form] = c

    def cover(self, run: str) -> tuple[str, tuple[str, ...]] | None:
        """(original, chain) of a run that is wholly made of forms of letters under one chain; the longest chain first."""
        for chain in self.first.get(run[0], ()):
            out, at = [], 0
            while at < len(run):
                table = self.first.get(run[at], {}).get(chain)
                if table is None:
                    break
                sizes = {len(f) for f in table}
                piece = next((run[at : at + n] for n in sizes if run[at : at + n] in table), None)
                if piece is None:
                    break
                out.append(table[piece])
                at += len(piece)
            else:
                return "".join(out), chain
        return None


def is_letter(c: str) -> bool:
    return c in TYPOGRAPHIC or unicodedata.category(c)[0] == "L" and c != "ª" and c != "º"


def _script(c: str) -> str:
    return "l" if c.isascii() and c.isalpha() else unicodedata.name(c, "? ").split(" ")[0][:1].lower() if c.isalpha() else ""


def oddity(word: str) -> int:
    """2 if no writing has a word of this shape: capitals after small letters, two scripts, signs among the letters, or two and
    more Latin letters with none of A-Za-z; 1 for ``DENSE`` and more capitals alone; else 0. A single letter is never odd."""
    letters = [c for c in word if unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo") and c not in "ªº"]
    if len(letters) < 2:
        return 0
    scripts = {_script(c) for c in letters}
    if len(scripts) > 1 or scripts == {"l"} and not any(c.isascii() for c in letters):
        return 2
    if any(a.islower() and b.isupper() for a, b in zip(word, word[1:])) or any(c > "\x7f" and not is_letter(c) and unicodedata.category(c)[0] != "M" and c not in "\xa0\xadªº" for c in word):
        return 2
    return int(len(letters) >= DENSE and all(c.isupper() for c in letters))


def _byte_back(word: str, alphabet: frozenset[str]) -> tuple[str, str] | None:
    """A Latin word in which single characters are impossible in their place, read back through one one-byte chain."""
    odd = False
    for m in _RUN.finditer(word):
        before, after = word[m.start() - 1 : m.start()], word[m.end() : m.end() + 1]
        near = [c for c in (before, after) if c and c.isalpha()]
        if not near:
            continue
        run = m.group()
        cyrillic = any("Ѐ" <= c <= "ӿ" or "Ͱ" <= c <= "Ͽ" for c in run)
        inside = len(near) == 2 and all(c.islower() for c in near) and any(c.isupper() or not is_letter(c) for c in run) and "\xa0" not in run and "\xad" not in run
        odd |= cyrillic or inside
    if not odd or not re.search("[A-Za-z]", word):
        return None
    for wrong in ("cp1251", "koi8-r", "mac_roman", "cp437", "cp850", "cp866", "cp1250", "latin-1"):
        raw = unread(word, wrong)
        if raw is None:
            continue
        for right in ("cp1252", "mac_roman", "cp850"):
            if right == wrong:
                continue
            try:
                x = raw.decode(right)
            except UnicodeDecodeError:
                continue
            if x != word and all(c.isascii() or c in alphabet and is_letter(c) and _script(c) == "l" and c.islower() for c in x):
                return x, f"{right}>{wrong}"
    return None


def piecewise(word: str, pieces: Pieces, alphabet: frozenset[str]) -> tuple[str | None, str, str] | None:
    """(restored word or None, chain, class) if the word is garbled, judged by its characters; else None."""
    chains: list[str] = []

    def sub(m: re.Match) -> str:
        got = pieces.cover(m.group())
        if got is None:
            return m.group()
        chains.append(">".join(got[1]))
        return got[0]

    out = _RUN.sub(sub, word)
    if "�" in word:
        return None, "lost", "lost"
    if chains:
        return (None if _BAD.search(out) else out), chains[0], "pieces"
    if _BAD.search(word):
        return None, "unknown", "unknown"
    got = _byte_back(word, alphabet)
    return (*got, "shape") if got else None


def _words(docs: DataFrame, key: str, text: str, copy: Column | None = None) -> DataFrame:
    """(``__key``, ``word``) of the distinct words with a non-ASCII character of each row, and the value ``copy`` of the row."""
    t = F.split(F.col(text), "[ \\t\\r\\n]+")
    w = F.array_distinct(F.filter(F.transform(t, lambda x: F.regexp_replace(x, _EDGE, "")), lambda x: x.rlike("[^\\x00-\\x7F]")))
    return docs.select(F.col(key).alias("__key"), *([copy.alias("copy")] if copy is not None else []), F.explode(w).alias("word"))


#: Weight of odd shapes (see ``oddity``) by which a document confirms a one-byte chain: one impossible word, or two in capitals.
CONFIRMED = 2


def garbled_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The words of the corpus that may be garbled, once a chain: ``word``, ``original`` (null: not restorable), ``chain``, ``class``
    (``word``: a clean word of the corpus garbled; else see the module), ``dense`` (what the word adds to the evidence by counts),
    ``gain`` (oddity that the chain removes), ``rarer`` (than its original), ``rank`` (the highest original is taken)."""
    held = _words(docs, key, text, F.xxhash64(text)).groupBy("word", "copy").agg(F.count("*").alias("n"))
    counts = stored(held.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).withColumn("h", F.xxhash64("word")), "p10-words")
    chars = counts.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where(F.col("c").rlike("[^\\x00-\\x7F]"))
    present = frozenset(r["c"] for r in chars.distinct().collect())
    alphabet = frozenset(c for c in present if is_letter(c))
    ascii_ = frozenset(map(chr, range(128)))
    clean, known = alphabet | ascii_, present | ascii_
    edged = F.concat(F.lit(EDGE), "word", F.lit(EDGE))
    pair = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.pmod(F.crc32(F.encode(F.substring(F.col("e"), i, F.lit(2)), "utf-8")), F.lit(PAIRS)))))
    pairs = {r["b"] for r in counts.withColumn("e", edged).select(pair.alias("b")).distinct().collect()}  # at most PAIRS numbers

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, pieces = Table(pairs, known), Pieces(alphabet)
        for b in batches:
            out = []
            for word, h in zip(b["word"], b["h"]):
                if not clean.issuperset(word) or any(pieces.cover(r) for r in _RUN.findall(word)):
                    continue
                out += [(form, h, k) for form, k in made.forms(word)]
            yield pd.DataFrame(out, columns=["form", "h_original", "k"])

    def by_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(alphabet)
        for b in batches:
            out = [(w, *got) for w in b["word"] if (got := piecewise(w, pieces, alphabet))]
            yield pd.DataFrame(out, columns=["word", "original", "chain", "class"])

    @F.pandas_udf("int")
    def gain(words: pd.Series, originals: pd.Series, ks: pd.Series) -> pd.Series:
        """Null: the hashes agreed but the form is another."""
        return pd.Series([oddity(w) - oddity(o) if garble(o, CHAINS[k]) == w else None for w, o, k in zip(words, originals, ks)], dtype="Int32")

    made = spread(counts.select("word", "h"), "word").mapInPandas(table, "form string, h_original long, k int").select(F.xxhash64("form").alias("h"), "h_original", "k")
    old = counts.select(F.col("h").alias("h_original"), F.col("word").alias("original"), F.col("n").alias("n_original"), F.col("texts").alias("texts_original"))
    hits = stored(made.join(counts.select("h"), "h", "left_semi"), "p10-hits").join(counts, "h").join(old, "h_original")
    name = F.element_at(F.array(*(F.lit(">".join(c)) for c in CHAINS)), F.col("k") + 1)
    one_byte = ~F.col("chain").startswith(MULTI)
    dense = F.length(F.regexp_replace("word", "[\\x00-\\x7F]", ""))
    rarer = F.struct("texts", -F.col("gain"), "n") < F.struct(F.col("texts_original").alias("texts"), F.lit(0), F.col("n_original").alias("n"))
    hits = (
        hits.withColumns({"gain": gain("word", "original", "k"), "chain": name}).where("gain is not null")
        .withColumn("gain", F.when(one_byte, F.col("gain")).otherwise(0))
        .withColumns({"dense": F.when(~one_byte, DENSE).when(rarer, dense).otherwise(0), "rarer": ~one_byte | rarer, "rank": F.struct("n_original", "original")})
        .groupBy("word", "chain")
        .agg(F.max_by(F.struct("original", "dense", "rarer", "gain", "n_original"), F.struct(F.col("dense") > 0, "gain", "rarer", "rank")).alias("best"))
        .select("word", "best.original", "chain", F.lit("word").alias("class"), "best.dense", "best.gain", "best.rarer", F.col("best.n_original").alias("rank"))
    )
    rest = counts.select("word").mapInPandas(by_pieces, "word string, original string, chain string, class string")
    rest = rest.select("*", F.lit(DENSE).alias("dense"), F.lit(0).alias("gain"), F.lit(True).alias("rarer"), F.lit(-1).cast("long").alias("rank"))
    return stored(hits.unionByName(rest), "p10-garbled")


def _evidence(found: DataFrame, *keys: str) -> DataFrame:
    """(``keys``, ``ok``): whether the words of a document that one chain explains show the chain."""
    per = found.groupBy(*keys).agg(
        F.sum("dense").alias("dense"), F.max((F.col("dense") >= DENSE) & (F.col("gain") > 0)).alias("better"), F.min("gain").alias("worst"), F.sum("gain").alias("weight"),
    )
    return per.where(F.col("better") | ((F.col("dense") >= DENSE) & (F.col("worst") > -CONFIRMED)) | (F.col("weight") >= CONFIRMED)).select(*keys, "dense", "weight")


def find_garbled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The key of every document with a garbled stretch, once. Null and empty texts are never affected; repeated rows
    of one document give one row; other columns are not read."""
    bad = garbled_words(docs, key, text).select("word", "chain", "dense", "gain").distinct()
    found = _words(docs, key, text).join(small(bad), "word").distinct()
    return _evidence(found, "__key", "chain").select(F.col("__key").alias(key)).distinct()


def restore(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Affected documents with ``restored`` text, ``chains`` and ``classes`` (sorted) and ``n_lost``: words that have no original.

    A lost word stays as it stands. ``key`` must identify a row; rows that repeat a key count as one document.
    """
    bad = garbled_words(docs, key, text)
    found = _words(docs, key, text).join(small(bad), "word").distinct()
    shown = _evidence(found, "__key", "chain").select("__key", "chain", F.col("dense").alias("d"), "weight")
    found = found.join(shown, ["__key", "chain"]).where((F.col("d") >= DENSE) & F.col("rarer") | (F.col("weight") >= CONFIRMED) & (F.col("rarer") | (F.col("gain") > 0)))
    found = found.groupBy("__key", "word").agg(F.max_by(F.struct("original", "chain", "class"), F.struct("rank", "original", "chain")).alias("best")).select("__key", "word", "best.*")
    per = found.groupBy("__key").agg(
        F.map_from_entries(F.collect_set(F.when(F.col("original").isNotNull(), F.struct("word", "original")))).alias("fix"),
        F.array_sort(F.collect_set("chain")).alias("chains"),
        F.array_sort(F.collect_set("class")).alias("classes"),
        F.sum(F.when(F.col("original").isNull(), 1).otherwise(0)).alias("n_lost"),
    )
    per = stored(per, "p10-fixes")
    own = docs.select(key, F.col(text).alias("__text")).join(small(per.select(F.col("__key").alias(key))), key, "left_semi")  # clean texts stay where they are
    rows = own.groupBy(key).agg(F.max("__text").alias("__text")).join(per, F.col(key) == F.col("__key"))
    edge = re.compile("^([\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]*)(.*?)([\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]*)$", re.S)

    @F.pandas_udf("string")
    def apply(texts: pd.Series, fixes: pd.Series) -> pd.Series:
        def one(t: str, fix: dict) -> str:
            out = []
            for part in re.split("([ \t\r\n]+)", t):
                a, w, z = edge.match(part).groups()
                out.append(a + fix.get(w, w) + z)
            return "".join(out)

        return pd.Series([one(t, dict(f)) for t, f in zip(texts, fixes)])

    return rows.select(key, apply("__text", "fix").alias("restored"), "chains", "classes", "n_lost")
