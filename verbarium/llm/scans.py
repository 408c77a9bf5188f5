"""Noise in the text of scanned pages: running heads, page numbers, words broken over lines, misread characters.

Lines of a scan are labelled *head*, *number*, *body* or *break* by a hidden Markov model over layout features (edge
numbers, letter case, width against the page's own measure, recurrence of the line in the text, the neighbours' form,
whether the sentence runs on). The model is fitted here by Viterbi training on a bounded, hash-ordered sample of the scans
(``sample`` texts), started from seed rules; every scan is then decoded.

Words are judged against the lexicon of all words in contents that are no scans. A word of a scan that the lexicon lacks is
misread if undoing at most two recognition errors gives a word the lexicon holds often enough; all distinct words take
part, joined by hash. A last word with a hyphen is broken if the two parts make one word, or if the part on the next text
line is no word of its own (so affixes quoted as ``-ta`` or ``ta-`` are left alone).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbarium.llm.pages import is_scan
from verbarium.plans.runtime import small, spread, stored, width

HEAD, NUMBER, BODY, BREAK = range(4)
# Fixed values: (misread, written), as recognition confuses them.
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("c", "e"), ("f", "t"), ("í", "i"), ("rn", "m"),
    ("cl", "d"), ("li", "h"), ("vv", "w"), ("ii", "n"), ("ii", "u"), ("d", "cl"), ("m", "rn"), ("h", "li"),
    ("ﬁ", "fi"), ("ﬂ", "fl"),
)
WORD = re.compile(r"[^\W_]+(?:[’'ʼ][^\W_]+)*")
_NUMBER = re.compile(r"^[\[(\-–—~ ]*(?:(?:p|pp|pag|pág|page|página|hal|halaman)\b\.?\s*)?([0-9A-Za-z]{1,9})[\])\-–—~ ]*$", re.I)
_ROMAN = re.compile(r"^(?=.)m*(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$", re.I)
_EDGE_NUMBER = re.compile(r"^\s*(?:(?=\S*\d)\S{1,5}|[lIoO]{1,5}|[ivxlcdm]{1,9})\s{2,}\S|\S\s{2,}(?:(?=\S*\d)\S{1,5}|[lIoO]{1,5}|[ivxlcdm]{1,9})\s*$")
_BROKEN = re.compile(r"([^\W\d_]+(?:[’'ʼ][^\W\d_]+)*)([-\u00ad\u2010\u2011\u00ac])\s*$")
_FOLD = str.maketrans({"0": "o", "1": "i", "l": "i", "í": "i", "t": "i", "f": "i", "5": "s", "9": "g", "6": "b", "c": "e"})


def is_number(line: str) -> bool:
    """Whether a line holds nothing but a page number: digits (some misread as letters) or a Roman numeral, with marks and a
    word for page around it. A full stop after it makes it the end of a sentence."""
    m = _NUMBER.match(line)
    if not m:
        return False
    t = m.group(1)
    digits = bool(re.fullmatch(r"[0-9lIoOSBZ]{1,6}", t)) and (any(c.isdigit() for c in t) or bool(re.fullmatch(r"[lIO]+", t)) and (len(t) > 1 or line.strip() != t))
    return digits or bool(_ROMAN.match(t)) and (t.islower() or t.isupper())


def _skeleton(line: str) -> str:
    s = re.sub(r"^\s*\S{1,9}\s{2,}|\s{2,}\S{1,9}\s*$", "", line)
    return re.sub(r"[\W_]", "", s.lower().translate(_FOLD))


def features(lines: list[str]) -> np.ndarray:
    """One row of small integers per line: number form, edge number, case, width, recurrence, neighbours, run-on."""
    n = len(lines)
    strip = [x.strip() for x in lines]
    measure = np.median([len(x) for x in strip if len(x) > 20] or [1])
    number = [bool(x) and is_number(x) for x in strip]
    keys: dict[str, int] = defaultdict(int)
    parts = []
    for x, num in zip(lines, number):
        s = "" if num else _skeleton(x)
        h = len(s) // 2
        p = {f"a{s[:h]}|{len(s) // 3}", f"b{s[h:]}|{len(s) // 3}", f"c{s}"} if len(s) >= 6 else {f"c{s}"} if s else set()
        parts.append(p)
        for k in p:
            keys[k] += 1
    again = [max((keys[k] for k in p), default=0) for p in parts]
    edge = [bool(_EDGE_NUMBER.search(x)) for x in lines]
    shape = [_case(x) for x in strip]

    def near_number(i: int) -> bool:
        after = next((j for j in range(i + 1, n) if strip[j]), i)
        before = next((j for j in range(i - 1, -1, -1) if strip[j]), i)
        return any(j != i and abs(j - i) <= 2 and number[j] for j in (before, after))

    near = [near_number(i) for i in range(n)]
    # lines that surely stand outside the running text, so that sentences can be followed across them
    sure = [number[i] or edge[i] or (near[i] and (shape[i] >= 2 or again[i] >= 2) and len(x) < measure) for i, x in enumerate(strip)]
    out = np.zeros((n, 8), dtype=np.int8)
    last = None  # the line of running text before
    for i, x in enumerate(strip):
        if not x:
            continue
        nxt = next((strip[j] for j in range(i + 1, n) if strip[j] and not sure[j]), None)
        open_before = last is not None and not _STOP.search(last)
        into = open_before and not x[:1].isupper()
        onward = nxt is not None and not _STOP.search(x) and not nxt[:1].isupper()
        across = open_before and nxt is not None and not nxt[:1].isupper()
        out[i] = (
            1 + number[i],
            1 + edge[i],
            1 + shape[i],
            1 + min(4, int(5 * len(x) / max(measure, 1))),
            1 + min(2, max(0, again[i] - 1)),
            1 + near[i],
            1 + into + 2 * onward + 4 * across if not sure[i] else 1 + 4 * across,
            1 + bool(re.search(r"[.!?,;]$", x)),
        )
        if not sure[i]:
            last = x
    return out


_STOP = re.compile(r"[.!?…:][”»\"')]*$")


def _case(x: str) -> int:
    """0: starts in lower case; 1: with a capital; 2: all words do; 3: capitals only."""
    letters = [c for c in x if c.isalpha()]
    words = [w for w in x.split() if w[:1].isalpha()]
    if len(letters) > 3 and sum(c.isupper() for c in letters) >= 0.7 * len(letters):
        return 3
    if len(words) > 1 and sum(w[:1].isupper() for w in words) >= 0.7 * len(words):
        return 2
    return int(x[:1].isupper())


def seed(f: np.ndarray) -> np.ndarray:
    """Labels by plain rules, from which the training starts."""
    out = np.full(len(f), BODY)
    out[f[:, 0] == 0] = BREAK
    out[f[:, 0] == 2] = NUMBER
    text = (f[:, 0] == 1) & (f[:, 7] == 1)
    near, caps, again, narrow = f[:, 5] == 2, f[:, 2] >= 3, f[:, 4] >= 2, f[:, 3] <= 4
    out[(f[:, 0] == 1) & (f[:, 1] == 2)] = HEAD
    out[text & near & (caps | again) & (narrow | again)] = HEAD
    out[text & again & narrow & caps] = HEAD
    return out


class LineModel:
    """Hidden Markov model with independent categorical features; log parameters as arrays."""

    def __init__(self) -> None:
        self.start = np.zeros(4)
        self.move = np.zeros((4, 4))
        self.emit = np.zeros((8, 4, 9))

    def fit(self, docs: list[np.ndarray], rounds: int = 3) -> LineModel:
        labels = [seed(f) for f in docs]
        for _ in range(rounds):
            start, move, emit = np.ones(4), np.ones((4, 4)), np.full((8, 4, 9), 0.1)
            for f, y in zip(docs, labels):
                if len(y):
                    start[y[0]] += 1
                    np.add.at(move, (y[:-1], y[1:]), 1)
                    for k in range(8):
                        np.add.at(emit[k], (y, f[:, k]), 1)
            self.start, self.move, self.emit = np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), np.log(emit / emit.sum(2, keepdims=True))
            labels = [self.decode(f) for f in docs]
        return self

    def decode(self, f: np.ndarray) -> np.ndarray:
        """The most probable labels (Viterbi). Blank lines are breaks and pure numbers are never heads or breaks;
        a line that starts in lower case or ends a sentence is no head unless it bears a number or its words are capitalised."""
        n = len(f)
        if not n:
            return np.zeros(0, dtype=int)
        e = sum(self.emit[k][:, f[:, k]] for k in range(8)).T
        blank = f[:, 0] == 0
        e[blank, :BREAK] = -1e9
        e[~blank, BREAK] = -1e9
        e[f[:, 0] == 1, NUMBER] = -1e9
        e[f[:, 0] == 2, HEAD] = -1e9
        e[(f[:, 1] == 1) & ((f[:, 2] == 1) | (f[:, 2] == 2) & (f[:, 7] == 2)), HEAD] = -1e9
        score, back = self.start + e[0], np.zeros((n, 4), dtype=np.int8)
        for t in range(1, n):
            m = score[:, None] + self.move
            back[t] = m.argmax(0)
            score = m.max(0) + e[t]
        y = np.zeros(n, dtype=int)
        y[-1] = score.argmax()
        for t in range(n - 1, 0, -1):
            y[t - 1] = back[t, y[t]]
        return y


def words_of(text: str) -> list[str]:
    """Lower-case words; an affix (a hyphen on one side, a space or an end on the other) is none."""
    out = []
    for m in WORD.finditer(text.lower()):
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if before == "-" and (m.start() < 2 or text[m.start() - 2].isspace()) or after == "-" and text[m.end() + 1 : m.end() + 2].isspace():
            continue
        out.append(m.group())
    return out


def undo(word: str, most: int = 2) -> set[str]:
    """The words from which at most ``most`` recognition errors give ``word`` (some length to the power ``most`` at most)."""
    seen, edge = {word}, {word}
    for _ in range(most):
        nxt = set()
        for w in edge:
            for bad, good in CONFUSIONS:
                at = w.find(bad)
                while at >= 0:
                    nxt.add(w[:at] + good + w[at + len(bad) :])
                    at = w.find(bad, at + 1)
        edge = nxt - seen
        seen |= edge
    seen.discard(word)
    return seen


#: Words up to this length are looked up by all forms :func:`undo` gives; longer ones by their :func:`skeleton`, with the same result.
SPELLED = 60


def skeleton(word: Column) -> Column:
    """A key that no recognition error changes: both sides of every confusion have the same skeleton."""
    out = word
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("m", "rn"), ("w", "vv"), ("d", "cl"), ("h", "li"), ("n", "ii"), ("u", "ii")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, "01lí5689cf", "oiiisbbget")


def _steps(word: str) -> Iterator[str]:
    for bad, good in CONFUSIONS:
        at = word.find(bad)
        while at >= 0:
            yield word[:at] + good + word[at + len(bad) :]
            at = word.find(bad, at + 1)


def _one_step(word: str, original: str) -> bool:
    a, n = 0, min(len(word), len(original))
    while a < n and word[a] == original[a]:
        a += 1
    z = 0
    while z < n - a and word[-1 - z] == original[-1 - z]:
        z += 1
    return any(
        word[i : i + len(bad)] == bad and original[i : i + len(good)] == good and word[:i] == original[:i] and word[i + len(bad) :] == original[i + len(good) :]
        for bad, good in CONFUSIONS for i in range(max(0, a - 2), a + 1) if len(word) - len(bad) == len(original) - len(good)
    )


def undone(word: str, original: str) -> bool:
    """Whether at most two recognition errors turn ``original`` into ``word``."""
    return word != original and (_one_step(word, original) or any(_one_step(w, original) for w in _steps(word)))


_TOKENS = "doc long, line_no int, next_no int, kind string, word string, head string, tail string"


def _scan_frame(df: DataFrame, key: str, content: str) -> DataFrame:
    return df.where(F.col(content).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(content).alias("content"))


def fit(df: DataFrame, content: str, sample: int = 400) -> LineModel:
    """The line model, fitted on at most ``sample`` scans taken in hash order (bounded; texts beyond 20,000 characters are
    passed over here, not in decoding)."""

    @F.pandas_udf("boolean")
    def scan(t: pd.Series) -> pd.Series:
        return pd.Series([is_scan(x.split("\n")) for x in t], dtype=bool)

    pool = df.where(F.col(content).isNotNull() & (F.length(content) <= 20_000)).select(F.col(content).alias("t")).where(F.col("t").contains("\n"))
    rows = pool.where(scan("t")).orderBy(F.xxhash64("t"), "t").limit(sample).collect()
    return LineModel().fit([features(r["t"].split("\n")) for r in rows])


def labelled(df: DataFrame, key: str, content: str, model: LineModel) -> DataFrame:
    """(``doc``, ``line_no``, ``label``) for each line of every scan that is not blank, and its tokens (``_TOKENS``): the words
    of body lines (``word``), and of each last word with a hyphen the joined form (``joined``, with both parts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b["doc"], b["content"]):
                lines = text.split("\n")
                if not is_scan(lines):
                    continue
                y = model.decode(features(lines))
                body = [i for i in range(len(lines)) if y[i] == BODY]
                rows += [(doc, i, None, "head" if y[i] == HEAD else "number", None, None, None) for i in range(len(lines)) if y[i] in (HEAD, NUMBER)]
                skip: dict[int, str] = {}
                for i, j in zip(body, body[1:] + [None]):
                    line = skip.pop(i, lines[i])
                    m = _BROKEN.search(line)
                    if m and j is not None:
                        nxt = re.match(r"\s*([^\s]+)", lines[j])
                        b2 = WORD.match(nxt.group(1)) if nxt else None
                        if b2 and lines[j].lstrip()[: len(b2.group())] == b2.group():
                            soft = "hard" if m.group(2) == "-" else "soft"
                            skip[j] = lines[j].lstrip()[len(b2.group()) :]
                            rows.append((doc, i, j, f"joined-{soft}", (m.group(1) + b2.group()).lower(), m.group(1), b2.group()))
                    for w in words_of(line if not m else line[: m.start(1)]):
                        rows.append((doc, i, j, "word", w, None, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _TOKENS.split(", ")]).astype({"next_no": "Int32"})

    return spread(_scan_frame(df, key, content)).mapInPandas(run, _TOKENS)


def lexicon(df: DataFrame, content: str) -> DataFrame:
    """(``word``, ``n``): contents without scans that hold the word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter = Counter()
            for t in b["content"]:
                if not is_scan(t.split("\n")):
                    c.update(set(WORD.findall(t.lower())))
            yield pd.DataFrame({"word": list(c), "n": list(c.values())})

    src = df.where(F.col(content).isNotNull()).select(F.col(content).alias("content")).distinct()
    return src.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def judged(df: DataFrame, key: str, content: str, sample: int = 400, least: int = 3, affix: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokens, fixes, broken). ``fixes``: (``word``, ``original``) of misread words; ``broken``: the joined tokens that are one
    word. ``least``: contents that must hold a word before another is held for its misreading;
    ``affix``: the longest quoted affix, a longer last part of unknown kind is the start of a word."""
    tokens = stored(labelled(df, key, content, fit(df, content, sample)), "p6-tokens")
    lex = stored(lexicon(df, content), "p6-lexicon")

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, c) for w in b["word"] for c in undo(w)]
            yield pd.DataFrame(rows, columns=["word", "original"])

    @F.pandas_udf("boolean")
    def same(words: pd.Series, originals: pd.Series) -> pd.Series:
        return pd.Series([undone(w, o) for w, o in zip(words, originals)], dtype=bool)

    said = tokens.where("word is not null").select("word").distinct()
    unknown = said.join(lex.select("word"), "word", "left_anti").repartition(width(df.sparkSession))
    held = lex.where(F.col("n") >= least).select(F.col("word").alias("original"), "n")
    letters = F.col("word").rlike(r"\p{L}")
    made = unknown.where((F.length("word") <= SPELLED) & ((F.length("word") > 1) | letters)).mapInPandas(candidates, "word string, original string")
    long = unknown.where(F.length("word") > SPELLED).withColumn("s", skeleton(F.col("word"))).join(held.where(F.length("original") > SPELLED / 2).select("original", skeleton(F.col("original")).alias("s")), "s")
    made = made.unionByName(long.where(same("word", "original")).select("word", "original"))
    fixes = made.join(held, "original").groupBy("word").agg(F.max_by("original", F.struct("n", "original")).alias("original"))
    # a digit inside a word is misread even where the word itself is unknown
    mixed = unknown.where(F.col("word").rlike(r"\p{L}\d\p{L}|\p{L}{2}\d$|^\d\p{L}{3}") & ~F.col("word").rlike(r"\d{2}")).select("word", F.lit(None).cast("string").alias("o2"))
    fixes = stored(fixes.join(mixed, "word", "full").select("word", "original"), "p6-fixes")

    joined = tokens.where("kind like 'joined%'")
    part = lex.select(F.col("word").alias("t"), F.col("n").alias("n_tail"))
    whole = lex.select("word", F.col("n").alias("n_whole"))
    j = joined.withColumn("t", F.lower("tail")).join(part, "t", "left").join(whole, "word", "left").join(fixes.where("original is not null"), "word", "left")
    tail_word = (F.coalesce("n_tail", F.lit(0)) >= least) & (F.length("tail") >= 1)
    one_word = F.col("n_whole").isNotNull() | F.col("original").isNotNull() | ~tail_word | (F.length("head") > affix)
    # the part on the next line goes on in lower case (a misread digit may stand for its first letter), or in capitals after capitals
    lower = ~F.col("tail").rlike(r"^(?:\p{Lu}|\d+$)") | F.col("head").rlike(r"\p{Lu}$")
    broken = j.where((F.col("kind") == "joined-soft") | (lower & one_word)).select("doc", "line_no", "next_no", "word", "head", "tail", "original")
    return tokens, fixes, stored(broken, "p6-broken")


def faulty_lines(df: DataFrame, key: str, content: str, sample: int = 400) -> DataFrame:
    """(``key``, ``line_no``, ``fault``): ``running_head``, ``page_number``, ``broken_word`` and ``misread`` lines of scans.

    Lines are split at ``\\n`` and numbered from 0. Null and empty contents and contents that are no scans give none;
    repeated rows of a key give each fault once.
    """
    tokens, fixes, broken = judged(df, key, content, sample)
    plain = tokens.where("kind in ('head', 'number')").select("doc", "line_no", F.when(F.col("kind") == "head", "running_head").otherwise("page_number").alias("fault"))
    cut = broken.select("doc", "line_no", F.lit("broken_word").alias("fault"))
    wrong = tokens.where("kind = 'word'").join(small(fixes), "word", "left_semi").select("doc", "line_no", F.lit("misread").alias("fault"))
    in_head = F.lower("head") != F.expr("left(original, length(head))")
    in_tail = F.lower("tail") != F.expr("right(original, length(tail))")
    pieces = broken.where("original is not null")
    wrong2 = pieces.where(in_head).select("doc", "line_no", F.lit("misread").alias("fault")).union(pieces.where(~in_head | in_tail).where(~in_head).select("doc", F.col("next_no"), F.lit("misread")))
    # parts of a last word that is no broken word are words of their own
    alone = tokens.where("kind like 'joined%'").join(broken.select("doc", "line_no"), ["doc", "line_no"], "left_anti")
    own = alone.select("doc", F.col("next_no").alias("line_no"), F.lower("tail").alias("word")).join(small(fixes), "word", "left_semi").select("doc", "line_no", F.lit("misread").alias("fault"))
    return plain.union(cut).union(wrong).union(wrong2).union(own).distinct().select(F.col("doc").alias(key), "line_no", "fault")


def assemble(text: str, outside: set[int], broken: set[int], fixes: dict[str, str]) -> str:
    """Continuous paragraphs of one scan: lines outside the text go, broken words are joined, misread words replaced.

    A paragraph starts at an indented line, or after a blank line where a sentence had ended.
    """

    def fixed(m: re.Match) -> str:
        w = m.group()
        good = fixes.get(w.lower())
        if not good:
            return w
        return good.upper() if w.isupper() and len(w) > 1 else good[:1].upper() + good[1:] if w[:1].isupper() else good

    paragraphs: list[str] = []
    glue, gap = False, False
    for i, line in enumerate(text.split("\n")):
        if not line.strip():
            gap = True
            continue
        if i in outside:
            continue
        body = line.strip()
        if i in broken:
            body = _BROKEN.sub(lambda m: m.group(1), body)
        fresh = not paragraphs or not glue and (line.startswith("  ") or gap and _STOP.search(paragraphs[-1]))
        if fresh:
            paragraphs.append(body)
        else:
            paragraphs[-1] += ("" if glue else " ") + body
        glue, gap = i in broken, False
    return "\n\n".join(WORD.sub(fixed, p) for p in paragraphs)


def repair(df: DataFrame, key: str, content: str, sample: int = 400) -> DataFrame:
    """(``key``, ``repaired``) for every scan. ``key`` identifies a row (of rows that repeat a key the greatest content is
    taken). Misread words whose original is unknown stay as they are. One scan is one text: its lines fit one row."""
    tokens, fixes, broken = judged(df, key, content, sample)
    good = small(fixes.where("original is not null"))
    in_doc = tokens.where("word is not null").select("doc", "word").distinct().join(good, "word").groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("word", "original"))).alias("fix"))
    marks = tokens.groupBy("doc").agg(F.collect_set(F.when(F.col("kind").isin("head", "number"), F.col("line_no"))).alias("outside"))
    cuts = broken.groupBy("doc").agg(F.collect_set("line_no").alias("broken"))

    @F.pandas_udf("string")
    def build(t: pd.Series, o: pd.Series, b: pd.Series, f: pd.Series) -> pd.Series:
        none = lambda x: () if x is None else x
        return pd.Series([assemble(x, set(none(y)), set(none(z)), dict(none(w))) for x, y, z, w in zip(t, o, b, f)], dtype=object)

    src = _scan_frame(df, key, content).groupBy("doc").agg(F.max("content").alias("content"))
    x = marks.join(src, "doc").join(cuts, "doc", "left").join(in_doc, "doc", "left")
    return x.select(F.col("doc").alias(key), build("content", "outside", "broken", "fix").alias("repaired"))
