"""Rule classifiers of URLs, texts and levels: ordered conditions, first match wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verbarium.functions.text import round_half_up

# Fixed values: (pattern, class) in the order they are tried.
SOURCE_TYPES = (
    ("dictionary|dict|wiktionary|word.?list|lexicon", "dictionary"),
    ("scholar|academic|journal|paper|arxiv|research|thesis|phonolog", "academic"),
    ("youtube|video|vimeo|lesson", "video"),
    (r"archive\.org|museum|collection|oral.?history|recording", "archive"),
    ("wiki", "wiki"),
)
RELIABILITY = (
    ("unreliable|inaccurate|questionable|dubious", 0.3),
    ("university|peer.?review|linguist|professor|phd", 0.9),
    ("government|institute|official|national", 0.8),
    ("dictionary|comprehensive|authoritative", 0.75),
    ("community|volunteer|blog|personal", 0.5),
)
CHEAP_SITES = (r"wikipedia\.org", r"wiktionary\.org", r"wikimedia\.org", r"github\.com", r"github\.io", r"glottolog\.org", r"endangeredlanguages\.com")
HARD_SITES = (
    r"\.edu[./]?", r"\.ac\.[a-z]{2}", r"\.go\.[a-z]{2}", r"\.gov\.[a-z]{2}", r"\.or\.[a-z]{2}", r"jstor\.org", r"sciencedirect\.com",
    r"springer\.com", r"researchgate\.net", r"academia\.edu", r"namu\.wiki", r"forvo\.com", r"glosbe\.com",
)
ROUTES = (
    (r"glottolog\.org", "glottolog"), (r"endangeredlanguages\.com", "elp"), (r"elar\.soas\.ac\.uk", "elar"),
    ("talkingdictionary", "talking-dictionary"), (r"hawaii\.edu", "uh-dictionary"), (r"wikipedia\.org", "wikipedia"),
    (r"youtube\.com|youtu\.be", "youtube"), (r"namu\.wiki", "namu-wiki"),
)
EXTRACTION = {"dictionary": "dictionary", "article": "archive", "video": "video", "academic": "academic", "wiki": "wiki", "generic": "archive"}
#: Code point ranges of scripts, the language each stands for, in the order of the full and the short detector.
RANGES = {
    "ko": "\uac00-\ud7af\u1100-\u11ff\u3130-\u318f", "th": "\u0e00-\u0e7f", "ar": "\u0600-\u06ff\u0750-\u077f", "hi": "\u0900-\u097f",
    "zh": "\u4e00-\u9fff\u3400-\u4dbf", "ja": "\u3040-\u309f\u30a0-\u30ff", "ru": "\u0400-\u04ff", "ta": "\u0b80-\u0bff",
    "bn": "\u0980-\u09ff", "my": "\u1000-\u109f", "km": "\u1780-\u17ff", "am": "\u1200-\u137f", "ka": "\u10a0-\u10ff",
    "gu": "\u0a80-\u0aff", "te": "\u0c00-\u0c7f",
}
FULL_ORDER = ("ko", "th", "ar", "hi", "zh", "ja", "ru", "ta", "bn", "my", "km", "am", "ka", "gu", "te")
SHORT_ORDER = ("ko", "ar", "hi", "th", "zh", "ru", "bn", "ta", "my", "km", "am")
JEJU = r"하르방|할망|마씸|우다|수다|ᆞ|ㅿ|msim|하영|혼저|감수광"
ENDANGERMENT = {
    "aes-not_endangered": ("not_endangered", 1), "aes-threatened": ("vulnerable", 2), "aes-shifting": ("definitely_endangered", 3),
    "aes-moribund": ("severely_endangered", 4), "aes-nearly_extinct": ("critically_endangered", 5), "aes-extinct": ("extinct", 6),
}
CONFIDENCE = {"low": 1, "medium": 2, "high": 3}
STEPS = (0, 1, 4, 9, 24, 49, 99)


def ordered(c: Column, rules, default) -> Column:
    """The class of the first pattern that occurs in ``c``."""
    out = F
    for pattern, value in rules:
        out = out.when(c.rlike(pattern), F.lit(value))
    return out.otherwise(F.lit(default))


def source_type(url: Column, description: Column) -> Column:
    return ordered(F.lower(F.concat_ws(" ", url, description)), SOURCE_TYPES, "archive")


def reliability(text: Column) -> Column:
    return ordered(F.lower(text), RELIABILITY, 0.6)


#: The labels of sites that are read plainly first and of those that are not.
TIERS = ("cheerio_first", "brightdata_first")


def domain_tier(url: Column, labels: tuple[str, str] = TIERS) -> Column:
    """The second label for hard sites that are not known to be easy, else the first."""
    known = lambda sites: F.lower(url).rlike("|".join(sites))
    return F.when(known(HARD_SITES) & ~known(CHEAP_SITES), labels[1]).otherwise(labels[0])


def crawler_route(url: Column) -> Column:
    return ordered(F.lower(url), ROUTES, "generic")


def extraction_type(kind: Column) -> Column:
    m = F.create_map(*(F.lit(x) for kv in EXTRACTION.items() for x in kv))
    return F.coalesce(m[kind], F.lit("archive"))


def count_in(c: Column, lang: str) -> Column:
    return F.regexp_count(c, F.lit(f"[{RANGES[lang]}]"))


def script_counts(c: Column) -> Column:
    """What :func:`script_language` needs to know of a text, to be computed in a projection of its own (each count once)."""
    jeju = F.regexp_count(c, F.lit(JEJU)) + F.regexp_count(c, F.lit("ᆞ"))
    return F.struct(F.length(F.regexp_replace(c, r"\s", "")).alias("total"), jeju.alias("jeju"), *(count_in(c, k).alias(k) for k in FULL_ORDER))


def script_language(counts: Column) -> tuple[Column, Column]:
    """(language, confidence) by the share of each script among the characters that are no space, from its counts."""
    total, jeju = counts["total"], counts["jeju"]
    share = {k: F.try_divide(counts[k], total) for k in FULL_ORDER}
    lang, conf = F.when(total == 0, "en").when(jeju > 0, "jje"), F.when(total == 0, 0.0).when(jeju > 0, round_half_up(F.least(F.lit(0.95), 0.6 + jeju * 0.1), 3))
    for k in FULL_ORDER:
        lang = lang.when(share[k] > 0.3, k)
        conf = conf.when(share[k] > 0.3, round_half_up(F.least(F.lit(0.95), share[k] + 0.2), 3))
    return lang.otherwise("en"), conf.otherwise(round_half_up(F.greatest(F.lit(0.5), 1 - share["ko"] * 2), 3))


def script_language_short(c: Column, hint: Column | None = None) -> Column:
    """The hint if given, else the first script with over 15 % of the first 1,000 characters."""
    s = F.substring(c, 1, 1000)
    total = F.length(F.regexp_replace(s, r"\s", ""))
    out = F.when((hint.isNotNull() & (hint != "")) if hint is not None else F.lit(False), hint if hint is not None else F.lit(None))
    for k in SHORT_ORDER:
        out = out.when(count_in(s, k) > total * 0.15, k)
    return out.otherwise("en")


# Least length, size limit in KiB (None: any), least share of plain characters and the kinds of source of clean texts.
CLEAN_TEXTS = ((200, None, 0.8, None), (100, 500, 0.7, None), (150, None, 0.75, ("academic", "wiki")))
DEGRADED_LENGTH, DEGRADED_SHARE = 50, 0.4


def scan_quality(text: Column, size_bytes: Column, kind: Column) -> Column:
    """``degraded``, ``clean`` or ``unknown`` by length and share of plain characters."""
    n, bare = F.length(text), F.regexp_replace(text, r"\s", "")
    share = F.coalesce(F.try_divide(F.length(F.regexp_replace(bare, r"""[^a-zA-Z0-9.,;:!?()\-'"]""", "")), F.length(bare)), F.lit(0.0))
    clean = F.lit(False)
    for least, kib, over, kinds in CLEAN_TEXTS:
        rule = (n >= least) & (share > over)
        rule = rule if kib is None else rule & (size_bytes / 1024 < kib)
        clean = clean | F.coalesce(rule if kinds is None else rule & kind.isin(*kinds), F.lit(False))
    return F.when((n < DEGRADED_LENGTH) | (share < DEGRADED_SHARE), "degraded").when(clean, "clean").otherwise("unknown")


def bucket(n: Column) -> Column:
    """Index of the first step of the colour scale that holds the count."""
    out = F
    for i, s in enumerate(STEPS):
        out = out.when(n <= s, i)
    return out.otherwise(len(STEPS))


def heat(level: Column) -> Column:
    return 0.3 + (level - 2) / 4 * 0.7


def confidence_rank(c: Column) -> Column:
    m = F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))
    return F.coalesce(m[c], F.lit(0))


# Fixed values: (pattern, strategy) in the order they are tried.
STRATEGIES = (
    (r"pagination|page\s*\d|next\s*page|previous|»|›", "paginated"), ("search|filter|query|find", "searchable"), (r"scroll|load\s*more|infinite|show\s*more", "scrollable"),
)


def page_strategy(text: Column) -> Column:
    """How a page is walked, by what its text offers."""
    return ordered(F.lower(text), STRATEGIES, "simple")


# Fixed values: (pattern, label) in the order they are tried.
POS_WORDS = (("pronoun|deixis", "pronoun"), ("verb", "verb"), ("noun|kinship", "noun"), ("particle", "particle"))
CLUSTER_WORDS = (
    ("kinship", "kinship"), ("phonolog|consonant|vowel|prosody", "phonology"), ("grammar|noun|verb|pronoun|particle|deixis", "grammar"),
    ("vocabulary|sound symbolism|cultural", "vocabulary"), ("orthography", "orthography"),
)


def infer_pos(context: Column, word: Column) -> Column:
    """The word class that the (lower-case) context names, else a verb by its ending, else ``unknown``."""
    return F.coalesce(ordered(context, POS_WORDS, None), F.when(word.rlike("(?:-|da)$"), "verb"), F.lit("unknown"))


def infer_cluster(context: Column) -> Column:
    return ordered(context, CLUSTER_WORDS, None)
