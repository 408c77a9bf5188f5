"""Transcripts and videos: ids, time offsets, first occurrences, joined text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def video_id(url: Column) -> Column:
    """The eleven-character id of a watch, short, embed or shorts address; null if there is none."""
    x = F.regexp_extract(url, r"(?:v=|youtu\.be/|/embed/|/shorts/)([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1)
    return F.when(x != "", x)


def clock(seconds: Column) -> Column:
    """``m:ss`` of a time."""
    s = F.floor(seconds).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def shift_segments(segments: Column, chunk: Column, width: float = 30.0) -> Column:
    """Segments of chunk n moved to the time of the whole recording, rounded to hundredths."""
    move = lambda s, f: F.round(s[f] + chunk * width, 2).alias(f)
    return F.transform(segments, lambda s: F.struct(move(s, "start"), move(s, "end"), s["text"].alias("text")))


def transcript(segments: Column) -> Column:
    """The text of the segments in order of their start."""
    return F.array_join(F.transform(F.array_sort(F.transform(segments, lambda s: F.struct(s["start"].alias("s"), s["text"].alias("t")))), lambda x: F.trim(x["t"])), " ")


def first_words(df: DataFrame, key: str, words: str) -> DataFrame:
    """(``key``, ``word``, ``start``, ``end``): the first occurrence of each word of more than one letter that lasts at least 0.2 s."""
    x = df.select(key, F.explode(words).alias("w")).select(key, F.lower(F.trim("w.word")).alias("word"), "w.start", "w.end")
    x = x.where((F.length("word") > 1) & (F.col("end") - F.col("start") >= 0.2))
    return x.groupBy(key, "word").agg(F.min(F.struct("start", "end")).alias("m")).select(key, "word", "m.start", "m.end")


def fenced_json(text: Column) -> Column:
    """The JSON part of an answer: inside a fence, else from the first bracket to the last; null if it doesn't parse."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fence != "", F.trim(fence)).otherwise(F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1))
    return F.when(F.try_parse_json(body).isNotNull(), body)


# Names of contact languages and the code a recogniser knows them by.
SPEECH = {
    "Korean": "ko", "Japanese": "ja", "Mandarin Chinese": "zh", "Thai": "th", "Vietnamese": "vi", "Khmer": "km", "Burmese": "my", "Malay": "ms",
    "Indonesian": "id", "Filipino": "tl", "Hindi": "hi", "Bengali": "bn", "Tamil": "ta", "Nepali": "ne", "Sinhala": "si", "Russian": "ru",
    "Arabic": "ar", "Persian": "fa", "Turkish": "tr", "French": "fr", "Spanish": "es", "Portuguese": "pt", "English": "en", "German": "de",
    "Italian": "it", "Dutch": "nl", "Polish": "pl", "Swedish": "sv", "Norwegian": "no", "Danish": "da", "Finnish": "fi", "Greek": "el",
    "Hebrew": "he", "Swahili": "sw", "Amharic": "am", "Urdu": "ur", "Georgian": "ka", "Armenian": "hy", "Mongolian": "mn", "Maori": "mi",
    "Welsh": "cy", "Catalan": "ca", "Basque": "eu", "Irish": "ga", "Icelandic": "is", "Estonian": "et", "Czech": "cs", "Ukrainian": "uk",
    "Romanian": "ro", "Hungarian": "hu",
}


def speech_language(contacts: Column, code: Column, table: dict[str, str] | None = None) -> Column:
    """The code of the first contact language that ``table`` knows, else a two-letter ``code``, else ``en``."""
    m = F.create_map(*(F.lit(x) for kv in (table or SPEECH).items() for x in kv))
    known = F.filter(F.transform(contacts, lambda x: m[x]), lambda x: x.isNotNull())
    return F.coalesce(F.get(known, F.lit(0)), F.when(F.length(code) == 2, code), F.lit("en"))


def byte_size(n: Column) -> Column:
    """A size in B, KB or MB, the latter with one digit."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.format_string("%.1f KB", n / 1024.0)).when(n.isNotNull(), F.format_string("%.1f MB", n / 1048576.0))


def duration(ms: Column) -> Column:
    """``12s``, or ``3m 12s`` from a minute on."""
    whole = lambda x: F.floor(x).cast("string")
    return F.when(ms < 60000, F.concat(whole(ms / 1000), F.lit("s"))).otherwise(F.concat(whole(ms / 60000), F.lit("m "), whole((ms % 60000) / 1000), F.lit("s")))


def chunk_of(start: Column, chunks: int, width: float = 30.0) -> Column:
    """The chunk a time falls in; times beyond the last chunk are in it."""
    return F.least(F.floor(start / width), F.lit(chunks - 1))


def time_limit(chars: Column, video: Column, scan: Column) -> Column:
    """Minutes: three, one for each further 50,000 characters begun, seven for a video, five for a scan."""
    extra = F.greatest(F.lit(0), F.ceil((chars - 50000) / 50000.0))
    more = lambda c, n: F.when(c, n).otherwise(0)
    return (3 + extra + more(video, 7) + more(scan, 5)).cast("int")
