"""HTML and page text: links, readable text, audio addresses, captions, word-gloss lines, citations."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AUDIO = re.compile(r"\.(mp3|wav|ogg|m4a|aac|flac|webm)$", re.I)
# Elements whose text is not content, and those that hold it.
DROP = {"script", "style", "nav", "footer", "aside", "header", "noscript"}
KEEP = ("article", "main", "body")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Anchors(HTMLParser):
    """Anchors with an address and their text, in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self.open = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            href = dict(attrs).get("href")
            self.open = bool(href)
            if href:
                self.found.append([href.strip(), []])

    def handle_endtag(self, tag: str) -> None:
        self.open = self.open and tag != "a"

    def handle_data(self, data: str) -> None:
        if self.open:
            self.found[-1][1].append(data)


def page_links(page: str, base: str, keyword: str | None = None, most: int = 50) -> list[tuple[str, str]]:
    """(address, text) of the anchors of a page, first seen first, without fragments, scripts and mail."""
    parser = _Anchors()
    parser.feed(page)
    parser.close()
    out: dict[str, str] = {}
    for href, parts in parser.found:
        if href.startswith("#") or href.lower().startswith(("javascript:", "mailto:")):
            continue
        try:
            href = urljoin(base, href)
        except ValueError:
            continue
        text = "".join(parts).strip()
        if len(out) < most and href not in out and (not keyword or keyword.lower() in f"{href}\n{text}".lower()):
            out[href] = text or href
    return list(out.items())


def links(df: DataFrame, key: str, url: str, page: str, keyword: str | None = None, most: int = 50) -> DataFrame:
    """(``key``, ``pos``, ``link``, ``text``): up to ``most`` links of each page (the feature's own limit)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, h, t) for k, u, p in zip(b["k"], b["u"], b["p"]) for i, (h, t) in enumerate(page_links(p, u or "", keyword, most))]
            yield pd.DataFrame(rows, columns=[key, "pos", "link", "text"])

    src = df.where(F.col(page).isNotNull()).select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(page).alias("p"))
    return src.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, pos int, link string, text string")


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.text: dict[str, list[str]] = {k: [] for k in (*KEEP, "title", "h1")}
        self.audio: list[str] = []
        self.firsts: set[str] = set()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in ("audio", "source") and a.get("src"):
            self.audio.append(a["src"])
        if tag == "a" and a.get("href") and _AUDIO.search(a["href"]):
            self.audio.append(a["href"])
        if tag not in VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.stack:
            while self.stack and self.stack.pop() != tag:
                pass
            if tag in self.text and self.text[tag]:
                self.firsts.add(tag)

    def handle_data(self, data: str) -> None:
        if "title" in self.stack and "title" not in self.firsts:
            self.text["title"].append(data)
        if DROP & set(self.stack) or "title" in self.stack:
            return
        for k in (*KEEP, "h1"):
            if k in self.stack and k not in self.firsts:
                self.text[k].append(data)


def read_html(page: str, url: str) -> tuple[str, str, list[str]]:
    """(title, text, audio addresses). The text is that of the first element that holds content, blanks collapsed."""
    r = _Reader()
    r.feed(page)
    r.close()
    join = lambda k: " ".join("".join(r.text[k]).split())
    body = next((t for k in KEEP if (t := join(k))), "")
    audio = []
    for a in r.audio:
        try:
            audio.append(urljoin(url or "", a))
        except ValueError:
            continue
    return join("title") or join("h1") or url or "", body, list(dict.fromkeys(audio))


def html_text(df: DataFrame, key: str, url: str, page: str) -> DataFrame:
    """(``key``, ``title``, ``text``, ``audio_urls``) of each page; binary content gives no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, u, p in zip(b["k"], b["u"], b["p"]):
                if p.startswith("%PDF") or re.search(r"[\x00-\x08\x0e-\x1f]{10,}", p):
                    continue
                rows.append((k, *read_html(p, u)))
            yield pd.DataFrame(rows, columns=[key, "title", "text", "audio_urls"])

    src = df.where(F.col(page).isNotNull()).select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(page).alias("p"))
    return src.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, title string, text string, audio_urls array<string>")


def gloss_lines(df: DataFrame, key: str, content: str) -> DataFrame:
    """(``key``, ``line_no``, ``word``, ``gloss``) of the lines ``word — gloss`` of 3 to 500 characters."""
    x = df.select(key, F.posexplode(F.split(content, "\n", -1)).alias("line_no", "line"))
    m = lambda i: F.trim(F.regexp_extract("line", r"^\s*(\S.*?)\s+[—–-]\s+(\S.*?)\s*$", i))
    return x.where(F.length("line").between(3, 500)).select(key, "line_no", m(1).alias("word"), m(2).alias("gloss")).where("word <> '' and gloss <> ''")


def caption_text(c: Column) -> Column:
    """The text of caption XML, entities written out, pieces joined by blanks."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)<text[^>]*>(.*?)</text>"), F.lit(1))
    out = F.array_join(parts, " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def citations(text: str, urls: list[str], most: int = 300) -> list[tuple[str, str]]:
    """(address, sentence) of each marker ``[n]``: the sentence around it without markers, cut to 100 characters either side
    if it is longer than ``most``; several sentences of one address are joined unless one holds the other."""
    out: dict[str, str] = {}
    for m in re.finditer(r"\[(\d+)\]", text):
        i = int(m.group(1)) - 1
        if not 0 <= i < len(urls):
            continue
        a = max(text.rfind(p, 0, m.start()) for p in (". ", "! ", "? ", "\n"))
        ends = [e for p in (". ", "! ", "? ", "\n") if (e := text.find(p, m.end())) >= 0]
        s = text[a + 1 : min(ends) + 1 if ends else len(text)]
        if len(s) > most:
            s = text[max(0, m.start() - 100) : m.end() + 100]
        s = re.sub(r"\s*\[\d+\]", "", s).strip()
        had = out.get(urls[i])
        out[urls[i]] = s if had is None else had if s in had else f"{had} {s}"
    return [(u, html.unescape(s)) for u, s in out.items()]
