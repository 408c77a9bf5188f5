"""Main content of web pages kept as text: path ratios over lines.

Extracted pages have no tags left, so what stands for a line's tag path is: site (host) / line form / normal text, in
which digits, the site's own name and a trailing variable part (the last step of a breadcrumb, the value after a label)
are generalised. For every path the text length and the punctuation of its lines are aggregated and fused to its *mass*
(length times one plus a tenth of the marks), and the nodes of the path are counted as the share of the site's pages that hold it. The
*ratio* of a path is the logarithm of its mass over that share: text that is new on every page has a high ratio, site text of
any length recurs and has a low one. A path's ratio on its own site and that over all sites that use it are fused to the lower one. A path
without support (held by a single page; by two, if it is prose) says nothing of recurrence and gets the ratio ``ALONE``. Ratios are
smoothed along the page, over the lines of a block, and a line is the site's if its smoothed ratio is under ``LOW``.

Menus, glosses and headings refine this: a line all of whose pieces are known from menus is one, word lists and subheadings are the article's,
and a list under a site's heading that leads to links goes with it.

Counts are taken over distinct URLs, so repeated crawls do not turn an article into a template. Texts are hashed once they are read:
the tables hold 64-bit numbers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbarium.plans.runtime import spread, stored

_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", re.I)
_SEPARATED = re.compile(r"\s+[|·•>/]\s+|\s*»\s*|\t+| {3,}")
_END = re.compile(r"[.!?…:;。”»\"')\]]$")
_BULLET = re.compile(r"^(?:[*•-]|\d+[.)])\s+")
_PROSE = re.compile(r"[.!?…。][”»\"')]*$")
_GLOSS = re.compile(r"^(.{1,80}?)\s([–—-])\s(.{1,80})$")


FORMS = ("arrow", "crumbs", "label", "listed", "menu", "prose", "short", "titled")
ARROW, CRUMBS, LABEL, LISTED, MENU, PROSE, SHORT, TITLED = range(8)
#: Smoothed ratio under which a line is the site's.
LOW = math.log(100)
#: Ratio of a path without support.
ALONE = math.log(1000)
#: Weight of a line against each of its neighbours in the smoothing.
OWN = 8


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m.group(1).lower() if m else ""


def is_scan(lines: list[str]) -> bool:
    """Whether lines look like the printed lines of a page: most lines of running text break off inside a sentence.

    Menus, word lists and labels are no running text: they hold a separator or fewer than five words.
    """
    every = [x.strip() for x in lines if x.strip()]
    if any(len(x) > 140 for x in every):
        return False
    long = [x for x in every if len(x) >= 25 and len(x.split()) >= 5 and not _SEPARATED.search(x) and not _GLOSS.match(x)]
    return len(long) >= 3 and sum(not _END.search(x) for x in long) >= 0.4 * len(long)


def path_of(line: str, host: str) -> tuple[str, str, list[str], list[str]]:
    """(form, path, menu pieces, glosses) of a line that is not blank."""
    s = line.strip()
    arrow = s.startswith(("›", "»", "→"))
    if arrow:
        return "arrow", "›", [], []
    s = _BULLET.sub("", s)
    label = host.removeprefix("www.").split(".")[0]
    if len(label) > 3:
        s = re.sub(re.escape(label), "@", s, flags=re.I)
    s = re.sub(r"\d+", "0", s)
    pieces = [p.strip().lower() for p in _SEPARATED.split(s) if p.strip()]
    m = _GLOSS.match(s)
    if m and len(pieces) < 2:
        listed = m.group(2) == "—"
        return ("listed" if listed else "titled"), s.lower(), [], [m.group(3).strip().lower()] * 2 if listed else [m.group(1).strip().lower(), m.group(3).strip().lower()]
    if len(pieces) >= 2 and not _PROSE.search(s):
        if "»" in s:
            return "crumbs", " » ".join(pieces[:-1]) + " » *", pieces[:-1], []
        return "menu", " | ".join(sorted(pieces)), pieces, []
    if _PROSE.search(s) and len(s) > 25:
        return "prose", s.lower(), [], []
    m = re.match(r"^([^:]{3,30}):\s(\S+(?:\s\S+)?)$", s)
    if m:
        return "label", m.group(1).lower() + ": *", [], []
    return "short", s.rstrip(" »").lower(), [], []


LINE_SCHEMA = "doc long, url string, host string, line_no int, form byte, path string, pieces array<string>, gloss array<string>, chars int, marks int, gap boolean"


def page_lines(df: DataFrame, key: str, url: str, content: str) -> DataFrame:
    """Every line that is not blank of every content that is no scan, with its path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, u, text in zip(b["doc"], b["url"], b["content"]):
                lines = text.split("\n")
                if is_scan(lines):
                    continue
                host, gap = host_of(u), True
                for i, line in enumerate(lines):
                    if not line.strip():
                        gap = True
                        continue
                    form, path, pieces, gloss = path_of(line, host)
                    marks = sum(c in ".,;:!?…«»“”" for c in line)
                    rows.append((doc, u, host, i, FORMS.index(form), path, pieces, gloss, len(line), marks, gap))
                    gap = False
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINE_SCHEMA.split(", ")])

    src = df.where(F.col(content).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.col(content).alias("content"))
    return spread(src).mapInPandas(run, LINE_SCHEMA)


def hashed_lines(df: DataFrame, key: str, url: str, content: str) -> DataFrame:
    """:func:`page_lines` with 64-bit numbers for page, site, path, pieces and glosses."""
    page = F.when(F.col("url") == "", F.concat(F.lit("#"), F.col("doc").cast("string"))).otherwise(F.col("url"))
    number = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    return page_lines(df, key, url, content).select(
        "doc", "line_no", "form", "chars", "marks", "gap", F.xxhash64("host").alias("host"), F.xxhash64(page).alias("page"), F.xxhash64("path").alias("path"),
        (F.col("path") == "@").alias("name"), number("pieces").alias("pieces"), number("gloss").alias("gloss"),
    )


def ratio(mass: Column, pages: Column, of: Column, prose: Column) -> Column:
    """The ratio of a path held by ``pages`` of the ``of`` pages of its site."""
    least = F.when(prose, 3).otherwise(2)
    return F.when(pages >= least, F.log(F.log1p(mass) * of / pages)).otherwise(ALONE)


def path_ratios(lines: DataFrame) -> DataFrame:
    """(``host``, ``path``, ``ratio``, ``n_menu``, ``n_gloss``, ``menu_share``): the fused ratio of every path of a site, how often its text is a
    menu's piece or a gloss, and the share of its own pieces that menus know."""
    sites = lines.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("site_pages"))
    per = lines.groupBy("host", "path").agg(
        F.count_distinct("page").alias("pages"), F.avg("chars").alias("chars"), F.avg("marks").alias("marks"), F.max(F.col("form") == PROSE).alias("prose"),
        F.count("*").alias("n"), F.any_value("pieces").alias("pieces"), F.any_value("gloss").alias("gloss"),
    )
    per = stored(per.join(sites, "host").withColumn("mass", F.col("chars") * (1 + F.col("marks") / 10)).drop("chars", "marks"), "p4-paths")
    overall = per.groupBy("path").agg(
        F.sum("pages").alias("all_pages"), F.sum("site_pages").alias("all_site_pages"), F.sum("n").alias("n"), F.any_value("pieces").alias("pieces"), F.any_value("gloss").alias("gloss")
    )
    overall = stored(overall, "p4-overall")
    menu = overall.select(F.explode("pieces").alias("path"), "n").groupBy("path").agg(F.sum("n").alias("n_menu"))
    glosses = overall.select(F.explode("gloss").alias("path"), "n").groupBy("path").agg(F.sum("n").alias("n_gloss"))
    pieces = overall.select(F.col("path").alias("of"), F.explode("pieces").alias("path")).join(menu, "path")
    known = pieces.groupBy(F.col("of").alias("path")).agg(F.avg((F.col("n_menu") >= 2).cast("int")).alias("menu_share"))
    overall = overall.select("path", "all_pages", "all_site_pages").join(menu, "path", "left").join(glosses, "path", "left").join(known, "path", "left").fillna(0)
    here, anywhere = ratio(F.col("mass"), F.col("pages"), F.col("site_pages"), F.col("prose")), ratio(F.col("mass"), F.col("all_pages"), F.col("all_site_pages"), F.col("prose"))
    fused = F.least(here, anywhere)
    # what is glossed as a word more often than it stands in menus is the heading of a word list
    heading = (F.col("n_gloss") > F.col("n_menu")) & (F.col("n_gloss") >= 2)
    return per.join(overall, "path").select("host", "path", F.when(heading, ALONE).otherwise(fused).alias("ratio"), "n_menu", "n_gloss", "menu_share")


def smoothed(by: str = "doc") -> Column:
    """The ratio of a line, averaged with its neighbours in the block: a blank line ends one."""
    w = Window.partitionBy(by).orderBy("line_no")
    before = F.coalesce(F.when(~F.col("gap"), F.lag("ratio").over(w)), F.col("ratio"))
    after = F.coalesce(F.when(~F.lead("gap").over(w), F.lead("ratio").over(w)), F.col("ratio"))
    return (before + OWN * F.col("ratio") + after) / (OWN + 2)


def site_lines(df: DataFrame, key: str, url: str, content: str) -> DataFrame:
    """(``key``, ``line_no``): the lines of web pages that belong to the site.

    Lines are split at ``\\n`` and numbered from 0. Null and empty contents and scans give none; a null URL is a site of its
    own; repeated rows of a key give each line once.
    """
    lines = stored(hashed_lines(df, key, url, content), "p4-lines")
    x = lines.drop("page", "pieces", "gloss", "chars", "marks").join(path_ratios(lines), ["host", "path"])
    w = Window.partitionBy("doc").orderBy("line_no")
    x = x.withColumn("fixed", smoothed() < LOW)
    is_ = lambda *forms: F.col("form").isin(*forms)
    menu_line = is_(MENU, CRUMBS) & (F.col("menu_share") >= 0.5)
    item_of_menu = is_(SHORT) & (F.col("n_menu") >= 2) & (F.col("n_menu") > F.col("n_gloss"))
    x = x.withColumn("site", (F.col("fixed") & ~is_(ARROW) | menu_line | item_of_menu | F.col("name")) & ~is_(TITLED, LISTED))
    # a list under a fixed heading: arrows, glossed and bare entries without a gap (a known gloss over a paragraph is a
    # subheading); the heading is one that leads to arrows
    nxt = lambda c, k: F.lead(c, k).over(w)
    arrow_near = F.greatest(*(F.coalesce((nxt("form", k) == ARROW).cast("int"), F.lit(0)) for k in (1, 2, 3)))
    x = x.withColumns({"leads": F.col("site") & is_(SHORT) & ~F.coalesce(nxt("site", 1), F.lit(True)), "near": arrow_near, "next": nxt("form", 1)})
    x = stored(x.select("doc", "line_no", "form", "gap", "path", "site", "leads", "near", "next", "n_gloss"), "p4-judged")
    heads = x.where("leads").groupBy("path").agg(F.avg("near").alias("arrows")).where("arrows >= 0.2").select("path", F.lit(True).alias("head"))
    x = x.join(heads, "path", "left")
    head = F.coalesce("head", F.lit(False)) & F.col("site")
    entry = ~F.col("site") & ~F.col("gap") & (is_(ARROW, TITLED) | (is_(SHORT) & ((F.col("n_gloss") < 2) | (F.coalesce("next", F.lit(-1)) != PROSE))))
    state = F.when(head, F.lit(1)).when(entry, F.lit(None)).otherwise(F.lit(0))
    x = x.withColumn("state", state).withColumn("open", F.last("state", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("site", F.col("site") | (F.col("state").isNull() & (F.col("open") == 1)) | is_(ARROW))
    return x.where("site").select(F.col("doc").alias(key), "line_no").distinct()


def main_content(df: DataFrame, key: str, url: str, content: str) -> DataFrame:
    """(``key``, ``body``): the content without its site lines, blank runs reduced to one; unchanged where none was found."""
    drop = site_lines(df, key, url, content).groupBy(key).agg(F.collect_set("line_no").alias("__drop"))
    src = df.select(key, F.col(content).alias("__content")).join(drop, key, "left")
    kept = F.expr("array_join(transform(filter(transform(split(__content, '\\n', -1), (x, i) -> struct(x as x, i as i)), y -> not array_contains(coalesce(__drop, array()), y.i)), y -> y.x), '\\n')")
    return src.select(key, F.when(F.col("__drop").isNull(), F.col("__content")).otherwise(F.trim(F.regexp_replace(kept, r"\n{3,}", "\n\n"))).alias("body"))
