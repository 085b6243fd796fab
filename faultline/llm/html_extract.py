"""Main text of web pages, with nearest-URL page differencing.

A page is read into blocks (lines) in page order. Markup says of most blocks
what they are: menus, headers, footers, sidebars, notices, adverts, forms,
reader comments, scripts and styles go; what stands inside ``article`` (or, if
there is none, ``main``) is the article and its paragraphs, headings, lists and
tables stay, since a sentence that two articles share is still text. A class or
id marks an element where it is wholly one of the known words; a compound of
them (``with-sidebar``, ``related-work``) proves nothing about an article around
or inside which it stands. All blocks that this leaves open, those of an article
outside its paragraphs or under such a compound name and those of pages without
an article, are decided by the method: pages are paired by URL path within each
host, the lines of a pair are aligned by their longest common subsequence, and
shared lines, the site's own, are deleted.

Pairing is exact and has no per-host group: 64-bit line hashes are range
partitioned by (host, path, id), so a large host spreads over many partitions,
and each partition also gets the row before and the row after it. A page is
compared with whichever of its two neighbours on the same host shares the
longer beginning of the path (the one before, if equal). Pages of one path with
the same lines (as under ``?ref=`` or ``#top``) count as one, and its result goes
back to all of them. A neighbour with just
the same lines is a copy and proves nothing: the other one is taken.

Defined cases: null or empty html gives the empty text; a null url has no host
and no neighbours; texts of any length are read whole; unclosed or truncated
markup is closed at its end; repeated rows give a row each, with equal texts; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import map_batches, prepare, shuffle_partitions, utf8
from faultline.session import materialize

#: Elements that begin and end a block (fixed values).
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody tfoot thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is no article text.
DROPPED = frozenset(
    "aside audio button canvas datalist dialog footer form frameset head iframe map menu nav noframes noscript object "
    "script select style svg template textarea title video".split())
#: Words of class and id names, and roles, that mark the same.
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices "
    "overlay pager pagination popup promo promotion related recommended reply respond search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription toolbar widget".split())
#: First words of compound names that mark an element inside an article.
DROPPED_FIRST = frozenset("ad ads advert comment comments cookie disqus newsletter promo sidebar sponsor sponsored subscribe".split())
#: Elements whose text is an article's own.
PARAGRAPHS = HEADINGS | frozenset("blockquote caption dd dt figcaption li p pre table".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form navigation search".split())
#: An open paragraph ends where one of these begins.
ENDS_PARAGRAPH = BLOCKS - frozenset("body caption dd dt head html legend li optgroup option tbody tfoot thead title tr".split())

DROP, KEEP, OPEN = 0, 1, 2
#: Pages of a partition that are compared by one task.
PART_ROWS = 10_000


class PageReader(HTMLParser):
    """Blocks (text, state) of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # element, drops its content, is a header that keeps headings, has a compound name, begins an article
        self.stack: list[tuple[str, bool, bool, bool, bool]] = []
        self.dropped = self.headers = self.headings = self.paragraphs = 0
        self.doubtful = [0]  # elements of compound names, counted anew inside an article
        self.inside = {"article": 0, "main": 0}
        self.parts: list[str] = []
        self.blocks: list[tuple[str, bool, bool, bool, bool, bool]] = []  # text, dropped, doubtful, paragraph, in article, in main

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            gone = self.dropped > 0 or (self.headers > 0 and not self.headings)
            self.blocks.append((text, gone, self.doubtful[-1] > 0, self.paragraphs > 0, self.inside["article"] > 0, self.inside["main"] > 0))

    def _pop(self) -> None:
        tag, drops, header, doubtful, begins = self.stack.pop()
        if begins:
            self.doubtful.pop()
        self.doubtful[-1] -= doubtful
        self.dropped -= drops
        self.paragraphs -= tag in PARAGRAPHS
        self.headers -= header
        self.headings -= tag in HEADINGS
        if tag in self.inside:
            self.inside[tag] -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
        elif tag in ("br", "td", "th"):
            self.parts.append(" ")
        if tag in ENDS_PARAGRAPH and any(x[0] == "p" for x in self.stack):
            self._close("p")
        if tag in VOID:
            return
        named = dict(attrs)
        names = set(f"{named.get('class') or ''} {named.get('id') or ''}".lower().split())
        parts = [re.split(r"[^a-z0-9]+", n) for n in names]
        header = tag == "header" or "header" in names
        in_article = self.inside["article"] or self.inside["main"]
        marked = bool(names & DROPPED_NAMES) or (bool(in_article) and any(p[0] in DROPPED_FIRST for p in parts))
        frame = tag == "form" and not in_article  # a form may hold the whole page
        doubtful = tag in BLOCKS and (frame or any(x in DROPPED_NAMES or x == "header" for p in parts if len(p) > 1 for x in p))
        drops = ((tag in DROPPED and not frame) or marked or "hidden" in named
                 or (named.get("role") or "").lower() in DROPPED_ROLES
                 or (named.get("aria-hidden") or "").lower() == "true"
                 or "display:none" in (named.get("style") or "").lower().replace(" ", "")
                 or (header and not in_article))
        if tag in ("article", "main", "body", "html") and tag not in DROPPED:
            drops, doubtful = marked and tag == "article", False  # such as a reader's comment
        if tag in BLOCKS or drops:
            if drops or doubtful:
                self.flush()
            keeps_headings = header and bool(in_article) and not drops
            begins = tag in self.inside and not self.inside[tag] and not self.inside["article"]
            self.stack.append((tag, drops, keeps_headings, doubtful, begins))
            self.doubtful[-1] += doubtful
            if begins:
                self.doubtful.append(0)
            self.dropped += drops
            self.paragraphs += tag in PARAGRAPHS
            self.headers += keeps_headings
            self.headings += tag in HEADINGS
            if tag in self.inside:
                self.inside[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as in HTML, the slash of an element that can have content says nothing

    def _close(self, tag: str) -> None:
        if any(x[0] == tag for x in self.stack):
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        elif any(x[0] == tag and x[1] for x in self.stack):
            self.flush()
        self._close(tag)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def read_page(html: str) -> list[tuple[str, int]]:
    """Blocks of a page in order, with DROP, KEEP or OPEN."""
    reader = PageReader()
    reader.feed(html)
    reader.close()
    reader.flush()
    in_article = any(article and not gone for _, gone, _, _, article, _ in reader.blocks)
    in_main = any(main and not gone for _, gone, _, _, _, main in reader.blocks)
    out = []
    for text, gone, doubtful, paragraph, article, main in reader.blocks:
        if gone:
            out.append((text, DROP))
        elif not (in_article or in_main):
            out.append((text, DROP if doubtful else OPEN))
        elif not (article if in_article else main):
            out.append((text, DROP))
        else:
            out.append((text, KEEP if paragraph and not doubtful else OPEN))
    return out


def host_and_path(url: str | None) -> tuple[str | None, str]:
    try:
        u = urlsplit(url or "")
        return (u.hostname or None), u.path.rstrip("/")
    except ValueError:
        return None, ""


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b`` (bit-parallel rows)."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    shared = set(a[start:len(a) - end]) & set(b[start:len(b) - end])
    left = [i for i in range(start, len(a) - end) if a[i] in shared]
    right = [x for x in b[start:len(b) - end] if x in shared]
    masks: dict[int, int] = {}
    for bit, i in enumerate(left):
        masks[a[i]] = masks.get(a[i], 0) | 1 << bit
    full, rows = (1 << len(left)) - 1, []
    v = full
    for x in right:
        u = v & masks[x]
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    middle = []
    j, row = len(left) - 1, len(right) - 1
    while j >= 0 and row >= 0:
        if rows[row] >> j & 1:
            j -= 1  # no longer with this line than without
        elif row and not rows[row - 1] >> j & 1:
            row -= 1
        else:
            middle.append(left[j])
            j, row = j - 1, row - 1
    return [*range(start), *reversed(middle), *range(len(a) - end, len(a))]


def _nearest(path: str, lines: list[int], before, after) -> list[int]:
    """The lines of the neighbour that a page is compared with ([]: none)."""
    near = [n for n in (before, after) if n is not None and n[1] != lines]
    return max(near, key=lambda n: len(os.path.commonprefix([path, n[0]])))[1] if near else []


def mark_shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Shared line positions of the open pages of one partition (ghost rows are neighbours only)."""
    pdf = pdf.sort_values(["host", "path", "page_id", "h", "ghost"], na_position="first", ignore_index=True)
    hosts, paths = pdf["host"].tolist(), pdf["path"].tolist()
    lines = [list(map(int, x)) for x in pdf["lines"]]
    rows = []
    for i, (ghost, is_open) in enumerate(zip(pdf["ghost"], pdf["open"], strict=True)):
        if ghost or not is_open:
            continue
        side = [(paths[j], lines[j]) if 0 <= j < len(pdf) and hosts[j] == hosts[i] and hosts[i] else None for j in (i - 1, i + 1)]
        rows.append((hosts[i], paths[i], pdf["copy"][i], common_lines(lines[i], _nearest(paths[i], lines[i], *side))))
    return pd.DataFrame(rows, columns=["host", "path", "copy", "shared"])


def parse(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Blocks of every page; ``text`` is set where markup decides all of them."""
    def make():
        def run(b):
            out = {k: [] for k in ("host", "path", "lines", "open", "text", "blocks")}
            for url, html in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                blocks = read_page(html.decode("utf-8", "replace"))
                host, path = host_and_path(url)
                is_open = any(s == OPEN for _, s in blocks)
                out["host"].append(host)
                out["path"].append(path)
                out["lines"].append(np.array([xxhash.xxh64_intdigest(t) for t, _ in blocks], np.uint64).view(np.int64))
                out["open"].append(is_open)
                out["text"].append(None if is_open else "\n".join(t for t, s in blocks if s == KEEP))
                out["blocks"].append([{"text": t, "state": s} for t, s in blocks] if is_open else None)
            return {"page_id": b.column(0), "url": b.column(1), "h": b.column(2), **out}
        return run

    url = F.col(url_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"),
                        F.xxhash64(url, F.col(html_col)).alias("h"), utf8(html_col).alias("html"))
    return map_batches(rows, make, "page_id long, url string, h long, host string, path string, lines array<long>, "
                       "open boolean, text string, blocks array<struct<text string, state int>>")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): one row per input row."""
    spark = pages.sparkSession
    prepare(spark)
    parsed = materialize(parse(pages, id_col, url_col, html_col))
    order = ["host", "path", "page_id", "h"]
    fields = [*order, "lines", "open"]
    # copies at one path count as one page, whose result goes back to all of them
    parsed = parsed.withColumn("copy", F.xxhash64("lines"))
    one = parsed.groupBy("host", "path", "copy").agg(F.min(F.struct("page_id", "h", "lines")).alias("p"), F.max("open").alias("open")) \
        .select("host", "path", "p.page_id", "p.h", "p.lines", "open", "copy")
    fields.append("copy")
    parts = max(shuffle_partitions(spark), -(-parsed.count() // PART_ROWS))
    ranged = materialize(one.select(*fields).repartitionByRange(parts, *order)
                         .withColumn("part", F.spark_partition_id()))
    # a row before and a row after each partition; the table has a row per partition
    ends = ranged.groupBy("part").agg(F.min(F.struct(*fields)).alias("first"), F.max(F.struct(*fields)).alias("last"))
    w = Window.orderBy("part")
    beside = ends.select("part", F.lag("last").over(w).alias("before"), F.lead("first").over(w).alias("after")) \
        .select("part", F.explode(F.array("before", "after")).alias("r")).filter(F.col("r").isNotNull()).select("r.*", "part", F.lit(True).alias("ghost"))
    marks = ranged.withColumn("ghost", F.lit(False)).unionByName(beside).groupBy("part") \
        .applyInPandas(mark_shared, "host string, path string, copy long, shared array<int>") \
        .withColumnsRenamed({"host": "_host", "path": "_path", "copy": "_copy"})
    decided = parsed.filter(~F.col("open")).select("page_id", "url", "text")
    kept = F.filter("blocks", lambda x, i: (x["state"] == KEEP) | ((x["state"] == OPEN) & ~F.array_contains("shared", i)))
    compared = parsed.filter("open").join(marks, F.col("host").eqNullSafe(F.col("_host")) & (F.col("path") == F.col("_path"))
                                                & (F.col("copy") == F.col("_copy"))) \
        .select("page_id", "url", F.array_join(F.transform(kept, lambda x: x["text"]), "\n").alias("text"))
    return decided.unionByName(compared)
