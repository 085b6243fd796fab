"""Line-first quality rules, as DataFrame expressions only.

Each line is judged on its own, by three rules; failing lines are removed and a
document that loses more than ``max_lost`` of its text is rejected.

* Punctuation: runs of symbols or of ``!``/``?`` stand at ``SYMBOL_SHARE`` of the
  words or more (at least ``MIN_RUNS``), or a line of ``MIN_WORDS`` words or more
  holds no sentence punctuation at all.
* Navigation: separators of menus and breadcrumbs, at least two of them and one
  for five words.
* Boilerplate: a phrase of ``BOILERPLATE``.

Beside them stand counts of the whole text: words, their characters, symbols,
repeated lines, and words inside five-word windows that come twice or more.
Everything is computed within the row, with no shuffle; the cost of a text is
n log n in its words at most (repeated windows are looked for by hash first and
sorted only where a hash repeats).

Defined cases: null or blank text has no words and is rejected; texts of any
length are read whole; equal lines are repeats whatever their number; repeated
rows, null ids and extra columns stay as they are, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import numbered

#: White space of the word rule, as a regular-expression class body.
BLANK = r"\x20\x09-\x0D"
#: Fewest words of a document, and the largest share (percent) of repeated words.
MIN_DOC_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Words of a repeated window.
WINDOW = 5
#: Line rules.
SYMBOL_RUN = r"[#*$%&<>]{2,}|[!?]{2,}"
SYMBOL_SHARE, MIN_RUNS = 0.3, 2
MIN_WORDS = 5
SENTENCE_MARK = r"[.!?:;\x{2026}\x{3002}\x{FF01}\x{FF1F}]"
SEPARATOR = r"[|\x{BB}\x{203A}\x{2022}\x{B7}]"
#: Phrases of lines that are no content.
BOILERPLATE = [
    "accept all cookies", "all rights reserved", "click here to", "cookie policy", "enable javascript",
    "javascript is disabled", "lorem ipsum", "privacy policy", "sign up for our newsletter", "skip to content",
    "subscribe to our newsletter", "terms of service", "terms of use", "we use cookies"]
#: Largest share of a document's text (characters of its lines) that its failing lines may hold.
MAX_LOST = 0.3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{BLANK}]+"))


def _window(w: Column, i: Column) -> list[Column]:
    return [F.get(w, i + k) for k in range(WINDOW)]


def _covered(words: Column) -> Column:
    """Words in windows whose strings repeat, by sorting the windows."""
    def at(w: Column) -> Column:
        keyed = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.struct(
            F.concat_ws(" ", *_window(w, i)).alias("k"), i.alias("i"))))
        return let(keyed, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False))
                     | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False))), lambda x: x["i"])))

    total = F.aggregate(at(words), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda acc, i: F.struct(
        (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"), (i + WINDOW).alias("end")))
    return total["n"]


def _window_hashes(words: Column) -> Column:
    """Hash of the five words from each position, put together from pairs of
    pairs; the last four positions have no whole window and are cut off."""
    def pairs(a: Column, shift: int, b: Column) -> Column:
        return F.zip_with(a, F.slice(b, shift + 1, F.greatest(F.size(b) - shift, F.lit(0))), lambda x, y: F.xxhash64(x, y))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(
        pairs(h, 1, h), lambda two: F.slice(pairs(pairs(two, 2, two), 4, h), 1,
                                                    F.greatest(F.size(h) - WINDOW + 1, F.lit(0)))))


def repeated_words(words: Column) -> Column:
    def counted(w: Column) -> Column:
        unique = let(_window_hashes(w), lambda h: F.size(F.array_distinct(h)) == F.size(h))
        return F.when(F.size(w) < WINDOW, 0).when(unique, 0).otherwise(_covered(w))
    return let(words, counted).cast("long")


def boilerplate(text: Column) -> Column:
    return let(F.lower(text), lambda t: reduce(or_, [F.contains(t, F.lit(p)) for p in BOILERPLATE]))


def line_fails(line: Column) -> Column:
    """True for a line that one of the three rules removes."""
    n = F.size(words_of(line))
    runs = F.size(F.regexp_extract_all(line, F.lit(f"({SYMBOL_RUN})"), F.lit(1)))
    marks = F.size(F.regexp_extract_all(line, F.lit(f"({SEPARATOR})"), F.lit(1)))
    return let(n, lambda k: ((runs >= MIN_RUNS) & (runs >= SYMBOL_SHARE * k))
               | ((k >= MIN_WORDS) & ~line.rlike(SENTENCE_MARK))
               | ((marks >= 2) & (marks * 5 >= k))
               | boilerplate(line))


def may_fail(text: Column) -> Column:
    """True for every text that has a failing line (and for some others)."""
    return (text.rlike(f"[#*$%&<>{SEPARATOR[1:]}|[!?][!?]") | text.rlike(f"(?:^|\\n)[^\\n{SENTENCE_MARK[1:]}+(?:\\n|$)")
            | boilerplate(text))


def quality_rules(docs: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST,
                  verdict: str = "quality") -> DataFrame:
    """The rows of ``docs`` with the columns n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words (long), base_failed, line_chars, lost_chars
    (long), clean_text (its lines that pass) and kept, all in a struct column
    named ``verdict``, which replaces a column of that name."""
    given = docs.columns
    names = [c for c in given if c != verdict]
    text_col = f"c{given.index(text_col)}"
    docs = numbered(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n")
    full = F.filter(lines, lambda s: s.rlike(f"[^{BLANK}]"))
    def judged(passes: Callable[[Column], Column]) -> Column:
        return let(F.transform(lines, lambda s: F.struct(s.alias("s"), passes(s).alias("bad"))), lambda a: F.struct(
            F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.length(x["s"])).alias("line_chars"),
            F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.when(x["bad"], F.length(x["s"])).otherwise(0)).alias("lost_chars"),
            F.array_join(F.transform(F.filter(a, lambda x: ~x["bad"]), lambda x: x["s"]), "\n").alias("clean_text")))

    whole = F.struct(F.length(F.replace(text, F.lit("\n"), F.lit(""))).cast("long").alias("line_chars"),
                     F.lit(0).cast("long").alias("lost_chars"), text.alias("clean_text"))
    words = words_of(text)
    stats = docs.withColumn("_q", F.struct(
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"),
                                      F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                                      repeated_words(w).alias("n_repeat_words"))).alias("w"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(full, lambda f: F.size(f) - F.size(F.array_distinct(f))).cast("long").alias("n_dup_lines"),
        F.when(may_fail(text), judged(line_fails)).otherwise(whole).alias("l")))
    q, w, line = F.col("_q"), F.col("_q.w"), F.col("_q.l")
    failed = (w["n_words"] < MIN_DOC_WORDS) | (100 * w["n_repeat_words"] > MAX_REPEAT_PERCENT * w["n_words"])
    return stats.select(*[f"c{given.index(c)}" for c in names], F.struct(
        w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"),
        q["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"), line["line_chars"].alias("line_chars"), line["lost_chars"].alias("lost_chars"),
        line["clean_text"].alias("clean_text"),
        (~failed & (line["lost_chars"] <= max_lost * line["line_chars"])).alias("kept")).alias("verdict")).toDF(*names, verdict)
