"""Clean texts line by line, then reject those that lose too much.

Each line is judged by its own words: noise (words carrying runs of marks, or marks that
stand alone), navigation (words between bars, bullets, slashes or arrows), stutter (words
that repeat the word before), boilerplate (licence, consent and subscription phrases) and
punctuation (several words, none of which closes a sentence; lines of hard-wrapped prose are
judged with those that carry them on).  Short lines without a closing
mark are navigation where several follow one another.  Failing lines are removed.  A text is rejected
if the removed lines held more than a given share of its words, or by the base rules on its
length and on repeated passages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: A run of marks, a bar or bullet that stands by itself, what else parts a trail of links, and words of marks alone.
MARKS = r"[#$%&*!?|<>=~^+_]{2,}"
BARS = r"[ \t][|»•·][ \t]"
TRAIL = r"(?<![^ \t])[|»•·>/›→\\](?![^ \t])"
ALONE = r"(?<![^ \t])[#$%&*!?|~^_@]+(?![^ \t])"

#: A word that closes a sentence or a clause before a list, with quotes and brackets after its mark.
CLOSED = r"[.!?…:;。！？：；।؟۔][\"'”’»›)\]}」』]*(?![^ \t\r])"

#: Least words of a line that must hold a closed word, most words of a link in a menu, and links in a row that make one.
OPEN_WORDS = 8
LINK_WORDS = 3
MENU_LINES = 3

#: Most characters of a line of hard-wrapped prose, and lines on either side that may close what it leaves open.
WRAPPED = 120
NEAR_LINES = 4

#: Phrases of lines that belong to a page and not to its text.
BOILERPLATE = (
    "licensed under", "released under", "all rights reserved", "spdx-license-identifier", "general public license", "terms of service",
    "terms of use", "privacy policy", "cookie policy", "accept cookies", "enable javascript", "subscribe to our", "sign up for", "copyright ©", "copyright (c)",
)

#: Base rules: least words, and the most percent of words in repeated windows of eight.
LEAST_WORDS = 20
WINDOW = 8
MOST_REPEATED = 30

#: Most percent of a text's words that failing lines may hold.
MOST_LOST = 50


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))


def line_fails(line: Column, words: Column, is_open: Column, is_carried: Column) -> Column:
    """Whether a line of these words, ``is_open`` without a closed one, fails one of the rules on lines.

    ``is_carried``: the lines that carry it on, or that it carries on, hold a closed word.
    """
    n_words, marks = F.size(words), _count(line, MARKS)
    bars = F.when(F.rlike(line, F.lit("[|»•·]")), _count(F.concat(F.lit(" "), line, F.lit(" ")), BARS)).otherwise(0)
    noise = (marks >= 2) & (marks * 4 >= n_words)
    navigation = (bars >= 2) & (bars * 5 >= n_words)
    stutter = F.size(F.filter(words, lambda x, i: (i > 0) & (x == F.get(words, i - 1))))
    trail, alone = _count(line, TRAIL), _count(line, ALONE)
    unclosed = is_open & ((n_words >= OPEN_WORDS) & ~is_carried | (trail >= 2) & (trail * 5 >= n_words) | (alone >= 2) & (alone * 4 >= n_words))
    low = F.lower(line)
    phrase = F.lit(False)
    for words_of_it in BOILERPLATE:
        phrase = phrase | F.contains(low, F.lit(words_of_it))
    return noise | navigation | unclosed | phrase | (n_words >= 5) & (stutter * 5 >= n_words * 2)


def is_carried(lines: Column, i: Column) -> Column:
    """Whether a line near ``i``, with nothing but wrapped lines between, holds a closed word.

    A line is wrapped if the next one follows at once and begins with a word that the longer
    of the two had no room for.
    """
    def goes_on(k: Column) -> Column:
        line, after = F.get(lines, k), F.get(lines, k + 1)
        longer = F.greatest(*(F.length(F.rtrim(x["line"])) for x in (line, after)))
        fits = F.length(F.rtrim(line["line"])) + 1 + F.length(after["words"][0]) <= longer
        return F.coalesce((after["at"] == line["at"] + 1) & ~fits & (longer <= WRAPPED), F.lit(False))

    def closed(k: Column) -> Column:
        return ~F.coalesce(F.get(lines, k)["open"], F.lit(True))

    ahead, behind = F.lit(False), F.lit(False)
    for k in range(NEAR_LINES, 0, -1):
        ahead = goes_on(i + (k - 1)) & (closed(i + k) | ahead)
        behind = goes_on(i - k) & (closed(i - k) | behind)
    return ahead | behind


def in_menu(lines: Column, i: Column) -> Column:
    """Whether line ``i`` lies in a row of MENU_LINES or more links."""
    def link(k: int) -> Column:
        return F.coalesce(F.get(lines, i + k)["link"], F.lit(False))

    rows = F.lit(False)
    for first in range(1 - MENU_LINES, 1):
        row = link(first)
        for k in range(first + 1, first + MENU_LINES):
            row = row & link(k)
        rows = rows | row
    return rows


def repeated_words(words: Column) -> Column:
    """Words lying in windows of eight that the text has twice or more.

    Windows are compared by 64-bit hash.  Texts without an equal pair are settled by one
    distinct count; for the others windows are sorted by hash and place, places of equal
    neighbours are put in order, and each covers eight words or as many as lie before the next.
    """
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = F.transform(
        F.array(hashed),
        lambda h: F.when(
            F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
        ).otherwise(F.array().cast("array<bigint>")),
    )

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, step: total + step)

    def repeated(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda p, k: (p["h"] == F.get(pairs, k - 1)["h"]) | (p["h"] == F.get(pairs, k + 1)["h"]))
        return F.transform(F.array(F.sort_array(F.transform(twice, lambda p: p["i"]))), covered)[0]

    def sorted_pairs(w: Column) -> Column:
        return F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def of(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(F.transform(F.array(sorted_pairs(w)), repeated)[0])

    return F.transform(windows, of)[0]


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judge each whole text and clean it.

    Returns (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_lost_words, clean_text, kept).  NULL and empty texts have no words, fail the base rules
    and have an empty clean text.  Rows stand alone, nothing is shuffled; repeated rows and
    NULL ids are returned as they come; an empty table gives an empty result; other columns
    are not carried and cannot clash.
    """
    text = docs.select(F.col(id_col).alias("__fw_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("line"), _words(x).alias("words"), i.alias("at")))
    parts = text.withColumn("lines", F.filter(lines, lambda x: F.size(x["words"]) > 0))
    parts = parts.withColumns({"words": F.flatten(F.transform("lines", lambda x: x["words"])), "opened": F.transform("lines", lambda x: F.struct(
        x["line"].alias("line"), x["words"].alias("words"), x["at"].alias("at"), (~F.rlike(x["line"], F.lit(CLOSED))).alias("open"),
    ))})
    long_open = lambda x: x["open"] & (F.size(x["words"]) >= OPEN_WORDS)
    parts = parts.withColumn("alone", F.transform("opened", lambda x, i: F.struct(
        x["line"].alias("line"), F.size(x["words"]).alias("n"), (x["open"] & (F.size(x["words"]) <= LINK_WORDS)).alias("link"),
        line_fails(x["line"], x["words"], x["open"], F.when(long_open(x), is_carried(F.col("opened"), i)).otherwise(False)).alias("fails"),
    )))
    judged = F.transform("alone", lambda x, i: F.struct(x["line"].alias("line"), x["n"].alias("n"), (x["fails"] | x["link"] & in_menu(F.col("alone"), i)).alias("fails")))
    parts = parts.withColumn("judged", judged)
    full = F.transform("judged", lambda x: x["line"])
    rows = parts.select(
        F.col("__fw_id").alias(id_col),
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("bigint").alias("word_chars"),
        _count(F.col("text"), f"[{SYMBOLS}]").cast("bigint").alias("n_symbols"),
        (F.size("judged") - F.size(F.array_distinct(full))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.aggregate("judged", F.lit(0).cast("bigint"), lambda total, x: total + F.when(x["fails"], x["n"]).otherwise(0)).alias("n_lost_words"),
        F.array_join(F.transform(F.filter("judged", lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_lost_words") <= MOST_LOST * F.col("n_words")))
