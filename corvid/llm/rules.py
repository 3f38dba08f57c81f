"""Quality rules, line first, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases of page furniture, looked for in lower case.
BOILERPLATE = ("accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum",
               "privacy policy", "read more", "sign up for our newsletter", "subscribe to our newsletter", "terms of service", "terms of use")

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Maximal runs without ASCII white space."""
    return F.array_remove(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, n: Column, width: int = 5) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the text.

    The windows are compared by 64-bit hashes.  Only a text with an equal pair of windows
    is looked at more closely: its windows are sorted by (hash, place), those with an equal
    neighbour are put in order of place, and each adds the words not covered by the one before.
    """

    def windows(h):
        return F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    def twice(rows):
        same = lambda r, i, k: F.coalesce(F.get(rows, i + k)["h"] == r["h"], F.lit(False))
        marked = F.transform(rows, lambda r, i: F.when(same(r, i, 1) | same(r, i, -1), r["i"]))
        return F.array_sort(F.array_compact(marked))

    def covered(w):
        rows = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
        step = lambda s, i: F.struct((s["sum"] + i + width - F.greatest(s["end"], i)).alias("sum"), (i + width).alias("end"))
        return F.aggregate(_let(rows, twice), start, step, lambda s: s["sum"])

    found = _let(windows(F.col("hashes")), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))
    return F.when(n < width, F.lit(0)).otherwise(found).cast("long")


def _count(text: Column, of: str) -> Column:
    return F.length(text) - F.length(F.translate(text, of, ""))


def line_fails(line: Column, nav: int = 3, symbol_share: float = 0.1, shouts: int = 3) -> Column:
    """Whether a line is page furniture rather than prose.

    * navigation: ``nav`` separators (| > and bullets) or more, one for every four words at least;
    * punctuation: ``symbol_share`` of its characters or more are symbols, or ``shouts`` words
      or more end in doubled marks;
    * boilerplate: it holds one of ``BOILERPLATE``.
    A line without a word never fails; it has nothing to lose.
    """
    low = F.lower(line)
    spaces = _count(line, SPACE)
    seps = _count(line, "|>\u00bb\u203a\u2022\u00b7")
    symbols = _count(line, "#*$%&<>{}^~=_\\")
    return ((seps >= nav) & (seps * 4 >= spaces)) | ((symbols >= 3) & (symbols >= symbol_share * F.length(line))) | (
        F.regexp_count(line, F.lit("[!?][!?]")) >= shouts) | low.rlike("|".join(BOILERPLATE))


def quality_rules(docs: DataFrame, max_lost: float = 0.5, min_words: int = 10, max_repeat: int = 20) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    clean_text) for every row of ``docs`` (doc_id, text; other columns are ignored).

    ``kept``: the base rules hold, and the lines that ``line_fails`` removes hold no more than
    ``max_lost`` of the characters in words.  A null text has no words (base_failed).  The work
    is local to a row: no shuffle, so no key can gather rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("words", words_of(F.col("text")))
    rows = rows.select("doc_id", "text", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
                       F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0).alias("lines"))
    rows = rows.withColumn("repeat", repeated_words(F.col("hashes"), F.col("n"))).withColumn("good", F.filter("lines", lambda x: ~line_fails(x)))
    chars = F.length(F.translate("text", SPACE, "")).cast("long")
    rows = rows.select(
        "doc_id", F.col("n").cast("long").alias("n_words"), chars.alias("word_chars"), _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.col("repeat").alias("n_repeat_words"),
        ((F.col("n") < min_words) | (100 * F.col("repeat") > max_repeat * F.col("n"))).alias("base_failed"), F.array_join("good", "\n").alias("clean_text"))
    left = F.length(F.translate("clean_text", SPACE, ""))
    return rows.withColumn("kept", ~F.col("base_failed") & (left >= (1 - max_lost) * F.col("word_chars")))
