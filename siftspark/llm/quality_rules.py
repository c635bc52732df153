"""Line-first quality rules, in native expressions.

Each line is judged on its own: too much punctuation, navigation, boilerplate, or a
repeat of an earlier line. Failing lines go, and a document that loses too much of its
text with them is rejected. A document's words, lines and windows are arrays within its
row, so nothing is shuffled; windows are compared by sorting, not pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.llm.common import WORD, let

SYMBOLS = r"[#*$%&|<>]"
#: Phrases that mark a short line as boilerplate.
BOILERPLATE = ("cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "sign up for", "subscribe to our", "click here", "share this", "skip to content", "lorem ipsum")
#: Words up to which a line with such a phrase is boilerplate.
BOILERPLATE_WORDS = 20
#: Symbols, bars or exclamations a word from which a line fails; capital words a word.
PER_WORD, CAPITALS = 0.4, 0.7
#: The share of a document's text that its failing lines may hold.
MOST_LOST = 0.3


def line_fails(line: Column) -> Column:
    """True for a line that the rules remove; a line without words never fails."""

    def judge(x: Column) -> Column:
        n = F.regexp_count(x, F.lit(WORD))
        symbols = F.regexp_count(x, F.lit(SYMBOLS + "|!!"))
        capitals = F.regexp_count(x, F.lit(r"\p{Lu}{2,}"))
        phrase = F.lower(x).rlike("|".join(BOILERPLATE))
        return let(n, lambda words: (words > 0) & ((symbols >= PER_WORD * words) | ((words >= 3) & (capitals >= CAPITALS * words)) | ((words <= BOILERPLATE_WORDS) & phrase)))

    return let(line, judge)


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, the first place included.

    Windows are compared by 64-bit hashes of word hashes, sorted with their places;
    texts in which all windows differ are not sorted.
    """

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(rows: Column) -> Column:
            last = F.size(rows) - 1
            twin = lambda r, i: ((i > 0) & (F.get(rows, i - 1)["h"] == r["h"])) | ((i < last) & (F.get(rows, i + 1)["h"] == r["h"]))
            return F.array_sort(F.transform(F.filter(rows, twin), lambda r: r["i"]))

        gaps = lambda at: F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(ordered, places), gaps))

    window = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(let(hashes, window), covered)).cast("long")


def _judged(text: Column) -> Column:
    """All figures of one text as a struct."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))

    def by_lines(found: Column) -> Column:
        good = F.array_distinct(F.filter(found, lambda x: ~line_fails(x)))
        chars = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
        return let(good, lambda kept: F.struct((F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"), chars(found).alias("chars"), chars(kept).alias("kept_chars"), (F.size(found) - F.size(kept)).cast("long").alias("removed_lines"), kept.alias("lines")))

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    by_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("word_chars"), repeated_words(w).alias("n_repeat_words"))
    return F.struct(let(words, by_words).alias("w"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), let(lines, by_lines).alias("l"))


def judge(docs: DataFrame, text_col: str = "text", least_words: int = 50, most_repeated: int = 50, most_lost: float = MOST_LOST) -> DataFrame:
    """(row, quality): row is the whole row of docs; quality has its figures, base_failed, lost, kept and the cleaned text.

    A document fails the base if it has fewer than least_words words or more than
    most_repeated per cent of them lie in repeated windows. lost is the share of the
    characters of lines with a word that failing and repeated lines hold (none: 0). A
    text that loses no line stays as it is, else its remaining lines are joined by
    newlines. A null text has no words: all figures are 0, it fails, its clean text is
    null. Repeated rows are judged alike; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), let(text, _judged).alias("j"))
    found = rows.select("row", "j.w.n_words", "j.w.word_chars", "j.n_symbols", "j.l.n_dup_lines", "j.w.n_repeat_words", "j.l.removed_lines", F.col("j.l.lines").alias("lines"), F.when(F.col("j.l.chars") > 0, 1 - F.col("j.l.kept_chars") / F.col("j.l.chars")).otherwise(0.0).alias("lost"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    clean = F.when(F.col("removed_lines") == 0, F.col(f"row.`{text_col}`")).otherwise(F.array_join("lines", "\n"))
    return found.select("row", F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_lines", "lost", failed.alias("base_failed"), (~failed & (F.col("lost") <= most_lost)).alias("kept"), clean.alias("clean")).alias("quality"))
