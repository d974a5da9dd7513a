"""Line-first quality rules with DataFrame expressions only.

Each line of a text is held against punctuation, navigation and boilerplate rules; failing lines are
removed, and a document that loses too much of its text is rejected.

Defined cases: null text: no words, so ``base_failed``.  Empty lines are neither failures nor kept text.
Repeated rows are judged each by itself.  Other columns of the input are carried along by ``clean_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: A line failing these is a removal.  Share of symbols among its characters, at most.
MAX_SYMBOL_SHARE = 0.2
#: Separators of menu items a line may have for each word, at most.
MAX_SEPARATOR_SHARE = 0.5
#: A document must keep this share of its words' characters.
MIN_KEPT_SHARE = 0.5
#: Phrases of boilerplate lines (lower case).
BOILERPLATE = "cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|subscribe to our|sign up for|log in to|click here|read more|lorem ipsum|share this|skip to content|back to top"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def bare(text: Column) -> Column:
    return without(text, " \t\n\x0b\x0c\r")


def line_passes(line: Column) -> Column:
    """The rules of one line, which has a word."""
    chars = F.length(bare(line))
    symbols = chars - F.length(without(bare(line), SYMBOLS))
    n_words = F.size(F.split(F.trim(line), "[ \\t-\\r]+"))
    separators = F.length(line) - F.length(without(line, "|»›•·"))
    punctuation = symbols <= MAX_SYMBOL_SHARE * chars
    navigation = ~((separators >= 2) & (separators > MAX_SEPARATOR_SHARE * n_words))
    boilerplate = ~((n_words <= 25) & F.lower(line).rlike(BOILERPLATE))
    return punctuation & navigation & boilerplate


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\\n"), lambda x: F.length(bare(x)) > 0)


def quality(documents: DataFrame) -> DataFrame:
    """``doc_id``, base counts, ``n_lines_removed``, ``kept_chars``, ``base_failed`` and ``kept``."""
    text = F.coalesce("text", F.lit(""))
    first = documents.select("doc_id", text.alias("text")).select("doc_id", "text", words_of(F.col("text")).alias("words"))
    n = F.size("words")
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(F.col("words"), i + j) for j in range(5)]))).otherwise(F.expr("cast(array() as array<bigint>)"))
    second = first.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(bare(F.col("text"))).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        lines_of(F.col("text")).alias("lines"),
        windows.alias("windows"),
    )
    # Windows are sorted as (hash, place), only where one repeats, so equal ones are neighbours.
    # Marked places, in order, cover min(5, distance to the next) words each.
    none = F.expr("cast(array() as array<struct<hash:bigint,place:int>>)")
    packed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("hash"), i.alias("place"))))
    third = second.select(
        "*",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.filter("lines", lambda x: line_passes(x)).alias("good"),
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), none).otherwise(packed).alias("packed"),
    )
    near = lambda x, j: F.coalesce(x["hash"] == F.get(F.col("packed"), j)["hash"], F.lit(False))
    marked = F.sort_array(F.transform(F.filter("packed", lambda x, i: near(x, i - 1) | near(x, i + 1)), lambda x: x["place"]))
    fourth = third.select("*", marked.alias("marked"))
    covered = F.aggregate(F.transform("marked", lambda p, i: F.least(F.lit(5), F.coalesce(F.get(F.col("marked"), i + 1) - p, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    kept_chars = F.aggregate("good", F.lit(0), lambda a, x: a + F.length(bare(x)))
    fifth = fourth.select("*", covered.cast("long").alias("n_repeat_words"), kept_chars.cast("long").alias("kept_chars"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return fifth.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("kept_chars") >= MIN_KEPT_SHARE * F.col("word_chars"))).alias("kept"),
        (F.size("lines") - F.size("good")).cast("long").alias("n_lines_removed"),
        "kept_chars",
    )


def clean_lines(documents: DataFrame) -> DataFrame:
    """The documents with failing lines removed from ``text``; lines without words stay where they are."""
    good = F.filter(F.split("text", "\\n"), lambda x: (F.length(bare(x)) == 0) | line_passes(x))
    return documents.withColumn("text", F.array_join(good, "\n"))
