"""Quality rules on words and lines, and the lines that many documents of a host share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaboard.session import Staging

OTHER_SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
LEAST_DOCS = 5
HOST_SHARE = 0.1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once per row; a plain reference would be inlined into each lambda call."""
    return F.transform(F.array(value), body)[0]


def spaced(text: Column, others: str = OTHER_SPACES) -> Column:
    """The text with other white space as spaces; plain replacement is far cheaper here than a pattern or ``translate``."""
    for space in others:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return text


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(spaced(text), " "), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of words which the text has at least twice."""

    def covered(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
            starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
            return _let(
                starts,
                lambda p: F.aggregate(
                    F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window)))),
                    F.lit(0),
                    lambda total, x: total + x,
                ),
            )

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(_let(placed, of))

    places = F.sequence(F.lit(1), F.size(words) - window + 1)
    grams = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(window)]))
    return F.when(F.size(words) > window, _let(grams, covered)).otherwise(F.lit(0)).cast("long")


def normal_lines(text: Column) -> Column:
    """Lines in lower case, runs of white space as one space, no space at the ends; blank lines stay, empty."""
    flat = F.regexp_replace(spaced(F.lower(text), OTHER_SPACES.replace("\n", "")), " {2,}", " ")
    return F.transform(F.split(flat, "\n"), lambda line: F.trim(line))


def common_lines(
    docs: DataFrame, least_docs: int = LEAST_DOCS, host_share: float = HOST_SHARE, host: str = "source"
) -> DataFrame:
    """``host, lines``: digests of the lines in more than the allowed distinct documents of the host.

    A document counts once however many exact copies the host has. Lines are
    counted in two steps that both combine before the shuffle, so neither a hot
    host nor a hot line meets in one task. A host's lines are few: every one is in
    over ``host_share`` of its documents, so there are at most (mean lines of a
    document / host_share) of them.
    """
    base = docs.select(
        F.coalesce(F.col(host), F.lit("")).alias("host"),
        F.xxhash64("text").alias("doc"),
        F.array_distinct(
            F.transform(F.filter(normal_lines(F.col("text")), lambda x: x != ""), lambda x: F.xxhash64(x))
        ).alias("lines"),
    ).where(F.col("text").isNotNull())
    sizes = base.select("host", "doc").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    counted = (
        base.select("host", "doc", F.explode("lines").alias("line"))
        .distinct()
        .groupBy("host", "line").agg(F.count("*").alias("n"))
        .where(F.col("n") > least_docs)
    )
    above = counted.join(sizes, "host").where(F.col("n") > F.col("docs") * F.lit(host_share))
    return above.groupBy("host").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def quality_rules(
    docs: DataFrame,
    stage: Staging,
    least_docs: int = LEAST_DOCS,
    host_share: float = HOST_SHARE,
    host: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Verdict columns for every row of ``docs(doc_id, text, <host>)``; the text comes back as ``clean_text``.

    Lines in over ``max(least_docs, host_share * documents of the host)`` distinct
    documents of the host are removed. ``kept`` is false for documents that fail
    the base rules, and for depleted ones: under ``MIN_WORDS`` words left, or under
    half of their words.

    The common lines are staged first: their size is then known, and Spark
    broadcasts them only if they are small. A null text has no words and fails; a
    null host is a host of its own. Repeated rows each get their verdict. An empty
    table gives no rows. Of other columns only those in ``keep`` pass through.
    Only built-in functions run.
    """
    common = stage(common_lines(docs, least_docs, host_share, host), "common-lines")
    rows = docs.select(
        "doc_id", F.col("text").alias("raw"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col(host), F.lit("")).alias("host"), *keep,
    ).join(common, "host", "left")
    gone = F.coalesce(F.col("lines"), F.array().cast("array<bigint>"))
    split = F.split("text", "\n")
    with_word = F.filter(split, lambda x: F.trim(spaced(x)) != "")
    pairs = F.arrays_zip(split.alias("raw"), normal_lines(F.col("text")).alias("normal"))
    left = F.transform(
        F.filter(pairs, lambda p: ~F.array_contains(gone, F.xxhash64(p["normal"]))), lambda p: p["raw"]
    )
    clean = F.when(F.size(gone) == 0, F.col("text")).otherwise(F.array_join(left, "\n"))
    measured = rows.select(
        "doc_id", "raw", "text",
        F.size(words_of(F.col("text"))).cast("long").alias("n_words"),
        F.length(F.replace(spaced(F.col("text")), F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _let(words_of(F.col("text")), lambda w: repeated_words(w)).alias("n_repeat_words"),
        clean.alias("clean"), *keep,
    )
    judged = measured.select(
        "*",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        F.size(words_of(F.col("clean"))).cast("long").alias("n_words_left"),
    )
    enough = (F.col("n_words_left") >= MIN_WORDS) & (2 * F.col("n_words_left") >= F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & enough).alias("kept"), "n_words_left",
        F.when(F.col("raw").isNotNull(), F.col("clean")).alias("clean_text"), *keep,
    )
