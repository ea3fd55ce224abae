"""Line-first quality rules, as SQL expressions: clean line by line, then reject documents that lose too much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 5
#: A line fails with more symbols than this share of its words, or if so many words repeat the word before.
SYMBOL_SHARE, ECHO_SHARE, ECHO_WORDS = 0.3, 0.4, 8
#: A line without closing punctuation fails if it has so few words, as menu entries have.
ENTRY_WORDS = 2
CLOSING = r"[.!?…:;,\"'”’»)\]]$"
#: A short line with one of these phrases fails.
BOILERPLATE_WORDS = 25
BOILERPLATE = (
    r"\b(?:cookies?|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript"
    r"|click here|subscribe|sign (?:in|up)|log ?in|powered by|skip to content|read more)\b"
)
#: A document is rejected if less than this percentage of its word characters is left.
KEPT_PERCENT = 50

TEXT, WORDS, LINES, GRAMS = "__text", "__words", "__lines", "__grams"


def split_words(text: Column) -> Column:
    """Words between white space; no words give an empty array."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_RUN))


def symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))


def line_fails(line: Column) -> Column:
    """Whether a line with words is navigation, boilerplate, symbols or an echo of single words.

    ``line`` has the fields line, trimmed and words, so that each is worked out once.
    """
    trimmed, words = line["trimmed"], line["words"]
    n = F.size(words)
    echoes = F.size(F.filter(words, lambda word, at: word == F.get(words, at + 1)))
    return (
        ((n <= ENTRY_WORDS) & ~trimmed.rlike(CLOSING))
        | ((n <= BOILERPLATE_WORDS) & F.lower(trimmed).rlike(BOILERPLATE))
        | (symbols(trimmed) > SYMBOL_SHARE * n)
        | ((n >= ECHO_WORDS) & (echoes >= ECHO_SHARE * n))
    )


def repeated_words(grams: Column) -> Column:
    """Words inside windows that occur twice or more, from the array of all windows in order."""
    by_text = F.sort_array(F.transform(grams, lambda gram, at: F.struct(gram.alias("gram"), at.alias("at"))))

    def starts(ordered: Column) -> Column:
        same = lambda at, other: F.coalesce(
            F.get(ordered, at)["gram"] == F.get(ordered, other)["gram"], F.lit(False)
        )
        found = F.filter(
            F.transform(ordered, lambda x, at: F.when(same(at, at - 1) | same(at, at + 1), x["at"])),
            lambda at: at.isNotNull(),
        )
        return F.sort_array(found)

    def covered(ordered: Column) -> Column:
        steps = F.transform(ordered, lambda at, j: F.least(F.lit(WINDOW), F.get(ordered, j + 1) - at))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + F.coalesce(step, F.lit(WINDOW)))

    once = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731  evaluates value a single time
    return once(once(by_text, starts), covered)


def quality(docs: DataFrame) -> DataFrame:
    """All columns of ``docs(doc_id, text, ...)`` in a struct ``row``, with the statistics and the verdict of each row.

    Returns ``(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_lines, n_bad_lines, kept_chars, clean_text, kept)``. A null text has no words and
    so fails, as an empty one does; a null doc_id and columns of any other name pass
    through in ``row``; repeated rows are judged each; an empty table gives no rows. No shuffle: every rule looks
    at one text, whole, and a long one must fit in a task with its words and lines.
    """
    whole = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias(TEXT))
    split = whole.select(
        "row",
        TEXT,
        split_words(F.col(TEXT)).alias(WORDS),
        F.filter(
            F.transform(
                F.split(TEXT, "\n"),
                lambda line: F.struct(line.alias("line"), F.btrim(line, F.lit(WHITE)).alias("trimmed")),
            ),
            lambda line: line["trimmed"] != "",
        ).alias(LINES),
    ).withColumn(
        "__lines_split",
        F.transform(
            LINES,
            lambda x: F.struct(
                x["line"].alias("line"), x["trimmed"].alias("trimmed"), F.split(x["trimmed"], WHITE_RUN).alias("words")
            ),
        ),
    )
    grams = F.transform(
        F.slice(WORDS, WINDOW, F.greatest(F.size(WORDS) - (WINDOW - 1), F.lit(0))),
        lambda last, at: F.concat_ws(" ", *[F.get(F.col(WORDS), at + k) for k in range(WINDOW - 1)], last),
    )
    good = F.filter("__lines_split", lambda line: ~line_fails(line))["line"]
    judged = split.select(
        "row",
        F.size(WORDS).cast("bigint").alias("n_words"),
        F.length(F.array_join(WORDS, "")).cast("bigint").alias("word_chars"),
        symbols(F.col(TEXT)).cast("bigint").alias("n_symbols"),
        F.size(LINES).cast("bigint").alias("n_lines"),
        (F.size(LINES) - F.size(F.array_distinct(F.col(LINES)["line"]))).cast("bigint").alias("n_dup_lines"),
        grams.alias(GRAMS),
        good.alias("__good"),
    )
    repeats = F.when(F.size(F.array_distinct(GRAMS)) < F.size(GRAMS), repeated_words(F.col(GRAMS))).otherwise(0)
    scored = judged.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeats.cast("bigint").alias("n_repeat_words"),
        "n_lines",
        (F.col("n_lines") - F.size("__good")).alias("n_bad_lines"),
        F.array_join("__good", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.when(F.col("n_bad_lines") == 0, F.col("word_chars")).otherwise(
        F.length(F.regexp_replace("clean_text", WHITE_RUN, "")).cast("bigint")
    )
    return (
        scored.withColumn("base_failed", failed)
        .withColumn("kept_chars", left)
        .withColumn("kept", ~F.col("base_failed") & (100 * F.col("kept_chars") >= KEPT_PERCENT * F.col("word_chars")))
    )
