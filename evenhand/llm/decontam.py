"""Benchmark passages in training texts, by a distributed positional index of training tokens.

1. The words of all texts are written once, and the benchmark's words counted in them.
2. Every window of benchmark words gets anchors: its rarest words. Only words that some
   window or item is looked up by are indexed: ``(term, row, position)``, written to the
   shared folder. Postings of the rarest anchors carry the words around them.
3. The postings of a window's rarest anchor give places where it could start. The list
   is intersected with those of the next rarest anchors, shifted by their offsets.
4. What is left is compared with the words around it: an exact phrase match.
5. Proximity matches use the same postings: for every other half window of an item, its rarest words
   that occur at all, close together in whatever order. Edited copies are found by the windows left alone.

Everything is DataFrame operations. No step collects texts or links on the driver, and
nothing but tables of a checked number of rows is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import NON_WORD, ascii_lower, written

WINDOW_WORDS, ANCHORS = 13, 3
#: Longest stretch of words, in windows, that a proximity match may take.
NEAR_WINDOWS = 2
#: Items cut into at most so many windows are looked up by their next rarest words too, as one changed word may be all it takes.
FEW_WINDOWS = 3
#: Tables of the benchmark are broadcast up to so many rows; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def word_text(text: Column) -> Column:
    """The words of a text in lower case, with one space between them."""
    return F.btrim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD, " "), F.lit(" "))


def split_words(words: Column) -> Column:
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))


def checked(table: DataFrame) -> DataFrame:
    """Broadcast a written table only if it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def benchmark_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """``(item, phrase, words)`` for every window of every item; shorter items are one window."""
    words = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        split_words(word_text(F.col("text"))).alias("all"),
    ).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (size - 1), F.lit(1)))
    return (
        words.select("item", F.explode(F.transform(starts, lambda at: F.slice("all", at, size))).alias("words"))
        .select("item", F.array_join("words", " ").alias("phrase"), "words")
        .distinct()
    )


def benchmark_stretches(benchmark: DataFrame, size: int) -> DataFrame:
    """``(item, stretch, words, n_terms, few)``: the windows of every item at each half window, and its last one.

    ``words`` are the distinct ones, ``n_terms`` their number, and ``stretch`` tells windows apart; ``few`` says that
    the item has at most FEW_WINDOWS of them.
    """
    words = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        split_words(word_text(F.col("text"))).alias("all"),
    ).filter(F.size("all") > 0)
    last = F.greatest(F.size("all") - (size - 1), F.lit(1))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(1), last, F.lit(size // 2)), F.array(last)))
    windows = F.explode(F.transform(starts, lambda at: F.slice("all", at, size))).alias("all")
    cut = words.select("item", (F.size(starts) <= FEW_WINDOWS).alias("few"), windows)
    cut = cut.select("item", F.array_distinct("all").alias("words"), "few").distinct()
    number = (2 * F.monotonically_increasing_id()).alias("stretch")
    return cut.select("item", number, "words", F.size("words").alias("n_terms"), "few")


def rarest(words: DataFrame, keys: list[str], counts: DataFrame, most: int) -> DataFrame:
    """The rarest words of each key, as an array of ``(n, offset, term)``; keys with a word in no text are left out."""
    return (
        words.join(checked(counts), "term", "left")
        .groupBy(*keys)
        .agg(
            F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("all")
        )
        .filter(F.col("all")[0]["n"] > 0)
        .select(*keys, F.slice("all", 1, most).alias("anchors"))
    )


def rarest_known(stretches: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """``(item, stretch, terms)``: the rarest words that occur in some text, of equally rare ones the smaller.

    A stretch is left out if fewer of its words occur than are asked for, unless it has no more words. A stretch of an
    item with few of them gives its next rarest words as a second set.
    """
    known = stretches.select("item", "stretch", "n_terms", "few", F.explode("words").alias("term"))
    ranked = (
        known.join(checked(counts), "term")
        .groupBy("item", "stretch", "n_terms", "few")
        .agg(F.sort_array(F.collect_list(F.struct("n", "term")))["term"].alias("all"))
        .filter(F.size("all") >= F.least(F.col("n_terms"), F.lit(most)))
    )
    second = F.when(F.col("few") & (F.size("all") >= 2 * most), F.slice("all", most + 1, most))
    sets = F.array_compact(F.array(F.slice("all", 1, most), second))
    return ranked.select("item", "stretch", F.posexplode(sets).alias("more", "terms")).select(
        "item", (F.col("stretch") + F.col("more")).alias("stretch"), "terms"
    )


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", size: int = WINDOW_WORDS) -> DataFrame:
    """``(key, n_words, n_hit, items, near)`` for every row of ``docs(key, text)``.

    ``n_hit`` counts the words inside any occurrence of a window of ``benchmark(item_id, text)``,
    ``items`` are the ids, as sorted strings, of items with occurring windows, and ``near`` has
    ``(item, start, end)`` of every item, by id, of which some window has its ANCHORS rarest words (of those that occur
    anywhere) within NEAR_WINDOWS windows of words: its first such place, in words from 0, end exclusive.
    Copies with some words changed are near wherever a window keeps its rarest words.

    A null text has no words; a null key stays null; repeated rows are judged each; a null
    item_id counts as an empty string, items without words are left out, repeated items
    count once; an empty table on either side gives no hits; other columns are not read. Texts of any
    length are indexed whole; of equally rare words the smaller one comes first.
    """
    index = written(
        docs.select(key, word_text(F.col("text")).alias("words"))
        .withColumn("n_words", F.size(split_words(F.col("words"))).cast("bigint"))
        .withColumn("row", F.monotonically_increasing_id()),
        "words",
    )
    windows = written(benchmark_windows(benchmark, size), "windows")
    phrases = windows.select("phrase", "words").distinct()
    terms = written(windows.select(F.explode("words").alias("term")).distinct(), "terms")
    tokens = index.filter("n_words > 0").select(
        "row", F.posexplode(split_words(F.col("words"))).alias("pos", "term")
    )
    counts = written(
        tokens.select("term").join(checked(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")),
        "counts",
    )
    anchors = written(
        rarest(
            phrases.select("phrase", F.posexplode("words").alias("offset", "term")), ["phrase"], counts, ANCHORS
        ),
        "anchors",
    )
    stretches = written(benchmark_stretches(benchmark, size), "stretches")
    near = written(rarest_known(stretches, counts, ANCHORS), "near")
    rare = anchors.select(F.col("anchors")[0]["term"].alias("term")).distinct().withColumn("first", F.lit(True))
    terms_of = anchors.select("anchors.term").union(near.select("terms"))
    other = terms_of.toDF("terms").select(F.explode("terms").alias("term"))
    looked_up = written(other.distinct().join(rare, "term", "left"), "looked-up")

    reach = size - 1
    from_ = F.greatest(F.col("pos") - reach, F.lit(0))
    split = index.filter("n_words > 0").select("row", split_words(F.col("words")).alias("words"))
    postings = written(
        split.select("row", "words", F.posexplode("words").alias("pos", "term"))
        .join(checked(looked_up), "term")
        .select(
            "term",
            "row",
            "pos",
            F.when(F.col("first"), F.slice("words", from_ + 1, F.col("pos") - from_ + 1 + reach)).alias("around"),
        ),
        "postings",
    )
    found = intersect(postings, anchors, reach)
    return report(index, key, found, windows, close_terms(postings, near, NEAR_WINDOWS * size))


def intersect(postings: DataFrame, anchors: DataFrame, reach: int) -> DataFrame:
    """``(row, phrase, start, n)`` of every exact match, from the lists of the anchors."""
    lookup = anchors.select("phrase", "anchors", F.col("anchors")[0]["term"].alias("term"))
    places = (
        postings.filter("around is not null")
        .join(checked(lookup), "term")
        .withColumn("start", F.col("pos") - F.col("anchors")[0]["offset"])
        .filter("start >= 0")
    )
    lists = postings.select("row", F.col("term").alias("next_term"), F.col("pos").alias("next_pos"))
    for rank in range(1, ANCHORS):
        # Short items have fewer anchors: those places need no further list.
        anchor = F.get("anchors", F.lit(rank))
        places = places.withColumns(
            {
                "next_term": F.coalesce(anchor["term"], F.col("term")),
                "next_pos": F.when(anchor.isNull(), F.col("pos")).otherwise(F.col("start") + anchor["offset"]),
            }
        ).join(lists, ["row", "next_term", "next_pos"], "left_semi")
    words = F.split("phrase", " ")
    begin = F.col("start") - F.greatest(F.col("pos") - reach, F.lit(0)) + 1
    same = F.slice("around", begin, F.size(words)) == words
    return places.filter(same).select("row", "phrase", "start", F.size(words).alias("n"))


def close_terms(postings: DataFrame, near: DataFrame, reach: int) -> DataFrame:
    """``(row, item, start, end)``: the first place where the words of some stretch of an item lie within ``reach`` words."""
    lookup = near.select("item", "stretch", F.size("terms").alias("of"), F.posexplode("terms").alias("which", "term"))
    places = postings.select("term", "row", "pos").join(checked(written(lookup, "near-terms")), "term")
    by_place = Window.partitionBy("row", "stretch").orderBy("pos", "which")
    last = [F.last(F.when(F.col("which") == k, F.col("pos")), ignorenulls=True).over(by_place) for k in range(ANCHORS)]
    first = reduce(F.least, [F.coalesce(x, F.when(F.col("of") <= k, F.col("pos"))) for k, x in enumerate(last)])
    seen = [(F.col("of") <= k) | x.isNotNull() for k, x in enumerate(last)]
    close = reduce(lambda a, b: a & b, seen) & (F.col("pos") - first < reach)
    found = places.withColumns({"close": close, "first": first}).filter("close")
    place = F.min(F.struct(F.col("first").alias("start"), (F.col("pos") + 1).alias("end"))).alias("place")
    return found.groupBy("row", "item").agg(place).select("row", "item", "place.*")


def report(index: DataFrame, key: str, found: DataFrame, windows: DataFrame, near: DataFrame) -> DataFrame:
    found = written(found, "found")

    def covered(spans: Column) -> Column:
        """Words in the union of spans that are ordered by start."""
        return F.aggregate(
            spans,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda so_far, x: F.struct(
                (so_far["n"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(so_far["end"], x["start"]))).alias(
                    "n"
                ),
                F.greatest(so_far["end"], x["start"] + x["n"]).alias("end"),
            ),
            lambda total: total["n"].cast("bigint"),
        )

    hits = (
        found.select("row", "start", "n")
        .distinct()
        .groupBy("row")
        .agg(covered(F.sort_array(F.collect_list(F.struct("start", "n")))).alias("n_hit"))
    )
    items = (
        found.select("row", "phrase")
        .distinct()
        .join(checked(windows.select("phrase", "item")), "phrase")
        .groupBy("row")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    close = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("item", "start", "end"))).alias("near"))
    return (
        index.select(key, "n_words", "row")
        .join(hits, "row", "left")
        .join(items, "row", "left")
        .join(close, "row", "left")
        .select(
            key,
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("near", F.array().cast("array<struct<item: string, start: int, end: int>>")).alias("near"),
        )
    )


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """The rule of contamination: a word is hit, and at least a twentieth of all words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
