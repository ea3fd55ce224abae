"""Log-likelihood of documents under a gated recurrent language model trained on the corpus.

Counts of all training words are summed by Spark. The model's word table holds the most
frequent words, up to a bound; all other words are open and share their class by their
counts, one of them standing for all words that training has not shown. The network is trained on every training
document once: in each round the tasks go on from the same weights over their part
of that round's documents, and Spark averages what they reach, weighted by words.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm import gru
from evenhand.llm.common import Batches, texts, written

#: Words in the broadcast table, and words that a task counts or trains on at once.
TABLE_SIZE, COUNTED_AT_ONCE, WORDS_AT_ONCE = 262_144, 400_000, 1_500_000
#: Learning rates of the rounds; each training document belongs to one round.
RATES = (0.01, 0.006, 0.003)
#: Words of a round for which there is one more task, beyond one for each core: every task sends all weights.
TASK_WORDS = 500_000
#: Weights that a task sends in one row.
BLOCK = 4096
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The end of a document; no word is empty.
END = b""


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, c)`` of every word of all texts and of the ends of documents, written to the shared folder."""

    def counted(batches: Batches) -> Batches:
        counts: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "c"]
            )

        for batch in batches:
            for text in texts(batch.column(0)):
                counts.update(words_of(text))
                counts[END] += 1
                if len(counts) > COUNTED_AT_ONCE:
                    yield rows()
                    counts.clear()
        yield rows()

    found = docs.select("text").mapInArrow(counted, "word binary, c bigint")
    return written(found.groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


class Table(NamedTuple):
    """Frequent words by falling count: bytes, counts, the total and the number of all words; ``head`` comes first."""

    words: bytes
    counts: np.ndarray
    total: int
    distinct: int
    head: int

    def split(self) -> list[bytes]:
        return self.words.split(b"\n")

    def shared(self) -> np.ndarray:
        """First ranks of the shared classes: each holds as many words as all before it."""
        first, bounds = self.head, []
        while first < len(self.counts):
            bounds.append(first)
            first *= 2
        return np.array(bounds, np.int64)

    def layout(self) -> gru.Layout:
        return gru.Layout.of(self.head, len(self.shared()) + 1)

    def targets(self) -> np.ndarray:
        """Number of every word in the model: its own in the head, else that of its class."""
        ranks = np.arange(len(self.counts))
        return np.where(
            ranks < self.head, ranks, self.head + np.searchsorted(self.shared(), ranks, side="right") - 1
        ).astype(np.int32)

    def shares(self) -> np.ndarray:
        """Natural log of every word's share of its class; 0 in the head."""
        found, bounds = np.zeros(len(self.counts)), [*self.shared().tolist(), len(self.counts)]
        for low, high in zip(bounds, bounds[1:]):
            found[low:high] = np.log(self.counts[low:high] / self.counts[low:high].sum())
        return found


def frequent_words(counts: DataFrame) -> Table:
    """The most frequent words that occur twice or more, at most TABLE_SIZE; the end of documents is the first."""
    sums = counts.agg(F.sum("c").alias("total"), F.count("*").alias("distinct")).collect()[0]
    again = counts.filter((F.col("c") > 1) & (F.col("word") != F.lit(END)))
    level = F.floor(F.log2("c") * 16)
    least, size = math.inf, 1
    for row in sorted(again.groupBy(level.alias("level")).count().collect(), key=lambda row: -row.level):
        size += row["count"]
        if size > TABLE_SIZE:
            break
        least = row.level
    table = again.filter(level >= least).toArrow()
    rows = sorted(zip((-n for n in table["c"].to_pylist()), map(bytes, table["word"].to_pylist())))
    ends = counts.filter(F.col("word") == F.lit(END)).collect()
    falling = np.array([-n for n, _ in rows], np.int64)
    return Table(
        b"\n".join([END, *(word for _, word in rows)]),
        np.append(ends[0].c if ends else 1, falling),
        sums.total or 0,
        sums.distinct,
        # The end of documents comes first, whatever its count.
        gru.head_size(np.append(max(falling.max(initial=1), gru.LEARNT), falling)),
    )


class Numbers(dict):
    """Rank of every word in the table; other words have -1."""

    def __missing__(self, word: bytes) -> int:
        return -1


_NUMBERS: dict[int, Numbers] = {}


def numbers(table: Table) -> Numbers:
    """The table as a dictionary, kept by the worker process for its next tasks."""
    mark = hash(table.words)
    if mark not in _NUMBERS:
        _NUMBERS.clear()
        _NUMBERS[mark] = Numbers((word, rank) for rank, word in enumerate(table.split()))
    return _NUMBERS[mark]


def ranks_of(words: list[bytes], known: Numbers) -> np.ndarray:
    """Ranks of the words of a document and of its end."""
    return np.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), known[END])


def trained(docs: DataFrame, table: Table) -> np.ndarray:
    """Weights after one pass over all texts, in rounds."""
    spark, layout = docs.sparkSession, table.layout()
    sent = spark.sparkContext.broadcast(table)
    bounds = [*table.shared().tolist(), len(table.counts)]
    shared = [table.counts[low:high].sum() for low, high in zip(bounds, bounds[1:])]
    open_words = table.total - table.counts.sum()
    values = gru.flat(gru.by_counts(layout, table.counts[: table.head], np.array([*shared, open_words])))
    tasks = max(spark.sparkContext.defaultParallelism, table.total // (len(RATES) * TASK_WORDS))
    for turn, rate in enumerate(RATES):
        start = spark.sparkContext.broadcast(values)

        def fitted(batches: Batches) -> Batches:
            known, targets = numbers(sent.value), sent.value.targets()
            # Words outside the table have rank -1, so the open class has to come last.
            targets = np.append(targets, np.int32(layout.head + layout.shared - 1))
            weights = gru.unflat(start.value, layout)
            optimiser = gru.Adam(weights, rate)
            waiting: list[np.ndarray] = []
            size = done = 0
            for batch in batches:
                for text in texts(batch.column(0)):
                    waiting.append(targets[ranks_of(words_of(text), known)])
                    size += len(waiting[-1])
                    if size >= WORDS_AT_ONCE:
                        gru.train(weights, waiting, layout, optimiser)
                        waiting, size, done = [], 0, done + size
            if waiting:
                gru.train(weights, waiting, layout, optimiser)
            done += size
            if done:
                reached = gru.flat(weights)
                blocks = [reached[at : at + BLOCK] for at in range(0, len(reached), BLOCK)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(len(blocks)), pa.int64()),
                        pa.array(blocks, pa.list_(pa.float32())),
                        pa.array([done] * len(blocks), pa.int64()),
                    ],
                    ["block", "weights", "words"],
                )

        part = docs.filter(F.pmod(F.xxhash64("text"), F.lit(len(RATES))) == turn).select("text").coalesce(tasks)
        reached = part.mapInArrow(fitted, "block bigint, weights array<float>, words bigint")
        means = (
            reached.select("block", "words", F.posexplode("weights").alias("at", "weight"))
            .groupBy((F.col("block") * BLOCK + F.col("at")).alias("at"))
            .agg((F.sum(F.col("weight").cast("double") * F.col("words")) / F.sum("words")).alias("weight"))
            .toArrow()
        )
        if means.num_rows:
            values = np.empty(len(values))
            values[means["at"].to_numpy()] = means["weight"].to_numpy()
        start.unpersist()
    return values


def likelihoods(docs: DataFrame, training: Column, key: str = "doc_id") -> DataFrame:
    """Scores of every row of ``docs(key, text)`` by what the rows that meet ``training`` teach.

    Returns ``(key, n_tokens, n_known, train_tokens, base_score, score)``: words and one
    end are the tokens, ``n_known`` of them occur among the ``train_tokens`` training tokens,
    ``base_score`` is the log10 probability by smoothed counts and ``score`` that of the
    network, for the whole text. A null or empty text is its end alone; a null key stays
    null; repeated rows are counted and scored each; without training rows the counts
    are 0 and the network is untrained; other columns are not read unless ``training`` does. An empty table
    gives no rows. State is carried through a text of any length. Of equally frequent words the one that is smaller
    as bytes comes first.
    """
    learnt = docs.filter(training).select("text")
    counts = word_counts(learnt)
    table = frequent_words(counts)
    values = trained(learnt, table)
    total, distinct = table.total, table.distinct
    size = math.log10(total + distinct + 1)
    in_table = int(table.counts.sum()) if total else 0
    open_size = math.log10((total - in_table) + (distinct - (len(table.counts) if total else 0)) + 1)
    sent = docs.sparkSession.sparkContext.broadcast((table, values))

    def scored(batches: Batches) -> Batches:
        table, values = sent.value
        known, layout = numbers(table), table.layout()
        weights = gru.unflat(values, layout)
        open_class = np.int32(layout.head + layout.shared - 1)
        targets = np.append(table.targets(), open_class)
        shares = np.append(table.shares(), 0.0)
        # The end of documents stands in the table even if no training document has shown it.
        table_counts = table.counts if total else np.zeros(1)
        base = np.append(np.log10(table_counts + 1) - size, 0.0)
        for batch in batches:
            keys, whole = batch.column(key), texts(batch.column("text"))
            at = 0
            while at < len(whole):
                rows, rest, words_now, low = [], [], 0, at
                while at < len(whole) and words_now < WORDS_AT_ONCE:
                    words = words_of(whole[at])
                    ranks = ranks_of(words, known)
                    rows.append(ranks)
                    missing = np.flatnonzero(ranks < 0)
                    rest.append([words[i] for i in missing.tolist()])
                    words_now += len(ranks)
                    at += 1
                found = gru.score(weights, [targets[ranks] for ranks in rows], layout)
                found += [shares[ranks].sum() for ranks in rows]
                open_words = [Counter(words) for words in rest]
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(low, at - low),
                        pa.array([len(ranks) for ranks in rows], pa.int64()),
                        pa.array([int((ranks >= 0).sum()) if total else 0 for ranks in rows], pa.int64()),
                        pa.array([float(base[ranks].sum()) for ranks in rows], pa.float64()),
                        pa.array(found / math.log(10), pa.float64()),
                        pa.array([[{"word": w, "n": n} for w, n in x.items()] for x in open_words], OPEN_WORDS),
                    ],
                    [key, "n_tokens", "n_table", "base_table", "score_table", "open"],
                )

    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"{key} {kind}, n_tokens bigint, n_table bigint, base_table double, score_table double,"
        " open array<struct<word:binary,n:bigint>>"
    )
    rows = docs.select(key, "text").mapInArrow(scored, schema)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "scores")
    open_words = rows.select("row", F.explode("open").alias("x")).select("row", "x.word", "x.n")
    seen = F.col("c").isNotNull()
    log_count = F.log10(F.coalesce("c", F.lit(0)) + 1)
    rest = (
        open_words.join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("n_rest"),
            F.sum(F.col("n") * (log_count - size)).alias("base_rest"),
            F.sum(F.col("n") * (log_count - open_size)).alias("score_rest"),
        )
    )
    return (
        rows.drop("open")
        .join(rest, "row", "left")
        .select(
            key,
            "n_tokens",
            (F.col("n_table") + F.coalesce("n_rest", F.lit(0))).alias("n_known"),
            F.lit(total).cast("bigint").alias("train_tokens"),
            (F.col("base_table") + F.coalesce("base_rest", F.lit(0.0))).alias("base_score"),
            (F.col("score_table") + F.coalesce("score_rest", F.lit(0.0))).alias("score"),
        )
    )


OPEN_WORDS = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
