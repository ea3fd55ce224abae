"""Toxic documents by multiple-instance learning: only documents have labels, sentences get scores.

A sentence s with features x has p(s) = sigmoid(b + w.x). A document is toxic if any
sentence is: P = 1 - prod(1 - p(s)) (noisy-or). The weights maximise the likelihood of
the documents' labels, so the sentences that explain a label are found on the way.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import WORD_BYTES, Batches, texts

#: The classifier is fitted on at most so many labelled rows of each label, drawn by a hash of doc_id.
MOST_TOXIC, MOST_CLEAN = 3_000, 6_000
#: A feature is a word, or one of two starts of a longer word. It is kept if so many labelled documents have it
#: and the odds of a toxic label are so much higher (natural logarithm) where it occurs.
STARTS, LEAST_DOCUMENTS, LEAST_GAIN, MOST_FEATURES = (6, 8), 3, 1.0, 50_000
ROUNDS, RATE, SHRINK, FIRST_BIAS = 400, 0.05, 1e-5, -6.0
#: Score from which a document counts as toxic, and least score of an offending sentence.
TOXIC, OFFENDING = 0.7, 0.5
CACHE_SIZE = 1_000_000
#: Words as elsewhere; sentences end at line ends and at . ! ?
SENTENCE_BYTES = bytes(10 if c in b".!?\n" else WORD_BYTES[c] for c in range(256))


class Model(NamedTuple):
    weights: dict[bytes, float]
    bias: float
    #: Monotone map that takes the best threshold on the labelled rows to TOXIC: score = P ** power.
    power: float


def sentences(text: bytes) -> list[list[bytes]]:
    return [words for part in text.translate(SENTENCE_BYTES).split(b"\n") if (words := part.split())]


def features(word: bytes) -> tuple[bytes, ...]:
    return (word, *(word[:n] + b"*" for n in STARTS if len(word) > n))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts, labels and weights of a bounded sample; the weights undo the different shares of the labels."""
    given = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {row.toxic: row.n for row in given.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = [
        given.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for label, most in ((1, MOST_TOXIC), (0, MOST_CLEAN))
    ]
    # The sample has at most MOST_TOXIC + MOST_CLEAN rows, which bounds this broadcast.
    found = docs.select("doc_id", "text").join(F.broadcast(drawn[0].union(drawn[1])), "doc_id")
    found = found.select("doc_id", "text", "toxic").dropDuplicates(["doc_id"]).toArrow()
    order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
    toxic = found["toxic"].to_numpy()[order].astype(float)
    whole = found["text"].combine_chunks() if found.num_rows else pa.array([], pa.string())
    share = {1.0: counts.get(1, 0) / max(1, toxic.sum()), 0.0: counts.get(0, 0) / max(1, (1 - toxic).sum())}
    rows = texts(whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole)
    return [rows[i] for i in order], toxic, np.array([share[y] for y in toxic])


def fit(rows: list[bytes], toxic: np.ndarray, weight: np.ndarray) -> Model:
    """Weights by full-batch gradients; without both labels every document scores next to nothing."""
    if not len(rows) or not 0 < toxic.sum() < len(rows):
        return Model({}, -20.0, 1.0)
    split = [sentences(text) for text in rows]
    with_toxic, with_clean = Counter(), Counter()
    for parts, y in zip(split, toxic):
        seen = {name for words in parts for word in set(words) for name in features(word)}
        (with_toxic if y else with_clean).update(seen)
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    gain = {
        name: math.log((n + 0.2) / (n1 + 1)) - math.log((with_clean[name] + 0.2) / (n0 + 1))
        for name, n in with_toxic.items()
        if n >= LEAST_DOCUMENTS
    }
    kept = sorted((name for name in gain if gain[name] >= LEAST_GAIN), key=lambda name: (-with_toxic[name], name))
    number = {name: at for at, name in enumerate(kept[:MOST_FEATURES])}
    of_feature, of_sentence, of_document = [], [], []
    for at, parts in enumerate(split):
        for words in parts:
            found = {number[name] for word in set(words) for name in features(word) if name in number}
            of_feature += found
            of_sentence += [len(of_document)] * len(found)
            of_document.append(at)
    x, s, d = (np.array(a, np.int64) for a in (of_feature, of_sentence, of_document))
    w, b = np.zeros(len(number)), FIRST_BIAS
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    weight = weight / weight.sum()

    def forward() -> tuple[np.ndarray, np.ndarray]:
        z = b + np.bincount(s, weights=w[x], minlength=len(d))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(d, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(rows))
        return p, np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)

    for step in range(1, ROUNDS + 1):
        p, whole = forward()
        pull = weight * np.where(toxic == 1, (1 - whole) / whole, -1.0)
        by_sentence = pull[d] * p
        gradient = np.append(np.bincount(x, weights=by_sentence[s], minlength=len(w)) - SHRINK * w, by_sentence.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, b = w + move[:-1], min(b + move[-1], -2.0)
    return Model({name: float(w[at]) for name, at in number.items()}, float(b), power(forward()[1], toxic, weight))


def power(whole: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The exponent that takes the threshold of the best F1 on the labelled rows to TOXIC."""
    order = np.argsort(-whole, kind="stable")
    hits = np.cumsum((weight * toxic)[order])
    all_found = np.cumsum(weight[order])
    scores = 2 * hits / (all_found + (weight * toxic).sum())
    best = int(np.argmax(scores))
    after = whole[order][best + 1] if best + 1 < len(whole) else 0.0
    threshold = min(max(math.sqrt(whole[order][best] * max(after, 1e-6)), 1e-3), 0.999)
    return math.log(TOXIC) / math.log(threshold)


class Weights(dict):
    """Weight of every word, its start included; words are worked out when first met."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        found = sum(self.weights.get(name, 0.0) for name in features(word))
        if len(self) >= CACHE_SIZE:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, score, offending)`` for every row of ``docs(doc_id, text)``; learns from all given ``labels``.

    ``offending`` has the sentences that reach OFFENDING in documents that reach TOXIC:
    start and end in code points, and score, in order. A null or empty text scores 0 or
    next to it, a null doc_id stays null, repeated rows are scored each; labels other than 0
    and 1 and those without a document are not used; without documents of both labels
    all scores are near 0. No other column than doc_id and text is read, and only
    the text enters a score. An empty table gives no rows. Texts are scored whole, however long; those of the
    bounded labelled sample are held by the driver while it fits. Of rows that share a labelled doc_id
    one is learnt from.
    """
    model = fit(*labelled_rows(docs, labels))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Batches) -> Batches:
        weights, bias, exponent = sent.value
        known = Weights(weights)
        for batch in batches:
            rows = texts(batch.column("text"))
            scores, found = [], []
            for text in rows:
                sums = [sum(map(known.__getitem__, set(words))) for words in sentences(text)]
                p = 1 / (1 + np.exp(-np.clip(bias + np.array(sums), -30, 30)))
                scores.append(float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-9)).sum())) ** exponent)
                found.append(offending(text, p) if scores[-1] >= TOXIC else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(found, SENTENCES)],
                ["doc_id", "score", "offending"],
            )

    def offending(text: bytes, p: np.ndarray) -> list[dict]:
        places, at, k = [], 0, 0
        for part in text.translate(SENTENCE_BYTES).split(b"\n"):
            if part.split():
                if p[k] >= OFFENDING:
                    start = len(text[:at].decode())
                    end = start + len(text[at : at + len(part)].decode())
                    places.append({"start": start, "end": end, "score": float(p[k])})
                k += 1
            at += len(part) + 1
        return places

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, score double, offending array<struct<start:bigint,end:bigint,score:double>>"
    return docs.select("doc_id", "text").mapInArrow(scored, schema)


SENTENCES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
