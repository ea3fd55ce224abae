"""Token counts by a two-tier lookup of pre-tokens, without a shuffle of pre-tokens.

A pre-token here is a piece of text between white space. The tokenizer has to drop
white space, so that pieces are encoded independently of each other. Tier one is a
compact table of frequent pieces and their lengths, broadcast to all tasks; its size
is bounded by a parameter. Tier two is a bounded cache in each worker, which encodes
the pieces that tier one lacks.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterable
from json import loads
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import Batches, texts

#: Pieces in the broadcast table, pieces that each task reports, and pieces that a task counts before it prunes.
TABLE_SIZE, TASK_SIZE, TASK_COUNTED = 32_768, 8_192, 400_000
#: Pieces that a worker keeps; longer pieces than LONG_PIECE bytes are encoded again each time.
CACHE_SIZE, LONG_PIECE = 1_000_000, 96
#: The word rule of the public vocabulary, and how byte-level merges show bytes that don't print.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
BYTE_LETTERS = {b: 256 + n for n, b in enumerate(HIDDEN)}
#: The same rule for pieces of printable ASCII and Latin-1 letters in lower case.
SIMPLE = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PARTS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+"
)


def tokenizer_json(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def load_tokenizer(json: str) -> Any:
    """Tokenizer from its JSON; refuses one that keeps white space, as pieces would then depend on each other."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(json)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    whole = tokenizer.encode(" a bc\n\td ", add_special_tokens=False).ids
    parts = [i for piece in ("a", "bc", "d") for i in tokenizer.encode(piece, add_special_tokens=False).ids]
    if whole != parts:
        raise ValueError("the tokenizer keeps white space; its pieces can't be looked up one by one")
    return tokenizer


def splits_words(json: str) -> bool:
    """Whether the tokenizer folds case and splits pieces by WORD_SPLIT before byte-level merges, nothing else."""
    rules = loads(json)
    steps = [rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}]
    steps = [step.get("normalizers") or step.get("pretokenizers") or [step] for step in steps]
    patterns = [step.get("pattern", {}).get("Regex") for kind in steps for step in kind]
    kinds = [[step.get("type") for step in kind] for kind in steps]
    return (
        kinds == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]
        and patterns == [None, r"\s+", None, WORD_SPLIT, None]
        and rules["model"].get("type") == "BPE"
        and all("<|" in token["content"] for token in rules.get("added_tokens", ()))
    )


class PieceCache(dict):
    """Ids of every piece as bytes, or their number; a piece is encoded when it is first looked up.

    Where the tokenizer splits words by a known rule, a new piece of printable ASCII and
    Latin-1 letters is put together from its parts, so that "word", "word," and "Word."
    run the merges once. All other pieces, such as those with special strings, go
    through the tokenizer as they are.
    """

    def __init__(self, json: str, as_bytes: bool, frequent: Iterable[tuple[bytes, Any]] = ()):
        self.tokenizer = load_tokenizer(json)
        self.known_rule = splits_words(json)
        self.merges = self.tokenizer.model.tokenize
        self.as_bytes = as_bytes
        self.frequent = dict(frequent)
        super().__init__(self.frequent)
        self.parts: dict[str, Any] = {}

    def value(self, ids: list[int]) -> Any:
        return np.array(ids, "<u4").tobytes() if self.as_bytes else len(ids)

    def of(self, piece: bytes) -> Any:
        text = piece.decode()
        simple = text.isprintable() if text.isascii() else SIMPLE.fullmatch(text)
        if not self.known_rule or not simple or "<|" in text:
            return self.value(self.tokenizer.encode(text, add_special_tokens=False).ids)
        text = text.lower()
        if text.isalpha():
            return self.of_part(text)
        values = list(map(self.of_part, PARTS.findall(text)))
        return b"".join(values) if self.as_bytes else sum(values)

    def of_part(self, part: str) -> Any:
        found = self.parts.get(part)
        if found is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_LETTERS)
            tokens = self.merges(shown)
            found = np.array([token.id for token in tokens], "<u4").tobytes() if self.as_bytes else len(tokens)
            if len(self.parts) >= CACHE_SIZE:
                self.parts.clear()
            if len(part) <= LONG_PIECE:
                self.parts[part] = found
        return found

    def __missing__(self, piece: bytes) -> Any:
        found = self.of(piece)
        if len(piece) <= LONG_PIECE:
            if len(self) >= CACHE_SIZE:
                self.clear()
                self.update(self.frequent)
            self[piece] = found
        return found


_WORKER: dict[tuple, PieceCache] = {}


def worker_cache(json: str, as_bytes: bool, frequent: Callable[[], Iterable] = tuple) -> PieceCache:
    """The cache of this worker process, kept from task to task; one at a time."""
    key = (hash(json), as_bytes, frequent is tuple)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = PieceCache(json, as_bytes, frequent())
    return _WORKER[key]


def frequent_pieces(docs: DataFrame, size: int = TABLE_SIZE) -> list[bytes]:
    """Frequent pieces of all texts: every task sends a bounded summary of its own counts, no pieces are shuffled."""

    def summaries(batches: Batches) -> Batches:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in texts(batch.column(0)):
                counts.update(text.split())
            if len(counts) > TASK_COUNTED:
                counts = Counter(dict(counts.most_common(TASK_COUNTED // 4)))
        top = [(p, n) for p, n in counts.most_common(TASK_SIZE) if len(p) <= LONG_PIECE]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"]
        )

    found = docs.select("text").mapInArrow(summaries, "piece binary, n bigint")
    rows = found.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size)
    return [bytes(row.piece) for row in rows.collect()]


def count_tokens(docs: DataFrame, json: str, size: int = TABLE_SIZE) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` for every row of ``docs(doc_id, text)``, from the whole text.

    A null text counts as empty, an empty text has no tokens, a null doc_id stays null,
    repeated rows give repeated rows, an empty table gives no rows, and other columns are not read. A text is
    split and counted whole, however long. Which of equally frequent pieces are in the table changes no count.
    """
    spark = docs.sparkSession
    frequent = frequent_pieces(docs, size)
    lengths = list(map(PieceCache(json, as_bytes=False).of, frequent))
    compact = spark.sparkContext.broadcast((b"\n".join(frequent), np.array(lengths, "<u4").tobytes(), json))

    def counted(batches: Batches) -> Batches:
        pieces, packed, rules = compact.value
        known = lambda: zip(pieces.split(b"\n") if pieces else [], np.frombuffer(packed, "<u4").tolist())
        cache = worker_cache(rules, False, known)
        for batch in batches:
            whole = texts(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(text) for text in whole], pa.int64()),
                    pa.array([sum(map(cache.__getitem__, text.split())) for text in whole], pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
