"""Packing of token sequences: first-fit decreasing with a tournament tree, in random groups of bounded size."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import Batches, texts, written
from evenhand.llm.tokens import worker_cache

CAPACITY = 2048
#: Pieces that one group has on average; a group is packed by one task.
GROUP_PIECES = 20_000
END_ID = 1


class TournamentTree:
    """Free space of bins in order of opening; a match goes to the larger child, so the root holds the largest."""

    def __init__(self, bins: int, capacity: int):
        self.first = 1 << max(bins - 1, 0).bit_length()
        self.free = [capacity] * (2 * self.first)

    def place(self, length: int) -> tuple[int, int]:
        """Put ``length`` into the first bin with room; gives the bin and its free space before."""
        free, node = self.free, 1
        while node < self.first:
            node *= 2
            if free[node] < length:
                node += 1
        bin_, before = node - self.first, free[node]
        free[node] = before - length
        while node > 1:
            node >>= 1
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
        return bin_, before


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item, for items in the given order after a stable sort by falling length."""
    order = np.argsort(-lengths, kind="stable")
    tree = TournamentTree(len(lengths), capacity)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for at, length in zip(order.tolist(), lengths[order].tolist()):
        bins[at], before = tree.place(length)
        offsets[at] = capacity - before
    return bins, offsets


def cut_pieces(docs: DataFrame, json: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, each document ended by END_ID."""
    rules = docs.sparkSession.sparkContext.broadcast(json)

    def cut(batches: Batches) -> Batches:
        cache = worker_cache(rules.value, as_bytes=True)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            source, starts, lengths, sums, totals = [], [], [], [], []
            for at, text in enumerate(texts(batch.column("text"))):
                ids = memoryview(b"".join(map(cache.__getitem__, text.split())) + end)
                for start in range(0, len(ids), 4 * capacity):
                    part = ids[start : start + 4 * capacity]
                    source.append(at)
                    starts.append(start // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    totals.append(len(ids) // 4)
            numbers = [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(source, pa.int64())), *numbers],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    )


def pack(docs: DataFrame, json: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Where every piece of ``docs(doc_id, text)`` goes: ``sequence_id`` and ``offset``, gapless from 0.

    Returns ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``. A null or
    empty text is the end id alone, a null doc_id stays null, repeated rows are packed each,
    an empty table gives no rows, and other columns are not read. Groups are drawn by a
    hash of the piece's number, so they are even whatever the documents are like; their count
    follows the number of pieces, so a task holds about ``group_pieces`` of them at any size.
    """
    pieces = written(cut_pieces(docs, json, capacity).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def packed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece", kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)[names]

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
        " sequence_id bigint, offset bigint"
    )
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    group = F.pmod(F.xxhash64("piece"), F.lit(groups))
    return pieces.groupBy(group.alias("group")).applyInPandas(packed, schema)
