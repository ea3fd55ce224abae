"""Removal of lines that many documents share: perfect-hash shards over the repeated lines, probed by the documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import Batches, texts, written
from evenhand.llm.perfect_hash import PerfectHash

#: Code points that a line must have to be looked at, and documents that must hold it.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Lines that one shard has on average; a shard is built by one task.
SHARD_LINES = 100_000
#: Lines whose arrays (about 21 bytes each) are broadcast at most; rarer lines beyond are probed where their shard is.
BROADCAST_LINES = 2_000_000
#: Lines that are hashed at a time.
CHUNK_LINES = 200_000
#: Stands for a null doc_id, which is smaller than any other.
NO_ID = -(1 << 63)
_LATER_BYTES = bytes(range(0x80, 0xC0))


def line_keys(text: bytes, least: int = LEAST_CHARS) -> list[bytes | None]:
    """Key of every line: stripped of ASCII white space, A-Z lower-cased; None if it has too few code points."""
    keys = [line.strip().lower() for line in text.split(b"\n")]
    return [key if len(key) >= least and len(key.translate(None, _LATER_BYTES)) >= least else None for key in keys]


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def _ids(batch: pa.RecordBatch) -> list[int]:
    return [NO_ID if key is None else key for key in batch.column("doc_id").to_pylist()]


class Shards:
    """Perfect-hash shards: the second half of a line's hash is its fingerprint, beside it its document count and last document."""

    def __init__(self, rows: list[tuple[int, bytes]], shards: int):
        self.shards = shards
        self.arrays = {shard: self.unpacked(body) for shard, body in rows}

    @staticmethod
    def packed(keys: np.ndarray, docs: np.ndarray, last: np.ndarray) -> bytes:
        function = PerfectHash.build(keys)
        order = np.argsort(function.slots(keys))
        docs = np.minimum(docs, np.iinfo(np.uint32).max)
        parts = keys[order, 1].astype("<u8"), last[order].astype("<i8"), docs[order].astype("<u4")
        return len(keys).to_bytes(8, "little") + b"".join(part.tobytes() for part in parts) + function.to_bytes()

    @staticmethod
    def unpacked(body: bytes) -> tuple[PerfectHash, np.ndarray, np.ndarray, np.ndarray]:
        n = int.from_bytes(body[:8], "little")
        fingerprints, last, docs = (np.frombuffer(body, f"<{kind}", n, 8 + 8 * n * i) for i, kind in enumerate(("u8", "i8", "u4")))
        return PerfectHash.from_bytes(body[8 + 20 * n :]), fingerprints, last, docs

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every key: whether it is there, its last document, and its document count."""
        there, last, docs = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        shard = keys[:, 0] % np.uint64(max(self.shards, 1))
        for number, (function, fingerprints, last_ids, counts) in self.arrays.items():
            at = np.flatnonzero(shard == number)
            slots = function.slots(keys[at])
            same = (slots >= 0) & (fingerprints[slots] == keys[at, 1])
            at, slots = at[same], slots[same]
            there[at], last[at], docs[at] = True, last_ids[slots], counts[slots]
        return there, last, docs


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``(h1, h2, n_docs, last_id)`` of every line found in at least ``least_docs`` documents.

    A document sends each of its lines once, as a hash of 128 bits. Counts and last documents are combined
    before the shuffle, so a line that all documents hold is one row for each task.
    """

    def lines(batches: Batches) -> Batches:
        for batch in batches:
            digests, owners = [], []
            for key, text in zip(_ids(batch), texts(batch.column("text"))):
                own = {xxhash.xxh3_128_digest(line) for line in line_keys(text, least_chars) if line is not None}
                digests += own
                owners += [key] * len(own)
                if len(digests) >= CHUNK_LINES:
                    yield _line_rows(digests, owners)
                    digests, owners = [], []
            yield _line_rows(digests, owners)

    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = found.mapInArrow(lines, "h1 bigint, h2 bigint, doc_id bigint").groupBy("h1", "h2")
    counted = found.agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_id"))
    return counted.where(F.col("n_docs") >= least_docs)


def _line_rows(digests: list[bytes], owners: list[int]) -> pa.RecordBatch:
    hashes = _hashes(digests).view("<i8")
    columns = [pa.array(np.ascontiguousarray(hashes[:, i])) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(owners, pa.int64())], ["h1", "h2", "doc_id"])


def build_shards(lines: DataFrame, shards: int) -> DataFrame:
    """``(shard, body)``: the arrays of every shard of ``lines(h1, h2, n_docs, last_id)``."""

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        keys = group[["h1", "h2"]].to_numpy(np.int64).view(np.uint64)
        body = Shards.packed(keys, group["n_docs"].to_numpy(), group["last_id"].to_numpy())
        return pd.DataFrame({"shard": [int(key[0])], "body": [body]})

    # The unsigned remainder, as Shards.probe takes it.
    half = F.shiftrightunsigned("h1", 1)
    shard = (2 * (half % shards) + F.pmod("h1", F.lit(2))) % shards
    return lines.groupBy(shard.cast("int").alias("shard")).applyInPandas(build, "shard int, body binary")


def drop_shared_lines(
    docs: DataFrame,
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
    broadcast_lines: int = BROADCAST_LINES,
    shard_lines: int = SHARD_LINES,
) -> DataFrame:
    """``docs(doc_id, text)`` without lines that at least ``least_docs`` documents hold.

    Returns ``(doc_id, n_lines, n_dropped, most_docs, kept)``: lines before, lines dropped, the largest
    number of documents that holds one of the dropped lines (0 if none), and the other lines joined again.
    A line stays in the largest doc_id that holds it. A line is known by 128 bits of hash.

    Repeated lines are counted once, written, and indexed by a minimal perfect hash in shards of about
    ``shard_lines``. If there are at most ``broadcast_lines``, documents probe the broadcast arrays and no
    line moves. Of more, the lines held by the most documents are broadcast: those with at least
    ``total / broadcast_lines`` documents, of which there can't be more than that. Lines that are not among
    them go to the shards of the rest, where none meets more probes than that quotient, and only the hits
    come back. Both ways give the same rows.

    A null text is one empty line. A null doc_id counts as smaller than any other and stays null. Every row
    counts as a document, also if its doc_id is repeated; all rows of the largest doc_id keep a line. Texts
    are taken whole; one text and its lines must fit in a task. An empty table gives no rows, and other
    columns are not read.
    """
    spark = docs.sparkSession
    lines = written(repeated_lines(docs, least_chars, least_docs), "repeated-lines")
    count, total = lines.agg(F.count("*"), F.coalesce(F.sum("n_docs"), F.lit(0))).head()
    cut = 0 if count <= broadcast_lines else -(-total // broadcast_lines)
    head, tail = lines.where(F.col("n_docs") >= cut), lines.where(F.col("n_docs") < cut)
    shards = max(1, -(-min(count, broadcast_lines) // shard_lines))
    arrays = [(row["shard"], bytes(row["body"])) for row in build_shards(head, shards).collect()]
    sent = spark.sparkContext.broadcast((arrays, shards))
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if cut:
        shards = max(1, -(-count // shard_lines))
        hits = _tail_hits(plain, build_shards(tail, shards), sent, shards, least_chars)
        found = hits.groupBy("owner").agg(F.collect_list("hit").alias("hits"))
        owner = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
        plain = plain.join(found, owner == F.col("owner"), "left").select("doc_id", "text", "hits")

    def kept(batches: Batches) -> Batches:
        shards = Shards(*sent.value)
        for batch in batches:
            keys, content = _ids(batch), texts(batch.column("text"))
            known = batch.column("hits").to_pylist() if cut else [None] * len(keys)
            for start, end in _spans(content):
                yield _kept_rows(batch, keys, content, known, start, end, shards, least_chars)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(kept, f"doc_id {kind}, n_lines bigint, n_dropped bigint, most_docs bigint, kept string")


def _spans(content: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about CHUNK_LINES lines."""
    start, lines = 0, 0
    for at, text in enumerate(content):
        lines += text.count(b"\n") + 1
        if lines >= CHUNK_LINES:
            yield start, at + 1
            start, lines = at + 1, 0
    if start < len(content):
        yield start, len(content)


def _kept_rows(batch, ids, content, known, start, end, shards: Shards, least: int) -> pa.RecordBatch:
    digests, owners, places, counts = [], [], [], []
    for at in range(start, end):
        keys = line_keys(content[at], least)
        counts.append(len(keys))
        for place, key in enumerate(keys):
            if key is not None:
                digests.append(xxhash.xxh3_128_digest(key))
                owners.append(at)
                places.append(place)
    there, last, docs = shards.probe(_hashes(digests))
    drops: dict[int, dict[int, int]] = {}
    gone = there & (last != np.array([ids[at] for at in owners], np.int64))
    for i in np.flatnonzero(gone).tolist():
        drops.setdefault(owners[i], {})[places[i]] = int(docs[i])
    if any(known[start:end]):
        hits = {at: {hit["digest"]: hit["n"] for hit in known[at]} for at in range(start, end) if known[at]}
        for digest, at, place in zip(digests, owners, places):
            if at in hits and digest in hits[at]:
                drops.setdefault(at, {})[place] = hits[at][digest]
    kept = []
    for at in range(start, end):
        text, out = content[at], drops.get(at)
        kept.append(text if out is None else b"\n".join(line for i, line in enumerate(text.split(b"\n")) if i not in out))
    out = [drops.get(at, {}) for at in range(start, end)]
    numbers = counts, [len(d) for d in out], [max(d.values(), default=0) for d in out]
    columns = [pa.array(n, pa.int64()) for n in numbers]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").slice(start, end - start), *columns, pa.array(kept, pa.binary()).view(pa.string())],
        ["doc_id", "n_lines", "n_dropped", "most_docs", "kept"],
    )


def _tail_hits(docs: DataFrame, arrays: DataFrame, sent, shards: int, least: int) -> DataFrame:
    """``(owner, hit)``: lines that documents must drop, among those that are not broadcast."""

    def probes(batches: Batches) -> Batches:
        head = Shards(*sent.value)
        for batch in batches:
            digests, owners = [], []
            for key, text in zip(_ids(batch), texts(batch.column("text"))):
                own = {xxhash.xxh3_128_digest(line) for line in line_keys(text, least) if line is not None}
                digests += own
                owners += [key] * len(own)
                if len(digests) >= CHUNK_LINES:
                    yield rows(head, digests, owners)
                    digests, owners = [], []
            yield rows(head, digests, owners)

    def rows(head: Shards, digests: list[bytes], owners: list[int]) -> pa.RecordBatch:
        keys = _hashes(digests)
        rest = np.flatnonzero(~head.probe(keys)[0])
        shard = (keys[rest, 0] % np.uint64(shards)).astype(np.int32)
        body = pa.array([digests[i] for i in rest.tolist()], pa.binary())
        owner = pa.array(np.array(owners, np.int64)[rest])
        return pa.RecordBatch.from_arrays([pa.array(shard), owner, body], ["shard", "owner", "body"])

    def answers(batches: Batches) -> Batches:
        shard, loaded = None, None
        for batch in batches:
            owners, bodies = batch.column("owner").to_pylist(), batch.column("body").to_pylist()
            numbers, probe = batch.column("shard").to_pylist(), batch.column("probe").to_pylist()
            start = 0
            while start < len(numbers):
                if not probe[start]:
                    shard, loaded = numbers[start], Shards([(numbers[start], bodies[start])], shards)
                    start += 1
                    continue
                end = start
                while end < len(numbers) and probe[end] and numbers[end] == numbers[start]:
                    end += 1
                if numbers[start] == shard:
                    own = np.array(owners[start:end], np.int64)
                    there, last, docs = loaded.probe(_hashes(bodies[start:end]))
                    gone = np.flatnonzero(there & (last != own)).tolist()
                    hits = [{"digest": bodies[start + i], "n": int(docs[i])} for i in gone]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[gone]), pa.array(hits, pa.struct([("digest", pa.binary()), ("n", pa.int64())]))],
                        ["owner", "hit"],
                    )
                start = end

    asked = docs.mapInArrow(probes, "shard int, owner bigint, body binary").withColumn("probe", F.lit(True))
    stored = arrays.select("shard", F.lit(0).cast("bigint").alias("owner"), "body", F.lit(False).alias("probe"))
    # The arrays of a shard come before its probes, so a task holds one shard at a time.
    met = stored.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "probe")
    return met.mapInArrow(answers, "owner bigint, hit struct<digest: binary, n: bigint>")
