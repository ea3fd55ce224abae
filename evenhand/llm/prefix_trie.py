"""Prefix trie of conversations: sorted sequences, their common prefix lengths, and range minima over these."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import Batches, written

#: Conversations whose ids are equal without so many last bits are listed together for the hash of a node's ends.
LISTED_BITS = 12
#: Turns after which a run of sorted sequences ends; a run is one row with one table of range minima.
RUN_TURNS = 1 << 15
#: Tables with at most this many rows are broadcast.
BROADCAST_ROWS = 200_000
KEY = 16
ROOT = bytes(KEY)
NO_ENDS = hashlib.sha256().hexdigest()


# Sequences of turns


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turns)`` with the turns ``(turn, digest, chars)`` of every conversation in order.

    Turns go by number, null first; of equal numbers the smaller SHA-256 of role and text comes first. A null role
    or text is empty. Only digests and lengths are gathered, 48 bytes for each turn; rows without conv_id belong to no
    conversation.
    """
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(
        F.col("turn").cast("bigint").alias("turn"), F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.length(text).cast("bigint").alias("chars"),
    )
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("turn"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))


def with_shared_heads(sequences: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Every conversation with the first h turns of the first one of its block, then its own turns after its first h.

    ``h`` is the crc32 of the decimal conv_id modulo ``most``; the first one of the block is
    ``conv_id - conv_id % block`` and gives no turns if there is none.
    """
    sequences = written(sequences, "conversations")
    heads = sequences.where(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("head_id"), F.slice("turns", 1, max(most - 1, 1)).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = sequences.join(heads, F.col("conv_id") - F.col("conv_id") % block == F.col("head_id"), "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    rest = F.slice("turns", h + 1, F.size("turns"))
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))


def _chained(batches: Batches) -> Batches:
    """A sequence as the ids of its prefixes, one after the other: equal up to where sequences are equal."""
    for batch in batches:
        chains, chars = [], []
        for turns in batch.column("turns").to_pylist():
            key, chain = ROOT, []
            for turn in turns:
                key = hashlib.blake2b(key + turn["digest"], digest_size=KEY).digest()
                chain.append(key)
            chains.append(b"".join(chain))
            chars.append(np.array([turn["chars"] for turn in turns], "<i8").tobytes())
        columns = [batch.column("conv_id"), pa.array(chains, pa.binary()), pa.array(chars, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "chain", "chars"])


# Runs of sorted sequences


class Run(NamedTuple):
    """Distinct sequences in order, end to end: lengths, copies, smallest ids, hashes of ids, characters and prefix ids."""

    lengths: np.ndarray
    copies: np.ndarray
    convs: np.ndarray
    ends: list[str]
    chars: np.ndarray
    keys: np.ndarray

    def packed(self) -> bytes:
        head = np.array([len(self.lengths), len(self.chars)], "<i8")
        numbers = (head, self.lengths, self.copies, self.convs, self.chars)
        parts = [np.asarray(x, "<i8").tobytes() for x in numbers]
        return b"".join([*parts, self.keys.tobytes(), "".join(self.ends).encode()])

    @classmethod
    def unpacked(cls, body: bytes) -> Run:
        m, total = np.frombuffer(body, "<i8", 2).tolist()
        numbers = np.frombuffer(body, "<i8", 3 * m + total, 16)
        lengths, copies, convs, chars = np.split(numbers, [m, 2 * m, 3 * m])
        at = 16 + 8 * len(numbers)
        keys = np.frombuffer(body, np.uint8, KEY * total, at).reshape(total, KEY)
        hexes = body[at + KEY * total :].decode()
        return cls(lengths, copies, convs, [hexes[i : i + 64] for i in range(0, len(hexes), 64)], chars, keys)


def _runs(batches: Batches) -> Batches:
    """Runs of the sequences of one range partition; the lists of ids of a sequence arrive in order and are hashed as they come."""
    part, number = TaskContext.get().partitionId(), 0
    rows: list[tuple] = []
    turns, chain, chars, first, copies, ends = 0, None, b"", 0, 0, hashlib.sha256()

    def run() -> pa.RecordBatch:
        nonlocal rows, turns, number
        chains, texts, firsts, counts, hashes = zip(*rows)
        flat = np.frombuffer(b"".join(chains), np.uint8).reshape(-1, KEY)
        lengths = np.array([len(c) // KEY for c in chains], np.int64)
        body = Run(lengths, np.array(counts), np.array(firsts), list(hashes), np.frombuffer(b"".join(texts), "<i8"), flat)
        values = [[part], [number], [chains[0]], [chains[-1]], [body.packed()]]
        rows, turns, number = [], 0, number + 1
        kinds = pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays(list(map(pa.array, values, kinds)), ["part", "at", "first", "last", "body"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["chain"] != chain:
                if chain is not None:
                    rows.append((chain, chars, first, copies, ends.hexdigest()))
                    turns += 1 + len(chain) // KEY
                    if turns >= RUN_TURNS:
                        yield run()
                chain, chars, first, copies, ends = row["chain"], row["chars"], row["first"], 0, hashlib.sha256()
            ends.update(("," * (copies > 0) + row["ids"]).encode())
            copies += row["copies"]
    if chain is not None:
        rows.append((chain, chars, first, copies, ends.hexdigest()))
        yield run()


def sorted_runs(sequences: DataFrame) -> DataFrame:
    """``(part, at, first, last, body)``: the distinct sequences in order of their prefix ids, in runs.

    Copies of a sequence meet after their ids have been listed in steps of ``2**LISTED_BITS``, so the task of a sequence
    with very many copies reads few rows; it hashes the lists one after the other and holds one at a time.
    """
    chained = sequences.mapInArrow(_chained, "conv_id bigint, chain binary, chars binary")
    step = F.shiftright("conv_id", LISTED_BITS).alias("step")
    listed = chained.groupBy("chain", step).agg(
        F.first("chars").alias("chars"),
        F.min("conv_id").alias("first"),
        F.count("*").alias("copies"),
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"),
    )
    listed = written(listed, "sequences").repartitionByRange("chain").sortWithinPartitions("chain", "step")
    columns = listed.select("chain", "chars", "first", "copies", "ids")
    return columns.mapInArrow(_runs, "part int, at int, first binary, last binary, body binary")


def _common(batches: Batches) -> Batches:
    """Length of the common prefix of the last sequence of a run and the first of the next."""
    for batch in batches:
        found = []
        for a, b in zip(batch.column("last").to_pylist(), batch.column("first").to_pylist()):
            most = min(len(a), len(b)) // KEY
            same = [np.frombuffer(x, np.uint8, KEY * most).reshape(most, KEY) for x in (a, b)]
            found.append(int((same[0] == same[1]).all(axis=1).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array(found, pa.int64())], ["number", "common"])


def with_neighbours(runs: DataFrame) -> DataFrame:
    """``(number, before, after, body)``: runs numbered in order, with the prefix lengths they share with their neighbours (-1: none)."""
    parts = runs.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for row in parts:
        starts.append((row["part"], total))
        total += row["n"]
    if not starts:
        empty = F.lit(-1).cast("bigint")
        return runs.select(F.lit(0).cast("bigint").alias("number"), empty.alias("before"), empty.alias("after"), "body")
    offsets = runs.sparkSession.createDataFrame(starts, "part int, start bigint")
    numbered = runs.join(F.broadcast(offsets), "part").withColumn("number", F.col("start") + F.col("at"))
    lasts = numbered.select((F.col("number") + 1).alias("number"), "last")
    edges = numbered.select("number", "first").join(lasts, "number")
    common = edges.mapInArrow(_common, "number bigint, common bigint")
    small = F.broadcast if total <= BROADCAST_ROWS else lambda table: table
    before = small(common.withColumnRenamed("common", "before"))
    after = small(common.select((F.col("number") - 1).alias("number"), F.col("common").alias("after")))
    joined = numbered.select("number", "body").join(before, "number", "left").join(after, "number", "left")
    none = F.lit(-1).cast("bigint")
    return joined.select("number", F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"), "body")


# Intervals by range minima


class RangeMinimum:
    """Sparse table: level k holds the minimum of 2**k values from each place."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-width], below[width:]))
            width *= 2

    def right(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Last place up to which all values after ``start`` are at least ``least``, each by its own binary search."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[k], 1 << k
            inside = at + step < len(self.levels[0])
            far = inside & (level[np.minimum(at + 1, len(level) - 1)] >= least)
            at = np.where(far, at + step, at)
        return at

    def left(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """First place from which all values up to ``start``, its own left out, are at least ``least``."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[k], 1 << k
            inside = at - step >= 0
            far = inside & (level[np.clip(at - step + 1, 0, len(level) - 1)] >= least)
            at = np.where(far, at - step, at)
        return at

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of the values from ``first`` to ``last``."""
        size = last - first + 1
        k = np.frexp(size.astype(np.float64))[1] - 1
        found = np.empty(len(first), self.levels[0].dtype)
        for level in np.unique(k).tolist():
            at = k == level
            values = self.levels[level]
            found[at] = np.minimum(values[first[at]], values[last[at] - (1 << level) + 1])
        return found


def common_prefixes(run: Run, before: int) -> np.ndarray:
    """Length of the prefix that every sequence shares with the one before it; ``before`` for the first."""
    starts = np.concatenate([[0], np.cumsum(run.lengths)])[:-1]
    shorter = np.minimum(run.lengths[1:], run.lengths[:-1])
    pair = np.repeat(np.arange(len(shorter)), shorter)
    depth = np.arange(len(pair)) - np.repeat(np.cumsum(shorter) - shorter, shorter)
    same = (run.keys[starts[1:][pair] + depth] == run.keys[starts[:-1][pair] + depth]).all(axis=1)
    # Prefix ids are equal only as far as all before them are.
    return np.concatenate([[before], np.bincount(pair[same], minlength=len(shorter))]).astype(np.int64)


def run_nodes(run: Run, before: int, after: int) -> dict[str, np.ndarray]:
    """The nodes of one run, or the pieces of nodes that go on in its neighbours (``open``).

    A node starts at the first sequence that has its prefix; the first sequence of the run carries the pieces
    of all its prefixes. Sums count a node of the subtree where it starts, so pieces add up to the whole node.
    """
    m, lengths = len(run.lengths), run.lengths
    lcp = common_prefixes(run, before)
    minima, convs = RangeMinimum(lcp), RangeMinimum(run.convs)
    held = lcp.copy()
    held[0] = -1
    counts = lengths - held
    start = np.cumsum(counts) - counts
    i = np.repeat(np.arange(m), counts)
    depth = np.arange(len(i)) - start[i] + held[i] + 1
    l, r = minima.left(i, depth), minima.right(i, depth)
    new = depth > lcp[i]

    flat = np.concatenate([[0], np.cumsum(run.chars)])
    begin = np.cumsum(lengths) - lengths
    upto = lambda seq, d: flat[begin[seq] + d] - flat[begin[seq]]  # noqa: E731  characters of the first d turns
    whole = upto(np.arange(m), lengths)
    own = whole - upto(np.arange(m), np.maximum(lcp, 0))
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    between = lambda x: x[r + 1] - x[l]
    n = between(sums(run.copies))
    above = upto(i, np.maximum(depth - 1, 0))
    once = between(sums(own)) - np.where(new, own[i] - (whole[i] - above), 0)
    leaf = np.concatenate([lcp[1:], [after]]) < lengths

    top = np.maximum(depth - 1, 0)
    at = minima.left(i, top)
    parent = start[at] + top - held[at] - 1
    children = np.bincount(parent[new & (depth > 0)], minlength=len(i))
    closed = ~(((i == 0) & (depth <= before)) | ((r == m - 1) & (depth <= after)))
    smallest = convs.least(l, r)
    keys = np.concatenate([np.zeros((1, KEY), np.uint8), run.keys])
    return {
        "node": keys[np.where(depth > 0, begin[i] + depth, 0)],
        "parent": keys[np.where(depth > 1, begin[i] + depth - 1, 0)],
        "depth": depth,
        "conv_id": smallest,
        "n_convs": n,
        "n_children": children,
        "n_leaves": between(sums(leaf)),
        "saved_tokens": between(sums(run.copies * whole)) - n * above - once,
        "parent_conv_id": smallest[parent],
        "parent_open": ~closed[parent],
        "open": ~closed,
        "end": np.where(depth == lengths[i], i, -1),
    }


NUMBERS = ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "parent_conv_id")


def _nodes(batches: Batches) -> Batches:
    for batch in batches:
        columns = (batch.column(name).to_pylist() for name in ("number", "before", "after", "body"))
        for number, before, after, body in zip(*columns):
            run = Run.unpacked(body)
            found = run_nodes(run, before, after)
            size = len(found["depth"])
            for at in range(0, size, 1 << 16):
                part = {name: values[at : at + (1 << 16)] for name, values in found.items()}
                out = {name: pa.array(np.ascontiguousarray(part[name], np.int64)) for name in NUMBERS}
                out |= {name: pa.array(part[name]) for name in ("open", "parent_open")}
                for name in ("node", "parent"):
                    out[name] = pa.FixedSizeBinaryArray.from_buffers(
                        pa.binary(KEY), len(part[name]), [None, pa.py_buffer(part[name].tobytes())]
                    ).cast(pa.binary())
                out["ends_sha256"] = pa.array([None if e < 0 else run.ends[e] for e in part["end"].tolist()], pa.string())
                out["run"] = pa.array(np.full(len(part["depth"]), number, np.int64))
                names = [name.split()[0] for name in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([out[name] for name in names], names)


PIECES = (
    "run bigint, node binary, parent binary, depth bigint, conv_id bigint, n_convs bigint, n_children bigint,"
    " n_leaves bigint, saved_tokens bigint, parent_conv_id bigint, parent_open boolean, open boolean, ends_sha256 string"
)
RESULT = ["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """Nodes of the trie of ``sequences(conv_id, turns)``, which have one row for each conversation.

    A node is a distinct sequence of first turns, the root that of none. Returns ``(node, conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``: an id of 16 bytes from the turns alone, the smallest conv_id
    among the members (conversations that start with it), number of turns, the smallest member of the parent, members, child
    nodes, childless nodes of the subtree, characters that the subtree's nodes save when each is stored once, and the hash
    of the members that end there.

    Sequences are sorted by the ids of their prefixes over range partitions and cut into runs of about ``RUN_TURNS``
    turns. Within a run, every prefix finds its first and last sequence by binary search over a sparse table of
    minimum common prefixes. Runs know what they share with their neighbours, so the pieces of a node that
    spans several runs add up, and only those few pieces are joined by key. No group is gathered anywhere; a
    conversation is held whole, with 24 bytes for each turn.

    A conversation without turns ends at the root, conversations that are equal share all nodes, ties of members
    go to the smaller conv_id, and without conversations there are no nodes.
    """
    runs = with_neighbours(written(sorted_runs(sequences), "runs"))
    pieces = written(runs.mapInArrow(_nodes, PIECES), "nodes")
    parts = pieces.where("open")
    whole = parts.groupBy("node").agg(
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256"),
    )
    whole = written(whole, "split-nodes")
    small = F.broadcast if parts.count() <= BROADCAST_ROWS else lambda table: table
    known = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("found"))
    split = whole.join(small(known), "parent", "left").withColumn("parent_conv_id", F.col("found"))
    # By run as well, so that no parent with very many children becomes one key.
    by_run = parts.select("run", F.col("node").alias("parent")).join(small(known), "parent")
    inner = pieces.where("not open and not parent_open")
    outer = pieces.where("not open and parent_open").join(small(by_run), ["run", "parent"])
    outer = outer.withColumn("parent_conv_id", F.col("found"))
    found = inner.select(RESULT).unionByName(outer.select(RESULT)).unionByName(split.select(RESULT))
    top: Column = F.when(F.col("depth") > 0, F.col("parent_conv_id"))
    return found.withColumn("parent_conv_id", top).fillna({"ends_sha256": NO_ENDS})
