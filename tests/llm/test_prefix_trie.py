"""The prefix trie against a plain one, in one run and cut into many."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from evenhand.llm import prefix_trie as trie
from evenhand.llm.prefix_trie import RangeMinimum, prefix_trie, turn_sequences, with_shared_heads

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n_convs int, node string, run string"


def in_order(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            turns.setdefault(conv, []).append(((turn is not None, turn or 0), digest, role, text))
    return {conv: [t[2:] for t in sorted(own)] for conv, own in turns.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {p: [] for p in members}
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = sum(saved[c] for c in children[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    rows = []
    for p, own in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in own if len(convs[c]) == len(p)))
        parent = min(members[p[:-1]]) if p else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        rows.append((min(own), len(p), parent, len(own), len(children[p]), leaves[p], saved[p], sha))
    return sorted(rows, key=repr)


def found(frame):
    columns = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(row[c] for c in columns) for row in frame.collect()), key=repr)


def sample(seed, n=400):
    """Conversations with few different turns, so that prefixes branch at all depths and many are equal."""
    draw = random.Random(seed)
    says = ["hi", "hello é漢", "", "a", "b" * 50]
    rows = []
    for c in draw.sample(range(-300, 5000), n):
        for turn in range(draw.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, turn, draw.choice(["user", "assistant"]), says[min(int(draw.expovariate(1)), 4)]))
    return rows


EDGES = [
    (None, 0, "user", "no conversation"), (1, None, "user", None), (1, None, None, "x"), (1, 0, None, None),
    (1, 0, "user", "tie"), (1, 0, "assistant", "tie"), (1, 0, "user", "tie"), (2, 5, "user", ""), (7, 1, "user", "long" * 90_000),
    *[(9, k, "user", f"turn {k}") for k in range(700)], *[(10, k, "user", f"turn {k}") for k in range(650)],
]


@pytest.mark.parametrize("turns,bits,partitions", [(1 << 15, 12, 3), (40, 2, 1), (1, 0, 5), (7, 12, 8)])
def test_same_as_plain(spark, monkeypatch, turns, bits, partitions):
    monkeypatch.setattr(trie, "RUN_TURNS", turns)
    monkeypatch.setattr(trie, "LISTED_BITS", bits)
    rows = sample(turns) + EDGES
    table = spark.createDataFrame([(*row, 1, "x", "y") for row in rows], SCHEMA).repartition(partitions)
    convs = in_order(rows)
    assert found(prefix_trie(turn_sequences(table))) == plain(convs)
    assert found(prefix_trie(with_shared_heads(turn_sequences(table)))) == plain(rebuilt(convs))


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN_TURNS", 30)
    monkeypatch.setattr(trie, "BROADCAST_ROWS", 0)
    rows = sample(5)
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert found(prefix_trie(turn_sequences(table))) == plain(in_order(rows))


def test_turnless_conversations_end_at_the_root(spark):
    # Of 106, whose h is 3, nothing is left without conversation 100.
    assert zlib.crc32(b"106") % 6 == 3
    rows = [(106, k, "user", "x") for k in range(3)] + [(107, 0, "user", "y")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    result = found(prefix_trie(with_shared_heads(turn_sequences(table))))
    assert result == plain(rebuilt(in_order(rows)))
    assert [row for row in result if row[1] == 0][0][7] != trie.NO_ENDS


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie(with_shared_heads(turn_sequences(table))).count() == 0


def test_range_minimum():
    draw = np.random.default_rng(4)
    values = draw.integers(0, 6, 97)
    table = RangeMinimum(values)
    start, least = np.repeat(np.arange(97), 7), np.tile(np.arange(7), 97)
    right, left = table.right(start, least), table.left(start, least)
    for s, d, r, l in zip(start, least, right, left):
        assert (values[s + 1 : r + 1] >= d).all() and (r == 96 or values[r + 1] < d)
        assert (values[l + 1 : s + 1] >= d).all() and (l == 0 or values[l] < d)
    first = np.repeat(np.arange(97), 97)
    last = np.tile(np.arange(97), 97)
    first, last = first[first <= last], last[first <= last]
    assert table.least(first, last).tolist() == [values[a : b + 1].min() for a, b in zip(first, last)]
