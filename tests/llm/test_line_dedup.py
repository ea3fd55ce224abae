"""Line removal against a plain version, and the perfect hash behind it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.llm.line_dedup import drop_shared_lines
from evenhand.llm.perfect_hash import PerfectHash


def plain(rows, least_chars=20, least_docs=3):
    white = " \t\n\x0b\x0c\r"

    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(white))

    holders = {}
    for at, (doc, text) in enumerate(rows):
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= least_chars:
                holders.setdefault(k, []).append(-1 if doc is None else doc)
    out = []
    for doc, text in rows:
        lines, kept, most = (text or "").split("\n"), [], 0
        for line in lines:
            held = holders.get(key(line), [])
            if len(held) >= least_docs and max(held) != (-1 if doc is None else doc):
                most = max(most, len(held))
            else:
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), most, "\n".join(kept)))
    return sorted(out, key=repr)


def sample(n, seed):
    draw = random.Random(seed)
    common = [f"Shared line number {i} of them all é漢" for i in range(40)]
    rows = []
    for doc in range(n):
        lines = []
        for _ in range(draw.randrange(12)):
            line = draw.choice(common) if draw.random() < 0.6 else f"own {draw.random()} of document {doc}"
            line = line.upper() if draw.random() < 0.2 else line
            lines.append(draw.choice(["", " ", "\t", "\x0b\r"]) + line + draw.choice(["", " ", "\x85", " "]))
        rows.append((doc, "\n".join(lines)))
    return rows


EDGES = [
    (None, None), (None, "Shared line number 0 of them all é漢"), (7, "repeated row that is long enough"),
    (7, "repeated row that is long enough"), (3, "repeated row that is long enough\n\n"), (9, "\n" * 50), (9, ""),
    (11, "é" * 19), (12, "é" * 19), (13, "é" * 19), (14, "é" * 20), (15, "é" * 20), (16, "É" * 20), (17, "é" * 20),
    (18, "x" * 300_000), (19, " " + "X" * 300_000), (20, "x" * 300_000 + "\n" + "x" * 300_000),
]


@pytest.mark.parametrize("broadcast,shard", [(2_000_000, 100_000), (2_000_000, 7), (8, 5), (1, 1)])
def test_same_as_plain(spark, broadcast, shard):
    rows = sample(120, 1) + EDGES
    docs = spark.createDataFrame([(*row, "x", 1, 2) for row in rows], "doc_id bigint, text string, kept string, h1 int, owner int")
    found = drop_shared_lines(docs.repartition(4), broadcast_lines=broadcast, shard_lines=shard).collect()
    assert sorted(map(tuple, found), key=repr) == plain(rows)


def test_lines_in_chunks(spark, monkeypatch):
    monkeypatch.setattr("evenhand.llm.line_dedup.CHUNK_LINES", 3)
    rows = sample(60, 2)
    for broadcast in (100, 2):
        found = drop_shared_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), broadcast_lines=broadcast)
        assert sorted(map(tuple, found.collect()), key=repr) == plain(rows)


def test_empty_table(spark):
    assert drop_shared_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_one_line_in_a_third_of_documents_is_one_row_per_task(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "a line that a third of all documents hold").otherwise(F.concat(F.lit("own line of document "), "id")).alias("text"),
    )
    found = drop_shared_lines(docs, broadcast_lines=1).agg(F.sum("n_dropped"), F.max("most_docs")).head()
    assert tuple(found) == (999, 1000)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    draw = np.random.default_rng(n)
    keys = draw.integers(0, 1 << 64, (n, 2), np.uint64)
    keys[: n // 2, 0] = 5
    built = PerfectHash.build(keys)
    again = PerfectHash.from_bytes(built.to_bytes())
    assert sorted(again.slots(keys).tolist()) == list(range(n))
    other = again.slots(draw.integers(0, 1 << 64, (100, 2), np.uint64))
    assert ((other >= -1) & (other < max(n, 1))).all()
    assert len(built.to_bytes()) < 8 * (n * 0.7 + 100)
