"""The Jaccard join against all pairs, and the pipeline."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evenhand.llm import ngram_join
from evenhand.llm.ngram_join import similar_groups

SF = "/root/testdata/sf0.001"


def shingles(text: str) -> frozenset:
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
    if len(words) < 4:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3))


def plain_groups(rows: list[tuple[int, str]]) -> dict[int, tuple[int, int]]:
    sets = {key: shingles(text) for key, text in rows}
    group = {key: key for key in sets}

    def root(key):
        while group[key] != key:
            key = group[key]
        return key

    places = defaultdict(set)
    for key, found in sets.items():
        for gram in found:
            places[gram].add(key)
    for a in sorted(sets):
        for b in sorted({b for gram in sets[a] for b in places[gram] if b > a}):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                group[high] = low
    return {key: (len(sets[key]), root(key)) for key in sets}


def corpus() -> list[tuple[int, str]]:
    """Copies, near copies of many degrees, chains, shared passages and short texts."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = ["", " ", "one", "one", "One two", "a b c", "a b c d", "A b c d"]
    passage = [word() for _ in range(60)]
    for size in (6, 7, 12, 30, 60, 200, 700):
        base = [word() for _ in range(size)]
        for _ in range(12):
            near = list(base)
            for _ in range(rng.randrange(0, max(2, size // 12))):
                near[rng.randrange(size)] = word()
            texts += [" ".join(near)] * rng.choice((1, 1, 1, 3))
        chain = list(base)
        for at in range(0, size, max(1, size // 9)):
            chain[at] = word()
            texts.append(" ".join(chain))
    for _ in range(40):
        texts.append(" ".join([word() for _ in range(90)] + passage + [word() for _ in range(90)]))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("direct,table,passes", [(60_000, 500_000, 2), (0, 500_000, 1), (200, 0, 2)])
def test_same_groups_as_all_pairs(spark, monkeypatch, direct, table, passes):
    monkeypatch.setattr(ngram_join, "DIRECT_PAIRS", direct)
    monkeypatch.setattr(ngram_join, "TABLE_SIZE", table)
    monkeypatch.setattr(ngram_join, "PASSES", passes)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(docs).collect()}
    assert found == plain_groups(rows)


@pytest.mark.parametrize("boundary", [0, 20, 100, 5000])
def test_any_boundary_gives_the_same_groups(spark, monkeypatch, boundary):
    monkeypatch.setattr(ngram_join, "cheapest_boundary", lambda shared: boundary)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(docs).collect()}
    assert found == plain_groups(rows)


def test_null_keys(spark):
    rows = [(None, "a b c d e"), (7, "a b c d e"), (3, "a b c d e"), (None, "x y z w v")]
    found = similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (0, 3), (3, 3), (7, 3)]


def test_pipeline(spark, tmp_path):
    """Each stage against brute force on its own input."""
    from tests.llm.test_rules import plain_quality, plain_spans

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_name = dict(corpus_pipeline.STAGES)

    def after(name, before):
        frame = by_name[name](spark, before, SF)
        frame.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    good = after("quality_rules", docs)
    kept = {r.doc_id: r.text for r in good.collect()}
    assert kept and not any(plain_quality(text)[-1] for text in kept.values())
    single = after("near_duplicates", good)
    groups = plain_groups(list(kept.items()))
    left = {r.doc_id: r.text for r in single.collect()}
    assert sorted(groups[key][1] for key in left) == sorted({g for _, g in groups.values()})
    clean = after("decontamination", single)
    assert 0 < clean.count() <= len(left)
    marked = {r.doc_id: r for r in after("personal_data", clean).collect()}
    assert set(marked) == {r.doc_id for r in clean.collect()}
    for key, row in marked.items():
        assert row.n_chars == len(row.text) and plain_spans(row.text) == ""
        assert bool(plain_spans(left[key])) <= (row.text != left[key])
    pieces = by_name["packing"](spark, spark.read.parquet(f"{tmp_path}/personal_data"), SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(marked)
    whole = corpus_pipeline.run(spark, SF)
    assert whole.agg(F.sum("length")).collect() == pieces.agg(F.sum("length")).collect()
