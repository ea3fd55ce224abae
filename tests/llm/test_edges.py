"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from corpus_pipeline import STAGES
from evenhand.llm.decontam import contamination
from evenhand.llm.html import extract
from evenhand.llm.licenses import license_spans
from evenhand.llm.lm import likelihoods
from evenhand.llm.ngram_join import similar_groups
from evenhand.llm.packing import pack
from evenhand.llm.pii import personal_data
from evenhand.llm.quality import quality
from evenhand.llm.queries import vocabulary
from evenhand.llm.tokens import count_tokens
from evenhand.llm.toxicity import toxicity

LONG = "the quick brown fox, MIT License a@b.co 10.0.0.1 jumps. " * 4000
GOOD = "It was a fine day in the old town, and many people walked along the river."
TEXTS = [None, GOOD, "", " \n\t ", "one", "é ü 漢字 😀", "a b c d e", "a b c d e", LONG, "x" * 100_000, "1 " * 20_000, "\x00\x01 w"]
ROWS = [*enumerate(TEXTS), (None, "a b c d e"), (None, None), (5, "a b c d e"), (3, "another text"), (1, GOOD)]
#: Names that the operators use themselves.
CLASHING = ("n_words", "score", "kept", "spans", "row", "n", "words", "sig", "item", "length", "piece", "node", "label")
SCHEMA = "doc_id bigint, text string, n_chars bigint, " + ", ".join(f"{name} string" for name in CLASHING)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(
        [(k, t, len(t) if t is not None else None, *CLASHING) for k, t in ROWS], SCHEMA
    ).repartition(3)


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(1, "a b c d e"), (2, None), (None, "one"), (3, ""), (1, "a b c d e")]
    return spark.createDataFrame(items, "item_id bigint, text string")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(3, 1, 0), (4, 0, 1), (1, 1, 0), (7, None, None), (None, 1, 1), (999, 1, 1), (4, 0, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "licenses": lambda docs, b, y: license_spans(docs),
    "pii": lambda docs, b, y: personal_data(docs).select("row.doc_id", "spans"),
    "decontamination": lambda docs, b, y: contamination(docs, b),
    "quality": lambda docs, b, y: quality(docs).select("row.doc_id", "kept"),
    "lm": lambda docs, b, y: likelihoods(docs, F.col("doc_id") != 4),
    "tokens": lambda docs, b, y: count_tokens(docs, vocabulary()),
    "toxicity": lambda docs, b, y: toxicity(docs, y),
    "groups": lambda docs, b, y: similar_groups(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(documents, benchmark, labels, name):
    found = OPERATORS[name](documents, benchmark, labels).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in found) == sorted((k is None, k) for k, _ in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(documents, benchmark, labels, name):
    nothing = [table.filter("false") for table in (documents, benchmark, labels)]
    assert OPERATORS[name](*nothing).count() == 0
    assert OPERATORS[name](documents, *nothing[1:]).count() == len(ROWS)


def test_packing_covers_every_row(documents):
    pieces = pack(documents, vocabulary()).collect()
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
    assert sum(p.start == 0 for p in pieces) == len(ROWS)
    assert pack(documents.filter("false"), vocabulary()).count() == 0


def test_pages(spark):
    pages = [(1, "u", None), (None, None, ""), (2, "v", "<article><p>Hi there</p>"), (2, "v", "<article><p>Hi there</p>")]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, text string")
    found = sorted((r.page_id or 0, r.text) for r in extract(frame).collect())
    assert found == [(0, ""), (1, ""), (2, "Hi there"), (2, "Hi there")]
    assert extract(frame.filter("false")).count() == 0


@pytest.mark.parametrize("name,stage", STAGES[:-1])
def test_stages_keep_the_columns(spark, documents, benchmark, tmp_path, name, stage):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    found = stage(spark, documents, str(tmp_path))
    assert found.columns == documents.columns
    assert 0 < found.count() <= len(ROWS)
    assert stage(spark, documents.filter("false"), str(tmp_path)).count() == 0
