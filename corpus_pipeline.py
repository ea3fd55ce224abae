"""Five stages from raw documents to packed sequences, each over all that the stage before kept.

All stages take documents with a null in any column, empty and very long texts, repeated rows, an empty table (and return one)
and further columns of any name but ``ROW``, and all but the last return them as they are. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm.common import table, written
from evenhand.llm.decontam import contaminated, contamination
from evenhand.llm.ngram_join import similar_groups
from evenhand.llm.packing import pack
from evenhand.llm.pii import personal_data, redacted
from evenhand.llm.quality import quality
from evenhand.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Number of a row within a stage; no column of documents has this name.
ROW = "__row"
#: Rows to take out are broadcast up to this number; beyond it they are joined by shuffle.
BROADCAST_ROWS = 500_000


def numbered(docs: DataFrame, stage: str) -> DataFrame:
    """The documents with a number for every row that stays the same however often they are read."""
    if ROW in docs.columns:
        raise ValueError(f"documents must not have a column {ROW}")
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), stage)


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents without the numbered ``rows``."""
    out = written(rows.select(ROW), "rejected")
    out = F.broadcast(out) if out.count() <= BROADCAST_ROWS else out
    return docs.join(out, ROW, "left_anti").drop(ROW)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the quality rules, as they are. Null and empty texts fail; repeated rows are judged each."""
    # A filter on the verdict would be pushed down and repeat the rules; the generator takes it as it is.
    return quality(docs).select(F.inline(F.when(F.col("kept"), F.array("row"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: its first row. Documents without words, null texts among them, are no group and stay.

    Of repeated rows one stays. Null keys play no part, since rows are numbered.
    """
    rows = numbered(docs, "near-duplicates")
    groups = similar_groups(rows, ROW)
    return without(rows, groups.filter(F.col(ROW) != F.col("component_id")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no benchmark passages, by the rule of contamination. Null texts hold none; repeated rows are judged each."""
    rows = numbered(docs, "decontamination")
    found = contamination(rows, table(spark, sf_dir, "benchmark"), ROW)
    return without(rows, found.filter(contaminated(F.col("n_hit"), F.col("n_words"))))


def personal_data_marks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep all documents, with a mark in the place of each piece of personal data; n_chars follows the text.

    Of overlapping pieces the first one's mark stays. A text without any, a null one among them, keeps its row unchanged.
    """
    found = personal_data(docs).withColumn("__new", redacted(F.col("text"), F.col("spans")))
    changed = F.size("spans") > 0
    new = {"text": F.col("__new"), "n_chars": F.length("__new")}
    return found.select(
        *[
            F.when(changed, new[field.name].cast(field.dataType)).otherwise(F.col("row")[field.name]).alias(field.name)
            if field.name in new
            else F.col("row")[field.name].alias(field.name)
            for field in docs.schema
        ]
    )


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every piece of the remaining documents in sequences. A null text is its end id; repeated rows are packed each."""
    return pack(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data_marks),
    ("packing", packing),
]

#: SQL can express neither the tokenizer of the last stage nor its packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage returns is written and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
