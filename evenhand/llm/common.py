"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.storage import new_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Runs of characters outside words: all of ASCII except 0-9 and a-z (the text is in lower case).
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of UTF-8 to lower case, with one space for every ASCII character outside words.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once; the result reads those files and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; other letters keep their case. Pure ASCII text takes the fast built-in."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def texts(column: pa.Array) -> list[bytes]:
    """Texts of one Arrow column as UTF-8 bytes; a null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [value or b"" for value in column.cast(kind).to_pylist()]


def lower_words(text: bytes) -> list[bytes]:
    """Words of ASCII letters, digits and all non-ASCII characters, with A-Z in lower case."""
    return text.translate(WORD_BYTES).split()


def crc_remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; a null key counts as empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor).cast("int")


Batches = Iterator[pa.RecordBatch]
