"""Integer items from text lines or tables, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_items(lines: DataFrame, mode: str = "strict"):
    """Parse a column ``value`` of text lines into 64-bit items ``(item)``.

    ``strict`` fails on the first bad line. ``permissive`` returns
    ``(items, rejects)`` with rejects as ``(value)``.
    """
    if mode not in ("strict", "permissive"):
        raise ValueError("mode must be 'strict' or 'permissive'")
    parsed = lines.select("value", F.expr("try_cast(value as bigint)").alias("item"))
    if mode == "strict":
        message = F.concat(F.lit("not a 64-bit integer: "), F.coalesce("value", F.lit("null")))
        item = F.when(F.col("item").isNotNull(), F.col("item")).otherwise(F.raise_error(message).cast("bigint"))
        return parsed.select(item.alias("item"))
    items = parsed.where(F.col("item").isNotNull()).select("item")
    rejects = parsed.where(F.col("item").isNull()).select("value")
    return items, rejects


def file_pattern(path: str) -> str:
    """A pattern that matches ``path`` alone. File streams take a folder or a pattern, not the path of a single file."""
    return f"{path[:-1]}[{path[-1]}]"


def read_items(
    spark: SparkSession,
    fmt: str = "text",
    options: dict[str, str] | None = None,
    column: str = "value",
    streaming: bool = True,
    schema: T.StructType | str | None = None,
    mode: str = "strict",
):
    """Items from any Spark source: ``text`` and ``socket`` lines are parsed, other formats give ``column``.

    ``options`` are the source's own (``path``, ``host``, ``port``, ...); of a file stream,
    ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` says how much a micro-batch takes in, in whole
    files by modification time. File streams other than text need ``schema``, of which only
    ``column`` is read; ``column`` may be an expression over it.
    """
    reader = (spark.readStream if streaming else spark.read).format(fmt).options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    source = reader.load().select(F.expr(column).alias("value"))
    if isinstance(source.schema["value"].dataType, T.StringType):
        return parse_items(source, mode)
    items = source.select(F.col("value").cast("bigint").alias("item"))
    return items if mode == "strict" else (items, source.select(F.lit("").alias("value")).where("false"))
