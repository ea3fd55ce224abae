"""Fixed-decimal text of results, for reports that are read by people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_text(x: Column | str, digits: int = 6) -> Column:
    """``(c1,...,cd)`` with a fixed number of decimals, whatever the locale of the machine."""
    numbers = F.transform(x, lambda v: F.format_string(f"%.{digits}f", v))
    return F.concat(F.lit("("), F.array_join(numbers, ","), F.lit(")"))
