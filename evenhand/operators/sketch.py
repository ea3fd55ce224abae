"""Count-Min and Count sketches as mergeable tables ``(d, col, v)``; an absent cell is 0.

Building a sketch sends at most D*W rows per task to the shuffle, whatever the
skew of the items. Reading it probes all rows of both sketches in one join.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions.hashing import DEFAULT_PRIME, HashRow, bucket_sql, hash_rows, sign_sql

# Sketches of at most this many cells (about 64 MB as a hash table) are broadcast;
# larger ones are joined by shuffle.
BROADCAST_CELLS = 1 << 20


def item_hist(items: DataFrame) -> DataFrame:
    """Exact histogram ``(item, freq)``."""
    return items.groupBy("item").agg(F.count("*").alias("freq"))


def merge_hists(*hists: DataFrame) -> DataFrame:
    """Sum of histograms."""
    return reduce(DataFrame.unionByName, hists).groupBy("item").agg(F.sum("freq").alias("freq"))


def stream_summary(hist: DataFrame) -> DataFrame:
    """``(n_items, n_distinct)`` of a histogram."""
    return hist.agg(
        F.coalesce(F.sum("freq"), F.lit(0).cast("bigint")).alias("n_items"), F.count("*").alias("n_distinct")
    )


def approx_distinct(items: DataFrame, rsd: float = 0.02) -> DataFrame:
    """``(n_distinct)`` estimated without a histogram, for very wide item domains."""
    return items.agg(F.approx_count_distinct("item", rsd).alias("n_distinct"))


def _cm_slot(row: HashRow, d: int, w: int, prime: int) -> str:
    """SQL text of the cell number of an item in Count-Min row ``d``; cells are numbered row by row."""
    return f"{d * w}L + {bucket_sql(row.cm_a, row.cm_b, w, 'item', prime)}"


def _cs_slot(row: HashRow, d: int, w: int, prime: int) -> str:
    return f"{d * w}L + {bucket_sql(row.cs_a, row.cs_b, w, 'item', prime)}"


def _cs_sign(row: HashRow, prime: int) -> str:
    return sign_sql(row.sg_a, row.sg_b, "item", prime)


def _entries(pairs: list[tuple[str, str]], name: str) -> str:
    """SQL text of a generator of ``(slot, <name>)`` rows."""
    structs = ", ".join(f"struct({slot} as slot, {value} as {name})" for slot, value in pairs)
    return f"inline(array({structs}))"


def _counted(source: DataFrame) -> DataFrame:
    """A histogram as it is, or plain items with a count of one each."""
    if "freq" in source.columns:
        return source.select("item", "freq")
    return source.selectExpr("item", "1L as freq")


def _build(source: DataFrame, changes: list[tuple[str, str]], w: int) -> DataFrame:
    cells = _counted(source).selectExpr(_entries(changes, "change"))
    totals = cells.groupBy("slot").agg(F.sum("change").alias("v"))
    return totals.selectExpr(f"cast(slot div {w} as int) as d", f"cast(slot % {w} as int) as col", "v")


def distinct_sketch(items: DataFrame, *by: str, lg_k: int = 12) -> DataFrame:
    """``(<by>, sketch)``: distinct items of every batch as a HyperLogLog sketch of at most ``2**lg_k`` registers."""
    return items.groupBy(*by).agg(F.hll_sketch_agg("item", lg_k).alias("sketch"))


def merged_distinct(*sketches: DataFrame) -> DataFrame:
    """``(n_distinct)``: estimate for all batches together, in whatever order and grouping they are united.

    Its standard error is about ``1.04 / sqrt(2**lg_k)`` of the count; no rows give 0.
    """
    united = reduce(DataFrame.unionByName, [s.select("sketch") for s in sketches])
    estimate = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return united.agg(F.coalesce(estimate, F.lit(0).cast("bigint")).alias("n_distinct"))


def top_k_sketch(items: DataFrame, *by: str, capacity: int = 10_000) -> DataFrame:
    """``(<by>, sketch)``: frequent items of every batch as a mergeable accumulator of at most ``capacity`` items."""
    return items.groupBy(*by).agg(F.expr(f"approx_top_k_accumulate(item, {capacity})").alias("sketch"))


def merged_top_k(sketches: DataFrame, k: int, capacity: int = 10_000) -> DataFrame:
    """``(item, freq)`` of the ``k`` most frequent items of all batches; exact while items are fewer than ``capacity``.

    A cross-check of :func:`heavy_hitters` that needs no histogram. Of equally frequent items at the end
    some are left out.
    """
    whole = sketches.agg(F.expr(f"approx_top_k_combine(sketch, {capacity})").alias("sketch"))
    found = whole.select(F.expr(f"inline(approx_top_k_estimate(sketch, {k}))"))
    return found.toDF("item", "freq")


#: Tables that :func:`frequency_tables` keeps in one, by their number.
HIST, CMS, CS = 0, 1, 2


def frequency_tables(source: DataFrame, hashes, w: int, prime: int = DEFAULT_PRIME) -> DataFrame:
    """Histogram and both sketches as one table ``(kind, key, v)``, from one scan and one shuffle.

    Every item, of a histogram ``(item, freq)`` or plain, gives its own row and its 2D cells; these are summed
    together before and after the shuffle. ``kind`` is HIST, CMS or CS and ``key`` the item or the cell's number,
    see :func:`hist_table`, :func:`cms_table` and :func:`cs_table`. Works on a stream as well.
    """
    rows = hash_rows(hashes)
    entries = [(HIST, "item", "freq")]
    entries += [(CMS, _cm_slot(row, d, w, prime), "freq") for d, row in enumerate(rows)]
    entries += [(CS, _cs_slot(row, d, w, prime), f"{_cs_sign(row, prime)} * freq") for d, row in enumerate(rows)]
    structs = ", ".join(f"struct({kind} as kind, {key} as key, {change} as change)" for kind, key, change in entries)
    return _counted(source).selectExpr(f"inline(array({structs}))").groupBy("kind", "key").agg(F.sum("change").alias("v"))


def hist_table(tables: DataFrame) -> DataFrame:
    """The histogram ``(item, freq)`` of :func:`frequency_tables`."""
    return tables.where(F.col("kind") == HIST).selectExpr("key as item", "v as freq")


def _cells(tables: DataFrame, kind: int, w: int) -> DataFrame:
    rows = tables.where(F.col("kind") == kind)
    return rows.selectExpr(f"cast(key div {w} as int) as d", f"cast(key % {w} as int) as col", "v")


def cms_table(tables: DataFrame, w: int) -> DataFrame:
    """The Count-Min sketch ``(d, col, v)`` of :func:`frequency_tables`."""
    return _cells(tables, CMS, w)


def cs_table(tables: DataFrame, w: int) -> DataFrame:
    """The Count sketch ``(d, col, v)`` of :func:`frequency_tables`."""
    return _cells(tables, CS, w)


def cms_build(source: DataFrame, hashes, w: int, prime: int = DEFAULT_PRIME) -> DataFrame:
    """Count-Min sketch ``(d, col, v)`` of a histogram ``(item, freq)`` or of plain items ``(item)``."""
    rows = hash_rows(hashes)
    return _build(source, [(_cm_slot(row, d, w, prime), "freq") for d, row in enumerate(rows)], w)


def cs_build(source: DataFrame, hashes, w: int, prime: int = DEFAULT_PRIME) -> DataFrame:
    """Count sketch ``(d, col, v)`` of a histogram ``(item, freq)`` or of plain items ``(item)``."""
    rows = hash_rows(hashes)
    changes = [(_cs_slot(row, d, w, prime), f"{_cs_sign(row, prime)} * freq") for d, row in enumerate(rows)]
    return _build(source, changes, w)


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    """Sketch of the union of the inputs; all must share hash family and width."""
    if not sketches:
        raise ValueError("at least one sketch is needed")
    return reduce(DataFrame.unionByName, sketches).groupBy("d", "col").agg(F.sum("v").alias("v"))


def _median_sql(values: str, n: int) -> str:
    """SQL text of the median of ``n`` collected values; the middle pair is halved toward zero."""
    ordered = f"sort_array({values})"
    if n % 2:
        return f"element_at({ordered}, {n // 2 + 1})"
    return f"(element_at({ordered}, {n // 2}) + element_at({ordered}, {n // 2 + 1})) div 2"


class StoredSketch(NamedTuple):
    """Sketches in a table bucketed by cell, for lookups that move the probes alone."""

    table: DataFrame
    name: str
    has_cms: bool
    has_cs: bool

    def drop(self) -> None:
        """Remove the table."""
        self.table.sparkSession.sql(f"drop table if exists {self.name}")


def _numbered(hashes, w: int, cms: DataFrame | None, cs: DataFrame | None) -> DataFrame:
    """Cells ``(slot, v)`` of one or both sketches; Count-Min cells come first, those of the Count sketch after them."""
    tables = []
    if cms is not None:
        tables.append(cms.selectExpr(f"d * {w}L + col as slot", "v"))
    if cs is not None:
        tables.append(cs.selectExpr(f"{len(hash_rows(hashes)) * w}L + d * {w}L + col as slot", "v"))
    if not tables:
        raise ValueError("at least one sketch is needed")
    return reduce(DataFrame.unionByName, tables)


def store_sketches(
    hashes, w: int, cms: DataFrame | None = None, cs: DataFrame | None = None, buckets: int = 200
) -> StoredSketch:
    """Write sketches that are too large to broadcast, once, by the hash of the cell.

    The table lies in the session's warehouse, which all executors must reach. Every later lookup sends its
    probes to the buckets; the cells stay where they are.
    """
    cells = _numbered(hashes, w, cms, cs)
    name = f"sketch_{uuid.uuid4().hex}"
    # One file for each bucket and not for each task and bucket.
    cells.repartition(buckets, "slot").write.bucketBy(buckets, "slot").saveAsTable(name)
    return StoredSketch(cells.sparkSession.table(name), name, cms is not None, cs is not None)


def sketch_estimates(
    items: DataFrame,
    hashes,
    w: int,
    prime: int = DEFAULT_PRIME,
    cms: DataFrame | None = None,
    cs: DataFrame | None = None,
    stored: StoredSketch | None = None,
) -> DataFrame:
    """Estimates ``est_cm`` and/or ``est_cs`` of every item; other columns must depend on the item.

    Each item probes D cells per sketch. The probes stay on the item's own
    partition: with a broadcast sketch and items already partitioned by item
    (as a histogram is), no row moves. Of ``stored`` sketches, see :func:`store_sketches`, no cell moves.
    """
    rows = hash_rows(hashes)
    cells_per_sketch = len(rows) * w
    has_cms, has_cs = (stored.has_cms, stored.has_cs) if stored else (cms is not None, cs is not None)
    probes, results = [], []
    if has_cms:
        probes += [(_cm_slot(row, d, w, prime), "1") for d, row in enumerate(rows)]
        results.append(F.expr(f"min(if(slot < {cells_per_sketch}L, coalesce(v, 0L), null)) as est_cm"))
    if has_cs:
        probes += [
            (f"{cells_per_sketch}L + {_cs_slot(row, d, w, prime)}", _cs_sign(row, prime)) for d, row in enumerate(rows)
        ]
        signed = f"collect_list(if(slot < {cells_per_sketch}L, null, sign * coalesce(v, 0L)))"
        results.append(F.expr(f"{_median_sql(signed, len(rows))} as est_cs"))
    if stored:
        # Neither a broadcast nor a sort of the cells: the buckets are read as the hash side.
        cells = stored.table.hint("shuffle_hash")
    else:
        cells = _numbered(rows, w, cms, cs)
        if (has_cms + has_cs) * cells_per_sketch <= BROADCAST_CELLS:
            cells = F.broadcast(cells)
    others = [name for name in items.columns if name != "item"]
    probed = items.selectExpr("item", *others, _entries(probes, "sign")).join(cells, "slot", "left")
    return probed.groupBy("item", *others).agg(*results)


def cms_estimate(items: DataFrame, sketch: DataFrame, hashes, w: int, prime: int = DEFAULT_PRIME) -> DataFrame:
    """Count-Min estimate ``(item, est)`` of every distinct item: the smallest of its cells."""
    found = sketch_estimates(items.select("item"), hashes, w, prime, cms=sketch)
    return found.withColumnRenamed("est_cm", "est")


def cs_estimate(items: DataFrame, sketch: DataFrame, hashes, w: int, prime: int = DEFAULT_PRIME) -> DataFrame:
    """Count-sketch estimate ``(item, est)`` of every distinct item: the median of its signed cells."""
    found = sketch_estimates(items.select("item").distinct(), hashes, w, prime, cs=sketch)
    return found.withColumnRenamed("est_cs", "est")
