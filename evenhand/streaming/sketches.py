"""Streaming histograms and sketches.

Two forms. The stateful form keeps running aggregates in the executors' state
store: the sketches are bounded by D*W cells, the exact histogram by the number
of distinct items. The prefix form keeps no state: each micro-batch writes its
own counts, and sums of batches are taken when the result is read. It stops
after a given number of items. Both write to tables that merge their batches.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from evenhand.functions.hashing import DEFAULT_PRIME, hash_rows
from evenhand.operators.sketch import (
    HIST,
    cms_build,
    cms_table,
    cs_build,
    cs_table,
    frequency_tables,
    hist_table,
    item_hist,
)
from evenhand.streaming.sinks import BatchTable

# Time between micro-batches, unless a trigger is given.
BATCH_INTERVAL = {"processingTime": "100 milliseconds"}


def _hists(spark: SparkSession, path: str) -> BatchTable:
    return BatchTable(spark, path, "item bigint, freq bigint", ["item"], "freq", "last")


def _sketches(spark: SparkSession, path: str) -> BatchTable:
    return BatchTable(spark, path, "d int, col int, v bigint", ["d", "col"], "v", "last")


def _all(spark: SparkSession, path: str, combine: str) -> BatchTable:
    schema = "kind int, key bigint, v bigint"
    return BatchTable(spark, path, schema, ["kind", "key"], "v", combine, parts=("kind",))


def _start(updates: DataFrame, sink: BatchTable, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        sink.write(batch, batch_id)

    writer = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(**(trigger or BATCH_INTERVAL)).start()


def stream_hist(items: DataFrame, out_dir: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Running exact histogram; each batch writes the items whose count changed."""
    return _start(item_hist(items), _hists(items.sparkSession, out_dir), checkpoint, trigger)


def stream_cms(
    items: DataFrame,
    hashes,
    w: int,
    out_dir: str,
    checkpoint: str,
    prime: int = DEFAULT_PRIME,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Running Count-Min sketch; the state never exceeds D*W cells."""
    return _start(cms_build(items, hashes, w, prime), _sketches(items.sparkSession, out_dir), checkpoint, trigger)


def stream_cs(
    items: DataFrame,
    hashes,
    w: int,
    out_dir: str,
    checkpoint: str,
    prime: int = DEFAULT_PRIME,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Running Count sketch; the state never exceeds D*W cells."""
    return _start(cs_build(items, hashes, w, prime), _sketches(items.sparkSession, out_dir), checkpoint, trigger)


def stream_tables(
    items: DataFrame,
    hashes,
    w: int,
    out_dir: str,
    checkpoint: str,
    prime: int = DEFAULT_PRIME,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Running histogram and both sketches from one stateful aggregation: one scan and one shuffle for a batch."""
    tables = frequency_tables(items, hashes, w, prime)
    return _start(tables, _all(items.sparkSession, out_dir, "last"), checkpoint, trigger)


def read_hist(spark: SparkSession, out_dir: str) -> DataFrame:
    """Current histogram written by :func:`stream_hist`."""
    return _hists(spark, out_dir).read()


def read_sketch(spark: SparkSession, out_dir: str) -> DataFrame:
    """Current sketch written by :func:`stream_cms` or :func:`stream_cs`."""
    return _sketches(spark, out_dir).read()


def read_tables(spark: SparkSession, out_dir: str) -> DataFrame:
    """Current tables ``(kind, key, v)`` written by :func:`stream_tables`."""
    return _all(spark, out_dir, "last").read()


class _Watch(StreamingQueryListener):
    """Follows the query of one run; the start of a query is reported before anything else of it."""

    def __init__(self, run: PrefixRun) -> None:
        self.run, self.run_id = run, None

    def onQueryStarted(self, event) -> None:
        if event.name == self.run.name:
            self.run_id = event.runId

    def onQueryProgress(self, event) -> None:
        if event.progress.runId == self.run_id:
            self.run.seen = event.progress.batchId
            self.run.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        if event.runId == self.run_id:
            self.run.tell(self.run.idle)

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run_id:
            self.run.tell(self.run.ended)


class PrefixRun:
    """A running prefix query and the tables it writes.

    ``rows`` and ``seen`` tell how many rows the query has read so far and its latest batch.
    """

    def __init__(self, spark: SparkSession, out_dir: str, w: int, t: int) -> None:
        self.spark, self.w, self.t = spark, w, t
        self.tables = _all(spark, out_dir, "sum")
        self.done, self.idle, self.ended, self.changed = (threading.Event() for _ in range(4))
        self.rows, self.seen, self.name = 0, -1, f"prefix-{uuid.uuid4().hex}"
        self.query: StreamingQuery | None = None

    def tell(self, event: threading.Event) -> None:
        event.set()
        self.changed.set()

    def start(self, writer: DataStreamWriter) -> None:
        self._watch = _Watch(self)
        self.spark.streams.addListener(self._watch)
        self.query = writer.queryName(self.name).start()

    def wait(self, timeout: float | None = None, until_idle: bool = False) -> bool:
        """Wait until ``t`` items have arrived or the stream has ended, then stop; True if ``t`` was reached.

        With ``until_idle`` a stream that has nothing new for a while is stopped as well. The query
        reports what happens, so nothing is polled; after ``timeout`` seconds it is left running.
        """
        while not (self.done.is_set() or self.ended.is_set() or (until_idle and self.idle.is_set())):
            if not self.changed.wait(timeout):
                return False
            self.changed.clear()
        self.query.stop()
        if self._watch is not None:
            self.spark.streams.removeListener(self._watch)
            self._watch = None
        if self.query.exception() is not None:
            raise self.query.exception()
        return self.done.is_set()

    def progress(self) -> DataFrame:
        """``(first_batch, last_batch, n)``: items of the batches that were taken, older ones together."""
        rows = [(f.first, f.last, f.n) for f in self.tables.folders()]
        return self.spark.createDataFrame(rows, "first_batch bigint, last_batch bigint, n bigint")

    def hist(self) -> DataFrame:
        return hist_table(self.tables.read("kind = 0"))

    def cms(self) -> DataFrame:
        return cms_table(self.tables.read("kind = 1"), self.w)

    def cs(self) -> DataFrame:
        return cs_table(self.tables.read("kind = 2"), self.w)


def _n_items(tables: DataFrame) -> int:
    """Number of items of a batch, from its histogram."""
    return tables.where(F.col("kind") == HIST).agg(F.coalesce(F.sum("v"), F.lit(0))).head()[0]


def stream_sketches(
    items: DataFrame,
    hashes,
    w: int,
    t: int,
    out_dir: str,
    checkpoint: str,
    prime: int = DEFAULT_PRIME,
    trigger: dict | None = None,
) -> PrefixRun:
    """Histogram and both sketches of a stream that is left after ``t`` items.

    One query runs until then. What a micro-batch holds is up to the source's own limits (``maxFilesPerTrigger``
    or ``maxBytesPerTrigger`` of files). The batch that reaches ``t`` is taken whole and later ones are ignored. A batch is
    read once and shuffled once, its three tables together. A batch that is replayed after a failure replaces its
    own rows, and a restarted run finds the size of the earlier batches in the manifest of the tables.
    """
    if t < 1:
        raise ValueError("t must be at least 1")
    rows = hash_rows(hashes)
    run = PrefixRun(items.sparkSession, out_dir, w, t)

    def take(batch: DataFrame, batch_id: int) -> None:
        prior = run.tables.n_before(batch_id)
        if prior < t:
            run.tables.write(frequency_tables(batch, rows, w, prime), batch_id, _n_items)
            prior = run.tables.n_before(batch_id + 1)
        if prior >= t:
            run.tell(run.done)

    writer = items.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
    run.start(writer.trigger(**(trigger or BATCH_INTERVAL)))
    return run
