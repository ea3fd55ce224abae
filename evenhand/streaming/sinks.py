"""Tables written batch by batch, which stay small however many batches there are.

A micro-batch writes a folder of its own, so a batch that is replayed after a failure replaces its
rows. Once ten folders of a level are there, they are merged into one of the next level, so n batches
leave at most nine folders for each digit of n, and every row is rewritten once for each digit.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.storage import SmallFile

FANOUT = 10


class Folder(NamedTuple):
    """Rows of the batches ``first`` to ``last``; ``n`` is what their writers counted."""

    level: int
    first: int
    last: int
    n: int
    path: str


class BatchTable:
    """A table of values by key, as the combination of what batches wrote.

    ``combine`` is ``sum`` for batches that write changes and ``last`` for batches that write new values;
    either way a batch holds a key once at most. ``parts`` names key columns that become folders, so that
    a reader of one part leaves the others alone.

    The manifest lists the live folders. It is replaced as a whole after a batch and its merges are written;
    without it a batch does not count. Folders that were merged are removed when the next batch is
    written, since only then is the batch before it surely not replayed.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str,
        keys: list[str],
        value: str,
        combine: str = "sum",
        parts: tuple[str, ...] = (),
        fanout: int = FANOUT,
    ) -> None:
        if combine not in ("sum", "last"):
            raise ValueError("combine must be 'sum' or 'last'")
        if fanout < 2:
            raise ValueError("at least two folders are merged")
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.value, self.combine, self.parts, self.fanout = keys, value, combine, parts, fanout
        self._manifest = SmallFile(spark, f"{self.path}/manifest.json")

    def _state(self) -> tuple[list[Folder], list[str]]:
        found = json.loads(self._manifest.read() or '{"live": [], "merged": []}')
        return [Folder(*row) for row in found["live"]], found["merged"]

    def folders(self) -> list[Folder]:
        """Live folders in the order of their batches."""
        return self._state()[0]

    def n_before(self, batch_id: int) -> int:
        """Total of the counts of earlier batches, as far as they are not merged with this one."""
        return sum(f.n for f in self.folders() if f.last < batch_id)

    def write(self, df: DataFrame, batch_id: int, count=None) -> int:
        """Write one micro-batch, replacing an earlier attempt, and merge what is due; returns its count.

        ``count`` is called with the written rows and gives the number to keep for the batch. A batch that is part
        of a merged folder was written whole before, so its replay changes nothing.
        """
        live, merged = self._state()
        for folder in live:
            if folder.level and folder.first <= batch_id <= folder.last:
                return 0
        for old in merged:
            self._manifest.remove(old)
        live = [f for f in live if f.first != batch_id]
        path = self._folder(0, batch_id, batch_id)
        self._save(df, path)
        session = df.sparkSession
        n = count(self._load(session, [path])) if count else 0
        live = sorted([*live, Folder(0, batch_id, batch_id, n, path)], key=lambda f: f.first)
        merged, level = [], 0
        while len(due := [f for f in live if f.level == level]) >= self.fanout:
            target = self._folder(level + 1, due[0].first, due[-1].last)
            self._save(self._combined(session, due), target)
            joined = Folder(level + 1, due[0].first, due[-1].last, sum(f.n for f in due), target)
            live = sorted([joined, *(f for f in live if f.level != level)], key=lambda f: f.first)
            merged += [f.path for f in due]
            level += 1
        self._manifest.replace(json.dumps({"live": live, "merged": merged}))
        return n

    def _folder(self, level: int, first: int, last: int) -> str:
        return f"{self.path}/level={level}/batches={first}-{last}"

    def _save(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").partitionBy(*self.parts).parquet(path)

    def _load(self, session: SparkSession, paths: list[str]) -> DataFrame:
        reader = session.read.schema(f"{self.schema}, level int, batches string").option("basePath", self.path)
        return reader.parquet(*paths)

    def _combined(self, session: SparkSession, folders: list[Folder], where: str = "true") -> DataFrame:
        rows = self._load(session, [f.path for f in folders]).where(where)
        if self.combine == "sum":
            value = F.sum(self.value)
        else:
            value = F.max_by(self.value, F.split("batches", "-")[1].cast("bigint"))
        return rows.groupBy(*self.keys).agg(value.alias(self.value))

    def read(self, where: str = "true") -> DataFrame:
        """Current value of every key, of the keys that ``where`` keeps."""
        live = self.folders()
        if not live:
            return self.spark.createDataFrame([], self.schema).select(*self.keys, self.value)
        return self._combined(self.spark, live, where)
