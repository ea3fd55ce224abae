"""Shared storage for results that must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the session names none, a local session (tests) gets a temporary
    folder; on a cluster that would be lost with its machine, so it is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = sc.getCheckpointDir()
    if folder is None:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="evenhand-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class SmallFile:
    """A small text file in any store that Spark reads, replaced as a whole or not at all."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._hadoop = spark._jvm.org.apache.hadoop
        self._gateway = spark.sparkContext._gateway
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.path = self._hadoop.fs.Path(path)

    def _files(self, path=None):
        return (path or self.path).getFileSystem(self._conf)

    def read(self) -> str | None:
        """Text of the file, None if there is none."""
        files = self._files()
        if not files.exists(self.path):
            return None
        stream = files.open(self.path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, text: str) -> None:
        fresh = self._hadoop.fs.Path(self.path.getParent(), f".{self.path.getName()}.{uuid.uuid4().hex}")
        stream = self._files().create(fresh, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = self._hadoop.fs.Options.Rename
        how = self._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self._hadoop.fs.FileContext.getFileContext(self.path.toUri(), self._conf).rename(fresh, self.path, how)

    def remove(self, path: str) -> None:
        """Remove a folder of the same store."""
        folder = self._hadoop.fs.Path(path)
        self._files(folder).delete(folder, True)
