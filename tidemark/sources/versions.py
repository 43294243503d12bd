"""Tables that change while others read them: every write is a new version, which counts once its mark is there.

A version is a folder; its mark is a small file that is created when the folder is whole.  Creating the mark is one step of
the file system and fails if another writer was first.  Readers pin the version they began with; old versions are removed
after a grace.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """The few file system calls that versions need, on any store Spark can read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> dict[str, float]:
        """Names in a folder and when they were changed, in seconds; nothing for a missing folder."""
        at = self._path(f"{self.path}/{folder}")
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self.fs.listStatus(at)} if self.fs.exists(at) else {}

    def mark(self, name: str) -> None:
        """Create an empty file; raises if it is there."""
        self.fs.create(self._path(f"{self.path}/{name}"), False).close()

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.path}/{name}"), True)


class Versions:
    """Versions ``v=0, v=1, ...`` of one table below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.files, self.spark, self.path = Files(spark, path), spark, path.rstrip("/")

    def marked(self) -> dict[int, float]:
        """Whole versions and when they were published."""
        return {int(n): t for n, t in self.files.names("marks").items() if n.isdigit()}

    def current(self) -> int | None:
        return max(self.marked(), default=None)

    def publish(self, rows: DataFrame, as_of: str | None = None) -> int:
        """Write a version beside the others, then mark it; a writer that dies in between leaves the current one in place."""
        folders = [int(n[2:]) for n in self.files.names("") if n.startswith("v=")]
        version = max([*folders, *self.marked()], default=-1) + 1
        out = rows if as_of is None else rows.withColumn("as_of", F.lit(as_of).cast("timestamp"))
        out.write.parquet(f"{self.path}/v={version}")
        self.files.mark(f"marks/{version}")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """One whole version, the current one if none is named; its files stay as they are while it is kept."""
        found = self.current() if version is None else version
        if found is None or found not in self.marked():
            raise ValueError(f"{self.path}: no version {'' if version is None else version}".rstrip())
        return self.spark.read.parquet(f"{self.path}/v={found}")

    def clear(self, grace: float = 3600.0, now: float | None = None) -> list[int]:
        """Remove what was replaced more than ``grace`` seconds ago, and unmarked folders as old; the removed versions."""
        now, marked, gone = time.time() if now is None else now, self.marked(), []
        order = sorted(marked)
        for v, later in zip(order, order[1:]):
            if now - marked[later] > grace:
                self.files.remove(f"marks/{v}")  # first the mark: a reader never finds half a version
                self.files.remove(f"v={v}")
                gone.append(v)
        for name, changed in self.files.names("").items():
            if name.startswith("v=") and int(name[2:]) not in marked and now - changed > grace:
                self.files.remove(name)
                gone.append(int(name[2:]))
        return gone
