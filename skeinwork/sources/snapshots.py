"""Tables as immutable snapshot directories with a pointer to the current one.

A write makes a new directory and then moves the pointer, so a failed or rolled-back write leaves readers where they
were. One writer at a time; readers never lock.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class SnapshotTable:
    """Versions of one table under ``root``; all file access is Spark's, so the folder can be in any store that it reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._base: DataFrame | None = None
        self._active = False

    @classmethod
    def ephemeral(cls, spark: SparkSession, base: DataFrame) -> SnapshotTable:
        """A table whose first snapshot is a plan, not files; nothing is written unless something is committed."""
        made = cls(spark, "")
        made._base = base
        return made

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self) -> list[str]:
        fs, p = self._fs(f"{self.root}/_pointer")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def current(self) -> DataFrame | None:
        """The latest committed snapshot."""
        if self._base is not None:
            return self._base
        names = self._names()
        return self.spark.read.parquet(f"{self.root}/{json.loads(names[-1].partition('-')[2].replace('~', '\"'))}") if names else None

    def write(self, df: DataFrame) -> None:
        """Commit df as the next snapshot: data first, then a pointer file of a higher number."""
        name = f"snap-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        fs, p = self._fs(f"{self.root}/_pointer/{len(self._names()):08d}-{json.dumps(name).replace('\"', '~')}")
        fs.create(p, False).close()

    def history(self) -> list[str]:
        return [json.loads(n.partition("-")[2].replace("~", '"')) for n in self._names()]

    def transact(self, change: Callable[[DataFrame], DataFrame], commit: bool = True) -> DataFrame:
        """Apply change to the current snapshot; commit moves the pointer, otherwise the table stays as it was."""
        if self._active:
            raise RuntimeError("a transaction is active")
        self._active = True
        try:
            changed = change(self.current())
            if commit:
                self.write(changed)
            return self.current()
        finally:
            self._active = False

    def delete_snapshot(self, name: str) -> None:
        """Drop an old snapshot's files; the current one can't go."""
        if self.history()[-1:] == [name]:
            raise ValueError("the current snapshot can't be deleted")
        fs, p = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)
