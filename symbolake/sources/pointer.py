"""Numbered records under one folder; the one with the highest number is current.

A record is written aside and renamed to its number, which must be free: of two writers that saw the same current
record one succeeds and the other is told so. Readers see the old record or the new one, never a part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Stale(RuntimeError):
    """Somebody else has put in the record of that number."""


class Pointer:
    """Records in the folder `path` of any Hadoop file system, numbered from 1."""

    def __init__(self, spark: SparkSession, path: str):
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.path = f"{path.rstrip('/')}/_versions"
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        self._free = spark.sparkContext._gateway.new_array(rename, 1)
        self._free[0] = rename.NONE

    def _at(self, number: int):
        return self._path(f"{self.path}/{number:012d}")

    def number(self) -> int:
        """Of the current record; 0 before the first."""
        if not self._fs.exists(self._path(self.path)):
            return 0
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path(self.path)))
        return max((int(n) for n in names if n.isdigit()), default=0)

    def read(self, number: int) -> str | None:
        """What the record says; None if there is none of the number."""
        if not self._fs.exists(self._at(number)):
            return None
        stream = self._fs.open(self._at(number))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, number: int, text: str) -> None:
        """Puts in the record that follows the one of `number`; Stale if another did so first."""
        aside = self._path(f"{self.path}/aside-{uuid.uuid4().hex}")
        stream = self._fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            self._context.rename(aside, self._at(number + 1), self._free)
        except Exception as e:
            self._fs.delete(aside, False)
            if self._fs.exists(self._at(number + 1)):
                raise Stale(f"version {number + 1} in {self.path} was put in by another run") from e
            raise
