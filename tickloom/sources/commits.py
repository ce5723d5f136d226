"""A log of commits beside a table's files, in any file system that Spark writes to.

Every state of a table is one numbered JSON file, which appears whole by one rename that fails if the number is
taken. So a reader sees a state from before a commit or after it, never half of it, and of two writers that began with
the same state one is told. Files of a state are never changed: a commit names new ones.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

FOLDER = "_commits"             # hidden from Spark's listing by its underscore


class CommitConflict(RuntimeError):
    """Another writer has committed first."""


class CommitLog:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(self._conf)

    def _at(self, path: str) -> Any:
        return self._hadoop.fs.Path(path)

    def names(self, folder: str = "") -> list[str]:
        """The names inside a folder of the table; none if there is no such folder."""
        at = self._at(f"{self.path}/{folder}".rstrip("/"))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.names(FOLDER) if n.endswith(".json") and n[:-5].isdigit()]

    def state(self, version: int | None = None) -> tuple[int, dict]:
        """The number and content of a version, the last one by default; (0, {}) before the first."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return 0, {}
        stream = self._fs.open(self._at(f"{self.path}/{FOLDER}/{version:010}.json"))
        try:
            return version, json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, after: int, state: dict) -> int:
        """Write the state that follows version ``after``; raises ``CommitConflict`` if there is one already."""
        folder = self._at(f"{self.path}/{FOLDER}")
        self._fs.mkdirs(folder)
        draft, final = (self._at(f"{self.path}/{FOLDER}/{n}") for n in (f".{uuid.uuid4().hex}", f"{after + 1:010}.json"))
        out = self._fs.create(draft, False)
        try:
            out.write(json.dumps(state, sort_keys=True).encode())
        finally:
            out.close()
        files = self._hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        never_over = self.spark.sparkContext._gateway.new_array(self._hadoop.fs.Options.Rename, 0)
        try:
            files.rename(draft, final, never_over)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise CommitConflict(f"{self.path}: version {after + 1} was committed by another writer") from None
            raise
        return after + 1

    def remove(self, folder: str) -> None:
        self._fs.delete(self._at(f"{self.path}/{folder}"), True)
