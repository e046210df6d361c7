"""Version history of a table, with undo and redo.

Every saved version is written as Parquet to a folder of its own under ``root``
and read back, so a version is a snapshot (its lineage is cut at the write, and
it survives executor loss).  The list of versions and the cursor are a manifest,
``root/_state/NNNNNN.json``.  A new manifest is created only if its number is
free: whoever finds it taken reads the newer one and applies the change to
that, so writers at the same time lose nothing.  A version that a save drops
(what an undo had stepped back from) is deleted once the manifest without it is
there.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from quarry.sources.files import scratch_path


class _Store:
    """The few file operations the manifest needs, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.sc, self.root = spark.sparkContext, root
        self.fs = self.path("").getFileSystem(self.sc._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def create(self, name: str, text: str) -> bool:
        """Write a file unless there is one of that name."""
        from py4j.protocol import Py4JJavaError

        place = self.path(name)
        try:
            out = self.fs.create(place, False)
        except (Py4JJavaError, PySparkException):
            if self.fs.exists(place):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def read(self, name: str) -> str:
        status = self.fs.getFileStatus(self.path(name))
        data = self.sc._jvm.org.apache.commons.io.IOUtils.toByteArray(self.fs.open(status.getPath()))
        return bytes(data).decode()

    def names(self, folder: str) -> list[str]:
        place = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(place)) if self.fs.exists(place) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class History:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or scratch_path(spark, "history")).rstrip("/")
        self._store = _Store(spark, self.root)
        self.versions: list[str] = []                  # folder names
        self.cursor = -1
        self._seq = 0

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> "History":
        h = cls(spark, root)
        h._load()
        return h

    # -- state
    def _load(self) -> None:
        """The newest manifest.  One that its writer has not finished yet is
        waited for."""
        for _ in range(100):
            names = [n for n in self._store.names("_state") if n.endswith(".json") and n[0].isdigit()]
            if not names:
                return
            text = self._store.read(f"_state/{names[-1]}")
            if text.endswith("}"):
                state = json.loads(text)
                self.versions, self.cursor, self._seq = state["versions"], state["cursor"], int(names[-1][:-5])
                return
            time.sleep(0.1)
        raise RuntimeError(f"{self.root}/_state/{names[-1]} is not complete")

    def _commit(self, change: Callable[[], None]) -> None:
        """Apply ``change`` to the newest state and store it under the next
        number; again from the newer state if another writer was first."""
        while True:
            before = list(self.versions)
            change()
            state = json.dumps({"versions": self.versions, "cursor": self.cursor})
            if self._store.create(f"_state/{self._seq + 1:09d}.json", state):
                break
            self._load()
        self._seq += 1
        for name in before:
            if name not in self.versions:
                self._store.delete(name)

    # -- operations
    def save(self, df: DataFrame) -> DataFrame:
        """Append a version after the cursor (dropping any redo tail);
        returns the stored snapshot."""
        name = f"v-{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(f"{self.root}/{name}")

        def change() -> None:
            self.versions = [*self.versions[: self.cursor + 1], name]
            self.cursor = len(self.versions) - 1

        self._commit(change)
        return self.spark.read.parquet(f"{self.root}/{name}")

    def current(self) -> DataFrame | None:
        if self.cursor < 0:
            return None
        return self.spark.read.parquet(f"{self.root}/{self.versions[self.cursor]}")

    def _step(self, by: int) -> DataFrame | None:
        def change() -> None:
            self.cursor = min(max(self.cursor + by, 0 if self.versions else -1), len(self.versions) - 1)

        if 0 <= self.cursor + by < len(self.versions):
            self._commit(change)
        return self.current()

    def undo(self) -> DataFrame | None:
        """Step back if not at the first version; returns the current one."""
        return self._step(-1)

    def redo(self) -> DataFrame | None:
        """Step forward if not at the last version."""
        return self._step(1)

    @property
    def can_undo(self) -> bool:
        return self.cursor > 0

    @property
    def can_redo(self) -> bool:
        return self.cursor < len(self.versions) - 1
