"""Versioned snapshots: all tables of a store under one root, one pointer to the current parts of each.

A commit writes new table versions, or with `append` only the rows that are new, beside the old ones and then replaces
the pointer file in one rename, so graph and vectors change together or not at all. Adding a row so costs that row and
not the table; a table in more than ``PARTS`` parts is written whole with the next rows. Files go through Spark's file system layer, so the root may be any path
Spark can write. One writer at a time holds the lock file.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from knotwork.schema import TABLES, conform, empty


#: Parts of a table at most.
PARTS = 32


class SnapshotStore:
    """``root`` None keeps tables as plain DataFrames in memory of the session's plans."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, None if root is None else root.rstrip("/")
        self._memory: dict[str, DataFrame] = {}

    def __eq__(self, other: object) -> bool:
        return isinstance(other, SnapshotStore) and self.root == other.root and (self.root is not None or self is other)

    def __hash__(self) -> int:
        return hash(self.root)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointer(self) -> dict[str, list[str]]:
        fs, path = self._fs(), self._path("_CURRENT")
        if not fs.exists(path):
            return {}
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def initialize(self) -> None:
        """Make the root; tables that do not exist read as empty. May be called again."""
        if self.root is not None:
            self._fs().mkdirs(self._path(""))

    def read(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise ValueError(f"no table {name}")
        if self.root is None:
            return self._memory.get(name, empty(self.spark, name))
        return self._parts(name, self._pointer().get(name, []))

    def _parts(self, name: str, versions: list[str]) -> DataFrame:
        schema = empty(self.spark, name).schema
        each = [self.spark.read.schema(schema).parquet(f"{self.root}/{v}") for v in versions]
        return reduce(DataFrame.unionByName, each) if each else empty(self.spark, name)

    def commit(self, **tables: DataFrame) -> None:
        """New versions of the named tables, visible together."""
        self._publish(tables, whole=True)

    def append(self, **tables: DataFrame) -> None:
        """New rows of the named tables, visible together; what is there stays as it is."""
        self._publish(tables, whole=False)

    def _publish(self, tables: dict[str, DataFrame], whole: bool) -> None:
        from knotwork.session import cut

        if self.root is None:
            made = {n: cut(conform(df, n)) for n, df in tables.items()}
            self._memory |= made if whole else {n: self.read(n).unionByName(df) for n, df in made.items()}
            return
        fs, lock = self._fs(), self._path("_LOCK")
        self.initialize()
        if not fs.createNewFile(lock):
            raise RuntimeError(f"another writer holds {self.root}/_LOCK")
        try:
            pointer = self._pointer()
            for name, df in tables.items():
                version = f"{name}/v={uuid.uuid4().hex}"
                before = [] if whole else pointer.get(name, [])
                rows = conform(df, name)
                if len(before) >= PARTS:
                    rows, before = self._parts(name, before).unionByName(rows), []
                writer = rows.write
                if "resource_type" in df.columns:
                    writer = writer.partitionBy("resource_type")
                writer.parquet(f"{self.root}/{version}")
                pointer[name] = [*before, version]
            fresh = self._path(f"_CURRENT.{uuid.uuid4().hex}")
            stream = fs.create(fresh, True)
            stream.write(bytearray(json.dumps(pointer).encode()))
            stream.close()
            hadoop = self.spark._jvm.org.apache.hadoop.fs
            context = hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
            overwrite = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
            overwrite[0] = hadoop.Options.Rename.OVERWRITE
            context.rename(fresh, self._path("_CURRENT"), overwrite)
        finally:
            fs.delete(lock, False)

    def vacuum(self) -> int:
        """Delete table versions the pointer no longer names; their number."""
        if self.root is None:
            return 0
        fs, live, dropped = self._fs(), {v for versions in self._pointer().values() for v in versions}, 0
        for name in TABLES:
            if fs.exists(self._path(name)):
                for status in fs.listStatus(self._path(name)):
                    if f"{name}/{status.getPath().getName()}" not in live:
                        fs.delete(status.getPath(), True)
                        dropped += 1
        return dropped
