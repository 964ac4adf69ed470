"""Append-only tables whose writers agree by snapshot: histories, label lists, album members, feature caches.

A commit writes its rows to a folder of its own and then a numbered manifest that lists all folders of the table. The manifest
is put in place whole, and only if no other writer has taken its number; a writer that comes second reads what the first
has added and tries again. Rows without a manifest, of a job that broke off, are never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Snapshots:
    """The table at `path`, with columns as in `schema`; rows are told apart by `keys`."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str], every: int = 64):
        self.spark, self.path, self.keys, self.every = spark, path.rstrip("/"), keys, every
        self.schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the latest snapshot, 0 for a table that nobody has written."""
        path, fs = self._fs(f"{self.path}/_manifests")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def _folders(self, version: int) -> list[str]:
        if not version:
            return []
        lines = self.spark.read.text(f"{self.path}/_manifests/{version:012}.json").collect()
        return json.loads(lines[0].value)["folders"]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a snapshot, the latest by default."""
        folders = self._folders(self.version() if version is None else version)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def _take(self, version: int, folders: list[str]) -> bool:
        """Put a manifest in place; False if another writer has that number."""
        staged, fs = self._fs(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps({"folders": folders}).encode()))
        out.close()
        final, _ = self._fs(f"{self.path}/_manifests/{version:012}.json")
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").NONE  # fails where the manifest exists
        try:
            context.rename(staged, final, options)
        except Py4JJavaError as e:
            fs.delete(staged, False)
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        return True

    def append_new(self, rows: DataFrame | Callable[[DataFrame], DataFrame], attempts: int = 20) -> int:
        """Commit the rows whose keys the table does not have, one for each key, and return how many.

        `rows` may be a function of the table as it is. Of two writers the first one's rows stay; with nothing new no
        snapshot is made. Null keys are keys like others.
        """
        for _ in range(attempts):
            version = self.version()
            folders, now = self._folders(version), self.read(version)
            given = rows(now) if callable(rows) else rows
            fresh = given.select(*self.schema.names).dropDuplicates(self.keys).alias("new")
            same = [F.col(f"new.{k}").eqNullSafe(F.col(f"old.{k}")) for k in self.keys]
            both = same[0]
            for s in same[1:]:
                both = both & s
            fresh = fresh.join(now.alias("old"), both, "left_anti")
            folder = f"commit={uuid.uuid4().hex}"
            fresh.write.parquet(f"{self.path}/{folder}")
            count = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").count()
            if not count:
                self._drop(folder)
                return 0
            if self._take(version + 1, self._packed([*folders, folder])):
                return count
            self._drop(folder)
        raise RuntimeError(f"{self.path}: other writers were first {attempts} times")

    def _packed(self, folders: list[str]) -> list[str]:
        """The folders, or one with all their rows where they are many. Those before stay for readers of older snapshots."""
        if len(folders) <= self.every:
            return folders
        one = f"commit={uuid.uuid4().hex}"
        self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders)).write.parquet(f"{self.path}/{one}")
        return [one]

    def _drop(self, folder: str) -> None:
        path, fs = self._fs(f"{self.path}/{folder}")
        fs.delete(path, True)

    def vacuum(self) -> int:
        """Remove folders and manifests that the latest snapshot does not need, when nobody reads or writes the table; how many folders."""
        version = self.version()
        kept = {*self._folders(version)}
        root, fs = self._fs(self.path)
        found = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        gone = [n for n in found if n.startswith("commit=") and n not in kept]
        for n in gone:
            self._drop(n)
        manifests, _ = self._fs(f"{self.path}/_manifests")
        for s in fs.listStatus(manifests) if fs.exists(manifests) else []:
            if s.getPath().getName() != f"{version:012}.json":
                fs.delete(s.getPath(), False)
        return len(gone)
