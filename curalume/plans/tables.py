"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: This driver's folder in each shared folder.
_SESSION_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests, a local one is set, which a cluster cannot share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def complete(spark: SparkSession, folder: str) -> dict[str, str]:
    """The tables of a folder that were written to the end, by name; none if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    found = [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return {p.getName(): p.toString() for p in done}


def session_dir(spark: SparkSession) -> str:
    """A folder in the shared one for tables that results are read from; it is removed when the driver's Python ends."""
    shared = shared_dir(spark)
    if shared not in _SESSION_DIRS:
        _SESSION_DIRS[shared] = f"{shared}/tables-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, _SESSION_DIRS[shared])
    return _SESSION_DIRS[shared]


def _forget(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Py4JError, OSError, AttributeError):  # Spark's JVM can have ended before
        delete(spark, folder)


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it again: lost executors cost no recomputation beyond it."""
    return _written(df, f"{session_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder of intermediate tables that an operator removes when its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{session_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def saved(self, df: DataFrame, name: str = "table") -> DataFrame:
        return _written(df, f"{self.folder}/{name}-{uuid.uuid4().hex}")

    def close(self) -> None:
        delete(self.spark, self.folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
