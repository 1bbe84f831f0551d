"""Intermediate tables in the folder that driver and executors share.

An operator of several passes writes its small intermediate tables as Parquet:
this cuts lineage, survives the loss of any executor and is read back with
column pruning.  The folder is ``spark.checkpoint.dir``; only a local session
that leaves it unset gets a folder of its own.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go when the query that made them has ended; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
_roots: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, without a trailing slash.

    A session on ``local[...]`` without the setting gets a temporary folder,
    removed at exit; any other master without it is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _own:
        path = os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
        os.makedirs(path)
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own[sc.applicationId] = f"file://{path}"
    return _own[sc.applicationId]


def hadoop_path(spark: SparkSession, uri: str):
    """The Hadoop file system of a URI, and the URI as its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that are begun within it leave no shuffle files behind; the session's own setting holds again afterwards."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Scratch:
    """A private folder of tables under :func:`shared_dir`.

    ``write`` materialises a DataFrame, without its shuffle files, and returns a DataFrame that reads it;
    ``drop`` removes tables that no later plan reads.  What an operator returns may read
    its tables, so the folder stays until whoever has written the result calls
    :func:`release`; one with ``keep`` holds results itself and stays for good.
    """

    def __init__(self, spark: SparkSession, name: str, keep: bool = False):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if not keep:
            _roots.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        with shuffles_removed(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = hadoop_path(self.spark, self.path(name))
            fs.delete(path, True)


def open_folders() -> int:
    """The number of private folders that are not released."""
    return len(_roots)


def release(spark: SparkSession, since: int) -> None:
    """Removes the folders opened after the first ``since``: for results that are written elsewhere by now.

    Folders are counted over the whole process, so nothing else may open one meanwhile.
    """
    while len(_roots) > since:
        fs, path = hadoop_path(spark, _roots.pop())
        fs.delete(path, True)
