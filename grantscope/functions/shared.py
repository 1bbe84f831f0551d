"""Cutting lineage in iterative plans."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a task where each row is much work, and the least for which another task is worth while.
TASK_ROWS, LEAST_ROWS = 4_000, 500

_written = threading.local()


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from ``spark.checkpoint.dir`` if it is not set yet.

    Only a local session that has none gets a temporary one; elsewhere a missing
    setting is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        found = sc.getConf().get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not found:
            found = os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
            os.makedirs(found)
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
    return sc._jsc.sc().getCheckpointDir().get()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of a stored table dealt out by their keys, as many tasks as they need.

    A small file of many rows may be a single row group and so a single task, whatever is made of each row afterwards.  The number of
    tasks grows with the rows and is no less than the cores if there are rows for them; of a stored table they are counted from its
    footers.  ``keys`` tell rows apart well enough to deal them evenly.  Rows then pass a generator, since Spark would move filters on
    what is made of them to before they are dealt, back into the single task.
    """
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    spread = df.repartition(max(1, -(-n // TASK_ROWS), min(cores, n // LEAST_ROWS)), *[F.col(k) for k in keys])
    return spread.select(F.inline(F.array(F.struct(*df.columns))))


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df``, in any order, written once as a table below the checkpoint folder and read from there.

    A checkpoint would compute them twice.  The table stays until :func:`discard`.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "table")
    df.write.parquet(path)
    vars(_written).setdefault("paths", []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame) -> DataFrame:
    """As :func:`checkpointed`, for few rows whose order counts."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def discard(spark: SparkSession) -> None:
    """Removes the tables that :func:`checkpointed` has written in this thread: for results that were taken from them."""
    paths = vars(_written).setdefault("paths", [])
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
