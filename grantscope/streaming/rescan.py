"""Usages kept up to date while files change: a stream of file events, with tables of what they have changed.

An event is a new content of a file, or its end.  Its usages are found as in a batch and joined with the number of
the file's last event and the usages of that content; what is new or gone comes out as rows of sign 1 or -1.  Both
tables are committed by batch, so a batch that is run again replaces itself, and the sum of the signed rows is what a batch over
the last contents finds.  A batch reads the tables of those before it, so its cost has a part that grows with all changes so far.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import catalog, text
from ..functions.catalog import Signal
from ..operators import signals
from ..sources import project

EVENTS = "relative_path string, seq long, deleted boolean, content string"
FIELDS = ["line", "permission", "symbol", "kind", "evidence", "confidence", "snippet"]
DELTA = "file string, seq long, sign int, line int, permission string, symbol string, kind string, evidence string, confidence string, snippet string"
HEAD = "file string, seq long"


def event_usages(events: DataFrame, known: Sequence[Signal] = catalog.SIGNALS) -> DataFrame:
    """The usages of each event's content, with its number; an event without any has one row of nulls, so that it is not lost.

    Events of test files are left out.
    """
    own = events.where(~text.is_test(F.col("relative_path")) & F.col("seq").isNotNull()).withColumn("path", F.col("relative_path"))
    content = F.when(F.coalesce("deleted", F.lit(False)), "").otherwise(F.coalesce("content", F.lit("")))
    rows = project.source_rows(own.withColumn("content", content), keep_empty=True)
    return signals.usages(signals.candidate_lines(rows, known, outer=True), known, outer=True).select("file", "seq", *FIELDS)


def changed(found: DataFrame, heads: DataFrame, deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the files' newest events add and take away, as rows of :data:`DELTA`, and the numbers of these events.

    ``found`` are usages of events, ``heads`` the numbers and ``deltas`` the signed rows of the batches before.  Events that are no newer
    than a file's last one change nothing.
    """
    last = heads.groupBy("file").agg(F.max("seq").alias("_last"))
    newest = found.groupBy("file").agg(F.max("seq").alias("seq")).join(last.hint("merge"), "file", "left").where("_last is null or seq > _last").select("file", "seq")
    # an event that comes twice has each usage twice, one without usages a row of nulls
    new = found.join(newest.hint("merge"), ["file", "seq"], "left_semi").where("permission is not null").select("file", *FIELDS).distinct()
    old = deltas.join(newest.hint("merge"), "file", "left_semi").select("file", "sign", *FIELDS).withColumn("sign", -F.col("sign"))
    signed = new.withColumn("sign", F.lit(1)).unionByName(old).groupBy("file", *FIELDS).agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")
    return signed.join(newest.hint("merge"), "file").select(*[c.split()[0] for c in DELTA.split(", ")]), newest


def rescan(events: DataFrame, root: str, known: Sequence[Signal] = catalog.SIGNALS) -> StreamingQuery:
    """Starts a stream that takes all events that are there and ends; a later one over the same ``root`` goes on from it.

    ``events`` is a streaming table of :data:`EVENTS`: ``seq`` grows with a file's versions, and a file has one content a number.
    Events may come late, twice and several of a file at once: the greatest number wins.  A deleted file has no
    usages, and may come back with a greater number; null contents are empty.  ``root``, a folder that driver and
    executors share, holds the stream's progress, the numbers of last events and the signed rows.
    """

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def before(name: str, schema: str) -> DataFrame:
            if not number:
                return spark.createDataFrame([], schema)
            return spark.read.schema(f"{schema}, batch long").parquet(f"{root}/{name}").where(F.col("batch") < number).drop("batch")

        found = batch.persist(StorageLevel.DISK_ONLY)
        deltas, heads = changed(found, before("heads", HEAD), before("deltas", DELTA))
        for name, rows in (("heads", heads), ("deltas", deltas)):
            rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        found.unpersist()

    return event_usages(events, known).writeStream.foreachBatch(commit).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()


def current(spark: SparkSession, root: str) -> DataFrame:
    """The usages of all files as their last events left them: the sum of the signed rows."""
    deltas = spark.read.schema(DELTA).option("recursiveFileLookup", True).parquet(f"{root}/deltas")
    return deltas.groupBy("file", *FIELDS).agg(F.sum("sign").alias("n")).where("n > 0").drop("n")
