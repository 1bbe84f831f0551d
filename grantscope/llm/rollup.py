"""Token counts as delta-maintained rollups.

A store holds, per committed batch, the batch's signed sums of documents and
tokens by source, language and tokenizer version.  An insert adds a count, a
delete subtracts it, a revision subtracts the old count and adds the new one.
Totals are the sum over committed batches; no batch is ever read again as rows.

A batch is written into a folder of its own and becomes visible by one rename, so a
batch that is sent again (a retry, a replayed stream) changes nothing, and a job
that dies halfway leaves nothing that totals would count.  ``compact`` sums up what is
committed into a base, which becomes visible by a rename as well and names the batches
in it; totals then read the base and the batches since.

The rename of a folder has to be atomic and to fail, or land inside, where the folder
exists already: so it is on HDFS and local file systems, but not on plain object
stores, which need a committer or a table format on top.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words as W
from ._scratch import hadoop_path
from .token_output import encoder

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
CHANGES = ("insert", "delete", "revise")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of one batch of changes.

    ``changes`` has ``op`` (insert, delete or revise), the keys, ``tokens`` (the
    count inserted, deleted, or revised to) and ``old_tokens`` (the count before a
    revision; unused otherwise).  Null counts are 0, null keys are groups of their
    own, and rows of another or a null ``op`` count nothing.  Each row counts: equal
    rows are that many changes.  Groups whose sums are all 0 are left out; an empty batch
    has none.  Texts play no part, so their length does not matter; columns of other names
    are ignored.
    """
    tokens, old = F.coalesce(F.col("tokens").cast("long"), F.lit(0)), F.coalesce(F.col("old_tokens").cast("long"), F.lit(0))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    signed = F.when(F.col("op") == "insert", tokens).when(F.col("op") == "delete", -tokens).when(F.col("op") == "revise", tokens - old).otherwise(0)
    out = changes.select(*KEYS, docs.cast("long").alias("docs"), signed.cast("long").alias("tokens"))
    out = out.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return out.where("docs <> 0 OR tokens <> 0")


class Rollup:
    """A store of batches below ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _batch(self, batch_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9._-]{1,100}", batch_id) or batch_id.startswith((".", "_")):
            raise ValueError(f"not a batch id: {batch_id!r}")
        return f"{self.root}/batch={batch_id}"

    def _named(self, prefix: str) -> list[str]:
        fs, path = hadoop_path(self.spark, self.root)
        names = (s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else ()
        return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix))

    def _base(self) -> str | None:
        """The folder of the last base."""
        found = self._named("base=")
        return f"{self.root}/base={found[-1]}" if found else None

    def _included(self, base: str | None) -> DataFrame:
        """Ids of the batches that a base holds."""
        return self.spark.createDataFrame([], "id string") if base is None else self.spark.read.schema("id string").parquet(f"{base}/included")

    def batches(self) -> list[str]:
        """Committed batches that are not in the base: as many as came since the last ``compact``."""
        found, base = self._named("batch="), self._base()
        if base is None or not found:
            return found
        done = {r[0] for r in self._included(base).where(F.col("id").isin(found)).collect()}
        return [x for x in found if x not in done]

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch once; False if a batch of this id is committed already, in a base or not.

        Of two commits of one id at the same time the first rename wins.
        """
        final = self._batch(batch_id)
        fs, path = hadoop_path(self.spark, final)
        if fs.exists(path) or not self._included(self._base()).where(F.col("id") == batch_id).isEmpty():
            return False
        temp = f"{self.root}/_temp-{uuid.uuid4().hex}"
        deltas(changes).coalesce(8).write.parquet(temp)
        return self._publish(temp, final)

    def _publish(self, temp: str, final: str) -> bool:
        """Makes a written folder visible under its name by one rename; False if a rival was first."""
        fs, path = hadoop_path(self.spark, final)
        _, source = hadoop_path(self.spark, temp)
        done = not fs.exists(path) and fs.rename(source, path)
        if done and fs.exists(hadoop_path(self.spark, f"{final}/{source.getName()}")[1]):
            done = False  # a rival came first, and the rename went below its folder
            source = hadoop_path(self.spark, f"{final}/{source.getName()}")[1]
        if not done:
            fs.delete(source, True)
        return bool(done)

    def compact(self) -> int:
        """Sums up the base and all batches since into a new base; the number of batches that it took in.

        Batches committed meanwhile stay for the next time.  A compaction that dies leaves
        the old base, or the new one with folders of batches that no total counts twice.
        Folders that the base before had made needless are removed, so totals that were
        planned since then can still be read.
        """
        old = self._base()
        new = self.batches()
        if not new:
            return 0
        temp = f"{self.root}/_temp-{uuid.uuid4().hex}"
        self._sum(new, old).coalesce(8).write.parquet(f"{temp}/sums")
        ids = self._included(old).unionByName(self.spark.createDataFrame([(x,) for x in new], "id string"))
        ids.coalesce(8).write.parquet(f"{temp}/included")
        needless = [self._batch(x) for x in set(self._named("batch=")) - set(new)] + [f"{self.root}/base={x}" for x in self._named("base=")[:-1]]
        number = int(old.rpartition("=")[2]) + 1 if old else 0
        if not self._publish(temp, f"{self.root}/base={number:010d}"):
            return 0
        for gone in needless:
            fs, path = hadoop_path(self.spark, gone)
            fs.delete(path, True)
        return len(new)

    def _sum(self, batches: list[str], base: str | None) -> DataFrame:
        paths = [self._batch(b) for b in batches] + ([f"{base}/sums"] if base else [])
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        df = self.spark.read.schema(SCHEMA).parquet(*paths)
        df = df.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return df.where("docs <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer version; groups of 0 are left out."""
        return self._sum(self.batches(), self._base())


def count_tokens(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", name: str = "tokens") -> DataFrame:
    """All columns of ``docs``, with the number of a tokenizer's ids in each whole text.

    Null and empty texts have none.  A column named like the result is replaced.
    """
    own = [f for f in docs.schema.fields if f.name != name]
    at = [f.name for f in own].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, None)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                counts = [len(x) // enc.width for x in enc.encode([t or "" for t in part.column(at).to_pylist()])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64())], [*part.schema.names, name])
        enc.forget()
        W.tidy()

    schema = T.StructType([*own, T.StructField(name, T.LongType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in own]).mapInArrow(run, schema)
