"""Executed compaction of small Parquet files: bin packing over runs of equal sizes.

Small files of a partition are packed first fit, by descending size.  Files of one
size are a run with a multiplicity, and groups of one residual are a run as well: each
earliest group takes ``residual // size`` files at once, so the work of a partition
follows its different sizes, not its files.  A run's placement is a range of ordinals;
ranges are expanded and joined to the files, and every group of several is merged by
one task that streams its files, in joining order, into one.

Writing and merging are repeatable: a file is written under another name and renamed
when whole, by any attempt with the same bytes.  Sources are removed only when all
merged files stand, and removing one that is gone does nothing, so a lost executor
costs a task at most.  Until :func:`compact` returns, the folder may hold sources
beside the file that replaces them.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator, Sequence
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._scratch import Scratch, hadoop_path

#: Rows of a row group; a writer holds one at a time.
GROUP_ROWS = 1 << 17
ATTEMPTS = "_attempts"


@dataclass(slots=True)
class Range:
    """``each`` files of one size, from ordinal ``first`` up to ``last``, go to each group from ``group`` on."""

    size: int
    first: int
    last: int
    group: int
    each: int


def pack_runs(runs: Sequence[tuple[int, int]], limit: int) -> list[Range]:
    """First fit by descending size, for (size, number of files) pairs of sizes up to ``limit``.

    Groups are numbered as they are opened.  The list of open groups is run-length
    encoded by residual, so it has some three entries a size at most.
    """
    open_: list[tuple[int, int, int]] = []  # (first group, groups, residual)
    placed, opened = [], 0
    for size, count in sorted(runs, reverse=True):
        at, after = 0, []
        for first, groups, residual in open_:
            each = residual // size
            if at == count or not each:
                after.append((first, groups, residual))
                continue
            full = min(groups, (count - at) // each)
            if full:
                placed.append(Range(size, at, at + full * each, first, each))
                after.append((first, full, residual - each * size))
                at += full * each
            if full < groups:
                left = count - at
                if left:
                    placed.append(Range(size, at, count, first + full, left))
                    after.append((first + full, 1, residual - left * size))
                    at = count
                    full += 1
                if full < groups:
                    after.append((first + full, groups - full, residual))
        each = limit // size
        full, left = divmod(count - at, each)
        for groups, n in ((full, each), (1 if left else 0, left)):
            if groups:
                placed.append(Range(size, at, at + groups * n, opened, n))
                after.append((opened, groups, limit - n * size))
                at += groups * n
                opened += groups
        open_ = after
    return placed


class Writer:
    """One Parquet file, written in row groups of a fixed size under a name of its own and renamed when whole."""

    def __init__(self, root: str, uri: str, schema: pa.Schema):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        top = pafs.FileSystem.from_uri(root)[1]
        self.temp = f"{top}/{ATTEMPTS}/{uuid.uuid4().hex}"
        for folder in (f"{top}/{ATTEMPTS}", os.path.dirname(self.path)):
            self.fs.create_dir(folder, recursive=True)
        self.sink = self.fs.open_output_stream(self.temp)
        self.out = pq.ParquetWriter(self.sink, schema, compression="zstd")
        self.held: list[pa.RecordBatch] = []
        self.n = self.rows = 0

    def write(self, batch: pa.RecordBatch) -> None:
        while batch.num_rows:
            part = batch.slice(0, GROUP_ROWS - self.n)
            self.held.append(part)
            self.n += part.num_rows
            batch = batch.slice(part.num_rows)
            if self.n == GROUP_ROWS:
                self._flush()

    def _flush(self) -> None:
        if self.held:
            self.out.write_table(pa.Table.from_batches(self.held), row_group_size=GROUP_ROWS)
            self.rows += self.n
            self.held, self.n = [], 0

    def close(self) -> int:
        self._flush()
        self.out.close()
        self.sink.close()
        try:
            self.fs.move(self.temp, self.path)
        except OSError:  # where a rename does not replace: another attempt has written the same file
            if self.fs.get_file_info(self.path).type != pafs.FileType.File:
                raise
            self.fs.delete_file(self.temp)
        return self.rows


def file_uri(root: str, keys: Sequence, prefix: str = "") -> str:
    """Where the file of these keys lies."""
    return f"{root}/{prefix}{'-'.join('none' if k is None else str(k) for k in keys)}.parquet"


def write_files(keyed: DataFrame, root: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Writes one file per combination of ``keys`` below ``root``, its rows by ``order``, and returns a row per file.

    ``keyed`` has the integer columns ``keys``, of which the first is the partition, and ``row``, a struct of
    what the files hold; ``order`` names fields of it.  Rows equal in these are in the order of a hash of all fields
    that hold no maps, so that a file's bytes never depend on the run.  A file is written by one task, row group
    by row group.  Returns the keys, ``n_rows`` and ``path``.  An empty table writes no file.
    """
    flat = [F.col(f"row.`{f.name}`") for f in keyed.schema["row"].dataType.fields if "map<" not in f.dataType.simpleString()]
    slim = keyed.select(*[F.col(c).cast("long").alias(f"key{i}") for i, c in enumerate(keys)], *[F.col(f"row.`{c}`").alias(f"by{i}") for i, c in enumerate(order)], F.xxhash64(*flat).alias("tie"), "row")
    at, by = [f"key{i}" for i in range(len(keys))], [f"by{i}" for i in range(len(order))]
    dealt = slim.repartition(*at).sortWithinPartitions(*at, *by, "tie").select(*at, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current = None, None
        fields = [pa.field(n, pa.int64()) for n in [*at, "n_rows"]] + [pa.field("path", pa.string())]

        def done() -> pa.RecordBatch:
            values = [*current, out.close(), file_uri(root, current)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, fields, strict=True)], schema=pa.schema(fields))

        for batch in batches:
            columns = [batch.column(i) for i in range(len(at))]
            data = pa.RecordBatch.from_struct_array(batch.column(len(at)))
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                value, null = c.fill_null(0).to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False)
                change[1:] |= (value[1:] != value[:-1]) | (null[1:] != null[:-1])
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                own = tuple(c[a].as_py() for c in columns)
                if out is None or own != current:
                    if out is not None:
                        yield done()
                    out, current = Writer(root, file_uri(root, own), data.schema), own
                out.write(data.slice(a, b - a))
        if out is not None:
            yield done()

    found = dealt.mapInArrow(run, ", ".join(f"{c} long" for c in at) + ", n_rows long, path string")
    return found.select(*[F.col(c).alias(n) for c, n in zip(at, keys, strict=True)], "n_rows", "path")


def placements(files: DataFrame, within: str, order: Sequence[str], limit: int) -> DataFrame:
    """Adds to files of sizes from 1 to ``limit`` their ``group`` within the partition; files are numbered by ``order`` where sizes are equal."""
    runs = files.groupBy(within, "n_rows").agg(F.count("*").alias("n"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.size, r.first, r.last, r.group, r.each) for r in pack_runs(list(zip(frame["n_rows"].tolist(), frame["n"].tolist(), strict=True)), limit)]
        found = pd.DataFrame(rows, columns=["n_rows", "first", "last", "group", "each"])
        found.insert(0, within, frame[within].iloc[0])
        return found

    ranges = runs.groupBy(within).applyInPandas(pack, f"`{within}` long, n_rows long, first long, last long, group long, each long")
    spread = ranges.select(F.col(within).alias("own"), F.col("n_rows").alias("size"), "first", "group", "each", F.explode(F.sequence("first", F.col("last") - 1)).alias("ordinal"))
    spread = spread.select("own", "size", "ordinal", (F.col("group") + F.floor((F.col("ordinal") - F.col("first")) / F.col("each"))).alias("group"))
    nth = (F.row_number().over(Window.partitionBy(within, "n_rows").orderBy(*order)) - 1).cast("long")
    numbered = files.withColumn("nth", nth)
    same = numbered[within].eqNullSafe(spread["own"]) & (numbered["n_rows"] == spread["size"]) & (numbered["nth"] == spread["ordinal"])
    return numbered.join(spread, same).drop("own", "size", "ordinal", "nth")


def _tasks(df: DataFrame) -> int:
    """Tasks for a table of paths: its rows are few bytes but stand for whole files, so their number must not follow the bytes."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def merge_files(moves: DataFrame, root: str, keys: Sequence[str]) -> DataFrame:
    """Writes one file per (partition, group) of ``moves``, of the rows of its files by ``turn``; returns partition, group and ``path``.

    ``keys`` name the partition and the columns that name the merged file, those of its first source.
    """
    within = keys[0]
    slim = moves.select(F.col(within).alias("own"), "group", "turn", F.array(*[F.col(f"head.{k}").cast("long") for k in keys]).alias("head"), "path")
    dealt = slim.repartition(_tasks(moves), "own", "group").sortWithinPartitions("own", "group", "turn").select("own", "group", "head", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, uri = None, None, ""

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*current, uri], [pa.int64(), pa.int64(), pa.string()], strict=True)], ["own", "group", "path"])

        for batch in batches:
            for own, group, head, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, inner = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(inner) as raw:
                    source = pq.ParquetFile(raw)
                    if out is None or (own, group) != current:
                        if out is not None:
                            yield done()
                        current, uri = (own, group), file_uri(root, head, "merged-")
                        out = Writer(root, uri, source.schema_arrow)
                    for part in source.iter_batches(1 << 16):
                        out.write(part)
        if out is not None:
            yield done()

    return dealt.mapInArrow(run, "own long, group long, path string").withColumnRenamed("own", within)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            fs, path = pafs.FileSystem.from_uri(uri)
            with suppress(FileNotFoundError):
                fs.delete_file(path)
        yield batch


def compact(spark: SparkSession, root: str, files: DataFrame, keys: Sequence[str], *, small: int, limit: int) -> DataFrame:
    """Merges the small files of each partition in groups of at most ``limit`` rows, and returns a row per final file.

    ``files`` has ``keys`` (the partition, then what names a file), ``n_rows`` and ``path``, as
    :func:`write_files` returns it.  Files under ``small`` rows are taken by descending rows, then by
    the other keys; each joins the earliest-opened group that holds at most ``limit`` rows with it,
    or opens one.  Each group of several becomes one file of its sources' rows in joining order;
    all other files stay as they are.  ``small`` may be ``limit`` + 1 at most.

    Returns the keys (of the first source), ``n_rows`` by the plan, ``sources`` (each ``key-key``, in joining
    order, joined by commas), ``path`` and ``rewritten``.  A null partition is one of its own.
    An empty table of files stays one.
    """
    if small > limit + 1:
        raise ValueError("a small file has to fit into a group")
    within, rest = keys[0], list(keys[1:])
    scratch = Scratch(spark, "compaction")
    files = scratch.write(files.select(*keys, "n_rows", "path"), "files")
    placed = placements(files.where(F.col("n_rows").between(1, small - 1)), within, rest, limit)
    turn = F.struct((-F.col("n_rows")).alias("rows"), *rest)
    placed = scratch.write(placed.withColumn("turn", turn), "placed")
    name = lambda x: F.concat_ws("-", *[x[k].cast("string") for k in rest])
    groups = placed.groupBy(within, "group").agg(F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows"), F.array_sort(F.collect_list("turn")).alias("turns"))
    groups = groups.select(F.col(within).alias("own"), F.col("group").alias("joined"), "n_files", F.col("n_rows").alias("held"), F.col("turns")[0].alias("first"), F.array_join(F.transform("turns", name), ",").alias("sources"))
    groups = scratch.write(groups.where("n_files > 1"), "groups")
    same = placed[within].eqNullSafe(groups["own"]) & (placed["group"] == groups["joined"])
    head = F.struct(F.col(within), *[F.col(f"first.{k}").alias(k) for k in rest]).alias("head")
    moves = scratch.write(placed.join(groups, same).select(within, "group", "turn", head, "path"), "moves")
    merged = scratch.write(merge_files(moves, root, keys), "merged")
    # every merged file stands: its sources go
    moves.select("path").mapInArrow(_remove, "path string").write.format("noop").mode("overwrite").save()
    fs, attempts = hadoop_path(spark, f"{root}/{ATTEMPTS}")
    fs.delete(attempts, True)
    same = merged[within].eqNullSafe(groups["own"]) & (merged["group"] == groups["joined"])
    new = merged.join(groups, same).select(within, *[F.col(f"first.{k}").alias(k) for k in rest], F.col("held").alias("n_rows"), "sources", "path", F.lit(True).alias("rewritten"))
    old = files.join(moves.select("path"), "path", "left_anti").select(*keys, "n_rows", F.concat_ws("-", *[F.col(k).cast("string") for k in rest]).alias("sources"), "path", F.lit(False).alias("rewritten"))
    return new.unionByName(old)


def digests(files: DataFrame, *, id_col: str, value_col: str) -> DataFrame:
    """What the files hold, read back from them: ``path``, n_rows, min and max id, cents, ids_sha256 and columns.

    ``cents`` sums floor(100 * value + 0.5), nulls and values that are no finite number being 0; a null id is an
    empty text between its commas.  Each file is streamed by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                low = high = None
                n = cents = 0
                sha = hashlib.sha256()
                with fs.open_input_file(path) as raw:
                    source = pq.ParquetFile(raw)
                    for part in source.iter_batches(1 << 16, columns=[id_col, value_col]):
                        ids, value = part.column(part.schema.get_field_index(id_col)), part.column(part.schema.get_field_index(value_col))
                        if n and part.num_rows:
                            sha.update(b",")
                        n += part.num_rows
                        sha.update(",".join(["" if x is None else str(x) for x in ids.to_pylist()]).encode())
                        least = pc.min_max(ids).as_py()
                        if least["min"] is not None:
                            low = least["min"] if low is None else min(low, least["min"])
                            high = least["max"] if high is None else max(high, least["max"])
                        x = value.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
                        cents += int(np.floor(100 * np.where(np.isfinite(x), x, 0.0) + 0.5).astype(np.int64).sum())
                    names = ",".join(source.schema_arrow.names)
                row = [[uri], [n], [low], [high], [cents], [sha.hexdigest()], [names]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.string(), *[pa.int64()] * 4, pa.string(), pa.string()], strict=True)], ["path", "n_rows", "min_id", "max_id", "cents", "ids_sha256", "columns"])

    return files.select("path").repartition(_tasks(files), "path").mapInArrow(run, "path string, n_rows long, min_id long, max_id long, cents long, ids_sha256 string, columns string")


def by_lots(spark: SparkSession, rows: DataFrame, *, time_col: str, id_col: str, per_lot: int) -> DataFrame:
    """Each row as a struct ``row``, with ``day``, ``lot`` and ``piece`` of the file that it starts in.

    A day has one lot, and another for every ``per_lot`` rows.  Days are whole days of the time as the session shows it, or as
    it stands where it has no zone; a null time is a day of its own, a null id has the checksum of an empty text.
    """
    day = F.unix_date(F.to_date(F.col(f"`{time_col}`"))).cast("long")
    counts = Scratch(spark, "days").write(rows.groupBy(day.alias("day")).agg(F.count("*").alias("day_rows")), "counts")
    whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), day.alias("own"))
    # Spark broadcasts the table of days while it is small, and shuffles both sides beyond that
    sized = whole.join(counts, whole["own"].eqNullSafe(counts["day"]))
    h = F.crc32(F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.lit("")).cast("binary"))
    lot = F.floor(h / 16) % (1 + F.floor(F.col("day_rows") / per_lot))
    return sized.select("day", lot.cast("long").alias("lot"), F.least(h % 4, F.floor(h / 4) % 4).cast("long").alias("piece"), "row")
