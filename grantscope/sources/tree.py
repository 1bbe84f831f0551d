"""A folder tree as a table of its files, listed and read by the executors.

``spark.read.format("project_tree")`` gives ``path``, ``relative_path`` and ``content`` of every file below a
folder whose name is wanted.  The driver lists the top folder only: each folder in it is a partition, and a
task lists what lies below.  Folders of the skip list are never entered, neither by the driver nor by a task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME, COLUMNS = "project_tree", "path string, relative_path string, content string"
#: Bytes of texts in a batch, or one text.
BATCH = 4 << 20


class TreeReader(DataSourceReader):
    """Options: ``path`` (a URI or an absolute path), ``names`` and ``skip`` (JSON lists of shell patterns for names of files and folders)."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/") or "/"
        self.names, self.skip = json.loads(options.get("names", '["*"]')), json.loads(options.get("skip", "[]"))

    def _entries(self, fs: pafs.FileSystem, folder: str) -> tuple[list[str], list[str]]:
        """Folders to enter and files wanted, by name; a folder that cannot be listed has none."""
        try:
            found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        except OSError:
            return [], []
        folders = [x.base_name for x in found if x.type == pafs.FileType.Directory and not any(fnmatchcase(x.base_name, p) for p in self.skip)]
        files = [x.base_name for x in found if x.type == pafs.FileType.File and any(fnmatchcase(x.base_name, p) for p in self.names)]
        return sorted(folders), sorted(files)

    def partitions(self) -> Sequence[InputPartition]:
        """The files of the top folder, and each folder in it."""
        fs, top = pafs.FileSystem.from_uri(self.root)
        return [InputPartition(None), *[InputPartition(x) for x in self._entries(fs, top)[0]]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(self.root)
        top = top.rstrip("/")
        todo, held, size = [partition.value or ""], [], 0
        while todo:
            folder = todo.pop()
            folders, files = self._entries(fs, f"{top}/{folder}".rstrip("/") or "/")
            if partition.value is not None:
                todo += [f"{folder}/{x}" for x in folders]
            for name in files:
                relative = f"{folder}/{name}" if folder else name
                try:
                    with fs.open_input_stream(f"{top}/{relative}") as f:
                        text = f.read().decode("utf-8", "replace")
                except OSError:
                    continue
                held.append((f"{self.root.rstrip('/')}/{relative}", relative, text))
                size += len(text)
                if size > BATCH:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)


def _batch(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["path", "relative_path", "content"])


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def files(spark: SparkSession, root: str, names: Sequence[str], skip: Sequence[str]) -> DataFrame:
    """path, relative_path and content of the files below ``root`` whose name matches one of ``names``, no folder of ``skip`` entered.

    The root itself is always entered.  A missing root has no files, unreadable files and folders are left out; content is decoded
    as UTF-8, what is none replaced.
    """
    spark.dataSource.register(TreeSource)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    full = "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full
    return spark.read.format(NAME).option("names", json.dumps(list(names))).option("skip", json.dumps(list(skip))).load(full)
