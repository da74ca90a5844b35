"""A live directory tree as a Spark data source: the listing is a scan, and the extensions asked for are pushed into it."""

from __future__ import annotations

import os
import stat
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from .. import schemas
from .inventory import filter_extensions

FORMAT = "media_tree"
#: Files of a batch; directories that the driver opens at most to cut the tree into slices.
BATCH, OPENED = 10_000, 4096
_ARROW = pa.schema([("path", pa.string()), ("rel_path", pa.string()), ("ext", pa.string()), ("size", pa.int64()), ("mtime", pa.int64()),
                    ("mode", pa.int32()), ("links", pa.int64()), ("is_symlink", pa.bool_())])


class Slice(InputPartition):
    """Directories of which a task lists the entries alone (``flat``) or everything below (``deep``)."""

    def __init__(self, flat: list[str], deep: list[str]) -> None:
        super().__init__(None)
        self.flat, self.deep = flat, deep


def extension(name: str) -> str:
    """What follows the last dot of a file name, in lower case."""
    return name.rpartition(".")[2].lower() if "." in name else ""


def _entries(directory: str) -> Iterator[os.DirEntry]:
    """The entries of a directory; none of one that cannot be read or is gone."""
    try:
        found = os.scandir(directory)
    except OSError:
        return
    with found:
        while True:
            try:
                entry = next(found)
            except StopIteration:
                return
            except OSError:
                return
            yield entry


def _is_directory(entry: os.DirEntry) -> bool:
    try:
        return entry.is_dir(follow_symlinks=False)
    except OSError:
        return False


class TreeReader(DataSourceReader):
    def __init__(self, root: str, slices: int) -> None:
        self._root, self._slices = root.rstrip("/") or "/", slices
        self._extensions: frozenset[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over equality and lists on ``ext``, so that other files are not even looked up; the rest is Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("ext",):
                wanted = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self._extensions = wanted if self._extensions is None else self._extensions & wanted
            else:
                yield f

    def partitions(self) -> list[Slice]:
        """The tree cut along directories: the driver opens the topmost ones until there are several for each slice."""
        os.scandir(self._root).close()
        flat, waiting = [], deque([self._root])
        while waiting and len(waiting) < 4 * self._slices and len(flat) < OPENED:
            directory = waiting.popleft()
            flat.append(directory)
            waiting.extend(e.path for e in _entries(directory) if _is_directory(e))
        deep = list(waiting)
        parts = [Slice(flat[k::self._slices], deep[k::self._slices]) for k in range(self._slices)]
        return [p for p in parts if p.flat or p.deep]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in self._files(partition):
            rows.append(row)
            if len(rows) == BATCH:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    def _files(self, partition: Slice) -> Iterator[tuple]:
        for directory in partition.flat:
            yield from (row for row in map(self._describe, _entries(directory)) if row)
        todo = list(partition.deep)
        while todo:
            for entry in _entries(todo.pop()):
                if _is_directory(entry):
                    todo.append(entry.path)
                elif row := self._describe(entry):
                    yield row

    def _describe(self, entry: os.DirEntry) -> tuple | None:
        """A file's row, of a link that of its target; None for directories, links to them, broken links and unwanted extensions."""
        ext = extension(entry.name)
        if self._extensions is not None and ext not in self._extensions:
            return None
        try:
            linked, info = entry.is_symlink(), entry.stat()
        except OSError:
            return None
        if stat.S_ISDIR(info.st_mode):
            return None
        prefix = self._root if self._root == "/" else self._root + "/"
        return (entry.path, entry.path[len(prefix):], ext, info.st_size, info.st_mtime_ns // 1_000_000_000, info.st_mode, info.st_nlink, linked)


class MediaTree(DataSource):
    """``spark.read.format("media_tree").load(root)``: one row per file below ``root``, on a path that all executors see.

    Option ``slices``: the number of tasks (default 32). Linked directories are not entered, linked files have their target's metadata, entries that
    cannot be read are left out; only an unreadable root is an error.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return schemas.INVENTORY

    def reader(self, schema: StructType) -> TreeReader:
        if not self.options.get("path"):
            raise ValueError("the root to list is missing: load(root)")
        return TreeReader(self.options["path"], int(self.options.get("slices", "32")))


def live_inventory(spark: SparkSession, root: str, extensions: list[str] | None = None, slices: int | None = None) -> DataFrame:
    """The files below ``root`` as they are when the result is read, of all extensions or some.

    The tree is cut along directories, a slice to a task; ``inventory.list_tree`` spreads it level by level instead, which is
    better where one directory holds most of the tree's directories.
    """
    spark.dataSource.register(MediaTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = spark.read.format(FORMAT).option("slices", str(slices or spark.sparkContext.defaultParallelism)).load(root)
    return found if extensions is None else filter_extensions(found, extensions)
