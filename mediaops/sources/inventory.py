"""File inventories: stored tables, manifests, and live directory listings."""

from __future__ import annotations

import os
import stat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import paths
from .workspace import work_dir

ENTRIES = "path string, is_dir boolean, is_symlink boolean, size bigint, mtime bigint, mode int, links bigint"
BATCH = 10_000


def filter_extensions(inventory: DataFrame, extensions: list[str]) -> DataFrame:
    """Rows whose extension is allowed; case and a leading dot do not matter."""
    wanted = sorted({e.lower().removeprefix(".") for e in extensions})
    return inventory.filter(F.col("ext").isin(wanted))


def bare_extensions(extensions: Column) -> Column:
    """A list of extensions in lower case, without blanks and leading dots."""
    return F.transform(extensions, lambda e: F.regexp_replace(F.lower(F.trim(e)), r"^\.", ""))


def listed_extension(ext: Column, extensions: Column) -> Column:
    """Whether a row's own list (an array) allows its extension."""
    return F.array_contains(bare_extensions(extensions), F.lower(ext))


def read_inventory(spark: SparkSession, location: str, fmt: str = "parquet", extensions: list[str] | None = None,
                   **options) -> DataFrame:
    """An inventory table or manifest (parquet, csv, json, orc)."""
    inventory = spark.read.format(fmt).schema(schemas.INVENTORY).options(**options).load(location)
    return inventory if extensions is None else filter_extensions(inventory, extensions)


def list_paths(inventory: DataFrame) -> DataFrame:
    """Paths in the order a depth-first walk visits them."""
    return inventory.select("path").orderBy(paths.walk_order(F.col("path")))


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file under ``root``, listed level by level on the executors.

    Each round lists the directories found by the round before, spread over the
    cluster again, and writes what it finds; the driver sees only whether there is
    another level. Executors must see the tree under the same path. Symlinked
    directories are not entered, symlinked files appear with their target's
    metadata, and entries that cannot be read are left out. Only an unreadable
    root is an error.
    """
    os.scandir(root).close()
    folder = work_dir(spark, "listing")
    level, frontier = 0, spark.createDataFrame([(root.rstrip("/") or "/",)], "path string")
    while True:
        target = f"{folder}/level={level}"
        frontier.mapInPandas(_list_directories, ENTRIES).write.parquet(target)
        found = spark.read.schema(ENTRIES).parquet(target).filter("is_dir").select("path")
        if found.isEmpty():
            break
        # Round robin: one directory holds no more than its own entries.
        level, frontier = level + 1, found.repartition(spark.sparkContext.defaultParallelism)
    files = spark.read.schema(ENTRIES).option("basePath", folder).parquet(f"{folder}/*").filter("NOT is_dir")
    prefix = "/" if root == "/" else root.rstrip("/") + "/"
    return files.select(
        "path", F.substr("path", F.lit(len(prefix) + 1)).alias("rel_path"),
        paths.bare_ext(F.col("path")).alias("ext"), "size", "mtime", "mode", "links", "is_symlink",
    )


def scan_inventory(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """The media files under ``root``."""
    return filter_extensions(list_tree(spark, root), extensions)


def _list_directories(batches):
    for batch in batches:
        rows = []
        for directory in batch["path"]:
            try:
                entries = os.scandir(directory)
            except OSError:
                continue
            with entries:
                for entry in entries:
                    row = _describe(entry)
                    if row is not None:
                        rows.append(row)
                    if len(rows) >= BATCH:
                        yield _frame(rows)
                        rows = []
        if rows:
            yield _frame(rows)


def _describe(entry):
    """One entry, or None for broken links, linked directories and special files that vanish."""
    try:
        linked = entry.is_symlink()
        info = entry.stat()
    except OSError:
        return None
    directory = stat.S_ISDIR(info.st_mode)
    if linked and directory:
        return None
    return (entry.path, directory, linked, info.st_size, info.st_mtime_ns // 1_000_000_000, info.st_mode, info.st_nlink)


def _frame(rows):
    return pd.DataFrame(rows, columns=["path", "is_dir", "is_symlink", "size", "mtime", "mode", "links"])
