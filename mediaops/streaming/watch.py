"""Continuous watching of a library through snapshots of its inventory.

A snapshot is an inventory whose rows also carry ``seen_at`` (when it was taken),
appended to a folder. The file stream alone would not notice a file that changed
under its old name, so changes are found in the rows.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, StructType

from ..operators.planning import PlanSettings, plan, with_output_path
from ..operators.runs import COUNTERS, finish_run, register_jobs, start_run
from ..schemas import FLAG, TEXT, table, with_field
from ..sources import ledger
from . import packed, state

log = logging.getLogger(__name__)

def snapshot_stream(spark: SparkSession, location: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(location)


def find_changes(sightings: DataFrame, known: DataFrame | None) -> DataFrame:
    """Sightings whose mtime differs from the path's previous one, in order of ``seen_at``.

    ``known`` holds the mtime each path had before. Adds ``change`` (new, changed).
    The window and the join use one partitioning by path.
    """
    in_order = Window.partitionBy("path").orderBy("seen_at")
    ordered = sightings.withColumn("_before", F.lag("mtime").over(in_order))
    if known is None:
        before = F.col("_before")
    else:
        ordered = ordered.join(known.select("path", F.col("mtime").alias("_known")), "path", "left")
        before = F.coalesce("_before", "_known")
    change = F.when(before.isNull(), F.lit("new")).when(before != F.col("mtime"), F.lit("changed"))
    return ordered.withColumn("change", change).filter(F.col("change").isNotNull()).select(*sightings.columns, "change")


def changed_files(snapshots: DataFrame) -> DataFrame:
    """The sightings of a stream whose mtime differs from the path's previous one, with ``change`` (new, changed).

    The memory is keyed state, the last change of every path, in parts on disk: a micro-batch reads its own rows and the parts
    of their paths, however long the stream has run. Rows without path are nobody's and are left out.
    """
    out = with_field(snapshots.schema, "change", TEXT)
    return snapshots.filter("path is not null").select(state.part_of("path").alias("_part"), F.struct(*snapshots.columns).alias("_row")).groupBy(
        "_part").transformWithState(state.Sightings(snapshots.columns), out, outputMode="append", timeMode="none")


def watch_changes(snapshots: DataFrame, location: str, checkpoint: str, *, interval: str = "5 minutes",
                  once: bool = False) -> StreamingQuery:
    """Keep a log of new and changed files, one folder per micro-batch.

    A repeated batch starts from the state before it and replaces its own folder. The log itself is never read.
    """
    state.use_rocksdb(snapshots.sparkSession)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{location}/batch_id={batch_id}")

    return _start(changed_files(snapshots), store, checkpoint, interval, once)


def read_changes(spark: SparkSession, location: str, snapshot_schema: StructType) -> DataFrame:
    logged = with_field(with_field(snapshot_schema, "change", TEXT), "batch_id")
    return spark.read.schema(logged).parquet(location)


def _start(snapshots: DataFrame, store, checkpoint: str, interval: str, once: bool) -> StreamingQuery:
    timing = {"availableNow": True} if once else {"processingTime": interval}
    return snapshots.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**timing).start()


def latest_sightings(snapshots: DataFrame) -> DataFrame:
    """The newest row per path, for a batch that caught up on several snapshots."""
    newest = snapshots.groupBy("path").agg(
        F.max_by(F.struct(*[c for c in snapshots.columns if c != "path"]), "seen_at").alias("_row")
    )
    return newest.select("path", "_row.*").select(*snapshots.columns)


def plan_pass(batch: DataFrame, batch_id: int, settings: PlanSettings, location: str, *,
              history: Callable[[], DataFrame | None], listing: Callable[[], DataFrame | None],
              act: Callable[[DataFrame, int], DataFrame | None] | None = None, name: str = "watch") -> None:
    """One pass: plan the files seen, store the plan, register a run over what is to do, and close it.

    A plan that was stored completely is not made again: when a batch is repeated, the history may hold what its first try
    did. ``act`` receives the files to do once they are stored, and may return how they ended (path, status done, failed or
    skipped); files it says nothing of count as done. The closing event has their numbers, skipped ones with those the plan skipped.
    Everything else is written under the batch's own folder, so a repetition replaces it.
    """
    spark = batch.sparkSession
    target = f"{location}/plans/batch_id={batch_id}"
    seen = latest_sightings(batch)
    schema = plan(seen, settings).schema
    if not _complete(spark, target):
        plan(seen, settings, history=history(), listing=listing()).write.mode("overwrite").parquet(target)
    _run_pass(spark.read.schema(schema).parquet(target), batch_id, location, act, name)


def _run_pass(stored: DataFrame, batch_id: int, location: str, act: Callable[[DataFrame, int], DataFrame | None] | None, name: str) -> None:
    """Register a run over the ``todo`` files of a stored plan, have it done, and close it."""
    spark = stored.sparkSession
    todo = stored.filter(F.col("decision") == "todo")
    # The pass is dated by its snapshot, so that a repetition writes the same rows.
    facts = stored.agg(F.max(F.when(F.col("decision") == "todo", F.col("seen_at"))).alias("at"),
                       F.count_if(F.col("decision") == "todo").alias("todo"), F.count_if(F.col("decision") == "skipped").alias("skipped")).first()
    if not facts.todo:
        return
    run_id = f"{name}-{batch_id}"
    opened = start_run(todo, run_id, name, facts.at, "watch")
    ledger.append_run_events(opened, f"{location}/run_events", batch_id)
    ledger.append_job_events(register_jobs(todo, run_id, facts.at), f"{location}/job_events", batch_id)
    ended = act(todo, batch_id) if act is not None else None
    failed = left = 0
    if ended is not None:
        failed, left = ended.agg(F.count_if(F.col("status") == "failed"), F.count_if(F.col("status") == "skipped")).first()
    numbers = {"ok": facts.todo - failed - left, "failed": failed, "skipped": facts.skipped + left}
    counts = spark.range(1).select(F.lit(run_id).alias("run_id"), *[F.lit(numbers[c]).cast("bigint").alias(c) for c in COUNTERS])
    closed = finish_run(counts, facts.at)
    ledger.append_run_events(opened.unionByName(closed, allowMissingColumns=True), f"{location}/run_events", batch_id)


def _complete(spark: SparkSession, folder: str) -> bool:
    """A write to this folder was committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def watch_plan(snapshots: DataFrame, settings: PlanSettings, location: str, checkpoint: str, *,
               history: Callable[[], DataFrame | None] = lambda: None,
               listing: Callable[[], DataFrame | None] = lambda: None,
               act: Callable[[DataFrame, int], DataFrame | None] | None = None, name: str = "watch",
               interval: str = "5 minutes", once: bool = False) -> StreamingQuery:
    """Plan every snapshot as it arrives; with ``once`` only what is there now.

    Files already dealt with are skipped by the plan itself (history, existing
    outputs), both read anew for every pass.
    """
    def one_pass(batch: DataFrame, batch_id: int) -> None:
        plan_pass(batch, batch_id, settings, location, history=history, listing=listing, act=act, name=name)

    return _start(snapshots, one_pass, checkpoint, interval, once)


def maintain_plan(snapshots: DataFrame, settings: PlanSettings, location: str, checkpoint: str, *,
                  history: DataFrame | None = None, listing: DataFrame | None = None,
                  act: Callable[[DataFrame, int], DataFrame | None] | None = None, name: str = "watch",
                  interval: str = "5 minutes", once: bool = False) -> StreamingQuery:
    """Keep the plan of a library up to date from what changes: a pass plans new and changed files, and files whose facts changed.

    ``snapshots``, ``history`` (source_path, source_mtime, status) and ``listing`` (path; the snapshots themselves if none is given)
    are streams. In place, a done attempt of a file's mtime is a fact about the file; alongside, the existence of its
    output is. Both are kept as state, next to the file, so nothing is joined and a pass reads and stores only the files
    it plans. ``read_current_plan`` gives the plan of all files. Runs are opened and closed as ``watch_plan`` does.
    Mode and force are plain values here. Files that vanish keep their last plan.
    """
    if not isinstance(settings.inplace, bool) or not isinstance(settings.force, bool):
        raise ValueError("mode and force must be the same for all files")
    state.use_rocksdb(snapshots.sparkSession)
    seen = snapshots.filter("path is not null")
    if settings.inplace:
        files = seen.withColumns({"_key": F.col("path"), "_mark": _attempt("path", "mtime")})
        marks = None if history is None else history.filter("status = 'done' and source_path is not null and source_mtime is not null").select(
            F.col("source_path").alias("_key"), _attempt("source_path", "source_mtime").alias("_mark"))
    else:
        files = with_output_path(seen, settings).withColumns({"_key": F.col("output_path"), "_mark": F.col("output_path")})
        marks = (seen if listing is None else listing.filter("path is not null")).select(F.col("path").alias("_key"), F.col("path").alias("_mark"))

    def dealt(rows: DataFrame, *columns: str, **how) -> DataFrame:
        part = state.part_of("_key", min(state.PARTS, state.PACKED_PARTS))
        return packed.pack(rows.select(part.alias("_part"), *columns), **how)

    asked = dealt(files, *snapshots.columns, "_mark").withColumn("is_mark", F.lit(False))
    if marks is not None and not settings.force:
        asked = asked.unionByName(dealt(marks, "_mark", once=True).withColumn("is_mark", F.lit(True)))
    passed = asked.groupBy("_part").transformWithState(
        state.PlanFacts(by_mark=not settings.inplace), table(_rows=BinaryType()), outputMode="append", timeMode="none")
    facts = packed.unpack(passed, with_field(snapshots.schema, "present", FLAG))
    schema = plan(facts, settings).drop("present").schema

    def one_pass(batch: DataFrame, batch_id: int) -> None:
        spark, target = batch.sparkSession, f"{location}/plans/batch_id={batch_id}"
        if not _complete(spark, target):
            plan(batch, settings, present=F.col("present")).drop("present").write.mode("overwrite").parquet(target)
        _run_pass(spark.read.schema(schema).parquet(target), batch_id, location, act, name)

    return _start(facts, one_pass, checkpoint, interval, once)


def _attempt(path: str, mtime: str) -> Column:
    """The text that stands for an attempt at a file as it was at that time."""
    return F.concat(F.col(mtime).cast("string"), F.lit(" "), F.col(path))


def read_current_plan(spark: SparkSession, location: str, schema: StructType, as_of: int | None = None) -> DataFrame:
    """The last plan of every file, or the one after pass ``as_of``."""
    stored = read_plans(spark, location, schema)
    if as_of is not None:
        stored = stored.filter(F.col("batch_id") <= as_of)
    columns = [c for c in schema.names if c != "path"]
    newest = stored.groupBy("path").agg(F.max_by(F.struct(*columns), "batch_id").alias("_row"))
    return newest.select("path", "_row.*").select(*schema.names)


def read_plan_history(spark: SparkSession, location: str, schema: StructType, passes: list[int]) -> DataFrame:
    """The last plan of every file after each of the passes, with ``pass``. The stored plans are read and grouped once, however many passes."""
    stored = read_plans(spark, location, schema).filter(F.col("batch_id") <= max(passes))
    row = F.struct(*[c for c in schema.names if c != "path"])
    newest = stored.groupBy("path").agg(*[F.max_by(row, F.when(F.col("batch_id") <= n, F.col("batch_id"))).alias(f"_{n}") for n in passes])
    each = F.explode(F.array(*[F.struct(F.lit(n).cast("bigint").alias("pass"), F.col(f"_{n}").alias("_row")) for n in passes])).alias("_each")
    return newest.select("path", each).filter("_each._row is not null").select("path", "_each.pass", "_each._row.*").select(*schema.names, "pass")


def keep_watching(start: Callable[[], StreamingQuery], pause_s: float = 300.0,
                  stop: Callable[[], bool] = lambda: False) -> None:
    """Run a watch for good: a failed pass is logged and taken up again from the checkpoint."""
    while not stop():
        try:
            start().awaitTermination()
            return
        except Exception:
            log.exception("watch pass failed, trying again in %s s", pause_s)
            time.sleep(pause_s)


def read_plans(spark: SparkSession, location: str, schema: StructType) -> DataFrame:
    """All stored plans of a watch, with the ``batch_id`` of their pass."""
    return spark.read.schema(with_field(schema, "batch_id")).parquet(f"{location}/plans")
