"""Job state and queue counters kept up to date from the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import runs
from ..schemas import BIG, REAL, TEXT, table, with_field
from . import state
from .state import use_rocksdb  # noqa: F401

#: Parts that the jobs of one run are dealt over, so that a run with most of the jobs is not one key.
PARTS = 64


def job_state_stream(events: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """Current state of each job that had events, to be written in update mode.

    The same aggregation as in batch: Spark reduces each micro-batch on the map
    side and keeps one row of state per job. Events must carry the job's queued
    registration, unless the registered jobs are given as a static table.
    """
    latest = runs.latest_event(events.groupBy(*runs.JOB))
    if registered is None:
        return runs.flatten_state(latest.filter("_registered"))
    return runs.flatten_state(latest).join(registered.select(*runs.JOB), runs.JOB, "left_semi")


def open_job_states(events: DataFrame, closings: DataFrame, registered: DataFrame | None = None, *, late: str = "10 minutes",
                    grace_s: int = 0, idle_s: int = 7 * 86400, parts: int = PARTS) -> DataFrame:
    """Changes of job states, to be written in update mode; the state of a run's jobs ends with the run.

    ``closings`` is a stream of (run_id, ts) of runs that ended; a row without run_id only moves time on. Once event time has passed a
    closing by ``grace_s``, with ``late`` allowed for rows out of order, the run's state is released and a row without
    source_path says so. Rows that arrive later than that allowance are dropped, as all rows before the watermark are. A part of
    a run that nothing was heard of for ``idle_s`` is released too, so a lost closing leaves nothing behind for good.

    Beside the columns of ``job_state_stream`` there are ``before_status`` and ``before_at``, the state it replaces (null for a job's first).
    A job is registered by its queued event, or by ``registered``, a static table. Events without run, path or time are left out.
    """
    if registered is not None:
        events = events.join(registered.select(*runs.JOB), runs.JOB, "left_semi")
    told = events.filter("run_id is not null and source_path is not null and ts is not null").select(
        "run_id", "source_path", "status", F.col("pct").cast("double").alias("pct"), "speed", F.col("ts").cast("bigint").alias("ts"),
        F.coalesce(F.col("seq").cast("bigint"), F.lit(-1)).alias("seq"), F.pmod(F.xxhash64("source_path"), F.lit(parts)).cast("int").alias("part"))
    every = F.when(F.col("run_id").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(parts - 1)))
    ended = closings.filter("ts is not null").select("run_id", F.col("ts").cast("bigint").alias("ts"), F.explode(every).alias("part"))
    rows = told.unionByName(ended, allowMissingColumns=True).withColumn("_at", F.timestamp_seconds("ts")).withWatermark("_at", late)
    out = table(run_id=events.schema["run_id"].dataType, source_path=TEXT, status=TEXT, pct=REAL, speed=TEXT, updated_at=BIG, before_status=TEXT, before_at=BIG)
    return rows.groupBy("run_id", "part").transformWithState(
        state.OpenJobs(out.names, runs.TERMINAL, registered is not None, grace_s, idle_s), out, outputMode="update", timeMode="eventTime")


def job_updates(changes: DataFrame) -> DataFrame:
    """The state columns of ``open_job_states``, without what says that a run was released."""
    return changes.filter("source_path is not null").drop("before_status", "before_at")


def write_open_counters(changes: DataFrame, location: str, checkpoint: str, cancelled: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Queue counters of the runs that each micro-batch of ``open_job_states`` touches.

    A change takes a job out of the state it had and puts it into the new one, so counts of states per run are all that is carried
    from batch to batch, and only for runs not yet released. No job is read again, and closed runs cost nothing. A repeated
    batch starts from the counts before it and replaces its own folders.
    """
    def counts_of(batch: DataFrame, status: str, at: str, n: int) -> DataFrame:
        return batch.filter(f"source_path is not null and {status} is not null").select(
            "run_id", F.col(status).alias("status"), F.when(F.col(status) == "failed", F.col(at)).alias("failed_at"), F.lit(n).cast("bigint").alias("n"))

    counts = table(run_id=changes.schema["run_id"].dataType, status=TEXT, failed_at=BIG, n=BIG)

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{location}/changes/batch_id={batch_id}")
        stored = spark.read.schema(changes.schema).parquet(f"{location}/changes/batch_id={batch_id}")
        changed = counts_of(stored, "status", "updated_at", 1).unionByName(counts_of(stored, "before_status", "before_at", -1))
        touched = changed.select("run_id").distinct()
        if batch_id > 0:
            known = spark.read.schema(counts).parquet(f"{location}/open/batch_id={batch_id - 1}")
            gone = spark.read.schema(changes.schema).parquet(f"{location}/changes/batch_id={batch_id - 1}").filter("status = 'released'")
            changed = changed.unionByName(known.join(gone.select("run_id").distinct(), "run_id", "left_anti"))
        changed.groupBy("run_id", "status", "failed_at").agg(F.sum("n").alias("n")).filter("n <> 0").write.mode("overwrite").parquet(
            f"{location}/open/batch_id={batch_id}")
        now = spark.read.schema(counts).parquet(f"{location}/open/batch_id={batch_id}").join(touched, "run_id", "left_semi")
        runs.counters_of(now, cancelled).write.mode("overwrite").parquet(f"{location}/counters/batch_id={batch_id}")

    writer = changes.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def newest_state(updates: DataFrame) -> DataFrame:
    """The last written state of each job, out of stored updates with their batch_id."""
    columns = [c for c in updates.columns if c not in (*runs.JOB, "batch_id")]
    newest = updates.groupBy(*runs.JOB).agg(F.max_by(F.struct(*columns), "batch_id").alias("_row"))
    return newest.select(*runs.JOB, "_row.*")


def write_job_state(states: DataFrame, location: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Store state updates, one folder per micro-batch."""
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{location}/batch_id={batch_id}")

    writer = states.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def write_queue_counters(states: DataFrame, location: str, checkpoint: str, cancelled: DataFrame | None = None,
                         compact_every: int = 50, **trigger) -> StreamingQuery:
    """Store state updates and, for the runs they touch, the new queue counters.

    Every ``compact_every`` micro-batches the updates so far are folded into one
    row per job, so that a micro-batch reads that and the few updates since, not
    the whole past. A repeated batch never looks at folders of later ones.
    """
    schema = with_field(states.schema, "batch_id")

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{location}/states/batch_id={batch_id}")
        folded_at = batch_id // compact_every * compact_every - 1
        updates = spark.read.schema(schema).parquet(f"{location}/states")
        recent = updates.filter((F.col("batch_id") > folded_at) & (F.col("batch_id") <= batch_id))
        if folded_at >= 0:
            folded = spark.read.schema(states.schema).parquet(f"{location}/folded/batch_id={folded_at}")
            recent = recent.unionByName(folded.withColumn("batch_id", F.lit(folded_at).cast("bigint")))
        if (batch_id + 1) % compact_every == 0:
            newest_state(recent).write.mode("overwrite").parquet(f"{location}/folded/batch_id={batch_id}")
        touched = updates.filter(F.col("batch_id") == batch_id).select("run_id").distinct()
        current = newest_state(recent.join(touched, "run_id", "left_semi"))
        counters = runs.queue_counters(current, cancelled)
        counters.write.mode("overwrite").parquet(f"{location}/counters/batch_id={batch_id}")

    writer = states.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def newest_counters(counters: DataFrame) -> DataFrame:
    """The last written counters of each run."""
    columns = [c for c in counters.columns if c not in ("run_id", "batch_id")]
    newest = counters.groupBy("run_id").agg(F.max_by(F.struct(*columns), "batch_id").alias("_row"))
    return newest.select("run_id", "_row.*")


