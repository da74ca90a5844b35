"""Runs and jobs: an append-only event log, and the state derived from it.

Nothing is updated in place. A job's state is its latest event; a run's counters
are an aggregation over its jobs. Both aggregate on the map side first, so a run
or a file with a large share of the events is reduced before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import progress
from .capability import earns_retry
from .joins import lookup_join, owners_with_facts

JOB = ["run_id", "source_path"]
TERMINAL = ["done", "failed"]
COUNTERS = ["ok", "failed", "skipped"]


def start_run(planned: DataFrame, run_id: str | Column, name: str, at: int | Column,
              run_kind: str = "transcode") -> DataFrame:
    """The event that opens a run over the given files.

    ``total`` counts the planned files of a transcode or watch run and all scanned
    files of a program run; pass the matching rows.
    """
    return planned.agg(F.count(F.lit(1)).alias("total")).select(
        _lit(run_id).cast("string").alias("run_id"), F.lit(name).alias("name"), F.lit(run_kind).alias("run_kind"),
        F.lit("running").alias("event"), "total",
        *[F.lit(0).cast("bigint").alias(c) for c in COUNTERS], _lit(at).cast("bigint").alias("at"),
    )


def register_jobs(planned: DataFrame, run_id: str | Column, at: int | Column) -> DataFrame:
    """One queued job event per file."""
    return planned.select(
        _lit(run_id).cast("string").alias("run_id"), F.col("path").alias("source_path"),
        F.lit("queued").alias("status"), F.lit(0.0).alias("pct"), F.lit("").alias("speed"),
        _lit(at).cast("bigint").alias("ts"), F.lit(-1).cast("bigint").alias("seq"),
    )


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def split_progress_text(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per line of encoder output, which ends lines with CR as well as LF."""
    pieces = F.split(text, "[\r\n]")
    # What follows the last separator is a line only if there is something in it.
    whole = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    return df.select(*[c for c in df.columns if c != text], F.posexplode(whole).alias("line_no", "line"))


def parse_progress(lines: DataFrame, total_ms: int | Column, line: str = "line") -> DataFrame:
    """Position, share done, speed and time left of each progress line.

    Lines that carry no position are not progress and are left out.
    """
    total = _lit(total_ms).cast("bigint")
    spotted = lines.withColumn("_clock", progress.clock_text(F.col(line))).filter(F.col("_clock") != "")
    return spotted.withColumns({
        "current_ms": progress.position_ms(F.col("_clock")),
        "speed": F.coalesce(progress.realtime_speed(F.col(line)), F.lit(0.0)),
    }).drop("_clock").withColumns({
        "total_ms": total,
        "pct": progress.fraction_done(F.col("current_ms"), total),
        "eta_ms": progress.remaining_ms(F.col("current_ms"), total, F.col("speed")),
    })


def progress_events(parsed: DataFrame) -> DataFrame:
    """Job events out of parsed progress lines (run_id, source_path, ts, seq kept)."""
    return parsed.select(
        *JOB, F.lit("running").alias("status"), "pct", progress.speed_label(F.col("speed")).alias("speed"), "ts", "seq"
    )


def latest_event(grouped) -> DataFrame:
    """The deciding event per job, from events grouped by job.

    Arrival order is (ts, seq); an end state is never undone by progress that
    arrives late. Shared by the batch and the streaming form.
    """
    status = F.col("status")
    order = F.struct(status.isin(TERMINAL), F.col("ts"), F.col("seq"))
    state = F.struct("status", "pct", "speed", "ts")
    return grouped.agg(F.max_by(state, order).alias("_state"), F.max(status == "queued").alias("_registered"))


def flatten_state(latest: DataFrame) -> DataFrame:
    """State columns; an ended job is complete and has no speed."""
    ended = F.col("_state.status").isin(TERMINAL)
    return latest.select(
        *JOB, F.col("_state.status").alias("status"),
        F.when(ended, F.lit(1.0)).otherwise(F.col("_state.pct")).alias("pct"),
        F.when(ended, F.lit("")).otherwise(F.col("_state.speed")).alias("speed"),
        F.col("_state.ts").alias("updated_at"),
    )


def latest_job_state(events: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """Current state of every registered job.

    Events of files that were never registered in the run are dropped, after the
    reduction to one row per job. Without ``registered`` the queued events of the
    log itself say which jobs exist.
    """
    latest = latest_event(events.groupBy(*JOB))
    if registered is None:
        return flatten_state(latest.filter("_registered"))
    return flatten_state(latest).join(registered.select(*JOB), JOB, "left_semi")


def reconciled_status(status: Column) -> Column:
    """Jobs nobody took up were skipped; jobs left running have failed."""
    return (
        F.when(status == "queued", F.lit("skipped")).when(status == "running", F.lit("failed")).otherwise(status)
    )


def run_verdict(failed: Column) -> Column:
    return F.when(failed > 0, F.lit("failed")).otherwise(F.lit("done"))


def reconcile_runs(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Close runs from their jobs: status and the counters ok, failed, skipped.

    One pass over the jobs. A run without jobs is done with zeros; a cancelled run
    stays cancelled with the counters it had.
    """
    status = reconciled_status(F.col("status"))
    counted = jobs.groupBy("run_id").agg(
        F.count_if(status == "done").alias("ok"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "skipped").alias("skipped"),
    )
    zero = F.lit(0).cast("bigint")
    before = {c: F.col(c).cast("bigint") if c in runs.columns else zero for c in COUNTERS}
    kept = [c for c in runs.columns if c not in COUNTERS]
    joined = runs.select(*kept, *[F.coalesce(v, zero).alias(f"_{c}") for c, v in before.items()]).join(
        counted, "run_id", "left"
    )
    cancelled = F.col("status") == "cancelled"
    return joined.select(
        *[c for c in kept if c != "status"],
        F.when(cancelled, F.col("status")).otherwise(run_verdict(F.coalesce("failed", zero))).alias("status"),
        *[F.when(cancelled, F.col(f"_{c}")).otherwise(F.coalesce(c, zero)).alias(c) for c in COUNTERS],
    )


def finish_run(counts: DataFrame, at: int | Column) -> DataFrame:
    """Closing run events from given counters (run_id, ok, failed, skipped)."""
    return counts.select(
        "run_id", run_verdict(F.col("failed")).alias("event"), *COUNTERS, _lit(at).cast("bigint").alias("at")
    )


def cancel_run(run_ids: DataFrame, at: int | Column) -> DataFrame:
    """Cancelling run events; counters are left as they are."""
    return run_ids.select("run_id", F.lit("cancelled").alias("event"), _lit(at).cast("bigint").alias("at"))


def fold_run_events(events: DataFrame) -> DataFrame:
    """The runs table out of the run event log.

    A cancellation is final: closing events that come after it change nothing.
    Otherwise the latest closing event gives status and counters; without one the
    run is still running.
    """
    opening, cancelled = F.col("event") == "running", F.col("event") == "cancelled"
    closing = F.col("event").isin("done", "failed")
    closed_at = F.when(closing, F.col("at"))
    folded = events.groupBy("run_id").agg(
        F.max(F.when(opening, F.col("name"))).alias("name"),
        F.max(F.when(opening, F.col("run_kind"))).alias("run_kind"),
        F.min(F.when(opening, F.col("at"))).alias("started_at"),
        F.max(F.when(opening, F.col("total"))).alias("total"),
        F.min(F.when(cancelled, F.col("at"))).alias("_cancelled_at"),
        F.max(closed_at).alias("_closed_at"),
        F.max_by(F.struct("event", *COUNTERS), closed_at).alias("_closing"),
    )
    counts = F.col("_cancelled_at").isNull() | (F.col("_closed_at") <= F.col("_cancelled_at"))
    zero = F.lit(0).cast("bigint")
    return folded.select(
        "run_id", "name", "run_kind", "started_at",
        F.coalesce("_cancelled_at", "_closed_at").alias("finished_at"),
        F.when(F.col("_cancelled_at").isNotNull(), F.lit("cancelled"))
        .otherwise(F.coalesce("_closing.event", F.lit("running"))).alias("status"),
        F.coalesce("total", zero).alias("total"),
        *[F.coalesce(F.when(counts, F.col(f"_closing.{c}")), zero).alias(c) for c in COUNTERS],
    )


def recent_runs(runs: DataFrame, limit: int = 50, status: str | None = None) -> DataFrame:
    """The newest runs, optionally of one status."""
    chosen = runs if status is None else runs.filter(F.col("status") == status)
    return chosen.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit)


def active_runs(runs: DataFrame) -> DataFrame:
    """Runs still marked running, newest first."""
    return runs.filter(F.col("status") == "running").orderBy(F.col("started_at").desc(), F.col("run_id").desc())


def run_detail(runs: DataFrame, jobs: DataFrame, run_id=None) -> DataFrame:
    """Runs with their jobs, ordered by run and source path; all runs or one.

    One row per job (a run without jobs has one row of NULL job columns), because
    a run may hold any number of jobs and must not be gathered into one value.
    :func:`run_documents` nests them in pages of bounded size.
    """
    prefixed = jobs.select("run_id", *[F.col(c).alias(f"job_{c}") for c in jobs.columns if c not in ("run_id", "source_path")],
                           "source_path")
    if run_id is not None:
        runs, prefixed = (df.filter(F.col("run_id") == run_id) for df in (runs, prefixed))
    return owners_with_facts(runs, prefixed, ["run_id"], spread_by=["source_path"]).orderBy("run_id", "source_path")


def run_documents(runs: DataFrame, jobs: DataFrame, page_size: int = 1000) -> DataFrame:
    """Runs as nested documents: the jobs of a page in an array ordered by path.

    Jobs are dealt by a hash of their path over as many pages as the run needs, so
    a page holds about ``page_size`` jobs however large the run is. Runs without
    jobs have one page with an empty array.
    """
    pages = jobs.groupBy("run_id").agg(F.count(F.lit(1)).alias("jobs")).withColumn(
        "pages", F.ceil(F.col("jobs") / page_size).cast("bigint")
    )
    # The page counts are one row per run; jobs meet them without gathering a run in one task.
    paged = lookup_join(jobs, pages, ["run_id"], spread_by=["source_path"], how="inner").withColumn(
        "page", F.pmod(F.conv(F.substring(F.md5("source_path"), 1, 8), 16, 10).cast("bigint"), F.col("pages"))
    )
    job = F.struct("source_path", *[c for c in jobs.columns if c not in JOB])
    nested = paged.groupBy("run_id", "page").agg(F.sort_array(F.collect_list(job)).alias("jobs"))
    empty = F.array().cast(nested.schema["jobs"].dataType)
    return owners_with_facts(runs, nested, ["run_id"], spread_by=["page"], present=pages).withColumns({
        "page": F.coalesce("page", F.lit(0).cast("bigint")), "jobs": F.coalesce("jobs", empty),
    })


def attempt_outcomes(attempts: DataFrame, keys: list[str] = JOB) -> DataFrame:
    """Final outcome per file from its attempts, each file counted once.

    The first attempt alone can earn a retry, and only when hardware decoding was
    on and the encoder itself failed; ``retry_due`` marks those still without one.
    ``attempt_no`` is a number (``packed_order`` makes one of several columns): with
    flags and numbers alone this is a hash aggregation and needs no sort.
    """
    order = F.col("attempt_no")
    grouped = attempts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.max_by(F.col("status") == "failed", order).alias("_failed"),
        F.min_by(earns_retry(), order).alias("retry_earned"),
    )
    return grouped.select(
        *keys, "attempts", F.when(F.col("_failed"), F.lit("failed")).otherwise(F.lit("done")).alias("status"),
        "retry_earned", (F.col("retry_earned") & (F.col("attempts") == 1)).alias("retry_due"),
    )


def exit_outcome(runs: DataFrame) -> DataFrame:
    """Exit code of each run: 0 all well, 3 some failed, 4 all failed, 2 bad usage."""
    usage = F.col("usage_error") if "usage_error" in runs.columns else F.lit(False)
    code = (
        F.when(usage, F.lit(2)).when(F.col("failed") == 0, F.lit(0))
        .when(F.col("failed") == F.col("total"), F.lit(4)).otherwise(F.lit(3))
    )
    return runs.withColumn("exit_code", code)


def queue_counters(jobs: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """Done, errors, cancelled, active and pending files per run.

    ``cancelled`` lists run_id and cancelled_at; a failure at or after that moment is
    part of the cancellation, not an error. The moment is looked up per run after
    the jobs were counted per (run, status, second), not per job.
    """
    failed_at = F.when(F.col("status") == "failed", F.col("updated_at")) if cancelled is not None else F.lit(None).cast("bigint")
    grouped = jobs.groupBy("run_id", "status", failed_at.alias("failed_at")).agg(F.count(F.lit(1)).alias("n"))
    return counters_of(grouped, cancelled)


def counters_of(counts: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """The queue counters out of job counts (run_id, status, failed_at, n); ``failed_at`` matters for failures only."""
    if cancelled is None:
        after, counted = F.lit(False), counts
    else:
        counted = lookup_join(counts, cancelled.select("run_id", "cancelled_at"), ["run_id"], spread_by=["failed_at", "status"])
        after = F.coalesce(F.col("failed_at") >= F.col("cancelled_at"), F.lit(False))
    failed = F.col("status") == "failed"
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0).cast("bigint"))
    return counted.groupBy("run_id").agg(
        total(F.col("status") == "done").alias("done"),
        total(failed & ~after).alias("errors"),
        total(failed & after).alias("cancelled"),
        total(F.col("status") == "running").alias("active"),
        total(F.col("status") == "queued").alias("pending"),
        total(F.col("status") == "skipped").alias("skipped"),
    )


def stalled_runs(runs: DataFrame, jobs: DataFrame, now: int, threshold_s: int) -> DataFrame:
    """Running runs whose jobs (or start) saw no update for longer than the threshold."""
    updated = jobs.groupBy("run_id").agg(F.max("updated_at").alias("last_update"))
    running = runs.filter(F.col("status") == "running").join(updated, "run_id", "left")
    last = F.coalesce("last_update", "started_at")
    return running.withColumn("last_update", last).filter(F.col("last_update") < now - threshold_s)
