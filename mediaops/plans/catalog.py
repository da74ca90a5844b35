"""The queries over the sample tables, one per operator."""

from __future__ import annotations

import contextlib
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import codecs, paths, probe, progress
from ..functions.packing import packed_order
from ..operators import attributes, capability, history, planning, rules, runs, settings, work_orders
from ..operators.joins import facts_with_owners
from ..operators.planning import PlanSettings
from ..operators.rules import Cond, Rule
from ..sources import inventory, ledger, listing, manifests, probes
from ..sources.inventory import filter_extensions, list_paths
from ..sources.programs import list_programs, read_programs
from ..sources.workspace import work_dir
from ..streaming import jobs as job_streams
from ..streaming import watch
from . import tables as t
from .library_run import library_run as run_library
from .program_run import program_run
from .views import Views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: the sample rule program
PROGRAM = [
    Rule("transcode", ["--codec", "h265", "--crf", "24"], [Cond("codec", "ne", "hevc"), Cond("height", "gt", "1080")]),
    Rule("transcode", ["--codec", "h264"], [Cond("ext", "eq", "AVI")]),
    Rule("check", [], [Cond("audio", "ne", "aac"), Cond("bitrate", "gt", "15000")]),
    Rule("check", [], [Cond("duration", "lt", "600.5")]),
    Rule("skip"),
]
#: conditions covering every field and comparison
CONDITIONS = {
    "codec_eq": ("codec", "eq", "hevc"), "codec_ne": ("codec", "ne", "hevc"),
    "audio_eq": ("audio", "eq", "aac"), "audio_ne": ("audio", "ne", "aac"),
    "ext_eq": ("ext", "eq", "MP4"), "ext_ne": ("ext", "ne", "MP4"),
    "height_gt": ("height", "gt", "720"), "height_lt": ("height", "lt", "720"),
    "height_ge": ("height", "ge", "720"), "height_le": ("height", "le", "720"),
    "height_long": ("height", "lt", "0000000000000000001080"), "bitrate_long": ("bitrate", "lt", "1000000000000000000"),
    "width_gt": ("width", "gt", "1280"), "width_lt": ("width", "lt", "1280"),
    "bitrate_gt": ("bitrate", "gt", "10000"), "bitrate_lt": ("bitrate", "lt", "10000"),
    "duration_gt": ("duration", "gt", "3600"), "duration_lt": ("duration", "lt", "3600"),
}
OWN_SUFFIX = ".out"
NOW = 1_000_000_000


def query(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    """Register a query under its function's name."""
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Views(spark, sf_dir))
    return build


def _text(array: str | Column) -> Column:
    return F.array_join(array, " ")


def _rule_text(column: str) -> Column:
    line = lambda r: rules.render_rule_line(r["when"], r["do"]["cmd"], r["do"]["args"])
    return F.array_join(F.transform(column, line), "; ")


# --- inventory and probe ---------------------------------------------------

@query
def inventory_filter(v: Views) -> DataFrame:
    return filter_extensions(v.library(), ["MKV", ".mp4"]).select("file_id", "path", "ext", "size", "mtime", "links")


@query
def inventory_read(v: Views) -> DataFrame:
    """The library stored as a manifest and read back."""
    location = work_dir(v.spark, "inventory")
    columns = {f.name for f in schemas.INVENTORY.fields}
    v.library().select(*[c for c in v.library().columns if c in columns]).write.parquet(location)
    return inventory.read_inventory(v.spark, location, extensions=["MKV", ".mp4"]).select("path", "ext", "size", "mtime", "links")


def _grow_tree(rows: DataFrame, root: str) -> None:
    """Makes files, links and hard links of the rows below ``root``; making them again changes nothing.

    Rows are few bytes and much work, so they are dealt over all cores however few files they were read from.
    """
    def make(some) -> None:
        folders = set()
        for row in some:
            path = f"{root}/{row.rel_path}"
            folder = os.path.dirname(path)
            if folder not in folders:
                os.makedirs(folder, exist_ok=True)
                folders.add(folder)
            with open(path, "wb", buffering=0) as file:
                file.write(b"x" * row.bytes)
                os.utime(file.fileno(), (row.mtime, row.mtime))
            for name, link, target in ((row.symlink, os.symlink, path), (row.hard_link, os.link, path),
                                       (row.broken_link, os.symlink, f"{path}.gone"), (row.loop, os.symlink, root)):
                if name:
                    with contextlib.suppress(FileExistsError):
                        link(target, f"{root}/{name}")

    rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "rel_path").foreachPartition(make)


@query
def inventory_live(v: Views) -> DataFrame:
    """A tree made of the customers, with links, broken links and loops, listed by the data source."""
    root = work_dir(v.spark, "tree").removeprefix("file://").removeprefix("file:")
    _grow_tree(t.select(v.table("customer"), t.TREE), root)
    return listing.live_inventory(v.spark, root, ["mkv", ".MP4"]).select("rel_path", "ext", "size", "mtime", "links", "is_symlink")


@query
def each_path(v: Views) -> DataFrame:
    return list_paths(filter_extensions(v.library(), ["mkv", "mp4", "avi"]))


@query
def probe_attrs(v: Views) -> DataFrame:
    return attributes.parse_attrs(v.probe_text())


@query
def probe_read(v: Views) -> DataFrame:
    """Probe text stored and read back."""
    location = work_dir(v.spark, "probe-text")
    v.probe_text().select("path", "text").write.parquet(location)
    attrs = attributes.parse_attrs(probes.read_probe_text(v.spark, location))
    return attrs.select("path", "probe_ok", "video_codec", "audio_codec", "height", "bitrate")


@query
def health_report(v: Views) -> DataFrame:
    return attributes.health_report(attributes.parse_health(v.probe_text()))


@query
def unhealthy_files(v: Views) -> DataFrame:
    return attributes.unhealthy_files(attributes.parse_health(v.probe_text()))


@query
def format_depths(v: Views) -> DataFrame:
    return v.library().select(
        "file_id", probe.bit_depth(F.col("pix_fmt")).alias("bit_depth"),
        probe.surface_depth(F.col("pix_fmt")).alias("surface_depth"),
    )


# --- rules -----------------------------------------------------------------

@query
def rule_match(v: Views) -> DataFrame:
    return v.library().select(
        "file_id", *[rules.match_all([Cond(*c)]).alias(name) for name, c in CONDITIONS.items()],
        rules.match_all([]).alias("always"),
    )


@query
def rule_program(v: Views) -> DataFrame:
    decided = rules.apply_program(v.library(), PROGRAM)
    return decided.select(
        "file_id", "rule_ix", "cmd", _text("args").alias("args"), rules.action_outcome(F.col("cmd")).alias("outcome")
    )


@query
def rule_counts(v: Views) -> DataFrame:
    return rules.rule_counts(rules.apply_program(v.library(), PROGRAM))


@query
def rule_program_stored(v: Views) -> DataFrame:
    """Each file under its owner's stored program."""
    programs = read_programs(v.programs()).select(
        F.col("id").cast("bigint").alias("owner"), rules.prepare_rules(F.col("rules")).alias("rules")
    )
    owned = facts_with_owners(v.library(), programs, ["owner"], spread_by=["path"])
    decided = rules.apply_rules_column(owned)
    return decided.select("file_id", "rule_ix", "cmd", _text("args").alias("args"))


@query
def program_list(v: Views) -> DataFrame:
    return list_programs(v.programs()).select(
        "id", "name", "schedule", "src", F.array_join("ext", "|").alias("ext"),
        F.size("rules").alias("n_rules"), F.get("rules", F.lit(0))["do"]["cmd"].alias("first_cmd"), "rules_corrupt",
    )


@query
def rule_violations(v: Views) -> DataFrame:
    return rules.rule_violations(read_programs(v.draft_programs()))


@query
def program_violations(v: Views) -> DataFrame:
    """All that is wrong with stored programs, a third of which name no root."""
    part = F.col("id").cast("bigint")
    src = F.when(part % 3 == 0, "").when(part % 7 != 1, F.col("src"))
    return rules.program_violations(read_programs(v.draft_programs().withColumn("src", src)))


def _manifests(v: Views) -> DataFrame:
    return manifests.parse_manifests(v.scripts())


@query
def manifest_programs(v: Views) -> DataFrame:
    return _manifests(v).select(
        "script_id", "name", "schedule", "src", F.array_join("ext", "|").alias("ext"), _rule_text("rules").alias("rules"), F.size("errors").alias("n_errors"))


@query
def manifest_errors(v: Views) -> DataFrame:
    return manifests.manifest_errors(_manifests(v))


@query
def manifest_round_trip(v: Views) -> DataFrame:
    """The stored programs written as manifests and read again; conditions on values with blanks or none would not survive."""
    stored = read_programs(v.programs())
    text = manifests.render_manifest(F.col("name"), F.col("schedule"), F.col("src"), F.col("ext"), F.col("rules"))
    again = manifests.parse_manifests(stored.select("id", F.concat(F.lit("set -e\n"), text, F.lit("\nexit 0")).alias("text")), "id")
    return again.select("id", "name", "schedule", "src", F.array_join("ext", "|").alias("ext"), _rule_text("rules").alias("rules"), F.size("errors").alias("n_errors"))


@query
def rule_lines(v: Views) -> DataFrame:
    parsed = rules.parse_rule_lines(v.rule_lines())
    return parsed.select(
        "file_id", F.size("when").alias("conditions"),
        rules.render_rule_line(F.col("when"), F.col("cmd"), F.col("args")).alias("rule"),
        "cmd", _text("args").alias("args"), "error",
    ).withColumn("conditions", F.when(F.col("error").isNull(), F.col("conditions")))


@query
def program_assign(v: Views) -> DataFrame:
    decided = program_run(v.library(), v.region_programs())
    return decided.select("file_id", "program_id", "rule_ix", "cmd", "outcome")


# --- planning --------------------------------------------------------------

ALONGSIDE = PlanSettings(suffix=OWN_SUFFIX, skip_source_codecs=["av1"])
MIRRORED = PlanSettings(suffix=OWN_SUFFIX, output_dir="/out", container="mp4", allow_hdr_loss=True)
INPLACE = PlanSettings(inplace=True, skip_hardlinked=True, skip_source_codecs=["AVC"])


def _planned(v: Views, chosen: PlanSettings) -> DataFrame:
    return planning.plan(v.library(), chosen, history=v.transcodes(), listing=v.listing())


def _decisions(planned: DataFrame) -> DataFrame:
    return planned.select("file_id", "output_path", "decision", "reason")


@query
def plan_alongside(v: Views) -> DataFrame:
    return _decisions(_planned(v, ALONGSIDE))


@query
def plan_mirrored(v: Views) -> DataFrame:
    return _decisions(_planned(v, MIRRORED))


@query
def plan_inplace(v: Views) -> DataFrame:
    return _decisions(_planned(v, INPLACE))


@query
def plan_force(v: Views) -> DataFrame:
    """Both modes forced: two decisions per file, from one pass with per-row settings."""
    both = v.library().withColumn("inplace", F.explode(F.array(F.lit(False), F.lit(True))))
    forced = PlanSettings(suffix=OWN_SUFFIX, force=True, inplace=F.col("inplace"), skip_source_codecs=["av1"],
                          skip_hardlinked=True)
    planned = planning.plan(both, forced, history=v.transcodes(), listing=v.listing())
    return planned.select("file_id", "inplace", "output_path", "decision", "reason")


@query
def plan_summary(v: Views) -> DataFrame:
    return planning.plan_summary(_planned(v, ALONGSIDE))


@query
def plan_listing(v: Views) -> DataFrame:
    return planning.plan_listing(_planned(v, ALONGSIDE), ALONGSIDE)


@query
def orphans(v: Views) -> DataFrame:
    return planning.orphan_artifacts(v.listing(), ["mkv", ".MP4", "avi"])


# --- settings --------------------------------------------------------------

def _profiles(v: Views) -> DataFrame:
    return settings.overlay_profiles(settings.builtin_profiles(v.spark), v.user_profiles())


def _settings(v: Views) -> DataFrame:
    return settings.resolve_settings(
        v.job_specs(), _profiles(v), env=(v.env_layer(), "owner"), config=(v.config_layer(), "site")
    )


@query
def codec_aliases(v: Views) -> DataFrame:
    names = v.requests().select("request_id", "line", "part", "codec").withColumn(
        "audio_codec", F.get(F.array(*[F.lit(a) for a in ("copy", "OPUS", "mp3", "libfdk_aac")]), (F.col("part") % 4).cast("int"))
    )
    return settings.resolve_aliases(names)


@query
def profile_overlay(v: Views) -> DataFrame:
    return _profiles(v).withColumn("extra_args", _text("extra_args"))


@query
def profile_catalog(v: Views) -> DataFrame:
    return settings.profile_catalog(_profiles(v))


@query
def settings_resolve(v: Views) -> DataFrame:
    return _settings(v).withColumns({c: _text(c) for c in ("extra_args", "ext", "skip_source_codecs")})


@query
def settings_violations(v: Views) -> DataFrame:
    return settings.validate_settings(_settings(v))


@query
def preset_resolve(v: Views) -> DataFrame:
    return settings.resolve_presets(v.routed()).select(
        "file_id", "backend", "encoder", "preset", "encoder_preset", "default_preset", "valid_preset"
    )


# --- capability ------------------------------------------------------------

@query
def encoder_pick(v: Views) -> DataFrame:
    return capability.resolve_encoder(v.requests(), v.capability())


@query
def codec_pick(v: Views) -> DataFrame:
    return capability.resolve_codec(v.requests(), v.capability())


@query
def shape_worklist(v: Views) -> DataFrame:
    return capability.distinct_shapes(v.routed(), capability.shape_verdict(v.evidence()))


@query
def shape_verdict(v: Views) -> DataFrame:
    return capability.shape_verdict(v.evidence())


@query
def encoder_verdict(v: Views) -> DataFrame:
    return capability.encoder_verdict(v.evidence(), ["backend", "codec"])


def _route(v: Views) -> DataFrame:
    return capability.decode_route(v.routed(), capability.shape_verdict(v.evidence()))


@query
def decode_route(v: Views) -> DataFrame:
    return _route(v).select(
        "file_id", "route_encoder", "route_backend", "decode_backend", "source_bit_depth", "route_preset"
    )


@query
def resource_profile(v: Views) -> DataFrame:
    return capability.resource_profile(v.routed()).select("file_id", "decode_hw", "warn", "decode_label")


@query
def command_manifest(v: Views) -> DataFrame:
    """The command of every file, with its decode route settled."""
    routed = _route(v).withColumns({
        "encoder": F.col("route_encoder"), "backend": F.col("route_backend"), "preset": F.col("route_preset"),
    })
    ready = planning.with_output_path(
        routed.withColumn("rel_path", paths.base_name(F.col("path"))), PlanSettings(suffix=OWN_SUFFIX)
    )
    return work_orders.work_orders(ready).select("file_id", "working_path", _text("args").alias("command"))


@query
def library_run(v: Views) -> DataFrame:
    """Whole runs: probe text parsed, jobs settled on their hosts, files planned and routed, commands built."""
    inventory = v.library().select("file_id", "path", "rel_path", "ext", "mtime", "links", (F.col("file_id") % 10).alias("job_id"))
    attrs = attributes.parse_attrs(v.probe_text())
    done = run_library(
        inventory, attrs, v.host_jobs(), v.capability(), capability.shape_verdict(v.evidence()),
        history=v.transcodes(), listing=v.listing(),
    )
    return done.select(
        "file_id", "job_id", "codec", "output_path", "decision", "reason", "encoder", "backend", "decode_backend",
        "source_bit_depth", F.get("args", F.size("args") - 1).alias("last_arg"),
    )


# --- runs and jobs ---------------------------------------------------------

@query
def run_register(v: Views) -> DataFrame:
    todo = _planned(v, ALONGSIDE).filter("decision = 'todo'")
    return runs.register_jobs(todo, "run-1", NOW)


@query
def run_start(v: Views) -> DataFrame:
    todo = _planned(v, ALONGSIDE).filter("decision = 'todo'")
    return runs.start_run(todo, "run-1", "nightly", NOW)


@query
def progress_parse(v: Views) -> DataFrame:
    parsed = runs.parse_progress(v.progress(), t.TOTAL_MS)
    return parsed.select(
        "seq", "run_id", "source_path", "current_ms", "total_ms", "speed", "pct", "eta_ms",
        progress.eta_label(F.col("eta_ms")).alias("eta"),
    )


@query
def progress_split(v: Views) -> DataFrame:
    """Encoder output of three updates per chunk, split into lines."""
    chunk = F.concat(F.col("line"), F.lit("\r"), F.col("line"), F.lit("\r\n"), F.lit("press q"),
                     F.when(F.col("seq") % 2 == 0, F.lit("\n")).otherwise(F.lit("")))
    return runs.split_progress_text(v.progress().select("seq", chunk.alias("text")))


def _job_events(lines: DataFrame) -> DataFrame:
    """Job events out of the progress view: progress, and some ends in between."""
    parsed = runs.progress_events(runs.parse_progress(lines, t.TOTAL_MS))
    ended = F.when(F.col("seq") % 501 == 500, F.lit("done")).when(F.col("seq") % 701 == 700, F.lit("failed"))
    return parsed.withColumn("status", F.coalesce(ended, F.col("status")))


def _registered(v: Views) -> DataFrame:
    return v.progress().filter("user_id % 7 <> 0").select("run_id", "source_path").distinct()


@query
def job_latest(v: Views) -> DataFrame:
    return runs.latest_job_state(_job_events(v.progress()), _registered(v))


@query
def run_reconcile(v: Views) -> DataFrame:
    return runs.reconcile_runs(v.runs(), v.jobs()).select("run_id", "name", "status", "ok", "failed", "skipped")


def _counts(v: Views) -> DataFrame:
    done = v.jobs().groupBy("run_id").agg(
        F.count_if(F.col("status") == "done").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
    )
    return v.runs().select("run_id", "started_at").join(done, "run_id", "left").fillna(0)


@query
def run_finish(v: Views) -> DataFrame:
    return runs.finish_run(_counts(v), NOW)


@query
def run_ledger(v: Views) -> DataFrame:
    """Opening, closing and cancelling events of all runs folded into the runs table."""
    known = v.runs()
    opened = known.select(
        "run_id", "name", F.lit("program").alias("run_kind"), F.lit("running").alias("event"),
        (F.col("run_id") % 17).alias("total"), F.col("started_at").alias("at"),
    )
    closing = known.filter("status <> 'running'").select("run_id", (F.col("started_at") + 50).alias("_at"))
    closed = runs.finish_run(_counts(v).join(closing, "run_id"), F.col("_at"))
    cancelled = runs.cancel_run(known.filter("status = 'cancelled'"), NOW)
    events = opened.unionByName(closed, allowMissingColumns=True).unionByName(cancelled, allowMissingColumns=True)
    location = work_dir(v.spark, "run-events")
    ledger.append_run_events(events, location)
    return runs.fold_run_events(ledger.read_run_events(v.spark, location))


@query
def recent_runs(v: Views) -> DataFrame:
    return runs.recent_runs(v.runs()).select("run_id", "name", "started_at", "status")


@query
def recent_failed_runs(v: Views) -> DataFrame:
    return runs.recent_runs(v.runs(), 10, "failed").select("run_id", "name", "started_at", "status")


@query
def active_runs(v: Views) -> DataFrame:
    return runs.active_runs(v.runs()).select("run_id", "name", "started_at")


@query
def run_detail(v: Views) -> DataFrame:
    detail = runs.run_detail(v.runs(), v.jobs())
    return detail.select("run_id", "name", "status", "source_path", "job_status", "job_pct", "job_updated_at")


@query
def run_documents(v: Views) -> DataFrame:
    """Runs as documents of about eight jobs per page, shown as JSON."""
    documents = runs.run_documents(v.runs(), v.jobs().select("run_id", "source_path", "status"), page_size=8)
    listed = F.transform("jobs", lambda j: F.concat_ws("=", j["source_path"], j["status"]))
    return documents.select("run_id", "page", F.size("jobs").alias("n_jobs"), F.array_join(listed, ";").alias("jobs"))


def _attempts(v: Views) -> DataFrame:
    order = packed_order(F.col("completed_at"), *[(F.col(c), 9) for c in ("l_linenumber", "l_partkey", "l_suppkey")])
    return v.transcodes().withColumn("attempt_no", order)


@query
def attempts_final(v: Views) -> DataFrame:
    return runs.attempt_outcomes(_attempts(v), ["source_path"])


@query
def retry_evictions(v: Views) -> DataFrame:
    attempts = v.transcodes().withColumnsRenamed({"video_codec": "codec", "completed_at": "seq"})
    return capability.retry_evictions(attempts)


@query
def exit_outcome(v: Views) -> DataFrame:
    closed = runs.reconcile_runs(v.runs(), v.jobs()).withColumn("total", F.col("ok") + F.col("failed"))
    return runs.exit_outcome(closed).select("run_id", "total", "failed", "exit_code")


@query
def queue_counters(v: Views) -> DataFrame:
    cancelled = v.runs().filter("cancelled_at IS NOT NULL").select("run_id", "cancelled_at")
    return runs.queue_counters(v.jobs(), cancelled)


@query
def stalled_runs(v: Views) -> DataFrame:
    return runs.stalled_runs(v.runs(), v.jobs(), NOW, 80_000_000).select("run_id", "last_update")


# --- history ---------------------------------------------------------------

_REPORT = ["completed", "status", "encoder_label", "crf", "elapsed", "source_path", "completed_at"]


@query
def recent_history(v: Views) -> DataFrame:
    return history.recent_history(v.transcodes(), tie_break=tuple(t.TIE_BREAK)).select(*_REPORT)


@query
def recent_history_stored(v: Views) -> DataFrame:
    """The newest attempts of a ledger, of which only the last months are read."""
    location = work_dir(v.spark, "recent-history")
    ledger.append_history(v.transcodes(), location)
    newest = history.recent_stored_history(v.spark, location, tie_break=("source_path", "source_size", "crf", "elapsed_ms", "output_size"))
    return newest.select("completed_at", "source_path", "source_size", "crf", "output_size", "status", "completed", "elapsed", "encoder_label")


@query
def recent_failed(v: Views) -> DataFrame:
    newest = history.recent_history(v.transcodes(), 50, failed_only=True, tie_break=tuple(t.TIE_BREAK))
    return newest.select(*_REPORT)


@query
def space_saved(v: Views) -> DataFrame:
    return history.space_saved(v.transcodes())


@query
def savings_rollup(v: Views) -> DataFrame:
    return history.savings_rollup(v.transcodes())


@query
def savings_by_day(v: Views) -> DataFrame:
    return history.savings_by_day(v.transcodes())


@query
def history_display(v: Views) -> DataFrame:
    return history.with_display(v.transcodes()).select(*t.TIE_BREAK, "completed", "elapsed", "encoder_label")


@query
def error_tail(v: Views) -> DataFrame:
    return v.transcodes().select(*t.TIE_BREAK, progress.error_tail(F.col("error_msg")).alias("tail"))


@query
def history_append(v: Views) -> DataFrame:
    """Attempts appended to the ledger and read back."""
    location = work_dir(v.spark, "history")
    ledger.append_history(v.transcodes(), location)
    stored = ledger.read_history(v.spark, location)
    return stored.groupBy("completed_month", "status").agg(
        F.count(F.lit(1)).alias("attempts"), F.sum("source_size").alias("source_bytes"),
        F.sum(F.length("error_msg")).alias("error_chars"), F.count_if(F.col("source_codec") == "").alias("no_codec"),
    )


@query
def job_events_append(v: Views) -> DataFrame:
    """Registrations and progress appended to the ledger, the log then read back and folded."""
    location = work_dir(v.spark, "job-events")
    queued = _registered(v).select(
        "run_id", F.col("source_path"), F.lit("queued").alias("status"), F.lit(0.0).alias("pct"),
        F.lit("").alias("speed"), F.lit(0).alias("ts"), F.lit(-1).alias("seq"),
    )
    ledger.append_job_events(queued, location)
    ledger.append_job_events(_job_events(v.progress()), location, batch_id=0)
    return runs.latest_job_state(ledger.read_job_events(v.spark, location))


# --- streaming -------------------------------------------------------------

def _to_the_end(spark: SparkSession, start) -> None:
    """Run a stream over everything that is there, with its state on disk, and leave the session as it was."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    job_streams.use_rocksdb(spark)
    try:
        start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@query
def changed_files_stream(v: Views) -> DataFrame:
    """Three snapshots of the library, of which the last two arrive together.

    Some files change between the first and second, a third of those change
    again, some appear only in the second.
    """
    inbox, out, checkpoint = (work_dir(v.spark, n) for n in ("snapshots", "changes", "changes-checkpoint"))
    files = v.library().select("path", "file_id", "mtime")
    schema = files.withColumn("seen_at", F.lit(0).cast("bigint")).schema

    def start():
        snapshots = watch.snapshot_stream(v.spark, f"{inbox}/s=*", schema)
        return watch.watch_changes(snapshots, out, checkpoint, once=True)

    for n in range(3):
        seen = files if n else files.filter("file_id % 10 <> 3")
        touched = F.when((F.col("file_id") % 20 == 1) & F.lit(n >= 1), 100).otherwise(0) + F.when(
            (F.col("file_id") % 60 == 1) & F.lit(n == 2), 50).otherwise(0)
        snapshot = seen.withColumns({"mtime": F.col("mtime") + touched, "seen_at": F.lit(n).cast("bigint")})
        snapshot.write.parquet(f"{inbox}/s={n}")
        if n != 1:
            _to_the_end(v.spark, start)
    return watch.read_changes(v.spark, out, schema).select("file_id", "mtime", "seen_at", "change")


@query
def watch_twice(v: Views) -> DataFrame:
    """Two passes in place: the first does everything, the second plans what changed since. The plan of all files after each."""
    spark = v.spark
    location, done, inbox = work_dir(spark, "watch"), work_dir(spark, "watch-history"), work_dir(spark, "watch-inbox")
    checkpoint = work_dir(spark, "watch-checkpoint")
    chosen = PlanSettings(inplace=True, codec="h265")
    rows = v.library().withColumn("seen_at", F.lit(0).cast("bigint"))

    def act(todo: DataFrame, batch_id: int) -> None:
        finished = todo.select(
            F.col("path").alias("source_path"), F.col("mtime").alias("source_mtime"), F.lit("done").alias("status")
        )
        finished.write.mode("overwrite").parquet(f"{done}/batch_id={batch_id}")

    v.transcodes().select("source_path", "source_mtime", "status").write.parquet(f"{done}/batch_id=-1")

    attempts = v.transcodes().select("source_path", "source_mtime", "status").schema

    for n in range(2):
        changed = F.when((F.col("file_id") % 20 == 1) & F.lit(n == 1), 7).otherwise(0)
        rows.withColumns({"mtime": F.col("mtime") + changed, "seen_at": F.lit(n).cast("bigint")}).write.parquet(f"{inbox}/s={n}")

        def start():
            snapshots = watch.snapshot_stream(spark, f"{inbox}/s=*", rows.schema)
            history = spark.readStream.schema(attempts).parquet(f"{done}/batch_id=*")
            return watch.maintain_plan(
                snapshots, chosen, location, checkpoint, history=history, act=act, once=True, name="watch-twice"
            )

        _to_the_end(spark, start)
    planned = planning.plan(rows, chosen).select("path", "file_id", "mtime", "decision", "reason").schema
    passes = watch.read_plan_history(spark, location, planned, [0, 1])
    return passes.select("file_id", "pass", "mtime", "decision", "reason")


def _event_stream(v: Views) -> DataFrame:
    """The job events as a stream of several files."""
    location = work_dir(v.spark, "events")
    events = _job_events(v.progress())
    events.repartitionByRange(4, "seq").write.parquet(location)
    reader = v.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2)
    return reader.parquet(location)


def _to_the_end_of_runs(v: Views, write) -> None:
    """Stream the job events, restart, and close every run a minute after its last event.

    The files of events may be read in any order, so rows are late only after the month they span; a last row moves time on beyond that.
    """
    location = work_dir(v.spark, "closings")
    events = _event_stream(v)
    ended = _job_events(v.progress()).groupBy("run_id").agg((F.max("ts") + 60).cast("bigint").alias("ts"))
    closings = v.spark.readStream.schema(ended.schema).parquet(f"{location}/s=*")
    changes = job_streams.open_job_states(events, closings, _registered(v), late="31 days")
    _to_the_end(v.spark, lambda: write(changes))
    after = ended.agg((F.max("ts") + 32 * 86400).alias("ts")).select(F.lit(None).cast(ended.schema["run_id"].dataType).alias("run_id"), "ts")
    ended.unionByName(after).write.parquet(f"{location}/s=1")
    _to_the_end(v.spark, lambda: write(changes))


@query
def job_state_stream(v: Views) -> DataFrame:
    out, checkpoint = work_dir(v.spark, "states"), work_dir(v.spark, "states-checkpoint")
    _to_the_end_of_runs(v, lambda changes: job_streams.write_job_state(job_streams.job_updates(changes), out, checkpoint, availableNow=True))
    stored = v.spark.read.option("basePath", out).parquet(f"{out}/batch_id=*")
    return job_streams.newest_state(stored)


@query
def queue_counters_stream(v: Views) -> DataFrame:
    out, checkpoint = work_dir(v.spark, "counters"), work_dir(v.spark, "counters-checkpoint")
    _to_the_end_of_runs(v, lambda changes: job_streams.write_open_counters(changes, out, checkpoint, availableNow=True))
    return job_streams.newest_counters(v.spark.read.parquet(f"{out}/counters"))
