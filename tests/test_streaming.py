"""Watching, change detection and job state, restarted between micro-batches."""

from mediaops.operators import runs
from mediaops.operators.planning import PlanSettings
from mediaops.schemas import BIG, FLAG, REAL, TEXT, table
from mediaops.sources import ledger
from mediaops.streaming import jobs, watch

SNAPSHOT = table(path=TEXT, rel_path=TEXT, mtime=BIG, links=BIG, video_codec=TEXT, dolby_vision=FLAG, seen_at=BIG)


def snapshot(spark, location, seen_at, files):
    rows = [(p, p, m, 1, "h264", False, seen_at) for p, m in files.items()]
    spark.createDataFrame(rows, SNAPSHOT).write.mode("append").parquet(location)


def test_changes_are_found_across_restarts(spark, tmp_path):
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def run():
        watch.watch_changes(watch.snapshot_stream(spark, inbox, SNAPSHOT), out, checkpoint, once=True).awaitTermination()

    snapshot(spark, inbox, 1, {"/a": 1, "/b": 1})
    run()
    snapshot(spark, inbox, 2, {"/a": 1, "/b": 2, "/c": 1})
    run()
    # two snapshots at once: one file goes back to a time it had before
    snapshot(spark, inbox, 3, {"/a": 1, "/b": 1})
    snapshot(spark, inbox, 4, {"/a": 5, "/b": 1, "/c": 1})
    run()
    run()
    found = sorted((r.seen_at, r.path, r.change) for r in watch.read_changes(spark, out, SNAPSHOT).collect())
    assert found == [(1, "/a", "new"), (1, "/b", "new"), (2, "/b", "changed"), (2, "/c", "new"), (3, "/b", "changed"), (4, "/a", "changed")]


def test_watching_twice_does_nothing_the_second_time(spark, tmp_path):
    inbox, out, checkpoint, done = (str(tmp_path / n) for n in ("in", "out", "cp", "done"))
    history = spark.createDataFrame([], "source_path string, source_mtime bigint, status string")
    history.write.parquet(done)

    def act(todo, batch_id):
        rows = todo.selectExpr("path AS source_path", "mtime AS source_mtime", "'done' AS status")
        rows.write.mode("append").parquet(done)

    def run():
        watch.watch_plan(watch.snapshot_stream(spark, inbox, SNAPSHOT), PlanSettings(inplace=True), out, checkpoint,
                         history=lambda: spark.read.schema(history.schema).parquet(done), act=act, once=True).awaitTermination()

    snapshot(spark, inbox, 1, {"/a": 1, "/b": 1})
    run()
    snapshot(spark, inbox, 2, {"/a": 1, "/b": 1})
    run()
    snapshot(spark, inbox, 3, {"/a": 1, "/b": 9})
    run()
    events = ledger.read_job_events(spark, f"{out}/job_events")
    assert sorted((r.run_id, r.source_path, r.ts) for r in events.collect()) == [("watch-0", "/a", 1), ("watch-0", "/b", 1), ("watch-2", "/b", 3)]
    opened = {r.run_id: (r.total, r.status) for r in runs.fold_run_events(ledger.read_run_events(spark, f"{out}/run_events")).collect()}
    assert opened == {"watch-0": (2, "done"), "watch-2": (1, "done")}
    closed = ledger.read_run_events(spark, f"{out}/run_events").filter("event = 'done'")
    assert sorted((r.run_id, r.ok, r.failed, r.skipped) for r in closed.collect()) == [("watch-0", 2, 0, 0), ("watch-2", 1, 0, 1)]
    assert runs.latest_job_state(events).count() == 3


def test_a_repeated_pass_writes_the_same(spark, tmp_path):
    out, done = str(tmp_path / "out"), str(tmp_path / "done")
    snapshot(spark, str(tmp_path / "in"), 1, {"/a": 1})
    snapshot(spark, str(tmp_path / "in"), 2, {"/a": 1, "/b": 1})
    batch = spark.read.schema(SNAPSHOT).parquet(str(tmp_path / "in"))
    history = spark.createDataFrame([], "source_path string, source_mtime bigint, status string")
    history.write.parquet(done)

    def act(todo, batch_id):
        """Records its work where the next pass looks, and one of two files fails."""
        ended = todo.selectExpr("path", "mtime", "if(path = '/b', 'failed', 'done') AS status")
        ended.selectExpr("path AS source_path", "mtime AS source_mtime", "status").write.mode("append").parquet(done)
        return ended

    seen = []
    for _ in range(2):
        watch.plan_pass(batch, 4, PlanSettings(inplace=True), out, history=lambda: spark.read.schema(history.schema).parquet(done),
                        listing=lambda: None, act=act)
        plans = sorted((r.path, r.decision) for r in spark.read.parquet(f"{out}/plans").collect())
        events = sorted(tuple(r) for r in ledger.read_run_events(spark, f"{out}/run_events").select("run_id", "event", "total", "ok", "failed", "skipped").collect())
        jobs_ = sorted((r.source_path, r.run_id) for r in ledger.read_job_events(spark, f"{out}/job_events").collect())
        seen.append((plans, events, jobs_))
    assert seen[0] == seen[1]
    assert seen[0][0] == [("/a", "todo"), ("/b", "todo")]
    assert ("watch-4", "failed", 1, 1) in [(e[0], e[1], e[3], e[4]) for e in seen[0][1]]


def test_a_failed_pass_is_taken_up_again(spark, tmp_path):
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    snapshot(spark, inbox, 1, {"/a": 1})
    tries = []

    def act(todo, batch_id):
        tries.append(batch_id)
        if len(tries) == 1:
            raise RuntimeError("disk full")

    def start():
        return watch.watch_plan(watch.snapshot_stream(spark, inbox, SNAPSHOT), PlanSettings(), out, checkpoint, act=act, once=True)

    watch.keep_watching(start, pause_s=0.0)
    assert tries == [0, 0] and ledger.read_job_events(spark, f"{out}/job_events").count() == 1


EVENTS = table(run_id=TEXT, source_path=TEXT, status=TEXT, pct=REAL, speed=TEXT, ts=BIG, seq=BIG)


def test_streamed_state_equals_batch_state(spark, tmp_path):
    inbox = str(tmp_path / "in")
    steps = [("queued", 0.0), ("running", 0.1), ("running", 0.6), ("done", 0.99), ("running", 0.98)]
    events = [(f"r{r}", f"/{p}", s, pct, "1x" if pct else "", i, p) for i, (s, pct) in enumerate(steps) for r in range(3) for p in range(5)
              if not (s == "done" and p % 2)] + [("r0", "/ghost", "running", 0.5, "1x", 9, 9)]
    df = spark.createDataFrame(events, EVENTS)
    jobs.use_rocksdb(spark)

    def feed(part):
        part.write.mode("append").parquet(inbox)

    def run(location, writer, **kw):
        stream = spark.readStream.schema(EVENTS).parquet(inbox)
        writer(jobs.job_state_stream(stream), str(tmp_path / location), str(tmp_path / f"{location}-cp"), availableNow=True, **kw).awaitTermination()

    # late events first: the order of arrival must not matter
    for part in (df.filter("ts >= 3"), df.filter("ts < 2"), df.filter("ts = 2")):
        feed(part)
        run("states", jobs.write_job_state)
        run("queue", jobs.write_queue_counters, compact_every=2)
    streamed = jobs.newest_state(spark.read.option("basePath", str(tmp_path / "states")).parquet(str(tmp_path / "states")))
    batch = runs.latest_job_state(df)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    assert batch.count() == 15 and batch.filter("status = 'done'").count() == 9
    counters = jobs.newest_counters(spark.read.parquet(str(tmp_path / "queue/counters")))
    assert sorted(map(tuple, counters.collect())) == sorted(map(tuple, runs.queue_counters(batch).collect()))
    registered = spark.createDataFrame([("r0", "/ghost")], "run_id string, source_path string")
    stream = jobs.job_state_stream(spark.readStream.schema(EVENTS).parquet(inbox), registered)
    jobs.write_job_state(stream, str(tmp_path / "reg"), str(tmp_path / "reg-cp"), availableNow=True).awaitTermination()
    assert [r.source_path for r in spark.read.parquet(str(tmp_path / "reg")).collect()] == ["/ghost"]
