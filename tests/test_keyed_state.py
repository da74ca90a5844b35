"""Streams on keyed state: their work per micro-batch does not grow, and it ends."""

import pytest

from mediaops.operators import runs
from mediaops.operators.planning import PlanSettings, plan
from mediaops.schemas import BIG, FLAG, REAL, TEXT, table
from mediaops.sources import ledger
from mediaops.streaming import jobs, state, watch

SNAPSHOT = table(path=TEXT, rel_path=TEXT, mtime=BIG, links=BIG, video_codec=TEXT, dolby_vision=FLAG, seen_at=BIG)
EVENTS = table(run_id=TEXT, source_path=TEXT, status=TEXT, pct=REAL, speed=TEXT, ts=BIG, seq=BIG)
CLOSINGS = table(run_id=TEXT, ts=BIG)
ATTEMPTS = table(source_path=TEXT, source_mtime=BIG, status=TEXT)


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def snapshot(spark, location, seen_at, files):
    rows = [(p, p.lstrip("/"), m, 1, "h264", False, seen_at) for p, m in files.items()]
    spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.mode("append").parquet(location)


def rows_of_state(query):
    return sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])


def test_change_detection_reads_its_own_rows_only(spark, tmp_path, few_partitions):
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for n in range(12):
        snapshot(spark, inbox, n, {f"/{k}": 1 + (n if k == n % 20 else 0) for k in range(20)})
    stream = watch.snapshot_stream(spark, inbox, SNAPSHOT, files_per_batch=1)
    query = watch.watch_changes(stream, out, checkpoint, once=True)
    query.awaitTermination()
    assert query.exception() is None
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(batches) == 12 and {p["numInputRows"] for p in batches} == {20}
    assert {op["numRowsTotal"] for p in batches for op in p["stateOperators"]} == {20}
    changes = watch.read_changes(spark, out, SNAPSHOT)
    assert changes.filter("change = 'new'").count() == 20
    # The log of an earlier batch is gone: the state alone knows what was seen.
    (tmp_path / "out" / "batch_id=0").rename(tmp_path / "moved")
    snapshot(spark, inbox, 99, {f"/{k}": 1 for k in range(20)} | {"/new": 3})
    watch.watch_changes(stream, out, checkpoint, once=True).awaitTermination()
    assert watch.read_changes(spark, out, SNAPSHOT).filter("seen_at = 99 and change = 'new'").count() == 1


def test_late_and_odd_sightings(spark, tmp_path, few_partitions):
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def run():
        watch.watch_changes(watch.snapshot_stream(spark, inbox, SNAPSHOT), out, checkpoint, once=True).awaitTermination()

    snapshot(spark, inbox, 5, {"/a": 1, "/b": None})
    run()
    snapshot(spark, inbox, 4, {"/a": 7, "/c": 1})
    spark.createDataFrame([(None, "x", 1, 1, "h264", False, 9), ("/b", "b", None, 1, "h264", False, 9), ("/d", "d", 1, 1, "h264", False, None)], SNAPSHOT).write.mode("append").parquet(inbox)
    run()
    found = sorted((r.path, r.change, r.mtime) for r in watch.read_changes(spark, out, SNAPSHOT).collect())
    assert found == [("/a", "new", 1), ("/b", "new", None), ("/c", "new", 1), ("/d", "new", 1)]


def passes(spark, tmp_path, settings, steps, **streams):
    """Feed the steps (function of the inbox folders) one by one and give the plan and the number of rows planned after each."""
    location, checkpoint = str(tmp_path / "plan"), str(tmp_path / "cp")
    schema = plan(spark.createDataFrame([], SNAPSHOT), settings).schema
    found = []
    for n, step in enumerate(steps):
        step()
        watch.maintain_plan(watch.snapshot_stream(spark, str(tmp_path / "in"), SNAPSHOT), settings, location, checkpoint, once=True, **streams).awaitTermination()
        stored = watch.read_plans(spark, location, schema)
        planned = {r.path: (r.decision, r.reason, r.mtime) for r in watch.read_current_plan(spark, location, schema).collect()}
        found.append((planned, stored.filter(f"batch_id = {n}").count()))
    return found


def test_a_pass_in_place_plans_what_changed(spark, tmp_path, few_partitions):
    done = str(tmp_path / "done")
    files = {f"/{k}": 1 for k in range(100)}
    attempts = lambda *rows: spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.mode("append").parquet(done)
    snapshot(spark, str(tmp_path / "in"), 0, files)
    spark.createDataFrame([], ATTEMPTS).write.parquet(done)
    found = passes(spark, tmp_path, PlanSettings(inplace=True), [
        lambda: attempts(("/7", 1, "done"), ("/8", 1, "failed"), ("/9", 5, "done"), (None, 1, "done")),
        lambda: snapshot(spark, str(tmp_path / "in"), 1, files | {"/3": 2}),
        lambda: attempts(("/3", 2, "done"), ("/4", 1, "done"), ("/7", 1, "done"), ("/other", 1, "done")),
        lambda: snapshot(spark, str(tmp_path / "in"), 2, files | {"/3": 2, "/9": 5}),
    ], history=spark.readStream.schema(ATTEMPTS).parquet(done))
    assert [n for _, n in found] == [100, 1, 2, 1]
    last = found[-1][0]
    assert len(last) == 100 and {p for p, x in last.items() if x[1] == "history_done"} == {"/3", "/4", "/7", "/9"}
    assert last["/3"] == ("skipped", "history_done", 2) and found[1][0]["/3"] == ("todo", None, 2) and last["/8"][0] == "todo"
    events = ledger.read_run_events(spark, str(tmp_path / "plan" / "run_events"))
    assert {r.run_id: r.total for r in runs.fold_run_events(events).collect()} == {"watch-0": 99, "watch-1": 1}


def test_a_pass_alongside_follows_outputs(spark, tmp_path, few_partitions):
    inbox = str(tmp_path / "in")
    found = passes(spark, tmp_path, PlanSettings(suffix=".out"), [
        lambda: snapshot(spark, inbox, 0, {"/a.mkv": 1, "/b.mkv": 1, "/b.out.mkv": 1}),
        lambda: snapshot(spark, inbox, 1, {"/a.mkv": 1, "/b.mkv": 1, "/b.out.mkv": 1, "/a.out.mkv": 4}),
    ])
    assert [n for _, n in found] == [3, 2]
    assert found[0][0]["/a.mkv"][:2] == ("todo", None) and found[0][0]["/b.mkv"][:2] == ("skipped", "output_exists")
    assert found[1][0]["/a.mkv"][:2] == ("skipped", "output_exists") and found[1][0]["/a.out.mkv"][:2] == ("skipped", "own_output")
    with pytest.raises(ValueError):
        watch.maintain_plan(watch.snapshot_stream(spark, inbox, SNAPSHOT), PlanSettings(inplace=None), "x", "y")


def feed(spark, location, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(location)


def lifecycle(run, start, jobs_=4):
    """Events of a run: all jobs queued, then running, the first half ended, the last one never registered."""
    rows = [(run, f"/{j}", "queued", 0.0, "", start, -1) for j in range(jobs_)]
    rows += [(run, f"/{j}", "running", 0.5, "1x", start + 2, j) for j in range(jobs_)]
    rows += [(run, f"/{j}", "done" if j % 2 else "failed", 0.9, "1x", start + 3, j) for j in range(jobs_ // 2)]
    return rows + [(run, "/ghost", "running", 0.1, "1x", start + 1, 0)]


def test_state_of_closed_runs_is_released(spark, tmp_path, few_partitions):
    inbox, closings, out = (str(tmp_path / n) for n in ("in", "closings", "out"))
    spark.createDataFrame([], EVENTS).write.parquet(inbox)
    spark.createDataFrame([], CLOSINGS).write.parquet(closings)
    streams = [spark.readStream.schema(s).parquet(p) for s, p in ((EVENTS, inbox), (CLOSINGS, closings))]
    state.use_rocksdb(spark)
    queries = []

    def run():
        changes = jobs.open_job_states(*streams, late="0 seconds", parts=3)
        for name, write in (("states", lambda *a, **k: jobs.write_job_state(jobs.job_updates(changes), *a, **k)), ("counters", lambda *a, **k: jobs.write_open_counters(changes, *a, **k))):
            query = write(f"{out}/{name}", str(tmp_path / f"{name}-cp"), availableNow=True)
            query.awaitTermination()
            queries.append(query)

    everything = []
    for n in range(3):
        rows = [r for k in range(6) for r in lifecycle(f"r{n}-{k}", 1000 + 100 * n)]
        everything += rows
        feed(spark, inbox, rows, EVENTS)
        run()
        feed(spark, closings, [(f"r{n}-{k}", 1050 + 100 * n) for k in range(6)], CLOSINGS)
    feed(spark, closings, [(None, 5000)], CLOSINGS)
    run()
    assert [rows_of_state(q) for q in queries[-2:]] == [0, 0]
    # Late: before the watermark nothing is taken in; later events of a released run are of nobody registered.
    feed(spark, inbox, [("r0-0", "/2", "done", 1.0, "", 1060, 0)], EVENTS)
    run()
    assert [rows_of_state(q) for q in queries[-2:]] == [0, 0]
    states = jobs.newest_state(spark.read.option("basePath", f"{out}/states").parquet(f"{out}/states"))
    batch = runs.latest_job_state(spark.createDataFrame(everything, EVENTS))
    assert sorted(map(tuple, states.collect())) == sorted(map(tuple, batch.collect())) and batch.count() == 72
    counters = jobs.newest_counters(spark.read.option("basePath", f"{out}/counters/counters").parquet(f"{out}/counters/counters"))
    assert sorted(map(tuple, counters.collect())) == sorted(map(tuple, runs.queue_counters(batch).collect()))
    # Counts of six open runs at a time are all that a batch reads, however many were closed before.
    carried = spark.read.option("basePath", f"{out}/counters/open").parquet(f"{out}/counters/open")
    assert carried.groupBy("batch_id").agg({"run_id": "count"}).agg({"count(run_id)": "max"}).first()[0] <= 2 * 6 * 3


def test_idle_parts_and_cancelled_runs(spark, tmp_path, few_partitions):
    inbox, closings, out = (str(tmp_path / n) for n in ("in", "closings", "out"))
    spark.createDataFrame([], CLOSINGS).write.parquet(closings)
    feed(spark, inbox, lifecycle("lost", 1000) + lifecycle("kept", 1000), EVENTS)
    streams = [spark.readStream.schema(s).parquet(p) for s, p in ((EVENTS, inbox), (CLOSINGS, closings))]
    state.use_rocksdb(spark)
    cancelled = spark.createDataFrame([("lost", 1003)], "run_id string, cancelled_at bigint")
    registered = spark.createDataFrame([("lost", f"/{k}") for k in range(3)] + [("kept", "/ghost")], "run_id string, source_path string")

    def run():
        changes = jobs.open_job_states(*streams, registered, late="0 seconds", idle_s=500, parts=2)
        query = jobs.write_open_counters(changes, out, str(tmp_path / "cp"), cancelled, availableNow=True)
        query.awaitTermination()
        return query

    run()
    counters = {r.run_id: r for r in jobs.newest_counters(spark.read.option("basePath", f"{out}/counters").parquet(f"{out}/counters")).collect()}
    assert (counters["lost"].cancelled, counters["lost"].errors, counters["lost"].done, counters["lost"].active) == (1, 0, 1, 1)
    assert (counters["kept"].active, counters["kept"].done) == (1, 0)
    feed(spark, closings, [(None, 3000)], CLOSINGS)
    assert rows_of_state(run()) == 0
