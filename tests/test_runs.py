"""Run and job lifecycle, progress, and history reports."""

from mediaops.operators import history, runs

JOBS = "run_id string, source_path string, status string, updated_at bigint"
EVENTS = "run_id string, source_path string, status string, pct double, speed string, ts bigint, seq bigint"


def test_reconcile_closes_unfinished_jobs(spark):
    known = spark.createDataFrame([("r1", "running", 0, 0, 0), ("empty", "running", 0, 0, 0), ("ok", "running", 0, 0, 0), ("gone", "cancelled", 5, 1, 0)],
                                  "run_id string, status string, ok bigint, failed bigint, skipped bigint")
    jobs = spark.createDataFrame([("r1", f"/{s}", s, 1) for s in ("done", "failed", "running", "queued")]
                                 + [("ok", "/a", "done", 1), ("gone", "/b", "running", 1)], JOBS)
    closed = {r.run_id: (r.status, r.ok, r.failed, r.skipped) for r in runs.reconcile_runs(known, jobs).collect()}
    assert closed == {"r1": ("failed", 1, 2, 1), "empty": ("done", 0, 0, 0), "ok": ("done", 1, 0, 0), "gone": ("cancelled", 5, 1, 0)}


def test_latest_job_state(spark):
    events = spark.createDataFrame([
        ("r", "/a", "queued", 0.0, "", 1, -1), ("r", "/a", "running", 0.42, "2.10x", 2, 1), ("r", "/b", "queued", 0.0, "", 1, -1),
        ("r", "/c", "queued", 0.0, "", 1, -1), ("r", "/c", "done", 0.9, "1x", 3, 7), ("r", "/c", "running", 0.95, "3x", 9, 9),
        ("r", "/ghost", "running", 0.5, "1x", 2, 2),
    ], EVENTS)
    expected = {"/a": ("running", 0.42, "2.10x", 2), "/b": ("queued", 0.0, "", 1), "/c": ("done", 1.0, "", 3)}
    state = lambda df: {r.source_path: (r.status, r.pct, r.speed, r.updated_at) for r in df.collect()}
    assert state(runs.latest_job_state(events)) == expected
    registered = spark.createDataFrame([("r", "/a"), ("r", "/a"), ("r", "/zzz")], "run_id string, source_path string")
    assert state(runs.latest_job_state(events, registered)) == {"/a": expected["/a"]}


def test_opening_a_run(spark, rows):
    files = spark.createDataFrame([("/a",), ("/b",)], "path string")
    assert rows(runs.start_run(files, "r", "nightly", 5, "program")) == [("r", "nightly", "program", "running", 2, 0, 0, 0, 5)]
    assert sorted(rows(runs.register_jobs(files, "r", 5))) == [("r", p, "queued", 0.0, "", 5, -1) for p in ("/a", "/b")]
    assert rows(runs.start_run(files.limit(0), "r", "", 5))[0][4] == 0


def test_run_events_fold(spark):
    opened = spark.createDataFrame([(r, r, "watch", "running", 4, 100) for r in ("a", "b", "c", "d")],
                                   "run_id string, name string, run_kind string, event string, total bigint, at bigint")
    counts = spark.createDataFrame([("a", 4, 0, 0), ("b", 3, 1, 0), ("c", 2, 2, 0)], "run_id string, ok bigint, failed bigint, skipped bigint")
    cancelled = runs.cancel_run(spark.createDataFrame([("c",)], "run_id string"), 150)
    events = opened.unionByName(runs.finish_run(counts, 200), allowMissingColumns=True).unionByName(cancelled, allowMissingColumns=True)
    folded = {r.run_id: (r.status, r.finished_at, r.total, r.ok, r.failed) for r in runs.fold_run_events(events).collect()}
    assert folded == {"a": ("done", 200, 4, 4, 0), "b": ("failed", 200, 4, 3, 1), "c": ("cancelled", 150, 4, 0, 0), "d": ("running", None, 4, 0, 0)}


def test_run_lists(spark):
    known = spark.createDataFrame([(f"r{i}", i // 2, ["running", "done", "failed"][i % 3]) for i in range(10)], "run_id string, started_at bigint, status string")
    ids = lambda df: [r.run_id for r in df.collect()]
    assert ids(runs.recent_runs(known, 3)) == ["r9", "r8", "r7"]
    assert ids(runs.recent_runs(known, status="failed")) == ["r8", "r5", "r2"]
    assert ids(runs.active_runs(known)) == ["r9", "r6", "r3", "r0"]


def test_run_detail_and_documents(spark, rows):
    known = spark.createDataFrame([("r", "done"), ("empty", "done")], "run_id string, status string")
    jobs = spark.createDataFrame([("r", f"/{i:03}", "done", i) for i in range(100)], JOBS)
    detail = runs.run_detail(known, jobs, "r").collect()
    assert [r.source_path for r in detail] == [f"/{i:03}" for i in range(100)] and detail[7].job_updated_at == 7
    assert rows(runs.run_detail(known, jobs, "empty").select("source_path", "job_status")) == [(None, None)]
    assert runs.run_detail(known, jobs, "unknown").count() == 0
    pages = runs.run_documents(known, jobs, page_size=10).collect()
    nested = [[j.source_path for j in p.jobs] for p in pages if p.run_id == "r"]
    assert all(page == sorted(page) and len(page) < 40 for page in nested) and len(nested) == 10
    assert sorted(sum(nested, [])) == [f"/{i:03}" for i in range(100)]
    assert [(p.page, p.jobs) for p in pages if p.run_id == "empty"] == [(0, [])]


ATTEMPT = "run_id string, source_path string, attempt_no int, decode_backend string, status string, error_kind string, cancelled boolean"


def test_one_retry_for_a_failed_hardware_decode(spark):
    attempts = spark.createDataFrame([
        ("r", "/retried", 1, "vaapi", "failed", "exec", False), ("r", "/retried", 2, "", "done", "", False),
        ("r", "/twice", 1, "vaapi", "failed", "exec", False), ("r", "/twice", 2, "", "failed", "exec", False),
        ("r", "/due", 1, "vaapi", "failed", "exec", False), ("r", "/software", 1, "", "failed", "exec", False),
        ("r", "/os", 1, "vaapi", "failed", "os", False), ("r", "/cancelled", 1, "vaapi", "failed", "exec", True),
    ], ATTEMPT)
    got = {r.source_path: (r.attempts, r.status, r.retry_earned, r.retry_due) for r in runs.attempt_outcomes(attempts).collect()}
    assert got == {
        "/retried": (2, "done", True, False), "/twice": (2, "failed", True, False), "/due": (1, "failed", True, True),
        "/software": (1, "failed", False, False), "/os": (1, "failed", False, False), "/cancelled": (1, "failed", False, False),
    }


def test_exit_codes(spark):
    df = spark.createDataFrame([(1, 3, 0, False), (2, 3, 1, False), (3, 3, 3, False), (4, 3, 0, True)], "id int, total bigint, failed bigint, usage_error boolean")
    assert {r.id: r.exit_code for r in runs.exit_outcome(df).collect()} == {1: 0, 2: 3, 3: 4, 4: 2}


def test_queue_counters(spark):
    jobs = spark.createDataFrame([
        ("r", "/1", "done", 1), ("r", "/2", "failed", 5), ("r", "/3", "failed", 10), ("r", "/4", "failed", 11), ("r", "/5", "running", 11),
        ("r", "/6", "queued", 1), ("r", "/7", "skipped", 1), ("s", "/8", "failed", 99),
    ], JOBS)
    cancelled = spark.createDataFrame([("r", 10)], "run_id string, cancelled_at bigint")
    got = {r.run_id: tuple(r)[1:] for r in runs.queue_counters(jobs, cancelled).collect()}
    assert got == {"r": (1, 1, 2, 1, 1, 1), "s": (0, 1, 0, 0, 0, 0)}
    assert {r.run_id: (r.errors, r.cancelled) for r in runs.queue_counters(jobs).collect()} == {"r": (3, 0), "s": (1, 0)}


def test_stalled_runs(spark):
    known = spark.createDataFrame([("old", "running", 0), ("fresh", "running", 0), ("idle", "running", 10), ("done", "done", 0)], "run_id string, status string, started_at bigint")
    jobs = spark.createDataFrame([("old", "/a", "running", 50), ("fresh", "/a", "running", 95), ("done", "/a", "done", 1)], JOBS)
    assert sorted(r.run_id for r in runs.stalled_runs(known, jobs, now=100, threshold_s=20).collect()) == ["idle", "old"]


def test_output_is_split_at_carriage_returns(spark, rows):
    update = "frame={} fps= 24 q=28.0 size=  102400kB time=00:00:{:02}.00 bitrate=1000.0kbits/s speed=1.00x\r"
    text = "".join(update.format(i, i % 60) for i in range(5000))
    lines = runs.split_progress_text(spark.createDataFrame([(1, text)], "id int, text string"))
    parsed = runs.parse_progress(lines, 60_000)
    assert lines.count() == 5000 and parsed.count() == 5000
    assert parsed.filter("line_no = 59").first().pct == 59_000 / 60_000
    short = spark.createDataFrame([(1, "a\r\nb"), (2, "a\n"), (3, ""), (4, None)], "id int, text string")
    assert sorted(rows(runs.split_progress_text(short))) == [(1, 0, "a"), (1, 1, ""), (1, 2, "b"), (2, 0, "a")]


HISTORY = "source_path string, source_size bigint, output_size bigint, status string, encoder string, target_codec string, elapsed_ms bigint, completed_at bigint"


def test_history_reports(spark, rows):
    df = spark.createDataFrame([
        ("/a", 1000, 900, "done", "x265", "h265", 42_000, 300), ("/b", 500, 600, "done", "x265", "h265", 100, 300),
        ("/c", 900, 0, "done", "", "av1", 4_503_000, 100), ("/d", 900, 100, "failed", "x265", "av1", 0, 200),
    ], HISTORY)
    assert rows(history.space_saved(df)) == [(100,)] and rows(history.space_saved(df.limit(0))) == [(0,)]
    newest = history.recent_history(df, 3).select("source_path", "completed", "elapsed", "encoder_label").collect()
    assert [r.source_path for r in newest] == ["/a", "/b", "/d"] and newest[0].elapsed == "42s"
    assert [r.source_path for r in history.recent_history(df, failed_only=True).collect()] == ["/d"]
    assert history.with_display(df).filter("source_path = '/c'").first().encoder_label == "(unknown)"
    rollup = {(r.encoder, r.target_codec, r.level): (r.attempts, r.bytes_saved) for r in history.savings_rollup(df).collect()}
    assert rollup[(None, None, 3)] == (4, 100) and rollup[("x265", None, 1)] == (3, 100) and len(rollup) == 6


def test_filters_and_columns_reach_the_scan(spark, tmp_path, capsys):
    location = str(tmp_path / "history")
    spark.createDataFrame([("/a", 1000, 900, "done", "x265", "h265", 1, 300)], HISTORY).write.parquet(location)
    stored = spark.read.parquet(location)
    history.space_saved(stored).explain("formatted")
    saved = capsys.readouterr().out
    assert "EqualTo(status,done)" in saved and "ReadSchema: struct<source_size:bigint,output_size:bigint,status:string>" in saved
    history.recent_history(stored, failed_only=True).explain("formatted")
    recent = capsys.readouterr().out
    assert "EqualTo(status,failed)" in recent and "TakeOrderedAndProject" in recent
