"""Paths share parts of the state: it is called per part, not per path, and every path keeps its own memory."""

from mediaops.operators.planning import PlanSettings, plan
from mediaops.schemas import BIG, FLAG, TEXT, table
from mediaops.streaming import state, watch

SNAPSHOT = table(path=TEXT, rel_path=TEXT, mtime=BIG, links=BIG, video_codec=TEXT, dolby_vision=FLAG, seen_at=BIG)
ATTEMPTS = table(source_path=TEXT, source_mtime=BIG, status=TEXT)


def snapshot(spark, location, seen_at, files):
    rows = [(p, p.lstrip("/"), m, 1, "h264", False, seen_at) for p, m in files.items()]
    spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.mode("append").parquet(location)


def test_changes_of_paths_in_one_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "PARTS", 3)
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    files = {f"/{k}": k for k in range(60)}
    for n in range(3):
        snapshot(spark, inbox, n, {p: m + (n if m % 10 == 1 else 0) for p, m in files.items()})
        query = watch.watch_changes(watch.snapshot_stream(spark, inbox, SNAPSHOT), out, checkpoint, once=True)
        query.awaitTermination()
        assert sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"]) == 3
    found = sorted((r.seen_at, r.change, int(r.path[1:])) for r in watch.read_changes(spark, out, SNAPSHOT).collect())
    changed = [k for k in range(60) if k % 10 == 1]
    assert found == [(0, "new", k) for k in range(60)] + [(n, "changed", k) for n in (1, 2) for k in changed]


def test_facts_of_keys_in_one_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "PARTS", 2)
    inbox, done, location, checkpoint = (str(tmp_path / n) for n in ("in", "done", "plan", "cp"))
    files = {f"/{k}": 1 for k in range(40)}
    settings = PlanSettings(inplace=True)
    schema = plan(spark.createDataFrame([], SNAPSHOT), settings).schema

    def one_pass(*attempts):
        spark.createDataFrame(list(attempts), ATTEMPTS).coalesce(1).write.mode("append").parquet(done)
        query = watch.maintain_plan(watch.snapshot_stream(spark, inbox, SNAPSHOT), settings, location, checkpoint, once=True,
                                    history=spark.readStream.schema(ATTEMPTS).parquet(done))
        query.awaitTermination()
        assert sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"]) == 2
        return {r.path for r in watch.read_current_plan(spark, location, schema).collect() if r.reason == "history_done"}

    snapshot(spark, inbox, 0, files)
    assert one_pass(("/1", 1, "done"), ("/2", 2, "done"), ("/3", 1, "failed")) == {"/1"}
    snapshot(spark, inbox, 1, files | {"/2": 2})
    assert one_pass(("/4", 1, "done"), ("/gone", 1, "done")) == {"/1", "/2", "/4"}
    # A schema of some columns reads these alone.
    some = table(path=TEXT, decision=TEXT)
    assert watch.read_current_plan(spark, location, some).filter("decision = 'skipped'").count() == 3
