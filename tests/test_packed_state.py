"""Files and marks reach the state of a plan packed: one value per part, not one per row, and the state says the same as row by row."""

import datetime
import random

import pyarrow as pa
import pytest
from pyspark.sql import Row

from mediaops.operators.planning import PlanSettings, plan
from mediaops.schemas import BIG, TEXT, TEXTS, table
from mediaops.streaming import packed, state, watch

FILES = pa.schema([("path", pa.string()), ("mtime", pa.int64()), ("seen_at", pa.int64()), ("note", pa.int64()), ("_mark", pa.string())])
PACKED = Row("_part", "_rows", "is_mark")


def odd_rows(spark):
    return spark.sql("""SELECT cast(id % 3 AS INT) AS _part, concat('/', id) AS path, if(id % 5 = 0, NULL, 1000000000000000999 + id) AS size,
        if(id % 7 = 0, double('NaN'), id / 3) AS share, if(id % 4 = 0, NULL, array(NULL, concat('é', id))) AS names,
        named_struct('a', if(id % 2 = 0, NULL, id)) AS inner, timestamp_micros(id * 1000003) AS at, date_add(date'2024-02-28', cast(id AS INT)) AS day,
        cast(id AS DECIMAL(20, 3)) AS price, encode(cast(id AS STRING), 'utf-8') AS raw FROM range(2000)""")


def test_the_rows_of_a_part_are_one_value(spark):
    rows = odd_rows(spark)
    values = packed.pack(rows).collect()
    assert sorted(r._part for r in values) == [0, 1, 2]
    assert [packed.load(bytes(r._rows)).num_rows for r in sorted(values)] == [667, 667, 666]
    marks = rows.selectExpr("_part", "cast(_part AS STRING) AS _mark")
    assert [packed.load(bytes(r._rows)).num_rows for r in packed.pack(marks, once=True).collect()] == [1, 1, 1]


def test_values_unpack_to_the_same_rows(spark, monkeypatch):
    rows = odd_rows(spark)
    plain = rows.drop("_part")
    found = packed.unpack(packed.pack(rows), plain.schema)
    assert found.schema == plain.schema
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    wider = packed.unpack(packed.pack(rows.select("_part", "path")), table(path=TEXT, names=TEXTS))
    assert wider.filter("names is null").count() == 2000


class Handle:
    """State of one part, as Spark would keep it."""

    def __init__(self):
        self.stored, self.writes = None, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.stored

    def update(self, value):
        self.stored, self.writes = value, self.writes + 1


class Plain:
    """The same memory row by row."""

    def __init__(self, by_mark):
        self.by_mark, self.files, self.marks = by_mark, {}, set()

    def step(self, files, marks):
        newest = {}
        order = lambda f: (f["seen_at"] is not None, f["seen_at"] or 0)
        name = lambda f: (f["path"], f["_mark"] if self.by_mark else None)
        for f in files:
            if name(f) not in newest or order(f) >= order(newest[name(f)]):
                newest[name(f)] = f
        added = marks - self.marks
        self.marks |= marks
        out = []
        for n, f in newest.items():
            before = self.files.get(n)
            if before is None or (order(f) >= order(before) and f["mtime"] != before["mtime"]):
                self.files[n] = f | {"present": f["_mark"] in self.marks}
                out.append(self.files[n])
        for n, f in self.files.items():
            if f["_mark"] in added and not f["present"]:
                self.files[n] = f | {"present": True}
                out.append(self.files[n])
        return out


@pytest.mark.parametrize("by_mark", [False, True])
def test_packed_state_equals_plain_state(by_mark):
    pick = random.Random(7)
    handle, plain = Handle(), Plain(by_mark)
    facts = state.PlanFacts(by_mark)
    facts.init(handle)
    empty = 0
    for n in range(300):
        files = []
        for k in range(pick.choice([0, 0, 1, 3, 12])):
            path, mtime = f"/{pick.randrange(9)}", pick.choice([None, 1, 2, 3])
            mark = pick.choice([None, "/a", "/b"]) if by_mark else None if mtime is None else f"{mtime} {path}"
            files.append({"path": path, "mtime": mtime, "seen_at": pick.choice([None, n - 1, n, n + 1]), "note": 1000 * n + k, "_mark": mark})
        told = [pick.choice(["/a", "/b"]) if by_mark else f"{pick.randrange(4)} /{pick.randrange(9)}" for _ in range(pick.choice([0, 0, 1, 2]))] if n % 9 > 6 else []
        cut = pick.randrange(len(files) + 1)
        rows = [PACKED(0, packed.dump(pa.Table.from_pylist(some, FILES)), False) for some in (files[:cut], files[cut:]) if some]
        rows += [PACKED(0, packed.dump(pa.table({"_mark": [m]})), True) for m in told]
        writes = handle.writes
        found = [f for r in facts.handleInputRows((0,), iter(rows), None) for f in packed.load(r["_rows"]).to_pylist()]
        before = set(plain.marks)
        wanted = plain.step(files, set(told))
        key = lambda f: str(sorted(f.items()))
        assert sorted(found, key=key) == sorted(wanted, key=key)
        assert handle.writes - writes == (1 if wanted or set(told) - before else 0)
        empty += not wanted
    assert 0 < empty < 300 and len(plain.files) >= 9


def test_state_takes_a_column_more_and_another_zone():
    handle, facts = Handle(), state.PlanFacts(by_mark=False)
    facts.init(handle)

    def step(zone, **more):
        at = pa.array([datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)], pa.timestamp("us", zone))
        names = list(more.pop("paths"))
        rows = pa.table({"path": names, "mtime": pa.array([1], pa.int64()), "seen_at": pa.array([1], pa.int64()), "at": at, "_mark": [f"1 {names[0]}"], **more})
        return [packed.load(r["_rows"]) for r in facts.handleInputRows((0,), iter([PACKED(0, packed.dump(rows), False)]), None)]

    step("UTC", paths=["/a"])
    step("Europe/Berlin", paths=["/b"], more=["x"])
    told = PACKED(0, packed.dump(pa.table({"_mark": ["1 /a", "1 /b"]})), True)
    (found,) = (packed.load(r["_rows"]).sort_by("path") for r in facts.handleInputRows((0,), iter([told]), None))
    assert found["more"].to_pylist() == [None, "x"] and len(set(found["at"].to_pylist())) == 1 and found["present"].to_pylist() == [True, True]


def test_a_pass_keeps_every_column_of_a_file(spark, tmp_path):
    inbox, done, location, checkpoint = (str(tmp_path / n) for n in ("in", "done", "plan", "cp"))
    files = spark.sql("""SELECT concat('/', id) AS path, concat(id) AS rel_path, id AS mtime, 1L AS links, 'h264' AS video_codec, false AS dolby_vision,
        if(id % 2 = 0, NULL, 1000000000000000999) AS bitrate, array(concat('t', id), NULL) AS tags, timestamp_micros(id) AS at, 0L AS seen_at FROM range(50)""")
    files.write.parquet(inbox)
    attempts = table(source_path=TEXT, source_mtime=BIG, status=TEXT)
    settings = PlanSettings(inplace=True)
    for rows in ([("/1", 1, "done"), ("/2", 9, "done")], [("/3", 3, "done")]):
        spark.createDataFrame(rows, attempts).write.mode("append").parquet(done)
        watch.maintain_plan(watch.snapshot_stream(spark, inbox, files.schema), settings, location, checkpoint, once=True,
                            history=spark.readStream.schema(attempts).parquet(done)).awaitTermination()
    stored = watch.read_current_plan(spark, location, plan(files, settings).schema)
    assert sorted(map(str, stored.select(*files.columns).collect())) == sorted(map(str, files.collect()))
    assert {r.path for r in stored.filter("reason = 'history_done'").collect()} == {"/1", "/3"}


def test_plans_after_each_pass_are_read_at_once(spark, tmp_path):
    schema = table(path=TEXT, mtime=BIG, reason=TEXT)
    steps = [[("/a", 1, None), ("/b", 1, "x")], [("/a", 2, "y"), ("/c", None, None)], [], [("/b", 3, None)]]
    for n, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/plans/batch_id={n}")
    found = watch.read_plan_history(spark, str(tmp_path), schema, [0, 1, 2])
    wanted = [(*r, n) for n in (0, 1, 2) for r in watch.read_current_plan(spark, str(tmp_path), schema, as_of=n).collect()]
    assert found.columns == ["path", "mtime", "reason", "pass"] and len(wanted) == 8
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
    scans = found._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert scans == 1
