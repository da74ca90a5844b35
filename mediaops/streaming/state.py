"""Keyed state of the streams: what a path was last seen as, and where each job of an open run stands."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import packed

#: Parts over which the paths of a library are dealt by a hash. Calls to the state for every path took most of a pass, so
#: paths are not read and written one by one. A checkpoint is bound to the number.
PARTS = 1 << 14
#: The most parts for packed rows: there the call of a part costs far more than a row in it.
PACKED_PARTS = 1 << 12
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state on disk, so that it may exceed executor memory; keyed state needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _seen(row) -> tuple:
    return (row["seen_at"] is not None, row["seen_at"])


def part_of(key: Column | str, parts: int | None = None) -> Column:
    """The part of the state that a key belongs to."""
    return F.pmod(F.xxhash64(key), F.lit(parts or PARTS)).cast("int")


class Part:
    """What is known of the keys of one part, kept as one value: read and written in one call, however many keys it holds."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self._value = handle.getValueState("part", "known binary")

    def read(self) -> dict:
        stored = self._value.get()
        return {} if stored is None else pickle.loads(stored[0])

    def write(self, known: dict) -> None:
        self._value.update((pickle.dumps(known, pickle.HIGHEST_PROTOCOL),))


class Sightings(StatefulProcessor):
    """Per part of the paths: passes on the sightings whose mtime differs from the path's one before.

    Rows have ``_row``, the sighting. A part holds mtime and time of the last change of each of its paths and is written only when one
    changes. A sighting that arrives late, from before the last change, says nothing about the file as it is now and is ignored.
    """

    def __init__(self, columns: list[str]) -> None:
        self._out = Row(*columns, "change")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._part = Part(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known, altered = self._part.read(), False
        for row in sorted((r["_row"] for r in rows), key=_seen):
            last = known.get(row["path"])
            if last is not None and _seen(row) < (last[1] is not None, last[1]):
                continue
            if last is None or row["mtime"] != last[0]:
                known[row["path"]], altered = (row["mtime"], row["seen_at"]), True
                yield self._out(*row.values(), "new" if last is None else "changed")
        if altered:
            self._part.write(known)

    def close(self) -> None:
        pass


class PlanFacts(StatefulProcessor):
    """Per part of the keys: files, and marks that bear on their plan. Passes on a file when it is new or changed, or when its mark appears.

    Rows are packed tables: sightings of files, with the ``_mark`` that each asks for, or, where ``is_mark``, marks alone. What comes out is
    packed too: files and whether their mark is there (``present``), for these files alone. A part holds its files as they were last
    passed on and its marks, each as one table, and is written only when one of them changes. Files of one path are one file, unless
    ``by_mark``: then the mark they ask for tells them apart as well.
    """

    def __init__(self, by_mark: bool) -> None:
        self._by_mark, self._out = by_mark, Row("_rows")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._part = handle.getValueState("facts", "files binary, marks binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen, told = [], []
        for row in rows:
            (told if row["is_mark"] else seen).append(packed.load(row["_rows"]))
        known, marks = (packed.load(table) if table else None for table in self._part.get() or (None, None))
        added = _new_marks(told, marks) if told else None
        if added:
            marks = packed.joined([marks, added]) if marks else added
        passed = found = None
        if seen:
            passed = self._newest(packed.joined(seen))
            if known:
                passed, known = self._changes(passed, known)
            passed = passed.append_column("present", _asked(passed, marks))
        if known and added:
            appeared = pc.and_(_asked(known, added), pc.invert(known["present"]))
            known = known.set_column(known.column_names.index("present"), "present", pc.or_(known["present"], appeared))
            found = known.filter(appeared)
        if passed or added:
            files = [files for files in (known, passed) if files]
            self._part.update(tuple(packed.dump(packed.joined(t), "zstd") if t else None for t in (files, [marks] if marks else [])))
        for files in (passed, found):
            if files:
                yield self._out(packed.dump(files))

    def _names(self, files: pa.Table) -> pa.Array:
        if not self._by_mark:
            return files["path"].combine_chunks()
        mark = files["_mark"]
        size = pc.utf8_length(mark).cast(pa.string())
        return pc.binary_join_element_wise(size, mark, files["path"], ":", null_handling="replace", null_replacement="-").combine_chunks()

    def _newest(self, files: pa.Table) -> pa.Table:
        """The newest sighting of every file; of equally new ones the last."""
        names = self._names(files).dictionary_encode()
        if len(names.dictionary) == len(files):
            return files
        order = pc.sort_indices(files, [("seen_at", "ascending")], null_placement="at_start").to_numpy()
        last = np.empty(len(names.dictionary), np.int64)
        last[names.indices.to_numpy()[order]] = order
        return files.take(last)

    def _changes(self, files: pa.Table, known: pa.Table) -> tuple[pa.Table, pa.Table]:
        """The files that are new or changed, and the known ones without these."""
        place = pc.index_in(self._names(files), value_set=self._names(known))
        before = known.select(["seen_at", "mtime"]).take(place)
        (at, mtime), (at_before, mtime_before) = ([t[name].combine_chunks() for name in ("seen_at", "mtime")] for t in (files, before))
        earlier = pc.or_(pc.and_(pc.is_null(at), pc.is_valid(at_before)), pc.less(at, at_before).fill_null(False))
        same = pc.or_(pc.and_(pc.is_null(mtime), pc.is_null(mtime_before)), pc.equal(mtime, mtime_before).fill_null(False))
        altered = pc.or_(pc.is_null(place), pc.invert(pc.or_(earlier, same)))
        stays = np.ones(len(known), bool)
        stays[place.filter(altered).drop_null().to_numpy()] = False
        return files.filter(altered), known.filter(pa.array(stays))

    def close(self) -> None:
        pass


def _asked(files: pa.Table, marks: pa.Table | None) -> pa.ChunkedArray:
    """Whether the mark that each file asks for is among the marks."""
    return pc.is_in(files["_mark"], value_set=marks["_mark"] if marks else pa.array([], pa.string()))


def _new_marks(told: list[pa.Table], marks: pa.Table | None) -> pa.Table:
    told = packed.distinct(packed.joined(told))
    return told.filter(pc.invert(_asked(told, marks))) if marks else told


class OpenJobs(StatefulProcessor):
    """Per part of a run: the state of its jobs, until the run is closed.

    Rows are job events, or the run's closing (without source_path). A job's deciding event is the one of an end state, else of the
    greatest (ts, seq). What comes out is each change of a registered job's state with the state before it, and one
    row without source_path, of status ``released``, when the part is given up: once event time has passed the closing, or when
    nothing was heard of it for ``idle_s`` seconds of event time, which also ends parts whose closing was lost.
    """

    def __init__(self, out: list[str], ended: list[str], registered: bool, grace_s: int, idle_s: int) -> None:
        self._out, self._ended, self._registered, self._grace, self._idle = Row(*out), ended, registered, grace_s, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._jobs = handle.getMapState("jobs", "source_path string", "registered boolean, ended boolean, ts bigint, seq bigint, status string, pct double, speed string")
        self._run = handle.getValueState("run", "closed_at bigint, last bigint, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        run, part = key
        known = self._run.get()
        closed, last, timer = known or (None, None, None)
        events: dict[str, list] = {}
        for row in rows:
            if row.run_id is None:
                continue
            last = row.ts if last is None else max(last, row.ts)
            if row.source_path is None:
                closed = row.ts if closed is None else max(closed, row.ts)
            else:
                events.setdefault(row.source_path, []).append(row)
        if last is None:
            return
        for path, some in events.items():
            old = self._jobs.getValue((path,)) if self._jobs.containsKey((path,)) else None
            registered = self._registered or (old is not None and old[0]) or any(e.status == "queued" for e in some)
            best = max(some, key=lambda e: (e.status in self._ended, e.ts, e.seq))
            new = (registered, best.status in self._ended, best.ts, best.seq, best.status, best.pct, best.speed)
            if old is not None and tuple(old[1:4]) >= new[1:4]:
                new = (registered, *old[1:])
            if old is None or new != tuple(old):
                self._jobs.updateValue((path,), new)
            if registered and (old is None or new != tuple(old)):
                shown = old is not None and old[0]
                yield self._out(run, path, new[4], 1.0 if new[1] else new[5], "" if new[1] else new[6], new[2],
                                old[4] if shown else None, old[2] if shown else None)
        due = 1000 * (last + self._idle if closed is None else closed + self._grace)
        if timer is None or due < timer:
            if timer is not None:
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(due)
            timer = due
        if known is None or (closed, last, timer) != tuple(known):
            self._run.update((closed, last, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self._run.get()
        if known is None:
            return
        closed, last, _ = known
        due = 1000 * (last + self._idle if closed is None else closed + self._grace)
        if due > timerValues.getCurrentWatermarkInMs():
            self._handle.registerTimer(due)
            self._run.update((closed, last, due))
            return
        self._jobs.clear()
        self._run.clear()
        yield self._out(key[0], None, "released" if closed is not None else "idle", None, None, None, None, None)

    def close(self) -> None:
        pass
