"""Rows on their way to keyed state and back, packed by part.

Keyed state takes rows into Python value by value, which took most of a pass. Here the rows of a part travel as one value, an Arrow table as bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: The most rows, and bytes, that a task packs or unpacks at once.
ROWS, BYTES = 1 << 17, 32 << 20
#: The rows of a batch handed back to Spark.
BATCH = 10_000


def dump(rows: pa.Table, compression: str | None = None) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=compression, use_threads=False)) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def load(stored: bytes | pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(stored, options=pa.ipc.IpcReadOptions(use_threads=False)).read_all()


def joined(tables: list[pa.Table]) -> pa.Table:
    """The rows of all tables in one chunk. The last table tells a column's type; a table without the column has NULL."""
    if any(not t.schema.equals(tables[-1].schema) for t in tables):
        kinds = {f.name: f.type for t in tables for f in t.schema}
        tables = [pa.table({n: t[n].cast(k) if n in t.column_names else pa.nulls(len(t), k) for n, k in kinds.items()}) for t in tables]
    return pa.concat_tables(tables).combine_chunks()


def distinct(rows: pa.Table) -> pa.Table:
    return rows.group_by(rows.column_names, use_threads=False).aggregate([])


def _gathered(tables: Iterable[pa.Table]) -> Iterator[pa.Table]:
    some, rows, size = [], 0, 0
    for t in tables:
        some.append(t)
        rows, size = rows + len(t), size + t.nbytes
        if rows >= ROWS or size >= BYTES:
            yield joined(some)
            some, rows, size = [], 0, 0
    if some:
        yield joined(some)


def _pack(once: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(pa.Table.from_batches([b]) for b in batches if len(b)):
            rows = distinct(rows) if once else rows
            rows = rows.take(pc.sort_indices(rows["_part"])).combine_chunks()
            parts = rows["_part"].to_numpy()
            starts = np.flatnonzero(np.diff(parts, prepend=-1))
            sizes = np.diff(starts, append=len(parts))
            rest = rows.drop_columns("_part")
            pieces = [dump(rest.slice(start, n)) for start, n in zip(starts, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(parts[starts]), pa.array(pieces, pa.binary())], ["_part", "_rows"])
    return run


def pack(rows: DataFrame, once: bool = False) -> DataFrame:
    """The rows of every ``_part`` (not negative) as few values: ``_part`` and ``_rows``. With ``once``, equal rows packed together are one."""
    return rows.repartition("_part").mapInArrow(_pack(once), "_part int, _rows binary")


def _unpack(schema: StructType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(load(value.as_buffer()) for b in batches for value in b.column("_rows")):
            columns = [rows[f.name] if f.name in rows.column_names else pa.nulls(len(rows), to_arrow_type(f.dataType)) for f in schema]
            yield from pa.table(columns, schema.names).to_batches(BATCH)
    return run


def unpack(rows: DataFrame, schema: StructType) -> DataFrame:
    """The rows that ``_rows`` holds, with the columns of ``schema``; a column that they lack is NULL."""
    return rows.select("_rows").mapInArrow(_unpack(schema), schema)
