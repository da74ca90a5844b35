"""Whitening of embeddings: projections on the leading principal components, scaled to unit variance."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spectrum import leading
from .work import keep

SCALE, OFFSET = 64.0, 1_000_000
#: Entries of this size or more do not fit the integers used here and count as not finite.
LIMIT = 2.0**50
#: Numbers of a travelling part of a sum.
_BLOCK = 8192
_SMALL = 1 << 15
ROWS = "id long, size int, x binary"


def _integers(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part, their lengths, their entries as integers without the offset)."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~(np.abs(flat) < LIMIT))])
    ends = np.cumsum(sizes)
    use = vectors.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0) & (bad[ends] == bad[ends - sizes])
    return np.flatnonzero(use), sizes[use], np.floor(SCALE * flat[np.repeat(use, sizes)]).astype(np.int64)


def _packed(batches):
    """Each vector as bytes, two for each entry if all fit and eight if not, so that equal vectors have equal bytes."""
    for batch in batches:
        rows, sizes, flat = _integers(batch.column("vector"))
        ends = np.cumsum(sizes)
        large = np.concatenate([[0], np.cumsum((flat < -_SMALL) | (flat >= _SMALL))])
        wide = large[ends] > large[ends - sizes]
        short, long = flat.astype("<i2"), flat.astype("<i8")
        x = [(long if w else short)[a:b].tobytes() for w, a, b in zip(wide.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(sizes, pa.int32()), pa.array(x, pa.binary())],
                                         names=["id", "size", "x"])


def _unpacked(column: pa.Array, size: int) -> np.ndarray:
    """Rows of integers."""
    raw = column.to_pylist()
    out = np.empty((len(raw), size), np.int64)
    for kind, width in (("<i2", 2), ("<i8", 8)):
        at = [i for i, x in enumerate(raw) if len(x) == width * size]
        if at:
            out[at] = np.frombuffer(b"".join([raw[i] for i in at]), kind).reshape(len(at), size)
    return out


class Centre:
    """The mean S/n of the integers as a whole part and a rest, so that differences to it lose no digits."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n = n
        self._whole = np.array([s // n for s in sums], np.int64)
        self._rest = np.array([s % n for s in sums], np.int64)

    def off(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in doubles."""
        return (x - self._whole) - self._rest / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Per row the sum of (n*x - S)**2, exact; as objects, None where it is beyond 64 bits."""
        y = x - self._whole
        near = self.n * y.astype(float) - self._rest
        total = (near * near).sum(axis=1)
        if not total.size or total.max() < 2.0**62:
            d = self.n * y - self._rest
            return (d * d).sum(axis=1)
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, self._rest.tolist(), strict=True)) for row in y.tolist()]
        return np.array([v if v < 1 << 63 else None for v in exact], object)


def _sums(size: int):
    """Per task the sums of all entries, in two halves of digits."""
    def run(batches):
        high, low = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            x = _unpacked(batch.column("x"), size)
            high += (x >> 28).sum(axis=0)
            low += (x & ((1 << 28) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(high), pa.array(low)], names=["at", "high", "low"])
    return run


def _moments(size: int, centre: Centre, project: np.ndarray | None = None, mean: np.ndarray | None = None):
    """Per task the sum of the centred (and projected) vectors and of their outer products, in parts of bounded size."""
    def run(batches):
        width = size if project is None else project.shape[1]
        first, second = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            y = centre.off(_unpacked(batch.column("x"), size))
            if project is not None:
                y = y @ project - mean
            first += y.sum(axis=0)
            second += y.T @ y
        flat = np.concatenate([first, second.ravel()])
        parts = range(0, len(flat), _BLOCK)
        yield pa.RecordBatch.from_arrays([
            pa.array([p // _BLOCK for p in parts], pa.int32()), pa.array([flat[p:p + _BLOCK].tobytes() for p in parts], pa.binary())],
            names=["block", "part"])
    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(p.as_buffer()) for p in table.column("part"))
    return pa.table({"block": table.column("block")[:1], "part": pa.array([total.tobytes()], pa.binary())})


def _total(fit: DataFrame, moments, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum, sum of outer products) over ``fit``: parts are added in two steps, so that no task reads more than a root of them.

    What reaches the driver is one matrix, as large as the square of a vector's length whatever the number of rows.
    """
    parts = fit.mapInArrow(moments, "block int, part binary")
    salts = max(1, math.isqrt(fit.rdd.getNumPartitions()))
    once = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("block", "salt").applyInArrow(_added, "block int, part binary")
    flat = np.zeros(width + width * width)
    for block, part in once.groupBy("block").applyInArrow(_added, "block int, part binary").toLocalIterator():
        flat[block * _BLOCK:(block + 1) * _BLOCK] = np.frombuffer(part)
    return flat[:width], flat[width:].reshape(width, width)


class Whitening:
    """A fitted whitening: the centre, the components as columns, their eigenvalues and measures of the fit."""

    def __init__(self, size: int, centre: Centre | None, values: np.ndarray, vectors: np.ndarray, trace: float) -> None:
        self.size, self.centre, self.values, self.vectors = size, centre, values, vectors
        self.explained = values / trace if len(values) else values
        self.scaled = vectors / np.sqrt(values) if len(values) else vectors
        self.identity_error = 0.0


def fit(vectors: DataFrame, components: int = 16) -> Whitening:
    """Fit to the distinct vectors of ``vectors`` (id, vector).

    Entries c become floor(64*c)+1000000. Vectors that are null or empty or hold an entry that is null, not finite, or 2**50 or
    larger take no part. All vectors of a fit have one length: that of most distinct vectors (the longer of two), others take no part. Components
    without variance, as far as doubles can tell, are left out; so one distinct vector, or no row, gives none.
    """
    rows = vectors.select("id", "vector").mapInArrow(_packed, ROWS)
    distinct = keep(rows.select("size", "x").distinct(), "fit")
    common = distinct.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not common:
        return Whitening(0, None, np.zeros(0), np.zeros((0, 0)), 0.0)
    size, n = common[0]
    chosen = distinct.where(F.col("size") == size).select("x")
    halves = chosen.mapInArrow(_sums(size), "at int, high long, low long").groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    sums = [0] * size
    for at, high, low in halves.collect():
        sums[at] = (high << 28) + low
    centre = Centre(n, sums)
    first, second = _total(chosen, _moments(size, centre), size)
    covariance = (second + second.T) / (2 * n)
    found = Whitening(size, centre, *leading(covariance, components), float(np.trace(covariance)))
    if width := len(found.values):
        _, outer = _total(chosen, _moments(size, centre, found.scaled, (first / n) @ found.scaled), width)
        found.identity_error = float(np.abs(outer / n - np.eye(width)).max())
    return found


def whiten(vectors: DataFrame, components: int = 16, *, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable row and each component.

    ``n`` distinct vectors were fitted, ``deviation`` is the sum of (n*x-S)**2 over the dimensions (null beyond 64 bits), ``whitened`` the
    projection of x-S/n on the component over the root of its eigenvalue, ``explained`` the eigenvalue's share of all
    variance, ``identity_error`` the largest entry of the whitened covariance minus the identity. See ``fit`` for which rows and
    components there are. Repeated rows each give their rows, also those with a null id; other columns play no part.
    """
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector"))
    model = fit(rows, components)

    def run(batches):
        count = len(model.values)
        for batch in batches:
            at, sizes, flat = _integers(batch.column("vector"))
            use = sizes == model.size
            if not count or not use.any():
                continue
            x = flat[np.repeat(use, sizes)].reshape(-1, model.size)
            n = len(x) * count
            each = lambda values: np.tile(values, len(x))
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(np.repeat(at[use], count))), pa.array(each(np.arange(1, count + 1)), pa.int32()),
                pa.array(np.full(n, model.centre.n), pa.int64()), pa.array(np.repeat(model.centre.deviations(x), count), pa.int64()),
                pa.array((model.centre.off(x) @ model.scaled).ravel()), pa.array(each(model.explained)), pa.array(np.full(n, model.identity_error))],
                names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"`{id_column}` long, component int, n long, deviation long, whitened double, explained double, identity_error double")
