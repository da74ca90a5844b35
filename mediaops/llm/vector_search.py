"""Exact top-k search: tiles of queries and shards, a matrix product each, and merging of the best lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import spread

#: Vectors of a packed shard, queries of a packed block.
SHARD_ROWS, BLOCK_ROWS = 2048, 1024
_EXACT = 2.0**53


def quantized(vector: Column) -> Column:
    """Components as ``floor(256 * x)``, exact in doubles."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))


def usable(vector: Column) -> Column:
    """Not null, and no component null or not finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def _packed(rows: int):
    """Rows of (id, vector) as blocks of vectors of one length."""
    def run(batches):
        for batch in batches:
            vectors = batch.column("vector")
            sizes = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for k in range(0, len(at), rows):
                    some = at[k:k + rows]
                    some = some[np.argsort(ids[some], kind="stable")]
                    matrix = flat[(ends[some] - size)[:, None] + np.arange(size)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(size)], pa.int32()), pa.array([ids[some].astype("<i8").tobytes()], pa.binary()),
                        pa.array([matrix.astype("<f8").tobytes()], pa.binary())], names=["size", "ids", "matrix"])
    return run


def _block(table: pa.Table) -> pa.Table:
    """The queries of a block and a length as one row."""
    size = table.column("size")[0].as_py()
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    matrix = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), size)
    return pa.table({"block": table.column("block")[:1], "size": pa.array([size], pa.int32()),
                     "query_ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), "queries": pa.array([matrix[order].astype("<f8").tobytes()], pa.binary())})


def _products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Inner products of rows. Doubles hold them exactly below 2**53; beyond, whole numbers of any size do."""
    largest = (np.abs(queries).max(initial=0) * np.abs(shard).max(initial=0)) * max(1, queries.shape[1])
    if largest < _EXACT:
        return queries @ shard.T
    return np.array([[int(x) for x in r] for r in queries], object).reshape(queries.shape) @ np.array([[int(x) for x in r] for r in shard], object).reshape(shard.shape).T


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per row of ``scores`` the columns of its ``k`` highest, equal ones by their ids, without the row's own id."""
    for row in range(len(scores)):
        line = scores[row]
        at = np.flatnonzero(ids != own[row])
        if len(at) > k:
            floor = np.partition(line[at], len(at) - k)[len(at) - k]
            at = at[line[at] >= floor]
        yield row, at[np.lexsort((ids[at], -line[at]))][:k]


def _tiles(k: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part = {c: batch.column(c)[i] for c in ("size", "ids", "matrix", "query_ids", "queries")}
                size = part["size"].as_py()
                ids, own = np.frombuffer(part["ids"].as_buffer(), "<i8"), np.frombuffer(part["query_ids"].as_buffer(), "<i8")
                shard = np.frombuffer(part["matrix"].as_buffer(), "<f8").reshape(len(ids), size)
                queries = np.frombuffer(part["queries"].as_buffer(), "<f8").reshape(len(own), size)
                scores = _products(queries, shard)
                rows, columns = [], []
                for row, at in best(scores, ids, own, k):
                    rows.append(np.full(len(at), row))
                    columns.append(at)
                row, at = np.concatenate(rows), np.concatenate(columns)
                yield pa.RecordBatch.from_arrays([
                    pa.array(own[row], pa.int64()), pa.array(ids[at], pa.int64()),
                    pa.array(np.clip(scores[row, at], -(2**63), 2**63 - 1).astype(np.int64) if scores.dtype == object else scores[row, at].astype(np.int64), pa.int64()),
                    pa.array(np.full(len(at), hash((i, int(ids[0]))) & 0xFF), pa.int32())], names=["query_id", "vec_id", "score", "tile"])
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` candidates of highest inner product.

    Both tables have (id, vector of whole numbers as doubles). A row of the query's own id is no candidate; equal scores go to
    the smaller id; fewer candidates give fewer rows. Only vectors of equal length are compared. Candidates are packed
    where they lie, queries into blocks, and both meet on a grid; each tile of both is one matrix product that hands on ``k`` rows per query, merged in
    two levels. Rows without id take no part, repeated queries of an id are one (of the greatest
    vector), repeated candidates are listed each. No candidates or no queries: no rows.
    """
    packed = "size int, ids binary, matrix binary"
    asked = queries.where("id is not null").groupBy("id").agg(F.max("vector").alias("vector"))
    count = max(1, -(-asked.count() // BLOCK_ROWS))
    blocks = (asked.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"), "size": F.size("vector")})
              .groupBy("block", "size").applyInArrow(_block, "block int, size int, query_ids binary, queries binary"))
    # A task of the grid has a block and a group of shards, so none reads all of either.
    groups = max(1, -(-spread(vectors) // count))
    place = F.pmod(F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    shards = vectors.where("id is not null").select("id", "vector").mapInArrow(_packed(SHARD_ROWS), packed).withColumn("group", place)
    grid = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    placed = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = (grid.join(placed, ["block", "group", "size"]).select("size", "ids", "matrix", "query_ids", "queries")
             .mapInArrow(_tiles(k), "query_id long, vec_id long, score long, tile int"))

    def merged(df: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    return merged(merged(found, "query_id", "tile"), "query_id").select("query_id", "rank", "vec_id", "score")
