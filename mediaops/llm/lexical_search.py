"""Ranked lexical search: the documents that suit each item best, by trees of documents and branch-and-bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from .document_tree import DocumentTree
from .hashing import Spans, slices, strings, words
from .work import keep, spread

#: Bits of the filter of the items' terms; a fixed size whatever the number of items.
FILTER_BITS = 1 << 22
#: Items of a block; documents and entries of a pack (a larger document is a pack of its own).
BLOCK_ITEMS, PACK_DOCUMENTS, PACK_ENTRIES = 256, 10_000, 1 << 20

_BETWEEN = np.zeros(256, bool)
_BETWEEN[:128] = [not chr(c).isalnum() for c in range(128)]


def _terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all terms of a batch's texts, and each row's first term (with an end)."""
    data, offsets = strings(batch.column("text"))
    start, end, rows = words(data, offsets, _BETWEEN)
    return Spans(data, lower=True).hash(start, end), rows


def _counted(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of each different term of a row."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])])) if len(rows) else order
    return rows[first], hashes[first], np.diff(np.append(first, len(rows)))


def _lists(rows: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def _vectors(filled: np.ndarray | None = None):
    """Per text with a term: the number of its terms, and those that pass the filter with their counts."""
    def run(batches):
        for batch in slices(batches, "text"):
            hashes, rows = _terms(batch)
            sizes = np.diff(rows)
            row = np.repeat(np.arange(len(sizes)), sizes)
            if filled is not None:
                bit = hashes & np.uint64(FILTER_BITS - 1)
                hit = (filled[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
                hashes, row = hashes[hit], row[hit]
            row, term, count = _counted(hashes, row)
            out = pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(sizes, pa.int64()), _lists(row, term.view(np.int64), len(sizes), pa.int64()),
                _lists(row, count, len(sizes), pa.int32())], names=["id", "n", "terms", "counts"])
            yield out.filter(pa.array(sizes > 0))
    return run


VECTOR_TYPES = "id long, n long, terms array<long>, counts array<int>"


def _term_filter(items: DataFrame) -> np.ndarray:
    """A bit for each hash of a term of any item, as words of 64 bits: what the driver sees is at most ``FILTER_BITS`` bits."""
    bit = F.col("term").bitwiseAND(F.lit(FILTER_BITS - 1))
    words_ = (items.select(F.explode("terms").alias("term")).groupBy(F.shiftright(bit, 6).cast("int").alias("at"))
              .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for at, bits in words_.toLocalIterator():
        out[at] = bits
    return out.view(np.uint64)


def _narrow(values: np.ndarray) -> tuple[bytes, str]:
    """Counting numbers in as few bytes as the largest needs."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return values.astype(kind).tobytes(), kind.str


def _packs(batches):
    """Vectors as packs of documents; terms as places in a list of the pack's own."""
    for batch in batches:
        sizes = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
        terms, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "counts"))
        ids, n, missing = batch.column("id"), batch.column("n").to_numpy(), batch.column("id").is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        ends = np.cumsum(sizes, dtype=np.int64)
        part = (np.arange(len(sizes)) // PACK_DOCUMENTS) + (ends - sizes) // PACK_ENTRIES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            x, y = int(ends[a] - sizes[a]) if b > a else 0, int(ends[b - 1]) if b > a else 0
            own, code = np.unique(terms[x:y], return_inverse=True)
            (codes, code_kind), (tf, tf_kind) = _narrow(code), _narrow(counts[x:y])
            values = [ids[a:b].astype("<i8").tobytes(), missing[a:b].tobytes(), n[a:b].astype("<i8").tobytes(), sizes[a:b].astype("<i8").tobytes(),
                      own.astype("<i8").tobytes(), codes, tf]
            yield pa.RecordBatch.from_arrays([*[pa.array([v], pa.binary()) for v in values], pa.array([code_kind]), pa.array([tf_kind])],
                                             names=[c.split()[0] for c in PACK_TYPES.split(", ")])


PACK_TYPES = "ids binary, missing binary, lengths binary, sizes binary, own binary, codes binary, tf binary, code_kind string, tf_kind string"


def _block(table: pa.Table) -> pa.Table:
    """The rows (item, term, df, weight) of a block of items as one row."""
    item, term, df, weight = (table.column(c).to_numpy() for c in ("item", "term", "df", "weight"))
    order = np.lexsort((term, item))
    values = [item[order].astype("<i8"), term[order].astype("<i8"), df[order].astype("<i8"), weight[order].astype("<i8")]
    return pa.table({"block": table.column("block")[:1], **{c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(("items", "terms", "dfs", "weights"), values, strict=True)}})


class _Items:
    """A block of items: terms numbered by falling document frequency, and each item's terms and weights."""

    def __init__(self, row) -> None:
        items, terms, dfs, weights = (np.frombuffer(row[c], "<i8") for c in ("items", "terms", "dfs", "weights"))
        self.terms, first, code = np.unique(terms, return_index=True, return_inverse=True)
        order = np.lexsort((self.terms, -dfs[first]))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        begins = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
        self.items = items[begins].tolist()
        self.queries = [(self.rank[code[a:b]], weights[a:b]) for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(items)], strict=True)]
        self.floors = [0] * len(self.items)


def _search(k: int, documents: int, all_terms: int):
    def run(batches):
        name, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["block"] != name:
                    name, block = row["block"], _Items(row)
                sizes = np.frombuffer(row["sizes"], "<i8")
                own = np.frombuffer(row["own"], "<i8")
                at = np.minimum(np.searchsorted(block.terms, own), len(block.terms) - 1)
                ranks = np.where(block.terms[at] == own, block.rank[at], -1)[np.frombuffer(row["codes"], row["code_kind"])]
                tf, doc = np.frombuffer(row["tf"], row["tf_kind"]).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
                entry = np.flatnonzero(ranks >= 0)
                entry = entry[np.lexsort((ranks[entry], doc[entry]))]
                some, count = np.unique(doc[entry], return_counts=True)
                if not len(some):
                    continue
                lengths, ids, missing = (np.frombuffer(row[c], t)[some] for c, t in (("lengths", "<i8"), ("ids", "<i8"), ("missing", bool)))
                tree = DocumentTree(np.concatenate([[0], np.cumsum(count)]), ranks[entry], tf[entry], 75 + (25 * lengths * documents) // all_terms)
                ids, missing = ids[tree.order], missing[tree.order]
                by_id = np.empty(len(ids), np.int64)
                by_id[np.lexsort((ids, missing))] = np.arange(len(ids))
                item, place, score = [], [], []
                for j, (query, weights) in enumerate(block.queries):
                    places, scores = tree.best(query, weights, k, block.floors[j], by_id)
                    if len(places) == k:
                        # Documents below these are not among the item's best, wherever they are.
                        block.floors[j] = max(block.floors[j], int(scores.min()))
                    item.append(np.full(len(places), block.items[j]))
                    place.append(places)
                    score.append(scores)
                place = np.concatenate(place)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(item), pa.int64()), pa.array(ids[place], pa.int64(), mask=missing[place]),
                    pa.array(np.concatenate(score), pa.int64()), pa.array(np.full(len(place), row["part"]), pa.int32())],
                    names=["item", "id", "score", "part"])
    return run


def lexical_top_k(documents: DataFrame, items: DataFrame, k: int = 20, *, id_column: str = "doc_id", text_column: str = "text",
                  item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``k`` documents of the highest scores above 0, equal ones by their ids.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case, compared by 64-bit hashes. The score is in integers, with
    weights from document frequencies and lengths relative to the mean; both count every document with a term. In this order:

    * documents are cut down to vectors of the terms of any item (and of what else passes a filter of fixed size);
    * items in blocks meet documents in packs on a grid of (block, part), so that no task reads all of either;
    * a pack's documents form a trie of their vectors, ordered by frequency. The largest tf and the least m below a
      node bound what any document there scores; depth-first branch-and-bound visits a node only if that may reach the k-th score found;
    * the best of each part and then of all parts are merged.

    Null, empty and termless texts rank nowhere and count nowhere; documents without id are listed after others of their score, repeated
    rows each. Items of one id are one, the greatest text; a null id is an id. Items or documents without terms, or no rows, give none.
    """
    docs = documents.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    asked = keep(items.select(F.col(f"`{item_column}`").cast("long").alias("id"), F.col(f"`{item_text}`").cast("string").alias("text"))
                 .groupBy("id").agg(F.max("text").alias("text")).mapInArrow(_vectors(), VECTOR_TYPES)
                 .withColumn("item", F.monotonically_increasing_id()), "items")
    filled = docs.sparkSession.sparkContext.broadcast(_term_filter(asked))
    vectors = keep(docs.mapInArrow(lambda batches: _vectors(filled.value)(batches), VECTOR_TYPES), "vectors")
    n_documents, all_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    frequencies = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    blocks = max(1, -(-asked.count() // BLOCK_ITEMS))
    parts = max(1, -(-spread(docs) // blocks))
    posted = asked.select("item", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"),
                          F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("item", "block", F.col("t.terms").alias("term"), F.col("t.counts").alias("times"))
    weight = F.floor(F.lit(1000.0) * F.log((2.0 * F.lit(n_documents) + 2.0) / (2.0 * F.col("df") + 1.0)))
    weighed = lookup_join(posted, frequencies, ["term"], spread_by=["item"], how="inner").select("block", "item", "term", "df", (F.col("times") * weight).alias("weight"))
    packed = weighed.groupBy("block").applyInArrow(_block, "block int, items binary, terms binary, dfs binary, weights binary")

    place = F.pmod(F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    tiles = vectors.mapInArrow(_packs, PACK_TYPES).withColumn("part", place).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    grid = tiles.join(packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), ["block", "part"])
    found = grid.mapInArrow(_search(k, n_documents, max(1, all_terms)), "item long, id long, score long, part int")

    def merged(df: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    best = merged(merged(found, "item", "part"), "item")
    named = best.join(asked.select("item", F.col("id").alias("item_id")), "item")
    return named.select(F.col("item_id").alias(item_column), "rank", F.col("id").alias(id_column), "score")
