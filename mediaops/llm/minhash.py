"""MinHash near-dedup: documents that share most of their word shingles, found by bands of hash minima."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from .hashing import mix, shingles, slices, strings
from .stars import star_components
from .work import keep

#: Bands and the minima of each. Sets of similarity 0.8 share none of the bands once in twenty million.
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
#: Bytes of two signatures that must agree: at a similarity of 0.8 fewer do once in ten billion.
AGREE = 70
#: Bytes of text that a task works on at a time.
SLICE = 1 << 20
#: Rounds in which nodes are compared with hubs before all that is left is compared in tiles of so many nodes.
ROUNDS, TILE = 1, 256

_DRAWN = np.random.Generator(np.random.PCG64(20240613)).integers(0, 2**63, (2, MINIMA), dtype=np.uint64)
_FACTORS, _SHIFTS = 2 * _DRAWN[0] + np.uint64(1), 2 * _DRAWN[1]
_MIXED = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Per set, none of them empty, the least of ``MINIMA`` universal hashes (a*x + b, upper 32 bits) over its elements."""
    x = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out, hashed = np.empty((len(sets), MINIMA), np.uint64), np.empty_like(x)
    for k in range(MINIMA):
        np.multiply(x, _FACTORS[k], out=hashed)
        hashed += _SHIFTS[k]
        out[:, k] = np.minimum.reduceat(hashed, starts)
    return out >> np.uint64(32)


def buckets(least: np.ndarray) -> np.ndarray:
    """Per row a key for each band: equal where the band's minima are."""
    bands = least.reshape(-1, BANDS, ROWS)
    return mix((bands * _MIXED).sum(axis=2, dtype=np.uint64) + mix(np.arange(BANDS, dtype=np.uint64)))


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each element's hash, about eight bits for each element; a larger map folds to a smaller one by halves."""
    size = max(64, 1 << (len(s) - 1).bit_length())
    bits = np.zeros(8 * size, np.uint8)
    bits[((s >> np.uint64(20)) & np.uint64(8 * size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def folded(maps: np.ndarray, size: int) -> np.ndarray:
    """Rows of bitmaps as rows of ``size`` bytes, no more than they have."""
    while maps.shape[1] > size:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def may_be_similar(n: int, bits: np.ndarray, others: np.ndarray, maps: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes ``others`` with bitmaps ``maps`` can have the similarity to one of size ``n`` with ``bits``, all maps of one size.

    A bit that one side alone has stands for an element that the other lacks, which bounds the overlap from above.
    """
    own = np.bitwise_count(bits & ~maps).sum(axis=1, dtype=np.int64)
    theirs = np.bitwise_count(maps & ~bits).sum(axis=1, dtype=np.int64)
    most = np.minimum(n - own, others - theirs)
    return 100 * most >= percent * (n + others - most)


def set_hash(s: np.ndarray) -> int:
    """A 64-bit hash of a whole set."""
    return int(mix(np.array([np.add.reduce(mix(s + np.uint64(0x2545F4914F6CDD1D)))]) + np.uint64(len(s)))[0])


def _profiles(width: int):
    """Per document its set's size, hash and bitmap, the keys of its bands, and a byte of each minimum."""
    def run(batches):
        for batch in slices(batches, "text", SLICE):
            sets = list(shingles(*strings(batch.column("text")), width))
            some = [i for i, s in enumerate(sets) if len(s)]
            keys, marks = [None] * len(sets), [None] * len(sets)
            if some:
                least = minima([sets[i] for i in some])
                for i, key, mark in zip(some, buckets(least).view(np.int64), (least & np.uint64(255)).astype(np.uint8), strict=True):
                    keys[i], marks[i] = key, mark.tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("print"), pa.array(np.array([set_hash(s) for s in sets], np.uint64).view(np.int64)),
                pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary()),
                pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary())], names=["id", "print", "node", "n", "buckets", "marks", "bits"])
    return run


def _marks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), MINIMA)


def _alike(batches):
    """Keep the pairs whose signatures agree enough."""
    for batch in batches:
        near = (_marks(batch.column("marks_a")) == _marks(batch.column("marks_b"))).sum(axis=1) >= AGREE
        yield batch.select(["a", "b"]).filter(pa.array(near))


class _Tile:
    """The nodes of a packed tile."""

    def __init__(self, rows: pa.StructArray) -> None:
        self.node, self.part, self.n = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("node", "part", "n"))
        self.marks, self.bits = _marks(rows.field("marks")), rows.field("bits").to_pylist()
        self._sizes = np.array([len(x) for x in self.bits])
        self._maps: dict[tuple[int, int], np.ndarray] = {}

    def close_to(self, n: int, bits: bytes, at: np.ndarray, percent: int) -> np.ndarray:
        """Those of the rows ``at`` that can be similar to a set of this size and bitmap."""
        out, own = [], np.frombuffer(bits, np.uint8)[None, :]
        for size in np.unique(self._sizes[at]).tolist():
            some, least = at[self._sizes[at] == size], min(size, len(bits))
            if (size, least) not in self._maps:
                rows = np.flatnonzero(self._sizes == size)
                place = np.zeros(len(self._sizes), np.int64)
                place[rows] = np.arange(len(rows))
                self._maps[size, least] = folded(np.frombuffer(b"".join([self.bits[i] for i in rows]), np.uint8).reshape(len(rows), size), least), place
            maps, place = self._maps[size, least]
            out.append(some[may_be_similar(n, folded(own, least)[0], self.n[some], maps[place[some]], percent)])
        return np.concatenate(out) if out else at[:0]


def forest(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The places of links ``a``-``b`` that, taken in ``order``, connect what those before them did not."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, left, out = list(range(len(names))), len(names) - 1, []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, x, y in zip(order.tolist(), ends[:len(a)][order].tolist(), ends[len(a):][order].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[x], left = y, left - 1
            out.append(i)
            if not left:
                break
    return np.array(out, np.int64)


def _alike_in_tiles(percent: int, best: bool):
    """Pairs of two packed tiles: of different parts, and of sizes, signatures and bitmaps that allow the similarity; all, or the ``best`` that would connect the tiles' parts."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (_Tile(batch.column(f"rows_{x}")[i].values) for x in "ab")
                found = []
                for k in range(len(a.node)):
                    at = np.flatnonzero((b.part != a.part[k]) & (100 * np.minimum(b.n, a.n[k]) >= percent * np.maximum(b.n, a.n[k])))
                    at = at[(b.marks[at] == a.marks[k]).sum(axis=1) >= AGREE]
                    if len(at) and len(at := b.close_to(int(a.n[k]), a.bits[k], at, percent)):
                        own = [np.full(len(at), x[k]) for x in (a.node, a.part)]
                        found.append([*own, b.node[at], b.part[at], (b.marks[at] == a.marks[k]).sum(axis=1)])
                if found:
                    node_a, part_a, node_b, part_b, agreed = (np.concatenate(x) for x in zip(*found, strict=True))
                    if best:
                        first = forest(part_a, part_b, np.lexsort((node_b, node_a, -agreed)))
                        node_a, node_b = node_a[first], node_b[first]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node_a, node_b), pa.int64()), pa.array(np.maximum(node_a, node_b), pa.int64())], names=["a", "b"])
    return run


def _similar(width: int, percent: int):
    """Keep the pairs whose full sets overlap enough."""
    def run(batches):
        for batch in slices(batches, "text_a", 1 << 18):
            sides = [shingles(*strings(batch.column(c)), width) for c in ("text_a", "text_b")]
            near = []
            for x, y in zip(*sides, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))
    return run


def _same_node(width: int):
    """Keep the rows whose text has the set that the node stands for."""
    def run(batches):
        for batch in slices(batches, "text", SLICE):
            node = np.array([set_hash(s) for s in shingles(*strings(batch.column("text")), width)], np.uint64).view(np.int64)
            yield batch.select(["node", "text"]).filter(pa.array(node == batch.column("node").to_numpy()))
    return run


def _row_key(named: Column, print_: Column) -> Column:
    return F.coalesce(named, print_)


def minhash_classes(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row: which documents are joined by links of Jaccard similarity.

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of ``width``-word shingles (64-bit hashes); the component is
    the smallest id reachable, and that document is kept. In this order:

    * documents with equal sets are one node, named by a 64-bit hash of the set;
    * ``MINIMA`` minima of universal hashes stand for a set; nodes with equal minima in a whole band meet in a bucket;
    * each node is compared with two of the hubs its buckets draw, which connects most of a group of near copies;
    * in buckets that still hold more than one connected part, the largest part and the rest are compared in tiles of bounded size, where bitmaps
      of the sets bound the overlap from above, so that of a large group of copies just below the limit hardly a pair goes on; the likeliest
      pairs that would connect a tile's parts go first, no more than it has parts, and all pairs only between parts that these left apart;
    * a pair goes on only if the signatures agree, and is a link only if the full sets overlap enough;
    * components come from alternating large-star and small-star.

    No bucket is expanded into its pairs and no partner is capped. Bands and agreement are for ``percent`` of 80 or more.
    A null or wordless text has no shingles and no links (its component is its own id). Rows without id take part; their component is the smallest id linked,
    or null, and they are kept if it is null. Repeated rows each give a row. An empty table gives no rows.
    """
    docs = documents.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")).withColumn(
        "print", F.xxhash64("text"))
    spark = docs.sparkSession
    profiles = keep(docs.mapInArrow(_profiles(width), "id long, print long, node long, n long, buckets array<long>, marks binary, bits binary"), "profiles")
    sized = profiles.select("id", "node", "n")
    nodes = keep(profiles.where("n > 0").groupBy("node").agg(
        F.min("id").alias("id"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "print")).alias("row"),
        *[F.first(c).alias(c) for c in ("n", "buckets", "marks", "bits")])
        .select("node", "id", _row_key(F.col("row.id"), F.col("row.print")).alias("key"), F.col("row.print").alias("print"), "n", "buckets", "marks", "bits"), "nodes")

    posted = nodes.select(F.explode("buckets").alias("bucket"), "node")
    meetings = posted.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket")
    met = keep(lookup_join(posted, meetings, ["bucket"], spread_by=["node"], how="inner"), "met")
    wanted = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "key", "print")
    texts = keep(docs.withColumn("key", _row_key(F.col("id"), F.col("print"))).join(wanted, ["key", "print"]).select("node", "text")
                 .mapInArrow(_same_node(width), "node long, text string").dropDuplicates(["node"]), "texts")
    links = spark.createDataFrame([], "a long, b long")
    part_of = spark.createDataFrame([], "node long, component long")

    def side(x: str, *columns: str) -> DataFrame:
        return nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])

    def linked(pairs: DataFrame, purpose: str) -> DataFrame:
        sized_pairs = lookup_join(lookup_join(pairs, side("a", "n", "marks"), ["a"], spread_by=["b"], how="inner"), side("b", "n", "marks"), ["b"], spread_by=["a"], how="inner")
        alike = keep(sized_pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
                     .select("a", "b", "marks_a", "marks_b").mapInArrow(_alike, "a long, b long"), f"{purpose}-pairs")
        a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        both = alike.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
        return keep(both.mapInArrow(_similar(width, percent), "a long, b long"), f"{purpose}-links")

    def with_part(rows: DataFrame, x: str) -> DataFrame:
        found = rows.join(part_of.select(F.col("node").alias(x), F.col("component").alias("part")), x, "left")
        return found.withColumn("part", F.coalesce("part", x))

    for turn in range(ROUNDS):
        # A hub is drawn for each bucket whose nodes are not connected: the least node after a reversible scrambling.
        scramble = F.xxhash64("bucket", F.lit(turn))
        open_ = with_part(met, "node")
        drawn = (open_.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min(F.col("node").bitwiseXOR(scramble)).alias("hub"))
                 .where("low < high").select("bucket", F.col("hub").bitwiseXOR(scramble).alias("hub")))
        offers = (lookup_join(open_.withColumnRenamed("part", "own"), drawn, ["bucket"], spread_by=["node"], how="inner").where("hub <> node")
                  .groupBy("node", "own", "hub").agg(F.count("*").alias("times")))
        offers = with_part(offers, "hub").where("part <> own")
        chosen = offers.groupBy("node").agg(F.max(F.struct("times", "hub")).alias("most"), F.min("hub").alias("least"))
        pairs = chosen.select("node", F.explode(F.array("most.hub", "least")).alias("hub")).select(
            F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        links = links.unionByName(linked(pairs, "hub"))
        part_of = star_components(links)

    # Parts need to be connected once: in each tile the likeliest pairs that would do so go first, and all pairs only where they did not.
    for best in (True, False):
        links = links.unionByName(linked(_tile_pairs(with_part(met, "node"), nodes, percent, best).distinct(), "tile"))
        if best:
            part_of = star_components(links)
    final = nodes.select("node", "id").join(star_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = final.groupBy("component").agg(F.min("id").alias("component_id"))
    found = final.join(smallest, "component").select("node", "component_id")
    out = lookup_join(sized.withColumn("node", F.when(F.col("n") > 0, F.col("node"))), found, ["node"], spread_by=["id"])
    return out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))).select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _tile_pairs(rows: DataFrame, nodes: DataFrame, percent: int, best: bool) -> DataFrame:
    """(a, b) of different parts that meet in a bucket and may be similar, from ``rows`` (bucket, node, part); or the ``best`` that would connect the parts of a tile.

    In each bucket the largest part is ``main``. The rest is compared with itself and with the main part, in tiles of about
    ``TILE`` nodes each, so a task never holds a whole bucket and no pair leaves a tile untested.
    """
    counted = rows.groupBy("bucket", "part").agg(F.count("*").alias("members"))
    largest = (counted.groupBy("bucket").agg(F.max(F.struct("members", "part")).alias("main"), F.sum("members").alias("all"), F.count("*").alias("parts"))
               .where("parts > 1").select("bucket", F.col("main.part").alias("main"), F.ceil(F.col("main.members") / TILE).cast("int").alias("main_tiles"),
                                          F.ceil((F.col("all") - F.col("main.members")) / TILE).cast("int").alias("rest_tiles")))
    placed = lookup_join(rows, largest, ["bucket"], spread_by=["node"], how="inner").withColumn("in_main", F.col("part") == F.col("main"))
    tiles = F.when(F.col("in_main"), F.col("main_tiles")).otherwise(F.col("rest_tiles"))
    members = placed.withColumn("tile", F.pmod(F.xxhash64("node"), tiles).cast("int")).join(nodes.select("node", "n", "marks", "bits"), "node")
    packed = keep(members.groupBy("bucket", "in_main", "tile", "main_tiles", "rest_tiles").agg(F.collect_list(F.struct("node", "part", "n", "marks", "bits")).alias("rows")), "tiles")
    rest, main = packed.where("not in_main"), packed.where("in_main")

    def against(tile: str, count: str, first: Column | None = None) -> Column:
        return F.explode(F.sequence(F.lit(0) if first is None else first, F.col(count) - 1)).alias(tile)

    left = rest.select("bucket", F.col("tile").alias("i"), against("j", "rest_tiles", F.col("tile")), F.lit(False).alias("in_main"), F.col("rows").alias("rows_a")).unionByName(
        rest.select("bucket", F.col("tile").alias("i"), against("j", "main_tiles"), F.lit(True).alias("in_main"), F.col("rows").alias("rows_a")))
    right = rest.select("bucket", F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("i"), F.col("tile").alias("j"), "in_main", F.col("rows").alias("rows_b")).unionByName(
        main.select("bucket", against("i", "rest_tiles"), F.col("tile").alias("j"), "in_main", F.col("rows").alias("rows_b")))
    return left.join(right, ["bucket", "i", "j", "in_main"]).select("rows_a", "rows_b").mapInArrow(_alike_in_tiles(percent, best), "a long, b long")
