"""N-gram Jaccard join: which documents share most of their word shingles."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .hashing import mix, shingles, slices, strings
from .work import keep

#: Cells of the frequency sketch and bytes of each part it travels in; fixed sizes whatever the corpus.
SKETCH_CELLS = 1 << 21
_BLOCK = 1 << 16
#: 64-bit words of a document's bitmap signature.
SIGNATURE_WORDS = 8
#: 64-bit words of the wider bitmap that pairs must pass before their texts are fetched.
WIDE_WORDS = 64
#: Rounds in which nodes are compared with a few hubs before all that is left is joined.
ROUNDS = 2


def _bands(percent: int) -> np.ndarray:
    """First set size of each band. Sets of the wanted similarity lie in one band or in neighbours."""
    first = [1]
    while first[-1] < 1 << 40:
        first.append(first[-1] * 100 // percent + 1)
    return np.array(first, np.int64)


def _cell(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(SKETCH_CELLS - 1)).astype(np.int64)


def _set_hash(s: np.ndarray) -> int:
    """A 64-bit hash of a whole set."""
    return int(mix(np.array([np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))]) ^ np.uint64(len(s)))[0])


def _profiles(width: int, percent: int):
    """Per document its set's size, hash and signature; per task a sketch of how common shingles are."""
    def run(batches):
        sketch, bands = np.zeros(SKETCH_CELLS, np.uint8), _bands(percent)
        for batch in slices(batches, "text"):
            data, offsets = strings(batch.column("text"))
            size, node, signatures = [], [], []
            for s in shingles(data, offsets, width):
                size.append(len(s))
                node.append(_set_hash(s))
                bits = np.zeros(SIGNATURE_WORDS * 64, np.uint8)
                bits[(s >> np.uint64(40)).astype(np.int64) % len(bits)] = 1
                signatures.append(np.packbits(bits).view(np.int64))
                # A cell that comes twice is counted once, as the sum is made before it is put back.
                cells = _cell(s)
                sketch[cells] += sketch[cells] < 255
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column("id").cast(pa.int64()), pa.array(np.array(node, np.uint64).view(np.int64)),
                pa.array(size, pa.int64()), pa.array(np.searchsorted(bands, size, "right"), pa.int32()),
                pa.array(signatures, pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=PROFILE)
        blocks = [(i, x) for i, x in enumerate(sketch.reshape(-1, _BLOCK)) if x.any()]
        if blocks:
            n = len(blocks)
            yield pa.RecordBatch.from_arrays([
                pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()),
                pa.nulls(n, pa.list_(pa.int64())), pa.array([i for i, _ in blocks], pa.int32()),
                pa.array([x.tobytes() for _, x in blocks], pa.binary())], names=PROFILE)
    return run


PROFILE = ["id", "node", "n", "band", "signature", "block", "counts"]
PROFILE_TYPES = "id long, node long, n long, band int, signature array<long>, block int, counts binary"


def _add_counts(kind):
    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(_BLOCK, np.uint64)
        for value in table.column("counts"):
            total += np.frombuffer(value.as_buffer(), kind)
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})
    return run


def _commonness(blocks: DataFrame) -> np.ndarray:
    """The sketches of all tasks added up, in two steps so that no task reads more than a root of them.

    What reaches the driver is the sketch itself, whose size is fixed; it comes as logarithms.
    """
    salts = max(1, math.isqrt(blocks.rdd.getNumPartitions()))
    salted = blocks.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    once = salted.groupBy("block", "salt").applyInArrow(_add_counts(np.uint8), "block int, counts binary")
    total = once.groupBy("block").applyInArrow(_add_counts(np.uint64), "block int, counts binary")
    rank = np.zeros(SKETCH_CELLS, np.uint8)
    for block, counts in total.toLocalIterator():
        rank[block * _BLOCK:(block + 1) * _BLOCK] = np.round(4 * np.log2(np.frombuffer(counts, np.uint64) + 1.0))
    return rank


def _prefixes(width: int, percent: int, common):
    """(token, node) for the rarest shingles of each set: sets of the wanted similarity share one of these."""
    def run(batches):
        rank = common.value
        for batch in slices(batches, "text"):
            data, offsets = strings(batch.column("text"))
            nodes, tokens, counts = [], [], []
            for s in shingles(data, offsets, width):
                n = len(s)
                length = n - -(-percent * n // 100) + 1 if n else 0
                nodes.append(_set_hash(s))
                counts.append(length)
                # The set is in order, so shingles of one rank stay in order.
                tokens.append(s[np.argsort(rank[_cell(s)], kind="stable")[:length]] if length < n else s)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(tokens).view(np.int64)),
                pa.array(np.repeat(np.array(nodes, np.uint64), counts).view(np.int64))], names=["token", "node"])
    return run


def _similar(width: int, percent: int):
    """Keep the pairs whose sorted arrays really overlap enough."""
    def run(batches):
        for batch in slices(batches, "text_a", 1 << 18):
            x_all = shingles(*strings(batch.column("text_a")), width)
            y_all = shingles(*strings(batch.column("text_b")), width)
            near = []
            for x, y in zip(x_all, y_all, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))
    return run


def _possible(percent: int) -> Column:
    """Sizes and bitmap signatures of ``n_a, signature_a, n_b, signature_b`` allow the similarity.

    Every bit that only one side has set stands for an element the other side lacks, which
    bounds the overlap from above.
    """
    only_a = sum(F.bit_count(F.col("signature_a")[i].bitwiseAND(F.bitwise_not(F.col("signature_b")[i]))) for i in range(SIGNATURE_WORDS))
    only_b = sum(F.bit_count(F.col("signature_b")[i].bitwiseAND(F.bitwise_not(F.col("signature_a")[i]))) for i in range(SIGNATURE_WORDS))
    most = F.least(F.col("n_a") - only_a, F.col("n_b") - only_b)
    return 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)


def _parts_possible(percent: int) -> Column:
    """The same bound for any members of two parts: bits that all of one side and none of the other have set."""
    def only(x: str, y: str) -> Column:
        return sum(F.bit_count(F.col(f"all{i}_{x}").bitwiseAND(F.bitwise_not(F.col(f"any{i}_{y}")))) for i in range(SIGNATURE_WORDS))

    def fits(x: str, y: str) -> Column:
        return 100 * (F.col(f"most_{x}") - only(x, y)) >= percent * (F.col(f"least_{y}") + only(x, y))

    return fits("a", "b") & fits("b", "a")


def _wide(s: np.ndarray) -> bytes:
    """The wider bitmap of a set."""
    bits = np.zeros(WIDE_WORDS * 64, np.uint8)
    bits[(s >> np.uint64(24)).astype(np.int64) % len(bits)] = 1
    return np.packbits(bits).tobytes()


def _of_node(width: int):
    """Keep the rows whose text has the set that the node stands for, with the set's size and wider bitmap."""
    def run(batches):
        for batch in slices(batches, "text"):
            node, size, wide = [], [], []
            for s in shingles(*strings(batch.column("text")), width):
                node.append(_set_hash(s))
                size.append(len(s))
                wide.append(_wide(s))
            rows = pa.RecordBatch.from_arrays([batch.column("node"), batch.column("text"), pa.array(size, pa.int64()), pa.array(wide, pa.binary())],
                                              names=["node", "text", "n", "wide"])
            yield rows.filter(pa.array(np.array(node, np.uint64).view(np.int64) == batch.column("node").to_numpy()))
    return run


def _wide_possible(percent: int):
    """Keep the pairs that the wider bitmaps allow: each bit that only one side has is an element the other lacks."""
    def bitmaps(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WIDE_WORDS)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                a, b = (bitmaps(batch.column(f"wide_{x}")) for x in "ab")
                n_a, n_b = (batch.column(f"n_{x}").to_numpy() for x in "ab")
                most = np.minimum(n_a - np.bitwise_count(a & ~b).sum(1, np.int64), n_b - np.bitwise_count(b & ~a).sum(1, np.int64))
                yield batch.select(["a", "b"]).filter(pa.array(100 * most >= percent * (n_a + n_b - most)))
    return run


def _linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int, purpose: str) -> DataFrame:
    """The pairs (a, b) of nodes that are similar, by exact intersection of their shingle sets."""
    near = keep(pairs, f"{purpose}-pairs")
    for x in "ba":
        near = near.join(texts.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"wide_{x}")), x)
    near = keep(near.select("a", "b", "n_a", "n_b", "wide_a", "wide_b").mapInArrow(_wide_possible(percent), "a long, b long"), f"{purpose}-near")
    both = (near.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a"))
    return keep(both.select("a", "b", "text_a", "text_b").mapInArrow(_similar(width, percent), "a long, b long"), f"{purpose}-links")


def jaccard_classes(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                    width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) per row: which documents are joined by links of Jaccard similarity.

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of
    ``width``-word shingles (64-bit hashes); the component is the smallest id reachable. In this order:

    * documents with equal sets are one node, named by a 64-bit hash of the set;
    * a node is posted under its rarest shingles, ``n - ceil(percent * n / 100) + 1`` of them, one of
      which any partner shares (rarest by a frequency sketch of fixed size, so passages that many
      documents share are not what documents meet by);
    * in a few rounds, each node is compared with a few of the nodes drawn as hubs of the shingles it
      meets others by, which connects most of a group of near copies in as many comparisons as it has members;
    * connected parts that still meet in a shingle are joined in tiles of (part, size band): bitmap signatures, of parts and then
      of nodes, bound the overlap from above, exact intersection of sorted arrays decides.

    No group is expanded into its pairs and no partner is capped. A null or wordless text has no
    shingles and no links (its component is its own id); rows without id have a null component;
    repeated rows each give a row. An empty table gives no rows.
    """
    docs = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    spark = docs.sparkSession
    profiles = keep(docs.mapInArrow(_profiles(width, percent), PROFILE_TYPES), "profiles")
    sized = profiles.where("block is null").select("id", "node", "n", "band", "signature")
    nodes = keep(sized.where("n > 0 and id is not null").groupBy("node").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("band").alias("band"), F.first("signature").alias("signature")), "nodes")

    common = spark.sparkContext.broadcast(_commonness(profiles.where("block is not null").select("block", "counts")))
    postings = docs.where("id is not null").select("text").mapInArrow(_prefixes(width, percent, common), "token long, node long")
    # One shuffle of the postings, which are made once.
    of_token = Window.partitionBy("token")
    met = keep(postings.withColumns({"low": F.min("node").over(of_token), "high": F.max("node").over(of_token)})
               .where("low < high").select("token", "node"), "met")
    # Rows of one id may have other texts than the one that made it a node.
    texts = keep(docs.join(nodes.join(met.select("node").distinct(), "node", "left_semi").select("id", "node"), "id").select("node", "text")
                 .mapInArrow(_of_node(width), "node long, text string, n long, wide binary").dropDuplicates(["node"]), "texts")
    links = spark.createDataFrame([], "a long, b long")
    part_of = spark.createDataFrame([], "node long, component long")

    def possible(pairs: DataFrame) -> DataFrame:
        a, b = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"signature_{x}")) for x in "ab")
        return pairs.join(a, "a").join(b, "b").where(_possible(percent)).select("a", "b")

    def with_part(rows: DataFrame, x: str) -> DataFrame:
        found = rows.join(part_of.select(F.col("node").alias(x), F.col("component").alias(f"part_{x}")), x, "left")
        return found.withColumn(f"part_{x}", F.coalesce(f"part_{x}", x))

    for turn in range(ROUNDS):
        # A hub is drawn for each shingle whose nodes are not connected: the least node after a reversible scrambling.
        scramble = F.xxhash64("token", F.lit(turn))
        open_ = with_part(met, "node")
        drawn = (open_.groupBy("token").agg(F.min("part_node").alias("low"), F.max("part_node").alias("high"),
                                            F.min(F.col("node").bitwiseXOR(scramble)).alias("hub"))
                 .where("low < high").select("token", F.col("hub").bitwiseXOR(scramble).alias("hub")))
        offers = with_part(open_.join(drawn, "token").where("hub <> node").groupBy("node", "part_node", "hub")
                           .agg(F.count("*").alias("times")), "hub").where("part_node <> part_hub")
        chosen = offers.groupBy("node").agg(F.max(F.struct("times", "hub")).alias("most"), F.min("hub").alias("low"), F.max("hub").alias("high"))
        pairs = chosen.select("node", F.explode(F.array("most.hub", "low", "high")).alias("hub"))
        pairs = possible(pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
        links = links.unionByName(_linked(pairs, texts, width, percent, "hub"))
        part_of = components(links)

    # What still meets: parts by shingle first, so that a large part is one row there, and then the members of such parts.
    grouped = with_part(met, "node").withColumnRenamed("part_node", "part")
    mixed = grouped.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("token")
    open_rows = keep(grouped.join(mixed, "token"), "open")
    members = keep(open_rows.select("node", "part").distinct().join(nodes, "node").select("node", "part", "n", "band", "signature"), "members")
    bits = lambda f, name: [f(F.col("signature")[i]).alias(f"{name}{i}") for i in range(SIGNATURE_WORDS)]
    parts = keep(members.groupBy("part").agg(F.count("*").alias("rows"), F.min("n").alias("least"), F.max("n").alias("most"),
                                             *bits(F.bit_and, "all"), *bits(F.bit_or, "any")), "parts")
    by_token = open_rows.select("token", "part").distinct().join(parts, "part")
    a, b = (by_token.select("token", *[F.col(c).alias(f"{c}_{x}") for c in parts.columns]) for x in "ab")
    larger = F.struct("rows_a", "part_a") < F.struct("rows_b", "part_b")
    met_parts = keep(a.join(b, "token").where(larger & _parts_possible(percent)).select("part_a", "part_b").distinct(), "tiles")
    side = lambda x: [F.col("part").alias(f"part_{x}"), F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "signature")]]
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    tiles = (met_parts.join(members.select(*side("a"), near), "part_a")
             .join(members.select(*side("b"), "band"), ["part_b", "band"]).where(_possible(percent)))
    links = links.unionByName(_linked(tiles.select("a", "b"), texts, width, percent, "tile"))

    final = components(links).join(nodes.select("node", "id"), "node")
    smallest = final.groupBy("component").agg(F.min("id").alias("component_id"))
    found = final.join(smallest, "component").select("node", "component_id")
    joined = (sized.select("id", F.when(F.col("n") > 0, F.col("node")).alias("node"), "n")
              .join(nodes.select("node", F.col("id").alias("first")), "node", "left").join(found, "node", "left"))
    return joined.select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "first", "id")).alias("component_id"))
