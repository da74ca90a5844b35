"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .native_text import evaluated_once, in_parts, word_count
from .work import keep

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Words of a block.
BLOCK_WORDS = 32
#: No source, and no document, is taken more often than this.
MOST_TIMES = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, target): what each source should give, in words, from rows of (source, size).

    Sources are ordered by code point, null last, and weigh ``weights`` in turn. A target stops at ``most`` times
    the source; what is cut off goes to the others by weight until none is above. Sorted by how soon
    they are full, sources are full up to the first one whose share of the rest fits.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    ranked = (sources.withColumn("weight", weight.cast("double")).withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double"))
              .withColumns({
                  "full": F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
                  "open": F.sum("weight").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
                  "total": F.sum("source_size").over(whole)}))
    level = (F.col("total") - F.col("full")) / F.col("open")
    fits = ranked.withColumn("level", F.when(F.col("weight") * level <= F.col("cap"), level))
    return fits.withColumn("level", F.max("level").over(whole)).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def sainte_lague(parties: DataFrame, seats: str, votes: str, group: list[str], name: str, order: list) -> DataFrame:
    """Add ``name``: the seats each row of a group gets of the group's ``seats`` by the highest quotients ``votes / (k + 1/2)``.

    With V votes and n rows, quotients above V / (seats - n/2) are surely among the highest and those below
    V / (seats + n/2) surely not, so only about n quotients of a group are ranked at all. Equal quotients go by ``order``.
    """
    alike = Window.partitionBy(*group)
    whole, n = F.sum(votes).over(alike), F.count("*").over(alike)
    sure = F.when((F.col(seats) > n / 2) & (whole > 0), F.floor(F.col(votes) * (F.col(seats) - n / 2) / whole + 0.5)).otherwise(0)
    most = F.when(whole > 0, F.floor(F.col(votes) * (F.col(seats) + n / 2) / whole + 0.5)).otherwise(0)
    bounds = parties.withColumns({"_sure": F.greatest(sure - 1, F.lit(0)).cast("long"), "_most": (most + 1).cast("long")})
    contested = bounds.withColumn("_left", F.col(seats) - F.sum("_sure").over(alike)).withColumn("_k", F.explode(F.sequence("_sure", "_most")))
    ranked = contested.withColumn("_rank", F.row_number().over(
        alike.orderBy((F.col(votes) / (F.col("_k") + 0.5)).desc(), *order, F.col("_k"))))
    kept = [c for c in parties.columns]
    won = F.sum(F.when((F.col("_rank") <= F.col("_left")) & (F.col(votes) > 0), 1).otherwise(0))
    return ranked.groupBy(*kept).agg((F.first("_sure") + won).alias(name))


def mix_sources(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
                weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES, block: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """(id, size, source_size, target, taken) per row: how many words of each document the mix takes.

    Every source's documents are dealt over shards (about the square root of its size, so neither a shard
    nor a source's list of shards grows with all of it) and lined up there by a seeded hash. Targets become blocks of
    ``block`` words for sources, and then for their shards, by Sainte-Lague. A shard gives whole
    passes as far as its quota goes, and for the rest the run of blocks that begins at a seeded one; a document gives the
    words of it that lie in those blocks. Reruns agree. Null and wordless texts have size 0 and give
    nothing; null sources are a source; repeated rows count each. Without any words all targets are 0.
    """
    return _taken(documents, id_column, text_column, source_column, weights, most, block, seed).select(
        F.col("id").alias(id_column), "size", "source_size", "target", "taken")


def _taken(documents: DataFrame, id_column: str, text_column: str, source_column: str, weights: tuple[int, ...],
           most: int, block: int, seed: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, shard, key, size, source_size, target, taken, *ties) per row; ``ties`` are columns that order rows of one key."""
    sizes = keep(documents.select(F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"),
                                  word_count(F.coalesce(F.col(text_column).cast("string"), F.lit(""))).alias("size"), *ties), "sizes")
    sources = sainte_lague(
        source_targets(sizes, weights, most).withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")),
        "blocks", "target", [], "quota", [F.col("source").asc_nulls_last()])
    sources = keep(sources.withColumn("shards", F.greatest(F.ceil(F.sqrt(F.col("source_size") / 1024)), F.lit(1)).cast("long")), "sources")

    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("size").cast("string")))
    number = lambda c: F.conv(F.substring(c, 1, 15), 16, 10).cast("long")
    placed = (sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
              .withColumn("key", key).withColumn("shard", F.pmod(number(F.col("key")), F.col("shards"))))
    shard_sizes = placed.groupBy("source", "shard").agg(
        F.sum("size").cast("double").alias("shard_size"), F.first("quota").alias("quota"))
    shards = sainte_lague(shard_sizes, "quota", "shard_size", ["source"], "share", [F.col("shard")])
    n = F.ceil(F.col("shard_size") / block)
    shards = shards.select(
        F.col("source").alias("_source"), F.col("shard").alias("_shard"), F.col("shard_size").cast("long").alias("shard_size"),
        (F.col("share") * block).alias("words"), n.alias("n")).withColumn(
            "passes", F.when(F.col("n") > 0, F.least(F.floor(F.col("words") / F.col("shard_size")), F.lit(most))).otherwise(0)).withColumns({
            "rest": F.when((F.col("n") > 0) & (F.col("passes") < most), F.least(
                F.round((F.col("words") - F.col("passes") * F.col("shard_size")) / block), F.col("n"))).otherwise(0),
            "first": F.when(F.col("n") > 0, F.pmod(number(F.md5(F.concat_ws(":", F.lit(str(seed)), "_source", F.col("_shard").cast("string")))), F.col("n"))).otherwise(0)})
    line = Window.partitionBy("source", "shard").orderBy("key", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = placed.withColumn("end", F.sum("size").over(line)).withColumn("begin", F.col("end") - F.col("size"))
    joined = lined.join(shards, (lined["source"].eqNullSafe(shards["_source"])) & (lined["shard"] == shards["_shard"]))
    common = lambda a, b: F.greatest(F.least("end", b) - F.greatest("begin", a), F.lit(0))
    since, until = F.col("first") * block, (F.col("first") + F.col("rest")) * block
    # The run of blocks goes on at the front when it passes the end.
    over = F.greatest(F.col("first") + F.col("rest") - F.col("n"), F.lit(0)) * block
    taken = F.col("passes") * F.col("size") + common(since, F.least(until, F.col("shard_size"))) + common(F.lit(0), over)
    return joined.select("id", "source", "shard", "key", "size", "source_size", "target", taken.cast("long").alias("taken"), *ties)


def _dealt(rows: Column, start: Column, most: int) -> Column:
    """Copies of each of ``rows`` (size, taken), in order: what a row is due and what the rows before it were left owing, to the nearest whole."""
    def deal(state: Column, x: Column) -> Column:
        due = state.owed + x.taken
        n = F.greatest(F.least(F.floor(due / x.size + 0.5), F.lit(most)), F.lit(0)).cast("long")
        return F.struct((due - n * x.size).alias("owed"), F.concat(state.copies, F.array(n)).alias("copies"))

    # Lists grow by copying: rows are dealt in parts, so that what is copied stays short.
    none = F.array().cast("array<bigint>")
    begin = F.struct(start.cast("long").alias("owed"), F.array().cast("array<array<bigint>>").alias("copies"))
    part = lambda state, some: evaluated_once(
        F.aggregate(some, F.struct(state.owed.alias("owed"), none.alias("copies")), deal),
        lambda dealt: F.struct(dealt.owed.alias("owed"), F.concat(state.copies, F.array(dealt.copies)).alias("copies")))
    return F.aggregate(in_parts(rows), begin, part, lambda state: F.struct(state.owed.alias("owed"), F.flatten(state.copies).alias("copies")))


def mixed_documents(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
                    weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES, block: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """The rows of ``documents``, each as a whole number of copies, ``most`` at most, so that each source gives about its words of the mix.

    A shard's documents are dealt copies from the longest to the shortest (then by the seeded line): a document gets what
    ``mix_sources`` takes of it and what was left owing before it, to the nearest copy. What a shard cannot give or
    take back goes to the source's other shards by what they can, so a source misses its words by about half
    a short document, unless even ``most`` copies of its other documents cannot make up for a long one. Rows without
    id take part like others; wordless rows give nothing. Reruns agree.
    """
    # The number only joins copies to rows again; places in line come from id, size and text.
    row, tie = "_mix_row", "_mix_tie"
    held = keep(documents.withColumns({row: F.monotonically_increasing_id(), tie: F.xxhash64(F.col(text_column).cast("string"))}), "mix")
    taken = _taken(held, id_column, text_column, source_column, weights, most, block, seed, (tie, row)).where("size > 0")
    line = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("less"), "key", tie, row, "size", "taken")))
    shards = keep(taken.groupBy("source", "shard").agg(line.alias("rows"), F.sum("size").alias("words"), F.sum("taken").alias("due")), "line")
    first = shards.withColumn("owed", _dealt(F.col("rows"), F.lit(0), most)["owed"])
    given = F.col("due") - F.col("owed")
    source = Window.partitionBy("source")
    open_ = first.withColumn("rest", F.sum("owed").over(source)).withColumn(
        "room", F.when(F.col("rest") > 0, most * F.col("words") - given).otherwise(given))
    # A shard's part of the rest replaces what it was left owing itself.
    share = F.coalesce(F.round(F.col("rest") * F.col("room") / F.nullif(F.sum("room").over(source), F.lit(0))), F.lit(0))
    dealt = open_.withColumn("start", share - F.col("owed")).select(
        F.col(f"rows.{row}").alias("row"), _dealt(F.col("rows"), F.col("start"), most)["copies"].alias("times"))
    times = dealt.select(F.explode(F.arrays_zip("row", "times")).alias("x")).select(
        F.col("x.row").alias(row), F.col("x.times").cast("int").alias("_mix_times")).where("_mix_times > 0")
    copy = F.explode(F.sequence(F.lit(1), F.col("_mix_times"))).alias("_mix_copy")
    return held.join(times, row).select(*[F.col(f"`{c}`") for c in documents.columns], copy).drop("_mix_copy")
