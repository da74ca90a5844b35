"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sub-keys a single key is dealt over.
SPREAD = 8
#: Sub-keys that rows without key are dealt over.
NULL_SPREAD = 1 << 20


def lookup_join(facts: DataFrame, table: DataFrame, on: list[str], *, spread_by: list[str],
                how: str = "left", spread: int = SPREAD, grows: bool = False) -> DataFrame:
    """Join a large table to a lookup table on keys that may be very skewed.

    Spark broadcasts ``table`` by itself while its measured size is below the
    broadcast threshold (the copies made here are at most ``spread`` times that).
    Beyond it the rows of one key must still not meet in one task, so the fact rows
    are dealt over ``spread`` sub-keys (by a hash of ``spread_by``, columns that
    vary within a key) and each lookup row is repeated once per sub-key; adaptive
    execution splits what is still too large, which it may for the fact side of an
    inner or left join. Every match is kept.

    ``grows`` says that ``table`` grows with the facts: its copies are then a union, whose size Spark reckons in full, so that
    it broadcasts the copies only while all of them together are below the threshold. (Of exploded rows it sees the size of one copy.)
    """
    dealt = _dealt(facts, on, spread_by, spread)
    if grows:
        repeated = reduce(DataFrame.unionByName, [table.withColumn("_sub_key", F.lit(i)) for i in range(spread)])
    else:
        repeated = table.withColumn("_sub_key", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return dealt.join(repeated, [*on, "_sub_key"], how).drop("_sub_key")


def _dealt(facts: DataFrame, on: list[str], spread_by: list[str], spread: int) -> DataFrame:
    # A row without key finds nothing wherever it is, so such rows need not share a few sub-keys.
    no_key = reduce(or_, [F.col(k).isNull() for k in on])
    sub_key = F.pmod(F.xxhash64(*spread_by), F.when(no_key, F.lit(NULL_SPREAD)).otherwise(F.lit(spread))).cast("int")
    return facts.withColumn("_sub_key", sub_key)


def facts_with_owners(facts: DataFrame, owners: DataFrame, on: list[str], *, spread_by: list[str]) -> DataFrame:
    """``facts`` inner join ``owners``, as :func:`lookup_join`, where the owners are many and one of them may have most of the facts."""
    return _found(facts, _marked(owners, facts.select(*on).distinct(), on), on, spread_by).drop("_found")


def owners_with_facts(owners: DataFrame, facts: DataFrame, on: list[str], *, spread_by: list[str],
                      present: DataFrame | None = None) -> DataFrame:
    """``owners`` left join ``facts`` where one owner may have most of the facts.

    As a plain left join the facts would be the side that cannot be split. Here
    they look up their owner as in :func:`lookup_join`, and owners without facts are added. A left join with the distinct
    keys tells which these are; ``present`` gives the keys, each once, where they are at hand, so that the facts are not worked out again.
    """
    marked = _marked(owners, facts.select(*on).distinct() if present is None else present.select(*on), on)
    missing = marked.filter(F.col("_found").isNull())
    columns = [*owners.columns, *[c for c in facts.columns if c not in on]]
    return _found(facts, marked, on, spread_by).select(*columns).unionByName(missing.select(*owners.columns), allowMissingColumns=True)


def _marked(owners: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return owners.join(keys.withColumn("_found", F.lit(True)), on, "left")


def _found(facts: DataFrame, marked: DataFrame, on: list[str], spread_by: list[str]) -> DataFrame:
    # Only owners with facts are repeated, after the join with the keys, whose size as Spark reckons it counts the keys too. The copies
    # are thus not broadcast because the file of the owners alone is small (in memory they are many times that) while there are many facts.
    copies = F.when(F.col("_found"), F.lit(SPREAD - 1)).otherwise(F.lit(0))
    repeated = marked.withColumn("_sub_key", F.explode(F.sequence(F.lit(0), copies)))
    return _dealt(facts, on, spread_by, SPREAD).join(repeated, [*on, "_sub_key"], "inner").drop("_sub_key")


def mark_present(facts: DataFrame, keys: DataFrame, on: dict[str, Column], name: str) -> DataFrame:
    """Add a boolean column: does ``keys`` hold a row with these values?

    ``on`` maps columns of ``keys`` to expressions over ``facts``. The keys are
    reduced to distinct ones first, on the map side and then on the same hash
    partitioning the join needs, so a key repeated millions of times costs one row.
    """
    fact_side = {f"_{name}_{i}": expr for i, expr in enumerate(on.values())}
    renamed = keys.select(*[F.col(k).alias(new) for k, new in zip(on, fact_side)]).distinct()
    flagged = renamed.withColumn(f"_{name}", F.lit(True))
    joined = facts.withColumns(fact_side).join(flagged, list(fact_side), "left")
    present = F.coalesce(F.col(f"_{name}"), F.lit(False))
    return joined.withColumn(name, present).drop(f"_{name}", *fact_side)
