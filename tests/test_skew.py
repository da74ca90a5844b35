"""One key with most of the rows: results stay whole and no task gets them all.

Broadcasts and adaptive execution are off, so that what is seen is the plan's own balance.
"""

import pytest
from pyspark.sql import functions as F

from mediaops.operators import capability, joins, runs

N = 40_000


@pytest.fixture(autouse=True)
def plain_shuffles(spark):
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def largest_share(df):
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(counts) / sum(counts)


@pytest.fixture
def facts(spark):
    """Rows of which two thirds have one key."""
    return spark.range(N).select(
        F.when(F.col("id") % 3 < 2, F.lit(0)).otherwise(F.col("id")).alias("key"), F.concat(F.lit("/f/"), "id").alias("path")
    )


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_of_a_hot_key_is_spread(spark, facts, how):
    table = spark.range(N).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value")).filter("key % 7 <> 1")
    plain = facts.join(table, ["key"], how)
    spread = joins.lookup_join(facts, table, ["key"], spread_by=["path"], how=how)
    assert spread.columns == plain.columns
    assert spread.count() == plain.count() and spread.exceptAll(plain).isEmpty()
    assert largest_share(plain) > 0.6 and largest_share(spread) < 0.35


def test_presence_test_reduces_repeated_keys(spark, facts):
    marked = joins.mark_present(facts.filter("key > 0 OR path = '/f/0'"), facts, {"key": F.col("key")}, "seen")
    assert marked.count() == facts.filter("key > 0").count() + 1 and marked.filter("NOT seen").isEmpty()
    assert joins.mark_present(facts, facts.filter("key = 5"), {"key": F.col("key")}, "seen").filter("seen").count() == 1


def test_run_with_most_of_the_jobs(spark, facts):
    jobs = facts.select(F.col("key").alias("run_id"), F.col("path").alias("source_path"), F.lit("done").alias("status"))
    known = spark.range(-5, N).select(F.col("id").alias("run_id"), F.lit("x").alias("name"))
    detail = joins.owners_with_facts(known, jobs, ["run_id"], spread_by=["source_path"])
    plain = known.join(jobs, "run_id", "left")
    assert detail.count() == plain.count() and detail.exceptAll(plain.select(detail.columns)).isEmpty()
    pages = runs.run_documents(known.filter("run_id <= 0"), jobs, page_size=100)
    assert pages.filter("run_id < 0").count() == 5
    sizes = [r[0] for r in pages.filter("run_id = 0").select(F.size("jobs")).collect()]
    hot = jobs.filter("run_id = 0").count()
    assert sum(sizes) == hot and max(sizes) < 200


def test_job_with_most_of_the_events(spark):
    events = spark.range(N).select(
        F.lit("r").alias("run_id"), F.when(F.col("id") % 3 < 2, F.lit("/hot")).otherwise(F.concat(F.lit("/"), F.col("id") % 100)).alias("source_path"),
        F.lit("running").alias("status"), (F.col("id") / N).alias("pct"), F.lit("1x").alias("speed"), F.col("id").alias("ts"), F.col("id").alias("seq"),
    )
    state = runs.latest_job_state(events, events.select("run_id", "source_path"))
    assert state.filter("source_path = '/hot'").first().updated_at == N - 1 and state.count() == 101
    # reduced before the shuffle: the exchange sits above a partial aggregation
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan


def test_rows_without_key_are_spread(spark):
    facts = spark.range(N).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("key"), F.concat(F.lit("/f/"), "id").alias("path"))
    table = spark.range(N).select(F.col("id").alias("key"), F.lit(1).alias("value"))
    spread = joins.lookup_join(facts, table, ["key"], spread_by=["path"])
    assert spread.count() == N and spread.filter("value = 1").count() == N // 10
    assert largest_share(spread) < 0.12


def test_verdicts_are_hashed_not_sorted(spark):
    evidence = spark.range(10).selectExpr("'qsv' AS backend", "'h264' AS codec", "'Main' AS profile", "'nv12' AS pix_fmt", "'positive' AS outcome", "id AS seq")
    assert "SortAggregate" not in capability.shape_verdict(evidence)._jdf.queryExecution().executedPlan().toString()
