from mediaops.operators import joins, runs, settings
from pyspark.sql import functions as F


def test_copies_of_a_growing_layer_are_broadcast_only_when_all_are_small(spark):
    jobs = spark.range(3000).select(F.col("id").alias("job_id"), (F.col("id") % 2000).alias("owner"), F.lit(None).cast("string").alias("profile"))
    env = spark.range(2000).select(F.col("id").alias("owner"), F.concat(F.lit("h"), "id").alias("hwaccel"))
    profiles = settings.builtin_profiles(spark).withColumn("source", F.lit("built-in"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        # One copy is smaller than this, eight are larger.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = settings.resolve_settings(jobs, profiles, env=(env, "owner")).select("job_id", "hwaccel")
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = {r.job_id: r.hwaccel for r in found.collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin" in plan
    assert rows == {i: f"h{i % 2000}" for i in range(3000)}


def test_copies_of_owners_are_not_broadcast_by_the_size_of_one(spark):
    jobs = spark.range(40_000).select((F.col("id") % 1500).alias("run_id"), F.concat(F.lit("/f/"), "id").alias("source_path"), F.lit("done").alias("status"))
    known = spark.range(2000).select(F.col("id").alias("run_id"), F.concat(F.lit("r"), "id").alias("name"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        # The owners are smaller than this, their copies and the keys of the jobs are larger.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        detail = runs.run_detail(known, jobs)
        pages = runs.run_documents(known, jobs, page_size=8)
        plan = detail._jdf.queryExecution().executedPlan().toString()
        attached = pages._jdf.queryExecution().executedPlan().toString()
        paths = {(r.run_id, r.name, r.source_path) for r in detail.collect()}
        sizes = {}
        for r in pages.collect():
            sizes.setdefault((r.run_id, r.name), []).append(len(r.jobs))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert "BroadcastHashJoin" not in plan and "BroadcastHashJoin" not in attached
    assert paths == {(i % 1500, f"r{i % 1500}", f"/f/{i}") for i in range(40_000)} | {(i, f"r{i}", None) for i in range(1500, 2000)}
    assert {k: sum(v) for k, v in sizes.items()} == {(i, f"r{i}"): len(range(i, 40_000, 1500)) if i < 1500 else 0 for i in range(2000)}
    assert all(min(v) > 0 for (i, _), v in sizes.items() if i < 1500) and all(sizes[i, f"r{i}"] == [0] for i in range(1500, 2000))


def test_copies_of_stored_programs_are_not_broadcast_by_the_size_of_one(spark):
    files = spark.range(40_000).select((F.col("id") % 1500).alias("owner"), F.concat(F.lit("/f/"), "id").alias("path"))
    programs = spark.range(1000, 3000).select(F.col("id").alias("owner"), F.concat(F.lit("p"), "id").alias("program"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        owned = joins.facts_with_owners(files, programs, ["owner"], spread_by=["path"])
        plan = owned._jdf.queryExecution().executedPlan().toString()
        rows = [(r.owner, r.path, r.program) for r in owned.collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert owned.columns == ["owner", "path", "program"] and "BroadcastHashJoin" not in plan
    assert sorted(rows) == sorted((i % 1500, f"/f/{i}", f"p{i % 1500}") for i in range(40_000) if i % 1500 >= 1000)
