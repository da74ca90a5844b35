"""The extension list of a job is spelled out once per job, before files meet it."""

import re

from pyspark.sql import functions as F

from mediaops.plans.library_run import library_run


def test_extension_lists_are_prepared_before_the_join(spark):
    files = [("/a.mkv", "mkv", 1), ("/b.MP4", "MP4", 1), ("/c.avi", "avi", 1), ("/d.ts", "ts", 2), ("/e.mkv", "mkv", 2), ("/f.mkv", "mkv", 3), ("/g", None, 1)]
    inventory = spark.createDataFrame([(p, p[1:], e, 1, 1, j) for p, e, j in files], "path string, rel_path string, ext string, mtime bigint, links bigint, job_id bigint")
    attrs = spark.createDataFrame([(p, True, "h264", "Main", "yuv420p", 8, False) for p, _, _ in files],
                                  "path string, probe_ok boolean, video_codec string, profile string, pix_fmt string, surface_depth int, dolby_vision boolean")
    jobs = spark.createDataFrame([(1, [" .MKV", "mp4"]), (2, ["TS", None]), (3, None)], "job_id bigint, ext array<string>").withColumns({
        "host": F.lit(1).cast("bigint"), "codec": F.lit("h265"), "hwaccel": F.lit("none"), "hwdecode": F.lit("off"), "crf": F.lit(20), "preset": F.lit("medium"),
        "audio_codec": F.lit("copy"), "audio_bitrate": F.lit(""), "subs": F.lit("copy"), "decode_threads": F.lit(0), "inplace": F.lit(False),
        "extra_args": F.array().cast("array<string>")})
    tested = spark.createDataFrame([], "host bigint, codec string, backend string, works boolean, main10 boolean")
    verdicts = spark.createDataFrame([], "backend string, codec string, profile string, pix_fmt string, verdict boolean")
    run = library_run(inventory, attrs, jobs, tested, verdicts)
    assert sorted(r.path for r in run.select("path").collect()) == ["/a.mkv", "/b.MP4", "/d.ts"]
    plan = run._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if re.search(r"\bJoin Inner\b", line)]
    assert joins and not any("regexp_replace" in line for line in joins)
