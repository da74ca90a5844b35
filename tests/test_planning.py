"""Skip, todo and blocked decisions in both modes."""

from pyspark.sql import functions as F

from mediaops.operators.planning import PlanSettings, orphan_artifacts, plan, plan_listing, plan_summary

FILES = "path string, rel_path string, mtime bigint, links bigint, video_codec string, dolby_vision boolean"


def files(spark, *given):
    filled = []
    for path, *rest in given:
        mtime, links, codec, dv = [*rest, *[1, 1, "h264", False][len(rest):]]
        filled.append((path, path.rsplit("/", 1)[1], mtime, links, codec, dv))
    return spark.createDataFrame(filled, FILES)


def paths_of(spark, *given):
    return spark.createDataFrame([(p,) for p in given], "path string")


def history_of(spark, *given):
    return spark.createDataFrame(list(given), "source_path string, source_mtime bigint, status string")


def decisions(planned):
    return {r.path: (r.decision, r.reason) for r in planned.collect()}


def test_alongside_skips_own_and_existing_outputs(spark):
    given = files(spark, ("/m/a.mkv",), ("/m/b.out.mkv",), ("/m/c.mkv",), ("/m/d.transcoded.mkv",))
    planned = plan(given, PlanSettings(), listing=paths_of(spark, "/m/a.out.mkv", "/m/a.out.mkv", "/m/c.mkv"))
    assert decisions(planned) == {
        "/m/a.mkv": ("skipped", "output_exists"), "/m/b.out.mkv": ("skipped", "own_output"), "/m/c.mkv": ("todo", None),
        "/m/d.transcoded.mkv": ("skipped", "own_output"),
    }


def test_force_redoes_existing_outputs_but_not_own_ones(spark):
    given = files(spark, ("/m/a.mkv",), ("/m/b.out.mkv",), ("/m/c.mkv", 1, 1, "av1"))
    planned = plan(given, PlanSettings(force=True, skip_source_codecs=["AV1"]), listing=paths_of(spark, "/m/a.out.mkv"))
    assert decisions(planned) == {
        "/m/a.mkv": ("todo", None), "/m/b.out.mkv": ("skipped", "own_output"), "/m/c.mkv": ("skipped", "source_denylist"),
    }


def test_output_with_another_extension_is_seen(spark):
    planned = plan(files(spark, ("/m/a.avi",)), PlanSettings(container="webm"), listing=paths_of(spark, "/m/a.out.webm"))
    assert decisions(planned) == {"/m/a.avi": ("skipped", "output_exists")}


def test_inplace_skips_what_is_in_the_target_codec(spark):
    given = files(spark, ("/x/already.mkv", 1, 1, "hevc"), ("/x/old.mkv",), ("/x/broken.mkv", 1, 1, None), ("/x/b.out.mkv",))
    planned = plan(given, PlanSettings(inplace=True))
    assert decisions(planned) == {
        "/x/already.mkv": ("skipped", "already_target"), "/x/old.mkv": ("todo", None), "/x/broken.mkv": ("todo", None),
        "/x/b.out.mkv": ("todo", None),
    }
    assert {r.output_path == r.path for r in planned.collect()} == {True}


def test_inplace_order_of_reasons(spark):
    given = files(spark, ("/x/1.mkv", 5, 2, "hevc"), ("/x/2.mkv", 5, 1, "hevc"), ("/x/3.mkv", 5, 1, "hevc"), ("/x/4.mkv", 5, 1, "av1"))
    done = history_of(spark, ("/x/1.mkv", 5, "done"), ("/x/2.mkv", 5, "done"), ("/x/2.mkv", 5, "done"), ("/x/3.mkv", 4, "done"),
                      ("/x/4.mkv", 5, "failed"))
    planned = plan(given, PlanSettings(inplace=True, skip_hardlinked=True, skip_source_codecs=["av1"]), history=done)
    assert [decisions(planned)[f"/x/{n}.mkv"][1] for n in range(1, 5)] == [
        "hardlinked", "history_done", "already_target", "source_denylist"]


def test_hardlinks_matter_only_when_asked(spark):
    given = files(spark, ("/x/linked.mkv", 1, 5))
    assert decisions(plan(given, PlanSettings(inplace=True)))["/x/linked.mkv"] == ("todo", None)


def test_forced_inplace_keeps_everything_but_dolby_vision(spark):
    given = files(spark, ("/x/a.mkv", 1, 9, "hevc"), ("/x/b.mkv", 1, 1, "hevc", True), ("/x/c.mkv", 1, 1, None, None))
    forced = PlanSettings(inplace=True, force=True, skip_hardlinked=True, skip_source_codecs=["hevc"])
    assert decisions(plan(given, forced)) == {
        "/x/a.mkv": ("todo", None), "/x/b.mkv": ("blocked", "dolby_vision"), "/x/c.mkv": ("todo", None)}


def test_dolby_vision_is_blocked_after_skips_unless_accepted(spark):
    given = files(spark, ("/m/a.mkv", 1, 1, "hevc", True), ("/m/b.out.mkv", 1, 1, "hevc", True))
    assert decisions(plan(given, PlanSettings())) == {
        "/m/a.mkv": ("blocked", "dolby_vision"), "/m/b.out.mkv": ("skipped", "own_output")}
    assert decisions(plan(given, PlanSettings(allow_hdr_loss=True)))["/m/a.mkv"] == ("todo", None)


def test_unknown_target_keeps_files(spark):
    assert decisions(plan(files(spark, ("/x/a.mkv", 1, 1, "")), PlanSettings(codec="libfoo", inplace=True)))["/x/a.mkv"][0] == "todo"


def test_settings_may_differ_by_row(spark):
    given = files(spark, ("/m/a.mkv", 1, 1, "hevc"), ("/m/b.mkv", 1, 1, "hevc")).withColumns({
        "inplace": F.col("path") == "/m/a.mkv", "skip_source_codecs": F.array(F.lit("h265")), "codec": F.lit("av1")})
    planned = plan(given, PlanSettings.from_columns(given), history=history_of(spark, ("/m/a.mkv", 1, "done")),
                   listing=paths_of(spark, "/m/b.out.mkv"))
    assert decisions(planned) == {"/m/a.mkv": ("skipped", "history_done"), "/m/b.mkv": ("skipped", "output_exists")}


def test_summary_and_listing(spark, rows):
    planned = plan(files(spark, ("/m/a.mkv",), ("/m/b.out.mkv",), ("/m/c.mp4",)), PlanSettings(crf=20))
    assert sorted(rows(plan_summary(planned)), key=str) == [("skipped", "own_output", 1), ("todo", None, 2)]
    assert sorted(rows(plan_listing(planned, PlanSettings(crf=20)))) == [
        ("/m/a.mkv", "/m/a.out.mkv", "/m/a.transcoded.mkv", "h265", 20), ("/m/c.mp4", "/m/c.out.mp4", "/m/c.transcoded.mp4", "h265", 20)]


def test_orphans(spark, rows):
    listing = spark.createDataFrame([
        ("/m/a.transcoded.mkv", False), ("/m/b.transcoded.MKV", False), ("/m/c.transcoded.mkv", True), ("/m/d.mkv", False),
        ("/m/e.transcoded.txt", False),
    ], "path string, is_symlink boolean")
    assert sorted(r.path for r in orphan_artifacts(listing, [".MKV", "mp4"]).collect()) == ["/m/a.transcoded.mkv", "/m/b.transcoded.MKV"]


def test_only_the_joins_a_mode_needs_are_planned(spark):
    given, done, listing = files(spark, ("/m/a.mkv",)), history_of(spark, ("/m/a.mkv", 1, "done")), paths_of(spark, "/m/a.out.mkv")
    joins = lambda s: plan(given, s, history=done, listing=listing)._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(PlanSettings()) == 1 and joins(PlanSettings(inplace=True)) == 1 and joins(PlanSettings(force=True)) == 0
