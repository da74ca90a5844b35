"""Manifest blocks to programs and back, and list settings in layers."""

import pytest
from pyspark.sql import functions as F

from mediaops.functions import codecs
from mediaops.operators import rules
from mediaops.operators import settings as s
from mediaops.sources import manifests
from mediaops.sources.inventory import listed_extension

BLOCK = f"""#!/bin/sh
{manifests.OPEN}
# name: weekly
# schedule: 0 3 * * 0
# src: /mnt/movies
# ext: mkv
# rule: when codec ne hevc and height gt 1080 do transcode --codec h265 --crf 24
# rule: do skip
{manifests.CLOSE}
for f in *; do echo "$f"; done
"""


def parsed(spark, *texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "script_id int, text string")
    return {r.script_id: r for r in manifests.parse_manifests(df, **kw).collect()}


def test_a_block_becomes_a_program(spark):
    got = parsed(spark, BLOCK)[0]
    assert (got.name, got.schedule, got.src, got.ext, got.errors) == ("weekly", "0 3 * * 0", "/mnt/movies", ["mkv"], [])
    assert [[tuple(c) for c in r.when] for r in got.rules] == [[("codec", "ne", "hevc"), ("height", "gt", "1080")], []]
    assert [(r["do"].cmd, r["do"]["args"]) for r in got.rules] == [("transcode", ["--codec", "h265", "--crf", "24"]), ("skip", [])]


@pytest.mark.parametrize(("text", "errors"), [
    (None, [(None, "no_block")]), ("", [(None, "no_block")]), ("#!/bin/sh\n# no manifest here\n", [(None, "no_block")]),
    (BLOCK.replace(manifests.CLOSE, ""), [(None, "block_not_closed")]), (f"{manifests.CLOSE}\n{manifests.OPEN}\n# src: /a", [(None, "block_not_closed")]),
    (BLOCK.replace("# src: /mnt/movies\n", ""), [(None, "missing_src")]), (BLOCK.replace("/mnt/movies", " "), [(None, "missing_src")]),
    (BLOCK.replace("do skip", "skip"), [(8, "expected_do")]), (BLOCK.replace("height gt", "height eq"), [(7, "invalid_op")]),
    (BLOCK.replace("height gt", "weight gt").replace("do skip", "do").replace("# src", "# root"), [(None, "missing_src"), (7, "unknown_field"), (8, "expected_do")]),
    (BLOCK.replace("gt 1080 do", "gt do"), [(7, "bad_condition")]), (BLOCK.replace("1080 do", "1080 then"), [(7, "missing_do")]),
])
def test_errors_have_their_line(spark, text, errors):
    assert [(e.line_no, e.error) for e in parsed(spark, text)[0].errors] == errors


def test_only_comment_lines_of_the_first_block_count(spark):
    text = f"{manifests.OPEN}\r\n#name:a:b\r\n  #  src : /x \nrule: do check\n# ext: avi\n# ext:\n# other\n{manifests.CLOSE}\n{manifests.OPEN}\n# src: /y\n{manifests.CLOSE}"
    got = parsed(spark, text, "x >>> # src: /z\n<<<")
    assert (got[0].name, got[0].src, got[0].ext, got[0].rules, got[0].errors) == ("a:b", "/x", ["avi"], [], [])
    assert parsed(spark, "pre >>> \n# src: /z\n<<<", opens=">>>", closes="<<<")[0].src == "/z"


def test_round_trip_and_use(spark):
    first = manifests.parse_manifests(spark.createDataFrame([("a", BLOCK)], "id string, text string"), "id")
    block = manifests.render_manifest(F.col("name"), F.col("schedule"), F.col("src"), F.col("ext"), F.col("rules"))
    again = manifests.parse_manifests(first.select("id", block.alias("text")), "id")
    assert again.collect() == first.collect()
    files = spark.createDataFrame([("/mnt/movies/a.mkv", "mkv", "h264", "aac", 2160, 3840, 1, 1.0), ("/mnt/movies/b.avi", "avi", "h264", "aac", 2160, 3840, 1, 1.0)],
                                  "path string, ext string, video_codec string, audio_codec string, height bigint, width bigint, bitrate bigint, duration double")
    assert [(r.program_id, r.path, r.cmd) for r in rules.run_programs(files, again).collect()] == [("a", "/mnt/movies/a.mkv", "transcode")]


def test_programs_without_root_are_reported(spark, rows):
    programs = spark.createDataFrame([("a", "", []), ("b", None, None), ("c", "/x", [([("size", "eq", "1")], ("skip", []))])],
                                     "id string, src string, rules array<struct<when:array<struct<field:string,op:string,value:string>>,do:struct<cmd:string,args:array<string>>>>")
    assert sorted(rows(rules.program_violations(programs)), key=str) == sorted(
        [("a", None, None, "missing_src"), ("b", None, None, "missing_src"), ("b", None, None, "corrupt_rules"), ("c", 0, 0, "unknown_field")], key=str)


def test_list_settings_of_the_first_layer_count(spark):
    jobs = spark.createDataFrame(
        [(1, 1, 1, "web", ["ts"], ["av1"]), (2, 1, 1, None, None, None), (3, 2, 1, None, None, None), (4, 3, 3, None, None, None), (5, 1, 1, None, [], []), (6, 4, 1, None, ["a,b"], None)],
        "job_id bigint, owner bigint, site bigint, profile string, ext array<string>, skip_source_codecs array<string>")
    env = spark.createDataFrame([(1, "mp4, .MOV,,", "hevc"), (2, "", ""), (4, " , ", None)], "owner bigint, ext string, skip_source_codecs string")
    config = spark.createDataFrame([(1, ["avi"], ["vp9", "h264"])], "site bigint, ext array<string>, skip_source_codecs array<string>")
    got = {r.job_id: (r.ext, r.skip_source_codecs) for r in s.resolve_settings(jobs, s.builtin_profiles(spark).withColumn("source", F.lit("built-in")), env=(env, "owner"), config=(config, "site")).collect()}
    assert got == {1: (["ts"], ["av1"]), 2: (["mp4", ".MOV"], ["hevc"]), 3: (["avi"], ["vp9", "h264"]), 4: (["mkv", "mp4", "avi"], []), 5: ([], []), 6: (["a", "b"], ["vp9", "h264"])}
    allowed = spark.createDataFrame([("mov", [".MOV "]), ("MKV", ["mkv"]), ("avi", []), ("avi", None)], "ext string, list array<string>")
    assert [r.ok for r in allowed.select(F.coalesce(listed_extension(F.col("ext"), F.col("list")), F.lit(False)).alias("ok")).collect()] == [True, True, False, False]
    denied = spark.createDataFrame([("h264", ["AVC"]), ("hevc", ["av1"]), ("", ["nope"]), (None, ["av1"])], "codec string, list array<string>")
    assert [bool(r.no) for r in denied.select(codecs.is_denied_codec(F.col("codec"), F.col("list")).alias("no")).collect()] == [True, False, False, False]
