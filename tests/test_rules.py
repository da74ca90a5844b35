"""Conditions, rule programs in both forms, rule text, and program assignment."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mediaops import schemas
from mediaops.operators import rules
from mediaops.operators.rules import Cond, Rule
from mediaops.plans.program_run import program_run
from mediaops.sources.programs import list_programs, program_by_id, read_programs

FILES = ("path string, ext string, video_codec string, audio_codec string, height bigint, width bigint, bitrate bigint,"
         " duration double")
LIBRARY = [
    ("/lib/f/a.mkv", "mkv", "h264", "aac", 1080, 1920, 9000, 3600.0),
    ("/lib/f/b.mp4", "mp4", "hevc", "opus", 2160, 3840, 15001, 10.5),
    ("/lib/o/c.avi", "avi", "", "", 0, 0, 0, 0.0),
    ("/lib/o/d.mkv", "mkv", None, None, None, None, None, None),
    ("/library/e.mkv", "mkv", "av1", "aac", 720, 1280, 100, 59.9),
]


@pytest.fixture
def library(spark):
    return spark.createDataFrame(LIBRARY, FILES)


def matched(library, *conditions):
    hit = library.filter(rules.match_all([Cond(*c) for c in conditions]))
    return sorted(r.path.rsplit("/", 1)[1][0] for r in hit.collect())


@pytest.mark.parametrize(("condition", "files"), [
    (("codec", "eq", "hevc"), "b"), (("codec", "ne", "hevc"), "ace"), (("codec", "eq", "HEVC"), ""),
    (("audio", "eq", "aac"), "ae"), (("audio", "ne", "aac"), "bc"),
    (("ext", "eq", "MKV"), "ade"), (("ext", "ne", "mkv"), "bc"),
    (("height", "gt", "1080"), "b"), (("height", "lt", "1080"), "ce"), (("height", "ge", "1080"), "ab"), (("height", "le", "1080"), "ace"),
    (("width", "gt", "1280"), "ab"), (("width", "lt", "1280"), "c"),
    (("bitrate", "gt", "9000"), "b"), (("bitrate", "lt", "9000"), "ce"),
    (("duration", "gt", "59.9"), "a"), (("duration", "lt", "59.9"), "bc"),
    (("height", "gt", "tall"), ""), (("duration", "lt", "1m"), ""),
])
def test_conditions(library, condition, files):
    assert matched(library, condition) == list(files)


def test_no_conditions_match_everything_and_repeated_ones_all_count(library):
    assert matched(library) == list("abcde")
    assert matched(library, ("height", "gt", "700"), ("height", "gt", "1080")) == ["b"]
    assert matched(library, ("codec", "ne", "av1"), ("codec", "ne", "hevc")) == ["a", "c"]


def test_unsupported_conditions_are_refused():
    for field, op in [("width", "le"), ("height", "eq"), ("codec", "gt"), ("size", "gt")]:
        with pytest.raises(ValueError):
            rules.cond(field, op, "1")


def test_first_full_match_wins(library):
    program = [
        Rule("transcode", ["--crf", "20"], [Cond("codec", "ne", "hevc"), Cond("height", "ge", "1080")]),
        Rule("check", [], [Cond("height", "ge", "1080")]),
        Rule("skip", when=[Cond("ext", "eq", "mkv")]),
    ]
    decided = {r.path[-5]: (r.rule_ix, r.cmd, r.args) for r in rules.apply_program(library, program).collect()}
    assert decided == {
        "a": (0, "transcode", ["--crf", "20"]), "b": (1, "check", []), "c": (None, None, None),
        "d": (2, "skip", []), "e": (2, "skip", []),
    }


def test_catch_all_ends_the_program(library):
    decided = rules.apply_program(library, [Rule("skip"), Rule("transcode", [], [Cond("codec", "eq", "h264")])])
    assert {r.cmd for r in decided.collect()} == {"skip"}
    assert rules.apply_program(library, []).filter("rule_ix IS NOT NULL").count() == 0
    counts = rules.rule_counts(rules.apply_program(library, [Rule("check", [], [Cond("codec", "eq", "av1")])]))
    assert {tuple(r) for r in counts.collect()} == {(0, "check", 1), (None, None, 4)}


def test_compiled_and_stored_programs_agree(spark, library):
    rng = random.Random(7)
    values = {"codec": ["h264", "hevc", "", "av1"], "audio": ["aac", "opus", ""], "ext": ["MKV", "avi", "mp4"],
              "height": ["0", "720", "1080", "x"], "width": ["1280", "0"], "bitrate": ["100", "15000"], "duration": ["10.5", "3600", ""]}
    for _ in range(6):
        program = []
        for _ in range(rng.randint(0, 4)):
            fields = [rng.choice(list(values)) for _ in range(rng.randint(0, 3))]
            when = [Cond(f, rng.choice(rules.VALID_OPS[f]), rng.choice(values[f])) for f in fields]
            program.append(Rule(rng.choice(["transcode", "check", "skip"]), ["-x"] * rng.randint(0, 2), when))
        text = json.dumps([{"when": [vars(c) for c in r.when] or None, "do": {"cmd": r.cmd, "args": r.args or None}} for r in program])
        assert rules.rules_from_json(text) == program
        parsed = F.from_json(F.lit(text), schemas.RULES)
        stored = rules.apply_rules_column(library.withColumn("rules", rules.prepare_rules(parsed)))
        compiled = rules.apply_program(library, program)
        columns = ["path", "rule_ix", "cmd", "args"]
        assert sorted(stored.select(columns).collect()) == sorted(compiled.select(columns).collect())


@pytest.mark.parametrize(("line", "conditions", "cmd"), [
    ("when audio eq flac do check --deep", 1, "check"),
    ("when ext ne mkv and duration lt 90.5 and width gt 640 do transcode --crf 19", 3, "transcode"),
    ("do transcode", 0, "transcode"), ("   do    skip  now ", 0, "skip"),
    ("when  audio   eq ac3 do do now do", 1, "do"),
])
def test_valid_rule_lines(spark, line, conditions, cmd):
    row = rules.parse_rule_lines(spark.createDataFrame([(line,)], "line string")).first()
    assert (row.error, len(row.when), row.cmd) == (None, conditions, cmd)


@pytest.mark.parametrize(("line", "error"), [
    ("when ext do check", "bad_condition"), ("when audio eq opus check", "missing_do"), ("   ", "expected_do"),
    ("do  ", "expected_do"), ("when bitrate ge 900 do check", "invalid_op"), ("when duration ne 60 do skip", "invalid_op"),
    ("when ext lt mp4 do skip", "invalid_op"), ("when colour eq blue do skip", "unknown_field"),
])
def test_invalid_rule_lines(spark, line, error):
    row = rules.parse_rule_lines(spark.createDataFrame([(line,)], "line string")).first()
    assert (row.error, row.cmd, row["when"]) == (error, None, None)


def test_rule_text_round_trip(spark, rows):
    lines = ["when codec ne hevc and height gt 1080 do transcode --codec h265", "do skip"]
    script = ["#!/bin/sh", "# name: x", *[f"# rule: {line}" for line in lines], "echo # rule: no"]
    parsed = rules.parse_manifest_lines(spark.createDataFrame([(s,) for s in script], "line string"))
    rendered = parsed.select(rules.render_rule_line(F.col("when"), F.col("cmd"), F.col("args")))
    assert [r[0] for r in rows(rendered)] == lines


def test_every_supported_pair_is_valid(spark):
    pairs = [(f, o) for f, ops in rules.VALID_OPS.items() for o in ops]
    assert len(pairs) == 16
    df = spark.createDataFrame([*pairs, ("width", "ge"), ("size", "eq")], "f string, o string")
    problems = [r[0] for r in df.select(rules.condition_problem(F.col("f"), F.col("o"))).collect()]
    assert problems == [None] * 16 + ["invalid_op", "unknown_field"]


PROGRAMS = "id string, name string, schedule string, src string, ext string, rules_json string"
SKIP = '[{"when":[],"do":{"cmd":"skip","args":[]}}]'


def test_stored_programs(spark):
    stored = spark.createDataFrame([
        ("1", "zebra", "", "/lib", "mkv,mp4", SKIP), ("2", "ant", "", "/", "", ""), ("3", "bee", "", "/", None, "[]"),
        ("4", "cow", "", "/", "", "{broken"),
    ], PROGRAMS)
    read = list_programs(stored).collect()
    assert [r.name for r in read] == ["ant", "bee", "cow", "zebra"]
    assert [r.ext for r in read] == [["mkv", "mp4", "avi"]] * 3 + [["mkv", "mp4"]]
    assert [r.rules_corrupt for r in read] == [False, False, True, False]
    assert [r.rules if r.rules is None else len(r.rules) for r in read] == [0, 0, None, 1]
    assert program_by_id(stored, "1").count() == 1 and program_by_id(stored, "9").count() == 0


def test_programs_scan_their_own_tree(spark, library):
    stored = spark.createDataFrame([
        ("all", "all", "", "/", "mkv", SKIP), ("films", "films", "", "/lib/f/", ".MKV,mp4", "[]"),
        ("lib", "lib", "", "/lib", "", '[{"do":{"cmd":"transcode"}}]'), ("none", "none", "", "/li", "", SKIP),
    ], PROGRAMS)
    ran = {(r.program_id, r.path[-5], r.cmd, r.outcome) for r in program_run(library, stored).collect()}
    assert ran == {
        ("all", "a", "skip", "skipped"), ("all", "d", "skip", "skipped"), ("all", "e", "skip", "skipped"),
        ("films", "a", None, "skipped"), ("films", "b", None, "skipped"),
        *{("lib", f, "transcode", "tracked") for f in "abcd"},
    }


def test_violations_are_all_listed(spark, rows):
    text = json.dumps([{"when": [{"field": "size", "op": "gt", "value": "1"}, {"field": "width", "op": "le", "value": "2"},
                                 {"field": "ext", "op": "eq", "value": "x"}], "do": {"cmd": "skip", "args": None}}])
    stored = spark.createDataFrame([("p", "p", "", "/", "", text)], PROGRAMS)
    found = rules.rule_violations(read_programs(stored)).select("id", "cond_ix", "problem", "valid_ops")
    assert sorted(rows(found)) == [("p", 0, "unknown_field", None), ("p", 1, "invalid_op", "gt, lt")]
