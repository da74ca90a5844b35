"""Library tables derived from the sample tables, the same way in Spark and in SQL.

Each view is a list of (column, expression). The expressions are plain SQL that
Spark and DuckDB read alike; ``EPOCH(x)`` stands for the unix seconds of a
zoneless timestamp and is spelled out per engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CODEC = "CASE o_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'h264' WHEN 2 THEN 'hevc' WHEN 3 THEN 'av1' ELSE 'vp9' END"
PROBED = "(o_custkey % 10 <> 0)"
NO_VIDEO = "(o_custkey % 5 = 0)"
EXT = "CASE o_orderkey % 6 WHEN 0 THEN 'mkv' WHEN 1 THEN 'mp4' WHEN 2 THEN 'avi' WHEN 3 THEN 'MP4' WHEN 4 THEN 'txt' ELSE 'mkv' END"
TAG = "CASE WHEN o_orderkey % 13 = 0 THEN '.transcoded' WHEN o_orderkey % 11 = 0 THEN '.out' ELSE '' END"
REL = f"lower(o_orderstatus) || '/' || CAST(o_orderkey AS STRING) || {TAG} || '.' || {EXT}"
SIZE = "CAST(round(o_totalprice * 100) AS BIGINT)"
PIX = "CASE o_orderkey % 5 WHEN 0 THEN 'yuv420p' WHEN 1 THEN 'yuv420p10le' WHEN 2 THEN 'yuv422p10le' WHEN 3 THEN 'nv12' ELSE 'yuv444p' END"


def _when_probed(expr: str, absent: str | None = None) -> str:
    inner = expr if absent is None else f"CASE WHEN {NO_VIDEO} THEN {absent} ELSE {expr} END"
    return f"CASE WHEN {PROBED} THEN {inner} END"


LIBRARY = [
    ("file_id", "o_orderkey"),
    ("owner", "o_custkey"),
    ("rel_path", REL),
    ("path", f"'/lib/' || {REL}"),
    ("ext", f"lower({EXT})"),
    ("size", SIZE),
    ("mtime", "EPOCH(o_orderdate)"),
    ("links", "CAST(CASE WHEN o_orderkey % 9 = 0 THEN 2 ELSE 1 END AS BIGINT)"),
    ("probe_ok", PROBED),
    ("video_codec", _when_probed(CODEC)),
    ("audio_codec", _when_probed("CASE o_custkey % 3 WHEN 0 THEN 'aac' WHEN 1 THEN 'opus' ELSE 'ac3' END")),
    ("height", _when_probed("CAST(CASE o_custkey % 4 WHEN 0 THEN 480 WHEN 1 THEN 720 WHEN 2 THEN 1080 ELSE 2160 END AS BIGINT)", "0")),
    ("width", _when_probed("CAST(CASE o_custkey % 4 WHEN 0 THEN 854 WHEN 1 THEN 1280 WHEN 2 THEN 1920 ELSE 3840 END AS BIGINT)", "0")),
    ("bitrate", _when_probed(f"{SIZE} % 20000")),
    ("duration", _when_probed(f"CAST({SIZE} % 7200 AS DOUBLE)")),
    ("pix_fmt", _when_probed(PIX, "''")),
    ("profile", _when_probed("CASE WHEN o_orderkey % 5 = 1 THEN 'Main 10' ELSE 'Main' END", "''")),
    ("dolby_vision", f"{PROBED} AND NOT {NO_VIDEO} AND o_orderkey % 17 = 0"),
]

#: what the probe printed, one key=value line each
PROBE_TEXT = [
    ("file_id", "file_id"),
    ("path", "path"),
    ("text", """CASE WHEN probe_ok THEN
        CASE WHEN video_codec <> '' THEN
            'codec_name=' || video_codec || chr(10) || 'profile=' || profile || chr(10) || 'codec_type=video' || chr(10)
            || 'width=' || CAST(width AS STRING) || chr(10) || 'height=' || CASE WHEN file_id % 31 = 0 THEN '0000000000000000' ELSE '' END || CAST(height AS STRING) || chr(10)
            || 'pix_fmt=' || pix_fmt || chr(10)
            || CASE WHEN dolby_vision THEN 'side_data_type=DOVI configuration record' || chr(10) ELSE '' END
        ELSE '' END
        || 'codec_name=' || audio_codec || chr(10) || 'profile=LC' || chr(10) || 'codec_type=audio' || chr(10)
        || 'duration=' || CASE WHEN file_id % 19 = 0 THEN 'N/A' ELSE CAST(CAST(duration AS BIGINT) AS STRING) || '.5' END || chr(10)
        || 'bit_rate=' || CASE WHEN file_id % 23 = 0 THEN 'N/A' WHEN file_id % 37 = 0 THEN '1000000000000000999'
            ELSE CAST(bitrate * 1000 + 999 AS STRING) END || chr(10)
    END"""),
]

TRANSCODES = [
    ("source_path", "path"),
    ("source_mtime", "mtime + CASE WHEN l_linestatus = 'O' THEN 86400 ELSE 0 END"),
    ("source_size", "CAST(round(l_extendedprice * 100) AS BIGINT)"),
    ("output_size", """CASE WHEN l_quantity <= 2 THEN CAST(0 AS BIGINT)
        ELSE CAST(floor(round(l_extendedprice * 100) * (1 - l_discount + l_tax)) AS BIGINT) END"""),
    ("encoder", "CASE l_suppkey % 4 WHEN 0 THEN 'libx265' WHEN 1 THEN 'hevc_nvenc' WHEN 2 THEN 'hevc_vaapi' ELSE 'libsvtav1' END"),
    ("backend", "CASE l_suppkey % 4 WHEN 1 THEN 'nvenc' WHEN 2 THEN 'vaapi' ELSE '' END"),
    ("target_codec", "CASE WHEN l_suppkey % 4 = 3 THEN 'av1' ELSE 'h265' END"),
    ("crf", "CAST(18 + l_linenumber AS INT)"),
    ("elapsed_ms", "(l_partkey % 5400) * 1000"),
    ("status", "CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'done' END"),
    ("completed_at", "EPOCH(l_shipdate)"),
    ("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber"),
    ("l_partkey", "l_partkey"), ("l_suppkey", "l_suppkey"),
    ("video_codec", "video_codec"), ("profile", "profile"), ("pix_fmt", "pix_fmt"),
    ("decode_backend", "CASE WHEN l_suppkey % 4 IN (1, 2) AND l_tax > 0.02 THEN CASE WHEN l_suppkey % 4 = 1 THEN 'nvenc' ELSE 'vaapi' END ELSE '' END"),
    ("error_kind", "CASE WHEN l_returnflag <> 'R' THEN '' WHEN l_partkey % 3 = 0 THEN 'os' ELSE 'exec' END"),
    ("cancelled", "l_quantity > 45"),
    ("error_msg", "CASE WHEN l_returnflag = 'R' THEN repeat('frame ' || CAST(l_partkey AS STRING) || ' dropped; ', CAST(1 + l_linenumber * 4 AS INT)) ELSE '' END"),
]
TIE_BREAK = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

RUNS = [
    ("run_id", "c_custkey"),
    ("name", "c_name"),
    ("started_at", "1700000000 + c_custkey * 60"),
    ("status", "CASE c_nationkey % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' WHEN 2 THEN 'cancelled' ELSE 'done' END"),
    ("cancelled_at", "CASE WHEN c_nationkey % 5 = 2 THEN CAST(800000000 + c_custkey * 1000 AS BIGINT) END"),
]

JOBS = [
    ("run_id", "owner"),
    ("source_path", "path"),
    ("status", "CASE o_orderpriority WHEN '1-URGENT' THEN 'done' WHEN '2-HIGH' THEN 'queued' WHEN '3-MEDIUM' THEN 'running' WHEN '4-NOT SPECIFIED' THEN 'failed' ELSE 'skipped' END"),
    ("pct", "CAST(file_id % 101 AS DOUBLE) / 100"),
    ("updated_at", "mtime"),
]

TOTAL_MS = 7_200_000
PROGRESS = [
    ("seq", "event_id"),
    ("ts", "EPOCH(ts)"),
    ("run_id", "user_id % 50"),
    ("user_id", "user_id"),
    ("source_path", "'/lib/p/' || CAST(user_id AS STRING) || '.mkv'"),
    ("line", """CASE WHEN event_type = 'error' THEN 'warning k=' || CAST(event_id AS STRING)
        ELSE 'frame= ' || CAST(event_id AS STRING) || ' fps= 24 time=0' || CAST(event_id % 3 AS STRING)
        || ':' || lpad(CAST(event_id % 60 AS STRING), 2, '0') || ':' || lpad(CAST(user_id % 60 AS STRING), 2, '0')
        || '.' || lpad(CAST(event_id % 100 AS STRING), 2, '0')
        || ' bitrate=1000kbits/s speed=' || CAST(1 + event_id % 4 AS STRING) || '.'
        || lpad(CAST(event_id % 100 AS STRING), 2, '0') || 'x' END"""),
]

EVIDENCE = [
    ("seq", "event_id"),
    ("backend", "CASE user_id % 5 WHEN 0 THEN 'nvenc' WHEN 1 THEN 'qsv' WHEN 2 THEN 'vaapi' WHEN 3 THEN 'amf' ELSE 'videotoolbox' END"),
    ("codec", "CASE event_id % 4 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' WHEN 2 THEN 'av1' ELSE 'vp9' END"),
    ("profile", "CASE WHEN event_id % 5 = 1 THEN 'Main 10' ELSE 'Main' END"),
    ("pix_fmt", PIX.replace("o_orderkey", "event_id")),
    ("outcome", "CASE WHEN (event_id * 7 + user_id) % 11 IN (0, 1, 2, 3, 10) THEN 'positive' WHEN (event_id * 7 + user_id) % 11 < 7 THEN 'negative' WHEN (event_id * 7 + user_id) % 11 = 7 THEN 'timeout' WHEN (event_id * 7 + user_id) % 11 = 8 THEN 'cancel' ELSE 'evict' END"),
]

_RULES_A = """'[{"when":[{"field":"codec","op":"ne","value":"hevc"}],"do":{"cmd":"transcode","args":["--codec","h265"]}},{"when":null,"do":{"cmd":"skip","args":null}}]'"""
_RULES_B = """'[{"when":[{"field":"height","op":"ge","value":"' || CAST(N * 100 AS STRING) || '"},{"field":"ext","op":"eq","value":"MKV"}],"do":{"cmd":"check","args":[]}}]'"""
_RULES_C = """'[{"when":[{"field":"duration","op":"lt","value":"' || CAST(N * 100 AS STRING) || '.5"}],"do":{"cmd":"transcode","args":["--crf","20"]}},{"when":[{"field":"bitrate","op":"gt","value":"fast"}],"do":{"cmd":"check","args":[]}}]'"""


def _rules(key: str, number: str) -> str:
    b, c = (r.replace("N * 100", f"{number} * 100") for r in (_RULES_B, _RULES_C))
    return f"CASE {key} % 5 WHEN 0 THEN '[]' WHEN 1 THEN '' WHEN 2 THEN {_RULES_A} WHEN 3 THEN {b} ELSE {c} END"


#: a program per customer
PROGRAMS = [
    ("id", "CAST(c_custkey AS STRING)"),
    ("name", "c_name"),
    ("schedule", "CASE WHEN c_custkey % 2 = 0 THEN '0 3 * * *' ELSE '' END"),
    ("src", "CASE c_nationkey % 3 WHEN 0 THEN '/lib/f' WHEN 1 THEN '/lib/o' ELSE '/lib/p/' END"),
    ("ext", "CASE c_custkey % 3 WHEN 0 THEN 'mkv,mp4' WHEN 1 THEN '' ELSE '.AVI' END"),
    ("rules_json", _rules("c_custkey", "c_nationkey")),
]
#: a few programs with overlapping roots, one per region
REGION_PROGRAMS = [
    ("id", "CAST(r_regionkey AS STRING)"),
    ("name", "r_name"),
    ("src", "CASE r_regionkey WHEN 0 THEN '/lib/f' WHEN 1 THEN '/lib/o/' WHEN 2 THEN '/lib' WHEN 3 THEN '/' ELSE '/lib/p' END"),
    ("ext", "CASE r_regionkey % 3 WHEN 0 THEN 'mkv,mp4' WHEN 1 THEN '' ELSE '.AVI,mkv' END"),
    ("rules_json", _rules("(r_regionkey + 2)", "(r_regionkey * 4)")),
]
#: programs whose conditions are often invalid, one per part
DRAFT_PROGRAMS = [
    ("id", "CAST(p_partkey AS STRING)"),
    ("name", "p_name"),
    ("src", "'/lib'"),
    ("ext", "''"),
    ("rules_json", """'[{"when":[{"field":"' || FIELD || '","op":"' || OP || '","value":"1"},{"field":"ext","op":"eq","value":"mkv"}],"do":{"cmd":"skip","args":[]}}]'"""),
]
DRAFT_FIELD = "CASE p_partkey % 9 WHEN 0 THEN 'codec' WHEN 1 THEN 'audio' WHEN 2 THEN 'ext' WHEN 3 THEN 'height' WHEN 4 THEN 'width' WHEN 5 THEN 'bitrate' WHEN 6 THEN 'duration' WHEN 7 THEN 'size' ELSE '' END"
DRAFT_OP = "CASE p_size % 7 WHEN 0 THEN 'eq' WHEN 1 THEN 'ne' WHEN 2 THEN 'gt' WHEN 3 THEN 'lt' WHEN 4 THEN 'ge' WHEN 5 THEN 'le' ELSE 'like' END"
DRAFT_PROGRAMS[-1] = ("rules_json", DRAFT_PROGRAMS[-1][1].replace("FIELD", f"({DRAFT_FIELD})").replace("OP", f"({DRAFT_OP})"))

RULE_LINES = [
    ("file_id", "o_orderkey"),
    ("line", """CASE o_orderkey % 12
        WHEN 0 THEN 'when codec ne hevc do transcode --codec h265 --crf ' || CAST(o_orderkey % 52 AS STRING)
        WHEN 1 THEN 'when codec ne hevc and height gt ' || CAST(o_orderkey % 2160 AS STRING) || ' do transcode --codec h265 --crf 24'
        WHEN 2 THEN 'do skip'
        WHEN 3 THEN '  do check  '
        WHEN 4 THEN 'when codec ne do transcode'
        WHEN 5 THEN 'when codec ne hevc transcode ' || CAST(o_orderkey AS STRING)
        WHEN 6 THEN ''
        WHEN 7 THEN 'do'
        WHEN 8 THEN 'when width le ' || CAST(o_orderkey AS STRING) || ' do transcode'
        WHEN 9 THEN 'when height eq 1080 do transcode'
        WHEN 10 THEN 'when codec gt hevc do transcode'
        ELSE 'when nosuchfield eq ' || CAST(o_orderkey AS STRING) || ' do transcode' END"""),
]

_FOLDER = "'n' || CAST(c_nationkey AS STRING) || '/m' || CAST(c_custkey % 4 AS STRING) || '/'"
#: a file of a tree per customer, some with links
TREE = [
    ("rel_path", f"{_FOLDER} || CAST(c_custkey AS STRING) || CASE c_custkey % 5 WHEN 0 THEN '.mkv' WHEN 1 THEN '.MP4' WHEN 2 THEN '.txt' WHEN 3 THEN '.a.mkv' ELSE '' END"),
    ("bytes", "CAST(c_custkey % 100 AS INT)"), ("mtime", "1600000000 + c_custkey"),
    ("symlink", f"CASE WHEN c_custkey % 20 = 0 THEN {_FOLDER} || 'link-' || CAST(c_custkey AS STRING) || '.mp4' END"),
    ("hard_link", f"CASE WHEN c_custkey % 30 = 10 THEN {_FOLDER} || 'hard-' || CAST(c_custkey AS STRING) || '.mkv' END"),
    ("broken_link", f"CASE WHEN c_custkey % 50 = 0 THEN {_FOLDER} || 'broken-' || CAST(c_custkey AS STRING) || '.mkv' END"),
    ("loop", f"CASE WHEN c_custkey % 60 = 0 THEN {_FOLDER} || 'loop-' || CAST(c_custkey AS STRING) || '.mkv' END"),
]


def _lines(*texts: str) -> str:
    """SQL for these lines; what stands in braces is an expression."""
    spelled = [re.sub(r"\{(.*?)\}", r"' || CAST(\1 AS STRING) || '", x) for x in texts]
    return " || ".join(f"'{x}' || chr(10)" for x in spelled)


_HEAD, _OPEN, _SRC = ("#!/bin/sh", "# name: outside"), "# >>> mediaops:manifest v1 >>>", "#src:  /lib/{c_nationkey} "
_CLOSE = ("# <<< mediaops:manifest <<<", "echo done # rule: do check")
_BOTH_RULES = ("# rule: when height gt {c_custkey} and codec ne hevc do transcode --crf 20", "# rule: do skip")
_NAME = "# name: {c_name}"
#: scripts with a manifest block, one per customer: whole ones, ones with other lines and repeated fields, and one for each thing that can be wrong
SCRIPTS = [
    ("script_id", "c_custkey"),
    ("text", f"""CASE c_custkey % 12
        WHEN 0 THEN {_lines(*_HEAD, "echo none")}
        WHEN 1 THEN {_lines(*_HEAD, _OPEN, _NAME, _SRC, *_BOTH_RULES)}
        WHEN 2 THEN {_lines(*_HEAD, _OPEN, _NAME, "# src:", *_BOTH_RULES, *_CLOSE)}
        WHEN 3 THEN {_lines(*_HEAD, _OPEN, _SRC, "# rule: when codec gt hevc do transcode", *_BOTH_RULES, "# rule: when size eq 1 do skip", "# rule: do", *_CLOSE)}
        WHEN 4 THEN {_lines(_OPEN, _SRC, "# rule: when codec ne hevc transcode", "# rule: when codec ne do skip", "# rule: transcode", *_CLOSE)}
        WHEN 5 THEN {_lines(*_HEAD, _OPEN, _NAME, "rule: do check", "", "#", "# note: 1:2", "# ext: mkv", "# ext: .MP4,avi", "# ext:", "# src: /other", _SRC,
                            *_CLOSE, _OPEN, *_BOTH_RULES, *_CLOSE)}
        WHEN 6 THEN {_lines(_OPEN, *_CLOSE)}
        WHEN 7 THEN CAST(NULL AS STRING)
        ELSE {_lines(*_HEAD, _OPEN, _NAME, "# schedule: 0 {c_custkey % 24} * * *", _SRC, "  # ext: mkv,mp4", *_BOTH_RULES, *_CLOSE)} END"""),
]

#: user profiles, one per supplier; three of them named like built-in ones
USER_PROFILES = [
    ("name", "CASE s_suppkey WHEN 0 THEN 'web' WHEN 1 THEN 'archive' WHEN 2 THEN 'mobile' ELSE 'team-' || CAST(s_suppkey AS STRING) END"),
    ("description", "CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END"),
    ("codec", "CASE s_suppkey % 4 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'vp9' WHEN 2 THEN '' ELSE 'h265' END"),
    ("crf", "CASE s_suppkey % 3 WHEN 0 THEN CAST(NULL AS INT) WHEN 1 THEN 0 ELSE 30 END"),
    ("preset", "CASE s_suppkey % 5 WHEN 0 THEN 'slow' ELSE '' END"),
    ("audio_codec", "CASE s_suppkey % 6 WHEN 0 THEN 'opus' END"),
    ("audio_bitrate", "CASE s_suppkey % 6 WHEN 0 THEN '96k' END"),
    ("container", "CASE s_suppkey % 7 WHEN 0 THEN '.mkv' END"),
    ("subs", "CASE s_suppkey % 8 WHEN 0 THEN 'drop' END"),
    ("extra_text", "CASE s_suppkey % 5 WHEN 0 THEN '-tune film' WHEN 1 THEN '' END"),
]

#: jobs with explicit settings (NULL = not given), one per order
JOB_SPECS = [
    ("job_id", "o_orderkey"),
    ("owner", "o_custkey"),
    ("site", "o_custkey % 25"),
    ("profile", "CASE o_orderkey % 8 WHEN 0 THEN 'web' WHEN 1 THEN 'web-hevc' WHEN 2 THEN 'archive' WHEN 3 THEN 'av1' WHEN 4 THEN 'mobile' WHEN 5 THEN 'team-' || CAST(o_custkey % 10 AS STRING) WHEN 6 THEN 'nope' END"),
    ("codec", "CASE o_orderkey % 10 WHEN 0 THEN 'av1' WHEN 1 THEN 'H264' WHEN 2 THEN 'h256' END"),
    ("crf", "CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_orderkey % 60 AS INT) END"),
    ("preset", "CASE WHEN o_orderkey % 14 = 0 THEN 'slow' END"),
    ("audio_codec", "CASE o_orderkey % 20 WHEN 0 THEN 'mp3' WHEN 1 THEN 'wav' WHEN 2 THEN '' END"),
    ("container", "CASE o_orderkey % 48 WHEN 0 THEN 'mkv' WHEN 5 THEN '' END"),
    ("subs", "CASE o_orderkey % 25 WHEN 0 THEN 'drop' WHEN 1 THEN 'burn' END"),
    ("output_dir", "CASE WHEN o_orderkey % 32 = 0 THEN '/out' END"),
    ("decode_threads", "CASE o_orderkey % 40 WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 2 THEN 4 END"),
    ("inplace", "CASE WHEN o_orderkey % 16 = 0 THEN true END"),
    ("extra_text", "CASE WHEN o_orderkey % 6 = 0 THEN '-vf scale=1280:-2' END"),
    ("ext_text", "CASE o_orderkey % 11 WHEN 0 THEN 'mkv webm' WHEN 1 THEN '' WHEN 2 THEN 'ts,m2ts' END"),
    ("skip_text", "CASE o_orderkey % 13 WHEN 0 THEN 'av1' WHEN 1 THEN '' WHEN 2 THEN 'avc VP9' END"),
]
ENV_LAYER = [
    ("owner", "c_custkey"),
    ("hwaccel", "CASE c_nationkey % 4 WHEN 0 THEN 'nvenc' WHEN 1 THEN '' WHEN 2 THEN 'none' WHEN 3 THEN 'cuda' END"),
    ("crf", "CASE WHEN c_nationkey % 5 = 0 THEN CAST(20 + c_nationkey AS INT) END"),
    ("preset", "CASE c_nationkey % 5 WHEN 1 THEN '' WHEN 2 THEN 'slow' END"),
    ("ext", "CASE c_nationkey % 6 WHEN 0 THEN 'mp4, mov,,' WHEN 1 THEN '' WHEN 2 THEN ',' END"),
    ("skip_source_codecs", "CASE c_nationkey % 7 WHEN 0 THEN 'hevc,av1' WHEN 1 THEN '' WHEN 2 THEN 'vp9' END"),
]
CONFIG_LAYER = [
    ("site", "CAST(n_nationkey AS BIGINT)"),
    ("preset", "CASE WHEN n_nationkey % 3 = 0 THEN 'fast' END"),
    ("hwdecode", "CASE n_nationkey % 4 WHEN 0 THEN 'off' WHEN 1 THEN 'never' END"),
    ("audio_codec", "CASE WHEN n_nationkey % 5 = 0 THEN 'opus' END"),
    ("container", "CASE WHEN n_nationkey % 7 = 0 THEN '.mkv' END"),
    ("ext_text", "CASE n_nationkey % 8 WHEN 0 THEN 'avi' WHEN 1 THEN '' WHEN 2 THEN 'mkv .MP4' END"),
    ("skip_text", "CASE n_nationkey % 9 WHEN 0 THEN 'h264' WHEN 1 THEN 'av1 hevc' END"),
]

REQUESTS = [
    ("request_id", "l_orderkey"), ("line", "l_linenumber"), ("part", "l_partkey"),
    ("host", "l_suppkey"),
    ("codec", "CASE l_partkey % 7 WHEN 0 THEN 'h265' WHEN 1 THEN 'HEVC' WHEN 2 THEN 'h264' WHEN 3 THEN 'avc' WHEN 4 THEN 'av1' WHEN 5 THEN 'vp9' ELSE 'libx265' END"),
    ("hwaccel", "CASE l_orderkey % 8 WHEN 0 THEN 'auto' WHEN 1 THEN 'none' WHEN 2 THEN '' WHEN 3 THEN 'nvenc' WHEN 4 THEN 'QSV' WHEN 5 THEN 'vaapi' WHEN 6 THEN 'AUTO' ELSE 'videotoolbox' END"),
]

#: files with a settled encoder, before the per-file decode decision
ROUTED = [
    ("file_id", "file_id"), ("path", "path"), ("probe_ok", "probe_ok"), ("video_codec", "video_codec"),
    ("profile", "profile"), ("pix_fmt", "pix_fmt"),
    ("backend", "CASE file_id % 6 WHEN 1 THEN 'nvenc' WHEN 2 THEN 'qsv' WHEN 3 THEN 'vaapi' WHEN 4 THEN 'amf' WHEN 5 THEN 'nvenc' ELSE '' END"),
    ("codec", "CASE WHEN file_id % 4 = 0 THEN 'av1' ELSE 'h265' END"),
    ("preset", "CASE file_id % 7 WHEN 0 THEN 'p5' WHEN 1 THEN 'medium' WHEN 2 THEN 'superfast' WHEN 3 THEN '' WHEN 4 THEN '6' WHEN 5 THEN 'slow' ELSE 'veryslow' END"),
    ("hwdecode", "CASE WHEN owner % 7 = 0 THEN 'OFF' ELSE 'auto' END"),
    ("main10", "owner % 2 = 0"),
    ("decode_threads", "CAST(file_id % 3 AS INT)"),
    ("crf", "CAST(18 + file_id % 15 AS INT)"),
    ("audio_codec", "CASE file_id % 5 WHEN 0 THEN 'copy' WHEN 1 THEN 'AAC' WHEN 2 THEN 'opus' WHEN 3 THEN '' ELSE 'libfdk_aac' END"),
    ("audio_bitrate", "CASE WHEN file_id % 2 = 0 THEN '160k' ELSE '' END"),
    ("subs", "CASE WHEN file_id % 3 = 0 THEN 'drop' ELSE 'copy' END"),
    ("extra_text", "CASE WHEN file_id % 4 = 1 THEN '-tune film' ELSE '' END"),
]

#: settled settings of one job per host
HOST_JOBS = [
    ("job_id", "s_suppkey"), ("host", "s_suppkey"),
    ("codec", "CASE s_suppkey % 3 WHEN 0 THEN 'av1' WHEN 1 THEN 'h265' ELSE 'h264' END"),
    ("hwaccel", "CASE s_suppkey % 4 WHEN 1 THEN 'none' WHEN 2 THEN 'vaapi' ELSE 'auto' END"),
    ("hwdecode", "CASE WHEN s_suppkey % 7 = 0 THEN 'off' ELSE 'auto' END"),
    ("crf", "CAST(20 + s_suppkey % 10 AS INT)"), ("preset", "'medium'"), ("audio_codec", "'copy'"), ("audio_bitrate", "''"),
    ("subs", "'copy'"), ("decode_threads", "0"), ("inplace", "s_suppkey % 2 = 1"), ("skip_hardlinked", "s_suppkey % 3 = 1"),
    ("force", "false"), ("allow_hdr_loss", "s_suppkey % 10 = 9"), ("output_dir", "''"), ("suffix", "'.out'"),
    ("container", "CASE WHEN s_suppkey % 10 = 4 THEN 'mkv' ELSE '' END"),
    ("ext_text", "CASE s_suppkey % 10 WHEN 5 THEN 'mkv .MP4' ELSE 'mkv mp4 avi txt' END"),
    ("skip_text", "CASE s_suppkey % 10 WHEN 0 THEN 'VP9' WHEN 3 THEN 'AVC' WHEN 6 THEN 'av1 hevc' WHEN 7 THEN 'libx264' ELSE '' END"),
]

_SPARK_EPOCH = ("(CAST(unix_date(CAST({x} AS DATE)) AS BIGINT) * 86400 + hour({x}) * 3600 + minute({x}) * 60"
                " + CAST(floor(second({x})) AS BIGINT))")
_SQL_EPOCH = "CAST(floor(epoch({x})) AS BIGINT)"


def _spell(expr: str, epoch: str) -> str:
    return re.sub(r"EPOCH\(([a-z_]+)\)", lambda m: epoch.format(x=m.group(1)), expr)


def select(df: DataFrame, view: list[tuple[str, str]]) -> DataFrame:
    return df.selectExpr(*[f"{_spell(expr, _SPARK_EPOCH)} AS {name}" for name, expr in view])


def sql_select(view: list[tuple[str, str]], source: str) -> str:
    columns = ", ".join(f"{_spell(expr, _SQL_EPOCH)} AS {name}" for name, expr in view)
    return f"SELECT {columns} FROM {source}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
