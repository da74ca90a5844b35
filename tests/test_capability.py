"""Encoder, codec and decode choices, and the commands that follow from them."""

import pytest
from pyspark.sql import functions as F

from mediaops.operators import capability as cap
from mediaops.operators.work_orders import work_orders
from mediaops.plans.library_run import library_run

TESTED = "host string, codec string, backend string, works boolean, main10 boolean"
REQUEST = "request_id bigint, host string, codec string, hwaccel string"


@pytest.fixture
def tested(spark):
    return spark.createDataFrame([
        ("a", "hevc", "vaapi", True, True), ("a", "hevc", "qsv", True, False), ("a", "hevc", "nvenc", False, False),
        ("a", "av1", "nvenc", False, False), ("a", "h264", "amf", True, False), ("b", "hevc", "videotoolbox", True, False),
    ], TESTED)


@pytest.mark.parametrize(("host", "codec", "mode", "platform", "expected"), [
    ("a", "h265", "auto", "linux", ("hevc_qsv", "qsv")), ("a", "HEVC", "AUTO", "windows", ("hevc_qsv", "qsv")),
    ("a", "h265", "vaapi", "linux", ("hevc_vaapi", "vaapi")), ("a", "h265", "nvenc", "linux", ("libx265", "")),
    ("a", "h265", "none", "linux", ("libx265", "")), ("a", "h265", "", "linux", ("libx265", "")),
    ("a", "av1", "auto", "linux", ("libsvtav1", "")), ("a", "avc", "auto", "linux", ("h264_amf", "amf")),
    ("a", "libfoo", "auto", "linux", ("libfoo", "")), ("b", "h265", "auto", "linux", ("libx265", "")),
    ("b", "h265", "auto", "darwin", ("hevc_videotoolbox", "videotoolbox")), ("z", "h265", "auto", "linux", ("libx265", "")),
    ("a", "h265", "VAAPI", "linux", ("hevc_vaapi", "vaapi")),
])
def test_resolve_encoder(spark, tested, host, codec, mode, platform, expected):
    request = spark.createDataFrame([(1, host, codec, mode)], REQUEST)
    row = cap.resolve_encoder(request, tested, platform=platform).first()
    assert (row.encoder, row.backend) == expected


@pytest.mark.parametrize(("host", "codec", "mode", "expected"), [
    ("a", "av1", "auto", "hevc"), ("a", "h265", "auto", "hevc"), ("a", "h264", "auto", "h264"), ("a", "vp9", "auto", "vp9"),
    ("a", "av1", "none", "av1"), ("b", "av1", "auto", "av1"), ("z", "avc", "auto", "avc"),
])
def test_resolve_codec(spark, tested, host, codec, mode, expected):
    request = spark.createDataFrame([(1, host, codec, mode)], REQUEST)
    assert cap.resolve_codec(request, tested).first().resolved_codec == expected


def test_shape_verdicts(spark, rows):
    hevc10, shape = ("hevc", "Main 10", "yuv420p10le"), "backend string, codec string, profile string, pix_fmt string, seq bigint, outcome string"
    evidence = [("vaapi", *hevc10, 1, "positive"), ("vaapi", *hevc10, 2, "timeout"), ("nvenc", *hevc10, 1, "positive"),
                ("nvenc", *hevc10, 2, "negative"), ("qsv", *hevc10, 1, "positive"), ("qsv", *hevc10, 2, "evict"),
                ("qsv", "h264", "High", "yuv420p", 1, "negative"), ("vaapi", "av1", "Main", "nv12", 1, "cancel"),
                ("amf", *hevc10, 1, "positive")]
    found = cap.shape_verdict(spark.createDataFrame(evidence, shape)).select("backend", "codec", "verdict")
    assert sorted(rows(found)) == [("amf", "hevc", False), ("nvenc", "hevc", False), ("qsv", "h264", False), ("qsv", "hevc", None),
                                   ("vaapi", "hevc", True)]


def test_encoder_evidence_keeps_successes_only(spark, rows):
    evidence = spark.createDataFrame([("e1", "positive"), ("e1", "negative"), ("e2", "negative")], "encoder string, outcome string")
    assert rows(cap.encoder_verdict(evidence, ["encoder"])) == [("e1", True)]


def test_shapes_are_probed_once(spark, rows):
    files = spark.createDataFrame([
        ("/b", "vaapi", True, "hevc", "Main", "nv12", 8, "auto", False), ("/a", "vaapi", True, "hevc", "Main", "nv12", 8, "auto", False),
        ("/c", "nvenc", True, "hevc", "Main", "nv12", 8, "", False), ("/d", "vaapi", True, "", "", "", 0, "auto", True),
        ("/e", "vaapi", False, None, None, None, None, "auto", True), ("/f", "", True, "hevc", "Main", "nv12", 8, "auto", True),
        ("/g", "amf", True, "hevc", "Main", "nv12", 8, "auto", True), ("/h", "qsv", True, "hevc", "Main", "nv12", 8, "Off", True),
        ("/i", "qsv", True, "hevc", "Rext", "yuv444p", 0, "auto", True), ("/j", "qsv", True, "hevc", "Main 10", "p010", 10, "auto", False),
        ("/k", "qsv", True, "hevc", "Main 10", "p010", 10, "auto", True), ("/l", "qsv", True, "av1", "Main", "nv12", 8, "auto", True),
    ], "path string, backend string, probe_ok boolean, video_codec string, profile string, pix_fmt string, surface_depth int, hwdecode string, main10 boolean")
    verdicts = spark.createDataFrame([("qsv", "av1", "Main", "nv12", False), ("nvenc", "hevc", "Main", "nv12", None)],
                                     "backend string, codec string, profile string, pix_fmt string, verdict boolean")
    expected = [("nvenc", "hevc", "Main", "nv12", "/c", 1), ("qsv", "hevc", "Main 10", "p010", "/k", 1), ("vaapi", "hevc", "Main", "nv12", "/a", 2)]
    assert sorted(rows(cap.distinct_shapes(files, verdicts))) == expected


ROUTE = ("path string, codec string, encoder string, backend string, preset string, hwdecode string, main10 boolean, probe_ok boolean,"
         " video_codec string, profile string, pix_fmt string, surface_depth int")


@pytest.mark.parametrize(("given", "expected"), [
    # software encoders are left alone
    (("libx265", "", "medium", "auto", True, True, "nv12", 8), ("libx265", "", "", 0, "medium")),
    # decodable 8-bit source
    (("hevc_vaapi", "vaapi", "medium", "auto", True, True, "yuv420p", 8), ("hevc_vaapi", "vaapi", "vaapi", 8, "medium")),
    # decoding switched off still notes the depth
    (("hevc_vaapi", "vaapi", "medium", "off", True, True, "yuv420p10le", 10), ("hevc_vaapi", "vaapi", "", 10, "medium")),
    # 10 bits without a 10-bit encoder: all software, with a preset it knows
    (("hevc_nvenc", "nvenc", "p5", "auto", False, True, "yuv420p10le", 10), ("libx265", "", "", 0, "medium")),
    # shapes that fit no surface
    (("hevc_vaapi", "vaapi", "slow", "auto", True, True, "yuv444p", 0), ("libx265", "", "", 0, "slow")),
    # a failed probe and a missing format change nothing
    (("hevc_vaapi", "vaapi", "slow", "auto", True, False, None, None), ("hevc_vaapi", "vaapi", "", 0, "slow")),
    (("hevc_vaapi", "vaapi", "slow", "auto", True, True, "", 0), ("hevc_vaapi", "vaapi", "", 0, "slow")),
    # no evidence, no hardware decoding
    (("hevc_qsv", "qsv", "slow", "auto", True, True, "yuv420p", 8), ("hevc_qsv", "qsv", "", 8, "slow")),
])
def test_decode_route(spark, given, expected):
    encoder, backend, preset, hwdecode, main10, ok, pix, depth = given
    row = ("/a", "h265", encoder, backend, preset, hwdecode, main10, ok, "hevc" if ok else None, "Main" if ok else None, pix, depth)
    verdicts = spark.createDataFrame([("vaapi", "hevc", "Main", p, True) for p in ("yuv420p", "yuv420p10le", "yuv444p")],
                                     "backend string, codec string, profile string, pix_fmt string, verdict boolean")
    got = cap.decode_route(spark.createDataFrame([row], ROUTE), verdicts).first()
    assert (got.route_encoder, got.route_backend, got.decode_backend, got.source_bit_depth, got.route_preset) == expected


@pytest.mark.parametrize(("backend", "threads", "hwdecode", "decode_hw", "warn", "label"), [
    ("", 0, "auto", False, False, "software (uncapped)"), ("nvenc", 0, "off", False, True, "software (uncapped)"),
    ("nvenc", 0, "auto", True, False, "hw: nvenc (per-file, may fall back)"), ("amf", 1, "auto", False, True, "software (capped at 1 thread)"),
    ("", 4, "auto", False, False, "software (capped at 4 threads)"),
])
def test_resource_profile(spark, backend, threads, hwdecode, decode_hw, warn, label):
    df = spark.createDataFrame([(backend, threads, hwdecode)], "backend string, decode_threads int, hwdecode string")
    row = cap.resource_profile(df).first()
    assert (row.decode_hw, row.warn, row.decode_label) == (decode_hw, warn, label)


ORDER = {"path": "/m/in.mkv", "output_path": "/m/in.out.mkv", "codec": "h265", "encoder": "", "backend": "", "crf": 23, "preset": "",
         "audio_codec": "copy", "audio_bitrate": "", "subs": "copy", "decode_threads": 0, "decode_backend": "", "source_bit_depth": 0,
         "extra_args": []}
ORDER_TYPE = ("path string, output_path string, codec string, encoder string, backend string, crf int, preset string, audio_codec string,"
              " audio_bitrate string, subs string, decode_threads int, decode_backend string, source_bit_depth int, extra_args array<string>")
MAPS = "-map 0:v:0 -map 0:a -map 0:s? -c:s copy"
DEV = "/dev/dri/renderD128"


@pytest.mark.parametrize(("given", "before", "after"), [
    ({"preset": "medium", "extra_args": ["-movflags", "+faststart"]}, "", "-c:v libx265 -crf 23 -preset medium -c:a copy -movflags +faststart"),
    ({"codec": "vp9", "crf": 31, "preset": "medium"}, "", "-c:v libvpx-vp9 -crf 31 -b:v 0 -c:a copy"),
    ({"codec": "av1", "crf": 30, "preset": "medium"}, "", "-c:v libsvtav1 -crf 30 -preset 6 -c:a copy"),
    ({"audio_codec": "opus", "audio_bitrate": "128k"}, "", "-c:v libx265 -crf 23 -c:a libopus -b:a 128k"),
    ({"audio_codec": "libfdk_aac"}, "", "-c:v libx265 -crf 23 -c:a libfdk_aac"),
    ({"decode_threads": 2, "source_bit_depth": 10}, "-threads 2", "-c:v libx265 -crf 23 -c:a copy"),
    ({"encoder": "hevc_vaapi", "backend": "vaapi", "decode_backend": "vaapi", "source_bit_depth": 10, "crf": 24, "decode_threads": 4},
     f"-vaapi_device {DEV} -hwaccel vaapi -hwaccel_output_format vaapi", "-c:v hevc_vaapi -rc_mode CQP -qp 24 -profile:v main10 -c:a copy"),
    ({"encoder": "hevc_vaapi", "backend": "vaapi", "source_bit_depth": 8, "decode_threads": 2, "preset": "medium"},
     f"-threads 2 -vaapi_device {DEV}", "-vf format=nv12,hwupload -c:v hevc_vaapi -rc_mode CQP -qp 23 -c:a copy"),
    ({"encoder": "hevc_vaapi", "backend": "vaapi", "source_bit_depth": 10}, f"-vaapi_device {DEV}",
     "-vf format=p010,hwupload -c:v hevc_vaapi -rc_mode CQP -qp 23 -profile:v main10 -c:a copy"),
    ({"encoder": "hevc_qsv", "backend": "qsv", "decode_backend": "qsv", "source_bit_depth": 8},
     "-init_hw_device qsv=qsv:hw_any -hwaccel qsv -hwaccel_output_format qsv", "-c:v hevc_qsv -q:v 23 -c:a copy"),
    ({"encoder": "hevc_qsv", "backend": "qsv", "decode_threads": 4, "preset": "superfast"}, "-threads 4 -init_hw_device qsv=qsv:hw_any",
     "-c:v hevc_qsv -q:v 23 -preset veryfast -c:a copy"),
    ({"encoder": "av1_nvenc", "backend": "nvenc", "decode_backend": "nvenc", "source_bit_depth": 10, "codec": "av1"},
     "-hwaccel cuda -hwaccel_output_format cuda", "-c:v av1_nvenc -rc vbr -cq 23 -c:a copy"),
    ({"encoder": "hevc_nvenc", "backend": "nvenc", "preset": "p5"}, "", "-c:v hevc_nvenc -rc vbr -cq 23 -preset p5 -c:a copy"),
    ({"encoder": "hevc_amf", "backend": "amf"}, "", "-c:v hevc_amf -rc cqp -qp_i 23 -qp_p 23 -c:a copy"),
    ({"encoder": "hevc_videotoolbox", "backend": "videotoolbox"}, "", "-c:v hevc_videotoolbox -q:v 23 -c:a copy"),
])
def test_commands(spark, given, before, after):
    df = spark.createDataFrame([tuple({**ORDER, **given}.values())], ORDER_TYPE)
    args = work_orders(df).first().args
    expected = f"-hide_banner {before} -i /m/in.mkv {MAPS} {after} -y /m/in.transcoded.mkv".split()
    assert args == expected


def test_container_and_subtitles(spark):
    rows = [{**ORDER, "output_path": "/m/in.out.MP4", "subs": "Drop"}, {**ORDER, "output_path": "/m/in.out.mov", "codec": "h264"}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ORDER_TYPE)
    hevc, avc = [" ".join(r.args) for r in work_orders(df).collect()]
    assert "-sn -c:v" in hevc and "-map 0:s?" not in hevc and "-movflags +faststart -tag:v hvc1" in hevc
    assert "+faststart -y" in avc and "hvc1" not in avc


def test_arguments_with_blanks_and_line_breaks_stay_whole(spark):
    odd = {**ORDER, "path": "/m/a b\n'c'.mkv", "output_path": "/m/a b\n'c'.out.mkv", "extra_args": ["-vf", "scale=1: 2", ""]}
    args = work_orders(spark.createDataFrame([tuple(odd.values())], ORDER_TYPE)).first().args
    assert args[args.index("-i") + 1] == odd["path"] and args[-5:-2] == ["-vf", "scale=1: 2", ""] and args[-1] == "/m/a b\n'c'.transcoded.mkv"


def test_a_library_run_end_to_end(spark, tested):
    inventory = spark.createDataFrame([(f"/m/{n}.mkv", f"{n}.mkv", 1, 1, 1) for n in "abc"],
                                      "path string, rel_path string, mtime bigint, links bigint, job_id bigint")
    attrs = spark.createDataFrame([("/m/a.mkv", True, "h264", "High", "yuv420p", 8, False), ("/m/b.mkv", True, "hevc", "Main", "yuv444p", 0, False)],
                                  "path string, probe_ok boolean, video_codec string, profile string, pix_fmt string, surface_depth int, dolby_vision boolean")
    settings = spark.createDataFrame([{
        "job_id": 1, "host": "a", "codec": "av1", "hwaccel": "vaapi", "hwdecode": "auto", "crf": 23, "preset": "medium", "audio_codec": "copy",
        "audio_bitrate": "", "subs": "copy", "decode_threads": 0, "inplace": False, "output_dir": "", "container": "", "suffix": ".out",
        "force": False, "skip_hardlinked": False, "allow_hdr_loss": False, "profile": "", "profile_known": False,
    }]).withColumns({"extra_args": F.array().cast("array<string>"), "codec": F.lit("h265")})
    verdicts = spark.createDataFrame([("vaapi", "h264", "High", "yuv420p", True)],
                                     "backend string, codec string, profile string, pix_fmt string, verdict boolean")
    listing = spark.createDataFrame([("/m/c.out.mkv",)], "path string")
    run = {r.path: r for r in library_run(inventory, attrs, settings, tested, verdicts, listing=listing).collect()}
    assert (run["/m/c.mkv"].reason, run["/m/c.mkv"].args) == ("output_exists", None)
    assert run["/m/a.mkv"].decode_backend == "vaapi" and "-hwaccel" in run["/m/a.mkv"].args
    assert run["/m/b.mkv"].encoder == "libx265" and "-crf" in run["/m/b.mkv"].args
