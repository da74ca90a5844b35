"""Paths, codec names, presets, progress and display columns."""

import pytest
from pyspark.sql import functions as F

from mediaops.functions import codecs, paths, progress
from mediaops.functions.columns import format_epoch, parse_decimal, parse_integer, wall_clock_epoch


@pytest.fixture
def value(spark):
    return lambda column: spark.range(1).select(column).first()[0]


def target(path, rel="", inplace=False, output_dir="", suffix=".out", container=""):
    return paths.output_path(F.lit(path), F.lit(rel), inplace=F.lit(inplace), output_dir=F.lit(output_dir),
                             suffix=F.lit(suffix), container=F.lit(container))


@pytest.mark.parametrize(("kwargs", "expected"), [
    ({"path": "/media/a.mkv"}, "/media/a.out.mkv"),
    ({"path": "/media/a.mkv", "inplace": True}, "/media/a.mkv"),
    ({"path": "/media/a.mp4", "suffix": ".enc"}, "/media/a.enc.mp4"),
    ({"path": "/media/a"}, "/media/a.out"),
    ({"path": "/media.d/a"}, "/media.d/a.out"),
    ({"path": "/media/movies/a.mkv", "rel": "movies/a.mkv", "output_dir": "/out"}, "/out/movies/a.mkv"),
    ({"path": "/media/a.mkv", "container": "mp4"}, "/media/a.out.mp4"),
    ({"path": "/media/movies/a.mkv", "rel": "movies/a.mkv", "output_dir": "/out/", "container": "mp4"}, "/out/movies/a.mp4"),
])
def test_output_path(value, kwargs, expected):
    assert value(target(**kwargs)) == expected


@pytest.mark.parametrize(("dst", "src", "expected"), [
    ("/media/a.out.mkv", "/media/a.mkv", "/media/a.transcoded.mkv"),
    ("/out/movies/a.mp4", "/media/movies/a.mkv", "/out/movies/a.transcoded.mp4"),
    ("a.mkv", "/x/b.mkv", "b.transcoded.mkv"),
    ("/a.mkv", "/a.mkv", "/a.transcoded.mkv"),
])
def test_transient_path(value, dst, src, expected):
    assert value(paths.transient_path(F.lit(dst), F.lit(src))) == expected


def test_path_pieces(value):
    assert value(paths.bare_ext(F.lit("/a/B.MKV"))) == "mkv"
    assert value(paths.dotted_ext(F.lit("/a.b/c"))) == ""
    assert value(paths.ancestors(F.lit("/lib/f/1.mkv"))) == ["/", "/lib", "/lib/f"]
    assert value(paths.ancestors(F.lit("1.mkv"))) == []
    assert [value(paths.normalize_root(F.lit(p))) for p in ("/lib/", "/", "/lib")] == ["/lib", "/", "/lib"]
    assert [value(paths.dir_name(F.lit(p))) for p in ("/media/a.mkv", "/a", "a")] == ["/media", "/", "."]
    assert [value(paths.join_path(F.lit(d), F.lit("a"))) for d in ("/x/", "", ".", "/")] == ["/x/a", "a", "a", "/a"]


@pytest.mark.parametrize(("path", "suffix", "own"), [
    ("/a/b.out.mkv", ".out", True), ("/a/b.transcoded.mkv", ".out", True), ("/a/b.mkv", ".out", False),
    ("/a/b.out.mkv", "", False), ("/a/b.transcoded.mkv", "", True), ("/a.out/b.mkv", ".out", False),
])
def test_own_output(value, path, suffix, own):
    assert value(paths.is_own_output(F.lit(path), F.lit(suffix))) is own


@pytest.mark.parametrize(("alias", "name", "software"), [
    ("h265", "hevc", "libx265"), ("HEVC", "hevc", "libx265"), ("h264", "h264", "libx264"), ("avc", "h264", "libx264"),
    ("av1", "av1", "libsvtav1"), ("vp9", "vp9", "libvpx-vp9"), ("libx264", "", "libx264"), ("copy", "", "copy"),
])
def test_codec_names(value, alias, name, software):
    assert value(codecs.codec_name(F.lit(alias))) == name
    assert value(codecs.software_encoder(F.lit(alias))) == software


@pytest.mark.parametrize(("audio", "encoder"), [
    ("copy", "copy"), ("AAC", "aac"), ("opus", "libopus"), ("mp3", "libmp3lame"), ("ac3", "ac3"), ("libfdk_aac", "libfdk_aac"),
])
def test_audio_encoder(value, audio, encoder):
    assert value(codecs.audio_encoder(F.lit(audio))) == encoder


@pytest.mark.parametrize(("backend", "encoder", "preset", "mapped", "valid"), [
    ("", "libx265", "medium", "medium", "medium"), ("", "libx265", "p5", "p5", "medium"), ("", "libx264", "", "", "medium"),
    ("", "libsvtav1", "8", "8", "8"), ("", "libsvtav1", "medium", "6", "8"), ("", "libsvtav1", "ultrafast", "12", "8"),
    ("", "libsvtav1", "odd", "", "8"), ("", "libsvtav1", "13", "13", "8"), ("", "libvpx-vp9", "medium", "", ""),
    ("nvenc", "hevc_nvenc", "p5", "p5", "p5"), ("nvenc", "hevc_nvenc", "superfast", "fast", "p5"),
    ("nvenc", "hevc_nvenc", "veryslow", "slow", "p5"), ("nvenc", "hevc_nvenc", "hq", "hq", "p5"),
    ("qsv", "h264_qsv", "superfast", "veryfast", "medium"), ("qsv", "h264_qsv", "slow", "slow", "slow"),
    ("vaapi", "hevc_vaapi", "medium", "", ""), ("amf", "hevc_amf", "fast", "", ""),
])
def test_presets(value, backend, encoder, preset, mapped, valid):
    args = F.lit(backend), F.lit(encoder), F.lit(preset)
    assert value(codecs.encoder_preset(*args)) == mapped
    assert value(codecs.valid_preset(*args)) == valid


def test_preset_choices(value):
    assert value(codecs.preset_choices(F.lit("qsv"), F.lit("h264_qsv"))) == codecs.QSV_PRESETS
    assert value(codecs.preset_choices(F.lit("vaapi"), F.lit("hevc_vaapi"))) is None


def test_denylist(value):
    denied = lambda codec, items: value(F.coalesce(codecs.is_denied_codec(F.lit(codec), items), F.lit(False)))
    assert denied("av1", ["AV1"]) and denied("hevc", ["h265"]) and denied("mpeg2video", ["mpeg2video"])
    assert not denied("h264", ["h265"]) and not denied("h264", [])
    assert not denied("", ["mpeg2video"]), "a file without video is never denied"
    assert denied("hevc", F.array(F.lit("h265"))) and not denied("", F.array(F.lit("wmv")))


def test_progress_line(value):
    line = F.lit("frame=  120 fps= 24 time=00:01:23.45 bitrate=1000kbits/s speed=1.02x")
    assert value(progress.position_ms(progress.clock_text(line))) == 83450
    assert value(progress.realtime_speed(line)) == 1.02
    assert value(progress.realtime_speed(F.lit("speed=   2.5x"))) == 2.5
    none = F.lit("no timestamp on this line")
    assert value(progress.position_ms(progress.clock_text(none))) is None
    assert value(progress.realtime_speed(none)) is None
    assert value(progress.realtime_speed(F.lit("speed=1.2.3x"))) is None


def test_fraction_and_remaining(value):
    big = lambda n: F.lit(n).cast("bigint")
    assert value(progress.fraction_done(big(50), big(200))) == 0.25
    assert value(progress.fraction_done(big(300), big(200))) == 1.0
    assert value(progress.fraction_done(big(50), big(0))) == 0.0
    assert value(progress.remaining_ms(big(1000), big(4000), F.lit(2.0))) == 1500
    assert value(progress.remaining_ms(big(1000), big(4000), F.lit(0.0))) == 0
    assert value(progress.remaining_ms(big(5000), big(4000), F.lit(2.0))) == 0


@pytest.mark.parametrize(("ms", "text"), [(999, "0s"), (42_000, "42s"), (60_000, "1m0s"), (4_503_000, "75m3s")])
def test_elapsed_label(value, ms, text):
    assert value(progress.elapsed_label(F.lit(ms).cast("bigint"))) == text


@pytest.mark.parametrize(("ms", "text"), [
    (0, "--"), (-5, "--"), (12_000, "12s"), (192_000, "3m12s"), (3_900_000, "1h05m"), (59_600, "1m00s"), (400, "0s"),
])
def test_eta_label(value, ms, text):
    assert value(progress.eta_label(F.lit(ms).cast("bigint"))) == text


def test_error_tail_counts_bytes(value):
    assert value(progress.error_tail(F.lit("short"))) == "short"
    assert value(progress.error_tail(F.lit("x" * 300 + "end"), 5)) == "xxend"
    assert value(progress.error_tail(F.lit("aäb"), 3)) == "äb"
    assert value(progress.error_tail(F.lit("aäb"), 2)) == "�b"


def test_numbers_are_strict(value):
    assert [value(parse_integer(F.lit(t))) for t in ("12", "+3", " 12", "1.5", "", "9" * 30)] == [12, 3, None, None, None, None]
    assert [value(parse_decimal(F.lit(t))) for t in ("1.5", ".5", "2", "1e3", "1.5d", "N/A")] == [1.5, 0.5, 2.0, 1000.0, None, None]


def test_times_do_not_depend_on_the_session_zone(spark, value):
    ts = F.expr("timestamp_ntz'2024-03-31 02:30:00'")
    for zone in ("UTC", "Europe/Berlin"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert value(wall_clock_epoch(ts)) == 1711852200
            assert value(format_epoch(F.lit(1700000000))) == "2023-11-14 22:13:20"
            assert value(format_epoch(F.lit(1700000000), zone="Asia/Tokyo")) == "2023-11-15 07:13:20"
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
