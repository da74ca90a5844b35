"""Probe text against a line-by-line reading of it in plain Python."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediaops.functions import probe
from mediaops.operators.attributes import attach_attrs, health_report, parse_attrs, parse_health, unhealthy_files

COLUMNS = ["video_codec", "audio_codec", "profile", "pix_fmt", "bit_depth", "height", "width", "bitrate", "duration"]


def read_lines(text):
    """What the text says, one line after the other."""
    a = dict.fromkeys(COLUMNS[:4], "") | {"bit_depth": 0, "height": 0, "width": 0, "bitrate": 0, "duration": 0.0}
    kind, name, profile = "", "", ""
    integer = lambda v: int(v) if re.fullmatch(r"[+-]?\d+", v) and abs(int(v)) < 2**63 else None
    for line in text.split("\n"):
        key, eq, value = line.partition("=")
        if not eq:
            continue
        if key == "codec_name":
            name = value
        elif key == "profile":
            profile = value
        elif key == "codec_type":
            kind = value
            if kind == "video" and not a["video_codec"]:
                a["video_codec"], a["profile"] = name, profile
            elif kind == "audio" and not a["audio_codec"]:
                a["audio_codec"] = name
            name = profile = ""
        elif key == "pix_fmt" and kind == "video" and not a["pix_fmt"]:
            a["pix_fmt"] = value
            named = re.search(r"(\d{1,2})(le|be)$", value)
            a["bit_depth"] = 0 if not value else int(named[1]) if named else 8
        elif key in ("height", "width") and kind == "video":
            a[key] = integer(value) or 0
        elif key == "bit_rate" and integer(value) is not None:
            a["bitrate"] = abs(integer(value)) // 1000 * (1 if integer(value) >= 0 else -1)
        elif key == "duration":
            a["duration"] = float(value) if re.fullmatch(r"\d+(\.\d*)?", value) else 0.0
    return tuple(a[c] for c in COLUMNS)


TEN_BIT = """codec_name=hevc
profile=Main 10
codec_type=video
width=3840
height=2160
pix_fmt=yuv420p10le
codec_name=aac
profile=LC
codec_type=audio
duration=4242.5
bit_rate=15000000
"""


def parsed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [tuple(r) for r in parse_attrs(df).orderBy("id").select(*COLUMNS).collect()]


def test_a_ten_bit_film(spark):
    assert parsed(spark, [TEN_BIT]) == [("hevc", "aac", "Main 10", "yuv420p10le", 10, 2160, 3840, 15000, 4242.5)]


HARD = [
    "",
    "no equals sign\n",
    "codec_name=aac\nprofile=LC\ncodec_type=audio\nduration=3\n",
    # cover art after the film: the last sized video stream counts for the size
    TEN_BIT.replace("duration", "codec_name=mjpeg\nprofile=Baseline\ncodec_type=video\nwidth=600\nheight=600\npix_fmt=yuvj420p\nduration"),
    # a nameless first video stream does not win
    "profile=A\ncodec_type=video\nheight=1\ncodec_name=h264\nprofile=B\ncodec_type=video\nwidth=7\npix_fmt=nv12\n",
    # nor do two of them
    "profile=A\ncodec_type=video\nprofile=B\ncodec_type=video\n",
    # the last video stream has no size of its own
    "codec_name=h264\ncodec_type=video\nheight=720\nwidth=1280\ncodec_name=png\ncodec_type=video\npix_fmt=rgb24\n",
    "codec_type=audio\ncodec_name=opus\ncodec_type=audio\ncodec_name=mp3\ncodec_type=audio\n",
    "codec_name=x=y\ncodec_type=video\npix_fmt=a=b\nheight=10=5\n",
    "bit_rate=N/A\nbit_rate=2999\nbit_rate=N/A\nduration=N/A\n",
    "bit_rate=-2999\nduration=12.\n",
    "duration=5\nduration=N/A",
    "codec_type=video\ncodec_type=video\nheight= 12\nwidth=+3\n",
    "codec_type=videos\ncodec_name=a\ncodec_type=video",
    "codec_name=h264\ncodec_type=data\nheight=5\ncodec_type=video\npix_fmt=\npix_fmt=gray16be\n",
    "codec_name=h264\r\ncodec_type=video\r\nheight=5\r\n",
]


def test_hard_texts_read_like_the_lines(spark):
    assert parsed(spark, HARD) == [read_lines(t) for t in HARD]


LINE = st.sampled_from([
    "codec_type=video", "codec_type=video", "codec_type=audio", "codec_type=subtitle", "codec_name=h264", "codec_name=aac",
    "codec_name=", "profile=High", "profile=", "pix_fmt=yuv420p", "pix_fmt=p010le", "pix_fmt=", "height=720", "height=x",
    "width=1280", "bit_rate=5999", "bit_rate=N/A", "duration=1.5", "duration=N/A", "noise", "",
])


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(LINE, max_size=14).map("\n".join), min_size=150, max_size=150))
def test_any_text_reads_like_its_lines(spark, texts):
    assert parsed(spark, texts) == [read_lines(t) for t in texts]


def test_a_long_text_is_read_whole(spark):
    padding = "tag=x\n" * 50_000
    text = padding + TEN_BIT.replace("duration", padding + "duration") + padding
    assert parsed(spark, [text]) == [read_lines(text)]


def test_failed_probe_gives_nulls(spark):
    row = parse_attrs(spark.createDataFrame([(None,)], "text string")).first()
    assert row.probe_ok is False and row.dolby_vision is False
    assert all(row[c] is None for c in [*COLUMNS, "surface_depth"])


@pytest.mark.parametrize(("pix_fmt", "depth", "surface"), [
    ("", 0, 0), ("yuv420p", 8, 8), ("yuvj420p", 8, 8), ("nv12", 8, 8), ("nv21", 8, 8), ("yuv420p10le", 10, 10),
    ("p010le", 10, 10), ("yuv422p10le", 10, 0), ("yuv420p12le", 12, 0), ("p016le", 16, 0), ("gray16be", 16, 0),
    ("yuv444p", 8, 0),
])
def test_depths(spark, pix_fmt, depth, surface):
    c = F.lit(pix_fmt)
    assert tuple(spark.range(1).select(probe.bit_depth(c), probe.surface_depth(c)).first()) == (depth, surface)


def test_dolby_vision_and_attach(spark, rows):
    texts = spark.createDataFrame(
        [("/a", TEN_BIT + "side_data_type=DOVI configuration record\n"), ("/b", None)], "path string, text string"
    )
    files = spark.createDataFrame([("/a",), ("/b",), ("/c",)], "path string")
    joined = attach_attrs(files, parse_attrs(texts)).orderBy("path").select("path", "probe_ok", "video_codec", "dolby_vision")
    assert rows(joined) == [("/a", True, "hevc", True), ("/b", False, None, False), ("/c", False, None, None)]


def test_health(spark, rows):
    texts = spark.createDataFrame([
        ("/film", TEN_BIT), ("/song", HARD[2]), ("/broken", None), ("/nameless", "codec_type=video\n"),
        ("/late", HARD[4]),
    ], "path string, text string")
    health = parse_health(texts)
    by_path = {r.path: (r.corrupt, r.has_video, r.video_codec, r.duration) for r in health.collect()}
    assert by_path == {
        "/film": (False, True, "hevc", 4242.5), "/song": (False, False, "", 3.0), "/broken": (True, None, None, None),
        "/nameless": (False, True, "", 0.0), "/late": (False, True, "h264", 0.0),
    }
    assert rows(health_report(health)) == [(5, 1, 1, False)]
    assert sorted(rows(unhealthy_files(health))) == [("/broken", "corrupt"), ("/song", "no_video")]
