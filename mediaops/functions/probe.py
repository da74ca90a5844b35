"""Attributes out of probe text (``key=value`` lines).

A probe prints each stream's name and profile before its ``codec_type`` line and
the picture fields after it. Nearly every file can be read by plain string search
around the first and last video and the first audio stream (:func:`landmarks`).
Where that does not decide (a nameless first stream, a last video stream without a
size), all streams are listed by :func:`streams` and searched in order; the CASE
that chooses is lazy, so only such files pay for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import parse_decimal, parse_integer

# Picture formats the hardware surfaces carry without loss.
EIGHT_BIT_FORMATS = ["yuv420p", "yuvj420p", "nv12", "nv21"]
TEN_BIT_FORMATS = ["yuv420p10le", "p010le"]
DOLBY_VISION_MARK = "DOVI configuration record"


def bit_depth(pix_fmt: Column) -> Column:
    """Bits per component named by a pixel format; 8 when unnamed, 0 for none."""
    named = F.regexp_extract(pix_fmt, r"(\d{1,2})(le|be)$", 1)
    return (
        F.when(pix_fmt == "", F.lit(0))
        .when(named != "", named.try_cast("int"))
        .otherwise(F.when(pix_fmt.isNotNull(), F.lit(8)))
    )


def surface_depth(pix_fmt: Column) -> Column:
    """8 or 10 where a hardware surface fits the format, 0 where software is needed."""
    return (
        F.when(pix_fmt.isin(EIGHT_BIT_FORMATS), F.lit(8))
        .when(pix_fmt.isin(TEN_BIT_FORMATS), F.lit(10))
        .otherwise(F.when(pix_fmt.isNotNull(), F.lit(0)))
    )


def has_dolby_vision(text: Column) -> Column:
    return text.contains(DOLBY_VISION_MARK)


_STREAM = "\ncodec_type="
_VIDEO = "\ncodec_type=video\n"
_AUDIO = "\ncodec_type=audio\n"


def _last_value(block: Column, key: str) -> Column:
    """Value of the last ``key=`` line of a block, else ``''``; the key must follow a newline."""
    tail = F.substring_index(block, f"\n{key}=", -1)
    return F.when(F.contains(block, F.lit(f"\n{key}=")), F.substring_index(tail, "\n", 1)).otherwise(F.lit(""))


def _has(block: Column, key: str) -> Column:
    return F.contains(block, F.lit(f"\n{key}="))


def _first_pix_fmt(block: Column) -> Column:
    return F.regexp_extract(block, r"\npix_fmt=([^\n]+)", 1)


def landmarks(lines: Column) -> list[dict[str, Column]]:
    """Columns that locate the deciding streams, in steps that build on one another.

    ``lines`` is the text between two newlines.
    """
    video_head, audio_head = F.substring_index(lines, _VIDEO, 1), F.substring_index(lines, _AUDIO, 1)

    def rest(head: Column, mark: str) -> Column:
        # From the newline that ends the mark; '' where the mark is absent.
        return F.substr(lines, F.length(head) + len(mark))

    last_video = F.concat(F.lit("\n"), F.substring_index(lines, _VIDEO, -1))
    return [
        {"_video_head": video_head, "_audio_head": audio_head, "_has_video": F.contains(lines, F.lit(_VIDEO))},
        {
            "_video_names": F.substring_index("_video_head", _STREAM, -1),
            "_video_rest": rest(F.col("_video_head"), _VIDEO),
            "_audio_name": F.when(
                F.contains(lines, F.lit(_AUDIO)),
                _last_value(F.substring_index("_audio_head", _STREAM, -1), "codec_name"),
            ).otherwise(F.lit("")),
            "_more_audio": F.contains(rest(F.col("_audio_head"), _AUDIO), F.lit(_AUDIO)),
            "_last_body": F.when(F.col("_has_video"), F.substring_index(last_video, _STREAM, 1)).otherwise(F.lit("")),
        },
        {
            "_video_name": F.when(F.col("_has_video"), _last_value(F.col("_video_names"), "codec_name")).otherwise(F.lit("")),
            "_video_profile": F.when(F.col("_has_video"), _last_value(F.col("_video_names"), "profile")).otherwise(F.lit("")),
            "_first_fmt": F.when(
                F.col("_has_video"), _first_pix_fmt(F.substring_index("_video_rest", _STREAM, 1))
            ).otherwise(F.lit("")),
            "_more_video": F.contains("_video_rest", F.lit(_VIDEO)),
        },
        {
            "_plain": (F.col("_audio_name") != "") | ~F.col("_more_audio"),
            "_plain_video": ~F.col("_more_video") | (
                (F.col("_video_name") != "") & (F.col("_first_fmt") != "")
                & _has(F.col("_last_body"), "height") & _has(F.col("_last_body"), "width")
            ),
        },
    ]


def streams(lines: Column) -> Column:
    """Array of all streams in order, each with its kind, name, profile and body text.

    The text is cut at the ``codec_type`` lines: piece *i* starts with the kind of
    stream *i* and ends with the names that belong to stream *i + 1*.
    """
    pieces = F.split(lines, _STREAM)

    def stream(piece: Column, ix: Column) -> Column:
        names = F.get(pieces, ix - 1)
        return F.struct(
            F.substring_index(piece, "\n", 1).alias("kind"),
            _last_value(names, "codec_name").alias("name"),
            _last_value(names, "profile").alias("profile"),
            F.substr(piece, F.length(F.substring_index(piece, "\n", 1)) + 1).alias("body"),
        )

    return F.filter(F.transform(pieces, stream), lambda s, ix: ix > 0)


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def _named(items: Column) -> Column:
    return _first(F.filter(items, lambda s: s["name"] != ""))


def _last_integer(lines: Column, key: str) -> Column:
    """Value of the last ``key=`` line that holds a 64-bit integer; others are passed over."""
    last = _last_value(lines, key)
    values = F.regexp_extract_all(lines, F.lit(rf"(?<=\n){key}=([+-]?[0-9]+)(?=\n)"), F.lit(1))
    fitting = F.filter(values, lambda v: v.try_cast("bigint").isNotNull())
    searched = F.coalesce(F.try_element_at(fitting, F.lit(-1)), F.lit(""))
    return F.when((last == "") | parse_integer(last).isNotNull(), last).otherwise(searched)


def integer_or_zero(text: Column) -> Column:
    return F.coalesce(parse_integer(text), F.lit(0).cast("bigint"))


def decimal_or_zero(text: Column) -> Column:
    return F.coalesce(parse_decimal(text), F.lit(0.0))


def attr_texts(lines: Column) -> dict[str, Column]:
    """The attributes as text, over ``lines`` and its landmark columns.

    The first named video and audio stream win, the last video stream's size wins,
    a missing stream leaves ``''`` and 0.
    """
    every = streams(lines)
    video = F.filter(every, lambda s: s["kind"] == "video")
    # An unnamed stream does not win, yet its profile stays if no named one follows.
    main = F.coalesce(_named(video), _last(video))
    formats = F.filter(F.transform(video, lambda s: _first_pix_fmt(s["body"])), lambda p: p != "")
    audio = _named(F.filter(every, lambda s: s["kind"] == "audio"))
    empty = F.lit("")

    def picked(plain: str, simple: Column, searched: Column) -> Column:
        return F.when(F.col(plain), simple).otherwise(F.coalesce(searched, empty))

    def size(key: str) -> Column:
        sized = _last(F.filter(video, lambda s: _has(s["body"], key)))
        return picked("_plain_video", _last_value(F.col("_last_body"), key), _last_value(sized["body"], key))

    return {
        "video_codec": picked("_plain_video", F.col("_video_name"), main["name"]),
        "audio_codec": picked("_plain", F.col("_audio_name"), audio["name"]),
        "profile": picked("_plain_video", F.col("_video_profile"), main["profile"]),
        "pix_fmt": picked("_plain_video", F.col("_first_fmt"), _first(formats)),
        "height": size("height"),
        "width": size("width"),
        "bitrate": _last_integer(lines, "bit_rate"),
        "duration": _last_value(lines, "duration"),
    }


def health_of(lines: Column) -> dict[str, Column]:
    """Columns has_video, video_codec and duration over ``lines`` and its landmarks.

    Any video stream counts, named or not.
    """
    searched = _named(F.filter(streams(lines), lambda s: s["kind"] == "video"))["name"]
    settled = (F.col("_video_name") != "") | ~F.col("_more_video")
    return {
        "has_video": F.col("_has_video"),
        "video_codec": F.when(settled, F.col("_video_name")).otherwise(F.coalesce(searched, F.lit(""))),
        "duration": decimal_or_zero(_last_value(lines, "duration")),
    }
