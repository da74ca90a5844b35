"""The encoder command line of each planned file, as an array of arguments.

Every option group is one string of arguments held together by a NUL, which no
argument can contain, and NULL where the group is absent. They are joined and
split once per file, which is far cheaper than concatenating a dozen arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codecs, paths
from ..functions.columns import lookup

NUL = "\x00"

# Option groups of the encoder, "{device}" and "{crf}" to be filled in.
DECODE_OPTIONS = {
    "vaapi": "-vaapi_device {device} -hwaccel vaapi -hwaccel_output_format vaapi",
    "qsv": "-init_hw_device qsv=qsv:hw_any -hwaccel qsv -hwaccel_output_format qsv",
    "nvenc": "-hwaccel cuda -hwaccel_output_format cuda",
}
ENCODE_DEVICE = {"vaapi": "-vaapi_device {device}", "qsv": "-init_hw_device qsv=qsv:hw_any"}
QUALITY_OPTIONS = {
    "nvenc": "-rc vbr -cq {crf}",
    "qsv": "-q:v {crf}",
    "vaapi": "-rc_mode CQP -qp {crf}",
    "amf": "-rc cqp -qp_i {crf} -qp_p {crf}",
    "videotoolbox": "-q:v {crf}",
    "": "-crf {crf}",
}
STREAMS_WITH_SUBTITLES = "-map 0:v:0 -map 0:a -map 0:s? -c:s copy"
STREAMS_ONLY = "-map 0:v:0 -map 0:a -sn"
UPLOAD = {8: "-vf format=nv12,hwupload", 10: "-vf format=p010,hwupload"}
TEN_BIT_PROFILE = "-profile:v main10"
VP9_CONSTANT_QUALITY = "-b:v 0"
AUDIO_COPY = "-c:a copy"
MP4_OPTIONS = "-movflags +faststart"
MP4_HEVC_OPTIONS = "-movflags +faststart -tag:v hvc1"
MP4_FAMILY = [".mp4", ".m4v", ".mov"]
DEFAULT_DEVICE = "/dev/dri/renderD128"


def _words(options: str) -> str:
    return options.replace(" ", NUL)


def _option(options: str) -> Column:
    return F.lit(_words(options))


def _choose(key: Column, table: dict[str, str], device: str = "") -> Column:
    """Option group by key; NULL where the table has none."""
    return lookup(key, {k: _words(v).replace("{device}", device) for k, v in table.items()})


def input_args(device: str) -> Column:
    """What must stand before the input: decode device, or thread cap and encode device."""
    threads = F.col("decode_threads")
    hardware = _choose(F.col("decode_backend"), DECODE_OPTIONS, device)
    cap = F.when(threads > 0, F.concat_ws(NUL, F.lit("-threads"), threads.cast("string")))
    software = F.nullif(F.concat_ws(NUL, cap, _choose(F.col("backend"), ENCODE_DEVICE, device)), F.lit(""))
    return F.coalesce(hardware, software)


def filter_args() -> Column:
    """Upload to the device when frames were decoded in memory, keeping 10 bits."""
    upload = F.when(F.col("source_bit_depth") == 10, _option(UPLOAD[10])).otherwise(_option(UPLOAD[8]))
    return F.when((F.col("decode_backend") == "") & (F.col("backend") == "vaapi"), upload)


def quality_args(encoder: Column) -> Column:
    backend, crf = F.col("backend"), F.col("crf").cast("string")
    known = F.coalesce(_choose(backend, QUALITY_OPTIONS), _option(QUALITY_OPTIONS[""]))
    constant = F.when((backend == "") & (encoder == "libvpx-vp9"), _option(VP9_CONSTANT_QUALITY))
    return F.concat_ws(NUL, F.replace(known, F.lit("{crf}"), crf), constant)


def profile_args(encoder: Column) -> Column:
    """The 10-bit profile, which only hardware HEVC encoders have to be told."""
    needed = (F.col("backend") != "") & (F.col("source_bit_depth") == 10) & encoder.startswith("hevc_")
    return F.when(needed, _option(TEN_BIT_PROFILE))


def audio_args() -> Column:
    codec, rate = F.col("audio_codec"), F.nullif("audio_bitrate", F.lit(""))
    with_rate = F.concat_ws(NUL, F.lit("-c:a"), codecs.audio_encoder(codec), F.concat(F.lit(_words("-b:a ")), rate))
    return F.when(F.lower(codec).isin("", "copy"), _option(AUDIO_COPY)).otherwise(with_rate)


def container_args(destination: Column) -> Column:
    hevc = F.lower("codec").isin("h265", "hevc", "libx265")
    options = F.when(hevc, _option(MP4_HEVC_OPTIONS)).otherwise(_option(MP4_OPTIONS))
    return F.when(F.lower(paths.dotted_ext(destination)).isin(MP4_FAMILY), options)


def work_orders(planned: DataFrame, device: str = DEFAULT_DEVICE) -> DataFrame:
    """Add ``working_path`` and ``args`` to rows of resolved settings.

    Expects path, output_path, codec, encoder (``''`` = from the codec), backend,
    crf, preset, audio_codec, audio_bitrate, subs, decode_threads, decode_backend,
    source_bit_depth and extra_args.
    """
    chosen = F.coalesce(F.nullif("encoder", F.lit("")), codecs.software_encoder(F.col("codec")))
    destination = F.col("output_path")
    prepared = planned.withColumns({
        "_encoder": chosen,
        "working_path": paths.transient_path(destination, F.col("path")),
    }).withColumn("_family", codecs.preset_family(F.col("backend"), F.col("_encoder")))
    encoder = F.col("_encoder")
    command = F.concat_ws(
        NUL,
        F.lit("-hide_banner"),
        input_args(device),
        F.lit("-i"), F.col("path"),
        F.when(F.lower("subs") == "drop", _option(STREAMS_ONLY)).otherwise(_option(STREAMS_WITH_SUBTITLES)),
        filter_args(),
        F.lit("-c:v"), encoder,
        quality_args(encoder), profile_args(encoder),
        F.concat(_option("-preset "), F.nullif(codecs.family_preset(F.col("_family"), F.col("preset")), F.lit(""))),
        audio_args(),
        container_args(destination),
        F.col("extra_args"),
        F.lit("-y"), F.col("working_path"),
    )
    return prepared.withColumn("args", F.split(command, NUL)).drop("_encoder", "_family")
