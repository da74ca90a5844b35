"""Codec, encoder and preset names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import lookup

# Fixed values -------------------------------------------------------------
#: codec alias -> name the probe reports, also the stem of hardware encoder names
CODEC_NAMES = {
    "h265": "hevc",
    "hevc": "hevc",
    "h264": "h264",
    "avc": "h264",
    "av1": "av1",
    "vp9": "vp9",
}
#: codec alias -> software encoder
SOFTWARE_ENCODERS = {
    "h265": "libx265",
    "hevc": "libx265",
    "h264": "libx264",
    "avc": "libx264",
    "av1": "libsvtav1",
    "vp9": "libvpx-vp9",
}
#: audio alias -> audio encoder
AUDIO_ENCODERS = {
    "copy": "copy",
    "aac": "aac",
    "opus": "libopus",
    "mp3": "libmp3lame",
    "ac3": "ac3",
    "flac": "flac",
}
#: codecs tried for a hardware encoder, best compression first
CODEC_CHAIN = ["av1", "hevc", "h264"]
#: hardware backends by platform, preferred first
BACKEND_PRIORITY = {
    "linux": ["nvenc", "qsv", "vaapi", "amf"],
    "darwin": ["videotoolbox", "nvenc"],
    "windows": ["nvenc", "qsv", "amf"],
}
BACKENDS = ["nvenc", "qsv", "vaapi", "amf", "videotoolbox"]
#: backends that can also decode
DECODE_BACKENDS = ["nvenc", "qsv", "vaapi"]
SOFTWARE_MODES = ["", "none", "software", "sw"]
HWACCEL_MODES = [*SOFTWARE_MODES, "auto", *BACKENDS]

X264_PRESETS = ["ultrafast", "superfast", "veryfast", "faster", "fast", "medium", "slow", "slower", "veryslow"]
NVENC_PRESETS = ["p1", "p2", "p3", "p4", "p5", "p6", "p7"]
QSV_PRESETS = ["veryfast", "faster", "fast", "medium", "slow", "slower", "veryslow"]
SVT_PRESETS = ["2", "4", "6", "8", "10", "12"]
#: x264 speed name -> nvenc name
NVENC_FROM_X264 = {
    "ultrafast": "fast", "superfast": "fast", "veryfast": "fast", "faster": "fast", "fast": "fast",
    "medium": "medium",
    "slow": "slow", "slower": "slow", "veryslow": "slow",
}
QSV_FROM_X264 = {"ultrafast": "veryfast", "superfast": "veryfast"}
SVT_FROM_X264 = {
    "ultrafast": "12", "superfast": "11", "veryfast": "10", "faster": "9", "fast": "8",
    "medium": "6", "slow": "4", "slower": "3", "veryslow": "2",
}
# --------------------------------------------------------------------------

X264_FAMILY = ["libx264", "libx265"]


def codec_name(alias: Column) -> Column:
    """Probe name of a codec alias, ``''`` when unknown."""
    return F.coalesce(lookup(F.lower(alias), CODEC_NAMES), F.lit(""))


def software_encoder(alias: Column) -> Column:
    """Software encoder of a codec alias; other names pass through."""
    return F.coalesce(lookup(F.lower(alias), SOFTWARE_ENCODERS), alias)


def audio_encoder(alias: Column) -> Column:
    return F.coalesce(lookup(F.lower(alias), AUDIO_ENCODERS), alias)


def hardware_encoder(alias: Column, backend: Column) -> Column:
    """``hevc_nvenc`` for (h265, nvenc); NULL when the codec is unknown."""
    return F.concat(lookup(F.lower(alias), CODEC_NAMES), F.lit("_"), F.lower(backend))


def denied_codec_names(denylist) -> list[str]:
    """All codec names a denylist stands for: each item itself and its probe name."""
    items = [str(item).lower() for item in denylist]
    return sorted({n for item in items for n in (item, CODEC_NAMES.get(item, "")) if n})


def is_denied_codec(codec: Column, denylist) -> Column:
    """Whether a probed codec is named by the denylist (a list or an array Column).

    A file without a video codec never matches.
    """
    if isinstance(denylist, Column):
        hit = F.exists(denylist, lambda d: (F.lower(d) == codec) | (codec_name(d) == codec))
    else:
        hit = codec.isin(denied_codec_names(denylist))
    return (codec != "") & hit


def preset_family(backend: Column, encoder: Column) -> Column:
    """Which preset vocabulary an encoder speaks; ``''`` when it takes no preset."""
    software = F.when(encoder.isin(X264_FAMILY), F.lit("x264")).when(encoder == "libsvtav1", F.lit("svt"))
    return F.coalesce(F.when(backend.isin("nvenc", "qsv"), backend).when(backend == "", software), F.lit(""))


def _by_family(tables: dict[str, dict[str, str]]) -> dict[str, str]:
    """One lookup table for all vocabularies, keyed ``family preset``."""
    return {f"{family} {preset}": value for family, table in tables.items() for preset, value in table.items()}


_TRANSLATED = _by_family({"nvenc": NVENC_FROM_X264, "qsv": QSV_FROM_X264, "svt": SVT_FROM_X264})
_OFFERED = {"nvenc": NVENC_PRESETS, "qsv": QSV_PRESETS, "x264": X264_PRESETS, "svt": SVT_PRESETS}
_DEFAULTS = {"nvenc": "p5", "qsv": "medium", "x264": "medium", "svt": "8"}


def encoder_preset(backend: Column, encoder: Column, preset: Column) -> Column:
    """Preset in the encoder's own vocabulary; ``''`` means leave the option out.

    Known speed names are translated. Other values pass through, except that SVT-AV1
    takes numbers only.
    """
    return family_preset(preset_family(backend, encoder), preset)


def family_preset(family: Column, preset: Column) -> Column:
    translated = lookup(F.concat_ws(" ", family, preset), _TRANSLATED)
    passes = family.isin("nvenc", "qsv", "x264") | ((family == "svt") & preset.rlike("^[0-9]+$"))
    return F.coalesce(translated, F.when(passes, preset), F.lit(""))


def preset_choices(backend: Column, encoder: Column) -> Column:
    """Presets offered for an encoder, NULL when it takes none."""
    listed = {family: " ".join(presets) for family, presets in _OFFERED.items()}
    return F.split(lookup(preset_family(backend, encoder), listed), " ")


def default_preset(backend: Column, encoder: Column) -> Column:
    return F.coalesce(lookup(preset_family(backend, encoder), _DEFAULTS), F.lit(""))


def valid_preset(backend: Column, encoder: Column, preset: Column) -> Column:
    """The preset when the encoder offers it, else that encoder's default."""
    offered = [f"{family} {p}" for family, presets in _OFFERED.items() for p in presets]
    kept = F.concat_ws(" ", preset_family(backend, encoder), preset).isin(offered)
    return F.when(kept, preset).otherwise(default_preset(backend, encoder))
