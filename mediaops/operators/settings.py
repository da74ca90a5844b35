"""Layered settings for many jobs at once: profiles, precedence, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from .. import schemas
from ..functions import codecs
from .joins import lookup_join

# The built-in profiles. Unset fields are None.
BUILTIN_PROFILES = [
    {"name": "web", "codec": "h264", "crf": 23, "preset": "fast", "audio_codec": "aac", "audio_bitrate": "160k",
     "container": "mp4", "extra_args": ["-movflags", "+faststart"],
     "description": "Plays nearly everywhere: H.264 in MP4 that starts before it is loaded."},
    {"name": "web-hevc", "codec": "h265", "crf": 26, "preset": "medium", "audio_codec": "aac", "audio_bitrate": "160k",
     "container": "mp4", "extra_args": ["-tag:v", "hvc1", "-movflags", "+faststart"],
     "description": "H.265 in MP4, tagged hvc1 so that Apple players take it."},
    {"name": "archive", "codec": "h265", "crf": 18, "preset": "slow", "audio_codec": "copy",
     "description": "H.265 at a low CRF to keep for good; sound is copied."},
    {"name": "av1", "codec": "av1", "crf": 30, "preset": "slow", "audio_codec": "opus", "audio_bitrate": "128k",
     "description": "AV1: long to encode, least to store."},
    {"name": "mobile", "codec": "h264", "crf": 26, "preset": "fast", "audio_codec": "aac", "audio_bitrate": "96k",
     "container": "mp4", "extra_args": ["-vf", "scale=-2:720", "-movflags", "+faststart"],
     "description": "H.264 in MP4 scaled to 720 lines for small screens."},
]

# Settings, their type, and whether a profile may set them.
TEXT_SETTINGS = {
    "codec": True, "preset": True, "audio_codec": True, "audio_bitrate": True, "container": True, "subs": True,
    "hwaccel": False, "hwdecode": False, "suffix": False, "output_dir": False,
}
INTEGER_SETTINGS = {"crf": True, "decode_threads": False}
BOOLEAN_SETTINGS = ["inplace", "force", "skip_hardlinked", "allow_hdr_loss"]
#: Lists that a layer replaces as a whole, and what holds when none gives one; profiles have none of them.
LIST_SETTINGS = {"ext": ["mkv", "mp4", "avi"], "skip_source_codecs": []}
#: applied when no layer sets a value
DEFAULTS = {
    "codec": "h265", "preset": "medium", "audio_codec": "copy", "audio_bitrate": "", "container": "", "subs": "copy",
    "hwaccel": "auto", "hwdecode": "auto", "suffix": ".out", "output_dir": "", "crf": 23, "decode_threads": 0,
    "inplace": False, "force": False, "skip_hardlinked": False, "allow_hdr_loss": False,
}
#: an empty text in these counts as unset even when a layer gave it
DEFAULT_WHEN_EMPTY = ["audio_codec", "hwaccel", "hwdecode", "suffix"]


def builtin_profiles(spark: SparkSession) -> DataFrame:
    rows = [tuple(p.get(name) for name in schemas.PROFILES.names) for p in BUILTIN_PROFILES]
    return spark.createDataFrame(rows, schemas.PROFILES)


def overlay_profiles(builtin: DataFrame, user: DataFrame) -> DataFrame:
    """Effective profiles: the user's fields over the built-in ones of the same name.

    Empty text counts as unset; ``crf`` 0 is a value; ``extra_args`` is replaced as
    a whole. ``source`` says built-in, config or overridden.
    """
    b, u = builtin.alias("b"), user.alias("u")

    def layered(name: str, kind: DataType) -> Column:
        mine = F.nullif(F.col(f"u.{name}"), F.lit("")) if kind == schemas.TEXT else F.col(f"u.{name}")
        return F.coalesce(mine, F.col(f"b.{name}")).alias(name)

    source = (
        F.when(F.col("u.name").isNull(), F.lit("built-in"))
        .when(F.col("b.name").isNull(), F.lit("config"))
        .otherwise(F.lit("overridden"))
    )
    return b.join(u, F.col("b.name") == F.col("u.name"), "full").select(
        F.coalesce("b.name", "u.name").alias("name"),
        *[layered(f.name, f.dataType) for f in schemas.PROFILES.fields if f.name != "name"],
        source.alias("source"),
    )


def profile_catalog(profiles: DataFrame) -> DataFrame:
    """The listing of effective profiles, sorted by name."""
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    return profiles.select(
        "name", "source", dash(F.col("codec")).alias("codec"),
        dash(F.col("crf").cast("string")).alias("crf"), dash(F.col("description")).alias("description"),
    ).orderBy("name")


def resolve_aliases(df: DataFrame, codec: str = "codec", audio: str = "audio_codec") -> DataFrame:
    """Add the probe name and encoders that the codec and audio aliases stand for."""
    return df.withColumns({
        "codec_name": codecs.codec_name(F.col(codec)),
        "software_encoder": codecs.software_encoder(F.col(codec)),
        "audio_encoder": codecs.audio_encoder(F.col(audio)),
    })


def _layer(layer: DataFrame, key: str, prefix: str) -> DataFrame:
    """A layer's settings under prefixed names, keyed as given."""
    return layer.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in layer.columns if c != key])


def listed(df: DataFrame, name: str, empty_is_unset: bool = False) -> Column:
    """A list setting of a layer as an array: an array as it is, text (and an array of one text, as a variable gives it) cut at its commas.

    Blanks around items and empty items are dropped. An empty list is a value; with ``empty_is_unset``, empty text is none.
    """
    value = F.col(name)
    cut = lambda text: F.filter(F.transform(F.split(text, ","), lambda item: F.trim(item)), lambda item: item != "")
    if isinstance(df.schema[name].dataType, ArrayType):
        return F.when(F.size(value) == 1, cut(F.get(value, F.lit(0)))).otherwise(value)
    return cut(F.nullif(value, F.lit("")) if empty_is_unset else value)


def resolve_settings(jobs: DataFrame, profiles: DataFrame, *, job_key: str = "job_id",
                     env: tuple[DataFrame, str] | None = None,
                     config: tuple[DataFrame, str] | None = None) -> DataFrame:
    """Effective settings of every job.

    A value explicit on the job wins over the environment, the configuration
    file, the named profile and the built-in default, in that order. ``jobs``
    carries the explicit settings as columns (NULL = not given) and ``profile``;
    ``env`` and ``config`` are pairs of a layer table and the job column it is
    keyed by; an empty text in ``env`` counts as not given. ``extra_args`` is the profile's list
    followed by the job's. ``ext`` and ``skip_source_codecs`` are lists, or text with commas, of which the first layer's replaces the others'.
    """
    given = jobs
    prefixes = ["job"]
    layered = given.select(
        *[F.col(c) if c in _keys(job_key, env, config) else F.col(c).alias(f"job_{c}") for c in given.columns]
    ).withColumn("_profile", F.col("job_profile"))
    for name, source in (("env", env), ("config", config)):
        if source is not None:
            layer, key = source
            layered = lookup_join(layered, _layer(layer, key, name), [key], spread_by=[job_key], grows=name == "env")
            prefixes.append(name)
    by_name = _layer(profiles.withColumnRenamed("name", "_profile"), "_profile", "profile")
    layered = lookup_join(layered, by_name, ["_profile"], spread_by=[job_key])

    def first_given(name: str, from_profile: bool, text: bool) -> Column:
        # A variable that is set to nothing is not set.
        unset = lambda p, c: F.nullif(c, F.lit("")) if text and p == "env" else c
        columns = [unset(p, F.col(f"{p}_{name}")) for p in prefixes if f"{p}_{name}" in layered.columns]
        if from_profile and f"profile_{name}" in layered.columns:
            value = F.col(f"profile_{name}")
            columns.append(F.nullif(value, F.lit("")) if text else value)
        picked = F.coalesce(*columns, F.lit(DEFAULTS[name]))
        if name in DEFAULT_WHEN_EMPTY:
            picked = F.coalesce(F.nullif(picked, F.lit("")), F.lit(DEFAULTS[name]))
        return picked

    def first_list(name: str) -> Column:
        given = [listed(layered, f"{p}_{name}", p == "env") for p in prefixes if f"{p}_{name}" in layered.columns]
        return F.coalesce(*given, F.array(*map(F.lit, LIST_SETTINGS[name])).cast("array<string>"))

    none = F.array().cast("array<string>")
    extra = [F.coalesce("profile_extra_args", none)]
    own = [F.col(f"{p}_extra_args") for p in prefixes if f"{p}_extra_args" in layered.columns]
    if own:
        extra.append(F.coalesce(*own, none))
    return layered.select(
        *_keys(job_key, env, config),
        F.coalesce("job_profile", F.lit("")).alias("profile"),
        F.col("profile_source").isNotNull().alias("profile_known"),
        *[first_given(n, p, True).alias(n) for n, p in TEXT_SETTINGS.items() if n != "container"],
        F.regexp_replace(first_given("container", True, True), r"^\.", "").alias("container"),
        *[first_given(n, p, False).cast("int").alias(n) for n, p in INTEGER_SETTINGS.items()],
        *[first_given(n, False, False).alias(n) for n in BOOLEAN_SETTINGS],
        F.concat(*extra).alias("extra_args"),
        *[first_list(n).alias(n) for n in LIST_SETTINGS],
    )


def _keys(job_key: str, *layers: tuple[DataFrame, str] | None) -> list[str]:
    return list(dict.fromkeys([job_key, *[source[1] for source in layers if source is not None]]))


def validate_settings(settings: DataFrame, job_key: str = "job_id") -> DataFrame:
    """One row per job and problem: all violations, not only the first."""
    lower = lambda name: F.lower(F.col(name))
    problems = {
        "inplace_with_output_dir": F.col("inplace") & (F.col("output_dir") != ""),
        "inplace_with_container": F.col("inplace") & (F.col("container") != ""),
        "unknown_profile": (F.col("profile") != "") & ~F.col("profile_known"),
        "unknown_codec": ~lower("codec").isin(list(codecs.CODEC_NAMES)),
        "crf_out_of_range": ~F.col("crf").between(0, 51),
        "negative_decode_threads": F.col("decode_threads") < 0,
        "unknown_hwaccel": ~lower("hwaccel").isin(codecs.HWACCEL_MODES),
        "unknown_hwdecode": ~lower("hwdecode").isin("", "auto", "off"),
        "unknown_audio_codec": ~lower("audio_codec").isin("", *codecs.AUDIO_ENCODERS),
        "unknown_subs": ~lower("subs").isin("", "copy", "drop"),
    }
    listed = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in problems.items()]))
    return settings.select(job_key, F.explode(listed).alias("problem"))


def resolve_presets(df: DataFrame) -> DataFrame:
    """Add the preset in the encoder's vocabulary (``''`` = leave out), the encoder's
    default and the preset snapped to what the encoder offers."""
    args = (F.col("backend"), F.col("encoder"))
    return df.withColumns({
        "encoder_preset": codecs.encoder_preset(*args, F.col("preset")),
        "default_preset": codecs.default_preset(*args),
        "valid_preset": codecs.valid_preset(*args, F.col("preset")),
    })
