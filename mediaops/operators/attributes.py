"""Probe text parsed into attributes, and the health report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import probe

def _with_landmarks(df: DataFrame, text: str) -> DataFrame:
    # In steps: Spark keeps a costly column that several later ones use instead of
    # copying its expression into each of them. NULL text gives NULLs throughout.
    located = df.withColumn("_lines", F.concat(F.lit("\n"), F.col(text), F.lit("\n")))
    for step in probe.landmarks(F.col("_lines")):
        located = located.withColumns(step)
    return located


def parse_attrs(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace the probe text by flat attribute columns.

    Adds ``probe_ok``, the attributes (all NULL where the probe failed),
    ``surface_depth`` for the hardware decision and ``dolby_vision``.
    """
    probed = F.col(text).isNotNull()
    texts = _with_landmarks(df, text).withColumns(
        {f"_{name}": F.when(probed, value) for name, value in probe.attr_texts(F.col("_lines")).items()}
    )
    numbers = {
        "height": probe.integer_or_zero, "width": probe.integer_or_zero,
        "bitrate": lambda c: F.call_function("div", probe.integer_or_zero(c), F.lit(1000).cast("bigint")),
        "duration": probe.decimal_or_zero,
    }
    return texts.select(
        *[c for c in df.columns if c != text],
        probed.alias("probe_ok"),
        *[F.col(f"_{name}").alias(name) for name in ("video_codec", "audio_codec", "profile", "pix_fmt")],
        *[F.when(probed, number(F.col(f"_{name}"))).alias(name) for name, number in numbers.items()],
        probe.bit_depth(F.col("_pix_fmt")).cast("int").alias("bit_depth"),
        probe.surface_depth(F.col("_pix_fmt")).alias("surface_depth"),
        F.coalesce(probe.has_dolby_vision(F.col(text)), F.lit(False)).alias("dolby_vision"),
    )


def attach_attrs(inventory: DataFrame, attrs: DataFrame) -> DataFrame:
    """Inventory rows with the attributes of their path; NULL where never probed."""
    columns = [c for c in attrs.columns if c not in inventory.columns]
    joined = inventory.join(attrs.select("path", *columns), "path", "left")
    if "probe_ok" not in columns:
        return joined
    return joined.withColumn("probe_ok", F.coalesce("probe_ok", F.lit(False)))


def parse_health(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per file: ``corrupt``, ``has_video``, ``video_codec``, ``duration``."""
    probed = F.col(text).isNotNull()
    health = probe.health_of(F.col("_lines"))
    return _with_landmarks(df, text).select(
        *[c for c in df.columns if c != text], (~probed).alias("corrupt"),
        *[F.when(probed, value).alias(name) for name, value in health.items()],
    )


def health_report(health: DataFrame) -> DataFrame:
    """One row: files, corrupt files, files without video; healthy if none is corrupt."""
    return health.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("corrupt").alias("corrupt"),
        F.count_if(~F.col("corrupt") & ~F.col("has_video")).alias("no_video"),
    ).withColumn("healthy", F.col("corrupt") == 0)


def unhealthy_files(health: DataFrame) -> DataFrame:
    """The paths behind the report, with what is wrong with each."""
    problem = F.when(F.col("corrupt"), F.lit("corrupt")).when(~F.col("has_video"), F.lit("no_video"))
    return health.select("path", problem.alias("problem")).filter(F.col("problem").isNotNull())
