"""Probe output as a table of (path, text)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_probe_text(spark: SparkSession, location: str, fmt: str = "parquet") -> DataFrame:
    """Stored probe output; NULL text stands for a failed probe."""
    return spark.read.format(fmt).schema(schemas.PROBE_TEXT).load(location)


def read_probe_files(spark: SparkSession, location: str, suffix: str = ".probe", root: str | None = None) -> DataFrame:
    """Probe output kept as one text file per media file, named after it.

    With ``root``, the inventory's name for ``location``, paths below ``location`` are put below it, whatever the store calls
    them; without it they are the files' own paths.

    Spark leaves empty files out, so a failed probe has no row here; attaching the
    attributes to an inventory then marks its file as not probed.
    """
    files = spark.read.text(location, wholetext=True).select("value", F.col("_metadata.file_path").alias("_file"))
    # The path is an encoded URI, in which a plus sign is just a plus sign.
    decoded = F.url_decode(F.replace("_file", F.lit("+"), F.lit("%2B")))
    media = F.regexp_replace(decoded, r"^file:(//)?", "")
    if root is not None:
        # A store may name itself differently in the files' paths than in ``location``, but not the folders.
        folder = re.sub(r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "", location).rstrip("/") + "/"
        plain = F.regexp_replace(decoded, r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "")
        media = F.concat(F.lit(root.rstrip("/") + "/"), F.substr(plain, F.lit(len(folder) + 1)))
    return files.select(F.regexp_replace(media, f"\\Q{suffix}\\E$", "").alias("path"), F.col("value").alias("text"))
