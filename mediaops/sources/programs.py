"""Stored rule programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas

#: extensions a program scans when it names none
DEFAULT_EXTENSIONS = "mkv,mp4,avi"


def read_programs(programs: DataFrame) -> DataFrame:
    """Programs with ``ext`` and ``rules`` as arrays.

    Missing rules are an empty list. Text that is not valid JSON gives NULL rules
    and ``rules_corrupt``.
    """
    text = F.coalesce(F.nullif("rules_json", F.lit("")), F.lit("[]"))
    rules = F.from_json(text, schemas.RULES)
    extensions = F.split(F.coalesce(F.nullif("ext", F.lit("")), F.lit(DEFAULT_EXTENSIONS)), ",")
    parsed = programs.withColumns({"ext": extensions, "rules": rules}).drop("rules_json")
    return parsed.withColumn("rules_corrupt", F.col("rules").isNull())


def list_programs(programs: DataFrame) -> DataFrame:
    """All programs, ordered by name."""
    return read_programs(programs).orderBy("name", "id")


def program_by_id(programs: DataFrame, program_id: str) -> DataFrame:
    """The one stored program of that id; empty when unknown."""
    return read_programs(programs.filter(F.col("id") == program_id))
