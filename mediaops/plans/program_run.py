"""A program run: stored rule programs over an inventory, and the jobs they open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import action_outcome, run_programs
from ..sources.programs import read_programs


def program_run(files: DataFrame, programs: DataFrame) -> DataFrame:
    """Each (program, file) with its action and what becomes of the job.

    The planner's skip and block tests do not apply to programs.
    """
    decided = run_programs(files, read_programs(programs))
    return decided.withColumn("outcome", action_outcome(F.col("cmd")))
