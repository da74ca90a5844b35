"""Reports over the history of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import progress
from ..functions.columns import format_epoch
from ..sources.ledger import history_months, read_history


def recent_history(history: DataFrame, limit: int = 20, *, failed_only: bool = False,
                   tie_break: tuple[str, ...] = ("source_path",), zone: str = "UTC") -> DataFrame:
    """The newest attempts with their display columns.

    Completion times are whole seconds, so ``tie_break`` columns make the order total.
    """
    chosen = history.filter(F.col("status") == "failed") if failed_only else history
    newest = chosen.orderBy(F.col("completed_at").desc(), *tie_break).limit(limit)
    return with_display(newest, zone)


def recent_stored_history(spark: SparkSession, location: str, limit: int = 20, *, failed_only: bool = False,
                          tie_break: tuple[str, ...] = ("source_path",), zone: str = "UTC") -> DataFrame:
    """``recent_history`` of the ledger, reading the newest months only.

    Months are taken from the newest on, twice as many each time, until they hold enough rows: no row of an earlier month
    can then be among the newest. If even all months hold fewer, all are read. Rows without completion time come last.
    """
    stored, months = read_history(spark, location), history_months(spark, location)
    taken = 1
    while True:
        chosen = stored if taken >= len(months) else stored.filter(F.col("completed_month").isin(months[:taken]))
        newest = chosen.filter(F.col("status") == "failed") if failed_only else chosen
        if taken >= len(months) or newest.select("status").limit(limit).count() == limit:
            return recent_history(chosen, limit, failed_only=failed_only, tie_break=tie_break, zone=zone)
        taken *= 2


def with_display(history: DataFrame, zone: str = "UTC") -> DataFrame:
    """Add completion time as text, elapsed time as text and the encoder's label."""
    return history.withColumns({
        "completed": format_epoch(F.col("completed_at"), zone=zone),
        "elapsed": progress.elapsed_label(F.col("elapsed_ms")),
        "encoder_label": F.coalesce(F.nullif("encoder", F.lit("")), F.lit("(unknown)")),
    })


def _saving() -> Column:
    """Did an attempt save space: it succeeded with a smaller, non-empty output?"""
    return (
        (F.col("status") == "done") & (F.col("output_size") > 0) & (F.col("output_size") < F.col("source_size"))
    )


def _bytes_saved(amounts: Column) -> Column:
    return F.coalesce(F.sum(amounts), F.lit(0).cast("bigint")).alias("bytes_saved")


def space_saved(history: DataFrame) -> DataFrame:
    """Total bytes saved, 0 when nothing was. The status test reaches the scan."""
    return history.filter(_saving()).agg(_bytes_saved(F.col("source_size") - F.col("output_size")))


def _saved_per_attempt() -> Column:
    return F.when(_saving(), F.col("source_size") - F.col("output_size"))


def savings_rollup(history: DataFrame) -> DataFrame:
    """Bytes saved and attempts per encoder and target codec, with subtotals.

    ``level`` tells the rows apart: 0 detail, 1 per encoder, 3 everything. The
    subtotals are formed from the few detail rows, not from every attempt again.
    """
    detail = history.groupBy("encoder", "target_codec").agg(
        F.count(F.lit(1)).alias("_attempts"), F.sum(_saved_per_attempt()).alias("_saved")
    )
    return detail.rollup("encoder", "target_codec").agg(
        F.grouping_id().cast("int").alias("level"),
        F.coalesce(F.sum("_attempts"), F.lit(0).cast("bigint")).alias("attempts"),
        _bytes_saved(F.col("_saved")),
    )


def savings_by_day(history: DataFrame) -> DataFrame:
    """Bytes saved and attempts per encoder, target codec and completion day."""
    day = format_epoch(F.col("completed_at"), "yyyy-MM-dd")
    return history.groupBy("encoder", "target_codec", day.alias("day")).agg(
        F.count(F.lit(1)).alias("attempts"),
        _bytes_saved(_saved_per_attempt()),
    )
