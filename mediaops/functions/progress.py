"""Encoder progress lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import parse_decimal

# Fixed patterns of the encoder's progress output.
TIME_PATTERN = r"time=(\d{2}:\d{2}:\d{2}\.\d{2})"
SPEED_PATTERN = r"speed=\s*([\d.]+)x"


def clock_text(line: Column) -> Column:
    """``HH:MM:SS.cc`` of a progress line, ``''`` on a line without ``time=``."""
    return F.regexp_extract(line, TIME_PATTERN, 1)


def position_ms(clock: Column) -> Column:
    """Milliseconds of ``HH:MM:SS.cc``, NULL for any other text."""
    def part(start: int) -> Column:
        return F.substring(clock, start, 2).try_cast("bigint")

    return part(1) * 3600000 + part(4) * 60000 + part(7) * 1000 + part(10) * 10


def realtime_speed(line: Column) -> Column:
    """Encoder speed as a multiple of real time, NULL when absent or malformed."""
    return parse_decimal(F.regexp_extract(line, SPEED_PATTERN, 1))


def fraction_done(current_ms: Column, total_ms: Column) -> Column:
    """0..1, and 0 when the total is unknown."""
    share = F.least(F.lit(1.0), current_ms.cast("double") / total_ms.cast("double"))
    return F.when(total_ms > 0, share).otherwise(F.lit(0.0))


def remaining_ms(current_ms: Column, total_ms: Column, speed: Column) -> Column:
    """Estimated time left, 0 when total or speed is unknown."""
    left = F.floor((total_ms - current_ms).cast("double") / speed).cast("bigint")
    return F.when((total_ms > current_ms) & (speed > 0), left).otherwise(F.lit(0).cast("bigint"))


def speed_label(speed: Column) -> Column:
    """``2.10x``; empty when unknown."""
    return F.when(speed > 0, F.format_string("%.2fx", speed)).otherwise(F.lit(""))


def elapsed_label(ms: Column) -> Column:
    """``0s``, ``42s``, ``75m3s``; hours are never split off."""
    seconds = F.floor(ms / 1000).cast("bigint")
    minutes = F.floor(seconds / 60).cast("bigint")
    return (
        F.when(seconds < 1, F.lit("0s"))
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m"), (seconds % 60).cast("string"), F.lit("s")))
    )


def eta_label(ms: Column) -> Column:
    """``--``, ``12s``, ``3m12s``, ``1h05m``; rounded to whole seconds first."""
    seconds = F.floor((ms + 500) / 1000).cast("bigint")
    hours = F.floor(seconds / 3600).cast("bigint")
    minutes = F.floor(seconds % 3600 / 60).cast("bigint")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return (
        F.when(ms.isNull() | (ms <= 0), F.lit("--"))
        .when(hours > 0, F.concat(hours.cast("string"), F.lit("h"), two(minutes), F.lit("m")))
        .when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m"), two(seconds % 60), F.lit("s")))
        .otherwise(F.concat(seconds.cast("string"), F.lit("s")))
    )


def error_tail(text: Column, size: int = 200) -> Column:
    """Last ``size`` bytes of an error text.

    A character cut in half at the front is shown as the replacement character.
    """
    raw = text.cast("binary")
    tail = F.substring(raw, -size, size).cast("string")
    return F.when(F.octet_length(text) <= size, text).otherwise(F.make_valid_utf8(tail))
