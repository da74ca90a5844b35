"""Small Column helpers shared by the other modules."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER_TEXT = r"^[+-]?[0-9]+$"
DECIMAL_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def as_column(value) -> Column:
    """A Column as it is; anything else as a literal (lists become arrays)."""
    if isinstance(value, Column):
        return value
    if isinstance(value, (list, tuple)):
        if not value:
            return F.array().cast("array<string>")
        return F.array(*[F.lit(v) for v in value])
    return F.lit(value)


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """Value of a small fixed table for ``key``; NULL where there is none."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def all_of(conditions) -> Column:
    """AND of the conditions; true for an empty list."""
    return reduce(and_, conditions, F.lit(True))


def is_true(condition: Column) -> Column:
    """Turn SQL's unknown into false."""
    return F.coalesce(condition, F.lit(False))


def parse_integer(text: Column) -> Column:
    """BIGINT of a plain decimal integer, NULL for any other text and beyond 64 bits.

    A bare cast would also take surrounding blanks, so the text is tested first.
    """
    return F.when(text.rlike(INTEGER_TEXT), text.try_cast("bigint"))


def parse_decimal(text: Column) -> Column:
    """DOUBLE of a plain decimal number, NULL for any other text."""
    return F.when(text.rlike(DECIMAL_TEXT), text.try_cast("double"))


def wall_clock_epoch(ts: Column) -> Column:
    """Unix seconds of a zoneless timestamp read as UTC, whatever the session zone."""
    return (
        F.unix_date(ts.cast("date")).cast("bigint") * 86400
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
        + F.second(ts)
    )


def format_epoch(seconds: Column, pattern: str = "yyyy-MM-dd HH:mm:ss", zone: str = "UTC") -> Column:
    """Text of unix seconds in an explicit zone."""
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")
    )
    local = utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    return F.date_format(local, pattern)
