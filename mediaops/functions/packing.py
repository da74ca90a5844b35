"""Orders of several columns as one number, so that aggregations keep them in a fixed-size buffer and need no sort."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "decimal(38,0)"


def _number(value: int) -> Column:
    return F.lit(str(value)).cast(_WIDE)


def packed_order(first: Column, *rest: tuple[Column, int]) -> Column:
    """A number that sorts as the tuple of these whole numbers does: ``rest`` has columns with their digits.

    All but the first must lie between 0 and 10**digits - 1; anything else is an error, as is a tuple of over 38 digits. A NULL counts as -1 in
    the first column and as 0 in the others.
    """
    packed = F.coalesce(first.cast(_WIDE), _number(-1))
    for column, digits in rest:
        value = F.coalesce(column.cast(_WIDE), _number(0))
        inside = F.when((value >= 0) & (value < _number(10**digits)), value).otherwise(
            F.raise_error(F.concat(F.lit(f"does not fit {digits} digits: "), value.cast("string"))).cast(_WIDE))
        packed = (packed * _number(10**digits) + inside).cast(_WIDE)
    return packed
