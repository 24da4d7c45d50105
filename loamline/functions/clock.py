"""Time as a column. Operators that stamp rows take a clock, so tests and replays can give their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Clock = Callable[[], Column]


def iso(stamp: Column) -> Column:
    """A timestamp as ISO text in UTC, to the second."""
    return F.concat(F.date_format(F.convert_timezone(None, F.lit("UTC"), stamp.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def now() -> Column:
    """The current time as ISO text; one value for all rows of a query."""
    return iso(F.current_timestamp())


def fixed(text: str) -> Clock:
    return lambda: F.lit(text)
