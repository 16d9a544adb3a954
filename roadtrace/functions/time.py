"""Time column expressions.

All work on ``TIMESTAMP_NTZ`` (wall-clock) so that results do not depend on
the session time zone; ``TIMESTAMP`` inputs are accepted as well.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_seconds(ts) -> Column:
    """Whole seconds since 1970-01-01 00:00 wall-clock (truncated toward zero)."""
    return F.timestamp_diff("SECOND", F.expr(_EPOCH_NTZ), _c(ts).cast("timestamp_ntz"))


def bucket_ntz(ts, seconds: int) -> Column:
    """Start of the ``seconds``-wide bucket holding ``ts`` (buckets aligned to the epoch)."""
    start = F.floor(epoch_seconds(ts) / F.lit(seconds)) * F.lit(seconds)
    return F.timestamp_add("SECOND", start, F.expr(_EPOCH_NTZ))


def seconds_between(start, end) -> Column:
    """whole seconds from ``start`` to ``end``, truncated toward zero."""
    return F.timestamp_diff("SECOND", _c(start), _c(end))


def minutes_between(start, end) -> Column:
    """Whole minutes from ``start`` to ``end``, truncated toward zero (the trip gap unit)."""
    return F.timestamp_diff("MINUTE", _c(start), _c(end))


def duration_between(start, end, unit: str) -> Column:
    """F2/F3 building block: truncated difference in DAY/HOUR/MINUTE/SECOND."""
    return F.timestamp_diff(unit.upper(), _c(start), _c(end))


def iso_weekday(ts) -> Column:
    """ISO day of week, Monday = 1 ... Sunday = 7."""
    return F.weekday(_c(ts)) + 1


def calendar_parts(ts) -> dict[str, Column]:
    """calendar fields used by the plate features."""
    t = _c(ts)
    return {
        "month": F.month(t),
        "day": F.dayofmonth(t),
        "hour": F.hour(t),
        "dayofweek": iso_weekday(t),
    }


def year_month(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")
