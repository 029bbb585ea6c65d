"""Wall-clock arithmetic that does not depend on the session time zone."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

LOCAL_ZONE = "+02:00"  # the loggers' fixed offset, no daylight saving


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clock_seconds(c) -> Column:
    """Seconds since 1970-01-01 on the stamp's own wall clock."""
    c = _c(c)
    days = F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def minutes_between(later, earlier) -> Column:
    return (clock_seconds(later) - clock_seconds(earlier)) / 60.0


def month_index(c) -> Column:
    """Consecutive month number, used to cut long series into bounded pieces."""
    c = _c(c)
    return (F.year(c) * 12 + F.month(c) - 1).cast("int")


def local_from_utc(c, offset_hours: int = 2) -> Column:
    return _c(c).cast("timestamp_ntz") + F.expr(f"INTERVAL '{offset_hours}' HOUR")
