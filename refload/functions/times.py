"""Time arithmetic."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the zone in which log times are shown.
LOG_ZONE = "America/Toronto"


def ntz(at: datetime) -> Column:
    """A time without zone, the same under every session zone."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def seconds_crossed(start: Column, end: Column) -> Column:
    """Number of second boundaries between two times."""
    return F.timestamp_diff("SECOND", _whole(start), _whole(end))


def _whole(ts: Column) -> Column:
    fraction = F.date_format(ts, "SSSSSS").cast("long")
    return F.timestamp_add("MICROSECOND", -fraction, ts)


def zone_time(utc: Column, zone: str = LOG_ZONE) -> Column:
    """Wall clock time in ``zone`` for a time without zone that is in UTC."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def stamp_text(ts: Column) -> Column:
    """Time as sortable text with microseconds."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
