"""Calendar and chunk expressions over timezone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSTS_PER_BAND = 256

DAY_SECONDS = 86_400


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970-01-01 of a timezone-free timestamp."""
    ts = col(ts)
    return (
        F.unix_date(F.to_date(ts)).cast("long") * DAY_SECONDS
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
        + F.second(ts)
    ).cast("long")


def day_chunk(ts: str | Column, days: int = 7) -> Column:
    """Number of the ``days``-long block that holds ``ts``; grows with time.

    Per-location windows partition by (location, block) so that the history of
    one location is spread over many tasks.
    """
    return F.floor(F.unix_date(F.to_date(col(ts))) / F.lit(days)).cast("long")


def band(value: str | Column, width: float) -> Column:
    """Number of the ``width``-wide band that holds a position."""
    return F.floor(col(value) / F.lit(width)).cast("long")


def hour_start(ts: str | Column) -> Column:
    """Timestamp truncated to the hour, without a detour over the session's zone."""
    ts = col(ts)
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(ts))


def minute_number(ts: str | Column) -> Column:
    """Whole minutes since 1970-01-01."""
    return F.floor(epoch_seconds(ts) / 60).cast("long")
