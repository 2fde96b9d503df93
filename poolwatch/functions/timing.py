"""Comparisons of clocks. Each compares two instants, so no time zone enters."""

from pyspark.sql import Column, functions as F


def seconds(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))


def minutes(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))


def idle_longer_than(last: str, as_of: Column, limit_minutes: Column) -> Column:
    """Strictly longer; unknown activity is never idle."""
    return F.coalesce(F.col(last) + minutes(limit_minutes) < as_of, F.lit(False))


def cooldown_over(last: str, as_of: Column, cooldown_seconds: Column) -> Column:
    """Strictly over; a pool that never shrank is free to."""
    return F.col(last).isNull() | (F.col(last) + seconds(cooldown_seconds) < as_of)


def whole_seconds(start: Column, end: Column) -> Column:
    """Whole seconds between two instants, cut toward zero."""
    return F.timestamp_diff("SECOND", start, end)


def day_of(ts: str) -> Column:
    return F.col(ts).cast("date")
