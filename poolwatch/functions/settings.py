"""Effective pool settings: the value used when a field is present but zero or unusable."""

from pyspark.sql import Column, DataFrame, functions as F

from poolwatch import values as V

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def fraction(col: str) -> Column:
    """A fraction kept as text; null unless it is a plain number."""
    return F.when(F.col(col).rlike(_NUMBER), F.col(col).try_cast("double"))


def metric_type(col: str = "metric_type") -> Column:
    return F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(V.DEFAULT_METRIC_TYPE))


def uses_utilisation(col: str = "metric_type") -> Column:
    return metric_type(col).isin("cpu", "memory")


def target(col: str = "target_per_instance", metric: str = "metric_type") -> Column:
    fallback = F.when(uses_utilisation(metric), V.ZERO_TARGET_PERCENT).otherwise(V.ZERO_TARGET_SESSIONS)
    return F.when(F.col(col) > 0, F.col(col)).otherwise(fallback).cast("int")


def scale_up_threshold(col: str = "scale_up_threshold") -> Column:
    return F.coalesce(F.nullif(fraction(col), F.lit(0.0)), F.lit(V.ZERO_SCALE_UP))


def cooldown_seconds(col: str = "cooldown_seconds") -> Column:
    return F.coalesce(F.nullif(F.col(col), F.lit(0)), F.lit(V.ZERO_COOLDOWN_SECONDS)).cast("int")


def idle_minutes(col: str = "idle_timeout_minutes") -> Column:
    return F.coalesce(F.nullif(F.col(col), F.lit(0)), F.lit(V.ZERO_IDLE_MINUTES)).cast("int")


def effective_settings(pools: DataFrame) -> DataFrame:
    return pools.withColumns(
        {
            "metric_type": metric_type(),
            "target_per_instance": target(),
            "scale_up_threshold": scale_up_threshold(),
            "cooldown_seconds": cooldown_seconds(),
            "idle_timeout_minutes": idle_minutes(),
        }
    )
