"""Bounded error text."""

from pyspark.sql import Column, functions as F

from poolwatch import values as V


def is_long(message: Column, limit: int = V.MESSAGE_BYTES) -> Column:
    return F.octet_length(message) > limit


def bounded_bytes(message: Column, limit: int = V.MESSAGE_BYTES) -> Column:
    """The message cut to `limit` bytes and marked; bytes, so a character may be split."""
    raw = message.cast("binary")
    cut = F.concat(F.substring(raw, 1, limit), F.lit(V.MESSAGE_SUFFIX).cast("binary"))
    return F.when(is_long(message, limit), cut).otherwise(raw)


def bounded_message(message: Column, limit: int = V.MESSAGE_BYTES) -> Column:
    """The same as readable text; a split character reads as the replacement character."""
    return F.make_valid_utf8(bounded_bytes(message, limit).cast("string"))
