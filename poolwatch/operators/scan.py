"""Ordered operators over keys that may be hot.

A plain window keeps all rows of a key in one task. Here the order is cut into buckets. One
aggregate per (key, bucket) runs along the short list of buckets of a key; its result enters each
bucket as one more row, and the window over all rows stays inside (key, bucket).
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

_FIRST, _ROW, _LAST = 0, 1, 2


def position_bucket(pos: str, width: int = 4096) -> Column:
    return F.floor(F.col(pos) / width)


def time_bucket(ts: str, unit: str = "day") -> Column:
    return F.date_trunc(unit, F.col(ts))


def _along(keys: list[str]):
    buckets = Window.partitionBy(*keys).orderBy("_bucket")
    earlier = buckets.rowsBetween(Window.unboundedPreceding, -1)
    later = buckets.rowsBetween(1, Window.unboundedFollowing)
    return earlier, later


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str, bucket: Column, coarser: Column | None = None
) -> DataFrame:
    """Sum of `value` over the rows of a key up to and including this one.

    `bucket` must grow with `order`; `order` should tell all rows of a key apart. With `coarser`, a
    bucket of the column `_fine`, the buckets themselves are summed in two levels, for keys that
    have very many of them.
    """
    rows = df.withColumns({"_bucket": bucket, "_place": F.lit(_ROW)})
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum(value).alias(value))
    if coarser is None:
        earlier, _ = _along(keys)
        carried = totals.withColumn(value, F.sum(value).over(earlier))
    else:
        upto = running_sum(totals.withColumnRenamed("_bucket", "_fine"), keys, ["_fine"], value, "_upto", coarser)
        carried = upto.select(*keys, F.col("_fine").alias("_bucket"), (F.col("_upto") - F.col(value)).alias(value))
    opening = carried.withColumn("_place", F.lit(_FIRST)).filter(F.col(value).isNotNull())
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_place", *order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    stacked = rows.unionByName(opening, allowMissingColumns=True).withColumn(out, F.sum(value).over(so_far))
    return stacked.filter(F.col("_place") == _ROW).drop("_bucket", "_place")


def nearest(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    newest: dict[str, str] | None = None,
    previous: dict[str, str] | None = None,
    coming: dict[str, str] | None = None,
) -> DataFrame:
    """Nearest non-null values around each row of a key, as new columns.

    `newest` maps a column to be made to the column whose value at or before the row it takes,
    `previous` the same strictly before the row, `coming` at or after it. The values must grow
    with `order`, as times do: then the newest is the greatest so far, and a hash aggregate per
    bucket is enough.
    """
    newest, previous, coming = newest or {}, previous or {}, coming or {}
    back = {f"_b_{c}": c for c in {**newest, **previous}.values()}
    ahead = {f"_a_{c}": c for c in coming.values()}
    rows = df.withColumns(
        {"_bucket": bucket, "_place": F.lit(_ROW)} | {k: F.col(c) for k, c in {**back, **ahead}.items()}
    )
    earlier, later = _along(keys)
    per_bucket = rows.groupBy(*keys, "_bucket").agg(
        *[F.max(k).alias(k) for k in back], *[F.min(k).alias(k) for k in ahead]
    )
    opening = per_bucket.select(
        *keys, "_bucket", F.lit(_FIRST).alias("_place"), *[F.max(k).over(earlier).alias(k) for k in back]
    )
    closing = per_bucket.select(
        *keys, "_bucket", F.lit(_LAST).alias("_place"), *[F.min(k).over(later).alias(k) for k in ahead]
    )
    for edge in [opening] * bool(back) + [closing] * bool(ahead):
        rows = rows.unionByName(edge, allowMissingColumns=True)

    inside = Window.partitionBy(*keys, "_bucket").orderBy("_place", *order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    onward = inside.rowsBetween(0, Window.unboundedFollowing)
    found = {out: F.max(f"_b_{c}").over(upto) for out, c in newest.items()}
    found |= {out: F.max(f"_b_{c}").over(before) for out, c in previous.items()}
    found |= {out: F.min(f"_a_{c}").over(onward) for out, c in coming.items()}
    return rows.withColumns(found).filter(F.col("_place") == _ROW).drop("_bucket", "_place", *back, *ahead)
