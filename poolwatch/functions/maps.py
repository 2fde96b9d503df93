"""Maps: labels, annotations and configuration."""

from functools import reduce

from pyspark.sql import Column, functions as F


def empty() -> Column:
    return F.create_map().cast("map<string,string>")


def or_empty(m: Column) -> Column:
    return F.coalesce(m, empty())


def literal(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def has_label(labels: str, key: str, value) -> Column:
    return F.try_element_at(F.col(labels), F.lit(key)) == value


def missing_keys(wanted: Column, actual: Column) -> Column:
    """Keys of `wanted` whose value in `actual` differs; an absent key reads as empty text."""
    seen = or_empty(actual)
    return F.map_keys(
        F.map_filter(wanted, lambda k, v: F.coalesce(F.try_element_at(seen, k), F.lit("")) != v)
    )


def contains_all(wanted: Column, actual: Column) -> Column:
    return F.size(missing_keys(wanted, actual)) == 0


def overlay(*layers: Column) -> Column:
    """Merge maps; a later one wins key by key."""
    return reduce(
        lambda low, high: F.map_zip_with(low, high, lambda k, x, y: F.coalesce(y, x)),
        [or_empty(m) for m in layers],
    )


def origin(**layers: Column) -> Column:
    """For each key, the name of the layer its value comes from."""

    def named(name: str, m: Column) -> Column:
        return F.transform_values(or_empty(m), lambda k, v: F.lit(name))

    return overlay(*[named(name, m) for name, m in layers.items()])


def instance_labels(prefix: str, manager: str, pool: str = "pool", pool_type: str = "type") -> Column:
    """Labels a server instance starts with."""
    return ownership_labels(
        prefix, pool=F.col(pool), pool_type=F.col(pool_type), managed_by=F.lit(manager), instance_role=F.lit("active")
    )


def ownership_labels(prefix: str, **labels: Column) -> Column:
    """Labels that say whom a record belongs to, under the cluster's label prefix."""
    return F.create_map(
        *[x for k, v in labels.items() for x in (F.lit(f"{prefix}/{k.replace('_', '-')}"), v)]
    )
