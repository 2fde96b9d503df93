"""Which pool a request belongs to, and which routes differ from what they should be."""

from pyspark.sql import Column, DataFrame, functions as F

from poolwatch import values as V
from poolwatch.functions import hosts, maps

ROUTE = ["namespace", "route"]
SPEC = ["class", "host", "path", "path_type", "service", "port"]


def pool_by_host(pools: DataFrame) -> DataFrame:
    """First pool of each host in list order."""
    return pools.groupBy("namespace", "host").agg(
        F.min_by("pool", "pos").alias("host_pool"), F.min_by("type", "pos").alias("host_type")
    )


def pool_of_type(pools: DataFrame) -> DataFrame:
    """Number of pools of each type, and the pool where there is exactly one."""
    counted = pools.groupBy("namespace", "type").agg(F.count("*").alias("n"), F.min("pool").alias("first"))
    return counted.select(
        "namespace", "type", F.col("n").alias("pools_of_type"), F.when(F.col("n") == 1, F.col("first")).alias("only_pool")
    )


def route_requests(requests: DataFrame, pools: DataFrame) -> DataFrame:
    """Pool of each request: by host, or without a host the only pool of the door's type."""
    rows = requests.withColumn("host", hosts.request_host())
    rows = rows.join(pool_by_host(pools), ["namespace", "host"], "left")
    doors = pool_of_type(pools).withColumnRenamed("type", "door")
    rows = rows.join(doors, ["namespace", "door"], "left")
    named = F.col("host") != ""
    status = (
        F.when(named & F.col("host_pool").isNull(), "no_pool")
        .when(named & (F.col("host_type") != F.col("door")), "wrong_type")
        .when(named, "ok")
        .when(F.col("pools_of_type").isNull(), "none_of_type")
        .when(F.col("pools_of_type") > 1, "ambiguous")
        .otherwise("ok")
    )
    return rows.select(
        "request_id", "namespace", "user_name", "door", "host",
        F.when(named, F.col("host_pool")).otherwise(F.col("only_pool")).alias("pool"),
        status.alias("status"),
    )


def desired_routes(
    pools: DataFrame,
    prefix: str,
    manager: str,
    service: str,
    proxy_namespace: str | None = None,
) -> DataFrame:
    """The route each pool should have; pools of an unknown type have none.

    `prefix` is the label prefix of the cluster, `manager` the value of its managed-by label and
    `service` the proxy behind all routes.
    """
    kind = F.col("type")

    def per_type(make) -> Column:
        column = F.lit(None)
        for name, route in V.ROUTE.items():
            column = F.when(kind == name, make(route)).otherwise(column)
        return column

    return pools.filter(kind.isin(*V.ROUTE)).select(
        (F.lit(proxy_namespace) if proxy_namespace else F.col("namespace")).alias("namespace"),
        F.concat("pool", per_type(lambda r: F.lit(r["suffix"]))).alias("route"),
        "pool",
        maps.ownership_labels(
            prefix, pool=F.col("pool"), pool_namespace=F.col("namespace"), managed_by=F.lit(manager)
        ).alias("labels"),
        per_type(lambda r: maps.literal(r["annotations"])).alias("annotations"),
        F.lit(V.ROUTE_CLASS).alias("class"),
        "host",
        F.lit(V.ROUTE_PATH).alias("path"),
        F.lit(V.ROUTE_PATH_TYPE).alias("path_type"),
        F.lit(service).alias("service"),
        per_type(lambda r: F.lit(r["port"])).alias("port"),
    )


def route_drift(desired: DataFrame, actual: DataFrame, prefix: str, manager: str) -> DataFrame:
    """Routes to create, update, keep or delete, and the fields that differ.

    Labels and annotations others added are left alone; so are routes somebody else manages.
    """
    want = desired.select(*ROUTE, F.struct("labels", "annotations", *SPEC).alias("w"))
    have = actual.select(*ROUTE, F.struct("labels", "annotations", *SPEC).alias("a"))
    spec = [F.when(~F.col(f"w.{c}").eqNullSafe(F.col(f"a.{c}")), F.lit(c)) for c in SPEC]
    tagged = lambda tag, field: F.transform(
        F.array_sort(maps.missing_keys(F.col(f"w.{field}"), F.col(f"a.{field}"))),
        lambda k: F.concat(F.lit(f"{tag}:"), k),
    )
    differs = F.concat(
        F.array_compact(F.array(*spec)), tagged("label", "labels"), tagged("annotation", "annotations")
    )
    wanted, there = F.col("w").isNotNull(), F.col("a").isNotNull()
    ours = maps.has_label("a.labels", f"{prefix}/managed-by", manager)
    return (
        want.join(have, ROUTE, "full")
        .filter(wanted | ours)
        .withColumn("differs", F.when(wanted & there, F.array_join(differs, ",")).otherwise(""))
        .select(
            *ROUTE,
            F.when(~wanted, "delete").when(~there, "create").when(F.col("differs") == "", "keep")
            .otherwise("update").alias("verdict"),
            "differs",
        )
    )
