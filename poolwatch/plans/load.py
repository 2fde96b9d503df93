"""Sessions per instance, pool roll-up and pool utilisation."""

from pyspark.sql import DataFrame, functions as F

from poolwatch import values as V
from poolwatch.functions import hosts, states

INSTANCE = V.POOL + ["instance"]


def instance_counts(instances: DataFrame, sessions: DataFrame) -> DataFrame:
    """Held and waiting sessions per (pool, instance), listed instances and others alike.

    Only counts of sessions are shuffled; an instance keeps its state whatever it is.
    """
    counted = (
        sessions.groupBy(*V.POOL, states.clean("assigned_instance").alias("instance"))
        .agg(
            F.sum(states.holds_instance().cast("int")).alias("held"),
            F.sum(states.is_waiting().cast("int")).alias("waiting"),
        )
    )
    listed = instances.select(*INSTANCE, F.col("pos").cast("bigint").alias("pos"), "state", F.lit(True).alias("listed"))
    return (
        listed.join(counted, INSTANCE, "full")
        .select(
            *INSTANCE, "pos", "state", F.coalesce("listed", F.lit(False)).alias("listed"),
            F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("waiting", F.lit(0)).alias("waiting"),
        )
    )


def instance_load(counts: DataFrame) -> DataFrame:
    """Active sessions of every listed instance; sessions on unknown instances drop out."""
    return counts.filter("listed").select(*INSTANCE, "pos", "state", F.col("held").alias("active_sessions"))


def pool_rollup(pools: DataFrame, counts: DataFrame) -> DataFrame:
    """Instances by class, sessions on listed instances and waiting sessions of every pool."""
    listed = F.col("listed")
    per_pool = counts.groupBy(*V.POOL).agg(
        F.count_if(listed).alias("instances"),
        F.count_if(listed & states.counted_as_running()).alias("running"),
        F.count_if(listed & states.is_ready()).alias("ready"),
        F.count_if(listed & states.is_starting()).alias("starting"),
        F.count_if(listed & (F.col("state") == V.FAILED)).alias("failed"),
        F.sum(F.when(listed, F.col("held")).otherwise(0)).alias("total"),
        F.sum("waiting").alias("waiting"),
    )
    names = ["instances", "running", "ready", "starting", "failed", "total", "waiting"]
    return pools.select(*V.POOL).join(per_pool, V.POOL, "left").fillna(0, names)


def counts_by_share(sessions: DataFrame) -> DataFrame:
    """Held and waiting sessions per (pool, instance) of a table in buckets of pool and share: counted inside the
    buckets, and only the counts of shares are brought together."""
    key = [*V.POOL, "share", "instance"]
    inside = sessions.select(*V.POOL, "share", states.clean("assigned_instance").alias("instance"), states.holds_instance().cast("int").alias("held"),
                             states.is_waiting().cast("int").alias("waiting")).groupBy(*key).agg(F.sum("held").alias("held"), F.sum("waiting").alias("waiting"))
    return inside.groupBy(*INSTANCE).agg(F.sum("held").alias("held"), F.sum("waiting").alias("waiting"))


def by_share(pools: DataFrame, shares: int) -> DataFrame:
    """Pools to be joined with a table in buckets of pool and share."""
    return pools.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))


def fleet_rollup(rollup: DataFrame, pools: DataFrame) -> DataFrame:
    """The roll-up of pools summed over regions, types within a region, pools within both, and all. `pools` has
    region and type; `level` counts the columns that are summed over."""
    names = ["instances", "running", "ready", "starting", "failed", "total", "waiting"]
    rows = rollup.join(pools.select(*V.POOL, "region", "type"), V.POOL)
    where = F.concat_ws("/", *V.POOL)
    return rows.withColumn("pool_name", where).rollup("region", "type", "pool_name").agg(
        F.bit_count(F.grouping_id()).alias("level"), F.count("*").alias("pools"), *[F.sum(n).cast("bigint").alias(n) for n in names],
        F.try_divide(F.sum(F.col("total") * 1000000).cast("bigint"), F.sum("ready")).cast("bigint").alias("micro_sessions_per_ready"),
    )


def pod_utilisation(instances: DataFrame, usage: DataFrame, requests: DataFrame) -> DataFrame:
    """Usage and request of each driver pod of a ready instance, per tick and resource.

    Only containers with both a usage and a request count; pods without any request are left out,
    and so are pods with an amount that cannot be read. Amounts are summed exactly and rounded up
    to milli-units once.
    The two small tables meet first, so the usage table is joined once.
    """
    pods = instances.filter(states.is_ready()).select(*V.POOL, hosts.driver_pod().alias("pod"))
    wanted = requests.join(pods, ["namespace", "pod"])
    key = ["namespace", "pod", "container", "resource"]
    return (
        usage.select(*key, "tick", "usage_milli").join(wanted, key)
        .groupBy(*V.POOL, "pod", "tick", "resource")
        .agg(
            F.ceil(F.sum("usage_milli")).cast("bigint").alias("usage"),
            F.ceil(F.sum("request_milli")).cast("bigint").alias("request"),
            F.count_if(F.col("usage_milli").isNull() | F.col("request_milli").isNull()).alias("unreadable"),
        )
        .filter((F.col("request") != 0) & (F.col("unreadable") == 0))
        .drop("unreadable")
    )


def pool_utilisation(instances: DataFrame, usage: DataFrame, requests: DataFrame) -> DataFrame:
    """Unweighted mean over the measured pods of a pool, per tick and resource.

    `mean_percent` is the value decisions use; `mean_micro_percent` is the same in whole
    millionths of a percent, equal on every engine.
    """
    micro = F.expr("(cast(usage as decimal(28,0)) * 100000000) div request")
    return (
        pod_utilisation(instances, usage, requests)
        .withColumn("micro", micro)
        .groupBy(*V.POOL, "tick", "resource")
        .agg(
            F.count("*").alias("measured_pods"),
            F.avg(F.col("usage").cast("double") / F.col("request") * 100).alias("mean_percent"),
            F.expr("sum(micro) div count(*)").alias("mean_micro_percent"),
        )
    )
