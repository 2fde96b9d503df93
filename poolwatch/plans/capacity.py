"""How many instances each pool wants, what to do about it, and an audit of past shrinking."""

from pyspark.sql import Column, DataFrame, functions as F

from poolwatch import values as V
from poolwatch.functions import settings, states, timing
from poolwatch.operators.scan import nearest, position_bucket, running_sum, time_bucket


def current(rows: DataFrame, as_of: Column, measured_minutes: int, ts: str = "tick") -> DataFrame:
    """Rows of a measurement that counts at a moment: not after it, and no older than that. Plain
    column filters, to go ahead of the joins, so that files of other days are not read."""
    oldest = as_of - F.make_dt_interval(mins=F.lit(measured_minutes))
    return rows.filter((F.col(ts) <= as_of) & (F.col(ts) > oldest))


def newest_utilisation(utilisation: DataFrame, as_of: Column, measured_minutes: int) -> DataFrame:
    """Newest measured mean per pool and resource at a moment."""
    return current(utilisation, as_of, measured_minutes).groupBy(*V.POOL, F.col("resource").alias("metric_type")).agg(
        F.max_by("mean_percent", "tick").alias("mean_percent")
    )


def desired_replicas(
    pools: DataFrame, rollup: DataFrame, utilisation: DataFrame, as_of: Column, measured_minutes: int = V.MEASURED_MINUTES
) -> DataFrame:
    """Replicas every pool wants at a moment, with the rule that decided. A pool that was not
    measured in the minutes before falls back to its minimum."""
    facts = (
        settings.effective_settings(pools)
        .join(rollup, V.POOL, "left")
        .fillna(0, ["running", "ready", "starting", "total", "waiting"])
        .join(newest_utilisation(utilisation, as_of, measured_minutes), V.POOL + ["metric_type"], "left")
        .withColumn("effective_load", F.col("total") + F.col("waiting"))
    )
    load, ready = F.col("effective_load"), F.col("ready")
    goal, low = F.col("target_per_instance"), F.col("min_replicas")

    crowded = F.when(ready > 0, F.try_divide(load, ready) > goal * F.col("scale_up_threshold")).otherwise(False)
    by_sessions = (
        F.when(crowded, F.struct(ready + 1, F.lit("crowded")))
        .when(load > 0, F.struct(F.ceil(load / goal), F.lit("sessions")))
        .otherwise(F.struct(low.cast("bigint"), F.lit("no_load")))
    )
    scaled = F.ceil(ready * F.col("mean_percent") / goal)
    measured = F.col("mean_percent").isNotNull() & (ready > 0)
    by_use = F.when(measured, scaled).otherwise(low.cast("bigint"))
    by_utilisation = F.when(
        (F.col("waiting") > 0) & (by_use == 0), F.struct(F.lit(1).cast("bigint"), F.lit("waiting"))
    ).otherwise(F.struct(by_use, F.when(measured, "utilisation").otherwise("no_measure")))

    choice = F.when(settings.uses_utilisation(), by_utilisation).otherwise(by_sessions)
    return (
        facts.withColumn("choice", choice.cast("struct<n:bigint,reason:string>"))
        .withColumn("desired", F.least(F.greatest("choice.n", "min_replicas"), "max_replicas").cast("int"))
        .select(
            *V.POOL, "effective_load", "running", "ready", "starting", "desired",
            F.col("choice.reason").alias("reason"),
        )
    )


def capacity_plan(pools: DataFrame, desired: DataFrame, load: DataFrame, as_of: Column) -> DataFrame:
    """One row per action: create, remove, drain (loaded, so left alone for now), replace."""
    wants = desired.select(*V.POOL, "running", "starting", "desired").join(
        pools.select(*V.POOL, "last_scale_time", "cooldown_seconds", "drain_before_scale_down"), V.POOL
    )
    missing = F.col("desired") - F.col("running") - F.col("starting")
    create = (
        wants.filter(missing > 0)
        .select(*V.POOL, F.explode(F.sequence(F.lit(1).cast("bigint"), missing)).alias("i"))
        .select(
            *V.POOL, F.lit("create").alias("action"), F.concat_ws("-", "pool", F.lit("new"), "i").alias("instance")
        )
    )
    shrink = wants.filter(
        (F.col("running") > F.col("desired"))
        & timing.cooldown_over("last_scale_time", as_of, settings.cooldown_seconds())
    ).select(*V.POOL, "drain_before_scale_down", (F.col("running") - F.col("desired")).alias("k"))

    ready = load.filter(states.is_ready()).join(shrink, V.POOL).withColumn(
        "removable", F.when(F.col("drain_before_scale_down") & (F.col("active_sessions") > 0), 0).otherwise(1)
    )
    ranked = running_sum(ready, V.POOL, ["pos", "instance"], "removable", "upto", position_bucket("pos"))
    in_reach = F.col("upto") - F.col("removable") < F.col("k")
    give_up = ranked.filter(in_reach).select(
        *V.POOL, F.when(F.col("removable") == 1, "remove").otherwise("drain").alias("action"), "instance"
    )
    replace = load.filter(F.col("state") == V.FAILED).select(*V.POOL, F.lit("replace").alias("action"), "instance")
    return create.unionByName(give_up).unionByName(replace)


def scaling_audit(log: DataFrame, pools: DataFrame) -> DataFrame:
    """Shrink actions with the time since the pool's previous one; only shrinking stamps the
    clock. A pool shrinks at most once per tick, so a day of one pool is a small group."""
    shrinks = log.filter(F.col("action") == "shrink").select(*V.POOL, "action_id", "ts")
    with_last = nearest(shrinks, V.POOL, ["ts", "action_id"], time_bucket("ts"), previous={"previous": "ts"})
    limits = pools.select(*V.POOL, "cooldown_seconds")
    joined = with_last.join(limits, V.POOL, "left").withColumn(
        "cooldown_seconds", settings.cooldown_seconds()
    )
    inside = ~timing.cooldown_over("previous", F.col("ts"), F.col("cooldown_seconds"))
    return joined.select(
        *V.POOL, "action_id", "ts",
        timing.whole_seconds(F.col("previous"), F.col("ts")).alias("seconds_since_previous"),
        inside.alias("inside_cooldown"),
    )
