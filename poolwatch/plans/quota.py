"""Quota limits, verdicts on waiting sessions, and an audit of what really ran."""

from pyspark.sql import Column, DataFrame, functions as F

from poolwatch import values as V
from poolwatch.functions import states, timing
from poolwatch.operators.scan import running_sum, time_bucket

USER = V.POOL + ["user_name"]


def quota_limits(quotas: DataFrame) -> DataFrame:
    """Override per pool and user: the last row with a positive limit."""
    return (
        quotas.filter("max_sessions_per_user > 0")
        .groupBy(*V.POOL, F.col("match_user").alias("user_name"))
        .agg(F.max_by("max_sessions_per_user", "pos").alias("override"))
    )


def group_quota_limits(users: DataFrame, quotas: DataFrame) -> DataFrame:
    """Override of each (pool, user) in question through a group the user is in. Off unless
    called: limits declared for groups are documented but not enforced.

    `users` has namespace, pool, user_name and groups; `quotas` has match_group. The rules come
    down to one row per pool and group first, so a user meets one row per group.
    """
    group = V.POOL + ["group_name"]
    rules = (
        quotas.filter("max_sessions_per_user > 0")
        .groupBy(*V.POOL, F.col("match_group").alias("group_name"))
        .agg(F.max_by("max_sessions_per_user", "pos").alias("n"), F.max("pos").alias("pos"))
    )
    members = users.select(*USER, F.explode(F.array_distinct("groups")).alias("group_name"))
    return (
        members.join(rules, group)
        .groupBy(*USER)
        .agg(F.max_by("n", "pos").alias("override"))
    )


def user_facts(sessions: DataFrame, quotas: DataFrame) -> DataFrame:
    """Live sessions and override of every (pool, user), in one aggregation of both tables."""
    live = sessions.filter(states.counts_toward_quota()).select(*USER, F.lit(1).alias("live"))
    overrides = quotas.filter("max_sessions_per_user > 0").select(
        *V.POOL, F.col("match_user").alias("user_name"), "pos", F.col("max_sessions_per_user").alias("n")
    )
    return (
        live.unionByName(overrides, allowMissingColumns=True)
        .groupBy(*USER)
        .agg(F.coalesce(F.sum("live"), F.lit(0)).alias("user_live"), F.max_by("n", "pos").alias("override"))
    )


def live_sessions(sessions: DataFrame, by: list[str]) -> DataFrame:
    return sessions.filter(states.counts_toward_quota()).groupBy(*by).agg(F.count("*").alias("live"))


def pool_facts(pools: DataFrame, sessions: DataFrame) -> DataFrame:
    live = live_sessions(sessions, V.POOL).withColumnRenamed("live", "pool_live")
    return (
        pools.select(*V.POOL, "max_sessions_per_user", "max_total_sessions")
        .join(live, V.POOL, "left")
        .fillna(0, ["pool_live"])
        .withColumn("pool_known", F.lit(True))
    )


def quota_check(sessions: DataFrame, pools: DataFrame, quotas: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Verdict on every new session against the snapshot, the session itself not counted. Its columns in `keep`
    come along.

    The user limit is looked at first; a limit of zero or less is none. Counts are joined back
    instead of taken by a window over the pool, so a crowded pool needs no single task.
    """
    new = sessions.filter(states.is_new()).select(*USER, "session", "state", *keep)
    joined = new.join(pool_facts(pools, sessions), V.POOL, "left")
    joined = joined.join(user_facts(sessions, quotas), USER, "left")
    own = states.counts_toward_quota().cast("int")
    used = joined.withColumns(
        {
            "user_used": F.coalesce("user_live", F.lit(0)) - own,
            "user_limit": F.coalesce("override", "max_sessions_per_user"),
            "pool_used": F.col("pool_live") - own,
            "pool_limit": F.col("max_total_sessions"),
        }
    )
    over = lambda n, limit: (F.col(limit) > 0) & (F.col(n) >= F.col(limit))
    verdict = (
        F.when(F.col("pool_known").isNull(), "pool_missing")
        .when(over("user_used", "user_limit"), "user_over_quota")
        .when(over("pool_used", "pool_limit"), "pool_over_quota")
        .otherwise("ok")
    )
    return used.withColumn("verdict", verdict).select(
        *USER, "session", "state", "user_used", "user_limit", "pool_used", "pool_limit", "verdict",
        _message().alias("message"), *keep,
    )


def _message() -> Column:
    """Text of a refusal; empty when there is none."""
    verdict = F.col("verdict")
    # Wording of the refusals.
    return (
        F.when(
            verdict == "user_over_quota",
            F.expr("concat('user ', user_name, ' has reached max sessions (', user_used, '/', user_limit, ')')"),
        )
        .when(
            verdict == "pool_over_quota",
            F.expr("concat('pool ', pool, ' has reached max total sessions (', pool_used, '/', pool_limit, ')')"),
        )
        .when(verdict == "pool_missing", F.expr("concat('pool ', pool, ' not found')"))
        .otherwise("")
    )


def quota_pressure(sessions: DataFrame, pools: DataFrame, quotas: DataFrame) -> DataFrame:
    """Used and allowed sessions of every user with any, `n/limit` as text."""
    limits = pools.select(*V.POOL, "max_sessions_per_user")
    users = user_facts(sessions, quotas).filter("user_live > 0")
    limit = F.coalesce("override", "max_sessions_per_user")
    return users.join(limits, V.POOL).select(
        *USER,
        F.col("user_live").alias("used"),
        limit.alias("user_limit"),
        F.concat_ws("/", "user_live", limit).alias("pressure"),
        ((limit > 0) & (F.col("user_live") >= limit)).alias("full"),
    )


def concurrency(history: DataFrame, keys: list[str]) -> DataFrame:
    """Live sessions per key after each moment at which their number changed.

    Starts and ends at one moment are netted first: that is the rule that an end comes before a
    start, and it bounds a key to one row per moment. The running sum is cut into minutes, and those
    into days, so that a crowded day of one key is many small groups.
    """
    starts = history.select(*keys, F.col("started_at").alias("ts"), F.lit(1).alias("delta"))
    ends = history.filter("ended_at is not null").select(
        *keys, F.col("ended_at").alias("ts"), F.lit(-1).alias("delta")
    )
    net = starts.unionByName(ends).groupBy(*keys, "ts").agg(F.sum("delta").alias("delta"))
    return running_sum(net, keys, ["ts"], "delta", "live", time_bucket("ts", "minute"), time_bucket("_fine"))


def quota_audit(history: DataFrame, limits: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """Peak, first breach and whole minutes over the limit per key.

    A stretch over the limit starts where the number passes the limit and ends where it falls
    back, so its length is a difference of two sums and needs no look at the next row.
    `limits` has the keys and `session_limit`.
    """
    timeline = concurrency(history, keys)
    rows = timeline.join(limits, keys, "left")
    limit, live = F.col("session_limit"), F.col("live")
    over = (limit > 0) & (live > limit)
    was_over = (limit > 0) & (live - F.col("delta") > limit)
    at = timing.whole_seconds(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    now = timing.whole_seconds(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), as_of)
    begins, finishes = over & ~was_over, was_over & ~over
    summed = rows.groupBy(*keys).agg(
        F.max("session_limit").alias("session_limit"),
        F.max("live").alias("peak"),
        F.min(F.when(begins, F.col("ts"))).alias("first_breach"),
        F.count_if(begins).alias("breaches"),
        F.sum(F.when(finishes, at).when(begins, -at).otherwise(0)).alias("closed"),
        (F.count_if(begins) - F.count_if(finishes)).alias("open"),
    )
    return summed.select(
        *keys, "session_limit", "peak", "first_breach", "breaches",
        F.floor((F.col("closed") + F.col("open") * now) / 60).alias("minutes_over"),
    )


def pool_limits(pools: DataFrame) -> DataFrame:
    return pools.select(*V.POOL, F.col("max_total_sessions").alias("session_limit"))


def user_limits(history: DataFrame, pools: DataFrame, quotas: DataFrame) -> DataFrame:
    """Limit of every (pool, user) seen in the history."""
    users = history.select(*USER).distinct()
    with_pool = users.join(pools.select(*V.POOL, "max_sessions_per_user"), V.POOL, "left")
    return with_pool.join(quota_limits(quotas), USER, "left").select(
        *USER, F.coalesce("override", "max_sessions_per_user").alias("session_limit")
    )
