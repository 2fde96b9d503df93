"""Streaming forms of the jobs. All use event time: a late touch never moves a clock back."""

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from poolwatch import values as V
from poolwatch.functions import settings, states, timing
from poolwatch.plans.quota import USER
from poolwatch.plans.sessions import SESSION
from poolwatch.sources.sinks import checkpointed
from poolwatch.streaming import life, state
from poolwatch.streaming.life import LIFE_OUTPUT, SessionLife
from poolwatch.streaming.state import (
    ASKED, FAILED, NO_ENDPOINT, OK, OPEN, START_OUTPUT, STATE_OUTPUT, SessionClock, StartClock,
)

# The processors travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(state)
cloudpickle.register_pickle_by_value(life)

DELAY = "10 minutes"
# Keys a pool's sessions are dealt to; news of the pool goes to each.
SHARDS = 64
# Keys all sessions are dealt to where no pool matters; to grow with them, as a key's state is read and written whole.
CLOCK_SHARDS = 1024


def _dealt(rows: DataFrame, by: list[str], shards: int):
    """Rows by shards of their sessions."""
    return rows.withColumn("shard", F.pmod(F.xxhash64(*by), F.lit(shards)).cast("int")).groupBy("shard")


def timed(rows: DataFrame, delay: str = DELAY) -> DataFrame:
    """Rows with their event time as an instant and a watermark on it."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def last_activity(activity: DataFrame, keep: str = "1 day", delay: str = DELAY) -> DataFrame:
    """Newest touch per session and stretch of time; update mode. The newest of a session is the greatest of its rows,
    as a touch only moves it ahead. State ends with the stretch, so sessions that are over leave none."""
    return timed(activity, delay).groupBy(*V.POOL, "session", F.window("ts", keep)).agg(F.max("ts").alias("last_activity_at")).drop("window")


def thin_touches(activity: DataFrame, minutes: int = V.TOUCH_MINUTES, delay: str = DELAY) -> DataFrame:
    """At most one touch per session and interval; goes ahead of the jobs that keep state."""
    cell = F.window("ts", f"{minutes} minutes")
    return timed(activity, delay).groupBy(*V.POOL, "session", cell).agg(F.max("ts").alias("ts")).drop("window")


def idle_sessions(activity: DataFrame, pools: DataFrame, delay: str = DELAY) -> DataFrame:
    """Stretches of use per user and pool, emitted once the pool's idle timeout has passed."""
    limits = pools.select(*V.POOL, settings.idle_minutes().alias("idle_minutes"))
    rows = timed(activity, delay).join(limits, V.POOL, "left").fillna(V.ZERO_IDLE_MINUTES, ["idle_minutes"])
    gap = F.concat(F.col("idle_minutes").cast("string"), F.lit(" minutes"))
    return (
        rows.groupBy(*USER, F.session_window("ts", gap))
        .agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_touch_at"), F.count("*").alias("touches"))
        .drop("session_window")
    )


def first_requests(requests: DataFrame, delay: str = DELAY) -> DataFrame:
    """The first request of each burst per user and pool: the one that starts the session. A burst
    ends with a pause as long as the delay, by event time, however the rows are cut into batches."""
    bursts = timed(requests, delay).groupBy(*USER, F.session_window("ts", delay))
    return bursts.agg(F.min("ts").alias("ts")).drop("session_window")


def activation_wait(
    requests: DataFrame, changes: DataFrame, budget: int = V.START_BUDGET_SECONDS, delay: str = DELAY, shards: int = CLOCK_SHARDS
) -> DataFrame:
    """Outcome of each start request, as the batch job has it: the state its session is in at that
    moment or the next that decides within the budget. It comes out once the watermark has passed
    the budget, so it does not depend on how rows are cut into batches. `changes` has a `seq` that
    orders changes of one moment."""
    lost = states.clean("endpoint") == "" if "endpoint" in changes.columns else F.lit(False)
    outcome = (
        F.when(states.holds_instance() & lost, NO_ENDPOINT).when(states.holds_instance(), OK)
        .when(states.start_failed(), FAILED).otherwise(OPEN)
    )
    asked = timed(requests, delay).select(*SESSION, "ts", F.lit(ASKED).alias("kind"), F.lit(0).cast("bigint").alias("seq"))
    became = timed(changes, delay).select(*SESSION, "ts", outcome.alias("kind"), F.col("seq").cast("bigint").alias("seq"))
    rows = asked.unionByName(became).withColumn("budget", F.lit(budget).cast("bigint"))
    return _dealt(rows, SESSION, shards).transformWithStateInPandas(
        statefulProcessor=StartClock(), outputStructType=START_OUTPUT, outputMode="append", timeMode="eventTime"
    )


def utilisation(
    usage: DataFrame, wanted: DataFrame, tick: str = f"{V.TICK_SECONDS} seconds", delay: str = DELAY
) -> DataFrame:
    """Mean over the pods of a pool per tick, by the rules of the batch job: amounts are summed exactly and rounded
    up once, and a pod with an amount that cannot be read is left out. `wanted` has the requests of the
    pods in question (namespace, pool, pod, container, resource, request_milli)."""
    key = ["namespace", "pod", "container", "resource"]
    rows = timed(usage, delay).join(wanted, key)
    per_pod = (
        rows.groupBy(*V.POOL, "pod", "resource", F.window("ts", tick))
        .agg(
            F.ceil(F.sum("usage_milli")).cast("bigint").alias("usage"), F.ceil(F.sum("request_milli")).cast("bigint").alias("request"),
            F.count_if(F.col("usage_milli").isNull() | F.col("request_milli").isNull()).alias("unreadable"),
        )
        .filter((F.col("request") != 0) & (F.col("unreadable") == 0))
        .withColumn("micro", F.expr("(cast(usage as decimal(28,0)) * 100000000) div request"))
    )
    return (
        per_pod.groupBy(*V.POOL, "resource", F.window("window", tick).alias("tick"))
        .agg(F.count("*").alias("measured_pods"), F.expr("sum(micro) div count(*)").alias("mean_micro_percent"))
        .withColumn("tick", F.col("tick.start"))
    )


def live_load(changes: DataFrame, by: list[str] = V.POOL) -> DataFrame:
    """Sessions that hold an instance, per key, from state changes with `previous` and `state`;
    update mode."""
    held = lambda c: F.coalesce(states.holds_instance(c), F.lit(False)).cast("int")
    return (
        changes.withColumn("delta", held("state") - held("previous"))
        .filter("delta <> 0")
        .groupBy(*by)
        .agg(F.sum("delta").alias("live"))
    )


def session_states(activity: DataFrame, pools: DataFrame, delay: str = DELAY, shards: int = CLOCK_SHARDS) -> DataFrame:
    """State changes of every session as touches arrive and clocks run out; append mode."""
    limits = pools.select(*V.POOL, settings.idle_minutes().alias("idle_minutes"))
    rows = timed(activity, delay).join(limits, V.POOL, "left").fillna(V.ZERO_IDLE_MINUTES, ["idle_minutes"])
    rows = rows.select(*V.POOL, "session", "ts", "idle_minutes")
    return _dealt(rows, [*V.POOL, "session"], shards).transformWithStateInPandas(
        statefulProcessor=SessionClock(), outputStructType=STATE_OUTPUT, outputMode="append", timeMode="eventTime"
    )


_NEWS = {
    "session": "string", "ts": "timestamp", "seq": "bigint", "user_name": "string", "state": "string", "instance": "string",
    "endpoint": "string", "minutes": "int", "flag": "boolean", "reason": "string", "created_at": "timestamp", "last_activity_at": "timestamp",
}


def _news(rows: DataFrame, kind: int, shards: int, **given: Column) -> DataFrame:
    """Rows of one kind in the shape all news has. Without a session they go to every shard of the pool."""
    each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    shard = F.pmod(F.xxhash64("session"), F.lit(shards)).cast("int") if "session" in rows.columns else each
    held = lambda c: given[c] if c in given else F.col(c) if c in rows.columns else F.lit(None)
    return rows.select(*V.POOL, shard.alias("shard"), F.lit(kind).alias("kind"), *[held(c).cast(t).alias(c) for c, t in _NEWS.items()])


def touch_news(activity: DataFrame, shards: int = SHARDS) -> DataFrame:
    return _news(activity.select(*V.POOL, "session", "ts"), life.TOUCH, shards)


def end_news(asks: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Requests to end a session, by `user_name`; the owner's alone are heard."""
    return _news(asks.select(*V.POOL, "session", "ts", "user_name"), life.END, shards)


def record_news(records: DataFrame, shards: int = SHARDS) -> DataFrame:
    """New sessions with their owner."""
    return _news(records.select(*V.POOL, "session", "ts", "user_name"), life.RECORD, shards)


def outlook_news(outlook: DataFrame, shards: int = SHARDS) -> DataFrame:
    """What `waiting_outlook` said of new sessions at `ts`; those that go on waiting are no news."""
    said = outlook.filter("outlook <> 'no running instance'")
    return _news(said.select(*V.POOL, "session", "ts", "instance", "endpoint", F.col("verdict").alias("reason")), life.OUTLOOK, shards)


def pool_news(pools: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Pools as they are from `ts` on; `known` is false for one that is gone."""
    rows = pools.select(*V.POOL, "ts", "known", settings.idle_minutes().alias("minutes"))
    return _news(rows, life.POOL, shards, flag=F.col("known"))


def instance_news(instances: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Instances as they are from `ts` on."""
    return _news(instances.select(*V.POOL, "instance", "ts", "state"), life.INSTANCE, shards, flag=states.is_ready())


def life_snapshot(sessions: DataFrame, pools: DataFrame, instances: DataFrame, as_of: Column, shards: int = SHARDS) -> DataFrame:
    """Where `session_transitions` begins: all that is known at `as_of`."""
    facts = pool_news(pools.withColumns({"ts": as_of, "known": F.lit(True)}), shards)
    seats = instance_news(instances.filter(states.is_ready()).withColumn("ts", as_of), shards)
    rows = sessions.withColumns({"ts": as_of, "instance": F.col("assigned_instance")})
    if "endpoint" not in rows.columns:
        rows = rows.withColumn("endpoint", F.lit(""))
    return facts.unionByName(seats).unionByName(_news(rows, life.SNAPSHOT, shards))


def session_transitions(news: DataFrame, snapshot: DataFrame, delay: str = DELAY) -> DataFrame:
    """Every change of every session, with the instance, endpoint and times it has then; append mode.

    `news` is any union of touches, requests to end, new sessions, outlooks, pools and instances;
    pools and instances are news like the rest, so a changed timeout counts from its moment on.
    The sessions of the snapshot are looked at once at its moment, by the rules of the batch job.
    """
    key = [*V.POOL, "shard"]
    return timed(news, delay).groupBy(*key).transformWithStateInPandas(
        statefulProcessor=SessionLife(), outputStructType=LIFE_OUTPUT, outputMode="append", timeMode="eventTime",
        # The state operator is sent with the plan of its initial rows, so that plan must be rows alone.
        initialState=checkpointed(snapshot).groupBy(*key),
    )
