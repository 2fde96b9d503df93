"""Placement, life cycle, reuse, start-up wait and idleness of sessions."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from poolwatch import values as V
from poolwatch.functions import hosts, settings, states, timing
from poolwatch.operators.scan import nearest, running_sum, time_bucket
from poolwatch.plans.load import INSTANCE
from poolwatch.plans.quota import USER, quota_check

SESSION = ["namespace", "session"]
_OPEN, _OK, _FAILED, _NO_ENDPOINT = 0, 1, 2, 3


def instance_endpoints(instances: DataFrame, services: DataFrame) -> DataFrame:
    """Host of each serving instance: its first driver service in list order, else empty."""
    driver = (
        services.filter(F.col("service").endswith(V.DRIVER_SERVICE_SUFFIX))
        .groupBy("namespace", "app_id")
        .agg(F.min_by("service", "pos").alias("service"))
    )
    serving = states.counted_as_running() & F.col("service").isNotNull()
    return instances.join(driver, ["namespace", "app_id"], "left").select(
        *instances.columns, F.when(serving, hosts.service_host()).otherwise("").alias("endpoint")
    )


def placement_candidates(pools: DataFrame, load: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Least loaded ready instance of every pool, the first in list order on a tie."""
    best = (
        load.filter(states.is_ready())
        .groupBy(*V.POOL)
        .agg(F.min_by(F.struct("instance", "active_sessions"), F.struct("active_sessions", "pos")).alias("best"))
        .select(*V.POOL, "best.*")
    )
    chosen = best.join(endpoints.select(*INSTANCE, "endpoint"), INSTANCE, "left")
    return (
        pools.select(*V.POOL, "type")
        .join(chosen, V.POOL, "left")
        .select(
            *V.POOL, "instance", "active_sessions",
            F.when(F.col("instance").isNotNull(), hosts.endpoint()).alias("endpoint"),
        )
    )


def balanced_placement(verdicts: DataFrame, sessions: DataFrame, load: DataFrame) -> DataFrame:
    """Admitted new sessions dealt over the ready instances of their pool so that loads end as even as they can.

    Water filling: with the instances in order of load, the first k of them are raised to a common
    level, the largest k for which the sessions suffice. Levels are prefix sums over instances, of which a
    pool has few; sessions are ranked by their time, in buckets, as a pool may have very many. Both
    meet by rank, one row each.
    """
    times = sessions.select(*SESSION, F.coalesce("created_at", F.lit("1970-01-01").cast("timestamp_ntz")).alias("at"))
    new = verdicts.filter("verdict = 'ok'").select(*V.POOL, "session").join(times, SESSION).withColumn("one", F.lit(1))
    ranked = running_sum(new, V.POOL, ["at", "session"], "one", "rank", time_bucket("at", "hour"))
    wanted = new.groupBy(*V.POOL).agg(F.count("*").alias("m"))
    by_load = Window.partitionBy(*V.POOL).orderBy("active_sessions", "pos", "instance")
    every = Window.partitionBy(*V.POOL)
    rows = load.filter(states.is_ready()).join(wanted, V.POOL).withColumns(
        {"i": F.row_number().over(by_load), "upto": F.sum("active_sessions").over(by_load.rowsBetween(Window.unboundedPreceding, 0))})
    used = F.col("i") * F.col("active_sessions") - F.col("upto") <= F.col("m")
    rows = rows.withColumn("k", F.max(F.when(used, F.col("i"))).over(every)).filter("i <= k")
    mass = F.col("m") + F.sum("active_sessions").over(every)
    rows = rows.withColumn("mass", mass).withColumn(
        "gets", F.expr("mass div k + if(i <= mass % k, 1, 0) - active_sessions")
    ).withColumn("before", F.sum("gets").over(by_load.rowsBetween(Window.unboundedPreceding, 0)) - F.col("gets"))
    seats = rows.filter("gets > 0").select(*V.POOL, "instance", F.explode(F.expr("sequence(before + 1, before + gets)")).alias("rank"))
    return ranked.join(seats, [*V.POOL, "rank"]).select(*V.POOL, "session", "instance")


def waiting_outlook(verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """What happens to each new session next: refused, placed, or still without an instance."""
    joined = verdicts.join(candidates.select(*V.POOL, "instance", "endpoint"), V.POOL, "left")
    ok = F.col("verdict") == "ok"
    placed = ok & F.col("instance").isNotNull()
    return joined.select(
        *USER, "session", "verdict",
        F.when(placed, "placed").when(ok, "no running instance").otherwise("refused").alias("outlook"),
        F.when(placed, F.col("instance")).alias("instance"),
        F.when(placed, F.col("endpoint")).alias("endpoint"),
    )


def alive_sessions(sessions: DataFrame, instances: DataFrame, alive: bool = True) -> DataFrame:
    """Placed sessions whose instance is ready, or those whose instance is not."""
    ready = instances.filter(states.is_ready()).select(*V.POOL, F.col("instance").alias("assigned_instance"))
    return sessions.filter(states.holds_instance()).join(ready, V.POOL + ["assigned_instance"], "left_semi" if alive else "left_anti")


def session_transitions(
    sessions: DataFrame, pools: DataFrame, instances: DataFrame, quotas: DataFrame, as_of: Column, candidates: DataFrame | None = None
) -> DataFrame:
    """Next state of every session and why; a reason of `none` means it stays.

    With `candidates` (`placement_candidates`) each row also has the instance, endpoint and times the
    session has then: a placed one those of its candidate and the moment, a lost one none, any other its own.
    New, placed and other sessions go separate ways, so only new ones meet the quota tables and
    only placed ones meet the instance table.
    """
    ready = instances.filter(states.is_ready())
    outcome = ("assigned_instance", "endpoint", "created_at", "last_activity_at") if candidates is not None else ()
    if outcome and "endpoint" not in sessions.columns:
        sessions = sessions.withColumn("endpoint", F.lit(""))
    if candidates is None:
        seat = ready.select(*V.POOL).distinct().withColumn("seat", F.lit(""))
    else:
        seat = candidates.filter("instance is not null").select(*V.POOL, F.col("instance").alias("seat"), F.col("endpoint").alias("seat_endpoint"))
    verdicts = quota_check(sessions, pools, quotas, outcome)
    new = verdicts.join(seat, V.POOL, "left")
    placed = F.col("seat").isNotNull()
    taken = (F.col("verdict") == "ok") & placed
    at = {"assigned_instance": F.col("seat"), "endpoint": F.col("seat_endpoint"), "created_at": as_of, "last_activity_at": as_of} if outcome else {}
    new = new.select(
        *SESSION, "pool", "state",
        F.when(F.col("verdict") != "ok", "Failed").when(placed, "Active").otherwise(F.col("state"))
        .alias("next_state"),
        F.when(F.col("verdict") != "ok", F.col("verdict")).when(placed, "placed")
        .otherwise("no_running_instance").alias("reason"),
        *[F.when(taken, at[c]).otherwise(F.col(c)).alias(c) for c in outcome],
    )

    own = [c for c in outcome if c not in ("assigned_instance", "last_activity_at")]
    held = sessions.filter(states.holds_instance()).select(
        *SESSION, "pool", "state", "assigned_instance", "last_activity_at", *own
    )
    limits = pools.select(*V.POOL, settings.idle_minutes().alias("idle_minutes"), F.lit(True).alias("pool_known"))
    seats = ready.select(
        *V.POOL, F.col("instance").alias("assigned_instance"), F.lit(True).alias("instance_ready")
    )
    held = held.join(limits, V.POOL, "left")
    held = held.join(seats, V.POOL + ["assigned_instance"], "left")
    idle = lambda limit: timing.idle_longer_than("last_activity_at", as_of, limit)
    to = lambda state, why: F.struct(state.alias("next_state"), F.lit(why).alias("reason"))
    step = (
        F.when(F.col("pool_known").isNull(), to(F.lit("Terminated"), "pool_deleted"))
        .when(F.col("instance_ready").isNull(), to(F.lit("Pending"), "instance_lost"))
        .when(idle(F.col("idle_minutes")), to(F.lit("Terminating"), "idle_timeout"))
        .when(idle(F.lit(V.IDLE_MARK_MINUTES)) & (F.col("state") == "Active"), to(F.lit("Idle"), "idle_mark"))
        .otherwise(to(F.col("state"), "none"))
    )
    held = held.select(*SESSION, "pool", "state", step.alias("step"), *outcome)
    cleared = lambda c: F.when(F.col("step.reason") == "instance_lost", "").otherwise(F.col(c)) if c in ("assigned_instance", "endpoint") else F.col(c)
    held = held.select(*SESSION, "pool", "state", "step.*", *[cleared(c).alias(c) for c in outcome])

    closing = F.col("state") == "Terminating"
    rest = sessions.filter(~states.is_new() & ~states.holds_instance()).select(
        *SESSION, "pool", "state",
        F.when(closing, "Terminated").otherwise(F.col("state")).alias("next_state"),
        F.when(closing, "closing").otherwise("none").alias("reason"), *outcome,
    )
    return new.unionByName(held).unionByName(rest)


def termination_requests(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Answer to requests to end a session: only the owner may, whatever its state.

    `requests` has namespace, session, user_name (who asks) and request_id.
    """
    owner = sessions.select(*SESSION, F.col("user_name").alias("owner"))
    joined = requests.join(owner, SESSION, "left")
    allowed = F.col("owner") == F.col("user_name")
    return joined.select(
        "request_id", *SESSION, "user_name",
        F.when(F.col("owner").isNull(), "not_found").when(allowed, "accepted").otherwise("forbidden").alias("answer"),
        F.when(allowed, "Terminating").alias("next_state"),
    )


def session_reuse(routed: DataFrame, sessions: DataFrame, prefix: str, known: DataFrame | None = None) -> DataFrame:
    """Session each routed request falls to: the oldest reusable one whose labels name its user and
    its pool; none means a new session would be made. `known` names sessions the proxy made itself
    (namespace, session), which may still have no state.

    Times are compared as numbers, by hash; names decide among the few that are left.
    """
    labelled = {c: F.try_element_at("labels", F.lit(f"{prefix}/{x}")) for c, x in (("user_name", "user"), ("pool", "pool"))}
    usable = states.is_reusable()
    if known is not None:
        made = known.select(*SESSION).distinct().withColumn("made", F.lit(True))
        sessions = sessions.join(made, SESSION, "left")
        usable = usable | (F.col("made").isNotNull() & states.is_reusable(known=True))
    # A session without a time is older than any.
    made_at = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(1 << 62)))
    reusable = sessions.filter(usable).withColumns(labelled).select(*USER, "session", made_at.alias("made_at")).dropna(subset=USER)
    oldest = reusable.groupBy(*USER).agg(F.min("made_at").alias("made_at"))
    first = reusable.join(oldest, [*USER, "made_at"]).groupBy(*USER).agg(F.min("session").alias("session"))
    ok = routed.filter(F.col("status") == "ok").select("request_id", *USER)
    return ok.join(first, USER, "left")


def activation_wait(
    requests: DataFrame, changes: DataFrame, as_of: Column, budget: int = V.START_BUDGET_SECONDS
) -> DataFrame:
    """How long each start request waited for its session.

    A request ends with the state its session is in at that moment or takes next, whichever
    first is active or failed, if within the budget. Requests and state changes are laid on one
    time line per session and looked over once, so no request is paired with more than one
    change. `changes` has a `seq` that orders changes of one moment; the last one of a moment
    stands, and moment and outcome travel as one growing number. A session that is active without an
    endpoint serves nobody: `no_endpoint`, where `changes` tells endpoints.
    """
    lost = states.clean("endpoint") == "" if "endpoint" in changes.columns else F.lit(False)
    outcome = (
        F.when(states.holds_instance() & lost, _NO_ENDPOINT).when(states.holds_instance(), _OK)
        .when(states.start_failed(), _FAILED).otherwise(_OPEN)
    )
    moments = (
        changes.select(*SESSION, "ts", (F.col("seq") * 4 + outcome).alias("n"))
        .groupBy(*SESSION, "ts")
        .agg((F.max("n") % 4).alias("outcome"))
    )
    mark = F.unix_micros(F.col("ts").cast("timestamp")) * 4 + F.col("outcome")
    marks = moments.select(
        *SESSION, "ts", F.lit(0).alias("kind"), mark.alias("mark"),
        F.when(F.col("outcome") != _OPEN, mark).alias("decision"),
    )
    line = requests.select(*SESSION, "ts", F.lit(1).alias("kind")).unionByName(marks, allowMissingColumns=True)
    line = nearest(
        line, SESSION, ["ts", "kind"], time_bucket("ts", "hour"), newest={"now": "mark"}, coming={"next": "decision"}
    ).filter("kind = 1")

    waited = F.floor(F.col("next") / 4) - F.unix_micros(F.col("ts").cast("timestamp"))
    in_time = waited <= budget * 1_000_000
    over = F.col("ts") + timing.seconds(F.lit(budget)) < as_of
    at_once = F.col("now") % 4 != _OPEN
    result = lambda mark: (
        F.when(F.col(mark) % 4 == _OK, "ok").when(F.col(mark) % 4 == _NO_ENDPOINT, "no_endpoint").otherwise("failed")
    )
    return line.select(
        *SESSION, "ts",
        F.when(at_once, 0).when(in_time, F.floor(waited / 1_000_000)).alias("wait_seconds"),
        F.when(at_once, result("now")).when(in_time, result("next"))
        .when(over, "timeout").otherwise("pending").alias("outcome"),
    )


def last_activity(activity: DataFrame) -> DataFrame:
    """Newest touch per session; a late touch never moves it back."""
    return activity.groupBy(*V.POOL, "session").agg(F.max("ts").alias("last_activity_at"), F.count("*").alias("touches"))


def touched_sessions(sessions: DataFrame, activity: DataFrame) -> DataFrame:
    """The snapshot after the touches of a log: a touch newer than the recorded activity moves it,
    and wakes an idle session; an older one changes nothing."""
    newest = activity.groupBy(*SESSION).agg(F.max("ts").alias("touched_at"))
    rows = sessions.join(newest, SESSION, "left")
    moved = F.col("touched_at").isNotNull() & (
        F.col("last_activity_at").isNull() | (F.col("touched_at") > F.col("last_activity_at"))
    )
    return rows.withColumns(
        {
            "state": F.when(moved & (F.col("state") == "Idle"), "Active").otherwise(F.col("state")),
            "last_activity_at": F.when(moved, F.col("touched_at")).otherwise(F.col("last_activity_at")),
        }
    ).drop("touched_at")


def thin_touches(activity: DataFrame, minutes: int = V.TOUCH_MINUTES) -> DataFrame:
    """At most one touch per session and interval: the newest of it."""
    cell = F.window("ts", f"{minutes} minutes")
    return activity.groupBy(*V.POOL, "session", cell).agg(F.max("ts").alias("ts")).drop("window")


def touch_gaps(activity: DataFrame) -> DataFrame:
    """Whole seconds since the same session's previous touch."""
    rows = activity.select(*V.POOL, "session", "event_id", "ts")
    with_last = nearest(
        rows, V.POOL + ["session"], ["ts", "event_id"], time_bucket("ts", "hour"), previous={"previous": "ts"}
    )
    return with_last.select(
        *V.POOL, "session", "event_id", "ts",
        timing.whole_seconds(F.col("previous"), F.col("ts")).alias("seconds_since_previous"),
    )


def idle_sessions(activity: DataFrame, pools: DataFrame) -> DataFrame:
    """Stretches of use per user and pool, cut where nothing happened for longer than the pool's
    idle timeout.

    Touches of one minute always belong together, because no timeout is shorter. They are merged
    first, which leaves a user with at most one row per minute, however busy.
    """
    minute = F.date_trunc("minute", "ts")
    cells = activity.groupBy(*USER, minute.alias("cell")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")
    )
    limits = pools.select(*V.POOL, settings.idle_minutes().alias("idle_minutes"))
    cells = cells.join(limits, V.POOL, "left").fillna(
        V.ZERO_IDLE_MINUTES, ["idle_minutes"]
    )
    by_time = Window.partitionBy(*USER).orderBy("cell")
    cut = F.lag("last").over(by_time) + timing.minutes(F.col("idle_minutes")) < F.col("first")
    marked = cells.withColumn("cut", F.coalesce(cut, F.lit(False)).cast("int"))
    numbered = marked.withColumn("stretch", F.sum("cut").over(by_time))
    return numbered.groupBy(*USER, "stretch").agg(
        F.min("first").alias("started_at"), F.max("last").alias("last_touch_at"), F.sum("n").alias("touches")
    ).drop("stretch")


def orphans(pools: DataFrame, **tables: DataFrame) -> DataFrame:
    """Rows that name a pool which is gone. Each table has namespace, pool and name."""
    found = None
    for kind, rows in tables.items():
        lost = rows.select(*V.POOL, "name").join(pools.select(*V.POOL), V.POOL, "left_anti").withColumn("kind", F.lit(kind))
        found = lost if found is None else found.unionByName(lost)
    return found
