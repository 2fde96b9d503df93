"""Registered queries: each job over the sample views of a folder of test tables."""

import uuid

from pyspark.sql import DataFrame, functions as F

from poolwatch import schemas, values as V
from poolwatch.functions import hosts, identity, maps, states
from poolwatch.plans import capacity, load, quota, routing, sessions, views
from poolwatch.sources import readers, sinks
from poolwatch.sources.sample import AS_OF, MANAGER, MEASURED_MINUTES, PREFIX, Sample, as_of, measured_at
from poolwatch.streaming import jobs, run, steps

QUERIES = {}


def query(make):
    """Register a function of the sample views under its own name."""
    QUERIES[make.__name__] = lambda spark, sf_dir: make(Sample(spark, sf_dir))
    return make


# Sessions per instance, capacity.


def _counts(s: Sample) -> DataFrame:
    return load.instance_counts(s.instances, s.sessions)


@query
def instance_load(s: Sample) -> DataFrame:
    return load.instance_load(_counts(s)).drop("pos")


@query
def pool_rollup(s: Sample) -> DataFrame:
    return load.pool_rollup(s.pools, _counts(s))


@query
def fleet_rollup(s: Sample) -> DataFrame:
    return load.fleet_rollup(load.pool_rollup(s.pools, _counts(s)), s.pools.join(s.pool_regions, V.POOL))


@query
def counts_by_bucket(s: Sample) -> DataFrame:
    """Sessions per pool and instance from a table in buckets, with the pool's type."""
    name = f"sessions_{uuid.uuid4().hex}"
    sinks.save_by_pool(s.sessions.select("namespace", "pool", "session", "state", "assigned_instance"), name, sinks.work_folder(s.spark, "by-pool"), 8, 4)
    sessions_ = s.spark.table(name).join(load.by_share(s.pools.select(*V.POOL, "type"), 4), [*V.POOL, "share"])
    return load.counts_by_share(sessions_)


@query
def pool_utilisation(s: Sample) -> DataFrame:
    return load.pool_utilisation(s.instances, s.container_usage, s.container_requests).drop("mean_percent")


@query
def pod_utilisation(s: Sample) -> DataFrame:
    return load.pod_utilisation(s.instances, s.container_usage, s.container_requests)


def _desired(s: Sample, counts: DataFrame) -> DataFrame:
    rollup = load.pool_rollup(s.pools, counts)
    usage = capacity.current(s.container_usage, measured_at(), MEASURED_MINUTES)
    used = load.pool_utilisation(s.instances, usage, s.container_requests)
    return capacity.desired_replicas(s.pools, rollup, used, measured_at(), MEASURED_MINUTES)


@query
def desired_replicas(s: Sample) -> DataFrame:
    return _desired(s, _counts(s))


@query
def capacity_plan(s: Sample) -> DataFrame:
    counts = sinks.materialise(_counts(s), "instance-counts")
    desired = sinks.materialise(_desired(s, counts), "desired-replicas")
    return capacity.capacity_plan(s.pools, desired, load.instance_load(counts), as_of())


@query
def scaling_audit(s: Sample) -> DataFrame:
    return capacity.scaling_audit(s.scaling_log, s.pools)


# Quota.


@query
def quota_limits(s: Sample) -> DataFrame:
    return quota.quota_limits(s.quotas)


@query
def group_quota_limits(s: Sample) -> DataFrame:
    users = s.tokens.select(*quota.USER, identity.token_part("token", 1).alias("claims"))
    users = users.select(*quota.USER, identity.claimed_groups("claims").alias("groups"))
    rules = s.quotas.withColumn("match_group", F.concat(F.lit("g"), F.col("pos")))
    return quota.group_quota_limits(users, rules)


@query
def live_sessions(s: Sample) -> DataFrame:
    return quota.live_sessions(s.sessions, quota.USER)


@query
def quota_check(s: Sample) -> DataFrame:
    return quota.quota_check(s.sessions, s.pools, s.quotas)


@query
def quota_pressure(s: Sample) -> DataFrame:
    return quota.quota_pressure(s.sessions, s.pools, s.quotas)


def _history(s: Sample) -> DataFrame:
    return s.sessions.withColumnRenamed("created_at", "started_at")


@query
def concurrency(s: Sample) -> DataFrame:
    return quota.concurrency(_history(s), V.POOL)


@query
def quota_audit(s: Sample) -> DataFrame:
    return quota.quota_audit(_history(s), quota.pool_limits(s.pools), V.POOL, as_of())


@query
def quota_audit_users(s: Sample) -> DataFrame:
    history = _history(s)
    limits = quota.user_limits(history, s.pools, s.quotas)
    return quota.quota_audit(history, limits, quota.USER, as_of())


# Placement and life cycle.


@query
def instance_endpoints(s: Sample) -> DataFrame:
    return sessions.instance_endpoints(s.instances, s.services).select("instance", "state", "endpoint")


def _candidates(s: Sample) -> DataFrame:
    loads = load.instance_load(_counts(s))
    return sessions.placement_candidates(s.pools, loads, sessions.instance_endpoints(s.instances, s.services))


@query
def placement_candidates(s: Sample) -> DataFrame:
    return _candidates(s)


@query
def waiting_outlook(s: Sample) -> DataFrame:
    return sessions.waiting_outlook(quota.quota_check(s.sessions, s.pools, s.quotas), _candidates(s))


@query
def balanced_placement(s: Sample) -> DataFrame:
    verdicts = quota.quota_check(s.sessions, s.pools, s.quotas)
    return sessions.balanced_placement(verdicts, s.sessions, load.instance_load(_counts(s)))


@query
def session_transitions(s: Sample) -> DataFrame:
    return sessions.session_transitions(s.sessions, s.pools, s.instances, s.quotas, as_of(), _candidates(s))


@query
def session_table(s: Sample) -> DataFrame:
    """Sessions after what became of them was written back, made the new base, and requests to end were heard; the
    last batch is written twice."""
    path = sinks.work_folder(s.spark, "session-table")
    fields = ["assigned_instance", "endpoint", "created_at", "last_activity_at"]
    snapshot = s.sessions.withColumn("endpoint", F.lit(""))
    sinks.write_session_base(snapshot.select("namespace", "session", "pool", "user_name", "state", *fields), path)
    outcome = sessions.session_transitions(s.sessions, s.pools, s.instances, s.quotas, as_of(), _candidates(s)).filter("reason <> 'none'")
    changes = outcome.select("namespace", "session", F.col("next_state").alias("state"), *fields, as_of().alias("ts"), F.lit(0).alias("seq"))
    sinks.write_session_batch(changes, path, 0)
    sinks.compact_sessions(s.spark, path)
    heard = sessions.termination_requests(s.sessions, s.termination_asks).filter("answer = 'accepted'")
    ended = heard.select("namespace", "session", F.col("next_state").alias("state"), as_of().alias("ts"), F.col("request_id").alias("seq"))
    for _ in range(2):
        sinks.write_session_batch(ended, path, 1)
    return sinks.read_session_table(s.spark, path)


@query
def alive_sessions(s: Sample) -> DataFrame:
    return sessions.alive_sessions(s.sessions, s.instances).select("namespace", "session", "assigned_instance")


@query
def sessions_to_reassign(s: Sample) -> DataFrame:
    return sessions.alive_sessions(s.sessions, s.instances, alive=False).select(
        "namespace", "session", "assigned_instance"
    )


@query
def termination_requests(s: Sample) -> DataFrame:
    return sessions.termination_requests(s.sessions, s.termination_asks)


@query
def orphans(s: Sample) -> DataFrame:
    placed = s.sessions.filter(~states.is_terminal()).withColumnRenamed("session", "name")
    away = s.instances.withColumnRenamed("instance", "name").withColumn(
        "pool", F.when(F.col("pos") % 17 == 0, "pool-gone").otherwise(F.col("pool"))
    )
    routes = s.route_owners
    tenants = routes.select("namespace", F.col("tenant").alias("pool"))
    return sessions.orphans(s.pools, session=placed, instance=away).unionByName(sessions.orphans(tenants, route=routes))


@query
def session_reuse(s: Sample) -> DataFrame:
    return sessions.session_reuse(routing.route_requests(s.requests, s.pools), s.sessions, PREFIX)


@query
def session_reuse_known(s: Sample) -> DataFrame:
    """As above, where the proxy remembers the sessions that have no record of a status yet."""
    known = s.sessions.filter("not has_status").select("namespace", "session")
    return sessions.session_reuse(routing.route_requests(s.requests, s.pools), s.sessions, PREFIX, known)


@query
def activation_wait(s: Sample) -> DataFrame:
    return sessions.activation_wait(s.session_requests, s.state_changes, as_of())


# Activity.


@query
def last_activity(s: Sample) -> DataFrame:
    return sessions.last_activity(s.activity)


@query
def touched_sessions(s: Sample) -> DataFrame:
    after = sessions.touched_sessions(s.sessions, s.session_touches)
    return after.select("namespace", "session", "state", "last_activity_at")


@query
def touch_thinning(s: Sample) -> DataFrame:
    return sessions.thin_touches(s.activity)


@query
def touch_gaps(s: Sample) -> DataFrame:
    return sessions.touch_gaps(s.activity)


@query
def idle_sessions(s: Sample) -> DataFrame:
    return sessions.idle_sessions(s.activity, s.pools)


# Routing.


@query
def request_hosts(s: Sample) -> DataFrame:
    return s.requests.select("request_id", hosts.request_host().alias("host"))


@query
def pool_of_type(s: Sample) -> DataFrame:
    return routing.pool_of_type(s.tenant_pools)


@query
def pool_by_host(s: Sample) -> DataFrame:
    return routing.pool_by_host(s.tenant_pools)


@query
def route_requests(s: Sample) -> DataFrame:
    return routing.route_requests(s.requests, s.pools)


@query
def desired_routes(s: Sample) -> DataFrame:
    return s.desired_routes.select(
        "namespace", "route", "class", "host", "path", "path_type", "service", "port",
        F.explode("annotations").alias("annotation", "annotation_value"),
    )


@query
def ownership_labels(s: Sample) -> DataFrame:
    labels = maps.ownership_labels(PREFIX, user=F.col("user_name"), pool=F.col("pool"), origin=F.lit("proxy"))
    return s.sessions.select("session", F.explode(labels).alias("label", "label_value"))


@query
def instance_labels(s: Sample) -> DataFrame:
    rows = s.instances.join(s.pools.select(*V.POOL, "type"), V.POOL)
    return rows.select("instance", F.explode(maps.instance_labels(PREFIX, MANAGER)).alias("label", "label_value"))


@query
def route_drift(s: Sample) -> DataFrame:
    return routing.route_drift(s.desired_routes, s.actual_routes, PREFIX, MANAGER)


# Records and views.


@query
def pool_settings(s: Sample) -> DataFrame:
    return views.effective_settings(s.tenant_pools).select(
        "namespace", "pool", "type", "host", "min_replicas", "max_replicas", "metric_type", "target_per_instance",
        "scale_up_threshold", "scale_down_threshold", "cooldown_seconds", "drain_before_scale_down",
        "max_sessions_per_user", "max_total_sessions", "idle_timeout_minutes",
    )


@query
def pool_quotas(s: Sample) -> DataFrame:
    return readers.explode_quotas(s.pool_records).select(
        "namespace", "pool", "pos", "match_user", "max_sessions_per_user", F.explode("session_conf").alias("k", "v")
    )


@query
def pool_instances(s: Sample) -> DataFrame:
    return readers.explode_instances(s.pool_records)


def _exported(rows: DataFrame, name: str) -> str:
    """Folder with rows written as the JSON records a cluster exports."""
    path = sinks.work_folder(rows.sparkSession, name)
    rows.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    return path


@query
def service_records(s: Sample) -> DataFrame:
    app = F.create_map(F.lit("spark-app-selector"), F.col("app_id"))
    rows = s.services.select("namespace", F.col("service").alias("name"), app.alias("labels"), "pos")
    return readers.read_services(s.spark, _exported(rows, "services"))


@query
def route_records(s: Sample) -> DataFrame:
    path = _exported(s.desired_routes.withColumnRenamed("route", "name"), "routes")
    return readers.read_routes(s.spark, path).select(
        "namespace", "route", "class", "host", "path", "path_type", "service", "port"
    )


@query
def written_listing(s: Sample) -> DataFrame:
    path = sinks.work_folder(s.spark, "listing")
    sinks.write_listing(views.own_sessions(s.sessions, "user-7").select("name", "user", "pool", "state"), path)
    return s.spark.read.text(path)


@query
def pool_list_documents(s: Sample) -> DataFrame:
    rows = readers.flatten_pools(readers.explode_pool_list(s.pool_lists))
    return rows.select("namespace", "pool", "pos", "type", "host", "max_replicas", "metric_type")


@query
def session_records(s: Sample) -> DataFrame:
    rows = readers.flatten_sessions(readers.session_records(s.session_documents))
    return rows.select(
        "namespace", "session", "user_name", "pool", "state", "assigned_instance",
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
        F.col("spark_conf")["spark.executor.memory"].alias("memory"),
    )


@query
def own_sessions(s: Sample) -> DataFrame:
    return views.own_sessions(s.sessions, "user-7").select("name", "user", "pool", "state")


@query
def own_sessions_by_label(s: Sample) -> DataFrame:
    return views.own_sessions(s.sessions, "user-7", PREFIX).select("name", "user", "labelUser", "pool", "state")


@query
def instance_states(s: Sample) -> DataFrame:
    return readers.instances_from_applications(s.applications, PREFIX)


@query
def container_quantities(s: Sample) -> DataFrame:
    rows = readers.usage_rows(s.pod_metrics)
    return rows.groupBy("pod", "container", "resource").agg(
        F.count("*").alias("readings"), F.ceil(F.sum("usage_milli")).cast("bigint").alias("usage_milli"),
        F.count_if(F.col("usage_milli").isNull()).alias("unreadable"),
    )


@query
def label_selection(s: Sample) -> DataFrame:
    hit = readers.select_labels(s.sessions, {f"{PREFIX}/pool": "pool-3", f"{PREFIX}/origin": "proxy"}, "ns-3")
    return hit.select("namespace", "session", "user_name")


@query
def label_columns(s: Sample) -> DataFrame:
    """Sessions of a user by a label that was made a column when they were written."""
    path = sinks.work_folder(s.spark, "labelled")
    sinks.write_sessions(s.sessions.withColumn("snapshot_date", as_of().cast("date")), path, PREFIX, {"label_user": "user"})
    return s.spark.read.parquet(path).filter("snapshot_date = date'2024-01-31' and label_user = 'user-7'").select("namespace", "session", "user_name")


@query
def broken_records(s: Sample) -> DataFrame:
    """Exported session records, some cut off and some without a name: good ones as ever, the others kept."""
    path = sinks.work_folder(s.spark, "records")
    s.session_lines.write.text(path)
    good, broken = readers.read_records(s.spark, path, schemas.SESSION_RECORD)
    rows = readers.flatten_sessions(good).select("session", "state", F.lit(None).cast("string").alias("line"), F.lit(None).cast("string").alias("reason"))
    return rows.unionByName(broken.select("line", "reason"), allowMissingColumns=True)


@query
def keyed_sessions(s: Sample) -> DataFrame:
    keys = s.requests.select("namespace", F.concat(F.lit("session-"), "request_id").alias("session"))
    return readers.lookup_keys(s.sessions, keys, ["namespace", "session"]).select("namespace", "session", "state")


@query
def safe_user_tokens(s: Sample) -> DataFrame:
    names = s.table("customer").select(
        "c_custkey", F.concat_ws("_", "c_name", "c_mktsegment", F.lit("x.Y")).alias("user_name")
    )
    return names.select("c_custkey", hosts.safe_user().alias("token"))


@query
def session_listing(s: Sample) -> DataFrame:
    conf = F.array_join(F.array_sort(F.transform(F.map_entries("sparkConf"), lambda e: F.concat_ws("=", e.key, e.value))), ",")
    return views.session_listing(s.sessions).withColumn("sparkConf", conf)


@query
def pool_listing(s: Sample) -> DataFrame:
    rows = views.pool_listing(s.tenant_pools)
    policy = rows.select("*", "sessionPolicy.*").drop("sessionPolicy")
    return policy.withColumn("defaultSessionConf", F.col("defaultSessionConf")["spark.executor.memory"])


@query
def listing_json(s: Sample) -> DataFrame:
    return sinks.to_listing_json(views.session_listing(s.sessions))


@query
def pool_health(s: Sample) -> DataFrame:
    return views.pool_health(s.tenant_pools)


@query
def pool_columns(s: Sample) -> DataFrame:
    created = as_of() - F.make_dt_interval(F.col("pos").cast("int"))
    return views.pool_columns(s.tenant_pools.withColumn("created_at", created), as_of())


@query
def session_columns(s: Sample) -> DataFrame:
    return views.session_columns(s.sessions, as_of())


@query
def validate_pools(s: Sample) -> DataFrame:
    return views.validate_pools(s.pool_records)


@query
def validate_sessions(s: Sample) -> DataFrame:
    return views.validate_sessions(s.sessions, PREFIX)


@query
def template_profile(s: Sample) -> DataFrame:
    return views.template_profile(s.tenant_pools)


@query
def template_differences(s: Sample) -> DataFrame:
    return views.template_differences(views.template_profile(s.tenant_pools))


@query
def effective_conf(s: Sample) -> DataFrame:
    return views.effective_conf(s.sessions, s.pools, s.quotas)


# Logs.


@query
def access_identity(s: Sample) -> DataFrame:
    return views.access_identity(s.requests)


@query
def token_claims(s: Sample) -> DataFrame:
    claims = views.token_claims(s.tokens.select("event_id", "token"))
    return claims.withColumn("claimed_groups", F.array_join("claimed_groups", ","))


@query
def error_log_trim(s: Sample) -> DataFrame:
    return views.error_log_trim(s.messages).select(
        "doc_id", "truncated", F.col("full_bytes").cast("bigint").alias("full_bytes"),
        F.octet_length("message_bytes").cast("bigint").alias("kept_bytes"),
        F.md5("message_bytes").alias("kept_md5"),
    )


# Sinks.


@query
def pool_status_table(s: Sample) -> DataFrame:
    """Three ticks, one of them written twice, put into the day's files; a fourth tick on its own."""
    path = sinks.work_folder(s.spark, "pool-status")
    counts = sinks.materialise(_counts(s), "instance-counts")
    rollup, listed = load.pool_rollup(s.pools, counts), load.instance_load(counts)
    for tick in (0, 1, 1, 2, 3):
        at = as_of() + F.make_dt_interval(secs=F.lit(tick * V.TICK_SECONDS))
        sinks.write_pool_status(sinks.pool_status(rollup, at, listed), path)
        if tick == 2:
            sinks.compact_pool_status(s.spark, path, AS_OF[:10])
    told = F.transform("instances", lambda i: F.concat_ws("/", i["name"], i["state"], i["active_sessions"]))
    return sinks.read_pool_status(s.spark, path).withColumn("instances", F.array_join(told, ",")).drop("as_of_date")


@query
def session_state_table(s: Sample) -> DataFrame:
    path = sinks.work_folder(s.spark, "session-state")
    changes = s.state_changes.select("namespace", "session", "pool", "state", "ts", "seq")
    sinks.write_session_changes(changes, path)
    return sinks.latest_sessions(s.spark.read.parquet(path).drop("day"), ["ts", "seq"]).drop("seq")


@query
def sessions_by_pool(s: Sample) -> DataFrame:
    path = sinks.work_folder(s.spark, "sessions")
    snapshot = s.sessions.withColumn("snapshot_date", as_of().cast("date"))
    sinks.write_sessions(snapshot, path)
    kept = s.spark.read.schema(snapshot.schema).parquet(path)
    on_day = kept.filter("snapshot_date = date'2024-01-31' and namespace = 'ns-3' and pool = 'pool-3'")
    return on_day.select("namespace", "pool", "session", "state")


# Streams: the same tables read as streams, run to their end.


def stream(*streamed: str):
    """Register a function of the sample views with some tables read as streams."""

    def register(make):
        QUERIES[make.__name__] = lambda spark, sf_dir: make(Sample(spark, sf_dir, streamed))
        return make

    return register


def _instants(df: DataFrame) -> DataFrame:
    """Instants as clock times, as the batch queries have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


@stream("events")
def stream_last_activity(s: Sample) -> DataFrame:
    rows = run.finish(jobs.last_activity(s.activity), "last-activity", "update")
    return _instants(rows.groupBy(*V.POOL, "session").agg(F.max("last_activity_at").alias("last_activity_at")))


@stream("events")
def stream_touch_thinning(s: Sample) -> DataFrame:
    return _instants(run.finish(jobs.thin_touches(s.activity), "thin-touches"))


@stream("events")
def stream_idle_sessions(s: Sample) -> DataFrame:
    return _instants(run.finish(jobs.idle_sessions(s.activity, s.pools), "idle-sessions"))


@stream("events")
def stream_first_requests(s: Sample) -> DataFrame:
    rows = s.activity.select(*quota.USER, "ts")
    return _instants(run.finish(jobs.first_requests(rows), "first-requests"))


@stream()
def stream_access_identity(s: Sample) -> DataFrame:
    log = readers.requests_stream(s.spark, _exported(s.requests, "requests"))
    return run.finish(views.access_identity(log), "access-identity")


@stream()
def stream_activity_records(s: Sample) -> DataFrame:
    records = readers.activity_stream(s.spark, _exported(s.activity.drop("event_id"), "activity"))
    return _instants(run.finish(records, "activity"))


@stream("orders")
def stream_activation_wait(s: Sample) -> DataFrame:
    return _instants(run.finish(jobs.activation_wait(s.session_requests, s.state_changes), "activation-wait"))


@stream("lineitem")
def stream_utilisation(s: Sample) -> DataFrame:
    pods = s.instances.filter(states.is_ready()).select(*V.POOL, "pos", hosts.driver_pod().alias("pod"))
    wanted = s.container_requests.join(pods, ["namespace", "pod"])
    return _instants(run.finish(jobs.utilisation(s.usage_readings, wanted, "1 day", "1 day"), "utilisation"))


@stream("orders")
def stream_live_load(s: Sample) -> DataFrame:
    return run.finish(jobs.live_load(s.state_changes), "live-load", "update", V.POOL)


@stream("events")
def stream_session_states(s: Sample) -> DataFrame:
    return _instants(run.finish(jobs.session_states(s.activity, s.pools), "session-states"))


def _news(s: Sample) -> tuple[DataFrame, int]:
    """News after the snapshot: outlooks at once, requests to end after 5 minutes, every 20th instance lost after
    7, one pool gone after 8, a session of its own much later. Its number of rows comes with it."""
    after = lambda minutes: as_of() + F.make_dt_interval(mins=F.lit(minutes))
    outlook = sessions.waiting_outlook(quota.quota_check(s.sessions, s.pools, s.quotas), _candidates(s)).withColumn("ts", after(0))
    asks = s.termination_asks.join(s.sessions.select("namespace", "session", "pool"), ["namespace", "session"]).withColumn("ts", after(5))
    lost = s.instances.filter("pos % 20 = 0").withColumns({"ts": after(7), "state": F.lit(V.FAILED)})
    gone = s.pools.filter("pool = 'pool-7'").withColumns({"ts": after(8), "known": F.lit(False)})
    late = s.pools.limit(1).select(*V.POOL, F.lit("late").alias("session"), after(2 * 24 * 60).alias("ts"))
    parts = [
        jobs.outlook_news(outlook), jobs.end_news(asks), jobs.instance_news(lost), jobs.pool_news(gone), jobs.touch_news(late),
    ]
    news = parts[0]
    for part in parts[1:]:
        news = news.unionByName(part)
    path = sinks.work_folder(s.spark, "news")
    news.write.parquet(path)
    return s.spark.readStream.schema(news.schema).parquet(path), s.spark.read.schema(news.schema).parquet(path).count()


@stream()
def stream_session_transitions(s: Sample) -> DataFrame:
    start = jobs.life_snapshot(s.sessions, s.pools, s.instances, as_of().cast("timestamp"))
    news, told = _news(s)
    parts = (s.sessions.count() + told) // run.ROWS_PER_PART + 1
    rows = _instants(run.finish(jobs.session_transitions(news, start), "session-transitions", parts=parts))
    return rows.select("namespace", "pool", "session", "changed_at", "state", "reason", "assigned_instance", "endpoint", "last_activity_at")


@stream("events")
def stream_cooldowns(s: Sample) -> DataFrame:
    path = sinks.work_folder(s.spark, "cooldowns")
    return steps.Steps(s.spark, path, steps.cooldowns(lambda: s.pools)).finish(s.scaling_log)
