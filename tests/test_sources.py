"""Readers on exported files, and sinks."""

import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from poolwatch import values as V
from poolwatch.functions import settings
from poolwatch.plans import load, sessions, views
from poolwatch.sources import readers, sinks
from poolwatch.sources.sample import as_of

PREFIX = "example.io"


@pytest.fixture
def put(tmp_path):
    def write(*records):
        folder = tmp_path / f"in{len(list(tmp_path.iterdir()))}"
        folder.mkdir()
        (folder / "part.json").write_text("\n".join(json.dumps(r) for r in records))
        return str(folder)

    return write


POOL = {
    "namespace": "dev",
    "name": "connect-default",
    "spec": {
        "type": "connect",
        "host": "c.example.com",
        "replicas": {"min": 0, "max": 5},
        "scaling": {
            "metrics": {"type": "activeSessions", "targetPerInstance": 20},
            "scaleUpThreshold": "0.8", "scaleDownThreshold": "0.3", "cooldownSeconds": 300, "drainBeforeScaleDown": True,
        },
        "sparkApplicationTemplate": {
            "spec": {"image": "i:1", "sparkVersion": "3.5.3", "driver": {"cores": 1, "memory": "4g"},
                     "executor": {"cores": 4, "instances": 1, "memory": "16g"}, "sparkConf": {"a.b": "10"}, "extra": [1, {"x": None}]}
        },
        "sessionPolicy": {
            "maxSessionsPerUser": 5, "maxTotalSessions": 200, "idleTimeoutMinutes": 720,
            "defaultSessionConf": {"spark.executor.memory": "4g"},
            "quotas": [
                {"match": {"users": ["admin", "root"], "groups": ["ops"]}, "maxSessionsPerUser": 20, "sessionConf": {"k": "v"}},
                {"match": {"users": ["admin"]}},
            ],
        },
    },
    "status": {
        "instances": [
            {"name": "b", "state": "Running", "activeSessions": 1, "endpoint": "b.svc"},
            {"name": "a", "state": "Pending", "activeSessions": 0},
        ],
        "totalActiveSessions": 1, "currentReplicas": 1, "readyReplicas": 1, "lastScaleTime": "2024-01-30T10:00:00Z",
    },
}


def test_read_pools(spark, put):
    (p,) = readers.read_pools(spark, put(POOL)).collect()
    assert (p.pool, p.max_replicas, p.scale_up_threshold, p.drain_before_scale_down) == ("connect-default", 5, "0.8", True)
    assert p.default_session_conf == {"spark.executor.memory": "4g"}
    assert json.loads(p.template) == POOL["spec"]["sparkApplicationTemplate"]["spec"]
    assert p.last_scale_time == datetime(2024, 1, 30, 10)


def test_read_pools_fills_missing_fields(spark, put):
    (p,) = readers.read_pools(spark, put({"namespace": "d", "name": "bare", "spec": {"type": "thrift", "host": "h"}})).collect()
    assert (p.min_replicas, p.max_replicas, p.metric_type, p.target_per_instance) == (0, 10, "activeSessions", 20)
    assert (p.scale_up_threshold, p.scale_down_threshold, p.cooldown_seconds, p.drain_before_scale_down) == ("0.8", "0.3", 300, True)
    assert (p.max_sessions_per_user, p.max_total_sessions, p.idle_timeout_minutes) == (5, 200, 720)
    assert (p.current_replicas, p.ready_replicas, p.total_active_sessions, p.last_scale_time) == (0, 0, 0, None)


def test_missing_and_zero_are_different(spark, put):
    zero = {"namespace": "d", "name": "zero", "spec": {"type": "thrift", "host": "h", "scaling": {
        "metrics": {"type": "cpu", "targetPerInstance": 0}, "cooldownSeconds": 0}}}
    missing = {"namespace": "d", "name": "missing", "spec": {"type": "thrift", "host": "h", "scaling": {"metrics": {"type": "cpu"}}}}
    got = settings.effective_settings(readers.read_pools(spark, put(zero, missing)))
    assert {r.pool: (r.target_per_instance, r.cooldown_seconds) for r in got.collect()} == {"zero": (80, 300), "missing": (20, 300)}


def test_quotas_and_instances_keep_their_order(spark, put):
    path = put(POOL)
    users = readers.read_quotas(spark, path)
    assert sorted((r.pos, r.match_user, r.max_sessions_per_user) for r in users.collect()) == [(0, "admin", 20), (0, "root", 20), (1, "admin", 0)]
    groups = readers.read_quotas(spark, path, kind="groups")
    assert [(r.match_group, r.max_sessions_per_user) for r in groups.collect()] == [("ops", 20)]
    records = spark.read.schema(readers.schemas.POOL_RECORD).json(path)
    assert [(r.pos, r.instance, r.active_sessions, r.endpoint) for r in readers.explode_instances(records).collect()] == [
        (0, "b", 1, "b.svc"), (1, "a", 0, "")]


def test_template_profile(spark, put):
    got = {r.setting: r.value for r in views.template_profile(readers.read_pools(spark, put(POOL))).collect()}
    assert got == {"image": "i:1", "version": "3.5.3", "driver.cores": "1", "driver.memory": "4g", "executor.cores": "4",
                   "executor.instances": "1", "executor.memory": "16g", "a.b": "10"}


def test_read_sessions(spark, put):
    full = {"namespace": "d", "name": "s", "labels": {f"{PREFIX}/user": "al"}, "spec": {"user": "al", "pool": "p", "sparkConf": {"k": "v"}},
            "status": {"state": "Active", "assignedInstance": "i", "createdAt": "2024-01-30T10:00:00Z"}, "snapshot_date": "2024-01-31"}
    new = {"namespace": "d", "name": "t", "spec": {"user": "al", "pool": "p"}}
    got = {r.session: r for r in readers.read_sessions(spark, put(full, new)).collect()}
    assert (got["s"].state, got["s"].assigned_instance, got["s"].created_at) == ("Active", "i", datetime(2024, 1, 30, 10))
    assert (got["t"].state, got["t"].assigned_instance, got["t"].endpoint, got["t"].created_at) == ("", "", "", None)
    labelled = readers.with_label_columns(readers.read_sessions(spark, put(full, new)), PREFIX, label_user="user")
    assert {r.session: r.label_user for r in labelled.collect()} == {"s": "al", "t": None}
    picked = readers.select_labels(readers.read_sessions(spark, put(full, new)), {f"{PREFIX}/user": "al"}, "d")
    assert [r.session for r in picked.collect()] == ["s"]


def test_applications(rows):
    app = {"metadata": {"name": "i", "namespace": "d", "labels": {f"{PREFIX}/pool": "p", f"{PREFIX}/instance-role": "draining"}},
           "status": {"applicationState": {"state": "RUNNING"}, "sparkApplicationId": "spark-1"}}
    bare = {"metadata": {"name": "j", "namespace": "d", "labels": {f"{PREFIX}/pool": "p"}}}
    got = readers.instances_from_applications(rows("pos long, doc string", (0, json.dumps(app)), (1, json.dumps(bare))), PREFIX)
    assert [(r.instance, r.pool, r.state, r.app_id) for r in got.collect()] == [("i", "p", "Draining", "spark-1"), ("j", "p", "Pending", "")]


def test_metrics_end_to_end(spark, put, rows):
    metrics = put({"namespace": "d", "pod": "i-driver", "timestamp": "2024-01-31T00:00:00Z", "containers": [
        {"name": "main", "usage": {"cpu": "500m", "memory": "1Gi"}}, {"name": "side", "usage": {"cpu": "1"}}]})
    pods = put({"namespace": "d", "pod": "i-driver", "containers": [
        {"name": "main", "requests": {"cpu": "1", "memory": "4Gi"}}, {"name": "side"}]})
    instances = rows("namespace string, pool string, instance string, state string", ("d", "p", "i", "Running"))
    got = load.pool_utilisation(instances, readers.read_usage(spark, metrics), readers.read_requests(spark, pods))
    assert {r.resource: r.mean_percent for r in got.collect()} == {"cpu": 150.0, "memory": 25.0}


def test_services_and_routes(spark, put):
    (s,) = readers.read_services(spark, put({"namespace": "d", "name": "x-driver-svc", "labels": {"spark-app-selector": "spark-1"}, "pos": 3})).collect()
    assert (s.service, s.app_id, s.pos) == ("x-driver-svc", "spark-1", 3)
    (r,) = readers.read_routes(spark, put({"namespace": "d", "name": "p-connect", "labels": {"a": "b"}, "host": "h", "port": 15002})).collect()
    assert (r.route, r.labels, r.annotations, r.port) == ("p-connect", {"a": "b"}, None, 15002)


def test_pool_list_document(rows):
    doc = {"namespace": "d", "pools": [{"name": "a", "spec": {"type": "connect", "host": "h"}}, {"name": "b", "spec": {"type": "thrift", "host": "g"}}]}
    got = readers.flatten_pools(readers.explode_pool_list(rows("doc string", (json.dumps(doc),))))
    assert [(r.namespace, r.pool, r.pos, r.type, r.max_replicas) for r in got.collect()] == [("d", "a", 0, "connect", 10), ("d", "b", 1, "thrift", 10)]


def test_lookup_keys(rows):
    table = rows("namespace string, session string", ("a", "s"), ("b", "s"), ("a", "t"))
    keys = rows("namespace string, session string", ("a", "s"), ("a", "s"), ("c", "t"))
    assert [tuple(r) for r in readers.lookup_keys(table, keys, ["namespace", "session"]).collect()] == [("a", "s")]


def test_status_of_a_tick_replaces_only_itself(spark, rows, tmp_path):
    path = f"{tmp_path}/status"
    rollup = lambda n: rows("namespace string, pool string, running long, ready long, total long", ("d", "p", n, n, n))
    for n, at in [(1, "2024-01-31 00:00:00"), (2, "2024-01-31 00:00:30"), (3, "2024-01-31 00:00:30")]:
        sinks.write_pool_status(sinks.pool_status(rollup(n), F.lit(at).cast("timestamp_ntz")), path)
    assert sorted(r.total_active_sessions for r in sinks.read_pool_status(spark, path).collect()) == [1, 3]


def _part_files(path):
    return [f for f in Path(path).rglob("part-*") if f.suffix == ".parquet"]


def test_ticks_of_a_day_become_few_files(spark, rows, tmp_path):
    path = f"{tmp_path}/status"
    ticks = [datetime(2024, 1, 30, 23, 59, 30), *[datetime(2024, 1, 31) + timedelta(seconds=30 * k) for k in range(40)]]
    status = lambda at, n: rows("namespace string, pool string, current_replicas long, as_of timestamp_ntz", ("d", "p", n, at), ("d", "q", n, at))
    for k, at in enumerate(ticks[:6]):
        sinks.write_pool_status(status(at, k), path)
    many = rows("namespace string, pool string, current_replicas long, as_of timestamp_ntz", *[("d", p, k, at) for k, at in enumerate(ticks) if k > 5 for p in "pq"])
    sinks.write_pool_status(many, path)
    want = sorted((p, k, at) for k, at in enumerate(ticks) for p in "pq")
    told = lambda: sorted((r.pool, r.current_replicas, r.as_of) for r in sinks.read_pool_status(spark, path).collect())
    assert told() == want and len(_part_files(f"{path}/ticks")) > 40
    kept = [(f, f.read_bytes()) for f in Path(f"{path}/ticks/as_of_date=2024-01-31/tick=000000").iterdir()]
    sinks.compact_pool_status(spark, path, "2024-01-31")
    assert told() == want and len(_part_files(f"{path}/days")) <= 4 and len(_part_files(f"{path}/ticks")) <= 2
    # Cut off before the ticks went: they are still there, and count once.
    for f, data in kept:
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)
    assert told() == want
    # A late tick of a day that has its files, and both once more.
    sinks.write_pool_status(status(datetime(2024, 1, 31, 12), 99), path)
    for _ in range(2):
        sinks.compact_pool_status(spark, path, "2024-01-31")
    assert told() == sorted([*want, ("p", 99, datetime(2024, 1, 31, 12)), ("q", 99, datetime(2024, 1, 31, 12))])


def test_two_writers_of_a_tick_leave_one_row(spark, rows, tmp_path):
    path, at = f"{tmp_path}/status", datetime(2024, 1, 31)
    row = rows("namespace string, pool string, current_replicas long, as_of timestamp_ntz", ("d", "p", 1, at))
    sinks.write_pool_status(row, path)
    folder = f"{path}/ticks/as_of_date=2024-01-31/tick=000000"
    row.write.mode("append").parquet(folder)
    assert sinks.read_pool_status(spark, path).count() == 1
    sinks.compact_pool_status(spark, path, "2024-01-31")
    assert sinks.read_pool_status(spark, path).count() == 1


def test_status_lists_instances_in_order(rows):
    rollup = rows("namespace string, pool string, running long, ready long, total long", ("d", "p", 2, 1, 3), ("d", "none", 0, 0, 0))
    listed = rows("namespace string, pool string, instance string, pos long, state string, active_sessions long",
                  ("d", "p", "b", 10, "Running", 3), ("d", "p", "a", 9, "Draining", 0))
    got = {r.pool: r.instances for r in sinks.pool_status(rollup, F.lit("2024-01-31").cast("timestamp_ntz"), listed).collect()}
    assert [(i.name, i.state, i.active_sessions, i.endpoint) for i in got["p"]] == [("a", "Draining", 0, ""), ("b", "Running", 3, "")]
    assert got["none"] == []


def test_session_table_merges_and_compacts(spark, rows, tmp_path):
    path = f"{tmp_path}/table"
    base = rows("namespace string, session string, user_name string, state string, assigned_instance string",
                ("d", "a", "u", "Active", "i"), ("d", "b", "u", "Idle", "i"), ("d", "c", "v", "", ""))
    change = "namespace string, session string, state string, assigned_instance string, ts timestamp_ntz, seq long"
    at = lambda m: datetime(2024, 1, 31, 0, m)
    told = lambda: {r.session: (r.user_name, r.state, r.assigned_instance) for r in sinks.read_session_table(spark, path).collect()}
    sinks.write_session_base(base, path)
    assert told() == {"a": ("u", "Active", "i"), "b": ("u", "Idle", "i"), "c": ("v", "", "")}
    first = rows(change, ("d", "c", "Active", "j", at(1), 0), ("d", "a", "Pending", "", at(2), 0), ("d", "a", "Active", "k", at(2), 1))
    for _ in range(2):
        sinks.write_session_batch(first, path, 0)
    want = {"a": ("u", "Active", "k"), "b": ("u", "Idle", "i"), "c": ("v", "Active", "j")}
    assert told() == want
    # A batch that changes the state alone, and one that was cut off before its end.
    sinks.write_session_batch(rows("namespace string, session string, state string, ts timestamp_ntz, seq long", ("d", "b", "Active", at(0), 0)), path, 1)
    sinks.write_session_batch(rows(change, ("d", "b", "Failed", "", at(9), 0)), path, 2)
    Path(f"{path}/changes/batch=2/_SUCCESS").unlink()
    want["b"] = ("u", "Active", "i")
    assert told() == want
    for _ in range(2):
        sinks.compact_sessions(spark, path)
        assert told() == want
    sinks.write_session_batch(rows(change, ("d", "new", "Pending", "", at(3), 0), ("d", "a", "Terminated", "k", at(3), 0)), path, 3)
    want |= {"new": (None, "Pending", ""), "a": ("u", "Terminated", "k")}
    assert told() == want
    sinks.compact_sessions(spark, path)
    assert told() == want and sorted(p.name for p in Path(f"{path}/base").iterdir()) == ["version=1", "version=3"]
    assert not list(Path(f"{path}/changes").glob("batch=0"))


def test_newest_rows(rows):
    table = rows("k string, ts timestamp_ntz, seq long, v string", ("a", datetime(2024, 1, 1), 1, "x"), ("a", datetime(2024, 1, 2), 0, "y"),
                 ("a", datetime(2024, 1, 2), 2, "z"), ("b", None, None, "n"), ("c", datetime(1960, 1, 1), -5, "old"))
    assert {r.k: r.v for r in sinks.newest_rows(table, ["k"], ["ts", "seq"]).collect()} == {"a": "z", "b": "n", "c": "old"}


def test_session_changes_compact_to_the_newest(spark, rows, tmp_path):
    path = f"{tmp_path}/changes"
    change = "namespace string, session string, state string, ts timestamp_ntz"
    sinks.write_session_changes(rows(change, ("d", "s", "Active", datetime(2024, 1, 2)), ("d", "t", "Idle", datetime(2024, 1, 1))), path)
    sinks.write_session_changes(rows(change, ("d", "s", "Pending", datetime(2024, 1, 1))), path)
    got = sinks.latest_sessions(spark.read.parquet(path).drop("day"))
    assert {r.session: r.state for r in got.collect()} == {"s": "Active", "t": "Idle"}


def test_listing_json_leaves_out_empty_fields(spark, rows, tmp_path):
    table = rows("session string, user_name string, pool string, state string, assigned_instance string, spark_conf map<string,string>, "
                 "created_at timestamp_ntz, last_activity_at timestamp_ntz",
                 ("s", "al", "p", "Active", "i", {"k": "v"}, datetime(2024, 1, 31, 10), None), ("r", "bo", "p", "", "", {}, None, None))
    sinks.write_listing(views.session_listing(table), f"{tmp_path}/listing")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/listing").collect()]
    assert lines == [
        {"name": "r", "user": "bo", "pool": "p", "state": ""},
        {"name": "s", "user": "al", "pool": "p", "state": "Active", "assignedInstance": "i", "sparkConf": {"k": "v"}, "createdAt": "2024-01-31T10:00:00Z"},
    ]


def test_pool_listing_json(spark, put):
    rows = sinks.to_listing_json(views.pool_listing(readers.read_pools(spark, put(POOL)))).collect()
    assert json.loads(rows[0].value) == {
        "name": "connect-default", "type": "connect", "host": "c.example.com", "minReplicas": 0, "maxReplicas": 5, "currentReplicas": 1,
        "readyReplicas": 1, "totalActiveSessions": 1,
        "sessionPolicy": {"maxSessionsPerUser": 5, "maxTotalSessions": 200, "idleTimeoutMinutes": 720,
                          "defaultSessionConf": {"spark.executor.memory": "4g"}},
    }


def test_validation_names_every_broken_rule(spark, put):
    bad = json.loads(json.dumps(POOL))
    bad["name"], bad["spec"]["type"], bad["spec"]["host"] = "bad", "batch", ""
    bad["spec"]["replicas"] = {"min": -1, "max": 0}
    bad["spec"]["scaling"] = None
    bad["status"]["conditions"] = [{"type": "bad type", "status": "Maybe", "reason": "1x"}]
    bad["status"]["instances"][0]["state"] = "Lost"
    records = spark.read.schema(readers.schemas.POOL_RECORD).json(put(POOL, bad))
    got = {r.rule: (r.bad_rows, r.first_key) for r in views.validate_pools(records).collect()}
    assert set(got) == {"type_unknown", "host_empty", "min_replicas_below_0", "max_replicas_below_1", "scaling_missing", "scaling.metrics_missing",
                        "instance_state_unknown", "condition_type", "condition_status", "condition_reason", "condition_message",
                        "condition_time_missing"}
    assert set(got.values()) == {(1, "dev/bad")}


def test_work_folder_is_the_shared_one(spark):
    assert sinks.work_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_orphans(rows):
    pools = rows("namespace string, pool string", ("d", "p"))
    found = sessions.orphans(pools, session=rows("namespace string, pool string, name string", ("d", "p", "a"), ("e", "p", "b"), ("d", "q", "c")))
    assert sorted((r.kind, r.name) for r in found.collect()) == [("session", "b"), ("session", "c")]


def test_columns_views(rows):
    table = rows("namespace string, session string, user_name string, pool string, state string, assigned_instance string, "
                 "last_activity_at timestamp_ntz, created_at timestamp_ntz",
                 ("d", "s", "u", "p", "Idle", "i", datetime(2024, 1, 30, 23, 59), datetime(2024, 1, 30)))
    (got,) = views.session_columns(table, as_of()).collect()
    assert (got.idle_seconds, got.age_seconds) == (60, 86400)
    assert V.POOL == ["namespace", "pool"]
