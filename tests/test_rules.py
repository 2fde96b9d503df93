"""One hand-made row per branch of the rules."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from poolwatch import values as V
from poolwatch.functions import hosts, identity, maps, quantity, settings, states, text, timing
from poolwatch.plans import capacity, load, quota, routing, sessions, views
from poolwatch.sources.sample import as_of

NOW = datetime(2024, 1, 31)


def ago(**kw):
    return NOW - timedelta(**kw)


def column(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


# Desired replicas: (min, max, metric, target, threshold), (running, ready, starting, total, waiting), mean, wanted.
DESIRED = [
    ((0, 10, "activeSessions", 20, "0.8"), (0, 0, 0, 0, 0), None, (0, "no_load")),
    ((2, 10, "activeSessions", 20, "0.8"), (0, 0, 0, 0, 0), None, (2, "no_load")),
    ((0, 10, "activeSessions", 20, "0.8"), (0, 0, 0, 0, 1), None, (1, "sessions")),
    ((0, 10, "activeSessions", 20, "0.8"), (1, 1, 0, 100, 0), None, (2, "crowded")),
    ((0, 10, "activeSessions", 20, "0.8"), (1, 1, 0, 16, 0), None, (1, "sessions")),
    ((0, 10, "activeSessions", 20, "0.8"), (1, 1, 0, 17, 0), None, (2, "crowded")),
    ((0, 10, "activeSessions", 20, ""), (1, 1, 0, 17, 0), None, (2, "crowded")),
    ((0, 10, "activeSessions", 20, "0"), (1, 1, 0, 17, 0), None, (2, "crowded")),
    ((0, 10, "activeSessions", 20, "abc"), (1, 1, 0, 17, 0), None, (2, "crowded")),
    ((0, 10, "activeSessions", 20, "1.5"), (1, 1, 0, 30, 0), None, (2, "sessions")),
    ((0, 10, "", 0, "0.8"), (0, 0, 0, 0, 41), None, (3, "sessions")),
    ((0, 10, "activeSessions", -1, "0.8"), (0, 0, 0, 0, 41), None, (3, "sessions")),
    ((5, 3, "activeSessions", 20, "0.8"), (0, 0, 0, 0, 1), None, (3, "sessions")),
    ((0, 3, "activeSessions", 20, "0.8"), (0, 0, 0, 0, 900), None, (3, "sessions")),
    ((0, 10, "activeSessions", 20, "0.8"), (9, 9, 0, 200, 0), None, (10, "crowded")),
    ((1, 10, "cpu", 80, "0.8"), (2, 2, 0, 5, 0), None, (1, "no_measure")),
    ((0, 10, "cpu", 80, "0.8"), (2, 2, 0, 5, 3), None, (1, "waiting")),
    ((0, 10, "cpu", 80, "0.8"), (0, 0, 0, 0, 3), 50.0, (1, "waiting")),
    ((0, 10, "cpu", 80, "0.8"), (2, 2, 0, 5, 1), 0.0, (1, "waiting")),
    ((0, 10, "cpu", 80, "0.8"), (2, 2, 0, 5, 0), 0.0, (0, "utilisation")),
    ((0, 10, "cpu", 80, "0.8"), (2, 2, 0, 5, 0), 80.0, (2, "utilisation")),
    ((0, 10, "memory", 80, "0.8"), (2, 2, 0, 5, 0), 81.0, (3, "utilisation")),
    ((0, 10, "memory", 0, "0.8"), (2, 2, 0, 5, 0), 120.0, (3, "utilisation")),
]


def test_desired_replicas(rows):
    pools, rollup, used = [], [], []
    for i, (spec, counts, mean, _) in enumerate(DESIRED):
        pools.append(("ns", f"p{i}", *spec, 300, 720))
        rollup.append(("ns", f"p{i}", *counts))
        if mean is not None:
            used.append(("ns", f"p{i}", spec[2], ago(minutes=1), mean))
            used.append(("ns", f"p{i}", spec[2], ago(minutes=2), 999.0))
        used.append(("ns", f"p{i}", spec[2], ago(minutes=5), 999.0))  # too old
        used.append(("ns", f"p{i}", spec[2], ago(minutes=-1), 999.0))  # not yet known
    pools = rows(
        "namespace string, pool string, min_replicas int, max_replicas int, metric_type string, target_per_instance int, "
        "scale_up_threshold string, cooldown_seconds int, idle_timeout_minutes int", *pools)
    rollup = rows(
        "namespace string, pool string, running long, ready long, starting long, total long, waiting long", *rollup)
    used = rows("namespace string, pool string, resource string, tick timestamp_ntz, mean_percent double", *used)
    got = {r.pool: (r.desired, r.reason) for r in capacity.desired_replicas(pools, rollup, used, F.lit(NOW)).collect()}
    assert got == {f"p{i}": want for i, (_, _, _, want) in enumerate(DESIRED)}


def _plan(rows, desired, running, starting, drain, load_rows, last=None):
    pools = rows(
        "namespace string, pool string, last_scale_time timestamp_ntz, cooldown_seconds int, drain_before_scale_down boolean",
        ("ns", "p", last, 300, drain))
    wants = rows("namespace string, pool string, running long, starting long, desired int", ("ns", "p", running, starting, desired))
    loads = rows("namespace string, pool string, instance string, pos long, state string, active_sessions long",
                 *[("ns", "p", name, pos, state, n) for pos, (name, state, n) in enumerate(load_rows)])
    plan = capacity.capacity_plan(pools, wants, loads, as_of())
    return sorted(column(plan, "action", "instance"))


SEATS = [("a", "Running", 2), ("b", "Draining", 0), ("c", "Running", 0), ("d", "Running", 1), ("e", "Running", 0), ("f", "Running", 0)]


def test_capacity_plan_creates_what_is_not_yet_starting(rows):
    assert _plan(rows, 4, 1, 1, True, []) == [("create", "p-new-1"), ("create", "p-new-2")]
    assert _plan(rows, 2, 1, 1, True, []) == []


def test_capacity_plan_removes_the_first_removable_in_list_order(rows):
    assert _plan(rows, 4, 6, 0, True, SEATS) == [("drain", "a"), ("drain", "d"), ("remove", "c"), ("remove", "e")]
    assert _plan(rows, 5, 6, 0, True, SEATS) == [("drain", "a"), ("remove", "c")]
    assert _plan(rows, 4, 6, 0, False, SEATS) == [("remove", "a"), ("remove", "c")]
    loaded = [(n, s, 1) for n, s, _ in SEATS]
    assert _plan(rows, 4, 6, 0, True, loaded) == [("drain", n) for n in "acdef"]


def test_capacity_plan_waits_for_the_cooldown(rows):
    assert _plan(rows, 5, 6, 0, False, SEATS, ago(seconds=300)) == []
    assert _plan(rows, 5, 6, 0, False, SEATS, ago(seconds=301)) == [("remove", "a")]


def test_capacity_plan_replaces_failed_on_top(rows):
    seats = [("x", "Failed", 0), ("y", "Running", 0)]
    assert _plan(rows, 3, 1, 0, True, seats) == [("create", "p-new-1"), ("create", "p-new-2"), ("replace", "x")]


def test_instance_states(rows):
    apps = {
        ("RUNNING", "active"): "Running", ("RUNNING", "draining"): "Draining", ("RUNNING", None): "Running",
        ("FAILED", "active"): "Failed", ("FAILING", ""): "Failed", ("COMPLETED", ""): "Failed",
        ("SUBMITTED", ""): "Pending", ("PENDING_RERUN", ""): "Pending", ("", ""): "Pending", ("ODD", ""): "Pending",
        (None, None): "Pending", ("FAILED", "draining"): "Failed",
    }
    df = rows("spark_state string, role string, want string", *[(*k, v) for k, v in apps.items()])
    assert df.filter(~states.instance_state().eqNullSafe(F.col("want"))).count() == 0


def test_counts_keep_namespaces_apart_and_ignore_unknown_instances(rows):
    instances = rows("namespace string, pool string, instance string, pos long, state string",
                     ("n1", "p", "i", 0, "Running"), ("n2", "p", "i", 0, "Running"), ("n1", "p", "j", 1, "Pending"))
    table = rows("namespace string, pool string, session string, state string, assigned_instance string",
                 ("n1", "p", "a", "Active", "i"), ("n1", "p", "b", "Idle", "i"), ("n1", "p", "c", "Active", "gone"),
                 ("n1", "p", "d", "Pending", ""), ("n1", "p", "e", None, None), ("n1", "p", "f", "", "i"),
                 ("n1", "p", "g", "Failed", "i"), ("n2", "p", "h", "Active", "j"))
    counts = load.instance_counts(instances, table)
    assert sorted(column(load.instance_load(counts), "namespace", "instance", "active_sessions")) == [
        ("n1", "i", 2), ("n1", "j", 0), ("n2", "i", 0)]
    pools = rows("namespace string, pool string", ("n1", "p"), ("n2", "p"), ("n3", "p"))
    got = column(load.pool_rollup(pools, counts), "namespace", "running", "ready", "starting", "failed", "total", "waiting")
    assert sorted(got) == [("n1", 1, 1, 1, 0, 2, 2), ("n2", 1, 1, 0, 0, 0, 0), ("n3", 0, 0, 0, 0, 0, 0)]


def test_instances_keep_states_that_no_list_knows(rows):
    states_ = ["Submitted", "Lost", "Running", "Assigning", "", None]
    instances = rows("namespace string, pool string, instance string, pos long, state string",
                     *[("n", "p", f"i{k}", k, s) for k, s in enumerate(states_)])
    none = rows("namespace string, pool string, session string, state string, assigned_instance string")
    counts = load.instance_counts(instances, none)
    assert column(load.instance_load(counts).orderBy("pos"), "state") == states_
    (got,) = load.pool_rollup(rows("namespace string, pool string", ("n", "p")), counts).collect()
    assert (got.instances, got.running, got.starting) == (6, 1, 3)


def test_measures_are_cut_ahead_of_the_joins(spark, rows, tmp_path):
    usage = rows("namespace string, pod string, container string, resource string, tick timestamp_ntz, usage_milli long",
                 ("n", "a-driver", "c", "cpu", NOW, 1))
    usage.write.parquet(f"{tmp_path}/usage")
    kept = capacity.current(spark.read.schema(usage.schema).parquet(f"{tmp_path}/usage"), F.lit(NOW), 5)
    instances = rows("namespace string, pool string, instance string, state string", ("n", "p", "a", "Running"))
    ask = rows("namespace string, pod string, container string, resource string, request_milli long", ("n", "a-driver", "c", "cpu", 1))
    plan = load.pool_utilisation(instances, kept, ask)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(tick," in plan and "LessThanOrEqual(tick," in plan


def test_amounts_are_summed_exactly_and_unreadable_pods_left_out(rows):
    instances = rows("namespace string, pool string, instance string, state string", ("n", "p", "a", "Running"), ("n", "p", "b", "Running"))
    usage = rows("namespace string, pod string, container string, resource string, tick timestamp_ntz, usage_milli decimal(38,6)",
                 ("n", "a-driver", "c1", "cpu", NOW, Decimal("0.4")), ("n", "a-driver", "c2", "cpu", NOW, Decimal("0.4")),
                 ("n", "b-driver", "c1", "cpu", NOW, None), ("n", "b-driver", "c2", "cpu", NOW, Decimal(5)))
    ask = rows("namespace string, pod string, container string, resource string, request_milli long",
               *[("n", f"{p}-driver", c, "cpu", 10) for p in "ab" for c in ("c1", "c2")])
    assert column(load.pod_utilisation(instances, usage, ask), "pod", "usage", "request") == [("a-driver", 1, 20)]


def test_utilisation_takes_joined_containers_and_unweighted_pods(rows):
    instances = rows("namespace string, pool string, instance string, state string",
                     ("n", "p", "a", "Running"), ("n", "p", "b", "Running"), ("n", "p", "z", "Running"), ("n", "p", "d", "Draining"))
    usage = [("a", "c1", 500), ("a", "c2", 100), ("a", "extra", 9000), ("b", "c1", 50), ("z", "c1", 10), ("d", "c1", 10)]
    ask = [("a", "c1", 1000), ("a", "c2", 1000), ("a", "unused", 5000), ("b", "c1", 100), ("z", "c1", 0), ("d", "c1", 10)]
    usage = rows("namespace string, pod string, container string, resource string, tick timestamp_ntz, usage_milli long",
                 *[("n", f"{i}-driver", c, "cpu", NOW, u) for i, c, u in usage])
    ask = rows("namespace string, pod string, container string, resource string, request_milli long",
               *[("n", f"{i}-driver", c, "cpu", u) for i, c, u in ask])
    (got,) = load.pool_utilisation(instances, usage, ask).collect()
    assert (got.measured_pods, got.mean_percent, got.mean_micro_percent) == (2, 40.0, 40_000_000)


SESSION = "namespace string, session string, user_name string, pool string, state string, assigned_instance string, last_activity_at timestamp_ntz"
POOLS = "namespace string, pool string, max_sessions_per_user int, max_total_sessions int, idle_timeout_minutes int"
QUOTAS = "namespace string, pool string, match_user string, pos int, max_sessions_per_user int"


def test_transitions(rows):
    table = [
        ("gone_new", "u", "missing", "Pending", "", None, "Failed", "pool_missing"),
        ("placed", "u", "p", "Pending", "", None, "Active", "placed"),
        ("new", "u2", "p", "", "", None, "Active", "placed"),
        ("stuck", "u", "empty", "Pending", "", None, "Pending", "no_running_instance"),
        ("gone", "v", "missing", "Active", "i", NOW, "Terminated", "pool_deleted"),
        ("lost", "v", "p", "Idle", "x", NOW, "Pending", "instance_lost"),
        ("drain", "v", "p", "Active", "d", NOW, "Pending", "instance_lost"),
        ("at_timeout", "v", "p", "Idle", "i", ago(minutes=720), "Idle", "none"),
        ("timeout", "v", "p", "Active", "i", ago(minutes=720, microseconds=1), "Terminating", "idle_timeout"),
        ("zero", "v", "zero", "Idle", "k", ago(minutes=721), "Terminating", "idle_timeout"),
        ("at_mark", "v", "p", "Active", "i", ago(minutes=10), "Active", "none"),
        ("mark", "v", "p", "Active", "i", ago(minutes=11), "Idle", "idle_mark"),
        ("idle", "v", "p", "Idle", "i", ago(minutes=11), "Idle", "none"),
        ("never", "v", "p", "Active", "i", None, "Active", "none"),
        ("closing", "v", "p", "Terminating", "i", NOW, "Terminated", "closing"),
        ("done", "v", "p", "Terminated", "i", NOW, "Terminated", "none"),
        ("failed", "v", "p", "Failed", "i", NOW, "Failed", "none"),
        ("odd", "v", "p", "Assigning", "i", NOW, "Assigning", "none"),
    ]
    snapshot = rows(SESSION, *[("n", s, u, p, st, i, at) for s, u, p, st, i, at, _, _ in table])
    pools = rows(POOLS, ("n", "p", 50, 200, 720), ("n", "empty", 5, 200, 720), ("n", "zero", 5, 200, 0))
    instances = rows("namespace string, pool string, instance string, state string",
                     ("n", "p", "i", "Running"), ("n", "p", "d", "Draining"), ("n", "zero", "k", "Running"))
    quotas = rows(QUOTAS)
    got = sessions.session_transitions(snapshot, pools, instances, quotas, as_of())
    assert sorted(column(got, "session", "next_state", "reason")) == sorted((r[0], r[6], r[7]) for r in table)


def _check(rows, others, pool=("n", "p", 2, 4, 720), overrides=(), me=("n", "me", "u", "p", "Pending", "", None)):
    snapshot = rows(SESSION, me, *[("n", f"s{i}", u, "p", st, "i", None) for i, (u, st) in enumerate(others)])
    got = quota.quota_check(snapshot, rows(POOLS, pool), rows(QUOTAS, *overrides)).filter("session = 'me'")
    return column(got, "verdict", "message")[0]


def test_quota_check(rows):
    assert _check(rows, [("u", "Active")]) == ("ok", "")
    assert _check(rows, [("u", "Active"), ("u", "Idle")]) == ("user_over_quota", "user u has reached max sessions (2/2)")
    assert _check(rows, [("u", "Active"), ("u", "")]) == ("ok", "")
    assert _check(rows, [("u", "Active"), ("u", "Failed")]) == ("ok", "")
    assert _check(rows, [("a", "Active")] * 4) == ("pool_over_quota", "pool p has reached max total sessions (4/4)")
    assert _check(rows, [("a", "Active")] * 3) == ("ok", "")
    assert _check(rows, [("u", "Active")] * 9, pool=("n", "p", 0, 0, 720)) == ("ok", "")
    assert _check(rows, [("u", "Active")] * 2, pool=("n", "q", 1, 1, 720)) == ("pool_missing", "pool p not found")
    assert _check(rows, [("u", "Active")] * 2, me=("n", "me", "u", "p", "", "", None))[0] == "user_over_quota"


def test_quota_overrides(rows):
    rule = lambda pos, limit, user="u": ("n", "p", user, pos, limit)
    two = [("u", "Active")] * 2
    assert _check(rows, two, overrides=[rule(0, 3)])[0] == "ok"
    assert _check(rows, two[:1], overrides=[rule(0, 1)]) == ("user_over_quota", "user u has reached max sessions (1/1)")
    assert _check(rows, two, overrides=[rule(0, 3), rule(1, 1)])[0] == "user_over_quota"
    assert _check(rows, two, overrides=[rule(0, 1), rule(1, 3)])[0] == "ok"
    assert _check(rows, two, overrides=[rule(0, 3), rule(1, 0)])[0] == "ok"
    assert _check(rows, two, overrides=[rule(0, 3, "other")])[0] == "user_over_quota"


def test_quota_audit(rows):
    history = rows(
        "namespace string, pool string, user_name string, started_at timestamp_ntz, ended_at timestamp_ntz",
        ("n", "p", "a", ago(hours=30), ago(hours=10)), ("n", "p", "b", ago(hours=28), ago(hours=20)),
        ("n", "p", "c", ago(hours=20), ago(hours=20)), ("n", "p", "d", ago(hours=5), None), ("n", "p", "e", ago(hours=2), None))
    limits = rows("namespace string, pool string, session_limit int", ("n", "p", 1))
    (got,) = quota.quota_audit(history, limits, V.POOL, as_of()).collect()
    assert (got.peak, got.first_breach, got.breaches, got.minutes_over) == (2, ago(hours=28), 2, 8 * 60 + 2 * 60)


def test_placement(rows):
    pools = rows("namespace string, pool string, type string",
                 ("n", "tie", "connect"), ("n", "drain", "thrift"), ("n", "odd", "batch"), ("n", "none", "thrift"), ("n", "thr", "thrift"))
    seats = [("tie", "b", 0, "Running", 3), ("tie", "a", 1, "Running", 3), ("tie", "c", 2, "Running", 4), ("tie", "d", 3, "Pending", 0),
             ("drain", "e", 0, "Draining", 0), ("odd", "f", 0, "Running", 1), ("thr", "g", 0, "Running", 9)]
    loads = rows("namespace string, pool string, instance string, pos long, state string, active_sessions long",
                 *[("n", *s) for s in seats])
    ends = rows("namespace string, pool string, instance string, endpoint string", *[("n", s[0], s[1], f"{s[1]}.svc") for s in seats])
    got = sessions.placement_candidates(pools, loads, ends)
    assert sorted(column(got, "pool", "instance", "endpoint"), key=str) == sorted([
        ("tie", "b", "b.svc:8424"), ("drain", None, None), ("odd", "f", "f.svc:"), ("none", None, None), ("thr", "g", "g.svc:10001")], key=str)


def test_endpoints_take_the_first_driver_service(rows):
    instances = rows("namespace string, app_id string, instance string, state string",
                     ("n", "a", "i", "Running"), ("n", "b", "j", "Pending"), ("n", "", "k", "Running"), ("n", "c", "l", "Draining"))
    services = rows("namespace string, app_id string, service string, pos int",
                    ("n", "a", "z-driver-svc", 1), ("n", "a", "y-driver-svc", 2), ("n", "a", "x-ui", 0), ("n", "b", "q-driver-svc", 0),
                    ("n", "c", "c-driver-svc", 0), ("m", "a", "w-driver-svc", 0))
    got = sessions.instance_endpoints(instances, services)
    assert sorted(column(got, "instance", "endpoint")) == [("i", "z-driver-svc.n.svc"), ("j", ""), ("k", ""), ("l", "c-driver-svc.n.svc")]


@pytest.mark.parametrize("forwarded, host, want", [
    ("h", "", "h"), ("h:443", "x", "h"), ("", "h:80", "h"), (None, "h", "h"), (":443", "", ":443"), ("[::1]:80", "", "[::1]"),
    ("::1", "", ":"), ("", "", ""), (None, None, ""), ("a:b:c", "", "a:b"), ("h:", "", "h"),
])
def test_request_host(rows, forwarded, host, want):
    df = rows("forwarded_host string, authority string, door string", (forwarded, host, "thrift"))
    assert column(df.select(hosts.request_host().alias("h")), "h") == [want]


@pytest.mark.parametrize("door, forwarded, want", [("connect", "", ""), ("connect", None, "h"), ("thrift", "", "h"), ("connect", "f:1", "f")])
def test_empty_forwarded_host_counts_at_the_connect_door(rows, door, forwarded, want):
    df = rows("forwarded_host string, authority string, door string", (forwarded, "h:80", door))
    assert column(df.select(hosts.request_host().alias("h")), "h") == [want]


@pytest.mark.parametrize("door, want", [("connect", ("al", "explicit")), ("thrift", (None, "none")), (None, (None, "none"))])
def test_names_beside_the_header_count_at_the_connect_door(rows, door, want):
    df = rows("request_id int, door string, authorization string, header_user string, has_password boolean, user_id string",
              (1, door, None, "al", True, "bo"))
    assert column(views.access_identity(df), "user_name", "source") == [want]


def test_routing(rows):
    pools = rows("namespace string, pool string, pos long, type string, host string",
                 ("n", "late", 2, "connect", "two"), ("n", "early", 1, "thrift", "two"), ("n", "solo", 3, "connect", "one"),
                 ("m", "a", 1, "thrift", "ha"), ("m", "b", 2, "connect", "hb"), ("k", "c", 1, "connect", "hc"), ("k", "d", 1, "connect", "hd"))
    asked = [("r1", "n", "two", "thrift"), ("r2", "n", "two", "connect"), ("r3", "n", "nope", "connect"), ("r4", "m", "", "connect"),
             ("r5", "k", "", "connect"), ("r6", "k", "", "thrift"), ("r7", "n", "ha", "thrift")]
    requests = rows("request_id string, namespace string, forwarded_host string, door string, authority string, user_name string",
                    *[(*a, "", "u") for a in asked])
    got = {r.request_id: (r.pool, r.status) for r in routing.route_requests(requests, pools).collect()}
    assert got == {"r1": ("early", "ok"), "r2": ("early", "wrong_type"), "r3": (None, "no_pool"), "r4": ("b", "ok"),
                   "r5": (None, "ambiguous"), "r6": (None, "none_of_type"), "r7": (None, "no_pool")}


def test_session_reuse_takes_the_oldest_usable(rows):
    routed = rows("request_id int, namespace string, pool string, user_name string, status string",
                  (1, "n", "p", "u", "ok"), (2, "n", "p", "v", "ok"), (3, "n", "p", "u", "no_pool"))
    plain = rows("namespace string, session string, user_name string, pool string, state string, created_at timestamp_ntz",
                 ("n", "dead", "u", "p", "Failed", ago(hours=9)), ("n", "blank", "u", "p", "", ago(hours=8)),
                 ("n", "b", "u", "p", "Idle", ago(hours=5)), ("n", "a", "u", "p", "Pending", ago(hours=5)), ("n", "c", "v", "q", "Active", NOW))
    label = lambda user, pool: F.create_map(F.lit("x/user"), user, F.lit("x/pool"), pool)
    table = plain.withColumn("labels", label(F.col("user_name"), F.col("pool")))
    assert sorted(column(sessions.session_reuse(routed, table, "x"), "request_id", "session"), key=str) == [(1, "a"), (2, None)]
    # The labels decide, not the columns.
    other = plain.withColumns({"labels": label(F.lit("v"), F.lit("p")), "user_name": F.lit("u")})
    assert sorted(column(sessions.session_reuse(routed, other, "x"), "request_id", "session"), key=str) == [(1, None), (2, "a")]


def test_activation_wait(rows):
    t = ago(hours=2)
    at = lambda s: t + timedelta(seconds=s)
    changes = {
        "at_60": [(0, 0, "Pending"), (60, 1, "Active")], "late": [(0, 0, "Pending"), (60.000001, 1, "Active")],
        "failed_first": [(5, 0, "Failed"), (9, 1, "Active")], "never": [(0, 0, "Pending")], "already": [(-4000, 0, "Idle")],
        "ended": [(-90000, 0, "Active"), (-5000, 1, "Terminated")], "none": [], "same_moment": [(0, 0, "Active"), (0, 1, "Pending"), (7.9, 2, "Idle")],
        "next_hour": [(0, 0, "Pending"), (30, 1, "Active")],
    }
    rows_in = [("n", s, at(dt), seq, state) for s, cs in changes.items() for dt, seq, state in cs]
    asked = [("n", s, t) for s in changes] + [("n", "recent", ago(seconds=30))]
    got = sessions.activation_wait(
        rows("namespace string, session string, ts timestamp_ntz", *asked),
        rows("namespace string, session string, ts timestamp_ntz, seq long, state string", *rows_in), as_of())
    assert sorted(column(got, "session", "wait_seconds", "outcome"), key=str) == sorted([
        ("at_60", 60, "ok"), ("late", None, "timeout"), ("failed_first", 5, "failed"), ("never", None, "timeout"), ("already", 0, "ok"),
        ("ended", 0, "failed"), ("none", None, "timeout"), ("same_moment", 7, "ok"), ("next_hour", 30, "ok"), ("recent", None, "pending")], key=str)


def test_activation_wait_across_hours(rows):
    t = datetime(2024, 1, 30, 23, 59, 50)
    asked = rows("namespace string, session string, ts timestamp_ntz", ("n", "s", t))
    changes = rows("namespace string, session string, ts timestamp_ntz, seq long, state string",
                   ("n", "s", t - timedelta(hours=5), 0, "Pending"), ("n", "s", t + timedelta(seconds=20), 1, "Active"))
    assert column(sessions.activation_wait(asked, changes, as_of()), "wait_seconds", "outcome") == [(20, "ok")]


def test_idle_sessions_cut_strictly_after_the_timeout(rows):
    pools = rows("namespace string, pool string, idle_timeout_minutes int", ("n", "p", 30))
    t = ago(hours=9)
    offsets = [0, 30 * 60, 60 * 60 + 0.000001, 60 * 60 + 5, 60 * 60 + 5]
    touches = rows("namespace string, pool string, user_name string, ts timestamp_ntz",
                   *[("n", "p", "u", t + timedelta(seconds=s)) for s in offsets], ("n", "other", "u", t))
    got = sessions.idle_sessions(touches, pools).filter("pool = 'p'")
    assert sorted(column(got, "touches")) == [2, 3]


def test_scaling_audit(rows):
    pools = rows("namespace string, pool string, min_replicas int, max_replicas int, metric_type string, target_per_instance int, "
                 "scale_up_threshold string, cooldown_seconds int, idle_timeout_minutes int", ("n", "p", 0, 1, "", 1, "", 0, 0))
    t = datetime(2024, 1, 30, 23, 58)
    log = rows("namespace string, pool string, action_id long, ts timestamp_ntz, action string",
               ("n", "p", 1, t, "shrink"), ("n", "p", 2, t + timedelta(seconds=10), "grow"),
               ("n", "p", 3, t + timedelta(seconds=300), "shrink"), ("n", "p", 4, t + timedelta(seconds=601), "shrink"))
    got = capacity.scaling_audit(log, pools)
    assert sorted(column(got, "action_id", "seconds_since_previous", "inside_cooldown"), key=str) == [(1, None, False), (3, 300, True), (4, 301, False)]


def test_route_drift(rows):
    pools = rows("namespace string, pool string, type string, host string",
                 ("n", "same", "connect", "h"), ("n", "odd", "batch", "h"), ("n", "none", "thrift", "h"), ("n", "bare", "thrift", "h"))
    want = routing.desired_routes(pools, "x.io", "boss", "proxy", "edge")
    assert sorted(column(want, "namespace", "route", "port")) == [
        ("edge", "bare-thrift", 10009), ("edge", "none-thrift", 10009), ("edge", "same-connect", 15002)]
    kept = want.filter("pool = 'same'").withColumn("annotations", maps.overlay(F.col("annotations"), maps.literal({"own": "1"})))
    bare = want.filter("pool = 'bare'").withColumns({"annotations": F.lit(None).cast("map<string,string>"), "port": F.lit(1)})
    gone = kept.withColumn("route", F.lit("gone-connect"))
    foreign = gone.withColumns({"route": F.lit("foreign"), "labels": maps.empty()})
    got = routing.route_drift(want, kept.unionByName(bare).unionByName(gone).unionByName(foreign), "x.io", "boss")
    verdicts = {r.route: (r.verdict, r.differs.count("annotation:"), r.differs.startswith("port")) for r in got.collect()}
    assert verdicts == {"same-connect": ("keep", 0, False), "none-thrift": ("create", 0, False),
                        "bare-thrift": ("update", 5, True), "gone-connect": ("delete", 0, False)}


def test_contains_all_reads_an_absent_key_as_empty(rows):
    df = rows("w map<string,string>, a map<string,string>", ({"k": ""}, {}), ({"k": "v"}, {}), ({"k": "v"}, None), ({}, None), ({"k": "v"}, {"k": "v", "z": "1"}))
    assert column(df.select(maps.contains_all(F.col("w"), F.col("a")).alias("c")), "c") == [True, False, False, True, True]


def test_effective_conf_layers(rows):
    pools = rows("namespace string, pool string, default_session_conf map<string,string>", ("n", "p", {"a": "1", "b": "1", "c": "1"}))
    quotas = rows("namespace string, pool string, match_user string, pos int, session_conf map<string,string>", ("n", "p", "u", 0, {"b": "2", "c": "2"}))
    table = rows("namespace string, pool string, session string, user_name string, spark_conf map<string,string>",
                 ("n", "p", "s", "u", {"c": "3"}), ("n", "p", "t", "v", None), ("n", "q", "w", "u", {}))
    got = sorted(column(views.effective_conf(table, pools, quotas), "session", "conf_key", "conf_value", "origin"))
    assert got == [("s", "a", "1", "pool"), ("s", "b", "2", "quota"), ("s", "c", "3", "session"),
                   ("t", "a", "1", "pool"), ("t", "b", "1", "pool"), ("t", "c", "1", "pool")]


def _b64(text):
    import base64

    return base64.b64encode(text.encode()).decode()


@pytest.mark.parametrize("header, want", [
    (f"Basic {_b64('al:pw')}", "al"), (f"BEARER {_b64('al:pw')}", "al"), (_b64("al:pw"), None), (f"Basic {_b64('al')}", None),
    (f"Basic {_b64(':pw')}", None), (f"Basic {_b64('al:p:w')}", "al"), (f"Digest {_b64('al:pw')}", None), ("Basic !!", None),
    ("Basic YWw6cHc", None), (f"Basic {_b64('al:pw')} x", None), ("Basic ", None), (None, None), (f"Basic  {_b64('al:pw')}", None),
])
def test_header_user(rows, header, want):
    df = rows("authorization string", (header,))
    assert column(df.select(identity.header_user().alias("u")), "u") == [want]


@pytest.mark.parametrize("text_in, want", [("plain", "plain"), (_b64("in:pw"), "in"), (_b64(":pw"), _b64(":pw")), ("", None), (None, None), (_b64("nocolon"), _b64("nocolon"))])
def test_message_user(rows, text_in, want):
    df = rows("user_id string", (text_in,))
    assert column(df.select(identity.message_user().alias("u")), "u") == [want]


def test_explicit_user_needs_a_password_beside_it(rows):
    df = rows("header_user string, has_password boolean", ("a", True), ("a", False), ("", True), (None, True))
    assert column(df.select(identity.explicit_user().alias("u")), "u") == ["a", None, None, None]


def _token(claims, head='{"alg":"RS256"}'):
    import base64

    url = lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("=")
    return ".".join([url(head), url(claims), "sig"])


@pytest.mark.parametrize("token, user, groups", [
    (_token('{"sub":"al","groups":["a","b"]}'), "al", ["a", "b"]), (_token('{"sub":5,"groups":["a"]}'), None, None),
    (_token('{"sub":"al","groups":["a",1,null,{"x":1},"c"]}'), "al", ["a", "c"]), (_token('{"sub":"al","groups":"a"}'), "al", []),
    (_token('{"sub":"al"}'), "al", []), (_token('{"sub":""}'), None, None), (_token('{"other":"al"}'), None, None),
    (_token("not json"), None, None), (_token('{"sub":"al"}', '{"alg":"what"}'), None, None), (_token('{"sub":"al"}', "{}"), None, None),
    (_token('{"sub":"al"}') + ".more", None, None), ("x", None, None), (None, None, None), (_token('{"sub":"日本?>"}'), "日本?>", []),
])
def test_token_claims(rows, token, user, groups):
    (got,) = views.token_claims(rows("token string", (token,))).collect()
    assert (got.claimed_user, got.claimed_groups) == (user, groups)


def test_token_claims_under_other_names(rows):
    (got,) = views.token_claims(rows("token string", (_token('{"preferred_username":"al","roles":["r"]}'),)), "preferred_username", "roles").collect()
    assert (got.claimed_user, got.claimed_groups) == ("al", ["r"])


def test_claim_names_are_whole_names(rows):
    token = _token('{"https://x/groups":["g"],"preferred.name":"al","it\'s":"bo"}')
    (got,) = views.token_claims(rows("token string", (token,)), "preferred.name", "https://x/groups").collect()
    assert (got.claimed_user, got.claimed_groups) == ("al", ["g"])
    assert column(views.token_claims(rows("token string", (token,)), "it's"), "claimed_user") == ["bo"]


def test_long_base64_is_no_trouble(rows):
    long = "u" * 200_000
    df = rows("authorization string, token string", (f"Basic {_b64(long + ':pw')}", _token('{"sub":"%s"}' % long)))
    assert column(df.select(identity.header_user().alias("u")), "u") == [long]
    assert column(views.token_claims(df), "claimed_user") == [long]


def test_bounded_message(rows):
    cut = V.MESSAGE_SUFFIX.encode()
    cases = {"a" * 1024: b"a" * 1024, "a" * 1025: b"a" * 1024 + cut, "é" * 600: ("é" * 512).encode() + cut,
             "a" + "é" * 600: b"a" + ("é" * 511).encode() + "é".encode()[:1] + cut, "": b""}
    df = rows("m string", *[(m,) for m in cases])
    assert [bytes(b) for b in column(df.select(text.bounded_bytes(F.col("m")).alias("b")), "b")] == list(cases.values())
    assert column(df.select(text.bounded_message(F.col("m")).alias("b")), "b")[3].endswith("�" + V.MESSAGE_SUFFIX)


@pytest.mark.parametrize("amount, want", [
    ("100m", 100), ("2", 2000), ("0.1", 100), ("1e3", 1_000_000), ("12E2", 1_200_000), ("1Ki", 1_024_000), ("1.5Gi", 1_610_612_736_000),
    ("16Gi", 17_179_869_184_000), ("1n", "0.000001"), ("1500u", "1.5"), ("1234567n", "1.234567"),
    ("10P", 10**19), ("1E", 10**21), ("1Ei", 2**60 * 1000), ("1K", None), ("bad", None), ("", None), ("1 ", None), ("1mm", None), (None, None), ("3M", 3_000_000_000),
])
def test_quantity(rows, amount, want):
    assert column(rows("q string", (amount,)).select(quantity.milli(F.col("q")).alias("m")), "m") == [
        None if want is None else Decimal(want)]


@pytest.mark.parametrize("raw, want", [("0.5", 0.5), ("", 0.8), ("0", 0.8), ("abc", 0.8), (None, 0.8), ("1e-1", 0.1), (" 0.5", 0.8), ("0.5d", 0.8), (".5", 0.5)])
def test_scale_up_threshold(rows, raw, want):
    df = rows("scale_up_threshold string", (raw,))
    assert column(df.select(settings.scale_up_threshold().alias("t")), "t") == [want]


def test_pool_health(rows):
    df = rows("ready_replicas int, current_replicas int", (0, 0), (0, 1), (1, 2), (2, 2))
    assert column(df.select(states.pool_health().alias("h")), "h") == ["zero", "not-ready", "not-ready", "ready"]


def test_reusable_states(rows):
    df = rows("state string", *[(s,) for s in ["Active", "Idle", "Pending", "Assigning", "", None, "Failed", "Terminating"]])
    assert column(df.select(states.is_reusable().alias("r")), "r") == [True] * 4 + [False] * 4
    assert column(df.select(states.is_reusable(known=True).alias("r")), "r") == [True] * 6 + [False] * 2


def test_touches_wake_idle_sessions_and_never_move_back(rows):
    schema = "namespace string, session string, user_name string, state string, last_activity_at timestamp_ntz"
    table = rows(schema, ("n", "idle", "u", "Idle", ago(hours=2)), ("n", "late", "u", "Idle", ago(hours=1)), ("n", "none", "u", "Idle", None),
                 ("n", "busy", "u", "Active", ago(hours=2)), ("n", "still", "u", "Idle", ago(hours=3)))
    touched = rows("namespace string, session string, ts timestamp_ntz", *[("n", s, ago(minutes=90 + m)) for s in ("idle", "late", "none", "busy") for m in (0, 5)])
    got = sessions.touched_sessions(table, touched)
    t = ago(minutes=90)
    assert sorted(column(got, "session", "state", "last_activity_at")) == [
        ("busy", "Active", t), ("idle", "Active", t), ("late", "Idle", ago(hours=1)), ("none", "Active", t), ("still", "Idle", ago(hours=3))]


def test_termination_needs_the_owner(rows):
    table = rows("namespace string, session string, user_name string", ("n", "s", "u"))
    asked = rows("request_id int, namespace string, session string, user_name string", (1, "n", "s", "u"), (2, "n", "s", "v"), (3, "m", "s", "u"))
    got = sessions.termination_requests(table, asked)
    assert sorted(column(got, "request_id", "answer", "next_state"), key=str) == [
        (1, "accepted", "Terminating"), (2, "forbidden", None), (3, "not_found", None)]


def test_group_limits_take_the_last_rule_of_any_group(rows):
    rules = rows("namespace string, pool string, pos int, match_group string, max_sessions_per_user int",
                 ("n", "p", 0, "g", 3), ("n", "p", 1, "h", 9), ("n", "p", 2, "g", 0), ("n", "q", 5, "g", 8))
    users = rows("namespace string, pool string, user_name string, groups array<string>",
                 ("n", "p", "u", ["g", "h", "g"]), ("n", "p", "v", ["g"]), ("n", "p", "w", []), ("n", "q", "v", ["g"]), ("m", "p", "u", ["g"]))
    got = quota.group_quota_limits(users, rules)
    assert sorted(column(got, "pool", "user_name", "override")) == [("p", "u", 9), ("p", "v", 3), ("q", "v", 8)]


def test_cooldown_and_idle_are_strict(rows):
    df = rows("t timestamp_ntz", (None,), (ago(seconds=300),), (ago(seconds=301),))
    assert column(df.select(timing.cooldown_over("t", as_of(), F.lit(300)).alias("c")), "c") == [True, False, True]
    assert column(df.select(timing.idle_longer_than("t", as_of(), F.lit(5)).alias("c")), "c") == [False, False, True]
