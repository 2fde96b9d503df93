"""The whole life of sessions as a stream: every rule, other batch cuts, and the batch job at the snapshot."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from poolwatch.plans import sessions as plans
from poolwatch.streaming import jobs, run
from poolwatch.streaming.life import _NEVER, SessionLife
from test_streaming import T, feed, minutes  # noqa: F401

SESSIONS = ("namespace string, pool string, session string, user_name string, state string, assigned_instance string, endpoint string, "
            "created_at timestamp, last_activity_at timestamp")
POOLS = "namespace string, pool string, idle_timeout_minutes int, ts timestamp, known boolean"
INSTANCES = "namespace string, pool string, instance string, state string, ts timestamp"
TOUCHES = "namespace string, pool string, session string, ts timestamp"
ASKS = TOUCHES + ", user_name string"
OUTLOOK = TOUCHES + ", outlook string, verdict string, instance string, endpoint string"
SHARDS = 2


def at(m):
    return T + timedelta(minutes=m)


def told(df, session=None):
    rows = df.collect() if session is None else df.filter(F.col("session") == session).collect()
    return [(minutes(r.changed_at), r.state, r.reason) for r in sorted(rows, key=lambda r: (r.changed_at, r.step))]


@pytest.fixture
def life(feed, rows):  # noqa: F811
    def make(snapshot, *kinds, pools=(("n", "p", 30),), instances=(("n", "p", "i", "Running"),), cut=False):
        """`kinds`: a builder of news, its schema and its rows; a last batch moves the clock far ahead.
        With `cut` the rows come in batches by their time, those of a batch in any order."""
        news, place = None, lambda schema: [c.split()[0] for c in schema.split(", ")].index("ts")
        times = sorted(r[place(schema)] for _, schema, data in kinds for r in data)
        edges = [times[len(times) * k // 5] for k in range(1, 5)] if cut else []
        for build, schema, data in kinds:
            index = place(schema)
            other = lambda ts: [tuple(ts if i == index else "clock" if i == 1 else v for i, v in enumerate(data[0]))]  # noqa: B023, E731
            batches = [other(T) for _ in range(len(edges) + 1)]
            for r in reversed(data):
                batches[sum(r[index] >= e for e in edges)].append(r)
            batches += [other(at(100_000))] * 2
            part = build(feed(schema, *batches), SHARDS)
            news = part if news is None else news.unionByName(part)
        start = jobs.life_snapshot(
            rows(SESSIONS, *snapshot), rows("namespace string, pool string, idle_timeout_minutes int", *pools),
            rows("namespace string, pool string, instance string, state string", *instances), F.lit(T), SHARDS)
        return run.finish(jobs.session_transitions(news, start), "life").filter("pool <> 'clock'")

    return make


def one(session, state="Active", last=0, instance="i", pool="p", user="u"):
    return ("n", pool, session, user, state, instance, "e", at(-100), None if last is None else at(last))


@pytest.mark.parametrize("cut", [False, True])
def test_every_rule(life, cut):
    got = life(
        [one("touched"), one("asked"), one("lost", instance="j"), one("new", "Pending", None, ""), one("over", "", None, ""),
         one("waits", "Pending", None, ""), one("still", "Active", None), one("wakes", "Idle", -15)],
        (jobs.touch_news, TOUCHES, [("n", "p", "touched", at(5)), ("n", "p", "touched", at(3)), ("n", "p", "none", at(4)), ("n", "p", "wakes", at(2))]),
        (jobs.end_news, ASKS, [("n", "p", "asked", at(4), "other"), ("n", "p", "asked", at(12), "u"), ("n", "p", "asked", at(13), "u")]),
        (jobs.instance_news, INSTANCES, [("n", "p", "j", "Draining", at(3)), ("n", "p", "k", "Running", at(3))]),
        (jobs.outlook_news, OUTLOOK, [
            ("n", "p", "new", at(1), "placed", "ok", "i", "e2"), ("n", "p", "over", at(1), "refused", "user_over_quota", None, None),
            ("n", "p", "waits", at(1), "no running instance", "ok", None, None), ("n", "p", "lost", at(6), "placed", "ok", "k", "e3")]),
        (jobs.pool_news, POOLS, [("n", "p", 30, at(60), False)]),
        (jobs.record_news, ASKS, [("n", "p", "fresh", at(20), "v")]),
        instances=[("n", "p", "i", "Running"), ("n", "p", "j", "Running")], cut=cut,
    )
    assert told(got, "touched") == [(15, "Idle", "idle_mark"), (35, "Terminating", "idle_timeout"), (35, "Terminated", "closing")]
    assert told(got, "asked") == [(10, "Idle", "idle_mark"), (12, "Terminating", "ended_by_owner"), (12, "Terminated", "closing")]
    assert told(got, "lost") == [
        (3, "Pending", "instance_lost"), (6, "Active", "placed"), (16, "Idle", "idle_mark"), (36, "Terminating", "idle_timeout"), (36, "Terminated", "closing")]
    assert told(got, "new")[0] == (1, "Active", "placed") and told(got, "over") == [(1, "Failed", "user_over_quota")]
    assert told(got, "waits") == [(60, "Failed", "pool_missing")] and told(got, "fresh") == [(60, "Failed", "pool_missing")]
    assert told(got, "still") == [(60, "Terminated", "pool_deleted")]
    assert told(got, "wakes")[:2] == [(2, "Active", "touched"), (12, "Idle", "idle_mark")]
    assert told(got, "none") == []
    by = {(r.session, r.reason): r for r in got.collect()}
    lost, placed = by["lost", "instance_lost"], by["lost", "placed"]
    assert (lost.assigned_instance, lost.endpoint, minutes(lost.created_at)) == ("", "", -100)
    assert (placed.assigned_instance, placed.endpoint, minutes(placed.created_at), minutes(placed.last_activity_at)) == ("k", "e3", 6, 6)
    assert by["over", "user_over_quota"].created_at == at(-100) and by["over", "user_over_quota"].last_activity_at is None


def test_limits_are_strict_and_a_changed_timeout_counts(life):
    got = life(
        [one("a", last=-10), one("b", last=-31), one("c", "Idle", -20), one("d", "Idle", -25), one("e", "Idle", -10)],
        (jobs.touch_news, TOUCHES, [("n", "p", "a", at(0.5)), ("n", "p", "d", at(5))]),
        (jobs.pool_news, POOLS, [("n", "p", 22, at(3), True), ("n", "p", 500, at(6), True)]),
    )
    # At ten minutes to the second a session is not idle yet, but a moment later it is.
    assert told(got, "a")[:3] == [(0, "Idle", "idle_mark"), (0.5, "Active", "touched"), (10.5, "Idle", "idle_mark")]
    assert told(got, "b") == [(0, "Terminating", "idle_timeout"), (0, "Terminated", "closing")]
    # A shorter timeout ends at once what is beyond it; a longer one is waited for.
    assert told(got, "c") == told(got, "d") == [(3, "Terminating", "idle_timeout"), (3, "Terminated", "closing")]
    assert told(got, "e") == [(490, "Terminating", "idle_timeout"), (490, "Terminated", "closing")]


def test_cuts_change_nothing(life):
    pick = random.Random(4)
    names = [f"s{k}" for k in range(30)]
    snapshot = [one(n, pick.choice(["Active", "Active", "Idle", "Pending", "", "Terminating"]), pick.choice([None, -50, -12, -3, 0]), pick.choice("iijj")) for n in names]
    some = lambda n: [("n", "p", pick.choice(names), at(pick.randrange(0, 900) / 10)) for _ in range(n)]
    kinds = [
        (jobs.touch_news, TOUCHES, some(30)), (jobs.end_news, ASKS, [(*r, pick.choice("uv")) for r in some(4)]),
        (jobs.instance_news, INSTANCES, [("n", "p", pick.choice("ij"), pick.choice(["Running", "Failed"]), at(pick.randrange(90))) for _ in range(4)]),
        (jobs.outlook_news, OUTLOOK, [(*r, "placed", "ok", pick.choice("ij"), "e") for r in some(12)]),
        (jobs.pool_news, POOLS, [("n", "p", pick.choice([5, 12, 40]), at(pick.randrange(90)), True) for _ in range(3)]),
    ]
    seats = [("n", "p", "i", "Running"), ("n", "p", "j", "Running")]
    whole, parts = (life(snapshot, *kinds, instances=seats, cut=cut) for cut in (False, True))
    by_session = lambda df: {n: told(df, n) for n in names}
    assert by_session(whole) == by_session(parts)
    assert sum(map(len, by_session(whole).values())) > 20


def test_snapshot_equals_the_batch_job(life, rows):
    pick = random.Random(5)
    snapshot = [
        one(f"s{k}", pick.choice(["Active", "Idle", "Terminating", "Terminated", "Failed", "Active"]), pick.choice([None, -800, -31, -30, -11, -10, -1]),
            pick.choice(["i", "j", "gone"]), pick.choice(["p", "q", "missing"]))
        for k in range(120)
    ]
    pools = [("n", "p", 30), ("n", "q", 0)]
    seats = [("n", pool, i, state) for pool in "pq" for i, state in (("i", "Running"), ("j", "Draining"))]
    got = life(snapshot, (jobs.touch_news, TOUCHES, [("n", "p", "none", at(1))]), pools=pools, instances=seats)
    first = {r.session: (r.state, r.reason) for r in got.orderBy(F.desc("changed_at"), F.desc("step")).collect() if minutes(r.changed_at) == 0}
    full = "namespace string, pool string, idle_timeout_minutes int, max_sessions_per_user int, max_total_sessions int"
    want = plans.session_transitions(
        rows(SESSIONS, *snapshot).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "last_activity_at")}),
        rows(full, *[(*p, 5, 100) for p in pools]), rows("namespace string, pool string, instance string, state string, pos int", *[(*s, 0) for s in seats]),
        rows("namespace string, pool string, match_user string, pos int, max_sessions_per_user int"), F.lit(T).cast("timestamp_ntz"),
    ).filter("reason <> 'none'")
    assert first == {r.session: (r.next_state, r.reason) for r in want.collect()}
    assert len(first) > 60


def test_snapshot_alone_is_dated(life):
    got = life([one("x", "Terminating")], (jobs.touch_news, TOUCHES, [("n", "p", "x", at(-1))]))
    (row,) = got.collect()
    assert (row.state, row.reason, row.changed_at) == ("Terminated", "closing", datetime(2024, 1, 1))


def test_times_come_out_exact_whatever_is_missing():
    told_at = lambda ts, last: ("s", ts, 0, "Pending", "instance_lost", "", "", last, last)
    # What lies in freed memory must not matter where a time is missing.
    for size in [1, 2, 50, 3000, 40_000, 400_000]:
        for _ in range(3):
            waste = [np.full(size, 1.7e308) for _ in range(8)]
            del waste
            got = SessionLife._frame(("n", "p", 0), [told_at(k, _NEVER if k % 2 else k) for k in range(size)])
            assert got["last_activity_at"].isna().sum() == size // 2 and got["changed_at"].iloc[-1].value == (size - 1) * 1000
    # Floats cannot tell these microseconds, of the year 2255, apart.
    late = (1 << 53) + 1
    got = SessionLife._frame(("n", "p", 0), [told_at(late, late), told_at(late, _NEVER)])
    assert got["last_activity_at"].iloc[0] == got["changed_at"].iloc[1] == pd.Timestamp(late, unit="us")
    assert SessionLife._frame(("n", "p", 0), []).empty


def test_a_lost_instance_looks_at_its_own_sessions_alone():
    shard, looks = SessionLife(), []
    shard.known, shard.minutes, shard.instances, shard.held = True, 30, set(), None
    shard.clocks, shard.waiting, shard.due, shard.open, shard.out = {}, {}, [], [], []
    shard.cell = shard.now = shard.passed = 0
    state = lambda k: ("Active", "Idle", "Pending")[k % 3]
    shard.sessions = {f"s{k}": ["u", state(k), f"i{k % 400}", "e", 0, 0, _NEVER] for k in range(2000)}
    look = shard._session
    shard._session = lambda name: looks.append(name) or look(name)
    for i in range(400):
        shard._instance({"flag": False, "instance": f"i{i}"}, 0)
    assert sorted(o[0] for o in shard.out) == sorted(f"s{k}" for k in range(2000) if k % 3 != 2)
    assert {(o[3], o[4], o[5]) for o in shard.out} == {("Pending", "instance_lost", "")}
    assert len(looks) < 5 * 2000
    # One that is placed again, on an instance lost before or not yet, is found again.
    before = len(shard.out)
    for instance in ("i7", "new"):
        shard._outlook({"session": "s0", "instance": instance, "endpoint": "e2"}, 1)
        shard._instance({"flag": False, "instance": instance}, 2)
        shard._instance({"flag": False, "instance": instance}, 2)
    assert [(o[0], o[4]) for o in shard.out[before:]] == [("s0", "placed"), ("s0", "instance_lost")] * 2
    # One that went on since the sessions were noted is not taken for held.
    shard._outlook({"session": "s1", "instance": "i8", "endpoint": "e2"}, 3)
    shard._end({"session": "s1", "user_name": "u"}, 4)
    before = len(shard.out)
    shard._instance({"flag": False, "instance": "i8"}, 5)
    assert shard.out[before:] == []


def test_state_lies_in_as_many_partitions_as_asked_for(feed, spark, tmp_path):  # noqa: F811
    was = spark.conf.get("spark.sql.shuffle.partitions")
    for asked, made in ((7, 7), (2, int(was))):
        activity = feed(TOUCHES, [("n", "p", f"s{k}", at(k)) for k in range(20)])
        run.start(jobs.thin_touches(activity), f"{tmp_path}/{asked}", parts=asked).awaitTermination()
        assert len(list((tmp_path / str(asked) / "checkpoint" / "state" / "0").glob("[0-9]*"))) == made
        assert spark.conf.get("spark.sql.shuffle.partitions") == was
