"""Random histories against plain Python, row by row."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from poolwatch import values as V
from poolwatch.plans import capacity, quota, sessions
from poolwatch.sources.sample import as_of

T = datetime(2024, 1, 28)
NOW = datetime(2024, 1, 31)


@pytest.fixture(params=[1, 2, 3])
def rng(request):
    return random.Random(request.param)


def test_idle_sessions(rows, rng):
    gaps = {"p": 30, "q": 5}
    touches = [("n", rng.choice("pq"), rng.choice(["a", "a", "b"]), T + timedelta(seconds=rng.randrange(90000) / 4)) for _ in range(400)]
    per_user = defaultdict(list)
    for _, pool, user, ts in touches:
        per_user[pool, user].append(ts)
    want = []
    for (pool, user), times in per_user.items():
        start = last = None
        for ts in sorted(times):
            if last is None or ts - last > timedelta(minutes=gaps[pool]):
                if last is not None:
                    want.append((pool, user, start, last, n))
                start, n = ts, 0
            last, n = ts, n + 1
        want.append((pool, user, start, last, n))
    pools = rows("namespace string, pool string, idle_timeout_minutes int", *[("n", p, g) for p, g in gaps.items()])
    got = sessions.idle_sessions(rows("namespace string, pool string, user_name string, ts timestamp_ntz", *touches), pools)
    assert sorted((r.pool, r.user_name, r.started_at, r.last_touch_at, r.touches) for r in got.collect()) == sorted(want)


def test_quota_audit(rows, rng):
    history = []
    for _ in range(150):
        start = T + timedelta(minutes=rng.randrange(3 * 1440))
        end = start + timedelta(minutes=rng.randrange(300)) if rng.random() < 0.9 else None
        history.append(("n", rng.choice(["hot", "hot", "cold"]), "u", start, min(end, NOW) if end else None))
    limits = {"hot": 4, "cold": 2}
    want = set()
    for pool, limit in limits.items():
        mine = [h for h in history if h[1] == pool]
        moments = sorted({h[3] for h in mine} | {h[4] for h in mine if h[4]})
        live = [sum(s <= t for *_, s, _ in mine) - sum(e is not None and e <= t for *_, e in mine) for t in moments]
        over, first, breaches, was = timedelta(0), None, 0, False
        for i, (t, n) in enumerate(zip(moments, live)):
            if n > limit:
                over += (moments[i + 1] if i + 1 < len(moments) else NOW) - t
                if not was:
                    breaches, first = breaches + 1, first or t
            was = n > limit
        want.add((pool, max(live), first, breaches, int(over.total_seconds() // 60)))
    table = rows("namespace string, pool string, user_name string, started_at timestamp_ntz, ended_at timestamp_ntz", *history)
    allowed = rows("namespace string, pool string, session_limit int", *[("n", p, n) for p, n in limits.items()])
    got = quota.quota_audit(table, allowed, V.POOL, as_of())
    assert {(r.pool, r.peak, r.first_breach, r.breaches, r.minutes_over) for r in got.collect()} == want


def test_activation_wait(rows, rng):
    happened, asked = [], []
    for s in ("a", "b", "c"):
        at = T
        for seq in range(60):
            at += timedelta(seconds=rng.choice([0, 1, 20, 59, 60, 61, 4000]))
            happened.append(("n", s, at, seq, rng.choice(["Pending", "Pending", "", "Active", "Idle", "Failed", "Terminating"])))
        asked += [("n", s, T + timedelta(seconds=rng.randrange(60000))) for _ in range(60)]
    ok, bad = ("Active", "Idle"), ("Failed", "Terminated", "Terminating")
    want = []
    for _, s, ts in asked:
        mine = [(t, q, st) for _, x, t, q, st in happened if x == s]
        moments = {t: max((q, st) for u, q, st in mine if u == t)[1] for t, _, _ in mine}
        past = [t for t in moments if t <= ts]
        state, wait = (moments[max(past)] if past else None), 0
        if state not in ok + bad:
            ahead = [t for t in moments if t > ts and moments[t] in ok + bad]
            state = None
            if ahead and min(ahead) - ts <= timedelta(seconds=60):
                state, wait = moments[min(ahead)], int((min(ahead) - ts).total_seconds())
        want.append((s, ts, wait if state else None, "ok" if state in ok else "failed" if state in bad else "timeout"))
    got = sessions.activation_wait(
        rows("namespace string, session string, ts timestamp_ntz", *asked),
        rows("namespace string, session string, ts timestamp_ntz, seq long, state string", *happened), as_of())
    assert sorted(((r.session, r.ts, r.wait_seconds, r.outcome) for r in got.collect()), key=str) == sorted(want, key=str)


def test_capacity_plan(rows, rng):
    pools, wants, seats, want = [], [], [], []
    for i in range(12):
        pool, drain = f"p{i}", rng.random() < 0.5
        mine = [(f"{pool}-{j}", rng.choice(["Running", "Running", "Draining", "Pending", "Failed"]), rng.choice([0, 0, 3])) for j in range(rng.randrange(14))]
        running = sum(s in ("Running", "Draining") for _, s, _ in mine)
        starting, desired = sum(s == "Pending" for _, s, _ in mine), rng.randrange(6)
        pools.append(("n", pool, None, 300, drain))
        wants.append(("n", pool, running, starting, desired))
        seats += [("n", pool, name, j * rng.choice([1, 5000]) + j, s, n) for j, (name, s, n) in enumerate(mine)]
        want += [(pool, "create")] * max(0, desired - running - starting) + [(pool, "replace")] * sum(s == "Failed" for _, s, _ in mine)
        left = running - desired
        for _, _, name, _, state, n in sorted((x for x in seats if x[1] == pool), key=lambda x: (x[3], x[2])):
            if left > 0 and state == "Running":
                want.append((pool, "drain" if drain and n else "remove"))
                left -= not (drain and n)
    got = capacity.capacity_plan(
        rows("namespace string, pool string, last_scale_time timestamp_ntz, cooldown_seconds int, drain_before_scale_down boolean", *pools),
        rows("namespace string, pool string, running long, starting long, desired int", *wants),
        rows("namespace string, pool string, instance string, pos long, state string, active_sessions long", *seats), as_of())
    assert sorted((r.pool, r.action) for r in got.collect()) == sorted(want)
