"""Streams fed in several batches, with late rows and clocks that run out."""

import os
import random
import subprocess
import sys
from datetime import datetime, timedelta
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from poolwatch.plans import capacity, sessions
from poolwatch.sources import readers, sinks
from poolwatch.streaming import jobs, run, steps

T = datetime(2024, 1, 1)


@pytest.fixture
def feed(spark, tmp_path):
    """A stream that gets one list of rows per batch."""
    def make(schema, *batches):
        folder = tmp_path / f"feed{len(list(tmp_path.iterdir()))}"
        folder.mkdir()
        for i, batch in enumerate(batches):
            out = f"{tmp_path}/staged-{folder.name}-{i}"
            spark.createDataFrame(batch, schema).coalesce(1).write.json(out)
            (part,) = Path(out).glob("part*")
            target = folder / f"{i:03}.json"
            target.write_bytes(part.read_bytes())
            os.utime(target, (1_700_000_000 + i * 60,) * 2)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))

    return make


TOUCH = "namespace string, pool string, session string, user_name string, ts timestamp"


def touches(*minutes, session="s"):
    return [("n", "p", session, "u", T + timedelta(minutes=m)) for m in minutes]


@pytest.fixture
def pools(rows):
    return rows("namespace string, pool string, idle_timeout_minutes int, cooldown_seconds int", ("n", "p", 30, 0))


def minutes(ts):
    return (ts - T).total_seconds() / 60


def test_last_activity_never_moves_back(feed):
    stream = feed(TOUCH, touches(5), touches(9), touches(7))
    # A day's row of a session is the newest so far, whatever the batch.
    (got,) = run.finish(jobs.last_activity(stream), "t", "update", ["namespace", "pool", "session"]).collect()
    assert minutes(got.last_activity_at) == 9


def test_last_activity_forgets_days_that_are_over(feed, tmp_path):
    day = 24 * 60
    stream = feed(TOUCH, touches(*range(0, 50, 7)) + touches(3, session="t"), touches(day + 20), touches(2 * day + 30), touches(2 * day + 60))
    query = run.start(jobs.last_activity(stream), f"{tmp_path}/last", "update")
    query.awaitTermination()
    assert query.lastProgress.stateOperators[0].numRowsTotal == 1
    rows_ = stream.sparkSession.read.parquet(f"{tmp_path}/last/table").groupBy("session").agg(F.max("last_activity_at").alias("at")).collect()
    assert {r.session: minutes(r["at"]) for r in rows_} == {"s": 2 * day + 60, "t": 3}


def test_thin_touches(feed):
    stream = feed(TOUCH, touches(0, 1, 1.5, 2), touches(3, 60))
    got = run.finish(jobs.thin_touches(stream), "t")
    assert sorted(minutes(r.ts) for r in got.collect()) == [1.5, 3]


def test_idle_sessions_close_after_the_timeout(feed, pools):
    stream = feed(TOUCH, touches(0, 30), touches(61, 70), touches(200))
    got = run.finish(jobs.idle_sessions(stream, pools), "t")
    assert sorted((minutes(r.started_at), minutes(r.last_touch_at), r.touches) for r in got.collect()) == [(0, 30, 2), (61, 70, 2)]


@pytest.mark.parametrize("cut", [False, True])
def test_first_requests_are_told_by_event_time(feed, cut):
    rows_ = touches(0, 0.1, 5, 100, 101, 220, 341)
    batches = [[r] for r in rows_] if cut else [rows_]
    stream = feed(TOUCH, *batches, touches(900), touches(2000))
    got = run.finish(jobs.first_requests(stream.drop("session")), "t").filter("user_name = 'u'")
    assert sorted(minutes(r.ts) for r in got.collect()) == [0, 100, 220, 341, 900]


@pytest.mark.parametrize("cut", [False, True])
def test_activation_wait_equals_the_batch_job(spark, feed, cut):
    at = lambda s: T + timedelta(seconds=s)
    change = "namespace string, session string, ts timestamp, seq long, state string, endpoint string"
    asked = [("n", x, at(100)) for x in ("active", "failed", "s30", "s60", "s61", "never", "woken", "mute", "mute2")] + [("n", "s30", at(200))]
    became = [
        ("n", "active", at(0), 0, "Pending"), ("n", "active", at(10), 1, "Active"), ("n", "failed", at(50), 0, "Failed"),
        ("n", "s30", at(100), 0, "Pending"), ("n", "s30", at(130), 1, "Active"), ("n", "s60", at(160), 0, "Active"),
        ("n", "s61", at(161), 0, "Active"), ("n", "woken", at(90), 0, "Active"), ("n", "woken", at(90), 1, "Pending"),
        ("n", "woken", at(105), 2, "Failed"), ("n", "woken", at(106), 3, "Active"),
        ("n", "mute", at(110), 0, "Active"), ("n", "mute", at(120), 1, "Failed"), ("n", "mute2", at(90), 0, "Idle"),
    ]
    became = [(*c, "" if c[1].startswith("mute") else "e") for c in became]
    end = [("n", "end", at(9000))], [("n", "end", at(9000), 0, "Active", "e")]
    ask = feed("namespace string, session string, ts timestamp", *([[r] for r in asked] if cut else [asked]), end[0], end[0])
    changes = feed(change, *([[r] for r in became] if cut else [became]), end[1], end[1])
    got = run.finish(jobs.activation_wait(ask, changes), "t")
    plain = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = sessions.activation_wait(
        plain(spark.createDataFrame(asked, "namespace string, session string, ts timestamp")),
        plain(spark.createDataFrame(became, change)), F.lit(at(9000)).cast("timestamp_ntz"),
    )
    told = lambda df: sorted((r.session, str(r.ts), r.wait_seconds, r.outcome) for r in df.collect())
    assert told(got) == told(want)
    by = {(r.session, r.wait_seconds, r.outcome) for r in got.collect()}
    assert by == {("active", 0, "ok"), ("failed", 0, "failed"), ("s30", 30, "ok"), ("s30", 0, "ok"), ("s60", 60, "ok"),
                  ("s61", None, "timeout"), ("never", None, "timeout"), ("woken", 5, "failed"), ("mute", 10, "no_endpoint"), ("mute2", 0, "no_endpoint")}


def test_utilisation_per_tick(feed, rows):
    wanted = rows("namespace string, pool string, pod string, container string, resource string, request_milli long",
                  ("n", "p", "a", "c", "cpu", 1000), ("n", "p", "a", "d", "cpu", 1000), ("n", "p", "b", "c", "cpu", 100))
    at = lambda s: T + timedelta(seconds=s)
    stream = feed("namespace string, pod string, container string, resource string, usage_milli long, ts timestamp",
                  [("n", "a", "c", "cpu", 500, at(1)), ("n", "a", "d", "cpu", 100, at(2)), ("n", "b", "c", "cpu", 50, at(29)),
                   ("n", "b", "c", "cpu", 10, at(30))], [("n", "a", "c", "cpu", 1, at(5000))], [("n", "a", "c", "cpu", 1, at(9000))])
    got = run.finish(jobs.utilisation(stream, wanted, delay="1 minute"), "t")
    rows_ = {(r.tick - T).total_seconds(): (r.measured_pods, r.mean_micro_percent) for r in got.collect()}
    assert rows_[0] == (2, 40_000_000) and rows_[30] == (1, 10_000_000)


def test_utilisation_leaves_out_what_cannot_be_read(feed, rows):
    """As the batch job: a pod with an unreadable amount counts for nothing, and sums are rounded up once."""
    wanted = rows("namespace string, pool string, pod string, container string, resource string, request_milli decimal(38,6)",
                  *[("n", "p", pod, c, "cpu", Decimal(n)) for pod, c, n in (("a", "c", 1000), ("a", "d", 1000), ("b", "c", 3), ("c", "c", 10))],
                  ("n", "p", "e", "c", "cpu", None))
    at = lambda s: T + timedelta(seconds=s)
    usage = [("a", "c", "400"), ("a", "d", None), ("b", "c", "0.2"), ("b", "c", "0.2"), ("c", "c", "1"), ("e", "c", "1")]
    schema = "namespace string, pod string, container string, resource string, usage_milli decimal(38,6), ts timestamp"
    row = lambda pod, c, n, s: ("n", pod, c, "cpu", None if n is None else Decimal(n), at(s))
    stream = feed(schema, [row(*u, 1) for u in usage], [row("c", "c", "1", 5000)], [row("c", "c", "1", 9000)])
    got = run.finish(jobs.utilisation(stream, wanted, delay="1 minute"), "t").filter(F.col("tick") == F.lit(T)).collect()
    # b: one milli of six, c: one of ten.
    assert [(r.measured_pods, r.mean_micro_percent) for r in got] == [(2, (16_666_666 + 10_000_000) // 2)]


def test_live_load_follows_changes(feed):
    change = "namespace string, pool string, previous string, state string"
    stream = feed(change, [("n", "p", "Pending", "Active"), ("n", "p", "", "Pending"), ("n", "q", "Pending", "Active")],
                  [("n", "p", "Active", "Idle"), ("n", "p", "Pending", "Active"), ("n", "q", "Idle", "Terminating")])
    got = run.finish(jobs.live_load(stream), "t", "update", ["namespace", "pool"])
    assert {r.pool: r.live for r in got.collect()} == {"p": 2, "q": 0}


def test_session_states_across_batches(feed, pools):
    stream = feed(
        TOUCH,
        touches(0, 5) + touches(0, session="other"),
        touches(14, 26),
        touches(50, session="other"),
        touches(100, session="clock"),
        touches(101),
        touches(300, session="clock"),
    )
    got = run.finish(jobs.session_states(stream, pools), "t")
    changes = sorted((minutes(r.changed_at), r.state, r.reason) for r in got.filter("session = 's'").collect())
    assert changes == [
        (0, "Active", "opened"), (24, "Idle", "idle_mark"), (26, "Active", "touched"), (36, "Idle", "idle_mark"),
        (56, "Terminating", "idle_timeout"), (101, "Active", "opened"), (111, "Idle", "idle_mark"), (131, "Terminating", "idle_timeout"),
    ]
    other = sorted((minutes(r.changed_at), r.state) for r in got.filter("session = 'other'").collect())
    assert other == [(0, "Active"), (10, "Idle"), (30, "Terminating"), (50, "Active"), (60, "Idle"), (80, "Terminating")]


def test_session_states_limits_are_strict(feed, pools):
    stream = feed(TOUCH, touches(0, 10, 40), touches(500, session="clock"))
    got = run.finish(jobs.session_states(stream, pools), "t").filter("session = 's'")
    assert sorted((minutes(r.changed_at), r.state) for r in got.collect()) == [
        (0, "Active"), (20, "Idle"), (40, "Active"), (50, "Idle"), (70, "Terminating")]


@pytest.mark.parametrize("cut", [False, True])
def test_cooldowns_equal_the_batch_audit(spark, feed, rows, tmp_path, cut):
    """Late rows fall into their place, and a policy that changes counts for the batches after it."""
    log = "namespace string, pool string, action_id long, ts timestamp, action string"
    pick = random.Random(7)
    data = [("n", pick.choice("pq"), k, T + timedelta(seconds=20 * k + pick.randrange(-200, 200)), pick.choice(["shrink", "grow"])) for k in range(60)]
    stream = feed(log, *([data[k : k + 9] for k in range(0, 60, 9)] if cut else [data]))
    policy = rows("namespace string, pool string, cooldown_seconds int", ("n", "p", 30), ("n", "q", 0))
    job = steps.Steps(spark, f"{tmp_path}/cool", steps.cooldowns(lambda: policy))
    told = lambda df: sorted((r.pool, r.action_id, r.seconds_since_previous, r.inside_cooldown) for r in df.collect())
    assert told(job.finish(stream)) == told(capacity.scaling_audit(spark.createDataFrame(data, log), policy))


def test_a_step_that_is_run_again_changes_nothing(spark, rows, tmp_path):
    log = "namespace string, pool string, action_id long, ts timestamp, action string"
    limit = [300]
    policy = lambda: rows("namespace string, pool string, cooldown_seconds int", ("n", "p", limit[0]))
    job = steps.Steps(spark, f"{tmp_path}/again", steps.cooldowns(policy, "1 second"))
    shrink = lambda k, s: rows(log, ("n", "p", k, T + timedelta(seconds=s), "shrink"))
    job.run(shrink(1, 0), 0)
    job.run(shrink(2, 100), 1)
    limit[0] = 10
    for _ in range(3):
        job.run(shrink(3, 200), 2)
    job.run(shrink(9, 50), 3)  # late: left out
    job.run(shrink(4, 300), 4)
    told = {r.action_id: (r.seconds_since_previous, r.inside_cooldown) for r in job.table().collect()}
    # The second shrink came out with the third batch, when the policy had changed.
    assert told == {1: (None, False), 2: (100, False), 3: (100, False)}
    assert job.done() == [3, 4]


def test_ticks_evaluate_what_is_there_then(spark, feed, rows, tmp_path):
    """Three ticks of a running query, each with the pools of its moment; a tick that is written again is one row."""
    clock = feed("ts timestamp", [(T,)], [(T + timedelta(seconds=30),)], [(T + timedelta(seconds=60),)])
    pools, seen = [1], []

    def evaluate(at):
        n = pools[0]
        pools[0] += 1
        rollup = rows("namespace string, pool string, running long, ready long, total long, instances long, starting long, failed long, waiting long",
                      ("n", "p", n, n, 20 * n, n, 0, 0, 0))
        settings_ = rows("namespace string, pool string, min_replicas int, max_replicas int, metric_type string, target_per_instance int, "
                         "scale_up_threshold string, cooldown_seconds int, idle_timeout_minutes int", ("n", "p", 0, 9, "", 10, "0.8", 0, 0))
        none = rows("namespace string, pool string, tick timestamp_ntz, resource string, mean_percent double")
        desired = capacity.desired_replicas(settings_, rollup, none, at)
        return {"status": sinks.pool_status(rollup, at), "desired": desired.withColumn("as_of", at)}

    def write(tables):
        seen.append(tables["desired"].first()["desired"])
        for _ in range(2):
            sinks.write_pool_status(tables["status"], f"{tmp_path}/status")

    query = steps.start_ticks(clock, steps.at_ticks(evaluate, write), f"{tmp_path}/ticks", every="1 second")
    try:
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    got = sorted((minutes(r.as_of), r.current_replicas) for r in sinks.read_pool_status(spark, f"{tmp_path}/status").collect())
    assert got == [(0, 1), (0.5, 2), (1, 3)] and seen == [2, 3, 4]


def test_cooldowns_remember_the_last_shrink(spark, feed, pools, tmp_path):
    log = "namespace string, pool string, action_id long, ts timestamp, action string"
    at = lambda s: T + timedelta(seconds=s)
    stream = feed(log, [("n", "p", 1, at(0), "shrink"), ("n", "p", 2, at(10), "grow")],
                  [("n", "p", 4, at(601), "shrink"), ("n", "p", 3, at(300), "shrink")])
    got = steps.Steps(spark, f"{tmp_path}/steps", steps.cooldowns(lambda: pools)).finish(stream)
    want = {1: (None, False), 3: (300, True), 4: (301, False)}
    assert {r.action_id: (r.seconds_since_previous, r.inside_cooldown) for r in got.collect()} == want


def test_a_restarted_stream_goes_on(spark, feed, pools, tmp_path):
    stream = feed(TOUCH, touches(0), touches(3), touches(200))
    path = f"{tmp_path}/again"
    for _ in range(2):
        run.start(jobs.thin_touches(stream), path).awaitTermination()
    assert spark.read.parquet(f"{path}/table").count() == 2


def test_stream_sources_declare_their_schema(spark, tmp_path):
    (tmp_path / "a").mkdir()
    activity = readers.activity_stream(spark, f"{tmp_path}/a", maxFilesPerTrigger=1)
    requests = readers.requests_stream(spark, f"{tmp_path}/a")
    assert activity.isStreaming and requests.isStreaming
    assert "user_name" in activity.columns and "forwarded_host" in requests.columns


def test_processors_travel_without_the_package(tmp_path):
    sent = cloudpickle.dumps([jobs.SessionClock(), jobs.SessionLife(), jobs.StartClock()])
    load = "import pickle, sys; print(len(pickle.loads(sys.stdin.buffer.read())), 'poolwatch' in sys.modules)"
    done = subprocess.run([sys.executable, "-c", load], input=sent, cwd=tmp_path, capture_output=True, check=True)
    assert done.stdout.split() == [b"3", b"False"]


def test_tick_is_a_trigger(feed, tmp_path):
    query = run.start(jobs.thin_touches(feed(TOUCH, touches(0))), f"{tmp_path}/tick", every="1 second")
    try:
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
