"""What a job holds and reads does not grow with single sessions, records or changes."""

from datetime import timedelta

from pyspark.sql import functions as F

from poolwatch.sources import sinks
from poolwatch.sources.sample import Sample
from poolwatch.streaming import jobs, run
from test_streaming import T, feed  # noqa: F401

NAMES = [f"s{k}" for k in range(60)]


def at(m):
    return T + timedelta(minutes=m)


def done(job, path):
    """Rows the job wrote, and rows in its state at the end."""
    query = run.start(job, str(path))
    query.awaitTermination()
    return job.sparkSession.read.parquet(f"{path}/table"), query.lastProgress.stateOperators[0].numRowsTotal


def test_start_requests_are_held_by_shard(feed, tmp_path):  # noqa: F811
    ask, change = "namespace string, session string, ts timestamp", "namespace string, session string, ts timestamp, seq long, state string"
    asked = feed(ask, [("n", s, at(0)) for s in NAMES], [("n", "end", at(500))])
    became = feed(change, [("n", s, at(0.5), 0, "Active") for s in NAMES], [("n", "end", at(500), 0, "Active")])
    got, held = done(jobs.activation_wait(asked, became, shards=2), tmp_path / "wait")
    assert {(r.session, r.wait_seconds, r.outcome) for r in got.collect()} == {(s, 30, "ok") for s in NAMES}
    assert held <= 16


def test_clocks_are_held_by_shard(feed, rows, tmp_path):  # noqa: F811
    pools = rows("namespace string, pool string, idle_timeout_minutes int", ("n", "p", 30))
    touched = feed("namespace string, pool string, session string, ts timestamp", [("n", "p", s, at(0)) for s in NAMES], [("n", "p", "end", at(35))])
    got, held = done(jobs.session_states(touched, pools, shards=2), tmp_path / "states")
    assert {(r.session, r.state) for r in got.filter("session <> 'end'").collect()} == {(s, x) for s in NAMES for x in ("Active", "Idle")}
    assert held <= 16


def test_lives_are_held_by_shard(feed, rows, tmp_path):  # noqa: F811
    pools = rows("namespace string, pool string, idle_timeout_minutes int", ("n", "p", 30))
    seats = rows("namespace string, pool string, instance string, state string", ("n", "p", "i", "Running"))
    snapshot = rows(
        "namespace string, pool string, session string, user_name string, state string, assigned_instance string, created_at timestamp, "
        "last_activity_at timestamp", *[("n", "p", s, "u", "Active", "i", at(-1), at(0)) for s in NAMES])
    news = jobs.touch_news(feed("namespace string, pool string, session string, ts timestamp", [("n", "p", "none", at(1))], [("n", "p", "none", at(22))]), 2)
    start = jobs.life_snapshot(snapshot, pools, seats, F.lit(T), 2)
    got, held = done(jobs.session_transitions(news, start), tmp_path / "life")
    assert {(r.session, r.state, r.changed_at) for r in got.collect()} == {(s, "Idle", at(10)) for s in NAMES}
    assert held <= 16


def test_records_are_dealt_out_before_they_are_made(spark, rows, tmp_path):
    keys = [(k, f"c{k}", k % 25, 1.0, "m") for k in range(200)]
    rows("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", *keys).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    pools = Sample(spark, str(tmp_path)).tenant_pools.filter("type = 'connect'")
    before = pools._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)
    # The keys alone are read and dealt out; whatever is asked of a record comes later.
    assert len(before) == 2 and "json" in before[0] and "json" not in before[1]
    assert pools.count() == sum(k % 2 == 0 and k % 41 != 0 for k in range(200))


def test_newest_rows_read_the_log_once(rows):
    log = rows("k string, v string, ts timestamp, seq long", ("a", "old", at(0), 9), ("a", "new", at(1), 1), ("a", "last", at(1), 2), ("b", "x", None, None), (None, "y", at(1), 1))
    got = sinks.newest_rows(log, ["k"], ["ts", "seq"])
    assert {r.k: (r.v, r.seq) for r in got.collect()} == {"a": ("last", 2), "b": ("x", None)}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
