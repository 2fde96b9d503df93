"""Layouts of tables, broken records, balance and roll-ups."""

import random
import re
import uuid
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Context, Decimal

import pytest
from pyspark.sql import functions as F

from poolwatch.functions import quantity
from poolwatch.plans import load, sessions, views
from poolwatch.sources import readers, sinks

NOW = datetime(2024, 1, 31)
ROWS = "namespace string, pool string, session string, state string, assigned_instance string"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_table_in_buckets_is_not_shuffled(spark, rows, tmp_path, no_broadcast):
    table = f"t_{uuid.uuid4().hex}"
    data = [("n", f"p{k % 3 if k % 2 else 0}", f"s{k}", ("Active", "Idle", "Pending", "")[k % 4], "" if k % 4 > 1 else f"i{k % 5}") for k in range(400)]
    sinks.save_by_pool(rows(ROWS, *data), table, f"{tmp_path}/t", 4, shares=3)
    kept = spark.table(table)
    per_share = kept.groupBy("namespace", "pool", "share", F.col("assigned_instance")).count()
    assert "Exchange" not in physical(per_share)
    pools = load.by_share(rows("namespace string, pool string, type string", ("n", "p0", "a"), ("n", "p1", "b"), ("n", "p2", "a")), 3)
    joined = kept.join(pools, ["namespace", "pool", "share"])
    assert physical(joined).count("Exchange") == 1  # of the pools
    # The hot pool lies in several buckets.
    assert kept.filter("pool = 'p0'").select(F.col("_metadata.file_path")).distinct().count() > 1
    want = defaultdict(lambda: [0, 0])
    for _, pool, _, state, instance in data:
        want[pool, instance][0] += state in ("Active", "Idle")
        want[pool, instance][1] += state in ("Pending", "") and instance == ""
    assert {(r.pool, r.instance): [r.held, r.waiting] for r in load.counts_by_share(joined).collect()} == dict(want)


def test_label_columns_reach_the_files(spark, rows, tmp_path):
    path = f"{tmp_path}/t"
    table = rows(ROWS, *[("n", "p", f"s{k}", "Active", "i") for k in range(3000)]).withColumns(
        {"snapshot_date": F.lit("2024-01-31").cast("date"), "labels": F.create_map(F.lit("x/user"), F.concat(F.lit("u"), F.substring("session", 2, 9)))})
    sinks.write_sessions(table, path, "x", {"label_user": "user"})
    kept = spark.read.parquet(path)
    hit = kept.filter("label_user = 'u77'")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(label_user,u77\)", physical(hit))
    assert [r.session for r in hit.collect()] == ["s77"]
    # A value inside the range of the statistics that no row has: the Bloom filter rules the row groups out, so no
    # row leaves the scan.
    absent = kept.filter("label_user = 'u1000x'").select("session")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert absent.collect() == []
        scan = absent._jdf.queryExecution().executedPlan()
        while scan.children().nonEmpty():
            scan = scan.children().head()
        assert scan.metrics().apply("numOutputRows").value() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_broken_records_are_kept(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [
        '{"namespace": "n", "name": "a", "spec": {"user": "u", "pool": "p"}}', '{"namespace": "n", "name": "b", "spec": {"user"', "no json", "",
        '{"namespace": "n", "spec": {}}', '{"namespace": "", "name": "c"}', '{"namespace": "n", "name": "d", "status": "text"}', "[]", '{"namespace": "n", "name": "e"}',
    ]
    (folder / "part.json").write_text("\n".join(lines))
    good, broken = readers.read_records(spark, str(folder), readers.schemas.SESSION_RECORD)
    got = readers.flatten_sessions(good).orderBy("session").collect()
    assert [(r.session, r.user_name, r.state) for r in got] == [("a", "u", ""), ("e", None, "")]
    kept = broken.collect()
    assert {r.line: r.reason for r in kept} == {
        lines[1]: "unreadable", lines[2]: "unreadable", lines[4]: "key_missing", lines[5]: "key_missing", lines[6]: "unreadable", lines[7]: kept[-1].reason}
    assert all(r.file.endswith("part.json") for r in kept)
    none = readers.read_records(spark, str(folder), readers.schemas.SESSION_RECORD, key=())[0]
    assert none.count() >= 4


def test_balance_against_one_by_one(rows):
    pick = random.Random(11)
    verdicts, table, loads, want = [], [], [], {}
    for pool in ("p", "q", "r", "none", "zero"):
        seats = [(f"{pool}{k}", k, pick.choice(["Running", "Running", "Draining"]), pick.randrange(12)) for k in range({"p": 1, "q": 5, "r": 9, "none": 0, "zero": 4}[pool])]
        loads += [("n", pool, *s) for s in seats]
        m = 0 if pool == "zero" else pick.randrange(1, 40)
        verdicts += [("n", pool, f"{pool}-s{k}", "ok") for k in range(m)] + [("n", pool, f"{pool}-x", "user_over_quota")]
        table += [("n", f"{pool}-s{k}", NOW - timedelta(minutes=pick.randrange(9000)) if k % 7 else None) for k in range(m)] + [("n", f"{pool}-x", NOW)]
        now = {name: n for name, _, state, n in seats if state == "Running"}
        for _ in range(m if now else 0):
            least = min(now, key=lambda i: now[i])
            now[least] += 1
        want[pool] = sorted(now.values())
    got = sessions.balanced_placement(
        rows("namespace string, pool string, session string, verdict string", *verdicts), rows("namespace string, session string, created_at timestamp_ntz", *table),
        rows("namespace string, pool string, instance string, pos int, state string, active_sessions long", *loads)).collect()
    assert len({r.session for r in got}) == len(got)
    after = defaultdict(dict)
    for _, pool, name, _, state, n in loads:
        if state == "Running":
            after[pool][name] = n
    for r in got:
        after[r.pool][r.instance] += 1
    assert {p: sorted(after[p].values()) for p in want} == want
    assert {r.session for r in got} == {s for _, p, s, v in verdicts if v == "ok" and after[p]}


def test_fleet_rollup(rows):
    names = ["instances", "running", "ready", "starting", "failed", "total", "waiting"]
    rollup = rows("namespace string, pool string, " + ", ".join(f"{n} long" for n in names), *[("n", p, k, k, k % 2, 0, 0, 3 * k, 1) for k, p in enumerate("abc", 1)])
    pools = rows("namespace string, pool string, region string, type string", ("n", "a", "eu", "x"), ("n", "b", "eu", "y"), ("n", "c", "us", "x"))
    got = {(r.region, r.type, r.pool_name): (r.level, r.pools, r.total, r.micro_sessions_per_ready) for r in load.fleet_rollup(rollup, pools).collect()}
    assert len(got) == 3 + 3 + 2 + 1
    assert got[None, None, None] == (3, 3, 18, 9_000_000) and got["eu", None, None] == (2, 2, 9, 9_000_000)
    assert got["eu", "y", None] == (1, 1, 6, None) and got["us", "x", "n/c"] == (0, 1, 9, 9_000_000)


def test_quantities_on_both_ways(rows):
    """Short whole numbers go as machine words, all others as decimals; the answers agree with exact arithmetic."""
    pick = random.Random(2)
    units = {u: Decimal(v) for u, v in quantity._MILLI.items()}
    texts = [f"{pick.choice(['', '', '-', '+'])}{pick.randrange(10 ** pick.randrange(1, 9))}{pick.choice(['', '', '.5', '.125', 'e2'])}{pick.choice(list(units))}" for _ in range(400)]
    texts += ["999999Gi", "1000000Gi", "000001m", "7", "", "Gi", "12 m", "1_0", "٣m"]

    def exact(text):
        unit = next((u for u in sorted(units, key=len, reverse=True) if u and text.endswith(u)), "")
        number = text[: len(text) - len(unit)]
        if not re.fullmatch(r"[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?", number):
            return None
        return Context(prec=80).quantize(Context(prec=80).multiply(Decimal(number), units[unit]), Decimal("0.000001"))

    got = rows("t string", *[(t,) for t in texts]).select("t", quantity.milli(F.col("t")).alias("n")).collect()
    for r in got:
        want = exact(r.t)
        if want is not None and abs(want) < Decimal(10) ** 26 and not r.t.endswith("n"):
            assert r.n == want, r.t
        elif want is None:
            assert r.n is None, r.t


def test_a_placed_session_takes_the_candidate(rows):
    schema = ("namespace string, session string, user_name string, pool string, state string, assigned_instance string, endpoint string, "
              "created_at timestamp_ntz, last_activity_at timestamp_ntz")
    old = NOW - timedelta(minutes=5)
    table = rows(schema, ("n", "new", "u", "p", "Pending", "", "", None, None), ("n", "bare", "u", "q", "", "", "", None, None),
                 ("n", "lost", "u", "p", "Active", "gone", "e", old, old), ("n", "kept", "u", "p", "Active", "i", "e", old, old),
                 ("n", "over", "v", "p", "", "", "", None, None))
    pools = rows("namespace string, pool string, max_sessions_per_user int, max_total_sessions int, idle_timeout_minutes int", ("n", "p", 9, 99, 60), ("n", "q", 9, 99, 60))
    quotas = rows("namespace string, pool string, match_user string, pos int, max_sessions_per_user int")
    instances = rows("namespace string, pool string, instance string, state string", ("n", "p", "i", "Running"))
    candidates = rows("namespace string, pool string, instance string, endpoint string", ("n", "p", "i", "e2"), ("n", "q", None, None))
    at = F.lit(NOW).cast("timestamp_ntz")
    got = sessions.session_transitions(table, pools, instances, quotas, at, candidates).collect()
    told = {r.session: (r.next_state, r.reason, r.assigned_instance, r.endpoint, r.created_at, r.last_activity_at) for r in got}
    assert told == {
        "new": ("Active", "placed", "i", "e2", NOW, NOW), "bare": ("", "no_running_instance", "", "", None, None),
        "lost": ("Pending", "instance_lost", "", "", old, old), "kept": ("Active", "none", "i", "e", old, old), "over": ("Active", "placed", "i", "e2", NOW, NOW)}
    plain = sessions.session_transitions(table, pools, instances, quotas, at).collect()
    assert {r.session: (r.next_state, r.reason) for r in plain} == {k: v[:2] for k, v in told.items()}


def test_an_active_session_without_endpoint_serves_nobody(rows):
    changes = rows("namespace string, session string, ts timestamp_ntz, seq long, state string, endpoint string",
                   ("n", "a", NOW - timedelta(minutes=9), 0, "Active", ""), ("n", "b", NOW - timedelta(seconds=100), 0, "Idle", None),
                   ("n", "c", NOW - timedelta(seconds=100), 0, "Active", "e"))
    asked = rows("namespace string, session string, ts timestamp_ntz", *[("n", s, NOW - timedelta(seconds=120)) for s in "abc"])
    got = sessions.activation_wait(asked, changes, F.lit(NOW).cast("timestamp_ntz")).collect()
    assert sorted((r.session, r.wait_seconds, r.outcome) for r in got) == [("a", 0, "no_endpoint"), ("b", 20, "no_endpoint"), ("c", 20, "ok")]


def test_listing_by_label(rows):
    table = rows("session string, user_name string, pool string, state string, assigned_instance string, spark_conf map<string,string>, "
                 "created_at timestamp_ntz, last_activity_at timestamp_ntz, labels map<string,string>",
                 ("a", "u", "p", "Active", "", None, None, None, {"x/user": "v"}), ("b", "v", "p", "Active", "", None, None, None, None),
                 ("c", "v", "p", "Idle", "", None, None, None, {"x/user": "v"}))
    assert sorted((r.name, r.user, r.labelUser) for r in views.own_sessions(table, "v", "x").collect()) == [("a", "u", "v"), ("c", "v", "v")]
    assert sorted(r.name for r in views.own_sessions(table, "v").collect()) == ["b", "c"]


def test_reuse_of_sessions_the_proxy_made(rows):
    routed = rows("request_id int, namespace string, pool string, user_name string, status string", (1, "n", "p", "u", "ok"), (2, "n", "p", "v", "ok"))
    label = lambda user: {"x/user": user, "x/pool": "p"}
    table = rows("namespace string, session string, state string, created_at timestamp_ntz, labels map<string,string>",
                 ("n", "fresh", "", NOW, label("u")), ("n", "other", "", NOW, label("v")), ("n", "late", "Active", NOW + timedelta(minutes=1), label("u")),
                 ("n", "old", "", None, label("w")))
    told = lambda **how: {r.request_id: r.session for r in sessions.session_reuse(routed, table, "x", **how).collect()}
    assert told() == {1: "late", 2: None}
    assert told(known=rows("namespace string, session string", ("n", "fresh"), ("n", "fresh"))) == {1: "fresh", 2: None}


def test_listing_stands_in_order(rows, tmp_path):
    table = rows("name string, user string", *[(f"s{k:03}", "u") for k in random.Random(1).sample(range(300), 300)]).repartition(7)
    sinks.write_listing(table, f"{tmp_path}/listing")
    files = sorted((tmp_path / "listing").glob("part-*.txt"))
    names = [re.search(r'"name":"(\w+)"', line)[1] for f in files for line in f.read_text().splitlines()]
    assert names == [f"s{k:03}" for k in range(300)]
