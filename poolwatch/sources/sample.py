"""Sample views: pools, instances, sessions, metrics and logs told from the test tables.

Each view covers its whole table; states, settings and faults follow from the keys.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from poolwatch.functions import maps
from poolwatch.functions.states import instance_state
from poolwatch.plans.routing import desired_routes
from poolwatch.sources.readers import flatten_pools, pool_records

PREFIX = "fleet.example.com"
MANAGER, PROXY = "fleet-manager", "fleet-proxy"
AS_OF = "2024-01-31 00:00:00"
_AS_OF = f"timestamp_ntz'{AS_OF}'"


# The sample's measures are monthly and end before its sessions begin.
MEASURED_AT, MEASURED_MINUTES = "2001-06-15 00:00:00", 31 * 24 * 60


def measured_at() -> Column:
    return F.lit(MEASURED_AT).cast("timestamp_ntz")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def _home(nation: str) -> list[str]:
    """Namespace and pool of a nation."""
    return [f"concat('ns-', ({nation}) % 9) as namespace", f"concat('pool-', {nation}) as pool"]


def _back(minutes: str, ts: str = _AS_OF) -> str:
    return f"({ts} - make_dt_interval(0, 0, cast({minutes} as int)))"


_APPLICATION_STATE = (
    "element_at(array('RUNNING', 'RUNNING', 'RUNNING', 'RUNNING', 'RUNNING', 'RUNNING', 'PENDING_RERUN', "
    "'FAILED', 'SUBMITTED', 'COMPLETED'), cast(s_suppkey % 10 + 1 as int))"
)
_ROLE = "case when s_suppkey % 10 = 5 then 'draining' else 'active' end"

# Declared, so that opening a table reads no file.
TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


class Sample:
    """Views over one folder of test tables; those named in `streamed` are read as streams."""

    def __init__(self, spark: SparkSession, sf_dir: str, streamed: tuple[str, ...] = ()):
        self.spark, self.sf_dir, self.streamed = spark, sf_dir, streamed

    def table(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        if name not in self.streamed:
            return self.spark.read.schema(TABLES[name]).parquet(path)
        # A stream takes a folder or a pattern; this pattern fits the one file or folder.
        return self.spark.readStream.schema(TABLES[name]).parquet(path[:-1] + "[t]")

    @cached_property
    def pools(self) -> DataFrame:
        kind = "case when n_nationkey % 2 = 0 then 'connect' else 'thrift' end"
        return self.table("nation").selectExpr(
            *_home("n_nationkey"),
            "cast(n_nationkey as bigint) as pos",
            f"{kind} as type",
            f"concat('spark-', {kind}, '-', n_nationkey, '.example.com') as host",
            "n_nationkey % 3 as min_replicas",
            "3 + n_nationkey % 8 as max_replicas",
            "case n_regionkey when 3 then 'cpu' when 4 then 'memory' when 2 then '' else 'activeSessions' end as metric_type",
            "case when n_nationkey % 10 = 9 then 0 when n_regionkey in (3, 4) then 80 when n_nationkey % 5 = 0 then 5"
            " else 20 end as target_per_instance",
            "element_at(array('0.8', '', '0', 'abc', '0.5', '0.9'), n_nationkey % 6 + 1) as scale_up_threshold",
            "case when n_nationkey % 7 = 6 then 0 else 300 end as cooldown_seconds",
            "n_nationkey % 4 <> 0 as drain_before_scale_down",
            "case when n_nationkey % 5 = 0 then 2 else 5 end as max_sessions_per_user",
            "case when n_nationkey % 11 = 10 then 0 when n_nationkey % 5 = 0 then 50 else 200 end as max_total_sessions",
            "case when n_nationkey % 12 = 11 then 0 when n_nationkey % 5 = 0 then 360 else 720 end as idle_timeout_minutes",
            f"case when n_nationkey > 0 then {_back('n_nationkey')} end as last_scale_time",
            "case when n_nationkey % 4 <> 3 then map('spark.executor.memory', '4g', 'spark.executor.cores', '2') end"
            " as default_session_conf",
        )

    @cached_property
    def pool_regions(self) -> DataFrame:
        return self.table("nation").selectExpr(*_home("n_nationkey"), "concat('region-', n_regionkey) as region")

    def _at_home(self, rows: DataFrame, customer: str) -> DataFrame:
        """Rows with the instance their customer works on: every customer has one home."""
        suppliers = self.table("supplier").select("s_suppkey", "s_nationkey")
        seats = suppliers.agg(F.count("*")).scalar()
        spread = rows.columns
        return rows.withColumn("s_suppkey", F.col(customer) % seats).join(suppliers, ["s_suppkey"], "left")

    @cached_property
    def quotas(self) -> DataFrame:
        """Three override rows per customer; limit 0 overrides nothing."""
        rows = """inline(array(
            named_struct('pos', 0, 'max_sessions_per_user', if(c_custkey % 50 = 0, 20, 0),
              'session_conf', if(c_custkey % 50 = 0, map('spark.executor.memory', '16g'), null)),
            named_struct('pos', 1, 'max_sessions_per_user', if(c_custkey % 100 = 0, 7, 0),
              'session_conf', if(c_custkey % 100 = 0, map('spark.executor.cores', '8'), null)),
            named_struct('pos', 2, 'max_sessions_per_user', 0, 'session_conf', cast(null as map<string,string>))))"""
        return self._at_home(self.table("customer").select("c_custkey"), "c_custkey").selectExpr(
            *_home("s_nationkey"), "concat('user-', c_custkey) as match_user", rows
        )

    @cached_property
    def applications(self) -> DataFrame:
        """Exported application records, as JSON documents."""
        doc = f"""to_json(named_struct(
            'metadata', named_struct(
              'name', concat('pool-', s_nationkey, '-', s_suppkey), 'namespace', concat('ns-', s_nationkey % 9),
              'labels', map('{PREFIX}/pool', concat('pool-', s_nationkey), '{PREFIX}/instance-role', {_ROLE})),
            'status', named_struct(
              'applicationState', named_struct('state', {_APPLICATION_STATE}),
              'sparkApplicationId', concat('spark-', s_suppkey)))) as doc"""
        return self.table("supplier").selectExpr("s_suppkey as pos", doc)

    @cached_property
    def instances(self) -> DataFrame:
        rows = self.table("supplier").selectExpr(
            *_home("s_nationkey"),
            "concat('pool-', s_nationkey, '-', s_suppkey) as instance",
            "s_suppkey as pos",
            f"{_APPLICATION_STATE} as spark_state",
            f"{_ROLE} as role",
            "concat('spark-', s_suppkey) as app_id",
        )
        # Two states that no application tells, as old status records have them.
        odd = F.expr("case s_suppkey % 20 when 8 then 'Submitted' when 6 then 'Lost' end".replace("s_suppkey", "pos"))
        return rows.withColumn("state", F.coalesce(odd, instance_state()))

    @cached_property
    def services(self) -> DataFrame:
        """Two services per application; one application in eleven has no driver service."""
        rows = """inline(array(
            named_struct('pos', 0, 'service', concat('app-', s_suppkey, '-ui-svc')),
            named_struct('pos', 1, 'service', concat('app-', s_suppkey, if(s_suppkey % 11 = 0, '-headless', '-driver-svc')))))"""
        return self.table("supplier").selectExpr(_home("s_nationkey")[0], "concat('spark-', s_suppkey) as app_id", rows)

    @cached_property
    def _orders(self) -> DataFrame:
        """Orders at home; some name another pool, some a pool that is gone."""
        rows = self._at_home(self.table("orders").select("o_orderkey", "o_custkey"), "o_custkey")
        return rows.selectExpr(
            "o_orderkey as k", "o_custkey as c", "s_nationkey", "s_suppkey",
            "case when o_orderkey % 89 = 0 then 99 when o_orderkey % 23 = 0 then o_orderkey % 25 else s_nationkey end as nk",
        )

    @cached_property
    def sessions(self) -> DataFrame:
        seen = _back("(k * 7) % 1000")
        state = (
            "case when k > 0 and k % 1009 = 0 then 'Assigning' else element_at(array('Pending', '', 'Active', 'Active', "
            "'Idle', 'Terminating', 'Terminated', 'Failed'), cast(k % 8 + 1 as int)) end"
        )
        labels = (
            f"map('{PREFIX}/user', concat(if(k % 50 = 0, 'other-', 'user-'), c), '{PREFIX}/pool', concat('pool-', nk), "
            f"'{PREFIX}/origin', 'proxy')"
        )
        conf = """case when k % 3 = 0 and k % 5 = 0
              then map('spark.executor.memory', concat(1 + k % 8, 'g'), 'spark.dynamicAllocation.maxExecutors', string(k % 9))
            when k % 3 = 0 then map('spark.executor.memory', concat(1 + k % 8, 'g'))
            when k % 5 = 0 then map('spark.dynamicAllocation.maxExecutors', string(k % 9)) end"""
        conditions = """array(named_struct('type', if(k % 7 = 0, 'not a type', 'Ready'), 'status', if(k % 11 = 0, null, 'True'),
            'reason', case when k % 13 = 0 then null when k % 17 = 0 then '' else 'Placed' end,
            'message', if(k % 19 = 0, null, ''), 'observedGeneration', if(k % 29 = 0, -1L, 1L),
            'lastTransitionTime', if(k % 31 = 0, null, timestamp'2024-01-01')))"""
        return self._orders.selectExpr(
            *_home("nk"),
            "concat('session-', k) as session",
            "concat('user-', c) as user_name",
            f"{state} as state",
            "case when k % 8 < 2 then '' when k % 97 = 0 then 'gone-instance'"
            " else coalesce(concat('pool-', s_nationkey, '-', s_suppkey), '') end as assigned_instance",
            f"{_back('k % 600', seen)} as created_at",
            f"case when k % 101 <> 0 then {seen} end as last_activity_at",
            f"case when k % 8 > 4 then {seen} end as ended_at",
            f"{labels} as labels",
            f"{conf} as spark_conf",
            "k % 16 <> 1 as has_status",
            f"if(k % 3 = 0, {conditions}, null) as conditions",
        )

    @cached_property
    def session_documents(self) -> DataFrame:
        """Exported session records, as JSON documents; a new session has no state at all."""
        doc = f"""to_json(named_struct(
            'namespace', concat('ns-', nk % 9), 'name', concat('session-', k),
            'labels', map('{PREFIX}/user', concat('user-', c)),
            'spec', named_struct('user', concat('user-', c), 'pool', concat('pool-', nk),
              'sparkConf', if(k % 3 = 0, map('spark.executor.memory', concat(1 + k % 8, 'g')), null)),
            'status', named_struct('state', if(k % 8 = 1, null, element_at(array('Pending', '', 'Active', 'Active', 'Idle',
                'Terminating', 'Terminated', 'Failed'), cast(k % 8 + 1 as int))),
              'assignedInstance', if(k % 8 < 2, null, concat('pool-', s_nationkey, '-', s_suppkey)),
              'createdAt', date_format({_back("k % 600")}, "yyyy-MM-dd'T'HH:mm:ss'Z'")))) as doc"""
        return self._orders.selectExpr(doc)

    @cached_property
    def session_lines(self) -> DataFrame:
        """Session records as lines of text; one in 37 is cut off, one in 41 has no name."""
        k = F.regexp_extract("doc", '"session-([0-9]+)"', 1).cast("bigint")
        cut = F.concat(F.lit('{"namespace":"ns-1","name":"session-'), k)
        nameless = F.concat(F.lit('{"namespace":"ns-1","labels":{"k":"'), k, F.lit('"}}'))
        return self.session_documents.select(F.when(k % 37 == 0, cut).when(k % 41 == 0, nameless).otherwise(F.col("doc")).alias("value"))

    @cached_property
    def container_usage(self) -> DataFrame:
        """Usage per pod, container, resource and month."""
        per_tick = (
            self.table("lineitem")
            .selectExpr(
                "l_suppkey", "l_linenumber", "cast(trunc(l_shipdate, 'month') as timestamp_ntz) as tick",
                "cast(round(l_extendedprice * 100) as bigint) as cpu", "cast(round(l_quantity * 100000) as bigint) as memory",
            )
            .groupBy("l_suppkey", "l_linenumber", "tick")
            .agg(F.sum("cpu").alias("cpu"), F.sum("memory").alias("memory"))
        )
        owners = self.table("supplier").selectExpr("s_suppkey as l_suppkey", "s_nationkey")
        owned = per_tick.join(owners, ["l_suppkey"])
        return owned.selectExpr(
            _home("s_nationkey")[0],
            "concat('pool-', s_nationkey, '-', l_suppkey, '-driver') as pod",
            "concat('c', l_linenumber) as container",
            "tick",
            "stack(2, 'cpu', cpu, 'memory', memory) as (resource, usage_milli)",
        )

    @cached_property
    def usage_readings(self) -> DataFrame:
        """One reading per order line, at its own time."""
        owners = self.table("supplier").selectExpr("s_suppkey as l_suppkey", "s_nationkey")
        rows = self.table("lineitem").join(owners, ["l_suppkey"])
        return rows.selectExpr(
            _home("s_nationkey")[0],
            "concat('pool-', s_nationkey, '-', l_suppkey, '-driver') as pod",
            "concat('c', l_linenumber) as container",
            "'cpu' as resource",
            "l_shipdate as ts",
            "if(l_orderkey % 31 = 0, null, cast(round(l_extendedprice * 100) as decimal(38,6)) + if(l_orderkey % 5 = 0, 0.25, 0)) as usage_milli",
        )

    @cached_property
    def container_requests(self) -> DataFrame:
        rows = self.table("supplier").selectExpr(
            _home("s_nationkey")[0],
            "concat('pool-', s_nationkey, '-', s_suppkey, '-driver') as pod",
            "cast(if(s_suppkey % 13 = 0, 0, 10000000 + 200000 * (s_suppkey % 7)) as bigint) as request_milli",
            "explode(sequence(1, 6)) as i",
        )
        return rows.selectExpr(
            "namespace", "pod", "concat('c', i) as container", "explode(array('cpu', 'memory')) as resource", "request_milli"
        )

    @cached_property
    def pod_metrics(self) -> DataFrame:
        """Exported readings with amounts as text, one per order line."""
        n = "l_linenumber"
        containers = f"""array(named_struct('name', concat('c', {n}), 'usage', named_struct(
            'cpu', element_at(array(concat({n}, '00m'), string({n}), concat('0.', {n}), concat({n}, 'e1'),
              concat({n}, '000u'), 'bad', concat({n}, '7n')), cast(l_orderkey % 7 + 1 as int)),
            'memory', element_at(array(concat({n}, 'Ki'), concat({n}, 'Mi'), concat({n}, '.5Gi'), concat({n}, 'M'), null),
              cast(l_orderkey % 5 + 1 as int))))) as containers"""
        return self.table("lineitem").selectExpr(
            "'ns-0' as namespace", "concat('pod-', l_suppkey) as pod", "l_shipdate as timestamp", containers
        )

    @cached_property
    def activity(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id", *_home("user_id % 25"), "concat('session-user-', user_id) as session",
            "concat('user-', user_id) as user_name", "ts", "event_type as kind",
        )

    @cached_property
    def requests(self) -> DataFrame:
        """Access log with raw hosts and credentials in many forms."""
        code = lambda *parts: f"base64(encode(concat({', '.join(parts)}), 'UTF-8'))"
        named = self.table("events").selectExpr(
            "*", "event_id as e", "user_id % 25 as nk", "if(user_id % 25 % 2 = 0, 'connect', 'thrift') as kind",
        )
        rows = named.selectExpr("*", "concat('spark-', kind, '-', nk, '.example.com') as own_host")
        header = f"""element_at(array(
            concat('Basic ', {code("'user-'", "user_id", "':pw'")}), concat('bearer ', {code("'user-'", "user_id", "':a:b'")}),
            {code("'user-'", "user_id", "':pw'")}, concat('Basic not*base64-', user_id),
            concat('Basic ', {code("'user-'", "user_id")}), concat('Basic ', {code("':pw'", "user_id")}),
            concat('Digest ', {code("'user-'", "user_id", "':pw'")}), null, null), cast(e % 9 + 1 as int))"""
        inner = code("'inner-'", "user_id", "':x'")
        return rows.selectExpr(
            "e as request_id",
            "concat('ns-', nk % 9) as namespace",
            "ts",
            "concat('user-', user_id) as user_name",
            "if(e % 7 = 0, 'thrift', kind) as door",
            "case e % 5 when 0 then concat(own_host, ':443') when 1 then '' when 2 then null else own_host end as forwarded_host",
            "case e % 11 when 0 then '' when 1 then 'nowhere.example.com:80' else own_host end as authority",
            f"{header} as authorization",
            "case e % 4 when 0 then '' when 1 then concat('named-', user_id) end as header_user",
            "e % 3 <> 0 as has_password",
            f"case e % 6 when 0 then {inner} when 1 then concat('plain-', user_id) when 2 then '' end as user_id",
        )

    @cached_property
    def tokens(self) -> DataFrame:
        """Tokens with proper and improper claims."""
        url = lambda text: f"rtrim('=', translate(base64(encode({text}, 'UTF-8')), '+/', '-_'))"
        head = (
            """case event_id % 10 when 7 then '{"alg":"XX1"}' when 8 then '{"typ":"JWT"}' """
            """else '{"alg":"RS256","typ":"JWT"}' end"""
        )
        claims = """case event_id % 10
            when 1 then concat('{"sub":', user_id, ',"groups":["a"]}')
            when 2 then '{"groups":["a","b"]}'
            when 3 then '{"sub":"","groups":[]}'
            when 4 then concat('{"sub":"üser-', user_id, '","groups":["g', user_id % 5, '",7,null,"x?~"]}')
            when 5 then concat('{"sub":"user-', user_id, '","groups":"admins"}')
            else concat('{"sub":"user-', user_id, '","groups":["g', user_id % 5, '","h', user_id % 3, '"]}') end"""
        return self.table("events").selectExpr(
            "event_id",
            *_home("user_id % 25"),
            "concat('user-', user_id) as user_name",
            f"if(event_id % 10 = 9, 'no-token', concat_ws('.', {url(head)}, {url(claims)}, 'c2ln')) as token",
        )

    @cached_property
    def scaling_log(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id as action_id", *_home("user_id % 25"), "ts",
            "if(event_type in ('error', 'view'), 'shrink', 'grow') as action",
        )

    @cached_property
    def session_requests(self) -> DataFrame:
        """A start request per session; for one in five another later, when its fate is known."""
        again = "if(k % 5 = 0, array(0, 100), array(0))"
        rows = self._orders.selectExpr(
            *_home("nk"), "concat('session-', k) as session", f"explode({again}) as after", f"{_back('(k * 7) % 1000 + k % 600')} as start",
        )
        return rows.selectExpr("namespace", "session", "timestampadd(second, after, start) as ts")

    @cached_property
    def state_changes(self) -> DataFrame:
        """What became of each started session, some seconds after its request."""
        rows = self._orders.selectExpr(
            *_home("nk"), "concat('session-', k) as session", "k",
            f"{_back('(k * 7) % 1000 + k % 600')} as start",
            "case when k % 11 = 0 then 'Failed' when k % 13 = 0 then 'Pending' else 'Active' end as outcome",
            "if(k % 19 = 0, '', concat('app-', k, '.svc')) as host",
        )
        after = lambda seconds: f"timestampadd(second, int({seconds}), start)"
        changes = f"""inline(array(
            named_struct('seq', 0, 'ts', start, 'previous', '', 'state', 'Pending', 'endpoint', ''),
            named_struct('seq', 1, 'ts', {after("k % 70")}, 'previous', 'Pending', 'state', outcome, 'endpoint', host),
            named_struct('seq', 2, 'ts', {after("k % 70 + 400")}, 'previous', outcome,
              'state', if(k % 17 = 0, outcome, 'Terminated'), 'endpoint', host)))"""
        return rows.selectExpr("namespace", "pool", "session", changes)

    @cached_property
    def session_touches(self) -> DataFrame:
        """Touches of the sessions: event by event, of the session with that number."""
        events = self.table("events").selectExpr("event_id as k", "ts")
        return events.join(self._orders, "k").selectExpr(*_home("nk"), "concat('session-', k) as session", "ts")

    @cached_property
    def termination_asks(self) -> DataFrame:
        """Requests to end sessions: by owners, by others, and for sessions that do not exist."""
        return self._orders.selectExpr(
            "k as request_id", _home("nk")[0], "concat(if(k % 7 = 0, 'session-none-', 'session-'), k) as session",
            "if(k % 3 = 0, 'user-other', concat('user-', c)) as user_name",
        )

    @cached_property
    def pool_documents(self) -> DataFrame:
        """Pool records of many tenants, as exported JSON: fields missing, zero or wrong."""
        pick = lambda *vs: f"element_at(array({', '.join(vs)}), cast(c % {len(vs)} + 1 as int))"
        doc = f"""named_struct(
          'namespace', concat('ns-', c_nationkey), 'name', concat('tenant-', c),
          'spec', named_struct(
            'type', case when c % 41 = 0 then 'batch' when c % 2 = 0 then 'connect' else 'thrift' end,
            'host', if(c % 43 = 0, '', concat('tenant-', c, '.example.com')),
            'replicas', named_struct(
              'min', if(c % 47 = 0, -1, int(c % 3)),
              'max', case when c % 53 = 0 then 0 when c % 6 <> 0 then int(3 + c % 8) end),
            'scaling', named_struct(
              'metrics', named_struct(
                'type', if(c % 59 = 0, 'latency', {pick("'activeSessions'", "'activeSessions'", "null", "'cpu'", "'memory'")}),
                'targetPerInstance', case when c % 7 = 0 then null when c % 7 = 1 then 0 else int(5 + c % 20) end),
              'scaleUpThreshold', {pick("'0.8'", "''", "'0'", "'abc'", "null", "'1e-1'")},
              'cooldownSeconds', {pick("null", "0", "120", "180")},
              'drainBeforeScaleDown', {pick("null", "false", "true", "true")}),
            'sparkApplicationTemplate', named_struct('spec', named_struct(
              'image', concat('registry.example.com/server:1.', c % 3), 'sparkVersion', concat('3.5.', c % 4),
              'driver', named_struct('cores', 1, 'memory', '4g'),
              'executor', named_struct('cores', int(c % 4 + 1), 'memory', concat(4 * (c % 4 + 1), 'g'), 'instances', 1),
              'sparkConf', map('spark.dynamicAllocation.maxExecutors', string(c % 10 + 1),
                'spark.sql.parquet.mergeSchema', 'false'))),
            'sessionPolicy', named_struct(
              'maxSessionsPerUser', {pick("2", "null", "0", "3", "4", "5")},
              'maxTotalSessions', if(c % 8 = 1, null, int(50 + c % 10)),
              'idleTimeoutMinutes', {pick("null", "0", "360", "360", "90")},
              'defaultSessionConf', if(c % 3 <> 0,
                map('spark.executor.memory', concat(1 + c % 4, 'g'), 'spark.executor.cores', '2'), null),
              'quotas', if(c % 5 < 3, array(named_struct(
                'match', named_struct('users', array(concat('user-', c), 'admin'), 'groups', array(concat('team-', c % 4))),
                'maxSessionsPerUser', int(c % 3 * 4), 'sessionConf', map('spark.executor.memory', '16g'))), null))),
          'status', named_struct(
            'instances', array(named_struct('name', concat('tenant-', c, '-a'), 'state', if(c % 37 = 0, 'Lost', 'Running'),
              'activeSessions', int(c % 6), 'endpoint', concat('tenant-', c, '-driver-svc.fleet.svc'),
              'sparkApplicationState', 'RUNNING')),
            'totalActiveSessions', int(c % 30), 'currentReplicas', int(c % 4), 'readyReplicas', int(c % 3)))"""
        # A record is far more work than its key, and one row group may hold all keys: they are dealt out first. The
        # records are rows of a generator, so that no filter on what is in them is moved ahead of that.
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = self.table("customer").selectExpr("c_custkey as c", "c_nationkey").repartition(tasks, "c")
        return rows.selectExpr("c as pos", f"explode(array(to_json({doc}))) as doc")

    @cached_property
    def pool_records(self) -> DataFrame:
        return pool_records(self.pool_documents)

    @cached_property
    def tenant_pools(self) -> DataFrame:
        return flatten_pools(self.pool_records)

    @cached_property
    def pool_lists(self) -> DataFrame:
        """Documents that each hold a list of two pools."""
        item = lambda tag, kind: (
            f"named_struct('name', concat('tenant-', c_custkey, '{tag}'), "
            f"'spec', named_struct('type', '{kind}', 'host', concat('{tag}', c_custkey, '.example.com')))"
        )
        doc = (
            "named_struct('namespace', concat('ns-', c_nationkey), "
            f"'pools', array({item('a', 'connect')}, {item('b', 'thrift')}))"
        )
        return self.table("customer").selectExpr(f"to_json({doc}) as doc")

    @cached_property
    def desired_routes(self) -> DataFrame:
        return desired_routes(self.tenant_pools, PREFIX, MANAGER, PROXY)

    @cached_property
    def actual_routes(self) -> DataFrame:
        """The desired routes with every kind of fault; some belong to pools that are gone."""
        protocol = "nginx.ingress.kubernetes.io/backend-protocol"
        rows = self.desired_routes.withColumn("c", F.expr("bigint(substring_index(pool, '-', -1))"))
        extra = maps.overlay(F.col("annotations"), maps.literal({"other.example.com/note": "kept"}))
        return rows.filter("c % 6 <> 1").withColumns(
            {
                "route": F.expr("if(c % 29 = 0, concat('gone-', route), route)"),
                "host": F.expr("if(c % 6 = 2, 'wrong.example.com', host)"),
                "annotations": F.when(F.expr("c % 6 = 4"), extra).otherwise(
                    F.expr(f"if(c % 6 = 3, map_filter(annotations, (k, v) -> k <> '{protocol}'), annotations)")
                ),
                "labels": F.expr(f"if(c % 6 = 5, map_filter(labels, (k, v) -> k <> '{PREFIX}/managed-by'), labels)"),
                "path": F.expr("if(c % 31 = 0, '/other', path)"),
            }
        )

    @cached_property
    def route_owners(self) -> DataFrame:
        """Owner of each tenant's route; one in 29 names a pool that is gone."""
        return self.table("customer").selectExpr(
            "concat('ns-', c_nationkey) as namespace", "concat('tenant-', c_custkey) as tenant",
            "concat('route-', c_custkey) as name", "if(c_custkey % 29 = 0, 'tenant-gone', concat('tenant-', c_custkey)) as pool",
        )

    @cached_property
    def messages(self) -> DataFrame:
        return self.table("documents").selectExpr("doc_id", "text as message")
