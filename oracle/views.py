"""Sample views as SQL. A query names the views it needs; they are put ahead of it."""

import re

AS_OF = "timestamp '2024-01-31 00:00:00'"
PREFIX = "fleet.example.com"

VIEWS = {
    "f_pools": f"""
select concat('ns-', n_nationkey % 9) as namespace, concat('pool-', n_nationkey) as pool,
  cast(n_nationkey as bigint) as pos,
  case when n_nationkey % 2 = 0 then 'connect' else 'thrift' end as type,
  concat('spark-', case when n_nationkey % 2 = 0 then 'connect' else 'thrift' end, '-', n_nationkey, '.example.com') as host,
  n_nationkey % 3 as min_replicas, 3 + n_nationkey % 8 as max_replicas,
  case n_regionkey when 3 then 'cpu' when 4 then 'memory' else 'activeSessions' end as metric_type,
  case when n_nationkey % 10 = 9 then 0 when n_regionkey in (3, 4) then 80 when n_nationkey % 5 = 0 then 5 else 20 end as raw_target,
  case when raw_target > 0 then raw_target when n_regionkey in (3, 4) then 80 else 20 end as target,
  coalesce(nullif(try_cast(['0.8', '', '0', 'abc', '0.5', '0.9'][n_nationkey % 6 + 1] as double), 0), cast(0.8 as double)) as threshold,
  300 as cooldown_seconds,
  n_nationkey % 4 <> 0 as drain,
  case when n_nationkey % 5 = 0 then 2 else 5 end as max_sessions_per_user,
  case when n_nationkey % 11 = 10 then 0 when n_nationkey % 5 = 0 then 50 else 200 end as max_total_sessions,
  case when n_nationkey % 12 = 11 then 720 when n_nationkey % 5 = 0 then 360 else 720 end as idle_minutes,
  case when n_nationkey > 0 then {AS_OF} - to_minutes(n_nationkey) end as last_scale_time,
  n_nationkey % 4 <> 3 as has_conf
from nation""",
    "f_quotas": """
select concat('ns-', s_nationkey % 9) as namespace, concat('pool-', s_nationkey) as pool,
  concat('user-', c_custkey) as match_user, pos,
  case when pos = 0 and c_custkey % 50 = 0 then 20 when pos = 1 and c_custkey % 100 = 0 then 7 else 0 end as lim
from customer
left join supplier on s_suppkey = c_custkey % (select count(*) from supplier)
cross join (select unnest([0, 1, 2]) as pos) p""",
    "f_instances": """
select concat('ns-', s_nationkey % 9) as namespace, concat('pool-', s_nationkey) as pool,
  concat('pool-', s_nationkey, '-', s_suppkey) as instance, s_suppkey as pos,
  case s_suppkey % 10 when 6 then 'PENDING_RERUN' when 7 then 'FAILED' when 8 then 'SUBMITTED' when 9 then 'COMPLETED' else 'RUNNING' end as spark_state,
  case when s_suppkey % 10 = 5 then 'draining' else 'active' end as role,
  concat('spark-', s_suppkey) as app_id,
  case s_suppkey % 10 when 5 then 'Draining' when 6 then 'Pending' when 7 then 'Failed' when 8 then 'Pending' when 9 then 'Failed' else 'Running' end as app_state,
  case s_suppkey % 20 when 8 then 'Submitted' when 6 then 'Lost' else app_state end as state
from supplier""",
    "f_orders": """
select o_orderkey as k, o_custkey as c, s_nationkey, s_suppkey,
  case when o_orderkey % 89 = 0 then 99 when o_orderkey % 23 = 0 then o_orderkey % 25 else s_nationkey end as nk
from orders left join supplier on s_suppkey = o_custkey % (select count(*) from supplier)""",
    "f_sessions": f"""
select k, concat('ns-', nk % 9) as namespace, concat('session-', k) as session, concat('user-', c) as user_name,
  concat('pool-', nk) as pool,
  case when k > 0 and k % 1009 = 0 then 'Assigning'
    else ['Pending', '', 'Active', 'Active', 'Idle', 'Terminating', 'Terminated', 'Failed'][k % 8 + 1] end as state,
  case when k % 8 < 2 then '' when k % 97 = 0 then 'gone-instance'
    else coalesce('pool-' || s_nationkey || '-' || s_suppkey, '') end as assigned_instance,
  {AS_OF} - to_minutes((k * 7) % 1000 + k % 600) as created_at,
  case when k % 101 <> 0 then {AS_OF} - to_minutes((k * 7) % 1000) end as last_activity_at,
  case when k % 8 > 4 then {AS_OF} - to_minutes((k * 7) % 1000) end as ended_at,
  case when k % 50 = 0 then concat('other-', c) else concat('user-', c) end as label_user
from f_orders""",
    "f_live": "select * from f_sessions where state in ('Active', 'Idle', 'Pending')",
    "f_state_changes": f"""
select concat('ns-', nk % 9) as namespace, concat('session-', k) as session, seq,
  {AS_OF} - to_minutes((k * 7) % 1000 + k % 600)
    + to_seconds(case seq when 0 then 0 when 1 then k % 70 else k % 70 + 400 end) as ts,
  case when k % 11 = 0 then 'Failed' when k % 13 = 0 then 'Pending' else 'Active' end as outcome,
  case when seq = 0 then 'Pending' when seq = 2 and k % 17 <> 0 then 'Terminated' else outcome end as state, k, nk,
  case when seq > 0 and k % 19 <> 0 then concat('app-', k, '.svc') else '' end as endpoint,
  case when state in ('Active', 'Idle') then case when endpoint = '' then 'no_endpoint' else 'ok' end
    when state in ('Failed', 'Terminated', 'Terminating') then 'failed' end as result
from f_orders cross join (select unnest([0, 1, 2]) as seq) q""",
    "f_asked": """
select namespace, session, created_at as ts from f_sessions
union all select namespace, session, created_at + to_seconds(100) from f_sessions where k % 5 = 0""",
    "f_usage": """
select concat('ns-', s_nationkey % 9) as namespace, concat('pool-', s_nationkey, '-', l_suppkey, '-driver') as pod,
  concat('c', l_linenumber) as container, date_trunc('month', l_shipdate) as tick, r as resource,
  cast(sum(case r when 'cpu' then cast(round(l_extendedprice * 100) as bigint)
    else cast(round(l_quantity * 100000) as bigint) end) as bigint) as usage_milli
from lineitem join supplier on s_suppkey = l_suppkey cross join (select unnest(['cpu', 'memory']) as r) x
group by 1, 2, 3, 4, 5""",
    "f_pod": """
select i.namespace, i.pool, u.pod, u.tick, u.resource, cast(sum(u.usage_milli) as bigint) as usage, cast(sum(q.request_milli) as bigint) as request
from f_instances i join f_usage u on u.namespace = i.namespace and u.pod = i.instance || '-driver'
join (select s_suppkey, concat('c', k) as container,
    case when s_suppkey % 13 = 0 then 0 else 10000000 + 200000 * (s_suppkey % 7) end as request_milli
  from supplier cross join (select unnest([1, 2, 3, 4, 5, 6]) as k) x) q
  on q.s_suppkey = i.pos and q.container = u.container
where i.state = 'Running' group by all having sum(q.request_milli) <> 0""",
    "f_util": """
select namespace, pool, tick, resource, count(*) as measured_pods,
  avg(cast(usage as double) / request * 100) as mean_percent,
  cast(sum((cast(usage as hugeint) * 100000000) // request) // count(*) as bigint) as mean_micro_percent
from f_pod group by 1, 2, 3, 4""",
    "f_held": """
select namespace, pool, assigned_instance, count(*) as held from f_sessions where state in ('Active', 'Idle') group by all""",
    "f_load": """
select i.*, coalesce(held, 0) as active_sessions from f_instances i
left join f_held h on h.namespace = i.namespace and h.pool = i.pool and h.assigned_instance = i.instance""",
    "f_rollup": """
select p.namespace, p.pool, coalesce(instances, 0) as instances, coalesce(running, 0) as running, coalesce(ready, 0) as ready,
  coalesce(starting, 0) as starting, coalesce(failed, 0) as failed, coalesce(total, 0) as total, coalesce(waiting, 0) as waiting
from f_pools p
left join (select namespace, pool, count(*) as instances, count(*) filter (state in ('Running', 'Draining')) as running,
    count(*) filter (state = 'Running') as ready, count(*) filter (state in ('Pending', 'Submitted')) as starting,
    count(*) filter (state = 'Failed') as failed, cast(sum(active_sessions) as bigint) as total from f_load group by 1, 2) l
  on l.namespace = p.namespace and l.pool = p.pool
left join (select namespace, pool, count(*) as waiting from f_sessions
    where state in ('Pending', '') and assigned_instance = '' group by 1, 2) w
  on w.namespace = p.namespace and w.pool = p.pool""",
    "f_newest": """
select namespace, pool, resource, arg_max(mean_percent, tick) as mean_percent from f_util
where tick <= timestamp '2001-06-15 00:00:00' and tick > timestamp '2001-06-15 00:00:00' - to_days(31) group by 1, 2, 3""",
    "f_wanted": """
select p.namespace, p.pool, p.min_replicas, p.max_replicas, r.running, r.ready, r.starting, r.total + r.waiting as effective_load,
  case when p.metric_type = 'activeSessions' then
    case when r.ready > 0 and cast(r.total + r.waiting as double) / nullif(r.ready, 0) > p.target * p.threshold then 'crowded'
      when r.total + r.waiting > 0 then 'sessions' else 'no_load' end
  else case when u.mean_percent is not null and r.ready > 0 then
      case when r.waiting > 0 and ceil(r.ready * u.mean_percent / p.target) = 0 then 'waiting' else 'utilisation' end
    when r.waiting > 0 and p.min_replicas = 0 then 'waiting' else 'no_measure' end end as reason,
  cast(case reason when 'crowded' then r.ready + 1 when 'sessions' then (r.total + r.waiting + p.target - 1) // p.target
    when 'waiting' then 1 when 'utilisation' then ceil(r.ready * u.mean_percent / p.target)
    else p.min_replicas end as bigint) as n,
  cast(least(greatest(n, p.min_replicas), p.max_replicas) as int) as desired
from f_pools p join f_rollup r on r.namespace = p.namespace and r.pool = p.pool
left join f_newest u on u.namespace = p.namespace and u.pool = p.pool and u.resource = p.metric_type""",
    "f_limits": """
select namespace, pool, match_user as user_name, arg_max(lim, pos) as override from f_quotas where lim > 0 group by 1, 2, 3""",
    "f_check": """
select s.namespace, s.pool, s.user_name, s.session, s.state,
  coalesce(u.n, 0) - (s.state = 'Pending')::int as user_used, coalesce(l.override, p.max_sessions_per_user) as user_limit,
  case when p.pool is not null then coalesce(t.n, 0) - (s.state = 'Pending')::int end as pool_used, p.max_total_sessions as pool_limit,
  case when p.pool is null then 'pool_missing'
    when user_limit > 0 and user_used >= user_limit then 'user_over_quota'
    when pool_limit > 0 and pool_used >= pool_limit then 'pool_over_quota' else 'ok' end as verdict,
  case verdict when 'user_over_quota' then concat('user ', s.user_name, ' has reached max sessions (', user_used, '/', user_limit, ')')
    when 'pool_over_quota' then concat('pool ', s.pool, ' has reached max total sessions (', pool_used, '/', pool_limit, ')')
    when 'pool_missing' then concat('pool ', s.pool, ' not found') else '' end as message
from f_sessions s
left join f_pools p on p.namespace = s.namespace and p.pool = s.pool
left join (select namespace, pool, user_name, count(*) as n from f_live group by all) u
  on u.namespace = s.namespace and u.pool = s.pool and u.user_name = s.user_name
left join (select namespace, pool, count(*) as n from f_live group by all) t on t.namespace = s.namespace and t.pool = s.pool
left join f_limits l on l.namespace = s.namespace and l.pool = s.pool and l.user_name = s.user_name
where s.state in ('Pending', '')""",
    "f_endpoints": """
select namespace, pool, instance, pos, state,
  case when state in ('Running', 'Draining') and pos % 11 <> 0 then concat('app-', pos, '-driver-svc.', namespace, '.svc') else '' end as endpoint
from f_instances""",
    "f_candidates": """
select p.namespace, p.pool, b.instance, b.active_sessions,
  case when b.instance is not null then concat(e.endpoint, ':', case p.type when 'thrift' then '10001' else '8424' end) end as endpoint
from f_pools p left join (select namespace, pool, instance, active_sessions from f_load where state = 'Running'
  qualify row_number() over (partition by namespace, pool order by active_sessions, pos) = 1) b on b.namespace = p.namespace and b.pool = p.pool
left join f_endpoints e on e.instance = b.instance""",
    "f_transitions": f"""
select s.namespace, s.session, s.pool, s.state,
  case when s.state in ('Pending', '') then case when c.verdict <> 'ok' then 'Failed' when r.ready > 0 then 'Active' else s.state end
    when s.state in ('Active', 'Idle') then case when p.pool is null then 'Terminated' when i.instance is null then 'Pending'
      when {AS_OF} - last_activity_at > to_minutes(p.idle_minutes) then 'Terminating'
      when s.state = 'Active' and {AS_OF} - last_activity_at > to_minutes(10) then 'Idle' else s.state end
    when s.state = 'Terminating' then 'Terminated' else s.state end as next_state,
  case when s.state in ('Pending', '') then case when c.verdict <> 'ok' then c.verdict when r.ready > 0 then 'placed' else 'no_running_instance' end
    when s.state in ('Active', 'Idle') then case when p.pool is null then 'pool_deleted' when i.instance is null then 'instance_lost'
      when {AS_OF} - last_activity_at > to_minutes(p.idle_minutes) then 'idle_timeout'
      when s.state = 'Active' and {AS_OF} - last_activity_at > to_minutes(10) then 'idle_mark' else 'none' end
    when s.state = 'Terminating' then 'closing' else 'none' end as reason,
  case reason when 'placed' then d.instance when 'instance_lost' then '' else s.assigned_instance end as assigned_instance,
  case when reason = 'placed' then d.endpoint else '' end as endpoint,
  case when reason = 'placed' then {AS_OF} else s.created_at end as created_at,
  case when reason = 'placed' then {AS_OF} else s.last_activity_at end as last_activity_at
from f_sessions s left join f_pools p on p.namespace = s.namespace and p.pool = s.pool
left join f_candidates d on d.namespace = s.namespace and d.pool = s.pool
left join f_check c on c.namespace = s.namespace and c.session = s.session
left join f_rollup r on r.namespace = s.namespace and r.pool = s.pool
left join f_instances i on i.namespace = s.namespace and i.pool = s.pool and i.instance = s.assigned_instance and i.state = 'Running'""",
    "f_activity": """
select event_id, concat('ns-', (user_id % 25) % 9) as namespace, concat('pool-', user_id % 25) as pool,
  concat('session-user-', user_id) as session, concat('user-', user_id) as user_name, ts, event_type as kind from events""",
    "f_requests": """
select event_id as request_id, concat('ns-', n % 9) as namespace, ts, concat('user-', user_id) as user_name,
  case when event_id % 7 = 0 then 'thrift' else t end as door,
  case event_id % 5 when 0 then h || ':443' when 1 then '' when 2 then null else h end as forwarded_host,
  case event_id % 11 when 0 then '' when 1 then 'nowhere.example.com:80' else h end as authority,
  case when forwarded_host is null or forwarded_host = '' and door <> 'connect' then authority else forwarded_host end as raw_host,
  regexp_replace(raw_host, '^(.+):[^:]*$', '\\1') as host
from (select *, user_id % 25 as n, case when n % 2 = 0 then 'connect' else 'thrift' end as t,
  concat('spark-', t, '-', n, '.example.com') as h from events)""",
    "f_routed": """
select r.request_id, r.namespace, r.user_name, r.door, r.host,
  case when r.host <> '' then b.pool when o.n = 1 then o.pool end as pool,
  case when r.host <> '' then case when b.pool is null then 'no_pool' when b.type <> r.door then 'wrong_type' else 'ok' end
    when o.n is null then 'none_of_type' when o.n > 1 then 'ambiguous' else 'ok' end as status
from f_requests r
left join (select namespace, host, arg_min(pool, pos) as pool, arg_min(type, pos) as type from f_pools group by 1, 2) b
  on b.namespace = r.namespace and b.host = r.host
left join (select namespace, type, count(*) as n, min(pool) as pool from f_pools group by 1, 2) o
  on o.namespace = r.namespace and o.type = r.door""",
    "f_tenants": f"""
select c_custkey as c, concat('ns-', c_nationkey) as namespace, concat('tenant-', c_custkey) as pool,
  case when c % 41 = 0 then 'batch' when c % 2 = 0 then 'connect' else 'thrift' end as type,
  case when c % 43 = 0 then '' else concat('tenant-', c, '.example.com') end as host,
  cast(case when c % 47 = 0 then -1 else c % 3 end as int) as min_replicas,
  cast(case when c % 53 = 0 then 0 when c % 6 <> 0 then 3 + c % 8 else 10 end as int) as max_replicas,
  case when c % 59 = 0 then 'latency' when c % 5 = 3 then 'cpu' when c % 5 = 4 then 'memory' else 'activeSessions' end as metric_type,
  cast(case when c % 7 = 0 then 20 when c % 7 = 1 then case when metric_type in ('cpu', 'memory') then 80 else 20 end else 5 + c % 20 end as int) as target_per_instance,
  cast(case when c % 6 = 5 then 0.1 else 0.8 end as double) as scale_up_threshold, '0.3' as scale_down_threshold,
  case c % 4 when 0 then 300 when 1 then 300 when 2 then 120 else 180 end as cooldown_seconds,
  c % 4 <> 1 as drain_before_scale_down,
  [2, 5, 0, 3, 4, 5][c % 6 + 1] as max_sessions_per_user,
  cast(case when c % 8 = 1 then 200 else 50 + c % 10 end as int) as max_total_sessions,
  [720, 720, 360, 360, 90][c % 5 + 1] as idle_timeout_minutes,
  [720, 0, 360, 360, 90][c % 5 + 1] as raw_idle,
  case when c % 3 <> 0 then concat(1 + c % 4, 'g') end as default_memory,
  cast(c % 4 as int) as current_replicas, cast(c % 3 as int) as ready_replicas, cast(c % 30 as int) as total_active_sessions
from customer""",
    "f_profile": """
select namespace, pool, c, unnest(['image', 'version', 'driver.cores', 'driver.memory', 'executor.cores', 'executor.instances',
    'executor.memory', 'spark.dynamicAllocation.maxExecutors', 'spark.sql.parquet.mergeSchema']) as setting,
  unnest([concat('registry.example.com/server:1.', c % 3), concat('3.5.', c % 4), '1', '4g', cast(c % 4 + 1 as varchar), '1',
    concat(4 * (c % 4 + 1), 'g'), cast(c % 10 + 1 as varchar), 'false']) as value
from f_tenants""",
    "f_mark": """
select date_trunc('millisecond', max(ts)) - to_minutes(10) as mark from events""",
    "f_touches": """
select a.namespace, a.pool, a.session, a.ts, p.idle_minutes as gap,
  lead(ts) over (partition by a.namespace, a.pool, session order by ts) as nxt,
  lag(ts) over (partition by a.namespace, a.pool, session order by ts) as prev
from f_activity a join f_pools p on p.namespace = a.namespace and p.pool = a.pool""",
    "f_moments": """
select namespace, pool, user_name, created_at as ts, 1 as d from f_sessions
union all select namespace, pool, user_name, ended_at, -1 from f_sessions where ended_at is not null""",
}


def with_views(sql: str) -> str:
    """The query with the views it names, directly or through other views, put ahead of it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bf_\w+\b", text):
            if name not in needed:
                need(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    need(sql)
    if not needed:
        return sql.strip()
    ahead = ",\n".join(f"{name} as ({VIEWS[name].strip()})" for name in needed)
    return f"with {ahead}\n{sql.strip()}"
