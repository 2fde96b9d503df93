"""One SQL query per registered query that SQL can express."""

from oracle.views import AS_OF, PREFIX, with_views

def _audit(keys: str, limits: str) -> str:
    """Concurrency over the limit, from one running sum and the next moment of the key."""
    return f"""
select {keys}, max(lim) as session_limit, cast(max(live) as bigint) as peak,
  min(ts) filter (lim > 0 and live > lim and live - d <= lim) as first_breach,
  count(*) filter (lim > 0 and live > lim and live - d <= lim) as breaches,
  cast(coalesce(sum(date_diff('second', ts, coalesce(nxt, {AS_OF}))) filter (lim > 0 and live > lim), 0) // 60 as bigint) as minutes_over
from (select t.*, lim, sum(d) over w as live, lead(ts) over w as nxt
  from (select {keys}, ts, cast(sum(d) as bigint) as d from f_moments group by all) t
  left join ({limits}) using ({keys})
  window w as (partition by {keys} order by ts))
group by {keys}"""


_SQL = {
    "instance_load": "select namespace, pool, instance, state, active_sessions from f_load",
    "pool_rollup": "select * from f_rollup",
    "pool_utilisation": "select namespace, pool, tick, resource, measured_pods, mean_micro_percent from f_util",
    "pod_utilisation": "select * from f_pod",
    "desired_replicas": "select namespace, pool, effective_load, running, ready, starting, desired, reason from f_wanted",
    "capacity_plan": f"""
select namespace, pool, 'create' as action, concat(pool, '-new-', i) as instance
from (select namespace, pool, unnest(range(1, desired - running - starting + 1)) as i from f_wanted)
union all
select namespace, pool, case when removable = 1 then 'remove' else 'drain' end, instance
from (select *, sum(removable) over (partition by namespace, pool order by pos) - removable as before
  from (select l.*, w.running - w.desired as k, case when p.drain and l.active_sessions > 0 then 0 else 1 end as removable
    from f_load l join f_wanted w on w.namespace = l.namespace and w.pool = l.pool
    join f_pools p on p.namespace = l.namespace and p.pool = l.pool
    where l.state = 'Running' and w.running > w.desired
      and (p.last_scale_time is null or {AS_OF} - p.last_scale_time > to_seconds(p.cooldown_seconds))))
where before < k
union all
select namespace, pool, 'replace', instance from f_load where state = 'Failed'""",
    "scaling_audit": """
select namespace, pool, event_id as action_id, ts, date_diff('microsecond', prev, ts) // 1000000 as seconds_since_previous,
  coalesce(ts - prev <= to_seconds(300), false) as inside_cooldown
from (select *, lag(ts) over (partition by namespace, pool order by ts, event_id) as prev
  from f_activity where kind in ('error', 'view'))""",
    "quota_limits": "select namespace, pool, user_name, override from f_limits",
    "group_quota_limits": """
select m.namespace, m.pool, m.user_name, arg_max(lim, pos) as override
from (select distinct concat('ns-', (user_id % 25) % 9) as namespace, concat('pool-', user_id % 25) as pool, concat('user-', user_id) as user_name,
    unnest(case when event_id % 10 in (0, 6, 7, 8) then [concat('g', user_id % 5), concat('h', user_id % 3)]
      when event_id % 10 = 4 then [concat('g', user_id % 5), 'x?~'] when event_id % 10 = 1 then ['a']
      when event_id % 10 = 2 then ['a', 'b'] else [] end) as g from events) m
join f_quotas q on q.namespace = m.namespace and q.pool = m.pool and concat('g', q.pos) = m.g where lim > 0 group by 1, 2, 3""",
    "live_sessions": "select namespace, pool, user_name, count(*) as live from f_live group by all",
    "quota_check": "select * from f_check",
    "quota_pressure": """
select u.namespace, u.pool, u.user_name, u.n as used, coalesce(override, max_sessions_per_user) as user_limit,
  concat(u.n, '/', coalesce(override, max_sessions_per_user)) as pressure,
  coalesce(override, max_sessions_per_user) > 0 and u.n >= coalesce(override, max_sessions_per_user) as full
from (select namespace, pool, user_name, count(*) as n from f_live group by all) u
join f_pools p on p.namespace = u.namespace and p.pool = u.pool
left join f_limits l on l.namespace = u.namespace and l.pool = u.pool and l.user_name = u.user_name""",
    "concurrency": """
select namespace, pool, ts, cast(sum(d) as bigint) as delta,
  cast(sum(sum(d)) over (partition by namespace, pool order by ts) as bigint) as live
from f_moments group by namespace, pool, ts""",
    "quota_audit": _audit("namespace, pool", "select namespace, pool, max_total_sessions as lim from f_pools"),
    "quota_audit_users": _audit(
        "namespace, pool, user_name",
        """select m.namespace, m.pool, m.user_name, coalesce(any_value(override), any_value(max_sessions_per_user)) as lim
from f_moments m left join f_pools p on p.namespace = m.namespace and p.pool = m.pool
left join f_limits l on l.namespace = m.namespace and l.pool = m.pool and l.user_name = m.user_name group by all""",
    ),
    "instance_endpoints": "select instance, state, endpoint from f_endpoints",
    "placement_candidates": "select * from f_candidates",
    "waiting_outlook": """
select c.namespace, c.pool, user_name, session, verdict,
  case when verdict <> 'ok' then 'refused' when d.instance is null then 'no running instance' else 'placed' end as outlook,
  case when verdict = 'ok' then d.instance end as instance, case when verdict = 'ok' then d.endpoint end as endpoint
from f_check c left join f_candidates d on d.namespace = c.namespace and d.pool = c.pool""",
    "session_transitions": "select * from f_transitions",
    "alive_sessions": """
select s.namespace, session, assigned_instance from f_sessions s join f_instances i on i.namespace = s.namespace and i.pool = s.pool
  and i.instance = s.assigned_instance and i.state = 'Running' where s.state in ('Active', 'Idle')""",
    "sessions_to_reassign": """
select s.namespace, session, assigned_instance from f_sessions s where s.state in ('Active', 'Idle') and not exists (
  select 1 from f_instances i where i.namespace = s.namespace and i.pool = s.pool and i.instance = s.assigned_instance and i.state = 'Running')""",
    "termination_requests": """
select k as request_id, namespace, case when k % 7 = 0 then concat('session-none-', k) else concat('session-', k) end as session,
  case when k % 3 = 0 then 'user-other' else concat('user-', c) end as user_name,
  case when k % 7 = 0 then 'not_found' when k % 3 = 0 then 'forbidden' else 'accepted' end as answer,
  case when k % 7 <> 0 and k % 3 <> 0 then 'Terminating' end as next_state
from (select k, c, concat('ns-', nk % 9) as namespace from f_orders)""",
    "orphans": """
select 'session' as kind, s.namespace, s.pool, session as name from f_sessions s
where state not in ('Terminated', 'Failed') and not exists (select 1 from f_pools p where p.namespace = s.namespace and p.pool = s.pool)
union all
select 'instance', namespace, 'pool-gone', instance from f_instances where pos % 17 = 0
union all
select 'route', namespace, 'tenant-gone', concat('route-', c) from f_tenants where c % 29 = 0""",
    "session_reuse": """
select r.request_id, r.namespace, r.pool, r.user_name, s.session from f_routed r
left join (select namespace, pool, label_user as user_name, arg_min(session, (created_at, session)) as session from f_sessions
  where state in ('Active', 'Idle', 'Pending', 'Assigning') group by 1, 2, 3) s
  on s.namespace = r.namespace and s.pool = r.pool and s.user_name = r.user_name
where r.status = 'ok'""",
    "session_reuse_known": """
select r.request_id, r.namespace, r.pool, r.user_name, s.session from f_routed r
left join (select namespace, pool, label_user as user_name, arg_min(session, (created_at, session)) as session from f_sessions
  where state in ('Active', 'Idle', 'Pending', 'Assigning') or state = '' and k % 16 = 1 group by 1, 2, 3) s
  on s.namespace = r.namespace and s.pool = r.pool and s.user_name = r.user_name
where r.status = 'ok'""",
    "session_table": """
, moved as (
  select s.namespace, s.session, s.pool, s.user_name, o.next_state, o.reason, o.assigned_instance, o.endpoint, o.created_at, o.last_activity_at,
    a.k is not null as asked
  from f_sessions s join f_transitions o on o.namespace = s.namespace and o.session = s.session
  left join (select k from f_orders where k % 3 <> 0 and k % 7 <> 0) a on a.k = s.k
)
select namespace, session, pool, user_name, case when asked then 'Terminating' else next_state end as state,
  assigned_instance, endpoint, created_at, last_activity_at from moved""",
    "activation_wait": f"""
select namespace, session, ts, case when now is not null then 0
    when next_ts <= ts + to_seconds(60) then date_diff('second', ts, next_ts) end as wait_seconds,
  case when now is not null then now when next_ts <= ts + to_seconds(60) then next_result
    when ts + to_seconds(60) < {AS_OF} then 'timeout' else 'pending' end as outcome
from (select q.namespace, q.session, q.ts, arg_max(coalesce(c.result, ''), (c.ts, c.seq)) filter (c.ts <= q.ts) as latest, nullif(latest, '') as now,
    min(c.ts) filter (c.ts > q.ts and c.state <> 'Pending') as next_ts,
    arg_min(c.result, (c.ts, c.seq)) filter (c.ts > q.ts and c.state <> 'Pending') as next_result
  from f_asked q left join f_state_changes c on c.namespace = q.namespace and c.session = q.session group by 1, 2, 3)""",
    "last_activity": """
select namespace, pool, session, max(ts) as last_activity_at, count(*) as touches from f_activity group by 1, 2, 3""",
    "touched_sessions": """
select namespace, session,
  case when state = 'Idle' and (last_activity_at is null or e.ts > last_activity_at) and e.ts is not null then 'Active' else state end as state,
  greatest(last_activity_at, e.ts) as last_activity_at
from f_sessions left join events e on e.event_id = k""",
    "touch_thinning": """
select namespace, pool, session, max(ts) as ts from f_activity group by namespace, pool, session, time_bucket(interval 2 minutes, ts)""",
    "touch_gaps": """
select namespace, pool, session, event_id, ts,
  date_diff('microsecond', lag(ts) over (partition by namespace, pool, session order by ts, event_id), ts) // 1000000 as seconds_since_previous
from f_activity""",
    "idle_sessions": """
select namespace, pool, user_name, min(ts) as started_at, max(ts) as last_touch_at, count(*) as touches
from (select *, sum(cut) over (partition by namespace, pool, user_name order by ts) as stretch
  from (select a.*, case when ts - lag(ts) over (partition by a.namespace, a.pool, user_name order by ts) > to_minutes(p.idle_minutes)
      then 1 else 0 end as cut
    from f_activity a join f_pools p on p.namespace = a.namespace and p.pool = a.pool))
group by namespace, pool, user_name, stretch""",
    "request_hosts": "select request_id, host from f_requests",
    "pool_of_type": """
select namespace, type, count(*) as pools_of_type, case when count(*) = 1 then min(pool) end as only_pool from f_tenants group by 1, 2""",
    "pool_by_host": """
select namespace, host, arg_min(pool, c) as host_pool, arg_min(type, c) as host_type from f_tenants group by 1, 2""",
    "route_requests": "select * from f_routed",
    "desired_routes": """
select namespace, concat(pool, '-', type) as route, 'nginx' as class, host, '/' as path, 'Prefix' as path_type, 'fleet-proxy' as service,
  case type when 'connect' then 15002 else 10009 end as port, a as annotation,
  case a when 'nginx.ingress.kubernetes.io/backend-protocol' then case type when 'connect' then 'GRPC' else 'HTTP' end
    when 'yandex.cloud/load-balancer-type' then 'internal' when 'nginx.ingress.kubernetes.io/proxy-buffer-size' then '32k'
    when 'nginx.ingress.kubernetes.io/proxy-buffers-number' then '8' when 'nginx.ingress.kubernetes.io/proxy-body-size' then '0'
    else '3600' end as annotation_value
from (select *, unnest(['nginx.ingress.kubernetes.io/backend-protocol', 'yandex.cloud/load-balancer-type',
    'nginx.ingress.kubernetes.io/proxy-read-timeout', 'nginx.ingress.kubernetes.io/proxy-send-timeout'] ||
    case type when 'connect' then ['nginx.ingress.kubernetes.io/proxy-buffer-size', 'nginx.ingress.kubernetes.io/proxy-buffers-number']
      else ['nginx.ingress.kubernetes.io/proxy-body-size'] end) as a
  from f_tenants where type <> 'batch')""",
    "ownership_labels": f"""
select session, unnest(['{PREFIX}/user', '{PREFIX}/pool', '{PREFIX}/origin']) as label, unnest([user_name, pool, 'proxy']) as label_value
from f_sessions""",
    "instance_labels": f"""
select instance, unnest(['{PREFIX}/pool', '{PREFIX}/pool-type', '{PREFIX}/managed-by', '{PREFIX}/instance-role']) as label,
  unnest([i.pool, p.type, 'fleet-manager', 'active']) as label_value
from f_instances i join f_pools p on p.namespace = i.namespace and p.pool = i.pool""",
    "service_records": """
select namespace, concat('app-', pos, unnest(['-ui-svc', case when pos % 11 = 0 then '-headless' else '-driver-svc' end])) as service,
  app_id, unnest([0, 1]) as pos from f_instances""",
    "route_records": """
select namespace, concat(pool, '-', type) as route, 'nginx' as class, host, '/' as path, 'Prefix' as path_type, 'fleet-proxy' as service,
  case type when 'connect' then 15002 else 10009 end as port from f_tenants where type <> 'batch'""",
    "written_listing": """
select concat('{"name":"', session, '","user":"', user_name, '","pool":"', pool, '","state":"', state, '"}') as value
from f_sessions where user_name = 'user-7'""",
    "route_drift": f"""
select namespace, concat(pool, '-', type) as route,
  case when c % 6 = 1 or c % 29 = 0 then 'create' when differs = '' then 'keep' else 'update' end as verdict,
  case when c % 6 = 1 or c % 29 = 0 then '' else differs end as differs
from (select *, array_to_string(list_filter([case when c % 6 = 2 then 'host' end, case when c % 31 = 0 then 'path' end,
    case when c % 6 = 5 then 'label:{PREFIX}/managed-by' end,
    case when c % 6 = 3 then 'annotation:nginx.ingress.kubernetes.io/backend-protocol' end], lambda x: x is not null), ',') as differs
  from f_tenants where type <> 'batch')
union all
select namespace, concat('gone-', pool, '-', type), 'delete', '' from f_tenants
where type <> 'batch' and c % 29 = 0 and c % 6 not in (1, 5)""",
    "pool_settings": """
select namespace, pool, type, host, min_replicas, max_replicas, metric_type, target_per_instance, scale_up_threshold, scale_down_threshold,
  cooldown_seconds, drain_before_scale_down, max_sessions_per_user, max_total_sessions, idle_timeout_minutes from f_tenants""",
    "pool_quotas": """
select namespace, pool, 0 as pos, u as match_user, cast(c % 3 * 4 as int) as max_sessions_per_user, 'spark.executor.memory' as k, '16g' as v
from (select *, unnest([concat('user-', c), 'admin']) as u from f_tenants where c % 5 < 3)""",
    "pool_instances": """
select namespace, pool, pool || '-a' as instance, 0 as pos, case when c % 37 = 0 then 'Lost' else 'Running' end as state,
  cast(c % 6 as int) as active_sessions, pool || '-driver-svc.fleet.svc' as endpoint from f_tenants""",
    "pool_list_documents": """
select namespace, concat(pool, tag) as pool, pos, case tag when 'a' then 'connect' else 'thrift' end as type,
  concat(tag, c, '.example.com') as host, 10 as max_replicas, 'activeSessions' as metric_type
from (select namespace, pool, c, unnest(['a', 'b']) as tag, unnest([0, 1]) as pos from f_tenants)""",
    "session_records": f"""
select concat('ns-', nk % 9) as namespace, concat('session-', k) as session, concat('user-', c) as user_name, concat('pool-', nk) as pool,
  ['Pending', '', 'Active', 'Active', 'Idle', 'Terminating', 'Terminated', 'Failed'][k % 8 + 1] as state,
  case when k % 8 < 2 then '' else concat('pool-', s_nationkey, '-', s_suppkey) end as assigned_instance,
  {AS_OF} - to_minutes(k % 600) as created_at, case when k % 3 = 0 then concat(1 + k % 8, 'g') end as memory
from f_orders""",
    "own_sessions": "select session as name, user_name as user, pool, state from f_sessions where user_name = 'user-7'",
    "fleet_rollup": """
select region, type, case when grouping(pool_name) = 0 then pool_name end as pool_name,
  cast(grouping(region) + grouping(type) + grouping(pool_name) as int) as level, count(*) as pools,
  sum(instances)::bigint as instances, sum(running)::bigint as running, sum(ready)::bigint as ready, sum(starting)::bigint as starting,
  sum(failed)::bigint as failed, sum(total)::bigint as total, sum(waiting)::bigint as waiting,
  cast(floor(sum(total) * 1000000 / nullif(sum(ready), 0)) as bigint) as micro_sessions_per_ready
from (select r.*, p.type, concat('region-', n_regionkey) as region, concat_ws('/', r.namespace, r.pool) as pool_name
  from f_rollup r join f_pools p on p.namespace = r.namespace and p.pool = r.pool join nation on concat('pool-', n_nationkey) = p.pool)
group by rollup (region, type, pool_name)""",
    "counts_by_bucket": """
select s.namespace, s.pool, assigned_instance as instance, count(*) filter (state in ('Active', 'Idle')) as held,
  count(*) filter (state in ('Pending', '') and assigned_instance = '') as waiting
from f_sessions s join f_pools p on p.namespace = s.namespace and p.pool = s.pool group by 1, 2, 3""",
    "balanced_placement": """
, new as (
  select c.namespace, c.pool, c.session, row_number() over (partition by c.namespace, c.pool order by s.created_at, c.session) as rank,
    count(*) over (partition by c.namespace, c.pool) as m
  from f_check c join f_sessions s on s.namespace = c.namespace and s.session = c.session where c.verdict = 'ok'
), wanted as (select distinct namespace, pool, m from new),
-- Every seat an instance could offer, lowest load first: the m lowest of a pool are taken.
seats as (
  select l.namespace, l.pool, l.instance, l.pos, l.active_sessions as load, l.active_sessions + x as level
  from f_load l join wanted w on w.namespace = l.namespace and w.pool = l.pool, unnest(range(0, w.m)) as u(x) where l.state = 'Running'
), ranked as (
  select *, row_number() over (partition by namespace, pool order by level, load, pos) as n from seats
), taken as (
  select r.* from ranked r join wanted w on w.namespace = r.namespace and w.pool = r.pool where n <= m
), dealt as (
  select *, row_number() over (partition by namespace, pool order by load, pos, level) as rank from taken
)
select namespace, pool, session, instance from new join dealt using (namespace, pool, rank)""",
    "label_columns": "select namespace, session, user_name from f_sessions where label_user = 'user-7'",
    "broken_records": """
select case when not cut and not nameless then concat('session-', k) end as session,
  case when not cut and not nameless then ['Pending', '', 'Active', 'Active', 'Idle', 'Terminating', 'Terminated', 'Failed'][k % 8 + 1] end as state,
  case when cut then concat('{"namespace":"ns-1","name":"session-', k) when nameless then concat('{"namespace":"ns-1","labels":{"k":"', k, '"}}') end as line,
  case when cut then 'unreadable' when nameless then 'key_missing' end as reason
from (select k, k % 37 = 0 as cut, k % 41 = 0 as nameless from f_orders)""",
    "own_sessions_by_label": """
select session as name, user_name as user, label_user as "labelUser", pool, state from f_sessions where label_user = 'user-7'""",
    "instance_states": "select namespace, pool, instance, pos, spark_state, role, app_id, app_state as state from f_instances",
    "container_quantities": """
select concat('pod-', l_suppkey) as pod, concat('c', l_linenumber) as container, r as resource, count(*) as readings,
  cast(ceil(cast(sum(case r when 'cpu' then [n * 100000000, n * 1000000000, n * 100000000, n * 10000000000, n * 1000000, null, n * 10 + 7][l_orderkey % 7 + 1]
    else [n * 1024000, n * 1048576000, n * 1073741824000 + 536870912000, n * 1000000000, 0][l_orderkey % 5 + 1]::hugeint * 1000000 end) as decimal(38,0)) / 1000000) as bigint) as usage_milli,
  count(*) filter (r = 'cpu' and l_orderkey % 7 = 5) as unreadable
from (select *, cast(l_linenumber as bigint) as n from lineitem) cross join (select unnest(['cpu', 'memory']) as r) x group by 1, 2, 3""",
    "label_selection": "select namespace, session, user_name from f_sessions where namespace = 'ns-3' and pool = 'pool-3'",
    "keyed_sessions": """
select namespace, session, state from f_sessions s where exists (
  select 1 from f_requests r where r.namespace = s.namespace and concat('session-', r.request_id) = s.session)""",
    "safe_user_tokens": """
select c_custkey, lower(replace(replace(concat(c_name, '_', c_mktsegment, '_x.Y'), '_', '-'), '.', '-')) as token from customer""",
    "session_listing": """
select session as name, user_name as user, pool, state, nullif(assigned_instance, '') as "assignedInstance",
  nullif(concat_ws(',', case when k % 5 = 0 then concat('spark.dynamicAllocation.maxExecutors=', k % 9) end,
    case when k % 3 = 0 then concat('spark.executor.memory=', 1 + k % 8, 'g') end), '') as "sparkConf",
  created_at as "createdAt", last_activity_at as "lastActivityAt" from f_sessions""",
    "pool_listing": """
select pool as name, type, host, min_replicas as "minReplicas", max_replicas as "maxReplicas", current_replicas as "currentReplicas",
  ready_replicas as "readyReplicas", total_active_sessions as "totalActiveSessions", max_sessions_per_user as "maxSessionsPerUser",
  max_total_sessions as "maxTotalSessions", raw_idle as "idleTimeoutMinutes", default_memory as "defaultSessionConf" from f_tenants""",
    "listing_json": """
select concat('{"name":"', session, '","user":"', user_name, '","pool":"', pool, '","state":"', state, '"',
  case when assigned_instance <> '' then concat(',"assignedInstance":"', assigned_instance, '"') end,
  case when k % 3 = 0 and k % 5 = 0 then concat(',"sparkConf":{"spark.executor.memory":"', 1 + k % 8, 'g","spark.dynamicAllocation.maxExecutors":"', k % 9, '"}')
    when k % 3 = 0 then concat(',"sparkConf":{"spark.executor.memory":"', 1 + k % 8, 'g"}')
    when k % 5 = 0 then concat(',"sparkConf":{"spark.dynamicAllocation.maxExecutors":"', k % 9, '"}') end,
  ',"createdAt":"', strftime(created_at, '%Y-%m-%dT%H:%M:%SZ'), '"',
  case when last_activity_at is not null then concat(',"lastActivityAt":"', strftime(last_activity_at, '%Y-%m-%dT%H:%M:%SZ'), '"') end, '}') as value
from f_sessions""",
    "pool_health": """
select namespace, pool, type, concat(current_replicas, ' / ', min_replicas, '..', max_replicas) as replicas,
  case when ready_replicas < current_replicas then 'not-ready' when ready_replicas = 0 then 'zero' else 'ready' end as health,
  total_active_sessions = 0 as no_sessions from f_tenants""",
    "pool_columns": """
select namespace, pool, type, host, current_replicas as replicas, ready_replicas as ready, total_active_sessions as sessions,
  c * 86400 as age_seconds from f_tenants""",
    "session_columns": f"""
select namespace, session, user_name as user, pool, state, assigned_instance as instance,
  date_diff('second', last_activity_at, {AS_OF}) as idle_seconds, date_diff('second', created_at, {AS_OF}) as age_seconds from f_sessions""",
    "validate_pools": """
select rule, count(*) as bad_rows, min(concat(namespace, '/', pool)) as first_key
from (select *, unnest([case when type = 'batch' then 'type_unknown' end, case when host = '' then 'host_empty' end,
    case when min_replicas < 0 then 'min_replicas_below_0' end, case when max_replicas < 1 then 'max_replicas_below_1' end,
    case when metric_type = 'latency' then 'metric_type_unknown' end, case when c % 37 = 0 then 'instance_state_unknown' end]) as rule
  from f_tenants) where rule is not null group by 1""",
    "validate_sessions": """
select rule, count(*) as bad_rows, min(concat(namespace, '/', session)) as first_key
from (select *, unnest([case when state = '' and k % 16 <> 1 then 'state_empty' end, case when state = 'Assigning' then 'state_unknown' end,
    case when label_user <> user_name then 'user_label_differs' end, case when k % 21 = 0 then 'condition_type' end,
    case when k % 33 = 0 then 'condition_status' end, case when k % 39 = 0 or k % 51 = 0 then 'condition_reason' end,
    case when k % 57 = 0 then 'condition_message' end, case when k % 87 = 0 then 'condition_generation_below_0' end,
    case when k % 93 = 0 then 'condition_time_missing' end]) as rule from f_sessions) where rule is not null group by 1""",
    "template_profile": "select namespace, pool, setting, value from f_profile",
    "template_differences": """
select setting, value, count(*) as pools, min(pool) as first_pool, any_value(values_seen) as values_seen
from f_profile join (select setting, count(distinct value) as values_seen from f_profile group by 1) using (setting)
where values_seen > 1 group by 1, 2""",
    "effective_conf": """
select namespace, session, key as conf_key, arg_max(value, layer) as conf_value,
  ['pool', 'quota', 'session'][max(layer)] as origin
from (
  select s.namespace, s.session, 1 as layer, unnest(['spark.executor.memory', 'spark.executor.cores']) as key, unnest(['4g', '2']) as value
    from f_sessions s join f_pools p on p.namespace = s.namespace and p.pool = s.pool where p.has_conf
  union all
  select s.namespace, s.session, 2, case when bool_or(pos = 1) then 'spark.executor.cores' else 'spark.executor.memory' end,
      case when bool_or(pos = 1) then '8' else '16g' end
    from f_sessions s join f_quotas q on q.namespace = s.namespace and q.pool = s.pool and q.match_user = s.user_name
    where q.lim > 0 group by 1, 2
  union all
  select namespace, session, 3, 'spark.executor.memory', concat(1 + k % 8, 'g') from f_sessions where k % 3 = 0
  union all
  select namespace, session, 3, 'spark.dynamicAllocation.maxExecutors', cast(k % 9 as varchar) from f_sessions where k % 5 = 0)
group by 1, 2, 3""",
    "access_identity": """
select event_id as request_id, coalesce(h, e, m) as user_name,
  case when h is not null then 'authorization' when e is not null then 'explicit' when m is not null then 'message' else 'none' end as source
from (select event_id, event_id % 7 <> 0 and user_id % 25 % 2 = 0 as connect, case when event_id % 9 < 2 then concat('user-', user_id) end as h,
    case when connect and event_id % 3 <> 0 and event_id % 4 = 1 then concat('named-', user_id) end as e,
    case when connect then case event_id % 6 when 0 then concat('inner-', user_id) when 1 then concat('plain-', user_id) end end as m from events)""",
    "token_claims": """
select event_id, case when event_id % 10 in (0, 5, 6) then concat('user-', user_id) when event_id % 10 = 4 then concat('üser-', user_id) end as claimed_user,
  case when event_id % 10 in (0, 6) then concat('g', user_id % 5, ',h', user_id % 3) when event_id % 10 = 4 then concat('g', user_id % 5, ',x?~')
    when event_id % 10 = 5 then '' end as claimed_groups from events""",
    "error_log_trim": """
select doc_id, octet_length(b) > 1024 as truncated, octet_length(b) as full_bytes,
  case when octet_length(b) > 1024 then 1024 + 24 else octet_length(b) end as kept_bytes,
  md5(case when octet_length(b) > 1024 then b[1:1024] || encode('... [truncated by proxy]') else b end) as kept_md5
from (select doc_id, encode(text) as b from documents)""",
    "pool_status_table": f"""
select r.namespace, r.pool, running as current_replicas, ready as ready_replicas, total as total_active_sessions,
  {AS_OF} + to_seconds(30 * tick) as as_of,
  coalesce(i.names, '') as instances
from f_rollup r left join (select namespace, pool, string_agg(concat_ws('/', instance, state, active_sessions), ',' order by pos) as names
    from f_load group by 1, 2) i on i.namespace = r.namespace and i.pool = r.pool
cross join (select unnest([0, 1, 2, 3]) as tick) t""",
    "session_state_table": """
select namespace, session, arg_max(concat('pool-', nk), (ts, seq)) as pool, arg_max(state, (ts, seq)) as state, max(ts) as ts
from f_state_changes group by 1, 2""",
    "sessions_by_pool": "select namespace, pool, session, state from f_sessions where namespace = 'ns-3' and pool = 'pool-3'",
    "stream_last_activity": "select namespace, pool, session, max(ts) as last_activity_at from f_activity group by 1, 2, 3",
    "stream_touch_thinning": """
select namespace, pool, session, max(ts) as ts from f_activity
group by namespace, pool, session, time_bucket(interval 2 minutes, ts)
having time_bucket(interval 2 minutes, max(ts)) + to_minutes(2) <= (select mark from f_mark)""",
    "stream_idle_sessions": """
select namespace, pool, user_name, min(ts) as started_at, max(ts) as last_touch_at, count(*) as touches
from (select *, sum(cut) over (partition by namespace, pool, user_name order by ts) as stretch
  from (select a.*, p.idle_minutes, case when ts - lag(ts) over (partition by a.namespace, a.pool, user_name order by ts) > to_minutes(p.idle_minutes)
      then 1 else 0 end as cut
    from f_activity a join f_pools p on p.namespace = a.namespace and p.pool = a.pool))
group by namespace, pool, user_name, stretch, idle_minutes
having max(ts) + to_minutes(idle_minutes) <= (select mark from f_mark)""",
    "stream_first_requests": """
select namespace, pool, user_name, min(ts) as ts
from (select *, sum(cut) over (partition by namespace, pool, user_name order by ts) as burst
  from (select *, case when ts - lag(ts) over (partition by namespace, pool, user_name order by ts) >= to_minutes(10)
      then 1 else 0 end as cut from f_activity))
group by namespace, pool, user_name, burst
having max(ts) + to_minutes(10) <= (select mark from f_mark)""",
    "stream_access_identity": """
select cast(event_id as varchar) as request_id, coalesce(h, e, m) as user_name,
  case when h is not null then 'authorization' when e is not null then 'explicit' when m is not null then 'message' else 'none' end as source
from (select event_id, event_id % 7 <> 0 and user_id % 25 % 2 = 0 as connect, case when event_id % 9 < 2 then concat('user-', user_id) end as h,
    case when connect and event_id % 3 <> 0 and event_id % 4 = 1 then concat('named-', user_id) end as e,
    case when connect then case event_id % 6 when 0 then concat('inner-', user_id) when 1 then concat('plain-', user_id) end end as m from events)""",
    "stream_activity_records": "select namespace, pool, session, user_name, kind, ts from f_activity",
    "stream_activation_wait": """
select namespace, session, ts, case when now is not null then 0
    when next_ts <= ts + to_seconds(60) then date_diff('second', ts, next_ts) end as wait_seconds,
  case when now is not null then now when next_ts <= ts + to_seconds(60) then next_result
    else 'timeout' end as outcome
from (select q.namespace, q.session, q.ts, arg_max(coalesce(c.result, ''), (c.ts, c.seq)) filter (c.ts <= q.ts) as latest, nullif(latest, '') as now,
    min(c.ts) filter (c.ts > q.ts and c.state <> 'Pending') as next_ts,
    arg_min(c.result, (c.ts, c.seq)) filter (c.ts > q.ts and c.state <> 'Pending') as next_result
  from f_asked q left join f_state_changes c on c.namespace = q.namespace and c.session = q.session group by 1, 2, 3)
where ts + to_seconds(60) < (select max(ts) from f_asked) - to_minutes(10)""",
    "stream_utilisation": """
select namespace, pool, resource, tick, count(*) as measured_pods,
  cast(sum((cast(usage as hugeint) * 100000000) // request) // count(*) as bigint) as mean_micro_percent
from (select i.namespace, i.pool, i.pos, 'cpu' as resource, date_trunc('day', l_shipdate)::timestamp as tick,
    cast(ceil(sum(cast(round(l_extendedprice * 100) as decimal(18,0)) + case when l_orderkey % 5 = 0 then 0.25 else 0 end)) as bigint) as usage,
    sum(case when pos % 13 = 0 then 0 else 10000000 + 200000 * (pos % 7) end) as request
  from lineitem join f_instances i on i.pos = l_suppkey and i.state = 'Running' and l_linenumber between 1 and 6
  group by all having request <> 0 and count(*) filter (l_orderkey % 31 = 0) = 0)
where tick + to_days(1) <= (select max(l_shipdate) from lineitem) - to_days(1)
group by 1, 2, 3, 4""",
    "stream_live_load": """
select namespace, concat('pool-', nk) as pool, cast(sum(case when seq = 1 and state = 'Active' then 1
    when seq = 2 and outcome = 'Active' and state <> 'Active' then -1 else 0 end) as bigint) as live
from f_state_changes group by 1, 2 having bool_or(outcome = 'Active')""",
    "stream_session_transitions": f"""
, base as (
  select s.*, p.idle_minutes, p.pool is not null as pool_known, i.instance is not null as seated,
    case when asked.session is not null then {AS_OF} + to_minutes(5) end as ask_at,
    case when i.pos % 20 = 0 then {AS_OF} + to_minutes(7) end as lost_at,
    case when s.pool = 'pool-7' and p.pool is not null then {AS_OF} + to_minutes(8) end as gone_at
  from f_sessions s left join f_pools p on p.namespace = s.namespace and p.pool = s.pool
  left join (select * from f_instances where state = 'Running') i
    on i.namespace = s.namespace and i.pool = s.pool and i.instance = s.assigned_instance
  left join (select namespace, session, user_name from f_sessions where k % 3 <> 0 and k % 7 <> 0) asked
    on asked.namespace = s.namespace and asked.session = s.session
), outlook as (
  select c.session, c.namespace, c.verdict, d.instance, coalesce(d.endpoint, '') as endpoint, i.pos
  from f_check c left join f_candidates d on d.namespace = c.namespace and d.pool = c.pool left join f_instances i on i.instance = d.instance
), started as (
  select b.* exclude (state, assigned_instance, last_activity_at, lost_at), b.state as was, assigned_instance as old_instance, '' as old_endpoint,
    b.last_activity_at as old_last,
    case when b.state = 'Terminating' then 'Terminated'
      when b.state in ('Active', 'Idle') then case when not pool_known then 'Terminated' when not seated then 'Pending'
        when b.last_activity_at + to_minutes(idle_minutes) < {AS_OF} then 'Terminating'
        when b.state = 'Active' and b.last_activity_at + to_minutes(10) < {AS_OF} then 'Idle' else b.state end
      when b.state in ('Pending', '') then case when not pool_known or o.verdict <> 'ok' then 'Failed' when o.instance is not null then 'Active' else b.state end
      else b.state end as state,
    case when b.state = 'Terminating' then 'closing'
      when b.state in ('Active', 'Idle') then case when not pool_known then 'pool_deleted' when not seated then 'instance_lost'
        when b.last_activity_at + to_minutes(idle_minutes) < {AS_OF} then 'idle_timeout'
        when b.state = 'Active' and b.last_activity_at + to_minutes(10) < {AS_OF} then 'idle_mark' end
      when b.state in ('Pending', '') then case when not pool_known then 'pool_missing' when o.verdict <> 'ok' then o.verdict when o.instance is not null then 'placed' end
      end as reason,
    case when reason = 'placed' then o.instance when reason = 'instance_lost' then '' else b.assigned_instance end as inst,
    case when reason = 'placed' then o.endpoint else '' end as ep,
    case when reason = 'placed' then {AS_OF} else b.last_activity_at end as last,
    case when reason = 'placed' then case when o.pos % 20 = 0 then {AS_OF} + to_minutes(7) end else b.lost_at end as lost_at
  from base b left join outlook o on o.session = b.session and o.namespace = b.namespace
  where b.state in ('Active', 'Idle', 'Pending', '', 'Terminating')
), live as (
  select *, state in ('Active', 'Idle') as held, last + to_minutes(10) as idle_at, last + to_minutes(idle_minutes) as end_at,
    coalesce(least(ask_at, lost_at, gone_at), timestamp '9999-01-01') as held_until
  from started where state in ('Active', 'Idle', 'Pending', '')
), held as (
  select *, state = 'Active' and idle_at < end_at and idle_at < held_until as idles,
    coalesce(end_at < held_until, false) as times_out
  from live where held
), waits as (
  select namespace, pool, session, inst, ep, last, ask_at, gone_at, {AS_OF} as since from live where not held
  union all select namespace, pool, session, '', '', last, ask_at, gone_at, lost_at from held
    where not times_out and lost_at = held_until and coalesce(ask_at > lost_at, true)
)
select namespace, pool, session, changed_at, state, reason, inst as assigned_instance, ep as endpoint, last as last_activity_at from (
  select namespace, pool, session, {AS_OF} as changed_at, state, reason, inst, ep, last from started where reason is not null
  union all select namespace, pool, session, {AS_OF}, 'Terminated', 'closing', inst, ep, last from started where state = 'Terminating'
  union all select namespace, pool, session, idle_at, 'Idle', 'idle_mark', inst, ep, last from held where idles
  union all select namespace, pool, session, end_at, unnest(['Terminating', 'Terminated']), unnest(['idle_timeout', 'closing']), inst, ep, last
    from held where times_out
  union all select namespace, pool, session, ask_at, unnest(['Terminating', 'Terminated']), unnest(['ended_by_owner', 'closing']), inst, ep, last
    from held where not times_out and ask_at = held_until
  union all select namespace, pool, session, lost_at, 'Pending', 'instance_lost', '', '', last
    from held where not times_out and lost_at = held_until and coalesce(ask_at > lost_at, true)
  union all select namespace, pool, session, gone_at, 'Terminated', 'pool_deleted', inst, ep, last
    from held where not times_out and gone_at = held_until
  union all select namespace, pool, session, ask_at, unnest(['Terminating', 'Terminated']), unnest(['ended_by_owner', 'closing']), inst, ep, last
    from waits where ask_at > since
  union all select namespace, pool, session, gone_at, 'Failed', 'pool_missing', inst, ep, last
    from waits where gone_at > since and ask_at is null
)""",
    "stream_session_states": """
select namespace, pool, session, changed_at, state, reason from (
  select namespace, pool, session, ts as changed_at, 'Active' as state,
    case when prev is null or ts - prev > to_minutes(gap) then 'opened' else 'touched' end as reason
  from f_touches where prev is null or ts - prev > to_minutes(10)
  union all
  select namespace, pool, session, ts + to_minutes(10), 'Idle', 'idle_mark' from f_touches
  where coalesce(nxt, (select mark from f_mark)) - ts > to_minutes(10) and gap > 10
  union all
  select namespace, pool, session, ts + to_minutes(gap), 'Terminating', 'idle_timeout' from f_touches
  where coalesce(nxt, (select mark from f_mark)) - ts > to_minutes(gap))""",
    "stream_cooldowns": """
select namespace, pool, event_id as action_id, ts, date_diff('microsecond', prev, ts) // 1000000 as seconds_since_previous,
  coalesce(ts - prev <= to_seconds(300), false) as inside_cooldown
from (select *, lag(ts) over (partition by namespace, pool order by ts, event_id) as prev
  from f_activity where kind in ('error', 'view'))""",
}

ORACLES = {name: with_views(sql) for name, sql in _SQL.items()}
