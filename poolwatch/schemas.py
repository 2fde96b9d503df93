"""Declared schemas of the exported records (see SURVEY, data model)."""

CONDITION = (
    "struct<type:string,status:string,reason:string,message:string,"
    "observedGeneration:bigint,lastTransitionTime:timestamp>"
)

POOL_SPEC = """struct<
  type:string, host:string,
  replicas:struct<min:int,max:int>,
  scaling:struct<
    metrics:struct<type:string,targetPerInstance:int>,
    scaleUpThreshold:string, scaleDownThreshold:string,
    cooldownSeconds:int, drainBeforeScaleDown:boolean>,
  sparkApplicationTemplate:struct<spec:string>,
  sessionPolicy:struct<
    maxSessionsPerUser:int, maxTotalSessions:int, idleTimeoutMinutes:int,
    defaultSessionConf:map<string,string>,
    quotas:array<struct<
      match:struct<users:array<string>,groups:array<string>>,
      maxSessionsPerUser:int, sessionConf:map<string,string>>>>>"""

POOL_RECORD = f"""
namespace string, name string, creationTimestamp timestamp, spec {POOL_SPEC},
status struct<
  instances:array<struct<name:string,state:string,activeSessions:int,
    endpoint:string,sparkApplicationState:string>>,
  totalActiveSessions:int, currentReplicas:int, readyReplicas:int,
  lastScaleTime:timestamp, conditions:array<{CONDITION}>>
"""

POOL_LIST = f"namespace string, pools array<struct<name:string,spec:{POOL_SPEC}>>"

SESSION_RECORD = f"""
namespace string, name string, labels map<string,string>, creationTimestamp timestamp,
spec struct<user:string, pool:string, sparkConf:map<string,string>>,
status struct<state:string, assignedInstance:string, endpoint:string, sessionId:string,
  createdAt:timestamp, lastActivityAt:timestamp, conditions:array<{CONDITION}>>,
snapshot_date date
"""

POD_METRICS_RECORD = """
namespace string, pod string, timestamp timestamp,
containers array<struct<name:string, usage:struct<cpu:string,memory:string>>>
"""

POD_RECORD = """
namespace string, pod string,
containers array<struct<name:string, requests:struct<cpu:string,memory:string>>>
"""

SERVICE_RECORD = "namespace string, name string, selector map<string,string>, labels map<string,string>, pos bigint"

ACTIVITY_RECORD = "namespace string, pool string, session string, user_name string, kind string, ts timestamp"

REQUEST_RECORD = """
request_id string, namespace string, ts timestamp, door string,
forwarded_host string, authority string, user_name string,
authorization string, header_user string, has_password boolean, user_id string
"""

ROUTE_RECORD = """
namespace string, name string, labels map<string,string>, annotations map<string,string>,
class string, host string, path string, path_type string, service string, port int
"""
