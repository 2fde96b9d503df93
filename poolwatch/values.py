"""Names, constants and defaults that results must agree with."""

# States of an instance, of a session and of an application.
RUNNING, DRAINING, PENDING, FAILED = "Running", "Draining", "Pending", "Failed"
INSTANCE_STATES = ("Pending", "Running", "Draining", "Failed", "Terminated")
SESSION_STATES = ("Pending", "Active", "Idle", "Terminating", "Terminated", "Failed")
FAILED_APPLICATION_STATES = ("FAILED", "FAILING", "COMPLETED")
CONDITION_STATES = ("True", "False", "Unknown")

# Kinds of pool and of scaling metric.
POOL_TYPES = ("connect", "thrift")
METRIC_TYPES = ("activeSessions", "cpu", "memory")

# Ports of the servers (endpoint) and of the proxy behind a route.
SERVER_PORT = {"thrift": "10001", "connect": "8424"}
DRIVER_POD_SUFFIX = "-driver"
DRIVER_SERVICE_SUFFIX = "-driver-svc"

# What a route of each pool type looks like.
ROUTE = {
    "connect": {
        "suffix": "-connect",
        "port": 15002,
        "annotations": {
            "nginx.ingress.kubernetes.io/backend-protocol": "GRPC",
            "nginx.ingress.kubernetes.io/proxy-buffer-size": "32k",
            "nginx.ingress.kubernetes.io/proxy-buffers-number": "8",
            "nginx.ingress.kubernetes.io/proxy-read-timeout": "3600",
            "nginx.ingress.kubernetes.io/proxy-send-timeout": "3600",
            "yandex.cloud/load-balancer-type": "internal",
        },
    },
    "thrift": {
        "suffix": "-thrift",
        "port": 10009,
        "annotations": {
            "nginx.ingress.kubernetes.io/backend-protocol": "HTTP",
            "nginx.ingress.kubernetes.io/proxy-body-size": "0",
            "nginx.ingress.kubernetes.io/proxy-read-timeout": "3600",
            "nginx.ingress.kubernetes.io/proxy-send-timeout": "3600",
            "yandex.cloud/load-balancer-type": "internal",
        },
    },
}
ROUTE_CLASS, ROUTE_PATH, ROUTE_PATH_TYPE = "nginx", "/", "Prefix"

# Defaults of a record whose field is missing.
DEFAULT_MIN_REPLICAS, DEFAULT_MAX_REPLICAS = 0, 10
DEFAULT_METRIC_TYPE = "activeSessions"
DEFAULT_TARGET = 20
DEFAULT_SCALE_UP, DEFAULT_SCALE_DOWN = "0.8", "0.3"
DEFAULT_COOLDOWN_SECONDS = 300
DEFAULT_DRAIN = True
DEFAULT_SESSIONS_PER_USER = 5
DEFAULT_TOTAL_SESSIONS = 200
DEFAULT_IDLE_MINUTES = 720

# What stands in for a field that is present but zero or unusable.
ZERO_TARGET_SESSIONS = 20
ZERO_TARGET_PERCENT = 80
ZERO_SCALE_UP = 0.8
ZERO_COOLDOWN_SECONDS = 300
ZERO_IDLE_MINUTES = 720

# Clocks.
IDLE_MARK_MINUTES = 10
START_BUDGET_SECONDS = 60
TOUCH_MINUTES = 2
TICK_SECONDS = 30

# Age at which a measurement no longer counts: ten ticks.
MEASURED_MINUTES = 5

# Identity and error text.
AUTH_SCHEMES = ("basic", "bearer")
USER_CLAIM, GROUPS_CLAIM = "sub", "groups"
TOKEN_ALGORITHMS = (
    "HS256", "HS384", "HS512", "RS256", "RS384", "RS512", "ES256", "ES384", "ES512",
    "PS256", "PS384", "PS512", "EdDSA", "none",
)
MESSAGE_BYTES = 1024
MESSAGE_SUFFIX = "... [truncated by proxy]"

# Patterns of a status condition.
CONDITION_REASON_CHARS, CONDITION_TYPE_CHARS, CONDITION_MESSAGE_CHARS = 1024, 316, 32768
CONDITION_REASON = r"^[A-Za-z]([A-Za-z0-9_,:]*[A-Za-z0-9_])?$"
CONDITION_TYPE = (
    r"^([a-z0-9]([-a-z0-9]*[a-z0-9])?(\.[a-z0-9]([-a-z0-9]*[a-z0-9])?)*/)?"
    r"(([A-Za-z0-9][-A-Za-z0-9_.]*)?[A-Za-z0-9])$"
)

# Key of a pool in every table.
POOL = ["namespace", "pool"]
