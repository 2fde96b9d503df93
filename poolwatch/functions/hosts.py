"""Host names, endpoints and names built from them."""

from pyspark.sql import Column, functions as F

from poolwatch import values as V


def safe_user(col: str = "user_name") -> Column:
    """User name as it may appear inside an object name."""
    return F.translate(F.lower(F.col(col)), "_.", "--")


def request_host(forwarded: str = "forwarded_host", host: str = "authority", door: str = "door") -> Column:
    """Forwarded host if there is one, else the host; the part after the last colon goes
    unless that colon comes first. At the connect door an empty forwarded host is an answer;
    at the other it is none."""
    given = F.when(F.col(door) == "connect", F.col(forwarded)).otherwise(F.nullif(F.col(forwarded), F.lit("")))
    raw = F.coalesce(given, F.col(host), F.lit(""))
    return F.regexp_replace(raw, r"(?s)^(.+):[^:]*$", "$1")


def service_host(service: str = "service", namespace: str = "namespace") -> Column:
    return F.concat(F.col(service), F.lit("."), F.col(namespace), F.lit(".svc"))


def server_port(pool_type: str = "type") -> Column:
    """Port of a server; empty for an unknown pool type."""
    ports = F.create_map(*[F.lit(x) for pair in V.SERVER_PORT.items() for x in pair])
    return F.coalesce(F.try_element_at(ports, F.col(pool_type)), F.lit(""))


def endpoint(host: str = "endpoint", pool_type: str = "type") -> Column:
    return F.concat(F.coalesce(F.col(host), F.lit("")), F.lit(":"), server_port(pool_type))


def driver_pod(instance: str = "instance") -> Column:
    return F.concat(F.col(instance), F.lit(V.DRIVER_POD_SUFFIX))
