"""Predicates and classes over instance and session states."""

from pyspark.sql import Column, functions as F

from poolwatch import values as V


def clean(col: str) -> Column:
    """A missing state and an empty one both mean "new"."""
    return F.coalesce(F.col(col), F.lit(""))


def instance_state(application_state: str = "spark_state", role: str = "role") -> Column:
    """State of an instance; unknown application states count as starting."""
    app = F.col(application_state)
    return (
        F.when((app == "RUNNING") & F.col(role).eqNullSafe("draining"), V.DRAINING)
        .when(app == "RUNNING", V.RUNNING)
        .when(app.isin(*V.FAILED_APPLICATION_STATES), V.FAILED)
        .otherwise(V.PENDING)
    )


def holds_instance(state: str = "state") -> Column:
    return F.col(state).isin("Active", "Idle")


def is_new(state: str = "state") -> Column:
    return clean(state).isin("Pending", "")


def is_waiting(state: str = "state", instance: str = "assigned_instance") -> Column:
    """New and not yet placed."""
    return is_new(state) & (clean(instance) == "")


def counts_toward_quota(state: str = "state") -> Column:
    """A session without any state yet does not count."""
    return clean(state).isin("Active", "Idle", "Pending")


def is_reusable(state: str = "state", known: bool = False) -> Column:
    """May serve another request; a session the proxy made itself (`known`) may be new."""
    return clean(state).isin(*["Active", "Idle", "Pending", "Assigning"] + [""] * known)


def is_terminal(state: str = "state") -> Column:
    return F.col(state).isin("Terminated", "Failed")


def start_failed(state: str = "state") -> Column:
    return F.col(state).isin("Failed", "Terminated", "Terminating")


def counted_as_running(state: str = "state") -> Column:
    return F.col(state).isin(V.RUNNING, V.DRAINING)


def is_ready(state: str = "state") -> Column:
    return F.col(state) == V.RUNNING


def is_starting(state: str = "state") -> Column:
    return clean(state).isin("Pending", "Submitted", "")


def pool_health(ready: str = "ready_replicas", current: str = "current_replicas") -> Column:
    """`not-ready` wins over `zero`."""
    return (
        F.when(F.col(ready) < F.col(current), "not-ready")
        .when(F.col(ready) == 0, "zero")
        .otherwise("ready")
    )
