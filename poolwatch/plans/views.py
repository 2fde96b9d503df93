"""Listings, record checks, template profiles and log views."""

from pyspark.sql import Column, DataFrame, functions as F

from poolwatch import values as V
from poolwatch.functions import identity, maps, settings, states, text, timing
from poolwatch.plans.quota import USER


def session_listing(sessions: DataFrame, prefix: str | None = None) -> DataFrame:
    """Sessions as their owners see them; empty fields are null, so the JSON sink drops them. With the
    `prefix` of the labels also the user they name (`labelUser`), who may be another."""
    conf = F.col("spark_conf")
    labelled = [F.try_element_at("labels", F.lit(f"{prefix}/user")).alias("labelUser")] if prefix else []
    return sessions.select(
        F.col("session").alias("name"),
        F.col("user_name").alias("user"),
        "pool",
        states.clean("state").alias("state"),
        F.nullif(F.col("assigned_instance"), F.lit("")).alias("assignedInstance"),
        F.when(F.size(conf) > 0, conf).alias("sparkConf"),
        F.col("created_at").alias("createdAt"),
        F.col("last_activity_at").alias("lastActivityAt"), *labelled,
    )


def own_sessions(sessions: DataFrame, me: str, prefix: str | None = None) -> DataFrame:
    """Sessions of one user: by their owner, or with the `prefix` of the labels by the user these name."""
    owner = F.try_element_at("labels", F.lit(f"{prefix}/user")) if prefix else F.col("user_name")
    return session_listing(sessions.filter(owner == me), prefix)


def pool_listing(pools: DataFrame) -> DataFrame:
    """Pools as everybody sees them; quota overrides stay hidden."""
    conf = F.col("default_session_conf")
    return pools.select(
        F.col("pool").alias("name"),
        "type",
        "host",
        F.col("min_replicas").alias("minReplicas"),
        F.col("max_replicas").alias("maxReplicas"),
        F.col("current_replicas").alias("currentReplicas"),
        F.col("ready_replicas").alias("readyReplicas"),
        F.col("total_active_sessions").alias("totalActiveSessions"),
        F.struct(
            F.col("max_sessions_per_user").alias("maxSessionsPerUser"),
            F.col("max_total_sessions").alias("maxTotalSessions"),
            F.col("idle_timeout_minutes").alias("idleTimeoutMinutes"),
            F.when(F.size(conf) > 0, conf).alias("defaultSessionConf"),
        ).alias("sessionPolicy"),
    )


def pool_health(pools: DataFrame) -> DataFrame:
    """Classes of the overview page."""
    return pools.select(
        *V.POOL, "type",
        F.concat_ws("", "current_replicas", F.lit(" / "), "min_replicas", F.lit(".."), "max_replicas").alias("replicas"),
        states.pool_health().alias("health"),
        (F.col("total_active_sessions") == 0).alias("no_sessions"),
    )


def pool_columns(pools: DataFrame, as_of: Column, created: str = "created_at") -> DataFrame:
    """Short table of pools."""
    return pools.select(
        *V.POOL, "type", "host",
        F.col("current_replicas").alias("replicas"),
        F.col("ready_replicas").alias("ready"),
        F.col("total_active_sessions").alias("sessions"),
        timing.whole_seconds(F.col(created), as_of).alias("age_seconds"),
    )


def session_columns(sessions: DataFrame, as_of: Column) -> DataFrame:
    """Short table of sessions."""
    return sessions.select(
        "namespace", "session", F.col("user_name").alias("user"), "pool", "state",
        F.col("assigned_instance").alias("instance"),
        timing.whole_seconds(F.col("last_activity_at"), as_of).alias("idle_seconds"),
        timing.whole_seconds(F.col("created_at"), as_of).alias("age_seconds"),
    )


def _broken_rules(records: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """Rows per broken rule and the first record that breaks it: one aggregate without groups
    over the records, nothing to sort and one row per task to shuffle."""
    checks = [(rule, F.coalesce(bad, F.lit(False))) for rule, bad in rules.items()]
    per_rule = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.count_if(bad).alias("bad_rows"),
            F.min(F.when(bad, key)).alias("first_key"),
        )
        for rule, bad in checks
    ]
    return records.agg(F.array(*per_rule).alias("r")).select(F.inline("r")).filter("bad_rows > 0")


def _not_in(col: str, allowed) -> Column:
    return F.col(col).isNotNull() & ~F.col(col).isin(*allowed)


def _bad_conditions(conditions: str) -> dict[str, Column]:
    any_of = lambda bad: F.exists(F.col(conditions), bad)
    wrong = lambda proper: ~F.coalesce(proper, F.lit(False))  # noqa: E731  also what is missing
    fits = lambda c, field, most: F.length(c[field]) <= most
    return {
        "condition_reason": any_of(
            lambda c: wrong(c["reason"].rlike(V.CONDITION_REASON) & fits(c, "reason", V.CONDITION_REASON_CHARS))
        ),
        "condition_type": any_of(
            lambda c: wrong(c["type"].rlike(V.CONDITION_TYPE) & fits(c, "type", V.CONDITION_TYPE_CHARS))
        ),
        "condition_status": any_of(lambda c: wrong(c["status"].isin(*V.CONDITION_STATES))),
        "condition_message": any_of(lambda c: wrong(fits(c, "message", V.CONDITION_MESSAGE_CHARS))),
        "condition_time_missing": any_of(lambda c: c["lastTransitionTime"].isNull()),
        "condition_generation_below_0": any_of(lambda c: c["observedGeneration"] < 0),
    }


def validate_pools(records: DataFrame) -> DataFrame:
    """Checks of the declared pool schema, on records as exported (before defaults)."""
    required = ["type", "host", "replicas", "scaling", "scaling.metrics", "sessionPolicy", "sparkApplicationTemplate.spec"]
    rules = {f"{f}_missing": F.col(f"spec.{f}").isNull() for f in required}
    rules |= {
        "type_unknown": _not_in("spec.type", V.POOL_TYPES),
        "host_empty": F.col("spec.host") == "",
        "min_replicas_below_0": F.col("spec.replicas.min") < 0,
        "max_replicas_below_1": F.col("spec.replicas.max") < 1,
        "metric_type_unknown": _not_in("spec.scaling.metrics.type", V.METRIC_TYPES),
        "instance_state_unknown": F.exists(
            F.col("status.instances"), lambda i: ~i["state"].isin(*V.INSTANCE_STATES)
        ),
        "instance_field_missing": F.exists(
            F.col("status.instances"), lambda i: i["name"].isNull() | i["state"].isNull()
        ),
    }
    return _broken_rules(records, F.concat_ws("/", "namespace", "name"), rules | _bad_conditions("status.conditions"))


def validate_sessions(sessions: DataFrame, prefix: str) -> DataFrame:
    """Checks of the declared session schema, and labels that contradict the record. A session
    without a status is a new one; inside a status the state is required."""
    seen = F.try_element_at(F.col("labels"), F.lit(f"{prefix}/user"))
    rules = {
        "user_missing": F.col("user_name").isNull(),
        "pool_missing": F.col("pool").isNull(),
        "state_empty": F.col("has_status") & (states.clean("state") == ""),
        "state_unknown": (states.clean("state") != "") & _not_in("state", V.SESSION_STATES),
        "user_label_differs": ~seen.eqNullSafe(F.col("user_name")),
    }
    rules |= _bad_conditions("conditions")
    return _broken_rules(sessions, F.concat_ws("/", "namespace", "session"), rules)


def template_profile(pools: DataFrame) -> DataFrame:
    """Sizes, image and version in the raw server template of each pool, one row per setting."""
    doc = F.try_parse_json(F.col("template"))
    read = lambda path: F.try_variant_get(doc, path, "string")
    paths = {
        "image": "$.image",
        "version": "$.sparkVersion",
        "driver.cores": "$.driver.cores",
        "driver.memory": "$.driver.memory",
        "executor.cores": "$.executor.cores",
        "executor.instances": "$.executor.instances",
        "executor.memory": "$.executor.memory",
    }
    sizes = F.create_map(*[x for k, p in paths.items() for x in (F.lit(k), read(p))])
    conf = maps.or_empty(F.from_json(F.get_json_object("template", "$.sparkConf"), "map<string,string>"))
    return pools.select(*V.POOL, F.explode(maps.overlay(sizes, conf)).alias("setting", "value")).filter(
        "value is not null"
    )


def template_differences(profile: DataFrame) -> DataFrame:
    """Settings on which pools disagree, with the pools behind each value."""
    per_value = profile.groupBy("setting", "value").agg(F.count("*").alias("pools"), F.min("pool").alias("first_pool"))
    disputed = per_value.groupBy("setting").agg(F.count("*").alias("values_seen")).filter("values_seen > 1")
    return per_value.join(disputed, "setting")


def effective_conf(sessions: DataFrame, pools: DataFrame, quotas: DataFrame) -> DataFrame:
    """Configuration a session would run with, one row per key with the layer it comes from:
    pool default, then the last override row of the user, then the session itself."""
    defaults = pools.select(*V.POOL, "default_session_conf")
    overrides = (
        quotas.filter("session_conf is not null")
        .groupBy(*V.POOL, F.col("match_user").alias("user_name"))
        .agg(F.max_by("session_conf", "pos").alias("session_conf"))
    )
    rows = sessions.select(*USER, "session", "spark_conf").join(defaults, V.POOL, "left")
    rows = rows.join(overrides, USER, "left")
    layers = [F.col(c) for c in ("default_session_conf", "session_conf", "spark_conf")]
    origin = maps.origin(pool=layers[0], quota=layers[1], session=layers[2])
    merged = rows.select("namespace", "session", maps.overlay(*layers).alias("conf"), origin.alias("origin"))
    return merged.select("namespace", "session", "origin", F.explode("conf").alias("conf_key", "conf_value")).select(
        "namespace", "session", "conf_key", "conf_value", F.col("origin")[F.col("conf_key")].alias("origin")
    )


def access_identity(log: DataFrame) -> DataFrame:
    """User behind each logged request and where the name comes from: the authorization header;
    at the connect door else the explicit headers, else the id inside the message. No password
    leaves the scan."""
    connect = F.col("door") == "connect"
    found = log.select(
        "request_id",
        identity.header_user().alias("by_header"),
        F.when(connect, identity.explicit_user()).alias("by_name"),
        F.when(connect, identity.message_user()).alias("by_message"),
    )
    return found.select(
        "request_id",
        F.coalesce("by_header", "by_name", "by_message").alias("user_name"),
        F.when(F.col("by_header").isNotNull(), "authorization")
        .when(F.col("by_name").isNotNull(), "explicit")
        .when(F.col("by_message").isNotNull(), "message")
        .otherwise("none").alias("source"),
    )


def token_claims(tokens: DataFrame, user_claim: str = V.USER_CLAIM, groups_claim: str = V.GROUPS_CLAIM) -> DataFrame:
    """Unverified claims of each token; groups only where there is a user. Each part of a token
    is parsed once."""
    rest = [c for c in tokens.columns if c != "token"]
    parsed = tokens.select(
        *rest, identity.token_part("token", 0).alias("head"), identity.token_part("token", 1).alias("claims"),
        identity.token_parts("token").alias("parts"),
    )
    known = parsed.select(
        *rest, "claims",
        F.when(identity.token_ok("parts", "head"), identity.claimed_user("claims", user_claim)).alias("claimed_user"),
    )
    return known.select(
        *rest, "claimed_user",
        F.when(F.col("claimed_user").isNotNull(), identity.claimed_groups("claims", groups_claim)).alias("claimed_groups"),
    )


def error_log_trim(log: DataFrame, limit: int = V.MESSAGE_BYTES) -> DataFrame:
    """Whole messages bounded in bytes; code and details stay as they are."""
    message = F.col("message")
    return log.withColumns(
        {
            "message_bytes": text.bounded_bytes(message, limit),
            "truncated": text.is_long(message, limit),
            "full_bytes": F.octet_length(message),
        }
    ).withColumn("message", text.bounded_message(message, limit))


def effective_settings(pools: DataFrame) -> DataFrame:
    return settings.effective_settings(pools)
