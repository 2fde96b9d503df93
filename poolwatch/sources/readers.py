"""Readers of exported records. Schemas are declared, never inferred; missing fields get the
default they would get on admission, zero values are left for the settings functions."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from poolwatch import schemas, values as V
from poolwatch.functions import quantity
from poolwatch.functions.states import instance_state


def _load(spark: SparkSession, path: str, fmt: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def split_records(lines: DataFrame, schema: str, key: tuple[str, ...] = ("namespace", "name"), column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, broken) of lines that should each hold a JSON record.

    Broken is a line that is no JSON, or holds a value of another kind than the schema says, or
    lacks a field of the key; it is kept as it is, with the other columns of `lines` (such as its file)
    and the reason. A good record is read as ever.
    """
    rest = [c for c in lines.columns if c != column]
    parsed = F.from_json(column, f"{schema.strip()}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = lines.withColumn("r", parsed)
    no_key = F.lit(False)
    for c in key:
        no_key = no_key | F.col(f"r.{c}").isNull() | (F.col(f"r.{c}") == "")
    why = F.when(F.col("r").isNull() | F.col("r._broken").isNotNull(), "unreadable").when(no_key, "key_missing")
    rows = rows.withColumn("reason", why)
    good = rows.filter("reason is null").select(*rest, "r.*").drop("_broken")
    return good, rows.filter("reason is not null").select(*rest, F.col(column).alias("line"), "reason")


def read_records(spark: SparkSession, path: str, schema: str, key: tuple[str, ...] = ("namespace", "name")) -> tuple[DataFrame, DataFrame]:
    """(good, broken) records of exported files of JSON lines; broken ones with the file they stand in."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    good, broken = split_records(lines.filter("trim(value) <> ''"), schema, key)
    return good.drop("file"), broken


def pool_records(documents: DataFrame, column: str = "doc") -> DataFrame:
    """Pool records out of a column of JSON documents."""
    rest = [c for c in documents.columns if c != column]
    parsed = F.from_json(F.col(column), schemas.POOL_RECORD)
    return documents.select(*rest, parsed.alias("r")).select(*rest, "r.*")


def explode_pool_list(documents: DataFrame, column: str = "doc") -> DataFrame:
    """Pool records out of documents that each hold a list of {name, spec} and a namespace."""
    parsed = F.from_json(F.col(column), schemas.POOL_LIST)
    rows = documents.select(parsed.alias("r")).select("r.namespace", F.posexplode("r.pools").alias("pos", "p"))
    return rows.select("namespace", F.col("p.name").alias("name"), "pos", "p.spec")


def flatten_pools(records: DataFrame) -> DataFrame:
    """One row per pool with admission defaults filled in."""
    spec, status = (lambda f: F.col(f"spec.{f}")), (lambda f: F.col(f"status.{f}"))
    or_default = lambda col, value: F.coalesce(col, F.lit(value))
    keep = [c for c in ("pos",) if c in records.columns]
    has_status = "status" in records.columns
    return records.select(
        "namespace",
        F.col("name").alias("pool"),
        *keep,
        spec("type").alias("type"),
        spec("host").alias("host"),
        or_default(spec("replicas.min"), V.DEFAULT_MIN_REPLICAS).alias("min_replicas"),
        or_default(spec("replicas.max"), V.DEFAULT_MAX_REPLICAS).alias("max_replicas"),
        or_default(spec("scaling.metrics.type"), V.DEFAULT_METRIC_TYPE).alias("metric_type"),
        or_default(spec("scaling.metrics.targetPerInstance"), V.DEFAULT_TARGET).alias("target_per_instance"),
        or_default(spec("scaling.scaleUpThreshold"), V.DEFAULT_SCALE_UP).alias("scale_up_threshold"),
        or_default(spec("scaling.scaleDownThreshold"), V.DEFAULT_SCALE_DOWN).alias("scale_down_threshold"),
        or_default(spec("scaling.cooldownSeconds"), V.DEFAULT_COOLDOWN_SECONDS).alias("cooldown_seconds"),
        or_default(spec("scaling.drainBeforeScaleDown"), V.DEFAULT_DRAIN).alias("drain_before_scale_down"),
        or_default(spec("sessionPolicy.maxSessionsPerUser"), V.DEFAULT_SESSIONS_PER_USER)
        .alias("max_sessions_per_user"),
        or_default(spec("sessionPolicy.maxTotalSessions"), V.DEFAULT_TOTAL_SESSIONS).alias("max_total_sessions"),
        or_default(spec("sessionPolicy.idleTimeoutMinutes"), V.DEFAULT_IDLE_MINUTES).alias("idle_timeout_minutes"),
        spec("sessionPolicy.defaultSessionConf").alias("default_session_conf"),
        spec("sparkApplicationTemplate.spec").alias("template"),
        *(
            [
                or_default(status("currentReplicas"), 0).alias("current_replicas"),
                or_default(status("readyReplicas"), 0).alias("ready_replicas"),
                or_default(status("totalActiveSessions"), 0).alias("total_active_sessions"),
                status("lastScaleTime").alias("last_scale_time"),
            ]
            if has_status
            else []
        ),
    )


def explode_quotas(records: DataFrame, kind: str = "users") -> DataFrame:
    """Override rows of each pool in list order, one per named user (or group)."""
    quotas = records.select(
        "namespace",
        F.col("name").alias("pool"),
        F.posexplode("spec.sessionPolicy.quotas").alias("pos", "q"),
    )
    name = "match_user" if kind == "users" else "match_group"
    return quotas.select(
        "namespace", "pool", "pos",
        F.explode(F.array_distinct(f"q.match.{kind}")).alias(name),
        F.coalesce("q.maxSessionsPerUser", F.lit(0)).alias("max_sessions_per_user"),
        F.col("q.sessionConf").alias("session_conf"),
    )


def explode_instances(records: DataFrame) -> DataFrame:
    """Instances listed in the status of each pool, in list order."""
    return records.select(
        "namespace",
        F.col("name").alias("pool"),
        F.posexplode("status.instances").alias("pos", "i"),
    ).select(
        "namespace", "pool", F.col("i.name").alias("instance"), "pos",
        F.coalesce("i.state", F.lit("")).alias("state"),
        F.coalesce("i.activeSessions", F.lit(0)).alias("active_sessions"),
        F.coalesce("i.endpoint", F.lit("")).alias("endpoint"),
    )


def read_pools(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return flatten_pools(_load(spark, path, fmt, schemas.POOL_RECORD))


def read_quotas(spark: SparkSession, path: str, fmt: str = "json", kind: str = "users") -> DataFrame:
    return explode_quotas(_load(spark, path, fmt, schemas.POOL_RECORD), kind)


def flatten_sessions(records: DataFrame) -> DataFrame:
    """One row per session; a missing state or instance reads as empty."""
    return records.select(
        "namespace",
        F.col("name").alias("session"),
        F.col("spec.user").alias("user_name"),
        F.col("spec.pool").alias("pool"),
        F.coalesce("status.state", F.lit("")).alias("state"),
        F.coalesce("status.assignedInstance", F.lit("")).alias("assigned_instance"),
        F.coalesce("status.endpoint", F.lit("")).alias("endpoint"),
        F.col("status.createdAt").alias("created_at"),
        F.col("status.lastActivityAt").alias("last_activity_at"),
        "labels",
        F.col("spec.sparkConf").alias("spark_conf"),
        F.col("status").isNotNull().alias("has_status"),
        F.col("status.conditions").alias("conditions"),
        "snapshot_date",
    )


def session_records(documents: DataFrame, column: str = "doc") -> DataFrame:
    """Session records out of a column of JSON documents."""
    return documents.select(F.from_json(F.col(column), schemas.SESSION_RECORD).alias("r")).select("r.*")


def read_sessions(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Session snapshots; filter on `snapshot_date` to read only the folders of those days."""
    return flatten_sessions(_load(spark, path, fmt, schemas.SESSION_RECORD))


def instances_from_applications(documents: DataFrame, prefix: str, column: str = "doc") -> DataFrame:
    """Instances out of application documents; only the paths in use are read."""
    read = lambda path: F.get_json_object(F.col(column), path)
    label = lambda name: read(f"$.metadata.labels['{prefix}/{name}']")
    keep = [c for c in ("pos",) if c in documents.columns]
    return documents.select(
        read("$.metadata.namespace").alias("namespace"),
        label("pool").alias("pool"),
        read("$.metadata.name").alias("instance"),
        *keep,
        F.coalesce(read("$.status.applicationState.state"), F.lit("")).alias("spark_state"),
        F.coalesce(label("instance-role"), F.lit("")).alias("role"),
        F.coalesce(read("$.status.sparkApplicationId"), F.lit("")).alias("app_id"),
    ).withColumn("state", instance_state())


def _quantities(records: DataFrame, field: str, extra: list[Column], out: str) -> DataFrame:
    rows = records.select("namespace", "pod", *extra, F.explode("containers").alias("c"))
    both = F.create_map(
        F.lit("cpu"), F.col(f"c.{field}.cpu"), F.lit("memory"), F.col(f"c.{field}.memory")
    )
    names = [c for c in rows.columns if c not in ("namespace", "pod", "c")]
    return (
        rows.select("namespace", "pod", F.col("c.name").alias("container"), *names, F.explode(both).alias("resource", "text"))
        # Nothing stated is nothing; text that cannot be read stays unknown.
        .withColumn(out, F.when(F.col("text").isNull(), F.lit(0).cast("decimal(38,6)")).otherwise(quantity.milli(F.col("text"))))
        .drop("text")
    )


def usage_rows(records: DataFrame) -> DataFrame:
    """Usage per container and resource, in milli-units; null where the amount cannot be read."""
    return _quantities(records, "usage", [F.col("timestamp").alias("tick")], "usage_milli")


def request_rows(records: DataFrame) -> DataFrame:
    """Requested amounts per container and resource, in milli-units; none reads as zero."""
    return _quantities(records, "requests", [], "request_milli")


def read_usage(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return usage_rows(_load(spark, path, fmt, schemas.POD_METRICS_RECORD))


def read_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return request_rows(_load(spark, path, fmt, schemas.POD_RECORD))


def read_services(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    rows = _load(spark, path, fmt, schemas.SERVICE_RECORD)
    return rows.select(
        "namespace", F.col("name").alias("service"), F.col("labels")["spark-app-selector"].alias("app_id"), "pos"
    )


def read_routes(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _load(spark, path, fmt, schemas.ROUTE_RECORD).withColumnRenamed("name", "route")


def activity_stream(spark: SparkSession, path: str, fmt: str = "json", **options) -> DataFrame:
    return spark.readStream.schema(schemas.ACTIVITY_RECORD).format(fmt).options(**options).load(path)


def requests_stream(spark: SparkSession, path: str, fmt: str = "json", **options) -> DataFrame:
    return spark.readStream.schema(schemas.REQUEST_RECORD).format(fmt).options(**options).load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: str, **options) -> DataFrame:
    """The same records as JSON values of a topic; needs the Kafka package on the cluster."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


def select_labels(rows: DataFrame, labels: dict[str, str], namespace: str | None = None) -> DataFrame:
    """Rows that carry all given labels. Labels used often belong in columns of their own:
    a filter on a map value cannot be pushed into the files."""
    if namespace is not None:
        rows = rows.filter(F.col("namespace") == namespace)
    for key, value in labels.items():
        rows = rows.filter(F.try_element_at("labels", F.lit(key)) == value)
    return rows


def with_label_columns(rows: DataFrame, prefix: str, **columns: str) -> DataFrame:
    """Promote labels to columns: `with_label_columns(df, prefix, label_user="user")`."""
    return rows.withColumns(
        {name: F.try_element_at("labels", F.lit(f"{prefix}/{label}")) for name, label in columns.items()}
    )


def lookup_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in a set of keys."""
    return rows.join(keys.select(*on).distinct(), on, "left_semi")
