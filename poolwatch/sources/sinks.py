"""Sinks. All of them write from the executors; nothing is collected."""

import atexit
import shutil
import tempfile
import uuid
from functools import cache
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from poolwatch.sources import files, readers


@cache
def _own_folder() -> str:
    """One folder of this machine for the whole process, gone when it ends."""
    path = tempfile.mkdtemp(prefix="poolwatch-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """A small table used more than once, written to the shared folder and read back, so that
    what it is made from is read once and a lost executor costs nothing upstream."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of `df` in the shared folder, without the plan that made them."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def pool_status(rollup: DataFrame, as_of: Column, instances: DataFrame | None = None) -> DataFrame:
    """Status row of each pool as the roll-up sees it, with its listed instances in list order.

    `instances` has the pool, instance, pos, state and active_sessions, and may have the endpoint. A pool
    has few enough of them for one row: they are one field of its record.
    """
    rows = rollup.select(
        "namespace", "pool",
        F.col("running").alias("current_replicas"),
        F.col("ready").alias("ready_replicas"),
        F.col("total").alias("total_active_sessions"),
        as_of.alias("as_of"),
    )
    if instances is None:
        return rows
    endpoint = F.col("endpoint") if "endpoint" in instances.columns else F.lit("")
    one = F.struct(F.col("pos").cast("bigint").alias("pos"), F.col("instance").alias("name"), "state", "active_sessions", endpoint.alias("endpoint"))
    listed = instances.groupBy("namespace", "pool").agg(F.sort_array(F.collect_list(one)).alias("instances"))
    plain = F.transform("instances", lambda i: i.dropFields("pos"))
    return rows.join(listed, ["namespace", "pool"], "left").withColumn("instances", F.coalesce(plain, F.array().cast(
        "array<struct<name:string,state:string,active_sessions:bigint,endpoint:string>>")))


STATUS_KEY = ["namespace", "pool", "as_of"]


def write_pool_status(status: DataFrame, path: str) -> None:
    """Write one tick; writing the same tick again replaces it and nothing else. `compact_pool_status` puts the
    ticks of a day into few files."""
    (
        status.withColumn("as_of_date", F.col("as_of").cast("date"))
        .withColumn("tick", F.date_format("as_of", "HHmmss"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("as_of_date", "tick")
        .parquet(f"{path}/ticks")
    )


def _ticks(spark: SparkSession, path: str) -> DataFrame | None:
    """One row per pool and tick, also where two writers wrote a tick at once."""
    if not files.names(spark, f"{path}/ticks"):
        return None
    return spark.read.parquet(f"{path}/ticks").drop("tick").dropDuplicates(STATUS_KEY)


def read_pool_status(spark: SparkSession, path: str) -> DataFrame:
    """All ticks, with `as_of_date`. A tick that is both in its day's files and on its own counts once."""
    new, days = _ticks(spark, path), files.names(spark, f"{path}/days")
    if not days:
        return new
    old = spark.read.parquet(f"{path}/days")
    return old if new is None else old.unionByName(new.join(old.select(*STATUS_KEY), STATUS_KEY, "left_anti"), allowMissingColumns=True)


def compact_pool_status(spark: SparkSession, path: str, day: str) -> None:
    """Put the ticks of a day into its files, which are written aside and take the place of the old ones as the
    last thing; only then do the ticks' own folders go. May be run again, also after it was cut off."""
    if not files.names(spark, f"{path}/ticks/as_of_date={day}"):
        return
    rows = materialise(read_pool_status(spark, path).filter(F.col("as_of_date") == F.lit(day).cast("date")), "day")
    _write_by_day(rows, "as_of_date", STATUS_KEY, "overwrite", f"{path}/days")
    files.remove(spark, f"{path}/ticks/as_of_date={day}")


# A table of sessions: a base snapshot, and the changes since, a folder for each batch.
SESSION_KEY = ["namespace", "session"]


def write_session_base(snapshot: DataFrame, path: str, batch: int = -1) -> None:
    """All sessions as they are after the changes of a batch; -1 comes before the first."""
    snapshot.write.mode("overwrite").parquet(f"{path}/base/version={batch}")


def write_session_batch(changes: DataFrame, path: str, batch: int) -> None:
    """Changed sessions: their key and all fields that change, with `ts` and `seq` that order changes of one
    session within the batch. A batch that is written again replaces itself."""
    changes.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")


def _versions(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the folders that were written to their end."""
    found = [int(n[len(name) + 1 :]) for n in files.names(spark, folder) if n.startswith(f"{name}=")]
    return sorted(n for n in found if files.exists(spark, f"{folder}/{name}={n}/_SUCCESS"))


def _merged(rows: DataFrame, log: DataFrame) -> DataFrame:
    newest = newest_rows(log, SESSION_KEY, ["batch", "ts", "seq"]).drop("batch", "ts", "seq")
    fields = [c for c in newest.columns if c not in SESSION_KEY]
    named = newest.select(*SESSION_KEY, *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_changed"))
    value = lambda c: F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
    return rows.join(named, SESSION_KEY, "full").select(*[F.col(c) if c in SESSION_KEY else value(c) for c in rows.columns])


def read_session_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest base with the changes since merged into it: the last change of a session stands, and a session
    that only changes tell of is new. Batches that change other fields are merged one after the other."""
    base = _versions(spark, f"{path}/base", "version")[-1]
    rows = spark.read.parquet(f"{path}/base/version={base}")
    folder = f"{path}/changes/batch="
    since = [b for b in _versions(spark, f"{path}/changes", "batch") if b > base]
    for _, alike in groupby(since, key=lambda b: sorted(spark.read.parquet(f"{folder}{b}").columns)):
        log = spark.read.option("basePath", f"{path}/changes").parquet(*[f"{folder}{b}" for b in alike])
        rows = _merged(rows, log)
    return rows


def compact_sessions(spark: SparkSession, path: str) -> None:
    """Make the newest state the base. Readers go over to it once it is whole; then the changes and bases before go,
    but for the last base, which a reader may still be at."""
    bases, batches = _versions(spark, f"{path}/base", "version"), _versions(spark, f"{path}/changes", "batch")
    if not batches or batches[-1] <= bases[-1]:
        return
    write_session_base(read_session_table(spark, path), path, batches[-1])
    for b in batches:
        if b <= bases[-1]:
            files.remove(spark, f"{path}/changes/batch={b}")
    for v in bases[:-1]:
        files.remove(spark, f"{path}/base/version={v}")


def newest_rows(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, in one aggregate that map tasks begin; rows without a key are left out. `order`
    tells all rows of a key apart, or any of the last is taken; missing places come first."""
    rest = [c for c in rows.columns if c not in key]
    known = rows.dropna(subset=key)
    return known.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*key, "_last.*")


def _write_by_day(rows: DataFrame, day: str, order: list[str], mode: str, path: str, options: dict[str, str] | None = None) -> None:
    """Files of even size per day: small days share a task, a large day is split over several."""
    balanced = rows.hint("rebalance", F.col(day)).sortWithinPartitions(day, *order)
    balanced.write.mode(mode).options(partitionOverwriteMode="dynamic", **(options or {})).partitionBy(day).parquet(path)


def write_sessions(snapshot: DataFrame, path: str, prefix: str | None = None, labels: dict[str, str] | None = None) -> None:
    """Write the session snapshot of a day (`snapshot_date`), replacing that day.

    Rows lie in the order of their pool, so a read of one pool skips most of each file. Labels that
    are often asked for (`labels`: column and name below `prefix`) become columns with Bloom filters, so
    that a filter on one reaches the files, and skips row groups that do not hold it.
    """
    labels = labels or {}
    rows = readers.with_label_columns(snapshot, prefix, **labels)
    options = {f"parquet.bloom.filter.enabled#{c}": "true" for c in labels} | {f"parquet.enable.dictionary#{c}": "false" for c in labels}
    _write_by_day(rows, "snapshot_date", ["namespace", "pool"], "overwrite", path, options)


def save_by_pool(sessions: DataFrame, table: str, path: str, buckets: int, shares: int = 1) -> None:
    """Sessions as a table in buckets of their pool, a file each, in the order of pool and instance. With `shares` a
    pool is dealt over as many buckets (column `share`), for pools that hold much of all rows; joins and counts by
    pool and share then need no shuffle of the table."""
    key = ["namespace", "pool", "share"]
    share = F.pmod(F.xxhash64("namespace", "session"), F.lit(shares)).cast("int")
    rows = sessions.withColumn("share", share).repartition(buckets, *key)
    rows.write.bucketBy(buckets, *key).sortBy(*key, "assigned_instance").mode("overwrite").option("path", path).saveAsTable(table)


def write_session_changes(changes: DataFrame, path: str) -> None:
    """Append state changes (namespace, session, state, reason, ts)."""
    dated = changes.withColumn("day", F.col("ts").cast("date"))
    _write_by_day(dated, "day", ["namespace", "session"], "append", path)


def latest_sessions(changes: DataFrame, order: list[str] = ["ts"]) -> DataFrame:  # noqa: B006
    """Newest change per session."""
    return newest_rows(changes, SESSION_KEY, order).select(*SESSION_KEY, *[c for c in changes.columns if c not in SESSION_KEY])


def to_listing_json(listing: DataFrame) -> DataFrame:
    """One JSON document per row; empty fields are left out."""
    text = [c for c, t in listing.dtypes if t == "string" and c not in ("name", "user", "pool", "state", "type", "host")]
    times = [c for c, t in listing.dtypes if t.startswith("timestamp")]
    cols = {c: F.nullif(F.col(c), F.lit("")) for c in text}
    cols |= {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") for c in times}
    shaped = listing.withColumns(cols) if cols else listing
    return shaped.select(F.to_json(F.struct(*listing.columns)).alias("value"))


def write_listing(listing: DataFrame, path: str, order: str = "name") -> None:
    to_listing_json(listing.orderBy(order)).write.mode("overwrite").text(path)
