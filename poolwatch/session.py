"""Session settings the jobs are written for."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key is split also where that costs one more shuffle after the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings that can change at run time to a session somebody else made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if spark.sparkContext.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        # One machine: a state store per core and operator is enough.
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return spark


def builder(master: str | None = None, app: str = "poolwatch", **conf):
    made = SparkSession.builder.appName(app)
    if master:
        made = made.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        made = made.config(key, value)
    return made


def cluster_settings(cores: int) -> dict[str, str]:
    """Settings that grow with the cluster: start from many small shuffle partitions and let
    adaptive execution join them up to an even size."""
    return {
        "spark.sql.shuffle.partitions": str(2 * cores),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(4 * cores),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.files.maxPartitionBytes": "256m",
    }
