"""Running a streaming job into a table on the shared folder."""

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from poolwatch.sources.sinks import work_folder

# About as many rows as a task should sort for a state processor that takes in much at once.
ROWS_PER_PART = 1_000_000
_PARTS = "spark.sql.shuffle.partitions"


@contextmanager
def _parts(spark: SparkSession, least: int):
    """A stream takes the number of partitions with it when it starts; adaptive execution does not change it."""
    was = spark.conf.get(_PARTS)
    spark.conf.set(_PARTS, str(max(int(was), least)))
    try:
        yield
    finally:
        spark.conf.set(_PARTS, was)


def start(job: DataFrame, path: str, mode: str = "append", every: str | None = None, parts: int = 0) -> StreamingQuery:
    """Write a job below `path`, with its checkpoint beside the table.

    `every` is the tick ("30 seconds"); without it the job takes what is there and stops. Update
    mode writes each batch into its own partition, so a batch that is run again replaces itself.
    State lies in `parts` partitions at least, which cannot be changed later.
    """
    table, checkpoint = f"{path}/table", f"{path}/checkpoint"
    writer = job.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    if mode == "append":
        with _parts(job.sparkSession, parts):
            return writer.format("parquet").option("path", table).start()

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    with _parts(job.sparkSession, parts):
        return writer.foreachBatch(put).start()


def finish(job: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None, parts: int = 0) -> DataFrame:
    """Run a job over all that is there and return the table it wrote; in update mode, with `keys`, the newest
    row per key."""
    spark = job.sparkSession
    path = work_folder(spark, name)
    start(job, path, mode, parts=parts).awaitTermination()
    if mode == "append" or keys is None:
        return spark.read.schema(job.schema).parquet(f"{path}/table")
    rest = [c for c in job.columns if c not in keys]
    written = spark.read.option("basePath", f"{path}/table").parquet(f"{path}/table")
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(*keys, "r.*")
