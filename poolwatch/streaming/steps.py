"""Streams worked off a batch at a time by batch jobs, with state in tables of the shared folder.

A step reads the state the batch before left, and writes its rows and the new state below the batch's
own number; a mark ends it. A batch that is run again finds the mark and changes nothing, or, where
it was cut off, writes the same folders anew. What a step reads beside its batch, such as pools, it
reads when it runs.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from poolwatch import values as V
from poolwatch.plans import capacity
from poolwatch.sources import files
from poolwatch.streaming.jobs import DELAY

# Rows of a step, and its state by name.
Step = Callable[[DataFrame, dict[str, DataFrame], bool], tuple[DataFrame, dict[str, DataFrame]]]
LAST = 1 << 62


class Steps:
    """A job that is a step per batch, below `path`: rows in `table`, state in `state`."""

    def __init__(self, spark: SparkSession, path: str, step: Step):
        self.spark, self.path, self.step = spark, path, step

    def done(self) -> list[int]:
        return sorted(int(n[len("done-"):]) for n in files.names(self.spark, f"{self.path}/marks") if n.startswith("done-"))

    def run(self, batch: DataFrame, number: int, last: bool = False) -> None:
        done = self.done()
        if number in done:
            return
        before = max((n for n in done if n < number), default=None)
        held = f"{self.path}/state/version={before}"
        names = files.names(self.spark, held) if before is not None else []
        state = {n: self.spark.read.parquet(f"{held}/{n}") for n in names}
        rows, after = self.step(batch, state, last)
        rows.write.mode("overwrite").parquet(f"{self.path}/table/batch={number}")
        for name, table in after.items():
            table.write.mode("overwrite").parquet(f"{self.path}/state/version={number}/{name}")
        files.touch(self.spark, f"{self.path}/marks/done-{number}")
        # The version just read stays, for a run of this batch that ends twice.
        for old in done:
            if before is not None and old < before:
                files.remove(self.spark, f"{self.path}/state/version={old}")
                files.remove(self.spark, f"{self.path}/marks/done-{old}")

    def start(self, stream: DataFrame, every: str | None = None) -> StreamingQuery:
        writer = stream.writeStream.option("checkpointLocation", f"{self.path}/checkpoint").foreachBatch(self.run)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def finish(self, stream: DataFrame) -> DataFrame:
        """Work off all that is there, close the stream, and return the rows."""
        self.start(stream).awaitTermination()
        self.run(self.spark.createDataFrame([], stream.schema), LAST, last=True)
        return self.table()

    def table(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/table").parquet(f"{self.path}/table").drop("batch")


def in_order(batch: DataFrame, state: dict[str, DataFrame], ts: str, delay: str, last: bool):
    """(ready, held, mark): the rows whose time the watermark has passed, with those held back before; the rows it has
    not; and the newest time seen. Rows older than the watermark before are late and left out."""
    wait = F.expr(f"interval {delay}")
    mark = state["mark"].first()["mark"] if "mark" in state else None
    rows = batch if mark is None else batch.filter(F.col(ts) > F.lit(mark) - wait)
    newest = max(filter(None, [batch.agg(F.max(ts)).first()[0], mark]), default=None)
    rows = rows.unionByName(state["held"]) if "held" in state else rows
    passed = F.lit(True) if last or newest is None else F.col(ts) <= F.lit(newest) - wait
    kind = batch.schema[ts].dataType.simpleString()
    mark = batch.sparkSession.createDataFrame([(newest,)], f"mark {kind}")
    return rows.filter(passed), rows.filter(~passed), mark


def cooldowns(pools: Callable[[], DataFrame], delay: str = DELAY) -> Step:
    """Shrink actions with the time since the pool's previous one, as the batch audit has them for any cut into
    batches. State: the last shrink of each pool, and what may still be overtaken. Policies are read anew
    for each batch."""

    def step(log: DataFrame, state: dict[str, DataFrame], last: bool):
        shrinks = log.filter(F.col("action") == "shrink").select(*V.POOL, "action_id", "ts", "action")
        ready, held, mark = in_order(shrinks, state, "ts", delay, last)
        before = state["last"] if "last" in state else ready.select(*V.POOL, "ts").limit(0)
        known = before.select(*V.POOL, F.lit(None).cast("bigint").alias("action_id"), "ts", F.lit("shrink").alias("action"))
        line = ready.unionByName(known)
        newest = line.groupBy(*V.POOL).agg(F.max("ts").alias("ts"))
        rows = capacity.scaling_audit(line, pools()).filter("action_id is not null")
        return rows, {"last": newest, "held": held, "mark": mark}

    return step


def at_ticks(evaluate: Callable[[Column], dict[str, DataFrame]], write: Callable[[dict[str, DataFrame]], None]):
    """A step for a stream of ticks (ts): what `evaluate` says at each tick of the batch, in order, given to `write`.
    Ticks are few, as a clock makes them, and a backlog of them is evaluated at its last alone."""

    def tick(batch: DataFrame, number: int) -> None:
        at = batch.agg(F.max("ts")).first()[0]
        if at is not None:
            write(evaluate(F.lit(at).cast("timestamp_ntz")))

    return tick


def start_ticks(clock: DataFrame, tick, path: str, every: str = f"{V.TICK_SECONDS} seconds") -> StreamingQuery:
    """Run `tick` each `every`; `clock` is a stream of times, such as Spark's rate source."""
    writer = clock.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(tick)
    return writer.trigger(processingTime=every).start()
