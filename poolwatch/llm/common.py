"""Small helpers shared by the operators."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from poolwatch.sources.sinks import materialise

WORD = r"[^\x20\x09-\x0D]+"
SALTS = 16

stored = materialise


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def in_small_batches(docs: DataFrame, rows: int = 1_000) -> DataFrame:
    """The same table, of whose texts a task hands at most `rows` at once to Python: Spark's own number is made for
    short rows, and a batch is held several times, on either side."""
    conf = docs.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return docs


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once a row, also where lambdas inside use it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def salt(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def salted_semi(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose `on` is among the distinct `keys`. `rows` has a column salt, so one hot key is
    spread over SALTS tasks; only the keys are repeated."""
    spread = keys.select(on, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.join(spread, [on, "salt"], "left_semi")
