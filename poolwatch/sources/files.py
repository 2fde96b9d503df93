"""Folders of the file system Spark writes to, whatever it is."""

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no folder. Hidden ones are left out."""
    system, where = _at(spark, path)
    found = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
    return sorted(n for n in found if not n.startswith((".", "_")))


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def touch(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.create(where, True).close()


def remove(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.delete(where, True)
