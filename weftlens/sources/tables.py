"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of files that a task reads, and of shuffled rows that a task gets when Spark joins small partitions.
BYTES = {"spark.sql.files.maxPartitionBytes": "32m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


#: Bytes of a table's files to a partition of a shuffle, before Spark joins small ones; and the keys of their number, Spark's and that of what was set here.
SHARE, FIRST, OURS = 3 << 20, "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "weftlens.initialPartitionNum"


def bounded_tasks(spark: SparkSession) -> None:
    """Sets the bytes of tasks where the caller has not.

    Aggregations that find few equal rows hold all of a task's rows: tables of numbers are packed so tightly that Spark's own sizes are
    millions of rows, and a task's memory grows with the input until it gets there.
    """
    set_ = spark.conf.getAll
    for key, most in BYTES.items():
        if key not in set_:
            spark.conf.set(key, most)


def enough_partitions(spark: SparkSession, where: str) -> None:
    """Raises the number of partitions that shuffles begin with to the table's size, where the caller has not set it.

    Spark joins small partitions but divides none before an aggregation or a sort, so with a fixed number a task's memory grows with the input.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    set_ = spark.conf.getAll
    if set_.get(FIRST) == set_.get(OURS):
        least = int(spark.conf.get(FIRST, None) or spark.conf.get("spark.sql.shuffle.partitions"))
        if size > least * SHARE:
            for key in (FIRST, OURS):
                spark.conf.set(key, str(-(-size // SHARE)))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    where = f"{folder}/{name}.parquet"
    bounded_tasks(spark)
    enough_partitions(spark, where)
    return spark.read.parquet(where)
