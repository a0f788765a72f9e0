"""One total order over a table of any size: ranks and batches by range partitions, counts a partition and offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def _offsets(sums: DataFrame) -> DataFrame:
    """(_part, _before) from (_part, n): the window runs over one row a partition, not over the table."""
    return sums.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))


def ranked(df: DataFrame, order: Sequence[str], scratch: Scratch | None = None) -> DataFrame:
    """df with _part, its range partition, and rank, from 0 by order over the whole table.

    The sorted table is written before its partitions are counted, since a partitioning by sampled ranges may fall out differently
    when it is worked out again. Rows equal in order follow each other in any order.
    """
    shelf = scratch or Scratch(df.sparkSession, "ranked")
    cols = [F.col(c) for c in order]
    placed = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    at = placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    sorted_ = shelf.table(at, "sorted")
    before = shelf.table(_offsets(sorted_.groupBy("_part").agg(F.count("*").alias("n"))), "offsets")
    return sorted_.join(before, "_part").withColumn("rank", F.col("_at") + F.col("_before")).drop("_at", "_before")


def batches(images: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """images with batch, numbers from 0 within each key, and batch_no, from 0 over the whole table, in the order of key and order.

    A batch has at most size images of one key. Ranks come from ranked(); a hot key is spread over the range partitions that it fills,
    and the numbers of batches that start are counted by partition.
    """
    shelf = Scratch(images.sparkSession, "batches")
    rows = shelf.table(ranked(images, [key, order], shelf), "ranked")
    shelf.drop("sorted", "offsets")
    first = shelf.table(rows.groupBy(F.col(key).alias("_key")).agg(F.min("rank").alias("_first")), "first")
    within = F.col("rank") - F.col("_first")
    met = rows.join(first, F.col(key).eqNullSafe(F.col("_key"))).withColumns({"batch": F.floor(within / size).cast("int"), "_start": F.when(within % size == 0, 1).otherwise(0).cast("long")})
    before = shelf.table(_offsets(met.groupBy("_part").agg(F.sum("_start").alias("n"))), "starts")
    inside = F.sum("_start").over(Window.partitionBy("_part").orderBy("rank"))
    return met.join(before, "_part").withColumn("batch_no", inside + F.col("_before") - 1).select(*images.columns, "batch", "batch_no")
