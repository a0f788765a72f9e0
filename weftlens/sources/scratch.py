"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Tables written to the shared folder, so that no lost executor loses them; those not dropped go when the session ends.

    The folder is ``spark.checkpoint.dir``, else the one of ``SparkContext.setCheckpointDir``; where neither is set, a local
    master takes a temporary folder and any other one raises. Tables are joined by sorting: files say little of a table's size in memory,
    so by them Spark would broadcast, through the driver, tables that grow with the input.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        sc = spark.sparkContext
        root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if not root and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not root:
            root = f"file://{tempfile.gettempdir()}/weftlens-scratch"
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._fs, path = self._path(self.root)
        self._fs.deleteOnExit(path)

    def _path(self, where: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def table(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where).hint("merge")

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = self._path(f"{self.root}/{name}")
            fs.delete(path, True)
