"""Results as files: rounded CSV beside unrounded Parquet, reports by category, provenance."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, places: int = 3) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{f.name}`"), places).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`") for f in df.schema])


def write_results(df: DataFrame, folder: str, name: str, partition: str | None = None) -> None:
    """{name}.csv, three places, and {name}.parquet, whole; partitioned by a column if asked for."""
    for out, kind in ((rounded(df), "csv"), (df, "parquet")):
        writer = out.write.mode("overwrite")
        if partition:
            writer = writer.partitionBy(partition)
        writer.option("header", True).format(kind).save(f"{folder}/{name}.{kind}")


def export_images(images: DataFrame, folder: str) -> DataFrame:
    """Writes each raster (image_id, height, width, n_channels, data) as {image_id}.png into folder; image_id, path and n_bytes.

    Tasks write the files, each under a name of its own that is then renamed, so a task that runs twice leaves one whole file. The folder
    must be one that all executors reach. The files are written when the result is read.
    """

    def run(batches):
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        from .images import encode_png

        where, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        where.create_dir(root, recursive=True)
        for batch in batches:
            for image_id, h, w, c, data in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                png = encode_png(np.frombuffer(data, np.uint8).reshape(h, w, c))
                path, part = f"{root}/{image_id}.png", f"{root}/.{image_id}-{uuid.uuid4().hex}"
                with where.open_output_stream(part) as out:
                    out.write(png)
                where.move(part, path)
                yield pa.record_batch([pa.array([image_id]), pa.array([path]), pa.array([len(png)], pa.int64())], names=["image_id", "path", "n_bytes"])

    able = images.where("data is not null").select(F.col("image_id").cast("string"), "height", "width", "n_channels", "data")
    return able.mapInArrow(run, "image_id string, path string, n_bytes long")


def read_results(spark, folder: str, name: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(f"{folder}/{name}.csv")


def report(df: DataFrame, key: str, categories: dict[str, list[str]]) -> DataFrame:
    """One line of text a metric, by category: key, category, line."""
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.concat(F.lit(f"{m}: "), F.format_number(F.col(f"`{m}`").cast("double"), 3)).alias("line")) for c, some in categories.items() for m in some])
    return df.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def provenance(df: DataFrame, version: str, params: str) -> DataFrame:
    return df.limit(0).sparkSession.createDataFrame([(version, params)], "version string, params string").withColumn("written", F.current_timestamp())


def git_version(folder: str) -> dict[str, str]:
    """Short commit, branch and latest tag of the repository around a folder of the driver; unknown where there is none."""

    def said(*args: str) -> str:
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=False)
        return done.stdout.strip() if done.returncode == 0 else ""

    try:
        commit = said("rev-parse", "--short=7", "HEAD")
        if not commit:
            return {"version": "unknown", "git_hash": "", "git_branch": "", "latest_tag": ""}
        tag = said("for-each-ref", "--sort=-creatordate", "--count=1", "--format=%(refname:short)", "refs/tags") or "No tags"
        return {"version": tag, "git_hash": commit, "git_branch": said("rev-parse", "--abbrev-ref", "HEAD"), "latest_tag": tag}
    except OSError:
        return {"version": "unknown", "git_hash": "", "git_branch": "", "latest_tag": ""}


def elapsed(seconds: float) -> str:
    """Hours, minutes and seconds of a run."""
    minutes, rest = divmod(int(seconds), 60)
    return f"{minutes // 60}h {minutes % 60}m {rest}s"
