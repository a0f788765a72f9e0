"""Structure tensors of rasters and what is read off their means: direction, alignment, variance, randomness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from . import raster as R


def gradients(images: DataFrame, column: str, h: int, w: int) -> DataFrame:
    """images with gx and gy, the Sobel gradients of the column's rasters (reflected at the border)."""
    return images.withColumns({"gx": R.convolve(F.col(column), R.SOBEL_X, h, w, "reflect"), "gy": R.convolve(F.col(column), R.SOBEL_Y, h, w, "reflect")})


def smoothed(images: DataFrame, column: str, h: int, w: int, sigma: float = 2.0, out: str = "smooth") -> DataFrame:
    """images with a Gaussian blur of the column; each pass is a projection of its own."""
    g = R.gaussian(sigma, radius=min(int(4 * sigma + 0.5), h - 1, w - 1))
    return images.withColumn("_rows", R.pass_rows(F.col(column), g, h, w, "reflect")).withColumn(out, R.pass_columns(F.col("_rows"), g, h, w, "reflect")).drop("_rows")


def tensor_means(images: DataFrame) -> DataFrame:
    """xx, xy and yy: the tensor's means over each image, from gx and gy."""

    def mean_product(a: str, b: str) -> Column:
        return R.mean(F.zip_with(a, b, lambda x, y: x * y))

    return images.withColumns({"xx": mean_product("gx", "gx"), "xy": mean_product("gx", "gy"), "yy": mean_product("gy", "gy")})


def alignment() -> Column:
    return scalar.coherency(F.col("xx"), F.col("xy"), F.col("yy"))


def mean_direction_degrees() -> Column:
    return F.degrees(scalar.orientation(F.col("xx"), F.col("xy"), F.col("yy")))


def directions() -> Column:
    """The direction of each pixel from gx and gy."""
    return F.zip_with("gx", "gy", lambda x, y: F.lit(0.5) * F.atan2(2 * x * y, y * y - x * x))


def energy() -> Column:
    """The tensor's energy at each pixel from gx and gy, from 0 to 1 between the image's 2nd and 98th percentile."""
    raw = F.zip_with("gx", "gy", lambda x, y: x * x + y * y)

    def spread(e: Column) -> Column:
        ends = F.struct(R.percentile(e, 0.02).alias("low"), R.percentile(e, 0.98).alias("high"))
        return R.let(ends, lambda b: F.transform(e, lambda v: F.least(F.greatest((v - b["low"]) / (b["high"] - b["low"] + 1e-20), F.lit(0.0)), F.lit(1.0))))

    return R.let(raw, spread)


def circular_variance(column: str) -> Column:
    """1 less the length of the mean of unit vectors at twice the angle."""
    c = R.mean(F.transform(column, lambda a: F.cos(2 * a)))
    s = R.mean(F.transform(column, lambda a: F.sin(2 * a)))
    return 1 - F.sqrt(c * c + s * s)


def angle_bins(column: str, bins: int) -> Column:
    """Numbers 0 … bins - 1 of the half-circle sectors that the angles (-pi/2 … pi/2) fall in."""
    return F.transform(column, lambda a: F.least(F.lit(bins - 1), F.floor((a + math.pi / 2) / math.pi * bins).cast("int")))


def randomness(column: str, bins: int = 180) -> Column:
    """1 / (sqrt(divergence from uniform) + 1) of the histogram of angles."""
    size = F.size(column).cast("double")
    counts = R.let(angle_bins(column, bins), lambda numbers: F.transform(F.array_distinct(numbers), lambda b: F.size(F.filter(numbers, lambda x: x == b)) / size))
    divergence = F.aggregate(counts, F.lit(0.0), lambda s, p: s + p * F.ln(p * bins))
    return 1 / (F.sqrt(F.greatest(divergence, F.lit(0.0))) + 1)


def block_directions(images: DataFrame, column: str, h: int, w: int, size: int) -> DataFrame:
    """by, bx, mean cosine and sine of twice the angle, one row a block of size x size pixels."""
    pixels = images.select("image_id", F.posexplode(column).alias("i", "a"))
    return pixels.groupBy("image_id", F.floor(F.floor(F.col("i") / w) / size).cast("int").alias("by"), F.floor(F.col("i") % w / size).cast("int").alias("bx")).agg(F.avg(F.cos(2 * F.col("a"))).alias("c"), F.avg(F.sin(2 * F.col("a"))).alias("s"), F.max("a").alias("most"))
