"""Regions by colour in pictures given as rows of pixels (image_id, y, x, r, g, b; 0 … 255), which may be larger than a task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..sources.scratch import Scratch
from .pixels import labelled_runs, large_components, of_runs, without_small_holes

RGB = ("r", "g", "b")


def shade(levels: int) -> Column:
    """Number of a colour's cell when each channel is cut into so many equal levels."""
    r, g, b = (F.least(F.floor(F.col(c) * levels / 256), F.lit(levels - 1)).cast("long") for c in RGB)
    return (r * levels + g) * levels + b


def colour_runs(pixels: DataFrame, levels: int) -> DataFrame:
    """Runs (image_id, shade, y, x0, x1, root, size, r, g, b): components of one shade, corners too, with their mean colour, cut to whole numbers.

    Rows that repeat at a place count once, with the largest of each channel; rows with nulls are left out.
    """
    known = pixels.select("image_id", "y", "x", *RGB).dropna()
    one = known.groupBy("image_id", "y", "x").agg(*[F.max(c).cast("double").alias(c) for c in RGB])
    by_shade = one.select(F.struct("image_id", shade(levels).alias("shade")).alias("image_id"), "y", "x", F.lit(0.0).alias("v"), *RGB)
    found = labelled_runs(by_shade, sums=RGB)
    return found.select("image_id.*", "y", "x0", "x1", "root", "size", *[F.floor(F.col(c) / F.col("size")).cast("double").alias(c) for c in RGB])


def relative_closeness(found: DataFrame, hue: float) -> DataFrame:
    """colour_runs() with closeness: 0 … 1 over the regions of the picture, by hue, saturation and value of their means.

    A picture whose regions are all grey is held against bright grey instead of the hue; all get 0 if they are equally close.
    """
    h, s, v = scalar.hsv(*[F.col(c) for c in RGB])
    seen = found.withColumns({"_h": h, "_s": s, "_v": v})
    close = {f"_{k}": scalar.hue_closeness(F.col("_h"), F.col("_s"), F.col("_v"), F.lit(hue), F.lit(k == "grey")) for k in ("colour", "grey")}
    seen = seen.withColumns(close)
    ends = seen.groupBy("image_id").agg(F.max(F.col("_h") + F.col("_s")).alias("_tint"), *[f(k).alias(f"{k}_{n}") for k in close for n, f in (("low", F.min), ("high", F.max))])
    shelf = Scratch(found.sparkSession, "closeness")
    both = seen.join(shelf.table(ends, "ends"), "image_id")

    def of(part: str) -> Column:
        return F.when(F.col("_tint") == 0, F.col(f"_grey{part}")).otherwise(F.col(f"_colour{part}"))

    return both.select(*found.columns, ((of("") - of("_low")) / (of("_high") - of("_low") + 2.220446049250313e-16)).alias("closeness"))


def colour_regions(pixels: DataFrame, height: int, width: int, levels: int = 4, hue: float = 0.96, above: float = 0.2, least: int = 64) -> DataFrame:
    """(image_id, y, x): the pixels of regions close to the hue, holes and then objects of fewer than least pixels removed, by sides.

    Stands for segmentation by a network trained on each picture: shades take the place of its labels, the rest follows the same rules.
    A picture without close regions has no rows; an empty table gives an empty one.
    """
    shelf = Scratch(pixels.sparkSession, "regions")
    chosen = relative_closeness(shelf.table(colour_runs(pixels, levels), "runs"), hue).where(F.col("closeness") > above)
    full = without_small_holes(shelf.table(of_runs(chosen), "chosen"), height, width, least, at_border=True)
    return large_components(shelf.table(full.withColumn("v", F.lit(0.0)), "full"), least, corners=False).select("image_id", "y", "x")


def whole(images: DataFrame, height: int, width: int) -> DataFrame:
    """(image_id, y, x) of all pixels: the region of pictures that are not segmented."""
    places = [F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))) for n in (height, width)]
    return images.select("image_id").distinct().withColumn("y", places[0]).withColumn("x", places[1])


def masked_intensities(pixels: DataFrame, masks: dict[str, DataFrame], below: int = 180) -> DataFrame:
    """image_id and the mean grey under each mask (image_id, y, x) by its name.

    It is that of the picture's eosin, over pixels below the limit; where the mask has none, that of plain grey; 0 under an empty mask.
    Greys are whole numbers 0 … 255. All masks meet the pixels in one join. Rows that repeat at a place count once, as in colour_runs().
    """
    known = pixels.select("image_id", "y", "x", *RGB).dropna()
    one = known.groupBy("image_id", "y", "x").agg(*[F.max(c).cast("double").alias(c) for c in RGB])
    marks = [m.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *[F.lit(n == name).alias(f"_in_{n}") for n in masks]) for name, m in masks.items()]
    marked = reduce(DataFrame.union, marks).groupBy("image_id", "y", "x").agg(*[F.max(f"_in_{n}").alias(f"_in_{n}") for n in masks])
    met = one.join(marked, ["image_id", "y", "x"], "left")
    red = F.floor(scalar.luma_linear(*scalar.eosin_only(*[F.col(c) for c in RGB])) * 255)
    grey = F.floor(scalar.luma_linear(*[F.col(c) for c in RGB]))
    seen = met.withColumns({"_red": red, "_grey": grey})

    def mean(name: str) -> Column:
        some = F.col(f"_in_{name}")
        return F.coalesce(F.avg(F.when(some & (F.col("_red") < below), F.col("_red"))), F.avg(F.when(some, F.col("_grey"))), F.lit(0.0)).alias(name)

    return seen.groupBy("image_id").agg(*[mean(n) for n in masks])
