"""Points, circles and outlines in the plane: nearest neighbours, greedy choice of circles, outlines to pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from . import chunks
from .tabular import overlapping_circles

#: Bits of a target's place on each axis of its key's square, and those that one level of cells adds.
BITS, STEP = 20, 2


def _square(c: Column) -> Column:
    return c * c


def nearest_in_plane(points: DataFrame, targets: DataFrame, key: str, leaf: int = 16, most: int = 1 << 12) -> DataFrame:
    """For each point (key, id, y, x) the target of its key with the least distance, then least id; null where a key has none.

    Keys of at most so many points and targets are settled within tasks, so their points are shuffled once. For the others targets stand in cells that shrink level by level, until a cell holds at most leaf places. A point follows only the cells whose box may hold a
    target as near as one that some box is sure to hold, so it meets a few cells a level, whatever clusters the targets form, and only
    the targets of the last cells. Places are made distinct first. A point that stands in many rows has as many results.
    """
    shelf = Scratch(points.sparkSession, "nearest")
    asked, kind = points.select(key, "id", "y", "x"), dict(points.dtypes)["id"]
    if kind not in ("bigint", "int") or dict(targets.dtypes)["id"] != kind:
        return _nearest_by_cells(asked, targets, key, leaf, shelf)
    whole = shelf.table(asked.withColumn("_t", F.lit(0)).union(targets.select(key, "id", "y", "x", F.lit(1))), "all")
    named = whole.where(F.col("id").isNotNull())
    small, large = chunks.halves(named, [key], shelf, "all", most)
    found = chunks.by_key(small, [key], ["_t", "id"], chunks.nearest, f"id {kind}, _near {kind}, distance double")
    met = found.select(key, "id", F.when(F.col("distance").isNotNull(), F.col("_near")).alias("nearest_id"), "distance")
    lost = whole.where((F.col("_t") == 0) & (F.col(key).isNull() | F.col("id").isNull()))
    out = met.union(lost.select(key, "id", F.lit(None).cast(kind), F.lit(None).cast("double")))
    if large is None:
        return out
    return out.union(_nearest_by_cells(large.where("_t = 0"), large.where("_t = 1"), key, leaf, shelf))


def _nearest_by_cells(points: DataFrame, targets: DataFrame, key: str, leaf: int, shelf: Scratch) -> DataFrame:
    places = targets.groupBy(key, "y", "x").agg(F.min("id").alias("id"))
    box = shelf.table(places.groupBy(key).agg(F.min("y").alias("_y0"), F.min("x").alias("_x0"), F.greatest(F.max("y") - F.min("y"), F.max("x") - F.min("x")).alias("_side")), "box")

    def place(c: str, low: str) -> Column:
        return F.when(F.col("_side") > 0, F.least(F.floor((F.col(c) - F.col(low)) / F.col("_side") * (1 << BITS)), F.lit((1 << BITS) - 1))).otherwise(0).cast("long")

    placed = shelf.table(places.join(box, key).select(key, "id", "y", "x", place("y", "_y0").alias("cy"), place("x", "_x0").alias("cx")), "placed")
    every = shelf.table(points.select(key, "id", "y", "x").withColumn("_p", F.xxhash64(key, "id", "y", "x")), "points")
    open_ = every.join(box.select(key), key).select(key, F.col("id").alias("p"), F.col("y").alias("py"), F.col("x").alias("px"), F.lit(0).cast("long").alias("cy"), F.lit(0).cast("long").alias("cx"), F.lit(float("inf")).alias("best")).distinct()
    alive, met = placed, []
    for level in range(1, BITS // STEP + 1):
        shift = 1 << (BITS - STEP * level)
        own = {"cy": F.floor(F.col("cy") / shift), "cx": F.floor(F.col("cx") / shift)}
        cells = alive.select(key, "y", "x", *[c.alias(n) for n, c in own.items()]).groupBy(key, "cy", "cx").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("m"))
        cells = shelf.table(cells.select(key, F.col("cy").alias("ny"), F.col("cx").alias("nx"), F.floor(F.col("cy") / (1 << STEP)).alias("cy"), F.floor(F.col("cx") / (1 << STEP)).alias("cx"), "y0", "y1", "x0", "x1", "m"), f"cells-{level}")
        near, far, out = {}, {}, {}
        for a in "yx":
            p, low, high = F.col(f"p{a}"), F.col(f"{a}0"), F.col(f"{a}1")
            out[a] = _square(F.greatest(low - p, p - high, F.lit(0.0)))
            first = p <= (low + high) / 2
            near[a], far[a] = (_square(p - F.when(first, x).otherwise(y)) for x, y in ((low, high), (high, low)))
        # each side of a tight box touches a target, so one is no farther than this
        sure = F.least(near["y"] + far["x"], near["x"] + far["y"])
        reached = open_.join(cells, [key, "cy", "cx"]).withColumns({"_least": out["y"] + out["x"], "_sure": sure})
        best = F.least("best", F.min("_sure").over(Window.partitionBy(key, "p", "py", "px")))
        reached = reached.withColumn("best", best).where(F.col("_least") <= F.col("best") * (1 + 1e-12))
        reached = shelf.table(reached.select(key, "p", "py", "px", F.col("ny").alias("cy"), F.col("nx").alias("cx"), "best", "m"), f"reached-{level}")
        last = (F.col("m") <= leaf) if level < BITS // STEP else F.lit(True)
        here = placed.select(key, "id", "y", "x", *[c.alias(n) for n, c in own.items()])
        met.append(reached.where(last).select(key, "p", "py", "px", "cy", "cx").join(here, [key, "cy", "cx"]).select(key, "p", "py", "px", F.struct((_square(F.col("y") - F.col("py")) + _square(F.col("x") - F.col("px"))).alias("d"), "id").alias("t")))
        open_ = reached.where(~last).drop("m")
        if open_.isEmpty():
            break
        wide = cells.where(~last).select(key, F.col("ny").alias("_cy"), F.col("nx").alias("_cx"))
        alive = shelf.table(alive.withColumns({f"_{n}": c for n, c in own.items()}).join(wide, [key, "_cy", "_cx"], "left_semi").drop("_cy", "_cx"), f"alive-{level}")
    found = met[0]
    for more in met[1:]:
        found = found.union(more)
    found = found.groupBy(key, "p", "py", "px").agg(F.min("t").alias("t")).select(key, F.col("p").alias("id"), F.col("py").alias("y"), F.col("px").alias("x"), F.col("t.id").alias("nearest_id"), F.sqrt("t.d").alias("distance"))
    return every.drop("_p").join(found, [key, "id", "y", "x"], "left").select(key, "id", "nearest_id", "distance")


def chosen_circles(circles: DataFrame, key: str, most: int = 1 << 12) -> DataFrame:
    """The circles (key, id, y, x, r) that a greedy choice takes: largest first, then least id, none that overlaps a taken one.

    Keys of at most so many circles are settled within tasks. For the others overlapping pairs point from the circle that comes first. In a round all circles that none comes before are taken at a time, those that they
    overlap are dropped, and the pairs of both go; what is never dropped is taken. Rounds are at most the longest descending
    chain of overlaps, not the number of circles.
    """
    shelf = Scratch(circles.sparkSession, "circles")
    small, large = chunks.halves(shelf.table(circles, "all"), [key], shelf, "all", most)
    some = small.withColumn("_r", -F.col("r"))
    kinds = dict(circles.dtypes)
    found = chunks.by_key(some, [key], ["_r", "id"], chunks.chosen_circles, ", ".join(f"{c} {kinds[c]}" for c in circles.columns if c != key)).select(*circles.columns)
    return found if large is None else found.union(_chosen_by_rounds(large, key, shelf).select(*circles.columns))


def _chosen_by_rounds(circles: DataFrame, key: str, shelf: Scratch) -> DataFrame:
    first = shelf.table(circles, "large")
    met = overlapping_circles(first, key)
    rank = first.select(key, "id", "r")
    both = met.join(rank.toDF(key, "a", "ra"), [key, "a"]).join(rank.toDF(key, "b", "rb"), [key, "b"])
    leads = F.col("ra") >= F.col("rb")  # a < b, so a comes first of equal ones
    pairs = shelf.table(both.select(key, F.when(leads, F.col("a")).otherwise(F.col("b")).alias("hi"), F.when(leads, F.col("b")).otherwise(F.col("a")).alias("lo")), "pairs-0")
    dropped, k = [], 0
    while not pairs.isEmpty():
        k += 1
        free = shelf.table(pairs.select(key, "hi").distinct().join(pairs.select(key, F.col("lo").alias("hi")).distinct(), [key, "hi"], "left_anti"), f"free-{k}")
        gone = shelf.table(pairs.join(free, [key, "hi"], "left_semi").select(key, "lo").distinct(), f"gone-{k}")
        if gone.isEmpty():
            raise ValueError("circles of one key share an id")
        dropped.append(gone)
        pairs = shelf.table(pairs.join(gone, [key, "lo"], "left_anti").join(gone.withColumnRenamed("lo", "hi"), [key, "hi"], "left_anti"), f"pairs-{k}")
        shelf.drop(f"pairs-{k - 1}", f"free-{k}")
    out = first
    if dropped:
        lost = dropped[0]
        for more in dropped[1:]:
            lost = lost.union(more)
        out = first.join(lost.withColumnRenamed("lo", "id"), [key, "id"], "left_anti")
    return out.select(*circles.columns)


def outline_spans(vertices: DataFrame, key: str) -> DataFrame:
    """Spans (key, y, x_from, x_to) of the pixels inside closed outlines (key, idx, y, x), by the even-odd rule.

    Each edge crosses the whole-numbered rows from its upper end to before its lower one; sorted crossings of a row pair up, and a
    pixel is inside from the left crossing on to before the right one.
    """
    w = Window.partitionBy(key).orderBy("idx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = {f"_{c}": F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in "yx"}
    edges = vertices.withColumns(step).where("y <> _y")
    low, high = F.ceil(F.least("y", "_y")), F.ceil(F.greatest("y", "_y")) - 1
    rows = edges.where(low <= high).withColumn("row", F.explode(F.sequence(low, high)))
    crossing = F.col("x") + (F.col("row") - F.col("y")) * (F.col("_x") - F.col("x")) / (F.col("_y") - F.col("y"))
    met = rows.select(key, "row", crossing.alias("at"))
    by_row = Window.partitionBy(key, "row").orderBy("at")
    paired = met.withColumns({"_n": F.row_number().over(by_row), "_to": F.lead("at").over(by_row)}).where("_n % 2 = 1")
    spans = paired.select(key, F.col("row").alias("y"), F.ceil("at").alias("x_from"), (F.ceil("_to") - 1).alias("x_to"))
    return spans.where("x_from <= x_to")


def outline_pixels(vertices: DataFrame, key: str) -> DataFrame:
    """(key, y, x) of the pixels of outline_spans()."""
    return outline_spans(vertices, key).select(key, "y", F.explode(F.sequence("x_from", "x_to")).alias("x"))
