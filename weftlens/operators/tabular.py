"""Tables of metrics: per-patient statistics, scores, look-ups, unions, checks and tilings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide
from ..sources.scratch import Scratch
from . import chunks


def eligible(h: Column, w: Column, bright: Column, widest_line: int, least: float = 1e-4) -> Column:
    """Whether an image is large enough for the widest line and not empty (share of bright pixels)."""
    return (F.least(h, w) >= 2 * widest_line) & (bright > least)


def oversized(images: DataFrame, most: int) -> DataFrame:
    return images.agg(F.coalesce(F.bool_or(F.col("width") * F.col("height") > most * most), F.lit(False)).alias("any_oversized"))


def tiles(images: DataFrame, most: int) -> DataFrame:
    """One row a tile: equal blocks of at most most pixels a side, the last one moved back inside on both axes."""

    def side(n: str) -> Column:
        parts = F.ceil(F.col(n) / most)
        return F.ceil(F.col(n) / parts).cast("int")

    sized = images.withColumns({"_bh": side("height"), "_bw": side("width")})
    rows = sized.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.col("_bh"))))
    cells = rows.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.col("_bw"))))
    return cells.select("image_id", F.floor(F.col("_y") / F.col("_bh")).cast("int").alias("i"), F.floor(F.col("_x") / F.col("_bw")).cast("int").alias("j"), F.least("_y", F.col("height") - F.col("_bh")).cast("int").alias("y0"), F.least("_x", F.col("width") - F.col("_bw")).cast("int").alias("x0"), F.col("_bh").alias("tile_h"), F.col("_bw").alias("tile_w"))


def group_statistics(df: DataFrame, by: Sequence[str], metrics: Sequence[str], ordinal: str, first: Sequence[str] = ()) -> DataFrame:
    """Rows, first values by ordinal, and mean, population deviation and standard error (non-null count) of each metric."""
    aggs = [F.count("*").alias("n_rois"), *[F.min_by(c, ordinal).alias(c) for c in first]]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), (F.stddev_pop(m) / F.sqrt(F.count(m))).alias(f"{m}_sem")]
    return df.groupBy(*by).agg(*aggs)


def with_z_scores(df: DataFrame, columns: Sequence[str], prefix: str = "z_") -> DataFrame:
    """Population z-scores, 0 where the deviation is 0. Means come from one aggregated row, joined without a sort."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = df.crossJoin(F.broadcast(stats))  # one row
    return joined.select(*df.columns, *[safe_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(f"{prefix}{c}") for c in columns])


def composite_scores(df: DataFrame, curvature: str, alignment: str, coverage: str, endpoints: str, thickness: str, fractal: str) -> DataFrame:
    """rigidity and bundling scores from z-scores of those columns."""
    z = with_z_scores(df, [curvature, alignment, coverage, endpoints, thickness, fractal])
    c = {k: F.col(f"z_{k}") for k in (curvature, alignment, coverage, endpoints, thickness, fractal)}
    return z.withColumns({"rigidity": c[thickness] - c[curvature] + c[alignment] + c[coverage] - c[endpoints], "bundling": c[thickness] + c[alignment] + c[coverage] + c[fractal] - c[endpoints]})


def area_summary(df: DataFrame, by: Sequence[str], area: str) -> DataFrame:
    """Mean, population deviation, 5th, 50th and 95th percentile and count of areas, and the radii's mean of each kind.

    radius_of_mean is that of the mean area, mean_radius the mean of the radii: both are in use, and they differ.
    """
    q = F.percentile(area, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    r = F.sqrt(F.col(area) / math.pi)
    out = df.groupBy(*by).agg(F.avg(area).alias("area_mean"), F.stddev_pop(area).alias("area_std"), q.alias("_q"), F.count(area).alias("n_gaps"), F.avg(r).alias("mean_radius"), F.stddev_pop(r).alias("radius_std"))
    return out.withColumns({"p5": F.get("_q", F.lit(0)), "median": F.get("_q", F.lit(1)), "p95": F.get("_q", F.lit(2)), "radius_of_mean": F.sqrt(F.col("area_mean") / math.pi)}).drop("_q")


def looked_up(left: DataFrame, right: DataFrame | None, key: str, columns: Sequence[str]) -> DataFrame:
    """left with columns of right by key, 0 where there is no row; a missing table gives zeros throughout."""
    if right is None:
        return left.withColumns({c: F.lit(0.0) for c in columns})
    some = right.select(key, *columns)
    return left.join(some, key, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})


def gap_summaries(left: DataFrame, whole: DataFrame | None, region: DataFrame | None, key: str, columns: Sequence[str]) -> DataFrame:
    """left with columns of the whole image's summary and, as roi_…, of its region's; both are 0 where the region has no row."""
    if whole is None or region is None:
        return left.withColumns({f"{p}{c}": F.lit(0.0) for p in ("", "roi_") for c in columns})
    inner = region.select(key, *[F.col(c).alias(f"roi_{c}") for c in columns], F.lit(True).alias("_there"))
    met = left.join(whole.select(key, *columns), key, "left").join(inner, key, "left")
    return met.withColumns({f"{p}{c}": F.when(F.col("_there"), F.coalesce(f"{p}{c}", F.lit(0.0))).otherwise(0.0) for p in ("", "roi_") for c in columns}).drop("_there")


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """df, with an error as soon as a key that stands twice is read."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"{key} stands twice: "), F.col(key).cast("string")))).otherwise(F.lit(True))).drop("_n")


def unioned(*tables: DataFrame) -> DataFrame:
    """All rows, columns by name, null where a table lacks one."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def without_roi_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if "ROI" not in c])


def mean_columns(df: DataFrame, meta: Sequence[str]) -> DataFrame:
    return df.select(*meta, *[c for c in df.columns if c.endswith("_mean")])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "double", "float", "short")]


def correlations(df: DataFrame, columns: Sequence[str], most: int | None = None) -> DataFrame:
    """Pairs (a, b) and Pearson's r, largest magnitude first if most is given. All pairs come from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("e")).select("e.*")
    return long.orderBy(F.abs("r").desc(), "a", "b").limit(most) if most else long


def described(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, extremes and quartiles, one row a column."""
    q = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    one = df.agg(*[F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.percentile(c, q).alias("q")).alias(c) for c in columns])
    e = one.select(F.explode(F.array(*columns)).alias("e")).select("e.*")
    return e.select("name", "n", "mean", "std", "low", F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(1)).alias("q50"), F.get("q", F.lit(2)).alias("q75"), "high")


def confusion(df: DataFrame, truth: Column, found: Column) -> DataFrame:
    """Counts of both, only found, only true and neither."""

    def n(test: Column) -> Column:
        return F.count_if(test)

    return df.agg(n(truth & found).alias("tp"), n(~truth & found).alias("fp"), n(truth & ~found).alias("fn"), n(~truth & ~found).alias("tn"))


def box_counts(cells: DataFrame, key: str, sizes: Sequence[int]) -> DataFrame:
    """Boxes of each size over distinct cells (key, y, x) that are neither empty nor full; sizes without one are 1e-10."""
    sized = cells.select(key, "y", "x", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("k"))
    boxes = sized.groupBy(key, "k", F.floor(F.col("y") / F.col("k")).alias("by"), F.floor(F.col("x") / F.col("k")).alias("bx")).agg(F.count("*").alias("cells"))
    return boxes.groupBy(key, "k").agg(F.greatest(F.count_if(F.col("cells") < F.col("k") * F.col("k")).cast("double"), F.lit(1e-10)).alias("n"))


def fractal_dimension(cells: DataFrame, key: str, sizes: Sequence[int]) -> DataFrame:
    return box_counts(cells, key, sizes).groupBy(key).agg((-F.regr_slope(F.ln("n"), F.ln("k"))).alias("dimension"))


def chord_angle(cross: Column, dot: Column) -> Column:
    """Degrees between two chords by their cross and dot product. Where both are zero the sign of the dot's zero decides, as in SQL's atan2; Spark's drops it."""
    turned = (cross == 0) & (dot == 0) & (F.pow(dot, F.lit(-1.0)) < 0)
    return F.when(turned, F.lit(180.0)).otherwise(F.degrees(F.abs(F.atan2(cross, dot))))


def curvature(points: DataFrame, key: str, order: Sequence[str], y: str, x: str, side: int) -> DataFrame:
    """points with angle: degrees between the chords to the points side steps back and ahead, null within side of an end."""
    w = Window.partitionBy(key).orderBy(*order)
    back = (F.col(y) - F.lag(y, side).over(w), F.col(x) - F.lag(x, side).over(w))
    ahead = (F.lead(y, side).over(w) - F.col(y), F.lead(x, side).over(w) - F.col(x))
    cross, dot = back[1] * ahead[0] - back[0] * ahead[1], back[0] * ahead[0] + back[1] * ahead[1]
    return points.withColumn("angle", chord_angle(cross, dot))


def reflected_curvature(points: DataFrame, key: str, order: Sequence[str], y: str, x: str, side: int) -> DataFrame:
    """points with angle as curvature() gives it, but at the ends too: beyond them a path goes on reflected through its end point.

    The chords of a path of at most side points are as long as it allows; a single point has angle 0.
    """
    w, back_to_front = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    whole, reverse = (v.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) for v in (w, back_to_front))
    at = F.struct(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"))
    known = points.withColumns({"_p": at, "_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(key)), "_back": F.lag(at, side).over(w), "_ahead": F.lead(at, side).over(w)})
    known = known.withColumns({"_first": F.array(*[F.nth_value("_p", k + 1).over(whole) for k in range(side + 1)]), "_last": F.array(*[F.nth_value("_p", k + 1).over(reverse) for k in range(side + 1)])})
    s = F.least(F.lit(side), F.col("_n") - 1)

    def through(ends: str, k: Column, c: str) -> Column:
        return 2 * F.get(ends, F.lit(0))[c] - F.get(ends, k.cast("int"))[c]

    def point(direct: str, j: Column, c: str) -> Column:
        beyond = F.when(j < 0, through("_first", -j, c)).when(j > F.col("_n") - 1, through("_last", j - F.col("_n") + 1, c))
        return F.coalesce(beyond, F.col(direct)[c], F.get("_first", F.greatest(j, F.lit(0)).cast("int"))[c])

    chord = {f"_{d}{c}": (F.col("_p")[c] - point("_back", F.col("_i") - s, c) if d == "a" else point("_ahead", F.col("_i") + s, c) - F.col("_p")[c]) for d in "ab" for c in "yx"}
    met = known.withColumns(chord)
    cross, dot = F.col("_ax") * F.col("_by") - F.col("_ay") * F.col("_bx"), F.col("_ay") * F.col("_by") + F.col("_ax") * F.col("_bx")
    return met.withColumn("angle", chord_angle(cross, dot)).select(*points.columns, "angle")


def path_lengths(points: DataFrame, key: str, order: Sequence[str], y: str, x: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    step = F.hypot(F.col(y) - F.lag(y).over(w), F.col(x) - F.lag(x).over(w))
    return points.withColumn("_s", step).groupBy(key).agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("length"), F.count("*").alias("n_points"))


def gaps_filled(points: DataFrame, key: str, order: Sequence[str], value: str, along: str) -> DataFrame:
    """points with filled: missing values between known ones by linear interpolation over along, else the nearest known one."""
    w = Window.partitionBy(key).orderBy(*order)
    behind, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(along).alias("t"), F.col(value).alias("v")))
    a, b = F.last(known, ignorenulls=True).over(behind), F.first(known, ignorenulls=True).over(ahead)
    at = a["v"] + (b["v"] - a["v"]) * safe_divide((F.col(along) - a["t"]).cast("double"), (b["t"] - a["t"]).cast("double"))
    return points.withColumn("filled", F.coalesce(value, at, a["v"], b["v"]))


def nearest(points: DataFrame, targets: DataFrame, key: str, value: str) -> DataFrame:
    """For each point the target of its key with the least |difference|, then least id: candidates are the neighbours in order.

    points, targets: (key, id, value). Sorting both together leaves two candidates a point, so no pairs are formed.
    """
    both = points.select(key, "id", value, F.lit(0).alias("_t")).unionByName(targets.select(key, "id", value, F.lit(1).alias("_t")))
    w = Window.partitionBy(key).orderBy(value, F.col("_t").desc(), "id")
    up = Window.partitionBy(key).orderBy(F.col(value).desc(), F.col("_t").desc(), "id")
    t = F.when(F.col("_t") == 1, F.struct(F.col(value).alias("v"), F.col("id").alias("id")))
    # of equal targets the one of least id is wanted, so ids are made equal first
    least = both.withColumn("id", F.when(F.col("_t") == 1, F.min(F.when(F.col("_t") == 1, F.col("id"))).over(Window.partitionBy(key, value))).otherwise(F.col("id")))
    seen = least.withColumns({"_a": F.last(t, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.last(t, True).over(up.rowsBetween(Window.unboundedPreceding, 0))}).where("_t = 0")
    da, db = F.col(value) - F.col("_a.v"), F.col("_b.v") - F.col(value)
    pick = F.when(F.col("_b").isNull() | (da < db) | ((da == db) & (F.col("_a.id") <= F.col("_b.id"))), F.col("_a")).otherwise(F.col("_b"))
    return seen.select(key, "id", F.coalesce(pick, F.col("_b"))["id"].alias("nearest_id"), F.abs(F.col(value) - F.coalesce(pick, F.col("_b"))["v"]).alias("distance"))


def overlapping_circles(circles: DataFrame, key: str, most: int = 1 << 12) -> DataFrame:
    """Pairs a < b of circles (key, id, y, x, r) that overlap.

    Keys of at most so many circles are settled within tasks, so their circles are shuffled once; larger ones, and those with places or radii that aren't
    finite, go by grids. circles is read twice, once for the keys' sizes.
    """
    kind = dict(circles.dtypes)["id"]
    if kind not in ("bigint", "int", "string"):
        return _overlapping_by_grids(circles, key)
    all_, far = circles.select(key, "id", *[F.col(c).cast("double").alias(c) for c in ("y", "x", "r")]).dropna(), F.lit(float("inf"))
    odd = F.greatest(*[F.abs(c) for c in ("y", "x", "r")]) >= far  # so is what isn't a number
    small, large = chunks.halves(all_, [key], Scratch(circles.sparkSession, "overlaps"), "all", most, F.when(odd, most + 1).otherwise(1))
    found = chunks.by_key(small, [key], ["y"], chunks.overlapping_circles, f"a {kind}, b {kind}", 1 << 16)
    return found if large is None else found.union(_overlapping_by_grids(large, key))


def _overlapping_by_grids(circles: DataFrame, key: str) -> DataFrame:
    """Pairs of overlapping_circles() by way of grids whose cells halve from level to level.

    A circle's level has the narrowest cells, from the largest diameter of its key down, that are no narrower than the circle. It
    is looked for in its cell there and the eight around it, and stands by its centre in the grids of all wider circles, so a
    pair meets at the level of its wider circle and one large circle doesn't widen the cells of small ones.
    """
    wide = circles.groupBy(key).agg((2 * F.max("r")).alias("_w")).where("_w > 0")
    level = F.when(F.col("r") > 0, F.least(F.floor(F.log2(F.col("_w") / (2 * F.col("r"))) - 1e-9), F.lit(40))).otherwise(40)
    placed = circles.join(wide, key).withColumn("_l", F.greatest(level, F.lit(0)).cast("int"))
    levels = placed.groupBy(key).agg(F.collect_set("_l").alias("_all"))  # 41 at most

    def cell(n: str) -> Column:
        return F.floor(F.col(n) * F.pow(F.lit(2.0), "_g") / F.col("_w"))

    stands = placed.join(levels, key).withColumn("_g", F.explode(F.filter("_all", lambda g: g <= F.col("_l"))))
    a = stands.select(key, F.col("id").alias("a"), F.col("y").alias("ay"), F.col("x").alias("ax"), F.col("r").alias("ar"), F.col("_l").alias("_la"), "_g", cell("y").alias("_cy"), cell("x").alias("_cx"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = placed.withColumn("_g", F.col("_l")).withColumn("_s", F.explode(steps)).select(key, F.col("id").alias("b"), F.col("y").alias("by"), F.col("x").alias("bx"), F.col("r").alias("br"), "_g", (cell("y") + F.col("_s.i")).alias("_cy"), (cell("x") + F.col("_s.j")).alias("_cx"))
    near = a.join(b, [key, "_g", "_cy", "_cx"]).where((F.col("_la") > F.col("_g")) & (F.col("a") != F.col("b")) | (F.col("a") < F.col("b")))
    met = near.where(F.hypot(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx")) < F.col("ar") + F.col("br"))
    return met.select(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def degrees(edges: DataFrame, key: str) -> DataFrame:
    """Tips (degree 1) and branch points (over 2) of undirected edges (key, src, dst); a loop counts twice."""
    ends = edges.select(key, F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy(key, "node").agg(F.count("*").alias("d")).groupBy(key).agg(F.count_if(F.col("d") == 1).alias("tips"), F.count_if(F.col("d") > 2).alias("branches"), F.count("*").alias("nodes"))


def pruned_edges(edges: DataFrame, key: str, least: float) -> DataFrame:
    """Without the edges from an end to a branch point that are at most least long."""
    return edges.where(~((F.col("kind") == "end-to-brh") & (F.col("length") <= least)))


def kept_contours(contours: DataFrame, shortest: float, longest: float) -> DataFrame:
    return contours.where((F.col("length") >= shortest) & ((F.lit(longest) <= 0) | (F.col("length") <= longest)))


def kept_junctions(junctions: DataFrame, removed: DataFrame) -> DataFrame:
    """Junctions neither of whose contours was removed."""
    one = removed.select("image_id", F.col("contour_id").alias("cont1"))
    two = removed.select("image_id", F.col("contour_id").alias("cont2"))
    return junctions.join(one, ["image_id", "cont1"], "left_anti").join(two, ["image_id", "cont2"], "left_anti")


def growth_unit(length: Column, tips: Column, branches: Column) -> Column:
    return safe_divide(2 * length, (tips + branches).cast("double"))


def interpolated_table(points: DataFrame, table: DataFrame) -> DataFrame:
    """points (id, u, v with whole-number grid) with value: bilinear between the corners of table (i, j, value), which is small by
    construction (a few thousand corners) and so is broadcast after its size is known."""
    at = points.withColumns({"_i": F.floor("u").cast("int"), "_j": F.floor("v").cast("int")}).withColumns({"_a": F.col("u") - F.col("_i"), "_b": F.col("v") - F.col("_j")})
    corner = F.explode(F.array(*[F.struct((F.col("_i") + i).alias("i"), (F.col("_j") + j).alias("j"), ((F.col("_a") if i else 1 - F.col("_a")) * (F.col("_b") if j else 1 - F.col("_b"))).alias("w")) for i in (0, 1) for j in (0, 1)]))
    return at.withColumn("_c", corner).select("id", "_c.*").join(table, ["i", "j"]).groupBy("id").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


#: Width-bias tables have a value every tenth of a width over sigma from 2 to 6 and every twentieth of a gradients' ratio from 0 to 1.
WIDTHS, RATIOS = (2.0, 6.0, 10), (0.0, 1.0, 20)
#: The third axis of such a table; all but the asymmetry are in units of sigma.
QUANTITIES = ("width", "asymmetry", "correction", "strong", "weak")


def line_corrections(lines: DataFrame, table: DataFrame) -> DataFrame:
    """lines (id, sigma, width, ratio) with the true values that table (ratio_step, width_step, quantity, value) gives for them.

    Values are bilinear between the four corners around a line, all quantities from one join and one aggregation; the last steps go with the
    cells before them. Outside the table's range all are 0, and so is a corner that the table lacks.
    """
    (low_w, high_w, per_w), (low_r, high_r, per_r) = WIDTHS, RATIOS
    scaled = lines.withColumn("_w", F.col("width") / F.col("sigma"))
    inside = F.col("_w").between(low_w, high_w) & F.col("ratio").between(low_r, high_r)
    u, v = (F.col("ratio") - low_r) * per_r, (F.col("_w") - low_w) * per_w
    i, j = F.least(F.floor(u), F.lit(int((high_r - low_r) * per_r) - 1)), F.least(F.floor(v), F.lit(int((high_w - low_w) * per_w) - 1))
    at = scaled.where(inside).withColumns({"_i": i.cast("int"), "_j": j.cast("int"), "_a": v - j, "_b": u - i})
    corners = F.explode(F.array(*[F.struct((F.col("_i") + p).alias("ratio_step"), (F.col("_j") + q).alias("width_step"), ((F.col("_b") if p else 1 - F.col("_b")) * (F.col("_a") if q else 1 - F.col("_a"))).alias("share")) for p in (0, 1) for q in (0, 1)]))
    met = at.select("id", "sigma", corners.alias("c")).select("id", "sigma", "c.*").join(table, ["ratio_step", "width_step"])
    unit = F.when(F.col("quantity") == QUANTITIES[1], 1.0).otherwise(F.col("sigma"))
    found = met.groupBy("id").agg(*[F.sum(F.when(F.col("quantity") == q, F.col("share") * F.col("value") * unit)).alias(f"_{q}") for q in QUANTITIES])
    return lines.join(found, "id", "left").select(*lines.columns, *[F.coalesce(f"_{q}", F.lit(0.0)).alias(f"true_{q}") for q in QUANTITIES])
