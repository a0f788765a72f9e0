"""All queries of the engine with their DuckDB counterparts.

The tables at hand hold no images, so the 64 numbers of an embedding stand for an 8 x 8 raster, rows of lineitem for measured
regions, and events for the points of paths. Floating results are rounded to six places on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import graphs, order, raster as R, tabular as T, tensor
from ..sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SIDE = 8


def query(sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return keep


def r6(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def images(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))


def near(dy: int, dx: int) -> str:
    """SQL for a neighbour in list e at position i (from 0), nearest or reflected by one pixel: the same value."""
    return f"e[greatest(0, least(7, i // 8 + ({dy}))) * 8 + greatest(0, least(7, i % 8 + ({dx}))) + 1]"


def folded(d: int, by: str) -> str:
    j = f"({by} + ({d}))"
    return f"(CASE WHEN {j} < 0 THEN -1 - {j} WHEN {j} > 7 THEN 15 - {j} ELSE {j} END)"


PIXELS = "px AS (SELECT vec_id AS image_id, label, embedding::DOUBLE[] AS e, unnest(range(64)) AS i FROM embeddings)"
GX = " + ".join(f"({k}) * {near(y - 1, x - 1)}" for y, row in enumerate(R.SOBEL_X) for x, k in enumerate(row) if k)
GY = " + ".join(f"({k}) * {near(y - 1, x - 1)}" for y, row in enumerate(R.SOBEL_Y) for x, k in enumerate(row) if k)
GRADIENTS = f"{PIXELS}, g AS (SELECT image_id, label, i, {GX} AS gx, {GY} AS gy FROM px)"
MEANS = f"{GRADIENTS}, t AS (SELECT image_id, label, avg(gx * gx) AS xx, avg(gx * gy) AS xy, avg(gy * gy) AS yy FROM g GROUP BY ALL)"
ANGLES = f"{GRADIENTS}, a AS (SELECT image_id, label, 0.5 * atan2(2 * gx * gy, gy * gy - gx * gx) AS a FROM g)"
ALIGN = "sqrt((yy - xx) * (yy - xx) + 4 * xy * xy) / (xx + yy + 1e-10)"


def tensors(spark: SparkSession, sf: str) -> DataFrame:
    return tensor.tensor_means(tensor.gradients(images(spark, sf), "v", SIDE, SIDE))


@query(f"WITH {MEANS} SELECT image_id, round({ALIGN}, 6) AS alignment FROM t")
def tensor_alignment(spark, sf):
    return tensors(spark, sf).select("image_id", r6(tensor.alignment(), "alignment"))


@query(f"WITH {MEANS} SELECT image_id, round(degrees(0.5 * atan2(2 * xy, yy - xx)), 6) AS direction FROM t")
def mean_orientation(spark, sf):
    return tensors(spark, sf).select("image_id", r6(tensor.mean_direction_degrees(), "direction"))


def angles(spark: SparkSession, sf: str) -> DataFrame:
    return tensor.gradients(images(spark, sf), "v", SIDE, SIDE).withColumn("angles", tensor.directions())


@query(f"WITH {ANGLES} SELECT image_id, round(1 - sqrt(avg(cos(2 * a)) ** 2 + avg(sin(2 * a)) ** 2), 6) AS variance FROM a GROUP BY image_id")
def circular_variance(spark, sf):
    return angles(spark, sf).select("image_id", r6(tensor.circular_variance("angles"), "variance"))


BIN = "least({n} - 1, floor((a + pi() / 2) / pi() * {n}))"


@query(f"WITH {ANGLES}, h AS (SELECT image_id, {BIN.format(n=180)} AS b, count(*) / 64.0::DOUBLE AS p FROM a GROUP BY ALL) SELECT image_id, round(1 / (sqrt(greatest(sum(p * ln(p * 180)), 0)) + 1), 6) AS randomness FROM h GROUP BY image_id")
def orientation_randomness(spark, sf):
    return angles(spark, sf).select("image_id", r6(tensor.randomness("angles"), "randomness"))


@query(f"WITH {ANGLES} SELECT label, {BIN.format(n=8)}::INT AS bin, count(*) AS n FROM a GROUP BY ALL")
def angular_hist(spark, sf):
    return angles(spark, sf).select("label", F.explode(tensor.angle_bins("angles", 8)).alias("bin")).groupBy("label", "bin").agg(F.count("*").alias("n"))


@query(f"WITH {ANGLES.replace('label, 0.5', 'i, 0.5')} SELECT image_id, (i // 8 // 4)::INT AS by, (i % 8 // 4)::INT AS bx, round(avg(cos(2 * a)), 6) AS c, round(avg(sin(2 * a)), 6) AS s, round(max(a), 6) AS most FROM a GROUP BY ALL")
def block_directions(spark, sf):
    return tensor.block_directions(angles(spark, sf), "angles", SIDE, SIDE, 4).select("image_id", "by", "bx", r6("c", "c"), r6("s", "s"), r6("most", "most"))


def per_label(spark: SparkSession, sf: str) -> DataFrame:
    a = tensor.tensor_means(angles(spark, sf)).select("image_id", "label", tensor.alignment().alias("alignment"), tensor.circular_variance("angles").alias("variance"))
    return T.group_statistics(a, ["label"], ["alignment", "variance"], "image_id")


@query(
    f"""WITH {MEANS}, a AS (SELECT image_id, label, {ALIGN} AS al FROM t), b AS (SELECT image_id, 1 - sqrt(avg(cos(2 * q)) ** 2 + avg(sin(2 * q)) ** 2) AS va FROM (SELECT image_id, 0.5 * atan2(2 * gx * gy, gy * gy - gx * gx) AS q FROM g) GROUP BY image_id),
s AS (SELECT label, count(*) AS n, avg(al) AS am, stddev_pop(al) AS sd, stddev_pop(al) / sqrt(count(al)) AS se, avg(va) AS vm FROM a JOIN b USING (image_id) GROUP BY label),
w AS (SELECT avg(am) AS ma, stddev_pop(am) AS sa, avg(vm) AS mv, stddev_pop(vm) AS sv FROM s)
SELECT label, n AS n_rois, round(am, 6) AS alignment_mean, round(sd, 6) AS alignment_std, round(se, 6) AS alignment_sem, round(vm, 6) AS variance_mean, round(CASE WHEN sa = 0 THEN 0 ELSE (am - ma) / sa END, 6) AS z_alignment, round(CASE WHEN sv = 0 THEN 0 ELSE (vm - mv) / sv END, 6) AS z_variance FROM s, w"""
)
def label_orientation_scores(spark, sf):
    z = T.with_z_scores(per_label(spark, sf), ["alignment_mean", "variance_mean"])
    return z.select("label", "n_rois", r6("alignment_mean", "alignment_mean"), r6("alignment_std", "alignment_std"), r6("alignment_sem", "alignment_sem"), r6("variance_mean", "variance_mean"), r6("z_alignment_mean", "z_alignment"), r6("z_variance_mean", "z_variance"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return label_orientation_scores(spark, sf)


# ---- tables of metrics


@query(
    "SELECT l_suppkey, count(*) AS n_rois, arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) AS tissue, round(avg(l_extendedprice), 6) AS price_mean, round(stddev_pop(l_extendedprice), 6) AS price_std, round(stddev_pop(l_extendedprice) / sqrt(count(l_extendedprice)), 6) AS price_sem, round(avg(l_discount), 6) AS discount_mean FROM lineitem GROUP BY l_suppkey"
)
def patient_mean_std_sem(spark, sf):
    li = tables.table(spark, sf, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("tissue"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    g = T.group_statistics(li, ["l_suppkey"], ["price", "discount"], "ordinal", ["tissue"])
    return g.select("l_suppkey", "n_rois", "tissue", *[r6(c, c) for c in ("price_mean", "price_std", "price_sem", "discount_mean")])


METRICS = "m AS (SELECT l_suppkey, avg(l_quantity) AS q, avg(l_extendedprice) AS p, avg(l_discount) AS d, avg(l_tax) AS t, count(*)::DOUBLE AS n, max(l_extendedprice) AS x FROM lineitem GROUP BY l_suppkey)"


def supplier_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("p"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.count("*").cast("double").alias("n"), F.max("l_extendedprice").alias("x"))


def _z(c: str) -> str:
    return f"(CASE WHEN stddev_pop({c}) OVER () = 0 THEN 0 ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END)"


@query(f"WITH {METRICS} SELECT l_suppkey, round({_z('p')} - {_z('q')} + {_z('d')} + {_z('t')} - {_z('n')}, 6) AS rigidity, round({_z('p')} + {_z('d')} + {_z('t')} + {_z('x')} - {_z('n')}, 6) AS bundling FROM m")
def zscore_scores(spark, sf):
    s = T.composite_scores(supplier_metrics(spark, sf), "q", "d", "t", "n", "p", "x")
    return s.select("l_suppkey", r6("rigidity", "rigidity"), r6("bundling", "bundling"))


SUMMARY = "SELECT l_suppkey, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd, quantile_cont(l_extendedprice, 0.05) AS p5, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.95) AS p95, count(*) AS n, avg(sqrt(l_extendedprice / pi())) AS mr, stddev_pop(sqrt(l_extendedprice / pi())) AS sr FROM lineitem GROUP BY l_suppkey"


@query(f"SELECT l_suppkey, round(m, 6) AS area_mean, round(sd, 6) AS area_std, round(p5, 6) AS p5, round(p50, 6) AS median, round(p95, 6) AS p95, n AS n_gaps FROM ({SUMMARY})")
def gap_summary_percentiles(spark, sf):
    s = T.area_summary(tables.table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return s.select("l_suppkey", *[r6(c, c) for c in ("area_mean", "area_std", "p5", "median", "p95")], "n_gaps")


@query(f"SELECT l_suppkey, round(sqrt(m / pi()), 6) AS radius_of_mean, round(mr, 6) AS mean_radius, round(sr, 6) AS radius_std FROM ({SUMMARY})")
def gap_radius_batch_vs_single(spark, sf):
    s = T.area_summary(tables.table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return s.select("l_suppkey", *[r6(c, c) for c in ("radius_of_mean", "mean_radius", "radius_std")])


GRID = "cells AS (SELECT DISTINCT l_suppkey, (l_partkey * 7 % 64)::INT AS y, (l_orderkey * 13 % 64)::INT AS x FROM lineitem)"


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_partkey") * 7 % 64).cast("int").alias("y"), (F.col("l_orderkey") * 13 % 64).cast("int").alias("x")).distinct()


@query(f"WITH {GRID}, x AS (SELECT l_suppkey, k, (y // k) * 64 + x // k AS box, count(*) AS cells FROM cells, (SELECT unnest([4, 8, 16, 32]) AS k) GROUP BY ALL), b AS (SELECT l_suppkey, k, greatest(count(*) FILTER (WHERE cells < k * k), 1e-10::DOUBLE) AS n FROM x GROUP BY ALL) SELECT l_suppkey, round(-regr_slope(ln(n), ln(k)), 6) AS dimension FROM b GROUP BY l_suppkey")
def box_count_fractal(spark, sf):
    return T.fractal_dimension(grid(spark, sf), "l_suppkey", [4, 8, 16, 32]).select("l_suppkey", r6("dimension", "dimension"))


FRACTION = "f AS (SELECT image_id, label, avg((e[i + 1] > 0.1)::INT::DOUBLE) AS m FROM px GROUP BY ALL)"


def with_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return images(spark, sf).withColumn("m", R.fraction(F.col("v"), lambda v: v > 0.1))


@query(f"WITH {PIXELS}, {FRACTION} SELECT image_id, round(CASE WHEN m = 0 THEN 0 ELSE abs(1 / m - 2) END, 6) AS lacunarity FROM f")
def lacunarity(spark, sf):
    return with_fraction(spark, sf).select("image_id", r6(R.lacunarity(F.col("m")), "lacunarity"))


@query(f"WITH {PIXELS}, {FRACTION}, q AS (SELECT *, CASE WHEN m = 0 THEN 0 ELSE abs(1 / m - 2) END AS l, m * 64 * 0.5 / 64 AS rho FROM f), w AS (SELECT *, CASE WHEN rho = 0 THEN 0 ELSE (1 - rho) / rho END AS o FROM q) SELECT image_id, round(CASE WHEN o = 0 THEN 0 ELSE (l - 1) / o END, 6) AS normalized FROM w")
def normalized_lacunarity(spark, sf):
    return with_fraction(spark, sf).select("image_id", r6(scalar.normalized_lacunarity(R.lacunarity(F.col("m")), F.col("m") * 64, F.lit(0.5), F.lit(64.0)), "normalized"))


@query(f"WITH {PIXELS}, {FRACTION} SELECT label, round(avg(m), 6) AS fraction, round(min(m), 6) AS least FROM f GROUP BY label")
def area_fraction(spark, sf):
    return with_fraction(spark, sf).groupBy("label").agg(r6(F.avg("m"), "fraction"), r6(F.min("m"), "least"))


@query(f"WITH {PIXELS} SELECT image_id, round(coalesce(avg(e[i + 1]) FILTER (WHERE e[i + 1] > 0.25), 0), 6) AS intensity FROM px GROUP BY image_id")
def masked_intensity(spark, sf):
    some = F.filter("v", lambda v: v > 0.25)
    return images(spark, sf).select("image_id", r6(F.when(F.size(some) == 0, F.lit(0.0)).otherwise(R.mean(some)), "intensity"))


LIMITS = "lim AS (SELECT image_id, e, quantile_cont(e[i + 1], 0.02) AS lo, quantile_cont(e[i + 1], 0.98) AS hi, min(e[i + 1]) AS mn, max(e[i + 1]) AS mx FROM px GROUP BY ALL), v AS (SELECT *, unnest(e) AS x, unnest(range(64))::INT AS i FROM lim)"


def with_limits(spark: SparkSession, sf: str) -> DataFrame:
    return images(spark, sf).withColumns({"lo": R.percentile(F.col("v"), 0.02), "hi": R.percentile(F.col("v"), 0.98)})


@query(f"WITH {PIXELS}, {LIMITS} SELECT image_id, i, round(least(1, greatest(0, (x - lo) / (hi - lo + 1e-20))), 6) AS v FROM v")
def percentile_normalize(spark, sf):
    return with_limits(spark, sf).select("image_id", F.posexplode(R.percentile_normalize(F.col("v"), F.col("lo"), F.col("hi"))).alias("i", "v")).select("image_id", "i", r6("v", "v"))


@query(f"WITH {PIXELS}, {LIMITS} SELECT image_id, sum(CASE WHEN hi = lo THEN 0 ELSE trunc((least(hi, greatest(lo, x)) - lo) / (hi - lo) * 255) END)::BIGINT AS total FROM v GROUP BY image_id")
def clip16to8(spark, sf):
    return with_limits(spark, sf).select("image_id", F.aggregate(R.clip_to_8bit(F.col("v"), F.col("lo"), F.col("hi")), F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


@query(f"WITH {PIXELS}, {LIMITS} SELECT image_id, i, (CASE WHEN mx = mn THEN 0 ELSE trunc((x - mn) / (mx - mn) * 255) END)::INT AS v FROM v")
def minmax_uint8(spark, sf):
    return images(spark, sf).select("image_id", F.posexplode(R.minmax_8bit(F.col("v"))).alias("i", "v"))


@query(
    f"""WITH {PIXELS}, c AS (SELECT image_id, greatest(0, least(e[i + 1]::DOUBLE, 0.3::DOUBLE)) AS x FROM px), m AS (SELECT image_id, min(x) AS a, max(x) AS b FROM c GROUP BY image_id),
f AS (SELECT image_id, trunc((x - a) / (b - a + 2.220446049250313e-16) * 255) AS x FROM c JOIN m USING (image_id)), l AS (SELECT image_id, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM f GROUP BY image_id)
SELECT image_id, round(avg((255 - CASE WHEN lo = hi THEN x ELSE trunc((least(hi, greatest(lo, x)) - lo) / (hi - lo + 2.220446049250313e-16) * 255) END > 0)::INT::DOUBLE), 6) AS fraction FROM f JOIN l USING (image_id) GROUP BY image_id"""
)
def hdm_fraction(spark, sf):
    return images(spark, sf).withColumn("c", R.hdm_contrast(F.col("v"), 0.3, 0.1, dark=True)).select("image_id", r6(R.fraction(F.col("c"), lambda v: v > 0), "fraction"))


@query(f"WITH {PIXELS}, b AS (SELECT image_id, avg((e[i + 1] > 0.2)::INT::DOUBLE) AS bright FROM px GROUP BY image_id) SELECT image_id, bright > 0.01 AS eligible FROM b")
def eligible_images(spark, sf):
    im = images(spark, sf).withColumn("b", R.fraction(F.col("v"), lambda v: v > 0.2))
    return im.select("image_id", T.eligible(F.lit(8), F.lit(8), F.col("b"), 4, 0.01).alias("eligible"))


# ---- stencils

GAUSS = R.gaussian(1.0, radius=2)
_ROWS = " + ".join(f"{k!r}::DOUBLE * e[{folded(d - 2, '(i // 8)')} * 8 + i % 8 + 1]" for d, k in enumerate(GAUSS))
_COLUMNS = " + ".join(f"{k!r}::DOUBLE * s[i // 8 * 8 + {folded(d - 2, '(i % 8)')} + 1]" for d, k in enumerate(GAUSS))


@query(f"WITH {PIXELS}, a AS (SELECT image_id, list({_ROWS} ORDER BY i) AS s FROM px GROUP BY image_id), b AS (SELECT image_id, s, unnest(range(64)) AS i FROM a) SELECT image_id, i::INT AS i, round({_COLUMNS}, 6) AS v FROM b")
def gauss_blur(spark, sf):
    a = images(spark, sf).withColumn("s", R.pass_rows(F.col("v"), GAUSS, SIDE, SIDE, "reflect")).withColumn("b", R.pass_columns(F.col("s"), GAUSS, SIDE, SIDE, "reflect"))
    return a.select("image_id", F.posexplode("b").alias("i", "v")).select("image_id", "i", r6("v", "v"))


@query(f"WITH {GRADIENTS} SELECT image_id, i::INT AS i, round(gx, 6) AS gx, round(gy, 6) AS gy FROM g")
def sobel(spark, sf):
    g = tensor.gradients(images(spark, sf), "v", SIDE, SIDE)
    return g.select("image_id", F.posexplode(F.arrays_zip("gx", "gy")).alias("i", "g")).select("image_id", "i", r6("g.gx", "gx"), r6("g.gy", "gy"))


_NINE = ", ".join(near(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1))


@query(f"WITH {PIXELS} SELECT image_id, i::INT AS i, round(greatest({_NINE}), 6) AS top, round(least({_NINE}), 6) AS low FROM px")
def dilate(spark, sf):
    both = images(spark, sf).select("image_id", R.box(F.col("v"), F.greatest, 1, SIDE, SIDE).alias("t"), R.box(F.col("v"), F.least, 1, SIDE, SIDE).alias("l"))
    return both.select("image_id", F.posexplode(F.arrays_zip("t", "l")).alias("i", "p")).select("image_id", "i", r6("p.t", "top"), r6("p.l", "low"))


@query(f"WITH {PIXELS} SELECT image_id, i::INT AS i FROM px WHERE e[i + 1] >= greatest({_NINE}) AND e[i + 1] > 0.1")
def local_maxima(spark, sf):
    m = images(spark, sf).select("image_id", F.posexplode(R.local_maxima(F.col("v"), SIDE, SIDE, 1, 0.1)).alias("i", "p"))
    return m.where("p = 1").select("image_id", "i")


_AROUND = " + ".join(f"(CASE WHEN i // 8 + ({y}) BETWEEN 0 AND 7 AND i % 8 + ({x}) BETWEEN 0 AND 7 THEN ({near(y, x)} > 0.1)::INT ELSE 0 END)" for y in (-1, 0, 1) for x in (-1, 0, 1) if y or x)


@query(f"WITH {PIXELS} SELECT image_id, i::INT AS i, ({_AROUND})::INT AS n FROM px WHERE e[i + 1] > 0.1")
def neighbour_counts(spark, sf):
    mask = images(spark, sf).withColumn("b", F.transform("v", lambda v: (v > 0.1).cast("int")))
    n = mask.select("image_id", F.posexplode(F.arrays_zip("b", R.neighbour_count(F.col("b"), SIDE, SIDE).alias("n"))).alias("i", "p"))
    return n.where("p.b = 1").select("image_id", "i", F.col("p.n").cast("int").alias("n"))


_AXX, _AXY, _AYY = (f"({near(0, 1)} - 2 * {near(0, 0)} + {near(0, -1)})", f"(({near(1, 1)} - {near(1, -1)} - {near(-1, 1)} + {near(-1, -1)}) / 4)", f"({near(1, 0)} - 2 * {near(0, 0)} + {near(-1, 0)})")


@query(f"WITH {PIXELS}, h AS (SELECT image_id, i, {_AXX} AS a, {_AXY} AS b, {_AYY} AS c FROM px), m AS (SELECT *, (a + c) / 2 AS mid, sqrt((a - c) * (a - c) / 4 + b * b) AS off FROM h) SELECT image_id, round(max(CASE WHEN mid >= 0 THEN mid + off ELSE mid - off END), 6) AS strongest, round(min(CASE WHEN mid >= 0 THEN mid + off ELSE mid - off END), 6) AS weakest FROM m GROUP BY image_id")
def hessian_eigen(spark, sf):
    kernels = {"a": ((1, -2, 1),), "b": ((0.25, 0, -0.25), (0, 0, 0), (-0.25, 0, 0.25)), "c": ((1,), (-2,), (1,))}
    h = images(spark, sf).withColumns({k: R.convolve(F.col("v"), m, SIDE, SIDE, "nearest") for k, m in kernels.items()})
    first = F.transform(F.arrays_zip("a", "b", "c"), lambda t: scalar.symmetric_eigen(t["a"], t["b"], t["c"])[0])
    return h.withColumn("e", first).select("image_id", r6(F.array_max("e"), "strongest"), r6(F.array_min("e"), "weakest"))


@query(f"WITH {PIXELS} SELECT image_id, round(avg(e[i + 1]), 6) AS middle FROM px WHERE i // 8 BETWEEN 2 AND 5 AND i % 8 BETWEEN 2 AND 5 GROUP BY image_id")
def center_crop(spark, sf):
    return images(spark, sf).select("image_id", r6(R.mean(R.crop_center(F.col("v"), SIDE, SIDE, 4, 4)), "middle"))


# ---- colours, from three numbers of each row

RGB = "c AS (SELECT l_orderkey, l_linenumber, (l_partkey % 256)::DOUBLE AS r, (l_suppkey * 7 % 256)::DOUBLE AS g, (l_orderkey % 256)::DOUBLE AS b FROM lineitem)"


def colours(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 256).cast("double").alias("r"), (F.col("l_suppkey") * 7 % 256).cast("double").alias("g"), (F.col("l_orderkey") % 256).cast("double").alias("b"))


@query(f"WITH {RGB} SELECT l_orderkey, l_linenumber, round(0.299 * r + 0.587 * g + 0.114 * b, 6) AS luma, round(0.2125 * r + 0.7154 * g + 0.0721 * b, 6) AS linear FROM c")
def gray_luma(spark, sf):
    rgb = [F.col(k) for k in "rgb"]
    return colours(spark, sf).select("l_orderkey", "l_linenumber", r6(scalar.luma(*rgb), "luma"), r6(scalar.luma_linear(*rgb), "linear"))


HSV = f"{RGB}, t AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS sp FROM c), h AS (SELECT *, CASE WHEN sp = 0 THEN 0 WHEN hi = r THEN (CASE WHEN (g - b) / sp < 0 THEN (g - b) / sp + 6 ELSE (g - b) / sp END) / 6 WHEN hi = g THEN ((b - r) / sp + 2) / 6 ELSE ((r - g) / sp + 4) / 6 END AS hue, CASE WHEN hi = 0 THEN 0 ELSE sp / hi END AS sat, hi / 255 AS val FROM t)"


def _density(x: str, mu: float, sd: float) -> str:
    return f"exp(-1 * (({x} - {mu!r}::DOUBLE) ** 2) / (2 * {sd}::DOUBLE ** 2)) / ({sd}::DOUBLE * sqrt(2 * pi()))"


@query(f"WITH {HSV} SELECT l_orderkey, l_linenumber, round({_density('hue', 0.96, 0.1)} * {_density('sat', 160 / 255, 0.3)} * {_density('val', 200 / 255, 0.5)}, 6) AS closeness FROM h")
def hue_distance(spark, sf):
    h, s, v = scalar.hsv(*[F.col(k) for k in "rgb"])
    return colours(spark, sf).withColumns({"h": h, "s": s, "v": v}).select("l_orderkey", "l_linenumber", r6(scalar.hue_closeness(F.col("h"), F.col("s"), F.col("v"), F.lit(0.96), F.lit(False)), "closeness"))


_U = scalar.UNMIX
_FLOOR = math.log(1e-6)
_OD = [f"(ln(greatest({k} / 255, 1e-6)) / ({_FLOOR!r}::DOUBLE))" for k in "rgb"]


@query(f"WITH {RGB}, e AS (SELECT l_orderkey, l_linenumber, greatest(0, {_OD[0]} * ({_U[0][1]!r}::DOUBLE) + {_OD[1]} * ({_U[1][1]!r}::DOUBLE) + {_OD[2]} * ({_U[2][1]!r}::DOUBLE)) AS eo FROM c) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(least(1, exp(eo * {scalar.STAINS[1][k]}::DOUBLE * ({_FLOOR!r}::DOUBLE))), 6) AS {n}" for k, n in enumerate(("red", "green", "blue"))) + " FROM e")
def stain_unmix(spark, sf):
    out = scalar.eosin_only(*[F.col(k) for k in "rgb"])
    return colours(spark, sf).select("l_orderkey", "l_linenumber", *[r6(c, n) for c, n in zip(out, ("red", "green", "blue"), strict=True)])


@query(f"WITH {RGB} SELECT l_linenumber AS segment, trunc(avg(r))::INT AS red, trunc(avg(g))::INT AS green, trunc(avg(b))::INT AS blue, count(DISTINCT r)::BIGINT AS shades FROM c GROUP BY l_linenumber")
def segment_colours(spark, sf):
    return colours(spark, sf).groupBy(F.col("l_linenumber").alias("segment")).agg(*[F.avg(k).cast("int").alias(n) for k, n in zip("rgb", ("red", "green", "blue"), strict=True)], F.count_distinct("r").alias("shades"))


@query(f"WITH {RGB} SELECT l_orderkey, l_linenumber, (CASE WHEN r > 128 THEN r ELSE 228 END)::INT AS red, (CASE WHEN r > 128 THEN g ELSE 228 END)::INT AS green FROM c")
def roi_composite(spark, sf):
    inside = F.col("r") > 128
    return colours(spark, sf).select("l_orderkey", "l_linenumber", *[F.when(inside, F.col(k)).otherwise(228).cast("int").alias(n) for k, n in (("r", "red"), ("g", "green"))])


ERODED = "least(" + ", ".join(f"(CASE WHEN {near(y, x)} > 0 THEN 1 ELSE 0 END)" for y in (-1, 0, 1) for x in (-1, 0, 1)) + ")"


@query(f"WITH {PIXELS}, m AS (SELECT image_id, i, e[i + 1] AS v, {ERODED} AS inside FROM px) SELECT image_id, sum(inside)::BIGINT AS inside, round(sum(CASE WHEN inside = 1 THEN v ELSE 0 END), 6) AS kept, round(sum(CASE WHEN inside = 1 THEN v ELSE 228 END), 6) AS composed FROM m GROUP BY image_id")
def roi_eroded_composite(spark, sf):
    """Pixels of a region that its background, grown by one pixel, leaves; the others are 0 or the neutral grey."""
    mask = R.eroded(F.transform("v", lambda v: F.when(v > 0, 1).otherwise(0)), SIDE, SIDE)
    df = images(spark, sf).select("image_id", "v", mask.alias("m"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    kept, composed = (total(R.composed("v", "m", fill)) for fill in (0.0, 228.0))
    return df.select("image_id", F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + x).alias("inside"), r6(kept, "kept"), r6(composed, "composed"))


# ---- paths of points

POINTS = "p AS (SELECT user_id, event_id, ts, value AS y, (event_id % 97)::DOUBLE AS x FROM events)"


def points(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "events").select("user_id", "event_id", "ts", F.col("value").alias("y"), (F.col("event_id") % 97).cast("double").alias("x"))


@query(
    f"WITH {POINTS}, d AS (SELECT *, y - lag(y, 3) OVER w AS y0, x - lag(x, 3) OVER w AS x0, lead(y, 3) OVER w - y AS y1, lead(x, 3) OVER w - x AS x1 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, round(degrees(abs(atan2(x0 * y1 - y0 * x1, y0 * y1 + x0 * x1))), 6) AS angle FROM d"
)
def curvature_path(spark, sf):
    return T.curvature(points(spark, sf), "user_id", ["ts", "event_id"], "y", "x", 3).select("user_id", "event_id", r6("angle", "angle"))


@query(f"WITH {POINTS}, d AS (SELECT *, sqrt((y - lag(y) OVER w) ** 2 + (x - lag(x) OVER w) ** 2) AS s FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, round(coalesce(sum(s), 0), 6) AS length, count(*) AS n_points FROM d GROUP BY user_id")
def path_length(spark, sf):
    return T.path_lengths(points(spark, sf), "user_id", ["ts", "event_id"], "y", "x").select("user_id", r6("length", "length"), "n_points")


@query(
    f"""WITH {POINTS}, m AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 3 <> 0 THEN y END AS y, event_id AS t FROM p),
w AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER b AS ta, last_value(y IGNORE NULLS) OVER b AS ya, first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER a AS tb, first_value(y IGNORE NULLS) OVER a AS yb FROM m
WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, round(coalesce(y, ya + (yb - ya) * CASE WHEN tb = ta THEN 0 ELSE (t - ta)::DOUBLE / (tb - ta) END, ya, yb), 6) AS filled FROM w"""
)
def gap_fill(spark, sf):
    p = points(spark, sf).select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("y")).alias("y"))
    return T.gaps_filled(p, "user_id", ["event_id"], "y", "event_id").select("user_id", "event_id", r6("filled", "filled"))


# ---- scans, names, checks


@query("SELECT doc_id, source, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5)::INT AS batch FROM documents")
def split_batches(spark, sf):
    return order.batches(tables.table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 5).drop("batch_no")


@query(
    "WITH n AS (SELECT l_quantity AS res, l_orderkey * 10 + l_linenumber AS path, (row_number() OVER (PARTITION BY l_quantity ORDER BY l_orderkey * 10 + l_linenumber) - 1) // 5 AS b FROM lineitem) SELECT path, res, b::INT AS batch, (dense_rank() OVER (ORDER BY res, b) - 1)::BIGINT AS batch_no FROM n"
)
def batches_in_total_order(spark, sf):
    i = tables.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("path"), F.col("l_quantity").alias("res"))
    return order.batches(i, "res", "path", 5)


def sized_images(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), (F.col("o_orderkey") % 3000 + 100).cast("int").alias("height"), (F.col("o_custkey") % 4000 + 100).cast("int").alias("width"))


@query(
    """WITH s AS (SELECT o_orderkey AS image_id, (o_orderkey % 3000 + 100)::INT AS h, (o_custkey % 4000 + 100)::INT AS w FROM orders), b AS (SELECT *, ceil(h / ceil(h / 2048.0))::INT AS bh, ceil(w / ceil(w / 2048.0))::INT AS bw FROM s),
y AS (SELECT *, unnest(range(0, h, bh)) AS y FROM b), x AS (SELECT *, unnest(range(0, w, bw)) AS x FROM y) SELECT image_id, (y // bh)::INT AS i, (x // bw)::INT AS j, least(y, h - bh)::INT AS y0, least(x, w - bw)::INT AS x0, bh AS tile_h, bw AS tile_w FROM x"""
)
def tiling(spark, sf):
    return T.tiles(sized_images(spark, sf), 2048)


@query("SELECT bool_or((o_orderkey % 3000 + 100) * (o_custkey % 4000 + 100) > 2048 * 2048) AS any_oversized FROM orders")
def oversize_probe(spark, sf):
    return T.oversized(sized_images(spark, sf), 2048)


#: File names in the forms that scanners give, built of an order's numbers.
NAME = """CASE o_orderkey % 6 WHEN 0 THEN concat('K', o_custkey, '.vsi - 20x_', upper(substr('bfpolxpl', 1, 2)), '_01Annotation (Tumor)_', o_orderkey % 7, '_roi.png')
WHEN 1 THEN concat(o_custkey, '.vsi - 20x_BF multi-band_01Annotation (Ellipse) (Stroma ', o_orderkey % 5, ')_', o_orderkey % 11, '_roi.png')
WHEN 2 THEN concat('K', o_custkey, '.vsi_-_20x_POL_01Annotation_(Tumor)_', o_orderkey % 13, '_roi.png') WHEN 3 THEN concat('S', o_custkey, '.czi_x_Annotation_(Polygon)_', o_orderkey % 17, '_roi.png')
WHEN 4 THEN concat(lower(o_orderstatus), o_custkey, '_def xpl _roi.png') ELSE concat('P', o_custkey, ' ', CASE o_orderkey % 4 WHEN 1 THEN 'green' WHEN 3 THEN 'Yellow' ELSE 'red' END, '_', o_orderkey % 19, '_roi.png') END"""
_SHAPES = ", ".join(f"'{s}'" for s in scalar.SHAPES)


@query(
    rf"""WITH n AS (SELECT o_orderkey, {NAME} AS name FROM orders), g AS (SELECT *, list_transform(regexp_extract_all(regexp_extract(name, '(?i)annotation(.*)$', 1), '\(([^()]+)\)', 1), lambda s: trim(s)) AS gs FROM n), f AS (SELECT *, list_filter(gs, lambda s: lower(s) NOT IN ({_SHAPES})) AS fs FROM g)
SELECT o_orderkey, name, coalesce(nullif(regexp_extract(name, '(?i)^(.+?)\.vsi', 1), ''), nullif(regexp_extract(name, '(?i)^(.+?)\.czi', 1), ''), nullif(regexp_extract(name, '^([^\s_]+)', 1), ''), '') || CASE WHEN lower(name) LIKE '%original%' THEN '_original' WHEN lower(name) LIKE '%red%' THEN '_red' WHEN lower(name) LIKE '%yellow%' THEN '_yellow' WHEN lower(name) LIKE '%green%' THEN '_green' ELSE '' END AS patient_id,
upper(regexp_extract(name, '(?i)[_\s](BF|POL|XPL)[_\s]', 1)) AS image_type, CASE WHEN len(fs) > 0 THEN fs[-1] WHEN len(gs) > 0 THEN gs[-1] ELSE '' END AS tissue_type, regexp_extract(CASE WHEN contains(name, ')') THEN regexp_extract(name, '(\)[^)]*)$', 1) ELSE name END, '_(\d+)', 1) AS roi_number FROM f"""
)
def parse_names(spark, sf):
    names = tables.table(spark, sf, "orders").select("o_orderkey", F.expr(NAME).alias("name"))
    return names.select("o_orderkey", "name", *[c.alias(k) for k, c in scalar.image_name_parts(F.col("name")).items()])


@query(r"SELECT page_id, regexp_replace(url, '[ ,:?/*]', '_', 'g') AS clean, regexp_replace(split_part(translate(url, '\', '/'), '/', -1), '\.[^.]*$', '') AS base FROM pages")
def sanitize(spark, sf):
    return tables.table(spark, sf, "pages").select("page_id", scalar.sanitized(F.col("url")).alias("clean"), scalar.base_name(F.col("url")).alias("base"))


@query(f"WITH {METRICS} SELECT l_suppkey, round(CASE WHEN t - 0.04 = 0 THEN 0 ELSE n / (t - 0.04) END, 6) AS density, round(CASE WHEN q = 0 THEN 0 ELSE p / q END, 6) AS thickness FROM m")
def safe_divide_densities(spark, sf):
    m = supplier_metrics(spark, sf)
    return m.select("l_suppkey", r6(scalar.safe_divide(F.col("n"), F.col("t") - 0.04), "density"), r6(scalar.safe_divide(F.col("p"), F.col("q")), "thickness"))


@query("WITH o AS (SELECT o_custkey, sum(o_totalprice) AS spent, count(*)::DOUBLE AS n FROM orders GROUP BY o_custkey) SELECT c_custkey, round(coalesce(spent, 0), 6) AS spent, round(coalesce(n, 0), 6) AS n FROM customer LEFT JOIN o ON c_custkey = o_custkey")
def combine_left_lookup(spark, sf):
    o = tables.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"), F.count("*").cast("double").alias("n"))
    c = T.looked_up(tables.table(spark, sf, "customer").select("c_custkey"), o, "c_custkey", ["spent", "n"])
    return c.select("c_custkey", r6("spent", "spent"), r6("n", "n"))


@query("WITH w AS (SELECT o_custkey AS k, avg(o_totalprice) AS m, count(*)::DOUBLE AS n FROM orders GROUP BY 1), r AS (SELECT o_custkey AS k, avg(o_totalprice) AS m, count(*)::DOUBLE AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey, round(CASE WHEN r.k IS NULL THEN 0 ELSE w.m END, 6) AS mean, CASE WHEN r.k IS NULL THEN 0 ELSE w.n END AS n, round(coalesce(r.m, 0), 6) AS roi_mean, coalesce(r.n, 0) AS roi_n FROM customer LEFT JOIN w ON w.k = c_custkey LEFT JOIN r ON r.k = c_custkey")
def guarded_gap_lookup(spark, sf):
    o = tables.table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    whole, region = (x.groupBy("c_custkey").agg(F.avg("o_totalprice").alias("mean"), F.count("*").cast("double").alias("n")) for x in (o, o.where("o_orderstatus = 'F'")))
    c = T.gap_summaries(tables.table(spark, sf, "customer").select("c_custkey"), whole, region, "c_custkey", ["mean", "n"])
    return c.select("c_custkey", r6("mean", "mean"), "n", r6("roi_mean", "roi_mean"), "roi_n")


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year, o_orderstatus, NULL::DOUBLE AS o_totalprice FROM orders WHERE year(o_orderdate) % 2 = 0 UNION ALL SELECT o_orderkey, year(o_orderdate)::INT, NULL, round(o_totalprice, 6) FROM orders WHERE year(o_orderdate) % 2 = 1")
def union_by_name(spark, sf):
    o = tables.table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return T.unioned(o.where("year % 2 = 0").select("o_orderkey", "year", "o_orderstatus"), o.where("year % 2 = 1").select(r6("o_totalprice", "o_totalprice"), "year", "o_orderkey"))


@query("SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS fn, count(*) FILTER (WHERE quality <> 1 AND toxic <> 1) AS tn FROM labels")
def mask_confusion(spark, sf):
    return T.confusion(tables.table(spark, sf, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


@query(f"WITH {GRID}, m AS (SELECT DISTINCT (o_orderkey * 3 % 64)::INT AS y, (o_custkey % 64)::INT AS x FROM orders WHERE o_orderstatus = 'F') SELECT l_suppkey, count(*) AS inside FROM cells SEMI JOIN m USING (y, x) GROUP BY l_suppkey")
def point_in_mask(spark, sf):
    m = tables.table(spark, sf, "orders").where("o_orderstatus = 'F'").select((F.col("o_orderkey") * 3 % 64).cast("int").alias("y"), (F.col("o_custkey") % 64).cast("int").alias("x")).distinct()
    return grid(spark, sf).join(m, ["y", "x"], "left_semi").groupBy("l_suppkey").agg(F.count("*").alias("inside"))


@query(
    """WITH p AS (SELECT c_nationkey AS k, c_custkey AS id, c_acctbal AS v FROM customer), t AS (SELECT s_nationkey AS k, s_suppkey AS id, s_acctbal AS v FROM supplier)
SELECT p.k, p.id, arg_min(t.id, row(abs(p.v - t.v), t.id)) AS nearest_id, round(min(abs(p.v - t.v)), 6) AS distance FROM p JOIN t ON p.k = t.k GROUP BY p.k, p.id UNION ALL SELECT k, id, NULL, NULL FROM p ANTI JOIN t USING (k)"""
)
def nearest_point(spark, sf):
    p = tables.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    t = tables.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"))
    return T.nearest(p, t, "k", "v").select("k", "id", "nearest_id", r6("distance", "distance"))


CIRCLES = "c AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS id, (l_partkey * 37 % 1000)::DOUBLE AS y, (l_orderkey * 11 % 1000)::DOUBLE AS x, l_quantity / 4 AS r FROM lineitem)"


def circles(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") * 37 % 1000).cast("double").alias("y"), (F.col("l_orderkey") * 11 % 1000).cast("double").alias("x"), (F.col("l_quantity") / 4).alias("r"))


@query(f"WITH {CIRCLES} SELECT a.k, a.id AS a, b.id AS b FROM c a JOIN c b ON a.k = b.k AND a.id < b.id AND sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) < a.r + b.r")
def circle_overlap_pairs(spark, sf):
    return T.overlapping_circles(circles(spark, sf), "k")


ALL_EDGES = "e AS (SELECT DISTINCT l_suppkey AS k, l_partkey * 2 AS src, l_orderkey * 2 + 1 AS dst FROM lineitem)"


def all_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Parts (even nodes) and orders (odd ones) that meet at a supplier."""
    return tables.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") * 2).alias("src"), (F.col("l_orderkey") * 2 + 1).alias("dst")).distinct()


@query(f"WITH {ALL_EDGES}, d AS (SELECT k, node, count(*) AS d FROM (SELECT k, src AS node FROM e UNION ALL SELECT k, dst FROM e) GROUP BY ALL) SELECT k, count(*) FILTER (WHERE d = 1) AS tips, count(*) FILTER (WHERE d > 2) AS branches, count(*) AS nodes FROM d GROUP BY k")
def degree_counts_all(spark, sf):
    return T.degrees(all_edges(spark, sf), "k")


@query(f"WITH {ALL_EDGES}, d AS (SELECT k, node, count(*) AS d FROM (SELECT k, src AS node FROM e UNION ALL SELECT k, dst FROM e) GROUP BY ALL) SELECT k, round(CASE WHEN count(*) FILTER (WHERE d = 1 OR d > 2) = 0 THEN 0 ELSE sum(d)::DOUBLE / count(*) FILTER (WHERE d = 1 OR d > 2) END, 6) AS growth FROM d GROUP BY k")
def growth_units(spark, sf):
    e = all_edges(spark, sf)
    n = e.groupBy("k").agg(F.count("*").cast("double").alias("length"))
    return T.degrees(e, "k").join(n, "k").select("k", r6(T.growth_unit(F.col("length"), F.col("tips"), F.col("branches")), "growth"))


@query()
def graph_components_all(spark, sf):
    return graphs.components(all_edges(spark, sf), "k")


@query(f"WITH {ALL_EDGES} SELECT k, count(*) AS n FROM e ANTI JOIN (SELECT o_orderkey * 2 + 1 AS dst FROM orders WHERE o_orderstatus = 'F') r USING (dst) GROUP BY k")
def junctions_kept_all(spark, sf):
    j = all_edges(spark, sf).select(F.col("k").alias("image_id"), F.col("src").alias("cont1"), F.col("dst").alias("cont2"))
    shut = tables.table(spark, sf, "orders").where("o_orderstatus = 'F'").select((F.col("o_orderkey") * 2 + 1).alias("contour_id"))
    gone = j.select("image_id", F.col("cont2").alias("contour_id")).join(shut, "contour_id", "left_semi").distinct()
    return T.kept_junctions(j, gone).groupBy(F.col("image_id").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 40 AND count(*) <= 70")
def contour_length_filter(spark, sf):
    n = tables.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("length"))
    return T.kept_contours(n, 40, 70).select("user_id", F.col("length").alias("n"))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :])


@query(f"SELECT a, b, round(r, 6) AS r FROM ({_PAIRS}) ORDER BY abs(r) DESC, a, b LIMIT 5")
def top_corr_pairs(spark, sf):
    return T.correlations(tables.table(spark, sf, "lineitem"), NUMBERS, 5).select("a", "b", r6("r", "r"))


_DESCRIBE = " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS low, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c})::DOUBLE, 6) AS high FROM lineitem" for c in NUMBERS)


@query(_DESCRIBE)
def describe(spark, sf):
    d = T.described(tables.table(spark, sf, "lineitem"), NUMBERS)
    return d.select("name", "n", *[r6(c, c) for c in ("mean", "std", "low", "q25", "q50", "q75", "high")])


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def uniqueness_check(spark, sf):
    return T.repeated_keys(tables.table(spark, sf, "orders"), "o_custkey")


TABLE = [(i, j, float((i * 7 + j * 3) % 11) / 4) for i in range(21) for j in range(41)]


@query(
    """WITH t AS (SELECT i, j, ((i * 7 + j * 3) % 11) / 4.0::DOUBLE AS v FROM (SELECT unnest(range(21)) AS i), (SELECT unnest(range(41)) AS j)), p AS (SELECT o_orderkey AS id, (o_totalprice % 19) AS u, (o_orderkey * 0.37::DOUBLE) % 39 AS w FROM orders), q AS (SELECT *, floor(u)::INT AS i, floor(w)::INT AS j, u - floor(u) AS a, w - floor(w) AS b FROM p)
SELECT id, round((1 - a) * (1 - b) * t0.v + (1 - a) * b * t1.v + a * (1 - b) * t2.v + a * b * t3.v, 6) AS value FROM q JOIN t t0 ON t0.i = q.i AND t0.j = q.j JOIN t t1 ON t1.i = q.i AND t1.j = q.j + 1 JOIN t t2 ON t2.i = q.i + 1 AND t2.j = q.j JOIN t t3 ON t3.i = q.i + 1 AND t3.j = q.j + 1"""
)
def table_interpolation(spark, sf):
    table = F.broadcast(spark.createDataFrame(TABLE, "i int, j int, value double"))  # 861 rows by construction
    p = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") % 19).alias("u"), ((F.col("o_orderkey") * 0.37) % 39).alias("v"))
    return T.interpolated_table(p, table).select("id", r6("value", "value"))


@query("SELECT l_suppkey, arg_max(l_linenumber, row(l_extendedprice, -l_orderkey)) AS scale, round(max(l_extendedprice), 6) AS saliency FROM lineitem GROUP BY l_suppkey")
def strongest_scale(spark, sf):
    best = F.max_by(F.col("l_linenumber"), F.struct(F.col("l_extendedprice"), -F.col("l_orderkey")))
    return tables.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(best.alias("scale"), r6(F.max("l_extendedprice"), "saliency"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS seed FROM orders")
def seed_order(spark, sf):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return tables.table(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("seed"))


@query("SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 6) AS length FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_quantity <= 20) GROUP BY l_suppkey")
def edge_pruning(spark, sf):
    e = tables.table(spark, sf, "lineitem").select("l_suppkey", F.when(F.col("l_returnflag") == "A", "end-to-brh").otherwise("brh-to-brh").alias("kind"), F.col("l_quantity").alias("length"))
    return T.pruned_edges(e, "l_suppkey", 20).groupBy("l_suppkey").agg(F.count("*").alias("n"), r6(F.sum("length"), "length"))


@query("SELECT event_id, round(CASE WHEN m < 0 THEN m + pi() ELSE m END, 6) AS angle FROM (SELECT event_id, (value - 3) % pi() AS m FROM events)")
def half_circle_angles(spark, sf):
    return tables.table(spark, sf, "events").select("event_id", r6(scalar.half_circle(F.col("value") - 3), "angle"))


@query("SELECT o_orderkey, (CASE WHEN o_custkey % 7 = 0 THEN 1.0 ELSE round_even(1.0 / (o_custkey % 7)::DOUBLE, 2) END)::DOUBLE AS res FROM orders")
def pixel_resolution(spark, sf):
    return tables.table(spark, sf, "orders").select("o_orderkey", scalar.resolution_of((F.col("o_custkey") % 7).cast("double")).alias("res"))


@query("WITH c AS (SELECT l_suppkey, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem GROUP BY l_suppkey) SELECT metric, count(*) AS n, round(avg(v), 6) AS mean FROM (SELECT 'd' AS metric, d AS v FROM c UNION ALL SELECT 't', t FROM c) GROUP BY metric")
def metrics_unpivot(spark, sf):
    m = tables.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    return m.unpivot(["l_suppkey"], ["d", "t"], "metric", "v").groupBy("metric").agg(F.count("*").alias("n"), r6(F.avg("v"), "mean"))
