"""Queries over pixels, points and paths as rows, whose rasters and graphs may be larger than a task.

Each supplier's rows of lineitem stand for a raster of 64 x 64 places, and the parts and suppliers of a return flag for one of as many rows
and columns as there are parts and suppliers.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import graphs, pixels as X, points as O, raster as R, regions, tabular as T, tensor
from ..sources import tables
from ..sources.scratch import Scratch
from .catalog import GX, GY, HSV, PIXELS, POINTS, RGB, SIDE as EIGHT, _AXX, _AXY, _AYY, _density, images, near, points, query, r6

GRID = 64
CELLS = f"c AS (SELECT l_suppkey AS image_id, (l_partkey * 7 % {GRID})::BIGINT AS y, (l_orderkey * 13 % {GRID})::BIGINT AS x, count(*)::DOUBLE AS v FROM lineitem GROUP BY ALL)"
SHEETS = "c AS (SELECT l_returnflag AS image_id, l_partkey AS y, l_suppkey AS x, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


def cells(spark: SparkSession, sf: str) -> DataFrame:
    li = tables.table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") * 7 % GRID).alias("y"), (F.col("l_orderkey") * 13 % GRID).alias("x")).agg(F.count("*").cast("double").alias("v"))


def sheets(spark: SparkSession, sf: str) -> DataFrame:
    li = tables.table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("image_id"), F.col("l_partkey").alias("y"), F.col("l_suppkey").alias("x")).agg(F.sum("l_quantity").alias("v"))


#: No two parts of an order have one number at a supplier; rows equal in all three are one point.
ID = "(l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey"
PLACES = f"DISTINCT l_suppkey AS k, {ID} AS id"


@query(
    f"""WITH p AS (SELECT {PLACES}, (l_partkey * 37 % 1000)::DOUBLE AS y, (l_orderkey * 11 % 1000)::DOUBLE AS x FROM lineitem), t AS (SELECT {PLACES}, (l_orderkey * 37 % 1000)::DOUBLE AS y, (l_partkey * 11 % 1000)::DOUBLE AS x FROM lineitem)
SELECT p.k, p.id, arg_min(t.id, row((p.y - t.y) ** 2 + (p.x - t.x) ** 2, t.id)) AS nearest_id, round(sqrt(min((p.y - t.y) ** 2 + (p.x - t.x) ** 2)), 6) AS distance FROM p JOIN t ON p.k = t.k GROUP BY p.k, p.id"""
)
def nearest_in_plane(spark, sf):
    li = tables.table(spark, sf, "lineitem")

    def places(y, x):
        return li.select(F.col("l_suppkey").alias("k"), F.expr(ID).alias("id"), *[(F.col(c) * m % 1000).cast("double").alias(n) for n, (c, m) in (("y", y), ("x", x))]).distinct()

    found = O.nearest_in_plane(places(("l_partkey", 37), ("l_orderkey", 11)), places(("l_orderkey", 37), ("l_partkey", 11)), "k")
    return found.select("k", "id", "nearest_id", r6("distance", "distance"))


_TAKE = "list_reduce(l, lambda a, b: CASE WHEN len(list_filter(a, lambda t: sqrt((t.y - b[1].y) ** 2 + (t.x - b[1].x) ** 2) < t.r + b[1].r)) > 0 THEN a ELSE list_concat(a, b) END)"


@query(f"WITH c AS (SELECT l_suppkey AS k, {ID} AS id, max(l_partkey * 37 % 1000)::DOUBLE AS y, max(l_orderkey * 11 % 1000)::DOUBLE AS x, max(l_quantity) / 4 AS r FROM lineitem GROUP BY ALL), o AS (SELECT k, list([{{'id': id, 'y': y, 'x': x, 'r': r}}] ORDER BY r DESC, id) AS l FROM c GROUP BY k), t AS (SELECT k, unnest({_TAKE}) AS t FROM o) SELECT k, t.id AS id, round(t.r, 6) AS r FROM t")
def chosen_circles(spark, sf):
    li = tables.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.expr(ID).alias("id"))
    c = li.agg(F.max(F.col("l_partkey") * 37 % 1000).cast("double").alias("y"), F.max(F.col("l_orderkey") * 11 % 1000).cast("double").alias("x"), (F.max("l_quantity") / 4).alias("r"))
    return O.chosen_circles(c, "k").select("k", "id", r6("r", "r"))


def grown(where: str = "true") -> str:
    """SQL that gives each pixel of c (where) all pixels of its component that come first, as r (image_id, y, x, root)."""
    return f"""c2 AS (SELECT image_id, y, x, v, y * 4294967296 + x AS n FROM c WHERE {where}), e AS (SELECT a.image_id, a.n AS s, b.n AS t FROM c2 a, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx), c2 b WHERE a.image_id = b.image_id AND b.y = a.y + dy AND b.x = a.x + dx),
r(image_id, n, root) AS (SELECT image_id, n, n FROM c2 UNION SELECT r.image_id, e.t, r.root FROM r JOIN e ON r.image_id = e.image_id AND r.n = e.s WHERE r.root < e.t),
m AS (SELECT image_id, n, min(root) AS root FROM r GROUP BY ALL)"""


@query(
    f"WITH RECURSIVE {CELLS}, {grown()}, z AS (SELECT image_id, root, count(*) AS n FROM m GROUP BY ALL) SELECT image_id, count(*) AS components, max(n)::BIGINT AS largest, coalesce(sum(n) FILTER (WHERE n >= 3), 0)::BIGINT AS kept FROM z GROUP BY image_id"
)
def pixel_components(spark, sf):
    z = X.labelled_runs(cells(spark, sf)).groupBy("image_id", "root").agg(F.max("size").alias("n"))
    return z.groupBy("image_id").agg(F.count("*").alias("components"), F.max("n").alias("largest"), F.coalesce(F.sum(F.when(F.col("n") >= 3, F.col("n"))), F.lit(0)).alias("kept"))


@query()
def large_components(spark, sf):
    """Pixels of components of at least three pixels of each sheet, which is as large as the tables of parts and suppliers."""
    return X.large_components(sheets(spark, sf), 3)


@query(f"WITH RECURSIVE {CELLS}, {grown('v >= 1')}, z AS (SELECT m.image_id, root FROM m JOIN c2 USING (image_id, n) GROUP BY ALL HAVING max(v) >= 2) SELECT image_id, count(*) AS pixels, count(DISTINCT root) AS lines FROM m JOIN z USING (image_id, root) GROUP BY image_id")
def hysteresis(spark, sf):
    return X.hysteresis(cells(spark, sf), 1, 2).groupBy("image_id").agg(F.count("*").alias("pixels"), F.count_distinct("root").alias("lines"))


@query(
    f"WITH {CELLS}, g AS (SELECT image_id, gy, gx FROM (SELECT DISTINCT image_id FROM c), (SELECT unnest(range({GRID})) AS gy), (SELECT unnest(range({GRID})) AS gx)), d AS (SELECT image_id, gy, gx, min((gy - y) ** 2 + (gx - x) ** 2) AS d FROM g JOIN c USING (image_id) GROUP BY ALL) SELECT image_id, count(*) AS places, round(max(sqrt(d)), 6) AS farthest, round(sum(sqrt(d)), 6) AS total FROM d GROUP BY image_id"
)
def distances_by_rows(spark, sf):
    d = X.distances(cells(spark, sf), GRID, GRID)
    return d.groupBy("image_id").agg(F.count("*").alias("places"), r6(F.max(F.sqrt("d2")), "farthest"), r6(F.sum(F.sqrt("d2")), "total"))


SIDE = 20  # the last tiles of a raster of 64 are narrower
_BLUR = R.gaussian(1.2, radius=2)
_KERNEL = ", ".join(f"({k - 2}, {w!r})" for k, w in enumerate(_BLUR))
_FOLD = f"(CASE WHEN {{0}} + d < 0 THEN -1 - ({{0}} + d) WHEN {{0}} + d > {GRID - 1} THEN {2 * GRID - 1} - ({{0}} + d) ELSE {{0}} + d END)"


@query(
    f"""WITH {CELLS}, k(d, w) AS (VALUES {_KERNEL}), g AS (SELECT image_id, y, x, coalesce(v, 0) AS v FROM (SELECT image_id, y, x FROM (SELECT DISTINCT image_id FROM c), (SELECT unnest(range({GRID})) AS y), (SELECT unnest(range({GRID})) AS x)) LEFT JOIN c USING (image_id, y, x)),
a AS (SELECT i.image_id, i.y, i.x, sum(w * g.v) AS v FROM (SELECT image_id, y, x, d, w, {_FOLD.format('y')} AS f FROM g, k) i JOIN g ON g.image_id = i.image_id AND g.y = i.f AND g.x = i.x GROUP BY ALL),
b AS (SELECT i.image_id, i.y, i.x, sum(w * a.v) AS v FROM (SELECT image_id, y, x, d, w, {_FOLD.format('x')} AS f FROM g, k) i JOIN a ON a.image_id = i.image_id AND a.y = i.y AND a.x = i.f GROUP BY ALL)
SELECT image_id, (y // {SIDE})::INT AS ty, (x // {SIDE})::INT AS tx, round(sum(v), 5) AS total, round(sum(v * v), 5) AS power, round(max(v), 5) AS top FROM b GROUP BY ALL"""
)
def tiled_blur(spark, sf):
    t = X.stencilled(X.tiles_of(cells(spark, sf), SIDE, GRID, GRID), SIDE, _BLUR, _BLUR)
    px = X.tile_pixels(t, SIDE)
    by = px.groupBy("image_id", F.floor(F.col("y") / SIDE).cast("int").alias("ty"), F.floor(F.col("x") / SIDE).cast("int").alias("tx"))
    return by.agg(*[F.round(c, 5).alias(n) for n, c in (("total", F.sum("v")), ("power", F.sum(F.col("v") * F.col("v"))), ("top", F.max("v")))])


WALKS = f"""{CELLS}, e AS (SELECT a.image_id AS k, a.y * 4294967296 + a.x AS u, b.y * 4294967296 + b.x AS v, sqrt((dy * dy + dx * dx)::DOUBLE) AS l FROM c a, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx), c b WHERE a.image_id = b.image_id AND b.y = a.y + dy AND b.x = a.x + dx AND (dy <> 0 OR dx <> 0)),
d AS (SELECT k, u AS n, count(*) AS d FROM e GROUP BY ALL),
w(k, s, f, p, n, l, h) AS (SELECT e.k, u, v, u, v, l, 1 FROM e JOIN d ON d.k = e.k AND d.n = e.u WHERE d.d <> 2 UNION ALL SELECT w.k, w.s, w.f, w.n, e.v, w.l + e.l, w.h + 1 FROM w JOIN d ON d.k = w.k AND d.n = w.n AND d.d = 2 JOIN e ON e.k = w.k AND e.u = w.n AND e.v <> w.p),
o AS (SELECT w.k, w.l, w.h, (a.d = 1)::INT + (b.d = 1)::INT AS tips FROM w JOIN d a ON a.k = w.k AND a.n = w.s JOIN d b ON b.k = w.k AND b.n = w.n AND b.d <> 2),
i AS (SELECT k, n FROM d WHERE d = 2 EXCEPT SELECT k, n FROM w),
g(k, n, root) AS (SELECT k, n, n FROM i UNION SELECT g.k, e.v, g.root FROM g JOIN e ON e.k = g.k AND e.u = g.n),
q AS (SELECT k, n, min(root) AS root FROM g GROUP BY ALL)"""


@query(
    f"""WITH RECURSIVE {WALKS} SELECT k AS image_id, CASE tips WHEN 2 THEN 'end-to-end' WHEN 1 THEN 'end-to-brh' ELSE 'brh-to-brh' END AS kind, count(*) // 2 AS n, (sum(h) / 2)::BIGINT AS hops, round(sum(l) / 2, 6) AS length FROM o GROUP BY ALL
UNION ALL SELECT q.k, 'ring', count(DISTINCT root), (count(*) / 2)::BIGINT, round(sum(e.l) / 2, 6) FROM q JOIN e ON e.k = q.k AND e.u = q.n GROUP BY q.k"""
)
def skeleton_paths(spark, sf):
    found = graphs.paths(X.pixel_graph(cells(spark, sf)), "image_id")
    return found.groupBy("image_id", "kind").agg(F.count("*").alias("n"), F.sum("hops").alias("hops"), r6(F.sum("length"), "length"))


@query()
def longest_routes(spark, sf):
    """The longest shortest path between key points of each component of the suppliers' pixel graphs."""
    found = graphs.paths(X.pixel_graph(cells(spark, sf)), "image_id")
    return graphs.longest_routes(found.where("kind <> 'ring'").select("image_id", "src", "dst", "length"), "image_id")


RAY = 8


@query(
    f"""WITH p AS (SELECT l_suppkey AS image_id, l_linenumber AS contour_id, {ID} AS idx, max(l_partkey * 7 % {GRID})::DOUBLE AS y, max(l_orderkey * 13 % {GRID})::DOUBLE AS x, max(l_extendedprice) % pi() AS angle FROM lineitem GROUP BY ALL), g AS (SELECT DISTINCT l_suppkey AS image_id, l_partkey * 7 % {GRID} AS y, l_orderkey * 13 % {GRID} AS x FROM lineitem WHERE l_returnflag = 'R'),
h AS (SELECT p.image_id, contour_id, idx, min(t) FILTER (WHERE s < 0) AS lft, min(t) FILTER (WHERE s > 0) AS rgt FROM (SELECT *, floor(y + s * t * sin(angle) + 0.5)::BIGINT AS gy, floor(x + s * t * cos(angle) + 0.5)::BIGINT AS gx FROM p, (SELECT unnest([-1, 1]) AS s), (SELECT unnest(range(1, {RAY + 1})) AS t)) p JOIN g ON g.image_id = p.image_id AND g.y = gy AND g.x = gx GROUP BY ALL),
a AS (SELECT p.*, lft, rgt, (lft + rgt)::DOUBLE AS width, coalesce(sqrt((y - lag(y) OVER o) ** 2 + (x - lag(x) OVER o) ** 2), 0) AS step FROM p LEFT JOIN h USING (image_id, contour_id, idx) WINDOW o AS (PARTITION BY image_id, contour_id ORDER BY idx)),
b AS (SELECT *, sum(step) OVER (PARTITION BY image_id, contour_id ORDER BY idx) AS t FROM a),
w AS (SELECT *, last_value(CASE WHEN width IS NOT NULL THEN t END IGNORE NULLS) OVER b AS ta, last_value(width IGNORE NULLS) OVER b AS ya, first_value(CASE WHEN width IS NOT NULL THEN t END IGNORE NULLS) OVER f AS tb, first_value(width IGNORE NULLS) OVER f AS yb FROM b
WINDOW b AS (PARTITION BY image_id, contour_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY image_id, contour_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT image_id, contour_id, idx, lft::INT AS lft, rgt::INT AS rgt, round(coalesce(width, ya + (yb - ya) * CASE WHEN tb = ta THEN 0 ELSE (t - ta) / (tb - ta) END, ya, yb), 6) AS filled FROM w"""
)
def ray_widths(spark, sf):
    li = tables.table(spark, sf, "lineitem")
    y, x = F.col("l_partkey") * 7 % GRID, F.col("l_orderkey") * 13 % GRID
    by = li.groupBy(F.col("l_suppkey").alias("image_id"), F.col("l_linenumber").alias("contour_id"), F.expr(ID).alias("idx"))
    p = by.agg(F.max(y).cast("double").alias("y"), F.max(x).cast("double").alias("x"), (F.max("l_extendedprice") % math.pi).alias("angle"))
    edge = li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("image_id"), y.alias("y"), x.alias("x"))
    return X.ray_widths(p, edge, RAY).select("image_id", "contour_id", "idx", F.col("left").alias("lft"), F.col("right").alias("rgt"), r6("filled", "filled"))


_VERTICES = "v AS (SELECT c_nationkey AS k, c_custkey AS idx, c_acctbal / 200 AS y, (c_custkey * 7 % 64) + 0.5::DOUBLE AS x FROM customer)"


@query(
    f"""WITH {_VERTICES}, e AS (SELECT k, y, x, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2 FROM v WINDOW w AS (PARTITION BY k ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
g AS (SELECT k, gy, gx FROM (SELECT DISTINCT k FROM v), (SELECT unnest(range(-10, 60)) AS gy), (SELECT unnest(range(-1, 67)) AS gx)),
n AS (SELECT g.k, gy, gx, count(*) AS n FROM g JOIN e ON e.k = g.k AND (e.y <= gy) <> (e.y2 <= gy) AND x + (gy - y) * (x2 - x) / (y2 - y) > gx GROUP BY ALL)
SELECT k, gy::BIGINT AS y, count(*) AS pixels, sum(gx)::BIGINT AS columns FROM n WHERE n % 2 = 1 GROUP BY ALL"""
)
def outline_pixels(spark, sf):
    v = tables.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("idx"), (F.col("c_acctbal") / 200).alias("y"), ((F.col("c_custkey") * 7 % 64) + F.lit(0.5)).alias("x"))
    return O.outline_pixels(v, "k").groupBy("k", "y").agg(F.count("*").alias("pixels"), F.sum("x").alias("columns"))


# ---- measures that the per-image kernels also have


@query(
    f"""WITH {POINTS}, l AS (SELECT user_id, list({{'id': event_id, 'y': y::DOUBLE, 'x': x}} ORDER BY ts, event_id) AS p, count(*) AS n FROM p GROUP BY user_id), i AS (SELECT user_id, p, n, least(3, n - 1) AS s, unnest(range(n)) AS i FROM l),
b AS (SELECT user_id, p[i + 1] AS h, CASE WHEN i >= s THEN p[i - s + 1].y ELSE 2 * p[1].y - p[s - i + 1].y END AS y0, CASE WHEN i >= s THEN p[i - s + 1].x ELSE 2 * p[1].x - p[s - i + 1].x END AS x0, CASE WHEN i + s < n THEN p[i + s + 1].y ELSE 2 * p[n].y - p[2 * n - 1 - i - s].y END AS y1, CASE WHEN i + s < n THEN p[i + s + 1].x ELSE 2 * p[n].x - p[2 * n - 1 - i - s].x END AS x1 FROM i)
SELECT user_id, h.id AS event_id, round(degrees(abs(atan2((h.x - x0) * (y1 - h.y) - (h.y - y0) * (x1 - h.x), (h.y - y0) * (y1 - h.y) + (h.x - x0) * (x1 - h.x)))), 6) AS angle FROM b"""
)
def reflected_curvature(spark, sf):
    return T.reflected_curvature(points(spark, sf), "user_id", ["ts", "event_id"], "y", "x", 3).select("user_id", "event_id", r6("angle", "angle"))


@query(
    f"""WITH {PIXELS}, g AS (SELECT image_id, i, ({GX}) AS gx, ({GY}) AS gy FROM px), e AS (SELECT image_id, list(gx * gx + gy * gy) AS l FROM g GROUP BY image_id), q AS (SELECT image_id, l, list_aggregate(l, 'quantile_cont', 0.02) AS low, list_aggregate(l, 'quantile_cont', 0.98) AS high FROM e),
v AS (SELECT image_id, least(greatest((unnest(l) - low) / (high - low + 1e-20), 0), 1) AS v FROM q) SELECT image_id, round(avg(v), 6) AS mean, count(*) FILTER (WHERE v >= 1) AS full FROM v GROUP BY image_id"""
)
def energy_map(spark, sf):
    e = tensor.gradients(images(spark, sf), "v", EIGHT, EIGHT).withColumn("e", tensor.energy())
    return e.select("image_id", r6(R.mean(F.col("e")), "mean"), F.size(F.filter("e", lambda v: v >= 1)).cast("long").alias("full"))


_SLOPE = f"(({near(0, 1)} - {near(0, -1)}) / 2) AS gx, (({near(1, 0)} - {near(-1, 0)}) / 2) AS gy"


@query(
    f"""WITH {PIXELS}, h AS (SELECT image_id, i, {_AXX} AS a, {_AXY} AS b, {_AYY} AS c, {_SLOPE} FROM px), m AS (SELECT *, (a + c) / 2 AS mid, sqrt((a - c) * (a - c) / 4 + b * b) AS off FROM h), t AS (SELECT *, CASE WHEN mid >= 0 THEN mid + off ELSE mid - off END AS top FROM m),
n AS (SELECT *, CASE WHEN abs(b) < 1e-12 THEN (abs(a) >= abs(c))::INT ELSE b / sqrt(b * b + (top - a) * (top - a)) END AS nx, CASE WHEN abs(b) < 1e-12 THEN (abs(a) < abs(c))::INT ELSE (top - a) / sqrt(b * b + (top - a) * (top - a)) END AS ny FROM t),
o AS (SELECT image_id, -(gy * ny + gx * nx) / (top + 1e-12) * ny AS dy, -(gy * ny + gx * nx) / (top + 1e-12) * nx AS dx FROM n) SELECT image_id, count(*) FILTER (WHERE abs(dy) <= 0.6 AND abs(dx) <= 0.6) AS points, round(sum(least(abs(dy), 1) + least(abs(dx), 1)), 5) AS moved FROM o GROUP BY image_id"""
)
def line_points(spark, sf):
    """Pixels whose extremum across the strongest curvature lies within them, and how far it is off, at most a pixel an axis."""
    kernels = {"a": ((1, -2, 1),), "b": ((0.25, 0, -0.25), (0, 0, 0), (-0.25, 0, 0.25)), "c": ((1,), (-2,), (1,)), "gx": ((-0.5, 0, 0.5),), "gy": ((-0.5,), (0,), (0.5,))}
    h = images(spark, sf).withColumns({k: R.convolve(F.col("v"), m, EIGHT, EIGHT, "nearest") for k, m in kernels.items()})
    one = h.select("image_id", F.explode(F.arrays_zip(*kernels)).alias("t")).select("image_id", "t.*")
    top, nx, ny = scalar.strongest_normal(F.col("a"), F.col("b"), F.col("c"))
    known = one.withColumns({"top": top, "nx": nx, "ny": ny})
    dy, dx = scalar.subpixel_offset(F.lit(0.0), F.col("ny"), F.col("nx"), F.col("gy"), F.col("gx"), F.col("top"))
    off = known.withColumns({"dy": F.abs(dy), "dx": F.abs(dx)})
    return off.groupBy("image_id").agg(F.count_if((F.col("dy") <= 0.6) & (F.col("dx") <= 0.6)).alias("points"), F.round(F.sum(F.least("dy", F.lit(1.0)) + F.least("dx", F.lit(1.0))), 5).alias("moved"))


@query("SELECT p_partkey, round(p_size / (2 * sqrt(3)) + 0.5, 6) AS sigma, (CASE WHEN p_partkey % 2 = 0 THEN 255 - p_size * 5 ELSE p_size * 5 END)::INT AS contrast FROM part")
def detection_scales(spark, sf):
    """The Gaussian for each line width, and contrasts turned round for dark lines."""
    p = tables.table(spark, sf, "part")
    return p.select("p_partkey", r6(scalar.sigma_of_width(F.col("p_size")), "sigma"), scalar.swap_contrast(F.col("p_size") * 5, F.col("p_partkey") % 2 == 0).cast("int").alias("contrast"))


_NAMED = "CASE l_linenumber % 5 " + " ".join(f"WHEN {k} THEN '{q}'" for k, q in enumerate(T.QUANTITIES)) + " END"


@query(
    f"""WITH t AS (SELECT (l_suppkey % 21)::INT AS i, (l_partkey % 41)::INT AS j, {_NAMED} AS q, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), p AS (SELECT o_orderkey AS id, (1 + o_custkey % 5)::DOUBLE AS sigma, o_totalprice % 30 AS width, (o_orderkey % 1009) / 1000.0::DOUBLE AS ratio FROM orders),
s AS (SELECT *, width / sigma AS w FROM p), c AS (SELECT id, sigma, least(floor(ratio * 20), 19)::INT AS i, least(floor((w - 2) * 10), 39)::INT AS j, ratio * 20 - least(floor(ratio * 20), 19) AS b, (w - 2) * 10 - least(floor((w - 2) * 10), 39) AS a FROM s WHERE w BETWEEN 2 AND 6 AND ratio BETWEEN 0 AND 1),
m AS (SELECT c.id, t.q, sum((CASE WHEN di = 1 THEN b ELSE 1 - b END) * (CASE WHEN dj = 1 THEN a ELSE 1 - a END) * v * CASE WHEN t.q = 'asymmetry' THEN 1 ELSE sigma END) AS v FROM c, (SELECT unnest([0, 1]) AS di), (SELECT unnest([0, 1]) AS dj), t WHERE t.i = c.i + di AND t.j = c.j + dj GROUP BY ALL)
SELECT p.id, {", ".join(f"round(coalesce(max(m.v) FILTER (WHERE m.q = '{q}'), 0), 6) AS true_{q}" for q in T.QUANTITIES)} FROM p LEFT JOIN m ON m.id = p.id GROUP BY p.id"""
)
def line_corrections(spark, sf):
    """Widths of orders corrected by a table of means over lineitem: 21 x 41 steps of five quantities."""
    li, o = tables.table(spark, sf, "lineitem"), tables.table(spark, sf, "orders")
    table = li.groupBy((F.col("l_suppkey") % 21).cast("int").alias("ratio_step"), (F.col("l_partkey") % 41).cast("int").alias("width_step"), F.expr(_NAMED).alias("quantity")).agg(F.avg("l_quantity").alias("value"))
    p = o.select(F.col("o_orderkey").alias("id"), (1 + F.col("o_custkey") % 5).cast("double").alias("sigma"), (F.col("o_totalprice") % 30).alias("width"), ((F.col("o_orderkey") % 1009) / 1000.0).alias("ratio"))
    return T.line_corrections(p, table).select("id", *[r6(f"true_{q}", f"true_{q}") for q in T.QUANTITIES])


# ---- thin lines, gaps, samples

_CODE = " + ".join(f"{1 << k} * count(*) FILTER (WHERE b.y - a.y = {dy} AND b.x - a.x = {dx})" for k, (dy, dx) in enumerate(X.AROUND))
_CODES = f"k AS (SELECT a.image_id, a.y, a.x, ({_CODE})::INT AS code FROM c a JOIN c b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)"
#: A corner of a line in its four directions.
CORNERS = (((-1, 1, -1), (0, 1, 1), (0, 0, -1)), ((-1, 1, -1), (1, 1, 0), (-1, 0, 0)), ((0, 0, -1), (0, 1, 1), (-1, 1, -1)), ((-1, 0, 0), (1, 1, 0), (-1, 1, -1)))


def _fits(p) -> str:
    care = sum(1 << k for k, (dy, dx) in enumerate(X.AROUND) if p[1 + dy][1 + dx] >= 0)
    return f"code & {care} = {sum(1 << k for k, (dy, dx) in enumerate(X.AROUND) if p[1 + dy][1 + dx] == 1)}"


@query(f"WITH {CELLS}, {_CODES} SELECT image_id, count(*) FILTER (WHERE bit_count(code) = 0) AS alone, count(*) FILTER (WHERE bit_count(code) = 1) AS ends, count(*) FILTER (WHERE bit_count((((code >> 1) | ((code & 1) << 7)) & ~code & 255)) >= 3) AS junctions, count(*) FILTER (WHERE {' OR '.join(f'({_fits(p)})' for p in CORNERS)}) AS corners FROM k GROUP BY image_id")
def pixel_patterns(spark, sf):
    """Lone pixels, ends, junctions, and those that fit one of four patterns."""
    k = X.neighbour_codes(cells(spark, sf))
    n, turns = X.neighbours_of(F.col("code")), X.crossings_of(F.col("code"))
    return k.groupBy("image_id").agg(F.count_if(n == 0).alias("alone"), F.count_if(n == 1).alias("ends"), F.count_if(turns >= 3).alias("junctions"), F.count_if(X.matches(F.col("code"), CORNERS)).alias("corners"))


@query()
def thin_lines(spark, sf):
    """Key points of the thinned sheets of parts and suppliers."""
    return X.key_points(X.thinned(sheets(spark, sf)))


@query()
def holes_filled(spark, sf):
    return X.without_small_holes(cells(spark, sf), GRID, GRID, 5).groupBy("image_id").agg(F.count("*").alias("pixels"))


LEAST, APART = 2.0, 3


@query(
    f"""WITH {CELLS}, g AS (SELECT image_id, gy, gx FROM (SELECT DISTINCT image_id FROM c), (SELECT unnest(range({GRID})) AS gy), (SELECT unnest(range({GRID})) AS gx)), d AS (SELECT image_id, gy AS y, gx AS x, min((gy - y) ** 2 + (gx - x) ** 2) AS d FROM g JOIN c USING (image_id) GROUP BY ALL),
a AS (SELECT *, max(d) OVER (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN {APART} PRECEDING AND {APART} FOLLOWING) AS m FROM d), b AS (SELECT *, max(m) OVER (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN {APART} PRECEDING AND {APART} FOLLOWING) AS t FROM a),
o AS (SELECT image_id AS k, list([{{'y': y::DOUBLE, 'x': x::DOUBLE, 'r': sqrt(d)}}] ORDER BY d DESC, y, x) AS l FROM b WHERE d = t AND d > {LEAST * LEAST} GROUP BY image_id), t AS (SELECT k, unnest({_TAKE}) AS t FROM o) SELECT k AS image_id, t.y AS y, t.x AS x, round(t.r, 6) AS r FROM t"""
)
def widest_gaps(spark, sf):
    """The first round of gap circles of each supplier's raster."""
    li = tables.table(spark, sf, "lineitem")
    pixels = li.select(F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") * 7 % GRID).alias("y"), (F.col("l_orderkey") * 13 % GRID).alias("x"))
    return X.gap_circles(pixels, GRID, GRID, LEAST, APART, rounds=1).select("image_id", "y", "x", r6("r", "r"))


_SEGMENTS = f"s AS (SELECT DISTINCT l_suppkey AS k, {ID} AS id, l_partkey * 7 % {GRID} AS y0, l_orderkey * 13 % {GRID} AS x0, l_orderkey * 5 % {GRID} AS y1, l_partkey * 3 % {GRID} AS x1 FROM lineitem)"


@query(
    f"""WITH {_SEGMENTS}, n AS (SELECT *, greatest(abs(y1 - y0), abs(x1 - x0)) AS n FROM s), t AS (SELECT *, unnest(range(n + 1)) AS t FROM n)
SELECT k, count(*) AS pixels, sum(CASE WHEN n = 0 THEN y0 ELSE y0 + floor((2 * t * (y1 - y0) + n) / (2 * n)::DOUBLE) END)::BIGINT AS rows, sum(CASE WHEN n = 0 THEN x0 ELSE x0 + floor((2 * t * (x1 - x0) + n) / (2 * n)::DOUBLE) END)::BIGINT AS columns FROM t GROUP BY k"""
)
def line_pixels(spark, sf):
    li = tables.table(spark, sf, "lineitem")
    s = li.select(F.col("l_suppkey").alias("k"), F.expr(ID).alias("id"), *[(F.col(c) * m % GRID).alias(n) for n, c, m in (("y0", "l_partkey", 7), ("x0", "l_orderkey", 13), ("y1", "l_orderkey", 5), ("x1", "l_partkey", 3))]).distinct()
    return X.line_pixels(s).groupBy("k").agg(F.count("*").alias("pixels"), F.sum("y").alias("rows"), F.sum("x").alias("columns"))


@query(
    f"""WITH {CELLS}, p AS (SELECT l_suppkey AS image_id, {ID} AS id, max(l_extendedprice) % 63 AS y, (max(l_orderkey) * 0.37::DOUBLE) % 63 AS x FROM lineitem GROUP BY ALL), f AS (SELECT *, floor(y)::BIGINT AS fy, floor(x)::BIGINT AS fx FROM p),
v AS (SELECT f.image_id, id, sum((CASE WHEN i = 1 THEN f.y - fy ELSE 1 - (f.y - fy) END) * (CASE WHEN j = 1 THEN f.x - fx ELSE 1 - (f.x - fx) END) * c.v) AS v FROM f, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j), c WHERE c.image_id = f.image_id AND c.y = fy + i AND c.x = fx + j GROUP BY ALL)
SELECT p.image_id, round(sum(coalesce(v, 0)), 5) AS total, count(*) FILTER (WHERE v > 0) AS hit FROM p LEFT JOIN v USING (image_id, id) GROUP BY p.image_id"""
)
def bilinear_samples(spark, sf):
    p = tables.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("image_id"), F.expr(ID).alias("id")).agg((F.max("l_extendedprice") % 63).alias("y"), (F.max("l_orderkey") * 0.37 % 63).alias("x"))
    found = X.sampled(p, cells(spark, sf))
    return found.groupBy("image_id").agg(F.round(F.sum("value"), 5).alias("total"), F.count_if(F.col("value") > 0).alias("hit"))


# ---- regions by colour

_PICTURES = f"p AS (SELECT l_suppkey AS image_id, (l_partkey * 7 % {GRID})::BIGINT AS y, (l_orderkey * 13 % {GRID})::BIGINT AS x, max(l_partkey * 11 % 256)::DOUBLE AS r, max(l_orderkey % 256)::DOUBLE AS g, max(l_linenumber * 36)::DOUBLE AS b FROM lineitem GROUP BY ALL)"
_CLOSE = f"{_density('hue', 0.96, 0.1)} * {_density('sat', 160 / 255, 0.3)} * {_density('val', 200 / 255, 0.5)}"


def pictures(spark: SparkSession, sf: str) -> DataFrame:
    li = tables.table(spark, sf, "lineitem")
    by = li.groupBy(F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") * 7 % GRID).alias("y"), (F.col("l_orderkey") * 13 % GRID).alias("x"))
    return by.agg(*[F.max(v).cast("double").alias(c) for c, v in (("r", F.col("l_partkey") * 11 % 256), ("g", F.col("l_orderkey") % 256), ("b", F.col("l_linenumber") * 36))])


@query(
    f"""WITH RECURSIVE {_PICTURES}, c AS (SELECT image_id * 8 + ((r >= 128)::INT * 2 + (g >= 128)::INT) * 2 + (b >= 128)::INT AS image_id, y, x, 0 AS v FROM p), {grown()},
z AS (SELECT p.image_id, m.image_id AS k, root, count(*) AS size, floor(avg(r)) AS r, floor(avg(g)) AS g, floor(avg(b)) AS b FROM m JOIN p ON p.image_id = m.image_id // 8 AND p.y * 4294967296 + p.x = m.n AND (p.r >= 128)::INT * 4 + (p.g >= 128)::INT * 2 + (p.b >= 128)::INT = m.image_id % 8 GROUP BY ALL)
{HSV.removeprefix(RGB).replace("FROM c)", "FROM z)")}, d AS (SELECT image_id, size, {_CLOSE} AS d FROM h), w AS (SELECT image_id, min(d) AS low, max(d) AS high FROM d GROUP BY ALL), f AS (SELECT image_id, size, (d - low) / (high - low + 2.220446049250313e-16) AS f FROM d JOIN w USING (image_id))
SELECT image_id, count(*) AS regions, coalesce(sum(size) FILTER (WHERE f > 0.2), 0)::BIGINT AS chosen, round(sum(f * size), 5) AS closeness FROM f GROUP BY image_id"""
)
def hue_regions(spark, sf):
    """Regions of one shade in each supplier's picture, pixels of those close to the hue, and the closeness of all pixels."""
    shelf = Scratch(spark, "hue_regions")
    runs = regions.colour_runs(pictures(spark, sf), 2)
    one = runs.groupBy("image_id", "shade", "root").agg(*[F.max(c).alias(c) for c in ("size", *regions.RGB)])  # a region's runs have the same ones
    found = regions.relative_closeness(shelf.table(one, "one"), 0.96).withColumnRenamed("closeness", "f")
    by = found.groupBy("image_id").agg(F.count("*").alias("regions"), F.coalesce(F.sum(F.when(F.col("f") > 0.2, F.col("size"))), F.lit(0)).alias("chosen"), F.round(F.sum(F.col("f") * F.col("size")), 5).alias("closeness"))
    return by


@query()
def segmented_regions(spark, sf):
    """The regions of each supplier's picture, without small holes and objects."""
    return regions.colour_regions(pictures(spark, sf), GRID, GRID, levels=2, least=2)


_FLOOR = math.log(1e-6)
_DENSITY = " + ".join(f"ln(greatest({c} / 255, 1e-6)) / {_FLOOR!r}::DOUBLE * {scalar.UNMIX[k][1]!r}::DOUBLE" for k, c in enumerate("rgb"))
_RED = " + ".join(f"{w}::DOUBLE * least(1, exp(greatest({_DENSITY}, 0) * {s}::DOUBLE * {_FLOOR!r}::DOUBLE))" for w, s in zip((0.2125, 0.7154, 0.0721), scalar.STAINS[1]))
_MASK = f"(SELECT DISTINCT l_suppkey AS image_id, l_partkey * 7 % {GRID} AS y, l_orderkey * 13 % {GRID} AS x, true AS w FROM lineitem WHERE {{}})"
_MASKS = {"returned": "l_returnflag = 'R'", "large": "l_quantity >= 49", "cheap": "l_extendedprice < 1500"}


@query(
    f"""WITH {_PICTURES}, v AS (SELECT image_id, y, x, floor(({_RED}) * 255) AS red, floor(0.2125::DOUBLE * r + 0.7154::DOUBLE * g + 0.0721::DOUBLE * b) AS grey FROM p)
SELECT v.image_id, {", ".join(f"round(coalesce(avg(red) FILTER (WHERE {n}.w AND red < 180), avg(grey) FILTER (WHERE {n}.w), 0), 6) AS {n}" for n in _MASKS)} FROM v {" ".join(f"LEFT JOIN {_MASK.format(c)} {n} ON {n}.image_id = v.image_id AND {n}.y = v.y AND {n}.x = v.x" for n, c in _MASKS.items())} GROUP BY v.image_id"""
)
def intensities_under_masks(spark, sf):
    li = tables.table(spark, sf, "lineitem")
    masks = {n: li.where(c).select(F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") * 7 % GRID).alias("y"), (F.col("l_orderkey") * 13 % GRID).alias("x")) for n, c in _MASKS.items()}
    return regions.masked_intensities(pictures(spark, sf), masks).select("image_id", *[r6(n, n) for n in masks])
