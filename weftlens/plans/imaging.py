"""Queries that run the per-image kernels. Rasters are 64 x 64 grids of the metrics tables, one a supplier or nation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kernels as K, pixels as X
from ..sources import tables
from .catalog import query

GRID = 64


def rasters(cells: DataFrame, side: int = GRID) -> DataFrame:
    """images (image_id, height, width, data) of cells (image_id, y, x, v); what is missing is 0. One shuffle by image.

    Cells are summed before the shuffle and travel as flat lists of places and values.
    """
    summed = cells.groupBy("image_id", (F.col("y") * side + F.col("x")).cast("int").alias("at")).agg(F.sum(F.col("v").cast("double")).alias("v"))
    one = summed.groupBy("image_id").agg(F.collect_list(F.struct("at", "v")).alias("c")).select("image_id", F.col("c.at").alias("at"), F.col("c.v").alias("v"))

    def run(batches):
        import pyarrow as pa

        for batch in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            data = []
            for at, v in zip(batch.column(1), batch.column(2), strict=True):
                m = np.zeros(side * side)
                m[at.values.to_numpy(zero_copy_only=False)] = v.values.to_numpy(zero_copy_only=False)
                data.append(m.tobytes())
            n = batch.num_rows
            yield pa.record_batch([batch.column(0), pa.array([side] * n, pa.int32()), pa.array([side] * n, pa.int32()), pa.array(data, pa.binary())], names=["image_id", "height", "width", "data"])

    return one.mapInArrow(run, f"image_id {dict(cells.dtypes)['image_id']}, height int, width int, data binary")


def supplier_rasters(spark: SparkSession, sf: str) -> DataFrame:
    li = tables.table(spark, sf, "lineitem")
    cells = li.select(F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") * 7 % GRID).cast("int").alias("y"), (F.col("l_orderkey") * 13 % GRID).cast("int").alias("x"), F.lit(1.0).alias("v"))
    return rasters(cells)


NATION = "c AS (SELECT DISTINCT c_nationkey AS image_id, (c_custkey * 7 % 64)::INT AS y, ((floor(c_acctbal)::BIGINT % 64 + 64) % 64)::INT AS x FROM customer)"


def nation_cells(spark: SparkSession, sf: str) -> DataFrame:
    c = tables.table(spark, sf, "customer")
    return c.select(F.col("c_nationkey").alias("image_id"), (F.col("c_custkey") * 7 % GRID).alias("y"), F.pmod(F.floor("c_acctbal").cast("long"), F.lit(GRID)).cast("long").alias("x"), F.lit(1.0).alias("v"))


@query(
    f"WITH {NATION}, g AS (SELECT image_id, y, x FROM (SELECT DISTINCT image_id FROM c), (SELECT unnest(range(64))::INT AS y), (SELECT unnest(range(64))::INT AS x)), d AS (SELECT g.image_id, g.y, g.x, min((g.y - c.y) ** 2 + (g.x - c.x) ** 2) AS d FROM g JOIN c USING (image_id) GROUP BY ALL) SELECT image_id, round(max(sqrt(d)), 6) AS farthest, round(sum(sqrt(d)), 6) AS total FROM d GROUP BY image_id"
)
def distance_transform(spark, sf):
    d = X.distances(nation_cells(spark, sf), GRID, GRID)
    return d.groupBy("image_id").agg(F.round(F.max(F.sqrt("d2")), 6).alias("farthest"), F.round(F.sum(F.sqrt("d2")), 6).alias("total"))


@query(f"WITH {NATION}, k AS (SELECT image_id, count(*) AS pixels FROM c GROUP BY image_id) SELECT image_id, pixels FROM k")
def mask_pixels(spark, sf):
    return nation_cells(spark, sf).distinct().groupBy("image_id").agg(F.count("*").alias("pixels"))


@query(
    f"""WITH RECURSIVE {NATION}, e AS (SELECT a.image_id, a.y * 64 + a.x AS s, b.y * 64 + b.x AS t FROM c a JOIN c b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1), r(image_id, n, root) AS (SELECT image_id, s, s FROM e WHERE s = t UNION SELECT r.image_id, e.t, r.root FROM r JOIN e ON r.image_id = e.image_id AND r.n = e.s WHERE r.root < e.t)
SELECT image_id, count(DISTINCT m) AS components FROM (SELECT image_id, n, min(root) AS m FROM r GROUP BY ALL) GROUP BY image_id"""
)
def raster_components(spark, sf):
    return X.labelled_runs(nation_cells(spark, sf)).groupBy("image_id").agg(F.count_distinct("root").alias("components"))


@query()
def skeleton_metrics(spark, sf):
    return K.per_image(supplier_rasters(spark, sf), lambda m: K.skeleton_metrics(m), "area long, length long, tips long, branches long, mean_length double, lacunarity double, longest double, curvature array<double>")


@query()
def gap_circles(spark, sf):
    return K.per_image(supplier_rasters(spark, sf), lambda m: K.gap_circles(m == 0, 2.0), "y double, x double, r double")


@query()
def intra_roi_gaps(spark, sf):
    def fn(m):
        roi = K.filtered(m, *[np.ones(9) / 9] * 2) > 0.1
        return [c for c in K.gap_circles(m == 0, 2.0) if roi[int(c[0]), int(c[1])]]

    g = K.per_image(supplier_rasters(spark, sf), fn, "y double, x double, r double")
    area = F.pi() * F.col("r") * F.col("r")
    return g.groupBy("image_id").agg(F.count("*").alias("n"), F.avg(area).alias("mean_area"), F.avg("r").alias("mean_radius"))


def _smooth(m):
    return K.filtered(m, *[np.array([1, 2, 3, 2, 1]) / 9] * 2)


@query()
def ridge_contours(spark, sf):
    def fn(m):
        image = _smooth(m)
        maps = K.ridge_maps(image, (3, 5), dark=False)
        lines = K.linked_contours(maps, 0.02, 0.05, 5)
        return [(k, len(c), float(np.hypot(*np.diff(c[:, :2], axis=0).T).sum()), float(c[:, 2].mean())) for k, c in enumerate(lines)]

    return K.per_image(supplier_rasters(spark, sf), fn, "contour_id long, n_points long, length double, response double")


@query()
def contour_widths(spark, sf):
    def fn(m):
        image = _smooth(m)
        maps = K.ridge_maps(image, (3, 5), dark=False)
        found = K.widths_of(image, K.linked_contours(maps, 0.02, 0.05, 5), maps)
        return [(k, None if np.isnan(w).all() else float(np.nanmean(w))) for k, w in enumerate(found)]

    return K.per_image(supplier_rasters(spark, sf), fn, "contour_id long, width double")


@query()
def contour_junctions(spark, sf):
    def fn(m):
        return K.junctions(K.linked_contours(K.ridge_maps(_smooth(m), (3, 5), dark=False), 0.02, 0.05, 5))

    return K.per_image(supplier_rasters(spark, sf), fn, "cont1 long, cont2 long, pos long, y double, x double")


@query()
def roi_segments(spark, sf):
    def fn(m):
        mask = K.regions(_smooth(m), least=16)
        return [(int(mask.sum()), int(K.labels(mask).max()))]

    return K.per_image(supplier_rasters(spark, sf), fn, "roi_pixels long, regions long")
