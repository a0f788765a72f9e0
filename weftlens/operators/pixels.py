"""Pixels as rows: components of runs, hysteresis, exact distances, stencils with halos, ray widths, pixel graphs.

Rasters may be larger than a task: nothing here holds more than a row, a column or a tile of one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from . import chunks
from .graphs import components
from .points import chosen_circles
from .tabular import gaps_filled

#: A pixel's number is its row times this and its column, so numbers go in raster order.
ROW = 1 << 32


def runs(pixels: DataFrame, sums: Sequence[str] = ()) -> DataFrame:
    """(image_id, y, x0, x1, top, *sums): runs of neighbouring pixels (image_id, y, x, v) of a row, the largest v in them and sums of columns."""
    one = pixels.groupBy("image_id", "y", "x").agg(*[F.max(c).alias(c) for c in ("v", *sums)])
    island = F.col("x") - F.row_number().over(Window.partitionBy("image_id", "y").orderBy("x"))
    return one.withColumn("_i", island).groupBy("image_id", "y", "_i").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.max("v").alias("top"), *[F.sum(c).alias(c) for c in sums]).drop("_i")


def touching(found: DataFrame, corners: bool = True) -> DataFrame:
    """Edges (image_id, src, dst) between runs of neighbouring rows, two a run at most.

    Of two runs that touch, the one that ends first has the other as the last run of its row that starts before its end: so one
    sorted pass over the starts and ends of two rows finds all that connects, however many runs they have.
    """
    reach = 1 if corners else 0
    run = F.struct("x0", "x1", (F.col("y").cast("long") * ROW + F.col("x0")).alias("id"))
    sides = F.explode(F.array(F.struct(F.col("y").alias("pair"), F.lit(0).alias("side")), F.struct((F.col("y") - 1).alias("pair"), F.lit(1).alias("side")))).alias("s")
    marks = F.explode(F.array(F.struct(F.col("run.x0").alias("at"), F.lit(0).alias("ask")), F.struct((F.col("run.x1") + reach).alias("at"), F.lit(1).alias("ask")))).alias("m")
    rows = found.select("image_id", run.alias("run"), sides).select("image_id", "run", "s.*", marks).select("image_id", "run", "pair", "side", "m.*")
    w = Window.partitionBy("image_id", "pair").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0)
    last = {f"_{k}": F.last(F.when((F.col("ask") == 0) & (F.col("side") == k), F.col("run")), True).over(w) for k in (0, 1)}
    other = F.when(F.col("side") == 0, F.col("_1")).otherwise(F.col("_0"))
    met = rows.withColumns(last).where("ask = 1").withColumn("_o", other).where(F.col("_o.x1") >= F.col("run.x0") - reach)
    return met.select("image_id", F.col("run.id").alias("src"), F.col("_o.id").alias("dst"))


def labelled_runs(pixels: DataFrame, corners: bool = True, sums: Sequence[str] = (), most: int = chunks.MOST) -> DataFrame:
    """runs() with root, the number of the component's first pixel, size, its pixels, peak, its largest v, and its sums.

    Rasters of at most so many pixels are settled within tasks, many at a time. In larger ones runs, not pixels, are the nodes of the star
    steps; sizes are added up by component before they are joined back.
    """
    shelf = Scratch(pixels.sparkSession, "runs")
    one = shelf.table(pixels.dropna(subset=["y", "x"]).groupBy("image_id", "y", "x").agg(*[F.max(c).cast("double").alias(c) for c in ("v", *sums)]), "pixels")
    small, large = chunks.halves(one, ["image_id"], shelf, "pixels", most)
    kinds = dict(pixels.dtypes)
    schema = ", ".join([f"y {kinds['y']}", f"x0 {kinds['x']}", f"x1 {kinds['x']}", "top double", "root long", "size long", "peak double", *[f"{c} double" for c in sums]])
    found = chunks.by_key(small, ["image_id"], ["y", "x"], chunks.labelled_runs(int(corners), sums, ROW), schema, most)
    return found if large is None else found.unionByName(_by_stars(large, corners, sums, shelf))


def _by_stars(pixels: DataFrame, corners: bool, sums: Sequence[str], shelf: Scratch) -> DataFrame:
    found = shelf.table(runs(pixels, sums), "runs")
    number = (F.col("y").cast("long") * ROW + F.col("x0")).alias("node")
    alone = found.select("image_id", number.alias("src"), number.alias("dst"))
    roots = components(touching(found, corners).union(alone), "image_id")
    named = shelf.table(found.withColumn("node", number).join(roots, ["image_id", "node"]).drop("node"), "named")
    sizes = shelf.table(named.groupBy("image_id", "root").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("size"), F.max("top").alias("peak"), *[F.sum(c).alias(c) for c in sums]), "sizes")
    return named.drop(*sums).join(sizes, ["image_id", "root"])


def of_runs(found: DataFrame, *more: str) -> DataFrame:
    """(image_id, y, x, *more): the pixels of runs."""
    return found.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), *more)


def large_components(pixels: DataFrame, least: int, corners: bool = True) -> DataFrame:
    """The pixels of components of at least so many."""
    return of_runs(labelled_runs(pixels, corners).where(F.col("size") >= least), "root", "size")


def hysteresis(pixels: DataFrame, low: float, high: float) -> DataFrame:
    """The pixels with v from low on whose component holds one from high on."""
    return of_runs(labelled_runs(pixels.where(F.col("v") >= low)).where(F.col("peak") >= high), "root", "size")


def distances(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """(image_id, y, x, d2): squared distance of each place of a raster to the nearest of its pixels (image_id, y, x).

    The set pixels of a column, sorted, divide its places; then each row of the raster has the lower envelope of its
    columns' parabolas, whose stretches are read off, many rows at a time. Two shuffles; images without a pixel have no rows.
    """
    one = pixels.select("image_id", "y", "x").dropna().distinct()
    columns = one.groupBy("image_id", "x").agg(F.sort_array(F.collect_list("y")).alias("set"))  # one column of a raster
    grid = columns.select("image_id", "x", F.posexplode("set").alias("k", "y"), F.size("set").alias("m"), "set")
    until = F.when(F.col("k") == F.col("m") - 1, height - 1).otherwise(F.floor((F.col("y") + F.get("set", F.col("k") + 1)) / 2))
    since = F.when(F.col("k") == 0, 0).otherwise(F.floor((F.get("set", F.col("k") - 1) + F.col("y")) / 2) + 1)
    near = grid.withColumns({"_a": since.cast("long"), "_b": until.cast("long")}).where("_a <= _b").select("image_id", "x", "y", F.explode(F.sequence("_a", "_b")).alias("row"))
    gap = (F.col("row") - F.col("y")).cast("double")
    places = near.select("image_id", F.col("row").alias("y"), F.col("x").cast("double").alias("x"), (gap * gap).alias("f"))
    spans = chunks.by_key(places, ["image_id", "y"], ["x"], partial(chunks.lower_envelopes, width=width), "at double, f double, _a long, _b long")
    out = spans.select("image_id", "y", "at", "f", F.explode(F.sequence("_a", "_b")).alias("x"))
    step = F.col("x") - F.col("at")
    return out.select("image_id", "y", "x", (step * step + F.col("f")).alias("d2"))


def tiles_of(pixels: DataFrame, side: int, height: int, width: int) -> DataFrame:
    """Tiles (image_id, ty, tx, th, tw, h, w, v) of rasters given by pixels (image_id, y, x, v); what is missing is 0.

    Tiles have side x side places, the last ones of an axis what is left. Every tile of an image with a pixel is there.
    """
    down, across = -(-height // side), -(-width // side)
    cells = pixels.groupBy("image_id", F.floor(F.col("y") / side).cast("int").alias("ty"), F.floor(F.col("x") / side).cast("int").alias("tx"), F.col("y"), F.col("x")).agg(F.sum("v").alias("v"))
    at = ((F.col("y") - F.col("ty") * side) * side + F.col("x") - F.col("tx") * side).cast("int").alias("at")
    held = cells.groupBy("image_id", "ty", "tx").agg(F.collect_list(F.struct(at, F.col("v").cast("double").alias("v"))).alias("m"))  # one tile
    every = pixels.select("image_id").distinct().withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    th, tw = F.least(F.lit(side), height - F.col("ty") * side), F.least(F.lit(side), width - F.col("tx") * side)
    full = every.join(held, ["image_id", "ty", "tx"], "left").withColumns({"th": th, "tw": tw, "h": F.lit(height), "w": F.lit(width)})

    def dense(row):
        m = np.zeros(side * side)
        m[row["at"]] = np.nan_to_num(row["v"], nan=0.0) if np.isnan(row["v"]).any() else row["v"]
        return m.reshape(side, side)[: row["th"], : row["tw"]].ravel()

    return _each_tile(full.select(*TILE, F.col("m.at").alias("at"), F.col("m.v").alias("v")), dense, side)


#: A tile's place, its own size and that of its raster.
TILE = ("image_id", "ty", "tx", "th", "tw", "h", "w")


def _each_tile(tiles: DataFrame, fn: Callable[[dict], np.ndarray], side: int) -> DataFrame:
    """TILE and v, the values that fn gives for a row's numbers and arrays. Batches have about four million places at most."""
    most = max(1, (1 << 22) // (side * side))
    lists = [c for c in tiles.columns if c not in TILE]

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for start in range(0, whole.num_rows, most):
                batch = whole.slice(start, most)
                own = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in TILE[1:]}
                more = {}
                for c in lists:
                    col = batch.column(c)
                    values, ends = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
                    more[c] = values, ends
                out = [fn({**{c: int(v[k]) for c, v in own.items()}, **{c: v[e[k] : e[k + 1]] for c, (v, e) in more.items()}}) for k in range(batch.num_rows)]
                ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
                yield pa.record_batch([*[batch.column(c) for c in TILE], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out)))], names=[*TILE, "v"])

    kinds = dict(tiles.dtypes)
    return tiles.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in TILE) + ", v array<double>")


def stencilled(tiles: DataFrame, side: int, down: Sequence[float], across: Sequence[float]) -> DataFrame:
    """tiles with v filtered by the separable kernel (down, across: odd lengths) as if each raster were whole; borders reflect.

    Each tile sends to its eight neighbours only the strips that their stencils reach, so a shuffle moves each tile once and
    little more. The last tiles of an axis must be at least as wide as the kernel's arm.
    """
    r, s = len(down) // 2, len(across) // 2
    ok = (F.col("th") >= r) & (F.col("tw") >= s) & F.lit(side >= max(r, s))
    safe = F.when(ok, F.col("v")).otherwise(F.raise_error(F.lit("a tile is narrower than the stencil's arm")).cast("array<double>"))

    def strip(sy: int, sx: int) -> Column:
        y0, high = (F.col("th") - r, F.lit(r)) if sy < 0 else (F.lit(0), F.lit(r) if sy else F.col("th"))
        x0, wide = (F.col("tw") - s, F.lit(s)) if sx < 0 else (F.lit(0), F.lit(s) if sx else F.col("tw"))
        rows = F.transform(F.sequence(y0, y0 + high - 1), lambda y: F.slice("_v", y * F.col("tw") + x0 + 1, wide))
        some = (high > 0) & (wide > 0)
        return F.struct(F.lit(sy).alias("sy"), F.lit(sx).alias("sx"), F.when(some, F.flatten(rows)).alias("part"))

    # sy, sx: where the sender lies as seen from the tile that gets the strip
    sent = tiles.withColumn("_v", safe).withColumn("_s", F.explode(F.array(*[strip(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)])))
    to = sent.withColumns({"ty": F.col("ty") - F.col("_s.sy"), "tx": F.col("tx") - F.col("_s.sx")})
    to = to.where((F.col("ty") >= 0) & (F.col("tx") >= 0) & (F.col("ty") * side < F.col("h")) & (F.col("tx") * side < F.col("w")))
    part = F.struct((F.col("_s.sy") * 3 + F.col("_s.sx")).alias("k"), F.coalesce("_s.part", F.array().cast("array<double>")).alias("p"))
    got = to.groupBy("image_id", "ty", "tx").agg(F.max("h").alias("h"), F.max("w").alias("w"), F.sort_array(F.collect_list(part)).alias("m"))  # nine at most
    got = got.withColumns({"th": F.least(F.lit(side), F.col("h") - F.col("ty") * side), "tw": F.least(F.lit(side), F.col("w") - F.col("tx") * side)})
    flat = got.select(*TILE, F.col("m.k").alias("k"), F.flatten("m.p").alias("p"))

    def places(own: int, arm: int, first: int, n: int) -> np.ndarray:
        """Where the padded tile's rows or columns stand when borders reflect."""
        at = np.arange(first - arm, first + own + arm)
        return np.where(at < 0, -1 - at, np.where(at >= n, 2 * n - 1 - at, at)) - first + arm

    def filtered(row):
        th, tw = row["th"], row["tw"]
        padded, used = np.zeros((th + 2 * r, tw + 2 * s)), 0
        spans = {-1: (0, r), 0: (r, r + th), 1: (r + th, th + 2 * r)}, {-1: (0, s), 0: (s, s + tw), 1: (s + tw, tw + 2 * s)}
        for k in row["k"]:
            sy = (int(k) + 4) // 3 - 1
            (a, b), (c, d) = spans[0][sy], spans[1][int(k) - 3 * sy]
            n = (b - a) * (d - c)
            if n:
                padded[a:b, c:d] = row["p"][used : used + n].reshape(b - a, d - c)
                used += n
        whole = padded[places(th, r, row["ty"] * side, row["h"])][:, places(tw, s, row["tx"] * side, row["w"])]
        first = sum(float(k) * whole[j : j + th] for j, k in enumerate(down))
        return sum(float(k) * first[:, j : j + tw] for j, k in enumerate(across)).ravel()

    return _each_tile(flat, filtered, side)


def tile_pixels(tiles: DataFrame, side: int) -> DataFrame:
    """(image_id, y, x, v) of tiles."""
    one = tiles.select("image_id", "ty", "tx", "tw", F.posexplode("v").alias("i", "v"))
    return one.select("image_id", (F.col("ty") * side + F.floor(F.col("i") / F.col("tw"))).cast("long").alias("y"), (F.col("tx") * side + F.col("i") % F.col("tw")).cast("long").alias("x"), "v")


def ray_widths(points: DataFrame, edge: DataFrame, longest: int, most: int = chunks.MOST) -> DataFrame:
    """points (image_id, contour_id, idx, y, x, angle) with left, right and width, all in steps, and filled.

    From each point rays go along its angle and against it; the first pixel of edge (image_id, y, x) that one meets within longest
    steps gives the side. width is their sum where both meet one, and filled bridges gaps by the length along the contour.

    Images of at most so many points and edge pixels cast their rays within tasks; in larger ones each step of a ray is a row.
    """
    shelf = Scratch(points.sparkSession, "rays")
    own = [c for c in points.columns if c not in ("image_id", "y", "x", "angle")]
    asked = points.withColumns({"y": F.col("y").cast("double"), "x": F.col("x").cast("double"), "sin": F.sin("angle"), "cos": F.cos("angle"), "_t": F.lit(0)})
    shown = edge.select("image_id", F.col("y").cast("long").cast("double").alias("y"), F.col("x").cast("long").cast("double").alias("x"), F.lit(1).alias("_t")).distinct()
    both = shelf.table(asked.unionByName(shown, allowMissingColumns=True), "both")
    small, large = chunks.halves(both, ["image_id"], shelf, "both", most)
    alone = both.where("image_id is null and _t = 0").select(*points.columns, *[F.lit(0).alias(c) for c in ("left", "right")])  # they meet nothing
    carried = small.withColumns({"_y": F.col("y"), "_x": F.col("x")}).withColumnsRenamed({"_y": "py", "_x": "px"})
    met = chunks.by_key(carried, ["image_id"], [], chunks.first_hits(longest), "left int, right int", most, [*own, "angle", "py", "px"])
    met = met.withColumnsRenamed({"py": "y", "px": "x"}).select(*points.columns, "left", "right").union(alone)
    met = met.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in ("left", "right")})
    if large is not None:
        met = met.unionByName(_ray_hits(large.where("_t = 0").select(*points.columns), large.where("_t = 1"), longest))
    key = F.struct("image_id", "contour_id").alias("_c")
    w = Window.partitionBy("_c").orderBy("idx")
    step = F.coalesce(F.hypot(F.col("y") - F.lag("y").over(w), F.col("x") - F.lag("x").over(w)), F.lit(0.0))
    met = met.withColumn("width", (F.col("left") + F.col("right")).cast("double"))
    along = met.withColumn("_c", key).withColumn("_step", step).withColumn("along", F.sum("_step").over(w))
    return gaps_filled(along, "_c", ["idx"], "width", "along").drop("_c", "_step")


def _ray_hits(points: DataFrame, edge: DataFrame, longest: int) -> DataFrame:
    side = F.explode(F.array(F.lit(-1), F.lit(1))).alias("s")
    steps = points.select("*", side).select("*", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("t"))
    cast = steps.select("image_id", "contour_id", "idx", "s", "t", F.floor(F.col("y") + F.col("s") * F.col("t") * F.sin("angle") + 0.5).alias("y"), F.floor(F.col("x") + F.col("s") * F.col("t") * F.cos("angle") + 0.5).alias("x"))
    hit = cast.join(edge.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct(), ["image_id", "y", "x"])
    sides = hit.groupBy("image_id", "contour_id", "idx").agg(F.min(F.when(F.col("s") < 0, F.col("t"))).alias("left"), F.min(F.when(F.col("s") > 0, F.col("t"))).alias("right"))
    return points.join(sides, ["image_id", "contour_id", "idx"], "left")


def pixel_graph(pixels: DataFrame, most: int = chunks.MOST) -> DataFrame:
    """Edges (image_id, src, dst, length) between neighbouring pixels, numbered in raster order.

    Rasters of at most so many pixels are settled within tasks, many at a time; in larger ones each pixel asks four places.
    """
    shelf = Scratch(pixels.sparkSession, "graph")
    one = shelf.table(pixels.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).dropna(), "pixels")
    small, large = chunks.halves(one, ["image_id"], shelf, "pixels", most)
    found = chunks.by_key(small, ["image_id"], ["y", "x"], chunks.pixel_edges(ROW), "src long, dst long, length double", most)
    return found if large is None else found.union(_edges_by_joins(large.distinct()))


def _edges_by_joins(one: DataFrame) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(math.hypot(dy, dx)).alias("length")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    ask = one.select("image_id", (F.col("y") * ROW + F.col("x")).alias("src"), "y", "x", F.explode(steps).alias("s")).select("image_id", "src", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "s.length")
    return ask.join(one, ["image_id", "y", "x"]).select("image_id", "src", (F.col("y") * ROW + F.col("x")).alias("dst"), "length")


#: Neighbours clockwise from the one above; the k-th sets bit k of a code.
AROUND = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
UP, RIGHT, DOWN, LEFT = 1, 4, 16, 64


#: Places of a tile's side for what neighbours decide.
CORE = 256


def _by_tiles(pixels: DataFrame, reach: int, fn: Callable, schema: str, side: int = CORE) -> DataFrame:
    """(image_id, …, schema) of fn over tiles of pixels (image_id, y, x, core), which also hold what lies within reach of them and isn't their own.

    One shuffle of little more than the pixels; a tile has at most the places of its square.
    """
    one = pixels.select("image_id", "y", "x")
    at = {t: F.explode(F.sequence(F.floor((F.col(c) - reach) / side).cast("int"), F.floor((F.col(c) + reach) / side).cast("int"))) for t, c in (("ty", "y"), ("tx", "x"))}
    held = one.withColumn("ty", at["ty"]).withColumn("tx", at["tx"])
    own = (F.floor(F.col("y") / side) == F.col("ty")) & (F.floor(F.col("x") / side) == F.col("tx"))
    return chunks.by_key(held.withColumn("core", own), ["image_id", "ty", "tx"], ["y", "x"], fn, schema)


def neighbour_codes(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, code) of distinct pixels: which of the eight around each are set, as bits in the order of AROUND."""
    kinds = dict(pixels.dtypes)
    return _by_tiles(pixels, 1, chunks.neighbour_codes(AROUND), f"y long, x long, code int").select("image_id", F.col("y").cast(kinds["y"]).alias("y"), F.col("x").cast(kinds["x"]).alias("x"), "code")


def neighbours_of(code: Column) -> Column:
    return F.bit_count(code)


def crossings_of(code: Column) -> Column:
    """How often unset turns to set on the way around a pixel."""
    turned = F.shiftright(code, 1).bitwiseOR(F.shiftleft(code.bitwiseAND(1), 7))
    return F.bit_count(turned.bitwiseAND(F.bitwise_not(code)).bitwiseAND(255))


def matches(code: Column, patterns: Sequence[Sequence[Sequence[int]]]) -> Column:
    """Whether any of the 3 x 3 patterns fits around a set pixel: 1 set, 0 unset, -1 either; its middle is 1."""
    hits = []
    for p in patterns:
        care = sum(1 << k for k, (dy, dx) in enumerate(AROUND) if p[1 + dy][1 + dx] >= 0)
        want = sum(1 << k for k, (dy, dx) in enumerate(AROUND) if p[1 + dy][1 + dx] == 1)
        hits.append(code.bitwiseAND(care) == want)
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


#: Half rounds of thinning that a tile makes before it has to hear from those around it; an even number.
HALF_ROUNDS = 8


def _going(sides: Sequence[int]) -> np.ndarray:
    """For each code whether a pixel goes: two to six neighbours, one crossing, and none of the sides' triples complete."""
    code = np.arange(256)
    turned = (code >> 1) | ((code & 1) << 7)
    n, crossings = (np.array([int(c).bit_count() for c in k]) for k in (code, turned & ~code & 255))
    return (n >= 2) & (n <= 6) & (crossings == 1) & np.all([code & s != s for s in sides], axis=0)


def thinned(pixels: DataFrame, side: int = CORE) -> DataFrame:
    """(image_id, y, x) of the lines that are left of pixels when borders are taken off alternately from two sides.

    A pixel goes in a half round if it has two to six neighbours, one crossing, and lacks a neighbour on the sides in turn; all of a half round go at a
    time, so the result doesn't hang on partitions. What is left of a place after some half rounds hangs only on those as many places away, so tiles
    make several of them between two shuffles; the shuffles grow with the width of what is thinned.
    """
    shelf, kinds = Scratch(pixels.sparkSession, "thinned"), dict(pixels.dtypes)
    goes = [_going(s) for s in ((UP | RIGHT | DOWN, RIGHT | DOWN | LEFT), (UP | RIGHT | LEFT, UP | DOWN | LEFT))]
    now, k = pixels, 0
    while True:
        made = shelf.table(_by_tiles(now, HALF_ROUNDS, chunks.thinned(AROUND, goes, HALF_ROUNDS), "y long, x long, late boolean", side).drop("ty", "tx"), f"round-{k}")
        if k:
            shelf.drop(f"round-{k - 1}")
        now, k = made.where("not late").select("image_id", F.col("y").cast(kinds["y"]).alias("y"), F.col("x").cast(kinds["x"]).alias("x")), k + 1
        if made.where("late").isEmpty():
            return now


def key_points(lines: DataFrame) -> DataFrame:
    """(image_id, y, x, kind) of the ends (one neighbour) and junctions (three crossings or more) of thin lines."""
    code = F.col("code")
    kind = F.when(neighbours_of(code) == 1, "end").when(crossings_of(code) >= 3, "junction")
    return neighbour_codes(lines).withColumn("kind", kind).where("kind is not null").drop("code")


def without_small_holes(pixels: DataFrame, height: int, width: int, least: int, at_border: bool = False) -> DataFrame:
    """(image_id, y, x) of pixels and of the holes in them of fewer than least pixels, that is those not joined to the border by a side.

    With at_border, small gaps at the border are filled as well.
    """
    one = pixels.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()
    grid = one.select("image_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long")))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))))
    free = grid.join(one, ["image_id", "y", "x"], "left_anti")
    border = ((F.col("y") == 0) | (F.col("y") == height - 1) | (F.col("x") == 0) | (F.col("x") == width - 1)).cast("double")
    holes = labelled_runs(free.withColumn("v", border), corners=False).where((F.lit(at_border) | (F.col("peak") == 0)) & (F.col("size") < least))
    return one.union(of_runs(holes).select("image_id", "y", "x"))


def gap_circles(pixels: DataFrame, height: int, width: int, least: float, apart: int, rounds: int | None = None, most: int = chunks.MOST) -> DataFrame:
    """Circles (image_id, y, x, r, round) that fill the gaps between pixels: largest first, none over another of its round.

    A round takes the distances to the pixels, the places that are the largest within apart on both axes and farther than least, and the greedy
    choice among their circles; the discs of what it took are pixels for the next one. It ends when no place is left, or after so many rounds.
    Rasters of at most so many places are settled within tasks, so their pixels are shuffled once; larger ones go by rounds of tables.
    """
    if height * width <= most:
        known = pixels.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).dropna()
        known = known.repartition("image_id").distinct()
        return chunks.by_key(known, ["image_id"], [], chunks.gap_circles(height, width, least, apart, rounds), "y double, x double, r double, round int", dealt=True)
    shelf = Scratch(pixels.sparkSession, "gaps")
    mask, found, k = shelf.table(pixels.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct(), "mask-0"), [], 0
    while rounds is None or k < rounds:
        d = distances(mask, height, width)
        across = Window.partitionBy("image_id", "y").orderBy("x").rangeBetween(-apart, apart)
        down = Window.partitionBy("image_id", "x").orderBy("y").rangeBetween(-apart, apart)
        top = d.withColumn("_row", F.max("d2").over(across)).withColumn("_top", F.max("_row").over(down))
        able = top.where((F.col("d2") == F.col("_top")) & (F.col("d2") > least * least)).select("image_id", (F.col("y") * ROW + F.col("x")).alias("id"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.sqrt("d2").alias("r"))
        k += 1
        new = shelf.table(chosen_circles(shelf.table(able, f"able-{k}"), "image_id").withColumn("round", F.lit(k)), f"round-{k}")
        if new.isEmpty():
            break
        found.append(new)
        whole = F.floor("r").cast("long")
        rows = new.withColumns({"_r": whole, "_dy": F.explode(F.sequence(-whole, whole))}).withColumn("_w", F.floor(F.sqrt(F.col("_r") * F.col("_r") - F.col("_dy") * F.col("_dy"))))
        disc = rows.select("image_id", (F.col("y") + F.col("_dy")).cast("long").alias("y"), F.explode(F.sequence((F.col("x") - F.col("_w")).cast("long"), (F.col("x") + F.col("_w")).cast("long"))).alias("x")).where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
        mask = shelf.table(mask.union(disc).distinct(), f"mask-{k}")
        shelf.drop(f"mask-{k - 1}", f"able-{k}")
    if not found:
        return pixels.sparkSession.createDataFrame([], f"image_id {dict(pixels.dtypes)['image_id']}, y double, x double, r double, round int")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.select("image_id", "y", "x", "r", "round")


def inside(circles: DataFrame, region: DataFrame) -> DataFrame:
    """The circles whose centre is a pixel of region (image_id, y, x)."""
    places = region.select("image_id", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")).distinct()
    return circles.join(places, ["image_id", "y", "x"], "left_semi")


def line_pixels(segments: DataFrame) -> DataFrame:
    """(segment columns, at, y, x): the pixels of segments (y0, x0, y1, x1 whole numbers), one for each step of the longer axis."""
    dy, dx = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    n = F.greatest(F.abs(dy), F.abs(dx))
    steps = segments.withColumn("_n", n).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long"))))

    def along(start: str, step: Column) -> Column:
        # half steps go up; whole numbers throughout, so no rounding error moves a pixel
        return F.when(F.col("_n") == 0, F.col(start)).otherwise(F.col(start) + F.floor((2 * F.col("at") * step + F.col("_n")) / F.when(F.col("_n") > 0, 2 * F.col("_n")))).cast("long")

    return steps.select(*segments.columns, "at", along("y0", dy).alias("y"), along("x0", dx).alias("x"))


def sampled(points: DataFrame, raster: DataFrame) -> DataFrame:
    """points (image_id, id, y, x) with value, bilinear between the four pixels of raster (image_id, y, x, v) around; missing pixels are 0."""
    at = points.withColumns({"_y": F.floor("y"), "_x": F.floor("x")}).withColumns({"_a": F.col("y") - F.col("_y"), "_b": F.col("x") - F.col("_x")})
    corners = F.explode(F.array(*[F.struct((F.col("_y") + i).alias("y"), (F.col("_x") + j).alias("x"), ((F.col("_a") if i else 1 - F.col("_a")) * (F.col("_b") if j else 1 - F.col("_b"))).alias("share")) for i in (0, 1) for j in (0, 1)]))
    met = at.select("image_id", "id", corners.alias("c")).select("image_id", "id", "c.*").where("share > 0")
    summed = met.join(raster.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "v"), ["image_id", "y", "x"]).groupBy("image_id", "id").agg(F.sum(F.col("share") * F.col("v")).alias("value"))
    return points.join(summed, ["image_id", "id"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
