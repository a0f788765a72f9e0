"""Raster operators on arrays: one row is one image, so nothing is shuffled.

A raster is a column of h * w numbers, row by row. Stencils read their neighbours by index with the border rule of the operator
(nearest, reflect or mirror) and stay inside one projection; percentiles of an image sort its own array.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _index(i: Column, d: int, n: int, border: str) -> Column:
    j = i + d
    if border == "nearest":
        return F.least(F.greatest(j, F.lit(0)), F.lit(n - 1))
    if border == "reflect":  # d c b a | a b c d | d c b a
        return F.when(j < 0, -1 - j).when(j >= n, 2 * n - 1 - j).otherwise(j)
    if border == "mirror":  # d c b | a b c d | c b a
        return F.when(j < 0, -j).when(j >= n, 2 * n - 2 - j).otherwise(j)
    raise ValueError(border)


def at(raster: Column, i: Column, dy: int, dx: int, h: int, w: int, border: str) -> Column:
    y, x = (i / w).cast("int"), i % w
    return F.get(raster, (_index(y, dy, h, border) * w + _index(x, dx, w, border)).cast("int"))


def each(h: int, w: int, fn: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), fn)


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with value worked out once a row, however often fn uses it and whatever projections are merged."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def convolve(raster: Column, kernel: Sequence[Sequence[float]], h: int, w: int, border: str) -> Column:
    """Correlation with an odd-sized kernel."""
    ry, rx = len(kernel) // 2, len(kernel[0]) // 2

    def value(a: Column, i: Column) -> Column:
        terms = [F.lit(float(k)) * at(a, i, y - ry, x - rx, h, w, border) for y, row in enumerate(kernel) for x, k in enumerate(row) if k]
        return sum(terms[1:], terms[0])

    return let(raster, lambda a: each(h, w, lambda i: value(a, i)))


SOBEL_X = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))
SOBEL_Y = ((-1, -2, -1), (0, 0, 0), (1, 2, 1))


def gaussian(sigma: float, order: int = 0, radius: int | None = None) -> list[float]:
    """Weights of a Gaussian or of its first or second derivative at whole steps; those of order 0 sum to 1."""
    import math

    r = radius if radius is not None else int(4 * sigma + 0.5)
    g = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    total = sum(g)
    g = [x / total for x in g]
    if order == 1:
        return [-k / sigma**2 * x for k, x in zip(range(-r, r + 1), g, strict=True)]
    if order == 2:
        return [(k * k / sigma**4 - 1 / sigma**2) * x for k, x in zip(range(-r, r + 1), g, strict=True)]
    return g


def pass_rows(raster: Column, weights: Sequence[float], h: int, w: int, border: str) -> Column:
    return convolve(raster, [[k] for k in weights], h, w, border)


def pass_columns(raster: Column, weights: Sequence[float], h: int, w: int, border: str) -> Column:
    return convolve(raster, [list(weights)], h, w, border)


def box(raster: Column, how: Callable[..., Column], radius: int, h: int, w: int) -> Column:
    """Grey dilation (F.greatest) or erosion (F.least) with a square; outside the image nothing counts."""
    steps = range(-radius, radius + 1)
    return let(raster, lambda a: each(h, w, lambda i: how(*[at(a, i, y, x, h, w, "nearest") for y in steps for x in steps])))


def eroded(mask: Column, h: int, w: int) -> Column:
    """A 0/1 region without the pixels that touch its background, corners too."""
    return box(mask, F.least, 1, h, w)


def composed(raster: Column | str, mask: Column | str, fill: float) -> Column:
    """The raster within the mask, fill elsewhere."""
    return F.zip_with(raster, mask, lambda v, m: F.when(m == 1, v).otherwise(F.lit(fill)))


def neighbour_count(mask: Column, h: int, w: int) -> Column:
    """Set pixels among the eight around each; outside counts as empty. mask: 0 or 1."""

    def value(m: Column, i: Column) -> Column:
        y, x = (i / w).cast("int"), i % w
        terms = [F.when((y + a >= 0) & (y + a < h) & (x + b >= 0) & (x + b < w), F.coalesce(F.get(m, (i + a * w + b).cast("int")), F.lit(0))).otherwise(0) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
        return sum(terms[1:], terms[0])

    return let(mask, lambda m: each(h, w, lambda i: value(m, i)))


def local_maxima(raster: Column, h: int, w: int, radius: int, above: float) -> Column:
    """1 where a pixel is the largest of its square and larger than above."""
    top = box(raster, F.greatest, radius, h, w)
    return F.zip_with(raster, top, lambda v, t: F.when((v >= t) & (v > above), 1).otherwise(0))


def percentile(raster: Column, q: float) -> Column:
    """Linear interpolation between the sorted values of the array."""

    def value(ordered: Column) -> Column:
        rank = (F.size(ordered) - 1) * F.lit(q)
        low = F.floor(rank).cast("int")
        a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
        return a + (b - a) * (rank - low)

    return let(F.array_sort(raster), value)


def percentile_normalize(raster: Column, low: Column, high: Column) -> Column:
    """Values between two percentiles as 0 to 1, cut there."""
    ends = F.struct(low.alias("a"), high.alias("b"))
    return let(ends, lambda e: F.transform(raster, lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - e["a"]) / (e["b"] - e["a"] + 1e-20)))))


def clip_to_8bit(raster: Column, low: Column, high: Column) -> Column:
    """Values between two percentiles as whole numbers 0 to 255."""

    def value(v: Column, a: Column, b: Column) -> Column:
        return F.when(b == a, F.lit(0)).otherwise(((F.least(b, F.greatest(a, v)) - a) / F.when(b != a, b - a) * 255).cast("int"))

    return let(F.struct(low.alias("a"), high.alias("b")), lambda e: F.transform(raster, lambda v: value(v, e["a"], e["b"])))


def minmax_8bit(raster: Column) -> Column:
    return clip_to_8bit(raster, F.array_min(raster), F.array_max(raster))


def mean(raster: Column) -> Column:
    return F.aggregate(raster, F.lit(0.0), lambda s, x: s + x) / F.size(raster)


def fraction(raster: Column, test: Callable[[Column], Column]) -> Column:
    """Share of pixels that pass; null for an empty array."""
    return F.size(F.filter(raster, test)).cast("double") / F.when(F.size(raster) > 0, F.size(raster))


def lacunarity(mask_mean: Column) -> Column:
    """|variance / mean ** 2 - 1| of a 0/1 raster, which is |1 / mean - 2|; 0 without foreground."""
    return F.when(mask_mean == 0, F.lit(0.0)).otherwise(F.abs(1 / F.when(mask_mean != 0, mask_mean) - 2))


def crop_center(raster: Column, h: int, w: int, height: int, width: int) -> Column:
    top, left = (h - height) // 2, (w - width) // 2
    return F.flatten(F.transform(F.sequence(F.lit(top), F.lit(top + height - 1)), lambda y: F.slice(raster, y * w + left + 1, width)))


def hdm_contrast(raster: Column, most: float, saturated: float, dark: bool = False) -> Column:
    """Whole numbers 0 to 255: cut to 0 … most, spread over the range, spread again between the saturated tails, inverted if the
    dense parts are dark. What is over 0 counts as dense."""
    cut = F.transform(raster, lambda v: F.greatest(F.lit(0.0), F.least(v, F.lit(float(most)))))

    def spread(v: Column, low: Column, high: Column) -> Column:
        return ((F.least(high, F.greatest(low, v)) - low) / (high - low + 2.220446049250313e-16) * 255).cast("int")

    def stretched(c: Column) -> Column:
        ends = F.struct(percentile(c, saturated / 2).alias("a"), percentile(c, 1 - saturated / 2).alias("b"))
        # without a range between the tails the values stay
        shown = lambda v, e: F.when(e["a"] == e["b"], v).otherwise(spread(v, e["a"], e["b"]))
        return let(ends, lambda e: F.transform(c, lambda v: 255 - shown(v, e) if dark else shown(v, e)))

    full = let(cut, lambda c: let(F.struct(F.array_min(c).alias("a"), F.array_max(c).alias("b")), lambda e: F.transform(c, lambda v: spread(v, e["a"], e["b"]))))
    return let(full, stretched)
