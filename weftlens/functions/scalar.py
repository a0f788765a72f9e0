"""Scalar expressions: ratios, circles, angles, small matrices, colours and file names. All are Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: shapes that an annotation may name, channels and image types in file names
SHAPES = ("ellipse", "rectangle", "polygon", "line", "polyline", "points")
CHANNELS = ("original", "red", "yellow", "green")
IMAGE_TYPES = ("BF", "POL", "XPL")


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0; null stays null."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b != 0, b))


def circle_area(radius: Column) -> Column:
    return F.pi() * radius * radius


def circle_radius(area: Column) -> Column:
    return F.sqrt(area / F.pi())


def half_circle(angle: Column) -> Column:
    """Angles of undirected lines in [0, pi)."""
    turned = F.pmod(angle, F.lit(math.pi))
    return F.when(turned >= math.pi, F.lit(0.0)).otherwise(turned)


def normalized_lacunarity(lacunarity: Column, length: Column, resolution: Column, area: Column) -> Column:
    """(L - 1) over (1 - rho) / rho with rho = length * resolution / area; 0 where that can't be formed."""
    rho = safe_divide(length * resolution, area)
    return safe_divide(lacunarity - 1, safe_divide(1 - rho, rho))


def symmetric_eigen(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Eigenvalues of [[a, b], [b, c]], the one of larger magnitude first."""
    mid = (a + c) / 2
    off = F.sqrt((a - c) * (a - c) / 4 + b * b)
    return F.when(mid >= 0, mid + off).otherwise(mid - off), F.when(mid >= 0, mid - off).otherwise(mid + off)


def strongest_normal(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """Eigenvalue of larger magnitude of [[a, b], [b, c]] and its unit vector (first, second axis); an axis where b is 0."""
    top = symmetric_eigen(a, b, c)[0]
    size = F.hypot(b, top - a)
    flat = F.abs(b) < 1e-12
    first = F.when(flat, F.when(F.abs(a) >= F.abs(c), 1.0).otherwise(0.0)).otherwise(b / F.when(~flat, size))
    second = F.when(flat, F.when(F.abs(a) >= F.abs(c), 0.0).otherwise(1.0)).otherwise((top - a) / F.when(~flat, size))
    return top, first, second


def orientation(xx: Column, xy: Column, yy: Column) -> Column:
    """Direction, in radians, along the structure of a tensor."""
    return F.lit(0.5) * F.atan2(2 * xy, yy - xx)


def coherency(xx: Column, xy: Column, yy: Column, eps: float = 1e-10) -> Column:
    return F.sqrt((yy - xx) * (yy - xx) + 4 * xy * xy) / (xx + yy + eps)


def subpixel_offset(r: Column, n_row: Column, n_col: Column, grow: Column, gcol: Column, eigen: Column) -> tuple[Column, Column]:
    """Row and column offset of the extremum along the normal of the strongest curvature."""
    t = -(grow * n_row + gcol * n_col) / (eigen + 1e-12)
    return t * n_row, t * n_col


def sigma_of_width(width: Column) -> Column:
    return width / (2 * math.sqrt(3)) + 0.5


def swap_contrast(contrast: Column, dark: Column) -> Column:
    return F.when(dark, 255 - contrast).otherwise(contrast)


def line_threshold(contrast: float, width: float, sigma: float, gamma: float = 2.0) -> float:
    """Scale-normalised threshold of the second derivative of a line of that contrast and half width."""
    half = width / 2
    return 0.17 * sigma**gamma * math.floor(abs(-2 * contrast * half / (math.sqrt(2 * math.pi) * sigma**3) * math.exp(-(half**2) / (2 * sigma**2))))


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def luma_linear(r: Column, g: Column, b: Column) -> Column:
    return 0.2125 * r + 0.7154 * g + 0.0721 * b


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and value in [0, 1] of channels in [0, 255]; grey has hue 0."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (top - low).cast("double")
    turn = F.when(top == r, F.pmod((g - b) / F.when(span != 0, span), F.lit(6.0))).when(top == g, (b - r) / F.when(span != 0, span) + 2).otherwise((r - g) / F.when(span != 0, span) + 4)
    return F.when(span == 0, F.lit(0.0)).otherwise(turn / 6), safe_divide(span, top.cast("double")), top / 255.0


def hue_closeness(h: Column, s: Column, v: Column, hue: Column, grey: Column) -> Column:
    """Gaussian density product around (hue, 160/255, 200/255); around (0, 0, 0.99) for grey pictures."""

    def density(x: Column, mu: Column, sd: float) -> Column:
        return F.exp(-(x - mu) * (x - mu) / (2 * sd * sd)) / (sd * math.sqrt(2 * math.pi))

    def mean(colour: Column, of_grey: float) -> Column:
        return F.when(grey, F.lit(of_grey)).otherwise(colour)

    return density(h, mean(hue, 0.0), 0.1) * density(s, mean(F.lit(160 / 255), 0.0), 0.3) * density(v, mean(F.lit(200 / 255), 0.99), 0.5)


#: Rows: optical density of haematoxylin, eosin and DAB in red, green and blue (Ruifrok and Johnston).
STAINS = ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78))


def _inverse(m: tuple) -> list[list[float]]:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return [[(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det], [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det], [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det]]


UNMIX = _inverse(STAINS)


def eosin_only(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Channels in [0, 1] of the picture with all stains but eosin taken out."""
    floor = math.log(1e-6)
    od = [F.log(F.greatest(x / 255.0, F.lit(1e-6))) / floor for x in (r, g, b)]
    eosin = F.greatest(sum((od[k] * UNMIX[k][1] for k in range(1, 3)), od[0] * UNMIX[0][1]), F.lit(0.0))
    return tuple(F.least(F.lit(1.0), F.exp(eosin * STAINS[1][k] * floor)) for k in range(3))


def sanitized(name: Column) -> Column:
    """Blanks and , : ? / * become underscores; a backslash stays."""
    return F.regexp_replace(name, "[ ,:?/*]", "_")


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.translate(path, "\\", "/"), "/", -1), r"\.[^.]*$", "")


def joined_path(*parts: Column) -> Column:
    return F.translate(F.concat_ws("/", *parts), "\\", "/")


def image_name_parts(name: Column) -> dict[str, Column]:
    """patient_id, image_type, tissue_type and roi_number of an image's file name; missing ones are empty."""
    before = F.coalesce(*[F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in (r"(?i)^(.+?)\.vsi", r"(?i)^(.+?)\.czi", r"^([^\s_]+)")], F.lit(""))
    low = F.lower(name)
    suffix = F.coalesce(*[F.when(low.contains(c), F.lit(f"_{c}")) for c in CHANNELS], F.lit(""))
    groups = F.transform(F.regexp_extract_all(F.regexp_extract(name, r"(?i)annotation(.*)$", 1), F.lit(r"\(([^()]+)\)"), 1), lambda g: F.trim(g))
    named = F.filter(groups, lambda g: ~F.lower(g).isin(*SHAPES))
    tissue = F.when(F.size(named) > 0, F.element_at(named, -1)).when(F.size(groups) > 0, F.element_at(groups, -1)).otherwise(F.lit(""))
    after = F.when(name.contains(")"), F.regexp_extract(name, r"(\)[^)]*)$", 1)).otherwise(name)
    return {"patient_id": F.concat(before, suffix), "image_type": F.upper(F.regexp_extract(name, r"(?i)[_\s](BF|POL|XPL)[_\s]", 1)), "tissue_type": tissue, "roi_number": F.regexp_extract(after, r"_(\d+)", 1)}


def um_to_px(value: Column, resolution: Column) -> Column:
    return (value / resolution).cast("int")


def resolution_of(x_resolution: Column) -> Column:
    """Micrometres a pixel from a picture's XResolution, 1.0 where that is missing or 0; half to even as Python rounds."""
    return F.when(F.coalesce(x_resolution, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.bround(1 / F.when(x_resolution != 0, x_resolution), 2))
