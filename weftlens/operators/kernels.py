"""Per-image numpy kernels for what is sequential by nature: distances, thinning, skeleton graphs, ridges, circles, segments.

Each takes arrays of one image; ``per_image`` runs one over a DataFrame of images, a row at a time, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def bounded_batches(df: DataFrame, most: str = "8m") -> None:
    """Sets the bytes of the batches that workers get, where the caller has not."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, most)


def per_image(images: DataFrame, fn: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """(image_id, …) rows of fn(raster) for images (image_id, height, width, data: float64 bytes); schema: fn's columns.

    A batch of rasters has as many bytes as bounded_batches() allows, not ten thousand rasters.
    """
    bounded_batches(images)
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    id_type = dict(images.dtypes)["image_id"]

    def made(batch: pa.RecordBatch, rows: list[tuple], owner: list[int]) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)]
        return pa.record_batch([batch.column(0).take(pa.array(owner)), *columns], names=["image_id", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, owner = [], []
            for k in range(batch.num_rows):
                h, w = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                rows = fn(np.frombuffer(batch.column(3)[k].as_py(), np.float64).reshape(h, w))
                held += rows
                owner += [k] * len(rows)
                if len(held) >= 1 << 12:
                    yield made(batch, held, owner)
                    held, owner = [], []
            if held:
                yield made(batch, held, owner)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))
    return images.select("image_id", "height", "width", "data").mapInArrow(run, f"image_id {id_type}, {schema}")


# ---- neighbourhoods


def shifted(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """a moved so that each place holds its neighbour at (dy, dx); outside is 0."""
    out = np.zeros_like(a)
    h, w = a.shape
    ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    yt, xt = slice(max(0, dy), min(h, h + dy)), slice(max(0, dx), min(w, w + dx))
    out[ys, xs] = a[yt, xt]
    return out


#: The eight neighbours in turn, from above and clockwise.
AROUND = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def labels(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Numbers from 1 of the connected components of mask, in the order of their first pixels."""
    index = np.flatnonzero(mask)
    place = np.full(mask.size, -1)
    place[index] = np.arange(len(index))
    place = place.reshape(mask.shape)
    root = np.arange(len(index))
    pairs = []
    for dy, dx in ((0, 1), (1, 0), *(((1, 1), (1, -1)) if diagonal else ())):
        both = (place >= 0) & (shifted(place + 1, dy, dx) > 0)
        pairs.append(np.stack([place[both], shifted(place + 1, dy, dx)[both] - 1]))
    a, b = np.concatenate(pairs, 1)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    out = np.zeros(mask.size, np.int64)
    out[index] = np.unique(root, return_inverse=True)[1] + 1
    return out.reshape(mask.shape)


def without_small(mask: np.ndarray, least: int, diagonal: bool = True) -> np.ndarray:
    """mask without components of fewer than least pixels."""
    found = labels(mask, diagonal)
    size = np.bincount(found.ravel())
    size[0] = 0
    return (size >= least)[found]


def holes_filled(mask: np.ndarray, most: int) -> np.ndarray:
    """mask with the holes of fewer than most pixels filled."""
    return ~without_small(~mask, most, diagonal=False)


def distances(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of every pixel to the nearest unset one; without any, to beyond the image's diagonal."""
    h, w = mask.shape
    far = float(h + w)
    down = np.where(mask, far, 0.0)
    for y in range(1, h):
        down[y] = np.minimum(down[y], down[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        down[y] = np.minimum(down[y], down[y + 1] + 1)
    square = down * down
    best = square.copy()
    for step in range(1, w):  # columns farther away than the best distance so far can't help
        if step * step >= best.max():
            break
        best[:, step:] = np.minimum(best[:, step:], square[:, :-step] + step * step)
        best[:, :-step] = np.minimum(best[:, :-step], square[:, step:] + step * step)
    return np.sqrt(best)


def thinned(mask: np.ndarray) -> np.ndarray:
    """A one pixel wide skeleton by parallel thinning in two alternating passes."""
    m = np.pad(mask, 1).astype(bool)
    while True:
        before = m.copy()
        for turn in (0, 1):
            n = [shifted(m, *d) for d in AROUND]
            count = sum(x.astype(np.int8) for x in n)
            rises = sum((~n[k] & n[(k + 1) % 8]).astype(np.int8) for k in range(8))
            up, right, below, left = n[0], n[2], n[4], n[6]
            ends = (up & right & below) | (right & below & left) if not turn else (up & right & left) | (up & below & left)
            m &= ~(m & (count >= 2) & (count <= 6) & (rises == 1) & ~ends)
        if (m == before).all():
            return m[1:-1, 1:-1]


# ---- skeleton graphs


def neighbour_number(skeleton: np.ndarray) -> np.ndarray:
    return sum(shifted(skeleton.astype(np.int8), *d) for d in AROUND) * skeleton


def key_points(skeleton: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and branch points. A branch point has three or more runs of neighbours around it, or more than four neighbours.

    An end has one neighbour, or two that touch each other.
    """
    n = [shifted(skeleton, *d) for d in AROUND]
    count = sum(x.astype(np.int8) for x in n)
    rises = sum((~n[k] & n[(k + 1) % 8]).astype(np.int8) for k in range(8))
    ends = skeleton & ((count == 1) | ((count == 2) & (rises == 1)))
    return ends, skeleton & ((rises >= 3) | (count > 4))


def skeleton_edges(skeleton: np.ndarray, shortest_branch: float = 0) -> list[dict]:
    """Edges of the skeleton's graph: nodes a and b (pixels; None where a path ends in nothing), kind, path and length.

    Branch points that touch are one node. Paths are the components of the rest; end-to-branch ones of at most shortest_branch
    are pruned. A closed ring has no key point and gives no edge.
    """
    _, branches = key_points(skeleton)
    beside = sum(shifted(branches.astype(np.int8), *d) for d in AROUND) > 0
    branches = branches | (beside & (neighbour_number(skeleton) > 2))  # else arms would touch past the branch point
    nodes = labels(branches)
    node_y, node_x = np.nonzero(nodes)
    number = nodes[node_y, node_x]
    many = np.maximum(np.bincount(number), 1)
    centres = np.column_stack([np.bincount(number, node_y) / many, np.bincount(number, node_x) / many])
    # places of a raster with a border count through, so a neighbour is a number away and the lesser number comes first
    wide = skeleton.shape[1] + 2
    path_of = np.pad(labels(skeleton & ~branches), 1).ravel()
    places = np.flatnonzero(path_of)
    places = places[np.argsort(path_of[places], kind="stable")]  # the pixels of each path, one after the other
    cuts = np.flatnonzero(np.diff(path_of[places])) + 1
    on, node_at = (path_of > 0).tolist(), np.pad(nodes, 1).ravel().tolist()
    around = [dy * wide + dx for dy, dx in AROUND]
    steps = [-wide, -1, 1, wide, -wide - 1, -wide + 1, wide - 1, wide + 1]  # straight ones before slanting ones

    def node_of(p: int, other: int = 0) -> int:
        found = sorted({node_at[p + d] for d in around} - {0})
        return next((f for f in found if f != other), found[0] if found else 0)

    walks = []
    for own in np.split(places, cuts) if len(places) else []:
        own = own.tolist()
        start = next((p for p in own if sum(on[p + d] for d in around) <= 1), None)
        if start is None:
            start = next((p for p in own if any(node_at[p + d] for d in around)), None)
            if start is None:
                continue  # a ring
        path, here = [], start
        while here is not None:
            path.append(here)
            on[here] = False  # each path is walked once
            here = next((here + d for d in steps if on[here + d]), None)
        a = node_of(path[0])
        b = node_of(path[-1], a if len(path) == 1 else 0)
        if len(path) == 1 and a == b:
            b = 0
        walks.append((a, b, path))
    if not walks:
        return []
    full, ends = [], [0]
    for a, b, path in walks:
        ends_at = [centres[n] for n in (a, b) if n]
        full += [*([tuple(ends_at[0])] if a else []), *((p // wide - 1, p % wide - 1) for p in path), *([tuple(ends_at[-1])] if b else [])]
        ends.append(len(full))
    apart = np.hypot(*np.diff(np.array(full, float), axis=0).T)
    out = []
    for k, (a, b, path) in enumerate(walks):
        kind = "brh-to-brh" if a and b else "end-to-brh" if a or b else "end-to-end"
        length = float(apart[ends[k] : ends[k + 1] - 1].sum())
        if kind == "end-to-brh" and length <= shortest_branch:
            continue
        out.append({"a": a, "b": b, "kind": kind, "path": [(p // wide - 1, p % wide - 1) for p in path], "length": length})
    return out


def longest_path(edges: list[dict]) -> float:
    """Length of the longest shortest path between nodes; a free end is a node of its own."""
    return longest_route(edges)[0]


def longest_route(edges: list[dict]) -> tuple[float, list[int]]:
    """The longest shortest path between nodes: its length and its edges' numbers in order."""
    graph: dict = {}
    for k, e in enumerate(edges):
        a, b = e["a"] or f"a{k}", e["b"] or f"b{k}"
        graph.setdefault(a, []).append((b, e["length"], k))
        graph.setdefault(b, []).append((a, e["length"], k))
    import heapq

    best, route = 0.0, []
    for source in graph:
        reached, todo = {}, [(0.0, str(source), source, None, None)]
        while todo:
            d, _, node, before, edge = heapq.heappop(todo)
            if node in reached:
                continue
            reached[node] = (d, before, edge)
            for other, length, k in graph[node]:
                if other not in reached:
                    heapq.heappush(todo, (d + length, str(other), other, node, k))
        far = max(reached, key=lambda n: reached[n][0])
        if reached[far][0] > best:
            best, route = reached[far][0], []
            while reached[far][2] is not None:
                route.append(reached[far][2])
                far = reached[far][1]
            route.reverse()
    return best, route


def longest_curvature(edges: list[dict], window: int) -> float:
    """Mean curvature along the longest path, its edges' pixels joined in the order they are walked; 0 without one."""
    points: list[tuple[int, int]] = []
    for k in longest_route(edges)[1]:
        path = edges[k]["path"]
        if points and math.dist(points[-1], path[-1]) < math.dist(points[-1], path[0]):
            path = path[::-1]
        points += path[1:] if points and points[-1] == path[0] else path
    return float(path_curvature(np.array(points), window).mean()) if len(points) > 1 else 0.0


def length_map(edges: list[dict], shape: tuple[int, int], longest: bool = False) -> np.ndarray:
    """Each path's pixels hold its edge's length; with longest only those of the longest path, and its whole length."""
    out = np.zeros(shape)
    total, route = longest_route(edges) if longest else (0.0, range(len(edges)))
    for k in route:
        p = np.array(edges[k]["path"])
        out[p[:, 0], p[:, 1]] = total if longest else edges[k]["length"]
    return out


def hit_or_miss(mask: np.ndarray, pattern: np.ndarray) -> np.ndarray:
    """Where the 3 x 3 neighbourhood equals the pattern; outside is unset."""
    out = np.ones(mask.shape, bool)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            out &= shifted(mask.astype(bool), dy, dx) == bool(pattern[dy + 1][dx + 1])
    return out


def any_pattern(mask: np.ndarray, patterns: list[np.ndarray]) -> np.ndarray:
    """Where one of the patterns, in any of its quarter turns, fits."""
    out = np.zeros(mask.shape, bool)
    for p in patterns:
        for turn in range(4):
            out |= hit_or_miss(mask, np.rot90(p, turn))
    return out


def facet_response(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values at points from the quadratic surface fitted to the 3 x 3 pixels around the nearest one, mirrored at the border."""
    padded = np.pad(image.astype(float), 1, mode="reflect")
    i, j = np.clip(np.rint(y).astype(int), 0, image.shape[0] - 1), np.clip(np.rint(x).astype(int), 0, image.shape[1] - 1)
    near = np.stack([padded[i + 1 + dy, j + 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], 1)
    v, u = (g.ravel() for g in np.mgrid[-1:2, -1:2])
    fit = np.linalg.pinv(np.column_stack([np.ones(9), v, u, v * v, v * u, u * u]))  # least squares
    c = near @ fit.T
    a, b = y - i, x - j
    return (c * np.column_stack([np.ones(len(a)), a, b, a * a, a * b, b * b])).sum(1)


def path_curvature(path: np.ndarray, window: int) -> np.ndarray:
    """Degrees between the chords back and ahead at each point; beyond its ends a path goes on reflected through them."""
    side, n = window // 2, len(path)
    if n < 2 or side < 1:
        return np.zeros(n)
    p = np.asarray(path, float)
    side = min(side, n - 1)
    p = np.vstack([2 * p[0] - p[side:0:-1], p, 2 * p[-1] - p[-2 : -side - 2 : -1]])
    here, back, ahead = p[side : side + n], p[:n], p[2 * side :]
    a, b = here - back, ahead - here
    return np.degrees(np.abs(np.arctan2(a[:, 1] * b[:, 0] - a[:, 0] * b[:, 1], (a * b).sum(1))))


def paths_curvature(paths: list[list[tuple[int, int]]], window: int) -> np.ndarray:
    """path_curvature() of many paths, one after the other."""
    n = np.array([len(p) for p in paths])
    p = np.array([q for path in paths for q in path], float)
    half = window // 2
    if half < 1:
        return np.zeros(len(p))
    first = np.repeat(np.cumsum(n) - n, n)
    last = first + np.repeat(n, n) - 1
    at = np.arange(len(p))
    side = np.minimum(half, last - first)

    def beyond(to: np.ndarray, end: np.ndarray, out: np.ndarray) -> np.ndarray:
        return np.where(out[:, None], 2 * p[end] - p[np.where(out, 2 * end - to, at)], p[np.where(out, at, to)])

    a, b = p - beyond(at - side, first, at - side < first), beyond(at + side, last, at + side > last) - p
    return np.degrees(np.abs(np.arctan2(a[:, 1] * b[:, 0] - a[:, 0] * b[:, 1], (a * b).sum(1))))


def skeleton_metrics(mask: np.ndarray, shortest_branch: float = 5, windows: tuple[int, ...] = (10, 20, 30)) -> list[tuple]:
    """One row: pixels, length (pixels of the skeleton), ends, branch points, mean length, lacunarity, longest path, curvatures."""
    mask = holes_filled(mask > 0, 8)
    skeleton = thinned(mask)
    edges = skeleton_edges(skeleton, shortest_branch)
    tips = sum((not e["a"]) + (not e["b"]) for e in edges)
    at: dict[int, int] = {}
    for e in edges:
        for n in (e["a"], e["b"]):
            if n:
                at[n] = at.get(n, 0) + 1
    branches = sum(v > 2 for v in at.values())
    length = int(skeleton.sum())
    share = skeleton.mean() if skeleton.size else 0
    bend = []
    for w in windows:
        bend.append(float(paths_curvature([e["path"] for e in edges], w).mean()) if edges else 0.0)
    return [(int(mask.sum()), length, tips, branches, 2 * length / (tips + branches) if tips + branches else 0.0, abs(1 / share - 2) if share else 0.0, longest_path(edges), bend)]


# ---- circles in the gaps


def gap_circles(free: np.ndarray, least_radius: float) -> list[tuple[float, float, float]]:
    """(y, x, r) of circles inscribed in the free area, larger than least_radius.

    Each round takes the distance transform's local maxima, largest first, keeps those that overlap none kept in this round,
    and erases them from the area; it ends when no maximum is large enough. No circle gives an empty list. The image's border
    isn't free, so no circle is cut off by it.
    """
    free = free.copy()
    free[:1] = free[-1:] = free[:, :1] = free[:, -1:] = False
    out: list[tuple[float, float, float]] = []
    while free.any():
        d = distances(np.pad(free, 1))[1:-1, 1:-1]
        top = d.copy()
        for dy, dx in AROUND:
            top = np.maximum(top, shifted(d, dy, dx))
        y, x = np.nonzero((d >= top) & (d > least_radius))
        if not len(y):
            break
        order = np.lexsort((x, y, -d[y, x]))
        kept, n = np.empty((len(order), 3)), 0
        for k in order:
            r = float(d[y[k], x[k]])
            if not (np.hypot(kept[:n, 0] - y[k], kept[:n, 1] - x[k]) < r + kept[:n, 2]).any():
                kept[n], n = (y[k], x[k], r), n + 1
        for a, b, c in kept[:n]:
            set_disc(free, a, b, c, False)
        out += [tuple(map(float, row)) for row in kept[:n]]
    return out


def set_disc(mask: np.ndarray, y: float, x: float, r: float, value: bool) -> None:
    """Sets the pixels within r of a point, looking at their square alone."""
    top, left = max(0, int(math.ceil(y - r))), max(0, int(math.ceil(x - r)))
    rows, columns = np.arange(top, min(mask.shape[0], int(y + r) + 1)), np.arange(left, min(mask.shape[1], int(x + r) + 1))
    if len(rows) and len(columns):
        mask[top : rows[-1] + 1, left : columns[-1] + 1][(rows[:, None] - y) ** 2 + (columns - x) ** 2 <= r * r] = value


# ---- ridges


def _kernels(sigma: float) -> list[np.ndarray]:
    r = int(3 * sigma + 0.5)
    t = np.arange(-r, r + 1)
    g = np.exp(-t * t / (2 * sigma * sigma))
    g /= g.sum()
    return [g, -t / sigma**2 * g, (t * t / sigma**4 - 1 / sigma**2) * g]


def _along(image: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    r, n, k = len(kernel) // 2, image.shape[axis], len(kernel)
    padded = image.take(np.clip(np.arange(-r, n + r), 0, n - 1), axis)
    out, one = np.zeros(image.shape), np.empty(image.shape)
    for j, w in enumerate(kernel):
        at = k - 1 - j
        np.multiply(padded[at : at + n] if axis == 0 else padded[:, at : at + n], w, out=one)
        out += one
    return out


def filtered(image: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Convolution with a separable kernel, edge values repeated."""
    return _along(_along(image.astype(float), rows, 0), columns, 1)


def ridge_maps(image: np.ndarray, widths: tuple[float, ...], dark: bool = True, thresholds: Callable[[float, float], tuple[float, float]] | None = None) -> dict[str, np.ndarray]:
    """Per pixel the strongest scale's response, sigma, normal and sub-pixel offset along it.

    The response is the second derivative across the line times sigma squared, so scales compare. With thresholds, which gives a
    lower and an upper one for a width and its sigma, the maps low and high hold those of the strongest scale.
    """
    best: dict[str, np.ndarray] = {}
    for width in widths:
        sigma = width / (2 * math.sqrt(3)) + 0.5
        g, d1, d2 = _kernels(sigma)
        sign = 1.0 if dark else -1.0
        r0, r1, r2 = (_along(image.astype(float), k, 0) for k in (g, d1, d2))
        gy, gx = sign * _along(r1, g, 1), sign * _along(r0, d1, 1)
        yy, xy, xx = sign * _along(r2, g, 1), sign * _along(r1, d1, 1), sign * _along(r0, d2, 1)
        mid, off = (yy + xx) / 2, np.sqrt(((yy - xx) / 2) ** 2 + xy**2)
        value = mid + off
        angle = 0.5 * np.arctan2(2 * xy, yy - xx)
        ny, nx = np.cos(angle), np.sin(angle)
        bend = yy * ny * ny + 2 * xy * ny * nx + xx * nx * nx
        t = -(gy * ny + gx * nx) / np.where(np.abs(bend) < 1e-12, 1e-12, bend)
        now = {"response": value * sigma**2, "sigma": np.full(image.shape, sigma), "ny": ny, "nx": nx, "py": t * ny, "px": t * nx}
        if thresholds is not None:
            now |= {k: np.full(image.shape, v) for k, v in zip(("low", "high"), thresholds(width, sigma), strict=True)}
        better = now["response"] > best["response"] if best else np.ones(image.shape, bool)
        best = {k: np.where(better, v, best[k]) if best else v for k, v in now.items()}
    return best


def linked_contours(maps: dict[str, np.ndarray], low: float | np.ndarray, high: float | np.ndarray, shortest: int = 5, longest: int = 0) -> list[np.ndarray]:
    """Lines (points y, x, response) from ridge maps: seeds by descending response, grown both ways over points above low.

    low and high are numbers or maps. At each step the three neighbours ahead along the line compete; the nearest in place and direction is taken.
    """
    line = (np.abs(maps["py"]) <= 0.6) & (np.abs(maps["px"]) <= 0.6) & (maps["response"] >= low)
    on = np.flatnonzero(line)
    y, x = np.divmod(on, line.shape[1])
    ny, nx, py, px, response = (maps[c].ravel()[on] for c in ("ny", "nx", "py", "px", "response"))
    seeds = np.flatnonzero(np.broadcast_to(response >= (high if np.ndim(high) == 0 else np.asarray(high).ravel()[on]), on.shape))
    seeds = seeds[np.lexsort((x[seeds], y[seeds], -response[seeds]))]
    after, first = _steps_ahead(line, on, y, x, ny, nx, py, px)
    used, out = bytearray(len(on)), []
    points = np.column_stack([y + py, x + px, response])
    for seed in seeds.tolist():
        if used[seed]:
            continue
        used[seed] = 1
        halves = []
        for way in (0, 1):
            half, here = [], 2 * seed + way
            while True:
                for to in after[first[here] : first[here + 1]]:
                    if not used[to >> 1]:
                        break
                else:
                    break
                here = to
                used[to >> 1] = 1
                half.append(to >> 1)
            halves.append(half)
        path = [*halves[1][::-1], seed, *halves[0]]
        if len(path) >= shortest and (longest <= 0 or len(path) <= longest):
            out.append(points[path])
    return out


_STEPS = np.array(AROUND)
_APART = np.array([math.hypot(*d) for d in AROUND])


def _steps_ahead(line: np.ndarray, on: np.ndarray, y: np.ndarray, x: np.ndarray, ny: np.ndarray, nx: np.ndarray, py: np.ndarray, px: np.ndarray) -> tuple[list[int], list[int]]:
    """For both ways along each line point what it may go on to, the nearest in place and direction first, and where each one's list starts.

    A point and a way are one number: twice the point's, plus 1 against its tangent (-nx, ny).
    """
    h, w = line.shape
    number = np.full((h + 2) * (w + 2), -1)
    at = (y + 1) * (w + 2) + x + 1
    number[at] = np.arange(len(on))
    q = number[at + _STEPS[:, :1] * (w + 2) + _STEPS[:, 1:]]
    ahead = (_STEPS[:, :1] * -nx + _STEPS[:, 1:] * ny) / _APART[:, None]
    k, i = np.nonzero((q >= 0) & (np.abs(ahead) >= 0.5))
    q, back, (dy, dx) = q[k, i], ahead[k, i] < 0, _STEPS[k].T
    turn = list(map(math.acos, np.minimum(1.0, np.abs(ny[i] * ny[q] + nx[i] * nx[q])).tolist()))
    away = list(map(math.hypot, (dy + py[q] - py[i]).tolist(), (dx + px[q] - px[i]).tolist()))
    straight = np.where(back, -1, 1) * (-nx[q] * -nx[i] + ny[q] * ny[i])
    by = np.lexsort((k, np.array(away) + np.array(turn), 2 * i + back))
    first = np.searchsorted((2 * i + back)[by], np.arange(2 * len(on) + 1))
    return (2 * q + (straight < 0))[by].tolist(), first.tolist()


def junctions(contours: list[np.ndarray], reach: float = 1.5) -> list[tuple[int, int, int, float, float]]:
    """(contour, other contour, position on the other, y, x) where an end of one comes within reach of another."""
    if not contours:
        return []
    places = np.concatenate([c[:, :2] for c in contours])
    first = np.cumsum([0, *map(len, contours)])
    owner = np.repeat(np.arange(len(contours)), np.diff(first))
    out = set()
    for i, c in enumerate(contours):
        for end in (c[0], c[-1]):
            d = np.hypot(places[:, 0] - end[0], places[:, 1] - end[1])
            nearest: dict[int, int] = {}
            for p in np.flatnonzero(d <= reach):
                j = int(owner[p])
                if j != i and (j not in nearest or d[p] < d[nearest[j]]):
                    nearest[j] = int(p)
            out |= {(i, j, int(p - first[j]), float(places[p, 0]), float(places[p, 1])) for j, p in nearest.items()}
    return sorted(out)


def steepness(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gradient magnitudes at the scale at which the edges of a line of that sigma are looked for."""
    g, d1, _ = _kernels(max(0.5, sigma / 2))
    return np.hypot(filtered(image, d1, g), filtered(image, g, d1))


def widths_of(image: np.ndarray, contours: list[np.ndarray], maps: dict[str, np.ndarray]) -> list[np.ndarray]:
    """line_widths() of all contours of ridge_maps(), each at the scale that most of its points have: one filtering a scale."""
    steep: dict[float, np.ndarray] = {}
    out = []
    for c in contours:
        at = tuple(np.clip(np.rint(c[:, :2]), 0, np.array(image.shape) - 1).astype(int).T)
        scales, n = np.unique(maps["sigma"][at], return_counts=True)
        sigma = float(scales[n.argmax()])
        if sigma not in steep:
            steep[sigma] = steepness(image, sigma)
        out.append(line_widths(image, c, np.column_stack([maps["ny"][at], maps["nx"][at]]), sigma, steep[sigma]))
    return out


def line_widths(image: np.ndarray, contour: np.ndarray, normals: np.ndarray, sigma: float, steep: np.ndarray | None = None) -> np.ndarray:
    """Distances to the steepest gradient on either side of each point (points, 2); gaps are filled along the line.

    steep: steepness(image, sigma), if it is at hand.
    """
    steep = steepness(image, sigma) if steep is None else steep
    steps = np.arange(0, 2.5 * sigma + 0.25, 0.25)
    out = np.full((len(contour), 2), np.nan)
    for side, sign in ((0, 1), (1, -1)):
        y = contour[:, 0, None] + sign * normals[:, 0, None] * steps
        x = contour[:, 1, None] + sign * normals[:, 1, None] * steps
        inside = (y >= 0) & (y <= image.shape[0] - 1) & (x >= 0) & (x <= image.shape[1] - 1)
        v = np.where(inside, steep[np.clip(np.rint(y), 0, image.shape[0] - 1).astype(int), np.clip(np.rint(x), 0, image.shape[1] - 1).astype(int)], -1)
        top = v >= v.max(1, keepdims=True) * (1 - 1e-9)  # an edge between two pixels is equally steep at both
        first, last = top.argmax(1), v.shape[1] - 1 - top[:, ::-1].argmax(1)
        ok = (last > 0) & (v.max(1) > 0)
        w = np.where(ok, (steps[first] + steps[last]) / 2, np.nan)
        if ok.any():
            along = np.append(0, np.cumsum(np.hypot(*np.diff(contour[:, :2], axis=0).T)))
            w = np.interp(along, along[ok], w[ok])
        out[:, side] = w
    return out


def drawn(contours: list[np.ndarray], shape: tuple[int, int], widths: list[np.ndarray] | None = None) -> np.ndarray:
    """Mask of the contours' pixels, or of all within their half widths."""
    mask = np.zeros(shape, bool)
    for k, c in enumerate(contours):
        if widths is None:
            at = np.clip(np.rint(c[:, :2]), 0, np.array(shape) - 1).astype(int)
            mask[at[:, 0], at[:, 1]] = True
            continue
        known = ~np.isnan(widths[k])
        r = np.where(known, widths[k], 0).sum(1) / np.maximum(known.sum(1), 1)
        for (y, x), half in zip(c[:, :2].tolist(), np.maximum(r, 0.5).tolist(), strict=True):
            set_disc(mask, y, x, half, True)
    return mask


def extended(contours: list[np.ndarray], maps: dict[str, np.ndarray], low: float | np.ndarray, most: int = 10) -> list[np.ndarray]:
    """Contours lengthened straight on at both ends while the response stays above low, at most most steps."""
    out, low = [], np.broadcast_to(low, maps["response"].shape)
    for c in contours:
        for _ in (0, 1):
            d = c[-1, :2] - c[max(0, len(c) - 4), :2]
            n = np.hypot(*d)
            more, here = [], c[-1, :2]
            for _ in range(most if n > 0 else 0):
                here = here + d / n
                k = tuple(np.rint(here).astype(int))
                if not (0 <= k[0] < maps["response"].shape[0] and 0 <= k[1] < maps["response"].shape[1]) or maps["response"][k] < low[k]:
                    break
                more.append((*here, maps["response"][k]))
            c = np.vstack([c, np.array(more).reshape(-1, 3)])[::-1]
        out.append(c)
    return out


# ---- segmentation without a network


def regions(image: np.ndarray, levels: int = 32, above: float = 0.2, least: int = 64) -> np.ndarray:
    """A mask of the bright regions: values quantised to levels, spread to 0 … 1, cut at above, small parts and holes removed.

    It stands in for a network trained on each image and does not give the same masks.
    """
    low, high = float(image.min()), float(image.max())
    if high == low:
        return np.zeros(image.shape, bool)
    shade = np.floor((image - low) / (high - low) * (levels - 1e-9)) / (levels - 1)
    mask = shade > above
    return without_small(holes_filled(mask, least), least)


def mean_field(scores: np.ndarray, colours: np.ndarray, rounds: int = 5, radius: int = 2, spatial: float = 3.0, colour: float = 0.1) -> np.ndarray:
    """Label probabilities (h, w, labels) after mean-field steps of a field with local Gaussian kernels of place and colour."""
    p = np.exp(scores - scores.max(2, keepdims=True))
    p /= p.sum(2, keepdims=True)
    steps = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy or dx]
    weights = [np.exp(-(dy * dy + dx * dx) / (2 * spatial**2) - ((colours - shifted(colours, dy, dx)) ** 2) / (2 * colour**2)) * shifted(np.ones(colours.shape), dy, dx) for dy, dx in steps]
    total = sum(weights)
    for _ in range(rounds):
        near = sum(w[:, :, None] * np.stack([shifted(p[:, :, k], dy, dx) for k in range(p.shape[2])], 2) for w, (dy, dx) in zip(weights, steps, strict=True)) / total[:, :, None]
        z = scores + 3 * near
        p = np.exp(z - z.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
    return p


# ---- small geometry


def pixels_between(y0: int, x0: int, y1: int, x1: int) -> np.ndarray:
    """Whole-number points of the straight line between two pixels, both included, one a step along its longer side."""
    n = max(abs(y1 - y0), abs(x1 - x0))
    t = np.arange(n + 1) / max(n, 1)
    return np.column_stack([np.floor(y0 + (y1 - y0) * t + 0.5), np.floor(x0 + (x1 - x0) * t + 0.5)]).astype(int)


def interpolated(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at points, the image's edge values going on outside."""
    y, x = np.clip(y, 0, image.shape[0] - 1), np.clip(x, 0, image.shape[1] - 1)
    i, j = np.minimum(y.astype(int), max(image.shape[0] - 2, 0)), np.minimum(x.astype(int), max(image.shape[1] - 2, 0))
    a, b = y - i, x - j
    k, m = np.minimum(i + 1, image.shape[0] - 1), np.minimum(j + 1, image.shape[1] - 1)
    return image[i, j] * (1 - a) * (1 - b) + image[i, m] * (1 - a) * b + image[k, j] * a * (1 - b) + image[k, m] * a * b


def resized(image: np.ndarray, width: int) -> np.ndarray:
    """The image at that width with its proportions kept, by bilinear values at pixel centres."""
    h, w = image.shape
    height = max(1, round(h * width / w))
    y, x = np.mgrid[:height, :width]
    return interpolated(image.astype(float), (y + 0.5) * h / height - 0.5, (x + 0.5) * w / width - 0.5)


def upright(image: np.ndarray) -> np.ndarray:
    """A portrait image turned a quarter to the left, so that its width is the longer side."""
    return np.rot90(image) if image.shape[0] > image.shape[1] else image


def smoothed_widths(widths: np.ndarray, sigma: float = 3.0) -> np.ndarray:
    """Widths along a line under a Gaussian, mirrored at its ends."""
    r = min(int(4 * sigma + 0.5), len(widths) - 1)
    if r < 1:
        return widths
    t = np.arange(-r, r + 1)
    g = np.exp(-t * t / (2 * sigma * sigma))
    return np.convolve(np.pad(widths, r, mode="reflect"), g / g.sum(), "valid")


def spline_curvature(path: np.ndarray, stiffness: float = 3.0) -> np.ndarray:
    """Signed curvature of a path smoothed by penalised second differences."""
    n = len(path)
    if n < 5:
        return np.zeros(n)
    d = np.diff(np.eye(n), 2, axis=0)
    p = np.linalg.solve(np.eye(n) + stiffness * d.T @ d, np.asarray(path, float))
    v, a = np.gradient(p, axis=0), np.gradient(np.gradient(p, axis=0), axis=0)
    return (v[:, 1] * a[:, 0] - v[:, 0] * a[:, 1]) / np.maximum((v**2).sum(1), 1e-12) ** 1.5
