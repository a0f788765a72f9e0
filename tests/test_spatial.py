"""Pixels, points and paths as rows against plain Python on odd inputs; the queries' SQL is run by test_queries."""

import collections
import colorsys
import heapq
import math
import random

import numpy as np
import pytest

from weftlens.operators import chunks, graphs, kernels, order, pixels as X, points as O, regions
from weftlens.plans import imaging, measure
from weftlens.sources.scratch import Scratch


def places(spark, rows):
    return spark.createDataFrame(rows, "k long, id long, y double, x double")


def test_nearest_in_clusters_and_ties(spark):
    rng = random.Random(1)
    near = [(1, i, rng.gauss(0, 1e-3), rng.gauss(0, 1e-3)) for i in range(300)] + [(1, 900 + i, rng.uniform(-1e4, 1e4), rng.uniform(-1e4, 1e4)) for i in range(60)]
    near += [(2, i, float(i % 5), float(i // 5 % 5)) for i in range(200)] + [(3, 4, 1.0, 1.0), (3, 2, 1.0, 1.0)] + [(5, 1, None, 1.0)]
    ask = [(1, i, *rng.choice([(rng.gauss(0, 1), rng.gauss(0, 1)), (rng.uniform(-3e4, 3e4), rng.uniform(-3e4, 3e4)), (0.0, 0.0)])) for i in range(200)]
    ask += [(2, i, rng.randint(-2, 12) / 2, rng.randint(-2, 12) / 2) for i in range(80)] + [(3, 1, 9.0, -9.0), (4, 1, 0.0, 0.0), (2, 1, 0.0, 0.0), (2, 1, 0.0, 0.0)]
    got = O.nearest_in_plane(places(spark, ask), places(spark, near), "k", leaf=4).collect()
    expected = []
    for k, i, y, x in ask:
        best = min((((y - v) ** 2 + (x - u) ** 2, j) for l, j, v, u in near if l == k and v is not None), default=None)
        expected.append((k, i, best and best[1], best and math.sqrt(best[0])))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_greedy_circles_equal_the_sequential_choice(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.uniform(0, 40), rng.uniform(0, 40), rng.choice([0.0, 1.0, 1.0, 2.0, 5.0])) for k in (1, 2) for i in range(200)]
    rows += [(3, i, 0.0, float(i), 0.6 - i * 1e-3) for i in range(30)]  # a chain, each one over the next
    got = {tuple(r)[:2] for r in O.chosen_circles(spark.createDataFrame(rows, "k long, id long, y double, x double, r double"), "k").collect()}
    taken = []
    for c in sorted(rows, key=lambda c: (-c[4], c[1])):
        if all(c[0] != t[0] or math.hypot(c[2] - t[2], c[3] - t[3]) >= c[4] + t[4] for t in taken):
            taken.append(c)
    assert got == {c[:2] for c in taken}


def labels_by_hand(cells, corners):
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (corners or not (dy and dx))]
    root = {}
    for at in sorted(cells):
        if at in root:
            continue
        root[at], todo = at, [at]
        while todo:
            y, x = todo.pop()
            for dy, dx in steps:
                to = (y + dy, x + dx)
                if to in cells and to not in root:
                    root[to] = at
                    todo.append(to)
    return root


@pytest.mark.parametrize("corners", [True, False])
def test_components_of_runs_equal_a_flood(spark, corners):
    rng = random.Random(3)
    images = {i: {(y, x) for y in range(25) for x in range(40) if rng.random() < d} for i, d in ((1, 0.3), (2, 0.5), (3, 0.62))}
    images[4] = {(y, x) for y in range(9) for x in range(30) if y % 2 == 0 or x in (29 if y % 4 == 1 else 0,)}  # one long snake
    images[5] = {(0, 0), (0, 2**31), (7, 5)}
    df = spark.createDataFrame([(i, y, x, float((y + x) % 7)) for i, c in images.items() for y, x in c] + [(1, *next(iter(images[1])), 0.0)], "image_id long, y long, x long, v double")
    got = collections.defaultdict(dict)
    for r in X.of_runs(X.labelled_runs(df, corners), "root", "size", "peak").collect():
        assert (r["y"], r["x"]) not in got[r["image_id"]]
        got[r["image_id"]][r["y"], r["x"]] = (r["root"], r["size"], r["peak"])
    for i, cells in images.items():
        root = labels_by_hand(cells, corners)
        size, peak = collections.Counter(root.values()), collections.defaultdict(float)
        for (y, x), at in root.items():
            peak[at] = max(peak[at], float((y + x) % 7))
        assert got[i] == {p: (at[0] * X.ROW + at[1], size[at], peak[at]) for p, at in root.items()}


def test_large_components_and_hysteresis(spark):
    rng = random.Random(4)
    v = {(y, x): rng.choice([0.0, 1.0, 1.0, 1.0, 2.0]) for y in range(20) for x in range(20) if rng.random() < 0.6}
    df = spark.createDataFrame([(1, y, x, a) for (y, x), a in v.items()], "image_id long, y long, x long, v double")
    root = labels_by_hand(set(v), True)
    size = collections.Counter(root.values())
    assert {(r["y"], r["x"]) for r in X.large_components(df, 4).collect()} == {p for p in v if size[root[p]] >= 4}
    low = {p for p, a in v.items() if a >= 1}
    root = labels_by_hand(low, True)
    strong = {root[p] for p in low if v[p] >= 2}
    assert {(r["y"], r["x"]) for r in X.hysteresis(df, 1, 2).collect()} == {p for p in low if root[p] in strong}


def test_distances_equal_all_pairs(spark):
    rng = random.Random(5)
    h, w = 23, 31
    sets = {1: {(0, 0)}, 2: {(h - 1, w - 1), (h - 1, 0)}, 3: {(rng.randrange(h), rng.randrange(w)) for _ in range(40)}, 4: {(11, x) for x in range(w)}, 5: {(y, 7) for y in range(h)}}
    df = spark.createDataFrame([(i, y, x) for i, c in sets.items() for y, x in c], "image_id long, y long, x long")
    got = {(r["image_id"], r["y"], r["x"]): r["d2"] for r in X.distances(df, h, w).collect()}
    assert got == {(i, y, x): float(min((y - a) ** 2 + (x - b) ** 2 for a, b in c)) for i, c in sets.items() for y in range(h) for x in range(w)}


@pytest.mark.parametrize(("h", "w", "side", "down", "across"), [(17, 22, 5, [1, 2, 4], [1.0, 0, 2, 3, 1]), (8, 8, 8, [0.5, 1, 0.25], [2.0]), (12, 9, 3, [1.0], [1, -1, 3, 2, 1]), (6, 40, 7, [1, 1, 1, 2, 1], [3, 1, 2])])
def test_stencils_of_tiles_equal_the_whole(spark, h, w, side, down, across):
    rng = np.random.default_rng(h)
    m = rng.integers(0, 9, (h, w)).astype(float)
    df = spark.createDataFrame([(1, y, x, float(m[y, x])) for y in range(h) for x in range(w) if m[y, x]], "image_id long, y long, x long, v double")
    out = X.tile_pixels(X.stencilled(X.tiles_of(df, side, h, w), side, down, across), side).collect()
    r, s = len(down) // 2, len(across) // 2
    p = np.pad(m, ((r, r), (s, s)), mode="symmetric")
    rows = sum(k * p[j : j + h] for j, k in enumerate(down))
    expected = sum(k * rows[:, j : j + w] for j, k in enumerate(across))
    got = np.full((h, w), np.nan)
    for _, y, x, v in out:
        got[y, x] = v
    assert len(out) == h * w and np.allclose(got, expected)


def test_narrow_tiles_are_refused(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0)], "image_id long, y long, x long, v double")
    with pytest.raises(Exception, match="narrower"):
        X.stencilled(X.tiles_of(df, 4, 9, 9), 4, [1, 1, 1, 1, 1], [1.0]).collect()


def walked(rows):
    """Paths between nodes whose degree isn't 2, and rings, one edge at a time."""
    near = collections.defaultdict(dict)
    for k, a, b, l in rows:
        if a != b:
            near[k, a][b] = near[k, b][a] = min(l, near[k, a].get(b, l))
    out, seen = [], set()
    for (k, u), ends in near.items():
        if len(ends) == 2:
            continue
        for v in ends:
            p, n, length, hops = u, v, ends[v], 1
            while len(near[k, n]) == 2:
                seen.add((k, n))
                q = next(x for x in near[k, n] if x != p)
                length, hops, p, n = length + near[k, n][q], hops + 1, n, q
            if (u, v) <= (n, p):
                tips = (len(ends) == 1) + (len(near[k, n]) == 1)
                out.append((k, u, n, round(length, 6), hops, ["brh-to-brh", "end-to-brh", "end-to-end"][tips]))
    for at in sorted(near):
        if len(near[at]) == 2 and at not in seen:
            k, first = at
            p, n, length, hops = first, next(iter(near[at])), next(iter(near[at].values())), 1
            seen.add(at)
            while n != first:
                seen.add((k, n))
                q = next(x for x in near[k, n] if x != p)
                length, hops, p, n = length + near[k, n][q], hops + 1, n, q
            out.append((k, first, first, round(length, 6), hops, "ring"))
    return sorted(out)


def network():
    rng = random.Random(6)
    rows = [(1, i, i + 1, 1.0 + i % 3) for i in range(100)] + [(2, i, (i + 1) % 12, 0.5) for i in range(12)] + [(2, 50, 51, 1.0), (2, 51, 52, 2.0), (2, 52, 50, 4.0)]
    rows += [(3, 0, 1, 1.0), (3, 1, 2, 1.0), (3, 2, 0, 1.0), (3, 0, 9, 3.0), (3, 9, 9, 1.0), (3, 9, 0, 2.0)]  # a loop on a stem, a self loop, parallel edges
    rows += [(4, a, b, float(rng.randint(1, 9))) for a, b in ((rng.randint(0, 90), rng.randint(0, 90)) for _ in range(85))]
    rng.shuffle(rows)
    return rows


def test_paths_equal_a_walk(spark):
    rows = network()
    got = graphs.paths(spark.createDataFrame(rows, "k long, src long, dst long, length double"), "k").collect()
    assert sorted((r["k"], r["src"], r["dst"], round(r["length"], 6), r["hops"], r["kind"]) for r in got) == walked(rows)
    assert graphs.paths(spark.createDataFrame([], "k long, src long, dst long, length double"), "k").collect() == []


def test_longest_routes_equal_dijkstra(spark):
    rows = [r for r in network() if r[0] != 1] + [(1, i, i + 1, 1.0 + i % 3) for i in range(20)]
    near = collections.defaultdict(list)
    for k, a, b, l in rows:
        near[k, a].append((b, l))
        near[k, b].append((a, l))
    best = {}
    for k, s in near:
        far, todo = {}, [(0.0, s)]
        while todo:
            d, n = heapq.heappop(todo)
            if n in far:
                continue
            far[n] = d
            for m, l in near[k, n]:
                heapq.heappush(todo, (d + l, m))
        root = (k, min(far))
        best[root] = min([best.get(root, (0.0, -1, -1)), *[(-d, s, n) for n, d in far.items() if s < n]])
    got = graphs.longest_routes(spark.createDataFrame(rows, "k long, src long, dst long, length double"), "k").collect()
    assert {(r["k"], r["root"]): (-r["length"], r["src"], r["dst"]) for r in got} == {k: v for k, v in best.items() if v[1] >= 0}


def test_batches_over_a_total_order(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, 0.5, 0.5, 0.5, 1.0, 2.0]), i) for i in range(500)]
    rng.shuffle(rows)
    got = order.batches(spark.createDataFrame(rows, "res double, path long").repartition(7), "res", "path", 4).collect()
    no, expected, last, left = -1, {}, "none", 0
    for res, path in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if res != last or not left:
            inner = 0 if res != last else inner + 1
            no, last, left = no + 1, res, 4
        left -= 1
        expected[path] = (inner, no)
    assert {r["path"]: (r["batch"], r["batch_no"]) for r in got} == expected
    ranks = order.ranked(spark.createDataFrame(rows, "res double, path long").repartition(5), ["path"]).collect()
    assert [r["rank"] for r in sorted(ranks, key=lambda r: r["path"])] == list(range(500))


def test_rays_stop_at_the_first_pixel(spark):
    p = spark.createDataFrame([(1, 1, i, 5.0, 5.0 + i, math.pi / 2) for i in range(4)], "image_id long, contour_id long, idx long, y double, x double, angle double")
    edge = spark.createDataFrame([(1, 3, 5), (1, 1, 5), (1, 8, 5), (1, 4, 8), (1, 9, 8), (1, 7, 6)], "image_id long, y long, x long")
    got = {r["idx"]: (r["left"], r["right"], r["width"], r["filled"]) for r in X.ray_widths(p, edge, 6).collect()}
    assert got == {0: (2, 3, 5.0, 5.0), 1: (None, 2, None, 5.0), 2: (None, None, None, 5.0), 3: (1, 4, 5.0, 5.0)}


def test_outline_of_a_square_and_a_notch(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 0.0, 4.0), (1, 2, 4.0, 4.0), (1, 3, 4.0, 0.0), (2, 0, 0.0, 0.0), (2, 1, 3.0, 3.0), (2, 2, 0.0, 6.0), (2, 3, 6.0, 6.0), (2, 4, 6.0, 0.0), (3, 0, 1.0, 1.0)]
    got = {tuple(r) for r in O.outline_pixels(spark.createDataFrame(rows, "k long, idx long, y double, x double"), "k").collect()}
    square = {(1, y, x) for y in range(4) for x in range(4)}
    notch = {(2, y, x) for y in range(6) for x in range(6) if x < y or x >= 6 - y}
    assert got == square | notch


@pytest.mark.parametrize("side", [1, 3, 5])
def test_reflected_curvature_of_short_and_long_paths(spark, side):
    from weftlens.operators import tabular as T

    rng = random.Random(side)
    paths = {k: [(float(rng.randint(0, 9)), float(rng.randint(0, 9))) for _ in range(k)] for k in (1, 2, 3, 4, 6, 11, 25)}
    df = spark.createDataFrame([(k, i, y, x) for k, p in paths.items() for i, (y, x) in enumerate(p)], "k long, i long, y double, x double").repartition(3)
    got = {(r["k"], r["i"]): r["angle"] for r in T.reflected_curvature(df, "k", ["i"], "y", "x", side).collect()}
    for k, p in paths.items():
        s, n = min(side, k - 1), k

        def at(j, c):
            return 2 * p[0][c] - p[-j][c] if j < 0 else 2 * p[-1][c] - p[2 * (n - 1) - j][c] if j >= n else p[j][c]  # noqa: B023

        for i in range(n):
            (ay, by), (ax, bx) = ([at(i, c) - at(i - s, c), at(i + s, c) - at(i, c)] for c in (0, 1))
            assert math.isclose(got[k, i], math.degrees(abs(math.atan2(ax * by - ay * bx, ay * by + ax * bx))), abs_tol=1e-9), (k, i)


def test_line_corrections_by_hand(spark):
    from weftlens.operators import tabular as T

    rng = random.Random(8)
    value = {(i, j, q): rng.uniform(-1, 5) for i in range(21) for j in range(41) for q in T.QUANTITIES}
    del value[7, 7, "width"]
    table = spark.createDataFrame([(*k, v) for k, v in value.items()], "ratio_step int, width_step int, quantity string, value double")
    lines = [(k, rng.uniform(1, 3), rng.uniform(1, 20), rng.uniform(-0.1, 1.1)) for k in range(300)] + [(900, 1.0, 6.0, 1.0), (901, 2.0, 4.0, 0.0), (902, 1.0, 2.75, 0.36)]
    got = {r["id"]: r for r in T.line_corrections(spark.createDataFrame(lines, "id long, sigma double, width double, ratio double"), table).collect()}
    for k, sigma, width, ratio in lines:
        w = width / sigma
        for q in T.QUANTITIES:
            want = 0.0
            if 2 <= w <= 6 and 0 <= ratio <= 1:
                i, j = min(int(ratio * 20), 19), min(int((w - 2) * 10), 39)
                b, a = ratio * 20 - i, (w - 2) * 10 - j
                want = sum((b if p else 1 - b) * (a if r else 1 - a) * value.get((i + p, j + r, q), 0.0) for p in (0, 1) for r in (0, 1)) * (1 if q == "asymmetry" else sigma)
            assert math.isclose(got[k][f"true_{q}"], want, abs_tol=1e-9)
    assert len(got) == len(lines)


def thinned_by_hand(cells):
    """The same borders taken off one half round at a time, pixel by pixel."""
    now, still, k = set(cells), 0, 0
    while still < 2 and now:
        gone = set()
        for y, x in now:
            p = [(y + dy, x + dx) in now for dy, dx in X.AROUND]
            n, e, s, w = p[0], p[2], p[4], p[6]
            turns = sum(not a and b for a, b in zip(p, p[1:] + p[:1], strict=True))
            ok = not (n and e and s) and not (e and s and w) if k % 2 == 0 else not (n and e and w) and not (n and s and w)
            if 2 <= sum(p) <= 6 and turns == 1 and ok:
                gone.add((y, x))
        now, still, k = now - gone, 0 if gone else still + 1, k + 1
    return now


def test_thin_lines_and_key_points(spark):
    rng = random.Random(10)
    images = {1: {(y, x) for y in range(4, 9) for x in range(30)} | {(y, x) for y in range(25) for x in range(12, 16)}, 2: {(y, x) for y in range(20) for x in range(20) if rng.random() < 0.7}, 3: {(5, 5)}, 4: {(y, x) for y in range(15) for x in range(15) if 16 < (y - 7) ** 2 + (x - 7) ** 2 < 50}}
    df = spark.createDataFrame([(i, y, x) for i, c in images.items() for y, x in c] * 2, "image_id long, y long, x long")
    got = collections.defaultdict(set)
    lines = X.thinned(df)
    for i, y, x in lines.collect():
        got[i].add((y, x))
    assert got == {i: thinned_by_hand(c) for i, c in images.items()}
    kinds = {tuple(r) for r in X.key_points(lines).collect()}
    want = set()
    for i, c in got.items():
        for y, x in c:
            p = [(y + dy, x + dx) in c for dy, dx in X.AROUND]
            turns = sum(not a and b for a, b in zip(p, p[1:] + p[:1], strict=True))
            if sum(p) == 1 or turns >= 3:
                want.add((i, y, x, "end" if sum(p) == 1 else "junction"))
    assert kinds == want and {k for *_, k in kinds} == {"end", "junction"}
    assert X.thinned(df.where("false")).collect() == []


def test_holes_are_filled_by_size(spark):
    rng = random.Random(11)
    h, w = 14, 17
    cells = {(y, x) for y in range(h) for x in range(w) if rng.random() < 0.68}
    df = spark.createDataFrame([(1, y, x) for y, x in cells], "image_id long, y long, x long")
    free = {(y, x) for y in range(h) for x in range(w)} - cells
    root = labels_by_hand(free, False)
    size = collections.Counter(root.values())
    open_ = {root[p] for p in free if p[0] in (0, h - 1) or p[1] in (0, w - 1)}
    want = cells | {p for p in free if root[p] not in open_ and size[root[p]] < 3}
    assert {(r["y"], r["x"]) for r in X.without_small_holes(df, h, w, 3).collect()} == want and want != cells


def test_gap_circles_of_all_rounds(spark):
    rng = random.Random(12)
    h, w, least, apart = 24, 30, 1.5, 2
    mask = {(rng.randrange(h), rng.randrange(w)) for _ in range(12)}
    df = spark.createDataFrame([(1, y, x) for y, x in mask], "image_id long, y long, x long")
    got = X.gap_circles(df, h, w, least, apart)
    taken, k, now = [], 0, set(mask)
    while True:
        k += 1
        d = {(y, x): min((y - a) ** 2 + (x - b) ** 2 for a, b in now) for y in range(h) for x in range(w)}
        able = [(v, y, x) for (y, x), v in d.items() if v > least**2 and v == max(d.get((y + i, x + j), 0) for i in range(-apart, apart + 1) for j in range(-apart, apart + 1))]
        new = []
        for v, y, x in sorted(able, key=lambda c: (-c[0], c[1], c[2])):
            if all(math.hypot(y - a, x - b) >= math.sqrt(v) + r for a, b, r, _ in new):
                new.append((y, x, math.sqrt(v), k))
        if not new:
            break
        taken += new
        now |= {(y + i, x + j) for y, x, r, _ in new for i in range(-int(r), int(r) + 1) for j in range(-int(r), int(r) + 1) if i * i + j * j <= int(r) ** 2 and 0 <= y + i < h and 0 <= x + j < w}
    assert k > 2 and {(r["y"], r["x"], r["r"], r["round"]) for r in got.collect()} == {(float(y), float(x), r, n) for y, x, r, n in taken}
    region = spark.createDataFrame([(1, y, x) for y in range(12) for x in range(w)], "image_id long, y long, x long")
    assert X.inside(got, region).count() == sum(y < 12 for y, *_ in taken)


@pytest.mark.parametrize("rounds, apart", [(1, 3), (None, 1), (2, 40)])
def test_gap_circles_within_tasks_and_by_rounds(spark, rounds, apart):
    rng = random.Random(apart)
    h, w = 13, 17
    rows = [(k, rng.randrange(h), rng.randrange(w)) for k in range(-6, 6) for _ in range(rng.choice([1, 2, 5, 25, 150]))]
    df = spark.createDataFrame([*rows, *rows[::3], (None, 1, 1), (3, None, 1), (90, None, None)], "image_id long, y long, x long").repartition(3)
    one, other = (sorted(map(tuple, X.gap_circles(df, h, w, 1.0, apart, rounds, most).collect())) for most in (h * w, 0))
    assert one == other and len({r[0] for r in one}) > 6 and (rounds == 1 or max(r[4] for r in one) > 1)


def test_gap_circles_of_chunks_in_slabs():
    rng = np.random.default_rng(3)
    g = np.sort(rng.integers(0, 40, 400))
    g = np.unique(g, return_inverse=True)[1]
    c = {"y": rng.integers(0, 9, 400), "x": rng.integers(0, 11, 400)}

    def found(places):
        parts = list(chunks.gap_circles(9, 11, 0.5, 2, None, places)(g, c))
        return len(parts), sorted((int(k), *map(float, r)) for of, m in parts for k, *r in zip(of, m["y"], m["x"], m["r"], m["round"], strict=True))

    (few, whole), (many, cut) = found(1 << 19), found(99)
    assert whole == cut and len(whole) > 40 and many > 10 * few


def test_widest_gaps_are_shuffled_once(spark, small):
    from weftlens.plans import spatial

    plan = spatial.widest_gaps(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan


def test_line_pixels_and_samples(spark):
    rows = [(k, y0, x0, y1, x1) for k, (y0, x0, y1, x1) in enumerate([(0, 0, 0, 0), (0, 0, 3, 9), (5, 5, 0, 2), (2, 7, 2, 0), (-3, 4, 4, -3)])]
    got = collections.defaultdict(list)
    for r in sorted(X.line_pixels(spark.createDataFrame(rows, "id long, y0 long, x0 long, y1 long, x1 long")).collect(), key=lambda r: (r["id"], r["at"])):
        got[r["id"]].append((r["y"], r["x"]))
    for k, y0, x0, y1, x1 in rows:
        n = max(abs(y1 - y0), abs(x1 - x0))
        assert got[k] == [(math.floor(y0 + t * (y1 - y0) / n + 0.5), math.floor(x0 + t * (x1 - x0) / n + 0.5)) if n else (y0, x0) for t in range(n + 1)] and got[k][-1] == (y1, x1)
    raster = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 3.0), (1, 1, 0, 5.0), (1, 1, 1, 9.0)], "image_id long, y long, x long, v double")
    ask = spark.createDataFrame([(1, 1, 0.5, 0.5), (1, 2, 0.0, 0.25), (1, 3, 1.0, 1.0), (1, 4, 1.5, 0.0), (1, 5, 9.0, 9.0)], "image_id long, id long, y double, x double")
    assert {r["id"]: r["value"] for r in X.sampled(ask, raster).collect()} == {1: 4.5, 2: 1.5, 3: 9.0, 4: 2.5, 5: 0.0}


def shades_by_hand(shades, corners):
    """Component numbers of equal values of a dict place -> value."""
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (corners or not (dy and dx))]
    label = {}
    for start in sorted(shades):
        if start in label:
            continue
        label[start], todo = start, [start]
        while todo:
            y, x = todo.pop()
            for dy, dx in steps:
                p = y + dy, x + dx
                if p in shades and p not in label and shades[p] == shades[start]:
                    label[p] = start
                    todo.append(p)
    return label


def regions_by_hand(picture, side, levels, hue, above, least):
    shades = {p: tuple(min(int(c * levels // 256), levels - 1) for c in v) for p, v in picture.items()}
    label = shades_by_hand(shades, True)
    groups = collections.defaultdict(list)
    for p, k in label.items():
        groups[k].append(picture[p])
    means = {k: [math.floor(sum(c) / len(v)) for c in zip(*v)] for k, v in groups.items()}
    tones = {k: colorsys.rgb_to_hsv(*[c / 255 for c in v]) for k, v in means.items()}
    grey = all(h == 0 and s == 0 for h, s, _ in tones.values())
    mu = (0, 0, 0.99) if grey else (hue, 160 / 255, 200 / 255)
    close = {k: math.prod(math.exp(-((a - m) ** 2) / (2 * s * s)) / (s * math.sqrt(2 * math.pi)) for a, m, s in zip(t, mu, (0.1, 0.3, 0.5))) for k, t in tones.items()}
    low, high = min(close.values()), max(close.values())
    mask = {(y, x): label.get((y, x)) is not None and (close[label[y, x]] - low) / (high - low + 2.220446049250313e-16) > above for y in range(side) for x in range(side)}
    if not any(mask.values()):
        return set()
    for value in (False, True):  # holes first, then objects
        label = shades_by_hand(mask, False)
        size = collections.Counter(label.values())
        mask = {p: (not m if m == value and size[label[p]] < least else m) for p, m in mask.items()}
    return {p for p, m in mask.items() if m}


def test_regions_by_colour_against_brute_force(spark):
    rng = random.Random(20)
    side, schema = 12, "image_id string, y long, x long, r double, g double, b double"
    pictures = {"noise": {(y, x): tuple(rng.choice((20, 90, 200)) for _ in range(3)) for y in range(side) for x in range(side)}}
    pictures["blocks"] = {(y, x): ((200, 40, 90), (10, 20, 200), (240, 230, 235))[(y // 4 + x // 5) % 3] for y in range(side) for x in range(side)}
    pictures["grey"] = {(y, x): (rng.choice((10, 120, 250)),) * 3 for y in range(side) for x in range(side)}
    pictures["flat"] = {(y, x): (50, 60, 70) for y in range(side) for x in range(side)}
    pictures["sparse"] = {p: v for p, v in pictures["noise"].items() if rng.random() < 0.4}
    rows = [(k, y, x, *map(float, v)) for k, picture in pictures.items() for (y, x), v in picture.items()]
    odd = [rows[0], (*rows[1][:3], 0.0, 0.0, 0.0), ("noise", 1, 1, None, 1.0, 1.0), ("noise", None, 1, 1.0, 1.0, 1.0), (None, 1, 1, 1.0, 1.0, 1.0)]
    docs = spark.createDataFrame(rows + odd, schema)
    for least in (1, 5):
        got = collections.defaultdict(set)
        for r in regions.colour_regions(docs, side, side, levels=3, least=least).collect():
            assert (r["y"], r["x"]) not in got[r["image_id"]]
            got[r["image_id"]].add((r["y"], r["x"]))
        for k, picture in pictures.items():
            assert got[k] == regions_by_hand(picture, side, 3, 0.96, 0.2, least), (k, least)
    assert regions.colour_regions(docs.limit(0), side, side).count() == 0
    assert regions.whole(docs.where("image_id = 'sparse'"), 3, 4).count() == 12


def test_intensities_fall_back_to_grey_and_to_zero(spark):
    schema = "image_id string, y long, x long, r double, g double, b double"
    red, pale = (120.0, 20.0, 60.0), (250.0, 250.0, 250.0)
    rows = [("a", 0, 0, *red), ("a", 0, 1, *pale), ("a", 0, 1, *pale), ("a", 1, 1, *pale), ("b", 0, 0, *pale), ("c", 0, 0, None, 1.0, 1.0)]
    at = "image_id string, y int, x int"
    masks = {"all": [("a", 0, 0), ("a", 0, 1), ("b", 0, 0)], "pale": [("a", 0, 1), ("a", 0, 1), ("a", 1, 1)], "none": []}
    got = {r["image_id"]: r for r in regions.masked_intensities(spark.createDataFrame(rows, schema), {k: spark.createDataFrame(v, at) for k, v in masks.items()}).collect()}
    stained = measure.eosin_gray(np.array([[red]]))[0, 0]
    grey = int(250 * 0.2125 + 250 * 0.7154 + 250 * 0.0721)
    assert stained < 180 and set(got) == {"a", "b"}
    assert (got["a"]["all"], got["a"]["pale"], got["a"]["none"]) == (stained, pytest.approx(grey, abs=1), 0)
    assert got["b"]["all"] == pytest.approx(grey, abs=1) and (got["b"]["pale"], got["b"]["none"]) == (0, 0)


def test_small_keys_in_tasks_equal_large_ones_by_rounds(spark):
    rng = random.Random(11)
    px = [((i, "a"), y, x, float(rng.randint(0, 9)), float(y)) for i in range(6) for y in range(20) for x in range(20) if rng.random() < 0.1 + 0.1 * i]
    df = spark.createDataFrame(px, "image_id struct<i:long,s:string>, y long, x long, v double, r double")
    for corners in (True, False):
        found = [{tuple(r[c] for c in ("image_id", "y", "x0", "x1", "top", "root", "size", "peak", "r")) for r in X.labelled_runs(df, corners, ["r"], most=m).collect()} for m in (0, 120, 1 << 18)]
        assert found[0] == found[1] == found[2] and len(found[0]) > 100
    edges = spark.createDataFrame([(k, rng.randrange(40) * (k + 1), rng.randrange(40)) for k in range(4) for _ in range(10 + 10 * k)], "k long, src long, dst long")
    one, two, three = ({tuple(r) for r in graphs.components(edges, "k", most=m).collect()} for m in (0, 25, 1 << 18))
    assert one == two == three
    circles = spark.createDataFrame([(k, i, rng.uniform(0, 30), rng.uniform(0, 30), rng.choice([0.0, 1.0, 1.0, 4.0])) for k in range(3) for i in range(30 + 60 * k)], "k long, id long, y double, x double, r double")
    targets = circles.withColumn("id", -circles["id"])
    one, two, three = ({tuple(r) for r in O.nearest_in_plane(circles, targets, "k", most=m).collect()} for m in (0, 200, 1 << 12))
    assert one == two == three
    one, two, three = ({tuple(r) for r in O.chosen_circles(circles, "k", most=m).collect()} for m in (0, 100, 1 << 12))
    assert one == two == three


def test_written_tables_are_not_broadcast_by_their_files_sizes(spark):
    shelf = Scratch(spark, "sizes")
    one, two = (shelf.table(spark.range(100).selectExpr("id as k", f"id as {n}"), n) for n in ("a", "b"))
    assert "Broadcast" not in one.join(two.where("b > 3"), "k")._jdf.queryExecution().executedPlan().toString()


def test_lower_envelopes_of_many_rows_at_a_time():
    rng = np.random.default_rng(12)
    places = [(g, x, float(rng.integers(0, 50)) ** 2) for g in range(9) for x in sorted(rng.choice(40, rng.integers(1, 30), replace=False))]
    g, x, f = (np.array(c) for c in zip(*places, strict=True))
    n, out = chunks.lower_envelopes(g, {"x": x, "f": f}, 40)
    for k in range(9):
        own = n == k
        got = {c: out["f"][own][i] + (c - out["at"][own][i]) ** 2 for i in range(own.sum()) for c in range(out["_a"][own][i], out["_b"][own][i] + 1)}
        assert got == {c: float(min(f[i] + (x[i] - c) ** 2 for i in range(len(g)) if g[i] == k)) for c in range(40)}


def test_workers_get_few_rasters_at_a_time(spark):
    cells = spark.range(700).selectExpr("id as image_id", "0 as y", "0 as x", "1.0D as v").coalesce(1)
    sizes = kernels.per_image(imaging.rasters(cells).coalesce(1), lambda m: [(len(m),)], "n long")
    assert sizes.count() == 700 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") not in ("-1", str(2**63 - 1))


def _same(a, b):
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)
    assert rows(a) == rows(b)


def _dots(spark, share, n=40, images=3):
    rng = np.random.default_rng(5)
    rows = [(k, int(y), int(x)) for k in range(images) for y, x in np.argwhere(rng.random((n, n)) < share)]
    rows += [(9, *p) for p in ((0, 0), (0, 1), (1, 2), (2, 1), (2, 0), (1, -1))]  # a ring
    return spark.createDataFrame([*rows, *rows[:5]], "image_id long, y long, x long")


def _arrows(df, fn=None):
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


@pytest.mark.parametrize("share", [0.15, 0.3])
def test_paths_and_routes_in_tasks_equal_rounds(spark, share):
    dots = _dots(spark, share)
    edges = _arrows(X.pixel_graph(dots))
    _same(edges, X.pixel_graph(dots, most=10))
    found = _arrows(graphs.paths(edges, "image_id"))
    _same(found, graphs.paths(edges, "image_id", most=10))
    some = found.where("kind <> 'ring'").select("image_id", "src", "dst", "length")
    routes = _arrows(graphs.longest_routes(some, "image_id"))
    _same(routes, graphs.longest_routes(some, "image_id", most=10))
    _same(routes, graphs.longest_routes(some, "image_id", nodes=6))


def test_routes_of_small_components_write_no_pairs(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(graphs, "_routes_by_rounds", refused)
    edges = _arrows(X.pixel_graph(_dots(spark, 0.15)))
    assert graphs.longest_routes(edges, "image_id").count()
    with pytest.raises(AssertionError):
        graphs.longest_routes(edges, "image_id", nodes=2)


def test_rays_in_tasks_equal_rays_as_rows(spark):
    rng = np.random.default_rng(3)
    edge = [(k, int(y), int(x)) for k in range(3) for y, x in np.argwhere(rng.random((20, 20)) < 0.1)]
    p = [(int(rng.integers(4)), int(rng.integers(2)), i, float(rng.random() * 24 - 2), float(rng.random() * 24 - 2), float(rng.random() * 6)) for i in range(300)]
    p += [(0, 1, 400, None, 3.0, 1.0), (0, None, 401, 3.0, 3.0, 1.0), (None, 1, 402, 3.0, 3.0, 1.0)]
    points, seen = spark.createDataFrame(p, "image_id long, contour_id long, idx long, y double, x double, angle double"), spark.createDataFrame(edge, "image_id long, y long, x long")
    kept = ["image_id", "contour_id", "idx", "left", "right", "filled"]
    known = points.where("contour_id is not null")
    _same(X.ray_widths(known, seen, 8).select(*kept), X.ray_widths(known, seen, 8, most=10).select(*kept))
    assert X.ray_widths(points, seen, 8).count() == len(p)


@pytest.mark.parametrize("side", [32, 256])
def test_thinning_by_tiles_equals_whole_rasters(spark, side):
    rng = np.random.default_rng(8)
    masks = [kernels.filtered(rng.random((90, 110)), *[np.ones(9) / 9] * 2) > 0.5, np.ones((70, 90), bool), rng.random((80, 80)) < 0.5]
    rows = [(k, int(y) - 40, int(x) - 30) for k, m in enumerate(masks) for y, x in np.argwhere(m)]
    got = {(k, y, x) for k, y, x in X.thinned(spark.createDataFrame([*rows, *rows[:9]], "image_id long, y long, x long"), side).collect()}
    want = {(k, int(y) - 40, int(x) - 30) for k, m in enumerate(masks) for y, x in np.argwhere(kernels.thinned(m))}
    assert got == want


def test_codes_and_thinning_take_one_shuffle_of_pixels(spark):
    dots = _dots(spark, 0.3)
    plan = X.neighbour_codes(dots)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "Aggregate" not in plan
