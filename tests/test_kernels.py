"""Kernels on rasters whose measures are known by hand."""

import math

import numpy as np
import pytest

from weftlens.operators import kernels as K


def brute_distance(mask):
    ys, xs = np.nonzero(~mask)
    yy, xx = np.mgrid[: mask.shape[0], : mask.shape[1]]
    return np.sqrt(((yy[..., None] - ys) ** 2 + (xx[..., None] - xs) ** 2).min(-1))


def test_distances_are_exact():
    rng = np.random.default_rng(0)
    for share in (0.02, 0.2, 0.8):
        free = rng.random((23, 31)) > share
        free[3, 4] = False
        assert np.allclose(K.distances(free), brute_distance(free))


def test_distances_without_any_unset_pixel():
    assert (K.distances(np.ones((4, 5), bool)) >= 9).all()


def test_labels():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 1]], bool)
    assert K.labels(m).max() == 4
    assert K.labels(m, diagonal=False).max() == 5
    assert K.labels(np.zeros((3, 3), bool)).max() == 0
    spiral = np.ones((41, 41), bool)
    spiral[1:-1:2, 1:] = False
    assert K.labels(spiral).max() == 1


def test_small_parts_and_holes():
    m = np.zeros((10, 10), bool)
    m[1:7, 1:7] = True
    m[3, 3] = False
    m[9, 9] = True
    assert K.without_small(m, 2).sum() == 35
    assert K.holes_filled(m, 4)[3, 3]


def line(n=20):
    m = np.zeros((9, n + 4), bool)
    m[4, 2 : 2 + n] = True
    return m


def test_line_has_two_ends():
    [(area, length, tips, branches, mean, lacunarity, longest, bend)] = K.skeleton_metrics(line(20), 5, (10,))
    assert (area, length, tips, branches, mean) == (20, 20, 2, 0, 20.0)
    assert longest == pytest.approx(19)
    assert bend == [0.0]
    assert lacunarity == pytest.approx(abs(1 / (20 / line(20).size) - 2))


def test_plus_has_a_branch_point():
    m = np.zeros((31, 31), bool)
    m[15, 3:28] = m[3:28, 15] = True
    edges = K.skeleton_edges(K.thinned(m))
    assert len(edges) == 4 and {e["kind"] for e in edges} == {"end-to-brh"}
    assert K.skeleton_metrics(m, 5)[0][2:4] == (4, 1)
    assert K.skeleton_edges(K.thinned(m), 50) == []


def test_ring_has_no_edges_but_length():
    yy, xx = np.mgrid[:41, :41]
    r = np.hypot(yy - 20, xx - 20)
    ring = (r < 14) & (r > 11)
    [(_, length, tips, branches, mean, *_)] = K.skeleton_metrics(ring, 5)
    assert length > 60 and tips == branches == 0 and mean == 0


def test_empty_and_full():
    for m in (np.zeros((8, 8)), np.ones((8, 8))):
        K.skeleton_metrics(m)
    assert K.skeleton_metrics(np.zeros((8, 8)))[0][:5] == (0, 0, 0, 0, 0.0)
    assert K.gap_circles(np.zeros((8, 8), bool), 1) == []


def test_thinning_keeps_components_and_is_thin():
    rng = np.random.default_rng(4)
    m = K.filtered(rng.random((60, 60)), *[np.ones(5) / 5] * 2) > 0.5
    t = K.thinned(m)
    assert not (t & ~m).any() and K.labels(t).max() >= K.labels(K.without_small(m, 5)).max()
    assert (K.thinned(t) == t).all()


def test_quarter_turn_curvature():
    t = np.linspace(0, math.pi / 2, 200)
    p = np.column_stack([50 * np.sin(t), 50 * np.cos(t)])
    step = math.degrees(t[1] - t[0])
    inner = K.path_curvature(p, 20)[20:-20]
    assert np.allclose(inner, 10 * step, atol=1e-6)


def test_one_hole_is_one_circle_first():
    yy, xx = np.mgrid[:61, :61]
    free = np.hypot(yy - 30, xx - 30) < 20
    circles = K.gap_circles(free, 3)
    y, x, r = circles[0]
    assert (y, x) == (30, 30) and r == pytest.approx(20, abs=1)
    assert all(c[2] > 3 for c in circles)


def test_circles_of_a_round_do_not_overlap_and_erase():
    rng = np.random.default_rng(3)
    free = rng.random((64, 64)) > 0.02
    circles = K.gap_circles(free, 2)
    assert circles
    for y, x, _ in circles:
        assert free[int(y), int(x)]


def bar(width=5):
    image = np.full((40, 60), 200.0)
    image[20 - width // 2 : 20 + width // 2 + 1, 5:55] = 50
    return image


def test_a_dark_bar_is_one_contour_of_its_width():
    image = bar(5)
    maps = K.ridge_maps(image, (5,), dark=True)
    lines = K.linked_contours(maps, 5, 20, 10)
    assert len(lines) == 1 and len(lines[0]) > 40
    assert np.abs(lines[0][:, 0] - 20).max() < 1
    at = tuple(np.rint(lines[0][:, :2]).astype(int).T)
    w = K.line_widths(image, lines[0], np.column_stack([maps["ny"][at], maps["nx"][at]]), float(maps["sigma"].mean()))
    assert np.nanmedian(w) == pytest.approx(2.5, abs=0.8)
    assert K.linked_contours(K.ridge_maps(image, (5,), dark=False), 20, 60, 30) == []


def test_crossing_bars_meet():
    image = bar(3)
    image[3:37, 29:32] = 50
    lines = K.linked_contours(K.ridge_maps(image, (3, 5)), 5, 20, 5)
    assert len(lines) >= 2
    assert K.drawn(lines, image.shape).sum() > 60
    K.junctions(lines)


def test_extension_is_bounded():
    maps = K.ridge_maps(bar(5), (5,))
    c = K.linked_contours(maps, 5, 20, 10)
    longer = K.extended(c, maps, 1.0, 3)
    assert len(c[0]) <= len(longer[0]) <= len(c[0]) + 6


def test_regions_and_mean_field():
    image = np.zeros((40, 40))
    image[10:30, 10:30] = 1
    assert K.regions(image, least=20).sum() == 400
    assert not K.regions(np.full((5, 5), 3.0)).any()
    rng = np.random.default_rng(0)
    scores = np.stack([1 - image, image], 2) + rng.normal(0, 0.4, (40, 40, 2))
    p = K.mean_field(scores, image)
    assert np.allclose(p.sum(2), 1)
    assert ((p.argmax(2) == 1) == (image == 1)).mean() > ((scores.argmax(2) == 1) == (image == 1)).mean()


def test_small_geometry():
    assert K.pixels_between(0, 0, 2, 4).tolist() == [[0, 0], [1, 1], [1, 2], [2, 3], [2, 4]]
    assert K.pixels_between(3, 3, 3, 3).tolist() == [[3, 3]]
    image = np.arange(12.0).reshape(3, 4)
    assert K.interpolated(image, np.array([0.5, 2, 9]), np.array([0.5, 3, 9])).tolist() == [2.5, 11, 11]
    assert K.resized(image, 4).tolist() == image.tolist() and K.resized(np.full((10, 20), 3.0), 7).shape == (4, 7)
    assert K.upright(np.zeros((5, 3))).shape == (3, 5)
    assert np.allclose(K.smoothed_widths(np.full(30, 2.0)), 2)
    t = np.linspace(0, np.pi, 80)
    circle = np.column_stack([40 * np.sin(t), 40 * np.cos(t)])
    assert np.allclose(np.abs(K.spline_curvature(circle, 0.1))[10:-10], 1 / 40, rtol=0.05)


def test_discs_are_those_of_the_whole_image():
    rng = np.random.default_rng(5)
    yy, xx = np.mgrid[:20, :30]
    for _ in range(200):
        y, x, r = rng.uniform(-3, 23), rng.uniform(-3, 33), rng.uniform(0, 9)
        m = np.zeros((20, 30), bool)
        K.set_disc(m, y, x, r, True)
        assert (m == ((yy - y) ** 2 + (xx - x) ** 2 <= r * r)).all()


def test_longest_route_and_maps():
    m = np.zeros((31, 41), bool)
    m[15, 3:38] = m[3:15, 20] = True  # a T: the long bar is the longest path
    edges = K.skeleton_edges(m)
    length, route = K.longest_route(edges)
    assert length == K.longest_path(edges) and length >= 32 and len(route) == 2
    assert K.longest_curvature(edges, 10) < 10
    every, long_ = K.length_map(edges, m.shape), K.length_map(edges, m.shape, True)
    assert (every > 0).sum() > (long_ > 0).sum() > 25 and set(np.unique(long_)) == {0.0, length}
    assert K.longest_curvature([], 10) == 0.0


def test_patterns_and_facets():
    m = np.zeros((9, 9), bool)
    m[4, 1:8] = True
    end = np.array([[0, 0, 0], [0, 1, 1], [0, 0, 0]])
    assert np.argwhere(K.any_pattern(m, [end])).tolist() == [[4, 1], [4, 7]]
    yy, xx = np.mgrid[:9, :9].astype(float)
    surface = 2 + 3 * yy - xx + 0.5 * yy * yy + 0.25 * yy * xx - xx * xx
    y, x = np.array([3.3, 4.0, 2.6]), np.array([4.2, 5.4, 3.0])
    assert np.allclose(K.facet_response(surface, y, x), 2 + 3 * y - x + 0.5 * y * y + 0.25 * y * x - x * x)


def test_scales_have_their_own_thresholds():
    maps = K.ridge_maps(bar(5), (3, 9), thresholds=lambda width, sigma: (width, 10 * width))
    assert set(np.unique(maps["low"])) <= {3, 9} and (maps["high"] == 10 * maps["low"]).all()
    wide = maps["sigma"] > 2
    assert (maps["low"][wide] == 9).all() and (maps["low"][~wide] == 3).all()


def test_junctions_equal_all_pairs_of_contours():
    rng = np.random.default_rng(13)
    contours = [np.cumsum(rng.integers(-1, 2, (n, 3)), axis=0) + rng.integers(0, 12, 3).astype(float) for n in rng.integers(1, 12, 40)]
    expected = set()
    for i, c in enumerate(contours):
        for end in (c[0], c[-1]):
            for j, other in enumerate(contours):
                d = np.hypot(other[:, 0] - end[0], other[:, 1] - end[1])
                if i != j and d.min() <= 1.5:
                    k = int(d.argmin())
                    expected.add((i, j, k, float(other[k, 0]), float(other[k, 1])))
    assert K.junctions(contours) == sorted(expected) and len(expected) > 40
    assert K.junctions([]) == []


def test_many_paths_bend_as_each_alone():
    rng = np.random.default_rng(4)
    paths = [[tuple(map(int, p)) for p in np.cumsum(rng.integers(-1, 2, (n, 2)), 0)] for n in (1, 2, 3, 9, 40)]
    for window in (1, 2, 10, 30):
        assert (K.paths_curvature(paths, window) == np.concatenate([K.path_curvature(np.array(p), window) for p in paths])).all()


def test_steps_of_lines_are_ranked_once_for_both_ways():
    rng = np.random.default_rng(6)
    maps = K.ridge_maps(K.filtered((rng.random((30, 40)) < 0.2).astype(float), *[np.ones(3) / 3] * 2), (3,), dark=False)
    line = (np.abs(maps["py"]) <= 0.6) & (np.abs(maps["px"]) <= 0.6)
    on = np.flatnonzero(line)
    ny, nx, py, px = ([float(v) for v in maps[c].ravel()[on]] for c in ("ny", "nx", "py", "px"))
    places = list(zip(*map(np.ndarray.tolist, np.divmod(on, 40)), strict=True))
    number = {p: i for i, p in enumerate(places)}
    after, first = K._steps_ahead(line, on, *np.divmod(on, 40), *map(np.array, (ny, nx, py, px)))
    for i, p in enumerate(places):
        for way, s in ((0, 1), (1, -1)):
            want = []
            for dy, dx in K.AROUND:
                q = number.get((p[0] + dy, p[1] + dx))
                if q is not None and (dy * s * -nx[i] + dx * s * ny[i]) / math.hypot(dy, dx) >= 0.5:
                    turn = math.acos(min(1.0, abs(ny[i] * ny[q] + nx[i] * nx[q])))
                    back = s * (nx[q] * nx[i] + ny[q] * ny[i]) < 0
                    want.append((math.hypot(dy + py[q] - py[i], dx + px[q] - px[i]) + turn, 2 * q + back))
            assert after[first[2 * i + way] : first[2 * i + way + 1]] == [w for _, w in sorted(want, key=lambda w: w[0])]
