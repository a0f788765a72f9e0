"""Keys that are small enough for a task, handled many at a time: sorted by key, cut between keys, as arrays over a whole chunk.

What is larger goes by rows and rounds in graphs.py, pixels.py and points.py; both give the same results. A chunk holds about as many rows as the largest
small key, whatever the table's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: Rows of a key, or of a chunk of keys, that one task holds at a time.
MOST = 1 << 18


def halves(df: DataFrame, keys: Sequence[str], shelf: Scratch, name: str, most: int = MOST, weight=None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys of at most so many rows (or such a sum of weights), and the others or None. Rows with a null key are in neither.

    df is read twice, so it should be a table. The large keys are at most its rows by most, so that list is broadcast.
    """
    total = F.count("*") if weight is None else F.sum(weight)
    large = shelf.table(df.groupBy(*keys).agg(total.alias("_n")).where(F.col("_n") > most).select(*keys), f"{name}-large")
    known = df.dropna(subset=list(keys))
    if large.isEmpty():
        return known, None
    few = F.broadcast(large)
    return known.join(few, list(keys), "left_anti"), known.join(few, list(keys), "left_semi")


def _changes(col: pa.Array) -> np.ndarray:
    """Whether each row but the first differs from the one before; nulls equal each other."""
    if pa.types.is_struct(col.type):
        out = np.zeros(len(col) - 1, bool)
        for part in col.flatten():
            out |= _changes(part)
        return out
    a, b = col.slice(1), col.slice(0, len(col) - 1)
    import pyarrow.compute as pc

    one_null = pc.not_equal(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return one_null | pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)


def first_rows(columns: Sequence[pa.Array]) -> np.ndarray:
    """Indexes of the rows that start a key."""
    n = len(columns[0])
    new = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        new |= _changes(c)
    return np.concatenate([np.zeros(min(n, 1), np.int64), np.flatnonzero(new) + 1])


def by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[np.ndarray, dict[str, np.ndarray]], tuple[np.ndarray, dict]], schema: str, rows: int = MOST, along: Sequence[str] = (), dealt: bool = False) -> DataFrame:
    """(keys, along, schema) of fn over chunks of whole keys: fn gets the keys' numbers, in order, and the other columns as arrays.

    It gives back the numbers of its own rows' keys and their columns, or yields such parts one after the other. Rows come sorted by keys and order.
    Columns along, which fn doesn't get, are taken as they are from the rows that fn names in _row. dealt says that a key's rows stand in one partition.
    """
    n, m = len(keys), len(keys) + len(along)
    cols = [*keys, *along, *[c for c in df.columns if c not in (*keys, *along)]]
    types = dict(df.dtypes)
    out = ", ".join([f"{k} {types[k]}" for k in (*keys, *along)] + [schema])
    names = [f.split()[0] for f in schema.split(",")]

    def done(table: pa.Table):
        parts = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
        parts = [p.chunk(0) if isinstance(p, pa.ChunkedArray) else p for p in parts]
        starts = first_rows(parts[:n])
        number = np.zeros(len(table), np.int64)
        number[starts[1:]] = 1
        found = fn(np.cumsum(number), {c: p.to_numpy(zero_copy_only=False) for c, p in zip(cols[m:], parts[m:], strict=True)})
        for at, made in [found] if isinstance(found, tuple) else found:
            kept = [p.take(pa.array(starts[at])) for p in parts[:n]] + [p.take(pa.array(made["_row"])) for p in parts[n:m]]
            for k in range(0, len(at), 1 << 16):
                yield pa.record_batch([*[p.slice(k, 1 << 16) for p in kept], *[pa.array(made[c][k : k + (1 << 16)], from_pandas=True) for c in names]], names=[*keys, *along, *names])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < rows:
                continue
            table = pa.Table.from_batches(held)
            last = int(first_rows([table.column(k).combine_chunks() for k in range(n)])[-1])
            if last:
                yield from done(table.slice(0, last))
                held = table.slice(last).to_batches()
                size -= last
        if size:
            yield from done(pa.Table.from_batches(held))

    whole = df.select(*cols) if dealt else df.select(*cols).repartition(*keys)
    return whole.sortWithinPartitions(*keys, *order).mapInArrow(run, out)


def spread(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for all j from first[i] to before end[i]."""
    n = np.maximum(end - first, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + first[i]


def least_of_component(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of the component of each of n nodes, under edges (a, b)."""
    root = np.arange(n)
    while len(a):
        u, v = root[a], root[b]
        open_ = u != v
        a, b, u, v = a[open_], b[open_], u[open_], v[open_]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def numbered(g: np.ndarray, *nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Numbers of nodes within their keys g: each one's key and node, in order, and the numbers of each list of nodes."""
    keys, values = np.concatenate([g] * len(nodes)), np.concatenate(nodes)
    order = np.lexsort((values, keys))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(keys[order]) != 0) | (np.diff(values[order]) != 0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return keys[order][new], values[order][new], np.split(number, len(nodes))


def components(g: np.ndarray, c: dict[str, np.ndarray]) -> tuple[np.ndarray, dict]:
    """node and root of edges (src, dst)."""
    keys, values, (a, b) = numbered(g, c["src"], c["dst"])
    return keys, {"node": values, "root": values[least_of_component(len(keys), a, b)]}


def labelled_runs(reach: int, sums: Sequence[str], row: int):
    """Runs of pixels (y, x, v, *sums) with root, size, peak and the component's sums."""

    def fn(g, c):
        y, x = c["y"].astype(np.int64), c["x"].astype(np.int64)
        line = np.ones(len(g), bool)
        line[1:] = (np.diff(g) != 0) | (np.diff(y) != 0)
        new = line.copy()
        new[1:] |= np.diff(x) != 1
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(g)) - 1
        x0, x1, rg, ry = x[at], x[last], g[at], y[at]
        r = np.cumsum(line)[at]  # the number of the row
        low, wide = x.min() - 2, int(x.max() - x.min()) + 8
        starts, ends = r * wide + (x0 - low), r * wide + (x1 - low)
        # the row after, where it is the next one of the same raster
        after = np.searchsorted(r, r + 1)
        ok = after < len(r)
        ok[ok] = (rg[after[ok]] == rg[ok]) & (ry[after[ok]] == ry[ok] + 1)
        first = np.searchsorted(ends, starts + wide - reach)
        end = np.where(ok, np.searchsorted(starts, ends + wide + reach, "right"), first)
        a, b = spread(first, end)
        comp = least_of_component(len(at), a, b)
        n = len(at)

        def best(v, to):
            out = np.full(n, -np.inf)
            np.fmax.at(out, to, v)
            return np.where(np.isneginf(out), np.nan, out) if np.isneginf(out[to]).any() else out

        top = np.fmax.reduceat(c["v"].astype(float), at)
        made = {"y": ry, "x0": x0, "x1": x1, "top": top, "root": (ry * row + x0)[comp], "size": np.bincount(comp, x1 - x0 + 1, n).astype(np.int64)[comp], "peak": best(top, comp)[comp]}
        for s in sums:
            made[s] = np.bincount(comp, np.add.reduceat(c[s].astype(float), at), n)[comp]
        return rg, made

    return fn


def _lines(g: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable]:
    """Distinct pixels of sorted (g, y, x) as ascending numbers of their chunk: what is kept, its number's row, and finding neighbours.

    The last gives the places of the pixels at (dy, dx) from each, or their count where there is none.
    """
    kept = np.ones(len(g), bool)
    kept[1:] = (np.diff(g) != 0) | (np.diff(y) != 0) | (np.diff(x) != 0)
    g, y, x = g[kept], y[kept].astype(np.int64), x[kept].astype(np.int64)
    line = np.ones(len(g), bool)
    line[1:] = (np.diff(g) != 0) | (np.diff(y) != 0)
    r, at = np.cumsum(line) - 1, np.flatnonzero(line)
    low, wide, n = x.min() - 2, int(x.max() - x.min()) + 5, len(g)
    code = r * wide + (x - low)
    next_ = np.zeros(len(at), bool)
    next_[:-1] = (g[at[1:]] == g[at[:-1]]) & (y[at[1:]] == y[at[:-1]] + 1)

    def neighbours(dy: int, dx: int) -> np.ndarray:
        to = code + (dy * wide + dx)
        if dy == 0:
            there = np.arange(n) + dx
            ok = (there >= 0) & (there < n)
        else:
            there = np.searchsorted(code, to)
            ok = (there < n) & (next_[r] if dy > 0 else np.append(False, next_[:-1])[r])
        out = np.full(n, n)
        ok &= code[np.where(ok, there, 0)] == to
        out[ok] = there[ok]
        return out

    return kept, g, y, x, neighbours


def pixel_edges(row: int):
    """Edges (src, dst, length) between neighbouring pixels (y, x), numbered by row times y and x."""

    def fn(g, c):
        _, g, y, x, neighbours = _lines(g, c["y"], c["x"])
        node, src, dst, length = y * row + x, [], [], []
        for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
            to = neighbours(dy, dx)
            a = np.flatnonzero(to < len(node))
            src, dst, length = [*src, a], [*dst, to[a]], [*length, np.full(len(a), math.hypot(dy, dx))]
        a, b = np.concatenate(src), np.concatenate(dst)
        return g[a], {"src": node[a], "dst": node[b], "length": np.concatenate(length)}

    return fn


def _eight(g: np.ndarray, c: dict[str, np.ndarray], around: Sequence[tuple[int, int]]):
    """Distinct pixels and, for each direction of around, the places of their neighbours, opposite ones from one search."""
    kept, g, y, x, neighbours = _lines(g, c["y"], c["x"])
    n, near = len(g), {}
    for dy, dx in around:
        if (dy, dx) > (0, 0):
            to = neighbours(dy, dx)
            back = np.full(n, n)
            ok = to < n
            back[to[ok]] = np.flatnonzero(ok)
            near[dy, dx], near[-dy, -dx] = to, back
    return kept, g, y, x, [near[d] for d in around]


def _codes(alive: np.ndarray, near: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(near[0]), np.uint8)
    for k, to in enumerate(near):
        out |= alive[to] << np.uint8(k)
    return out


def neighbour_codes(around: Sequence[tuple[int, int]]):
    """code of the pixels (y, x) that are a tile's own (core): which neighbours are set."""

    def fn(g, c):
        kept, g, y, x, near = _eight(g, c, around)
        alive = np.ones(len(g) + 1, np.uint8)
        alive[-1] = 0
        core = c["core"][kept]
        return g[core], {"y": y[core], "x": x[core], "code": _codes(alive, near)[core].astype(np.int32)}

    return fn


def thinned(around: Sequence[tuple[int, int]], goes: Sequence[np.ndarray], times: int):
    """The pixels (y, x) of a tile's own that are left after so many half rounds; goes tells for each code whether it goes, for half rounds in turn.

    A row that is late, and no pixel, stands for a tile that lost one of its own in the last two half rounds.
    """

    def fn(g, c):
        kept, g, y, x, near = _eight(g, c, around)
        core, alive, late = c["core"][kept], np.ones(len(g) + 1, np.uint8), np.zeros(0, np.int64)
        alive[-1] = 0
        for k in range(times):
            gone = np.flatnonzero(goes[k % 2][_codes(alive, near)] & (alive[:-1] > 0))
            alive[gone] = 0
            if k >= times - 2:
                late = np.union1d(late, g[gone[core[gone]]])
        left, no = np.flatnonzero((alive[:-1] > 0) & core), np.zeros(len(late), np.int64)
        return np.append(g[left], late), {"y": np.append(y[left], no), "x": np.append(x[left], no), "late": np.arange(len(left) + len(late)) >= len(left)}

    return fn


def first_hits(longest: int):
    """left and right for points (_t 0): steps of rays against and along (sin, cos) until one meets an edge pixel (_t 1), 0 where none does; _row is the point's."""

    def fn(g, c):
        ask = np.flatnonzero(c["_t"] == 0)
        edge = np.flatnonzero((c["_t"] == 1) & np.isfinite(c["y"]) & np.isfinite(c["x"]))
        py, px, sin, cos, pg = c["y"][ask], c["x"][ask], c["sin"][ask], c["cos"][ask], g[ask]
        hits = {-1: np.zeros(len(ask), np.int32), 1: np.zeros(len(ask), np.int32)}
        if len(edge):
            ey, ex = c["y"][edge].astype(np.int64), c["x"][edge].astype(np.int64)
            y0, x0, high, wide = ey.min(), ex.min(), int(ey.max() - ey.min()) + 1, int(ex.max() - ex.min()) + 1
            lines = g[edge] * high + (ey - y0)
            known = np.unique(lines)
            cells = np.searchsorted(known, lines) * wide + (ex - x0)
            dense = len(known) * wide <= 1 << 25
            if dense:
                there = np.zeros(len(known) * wide, bool)
                there[cells] = True
            else:
                there = np.unique(cells)
            valid = np.isfinite(py + px + sin + cos)
            for s, found in hits.items():
                open_ = np.flatnonzero(valid)
                for t in range(1, longest + 1):
                    gy, gx = np.floor(py[open_] + s * t * sin[open_] + 0.5) - y0, np.floor(px[open_] + s * t * cos[open_] + 0.5) - x0
                    ok = np.flatnonzero((gy >= 0) & (gy < high) & (gx >= 0) & (gx < wide))
                    i = open_[ok]
                    want = pg[i] * high + gy[ok].astype(np.int64)
                    r = np.minimum(np.searchsorted(known, want), len(known) - 1)
                    at = r * wide + gx[ok].astype(np.int64)
                    hit = known[r] == want
                    hit &= there[at] if dense else there[np.minimum(np.searchsorted(there, at), len(there) - 1)] == at
                    found[i[hit]] = t
                    open_ = open_[found[open_] == 0]
        return pg, {"_row": ask, "left": hits[-1], "right": hits[1]}

    return fn


def _shortest_pairs(g: np.ndarray, c: dict[str, np.ndarray]):
    """Keys and values of nodes, and distinct pairs (a, b) of their numbers, the lesser one first, with the least length."""
    keys, values, (a, b) = numbered(g, c["src"], c["dst"])
    u, v = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((c["length"], v, u))
    u, v = u[order], v[order]
    new = np.ones(len(u), bool)
    new[1:] = (np.diff(u) != 0) | (np.diff(v) != 0)
    return keys, values, u[new], v[new], c["length"][order][new].astype(float)


def paths(g: np.ndarray, c: dict[str, np.ndarray]) -> tuple[np.ndarray, dict]:
    """Chains of nodes of degree 2 as single paths (src, dst, length, hops, tips), rings with tips 3, by doubling pointers as in graphs.paths()."""
    keys, values, u, v, own = _shortest_pairs(g, c)
    start, head, own = np.append(u, v), np.append(v, u), np.append(own, own)
    degree = np.bincount(start, minlength=len(keys))
    out = np.argsort(start, kind="stable")
    first = np.cumsum(degree) - degree
    one, two = out[first[head]], out[np.minimum(first[head] + 1, len(out) - 1)]
    next_ = np.where(degree[head] == 2, np.where(head[one] != start, one, two), -1)
    last, length, hops, low = np.arange(len(start)), own.copy(), np.ones(len(start), np.int64), head.copy()
    open_, before = np.flatnonzero(next_ >= 0), None
    while len(open_) and not (before is not None and len(before[0]) == len(open_) and np.array_equal(before[0], open_) and np.array_equal(before[1], low[open_])):
        before = open_, low[open_]
        to = next_[open_]
        moved = next_[to], last[to], length[open_] + length[to], hops[open_] + hops[to], np.minimum(low[open_], low[to])
        next_[open_], last[open_], length[open_], hops[open_], low[open_] = moved
        open_ = open_[next_[open_] >= 0]
    src, dst = start, head[last]
    back = start[last]
    whole = np.flatnonzero((next_ < 0) & (degree[src] != 2) & (degree[dst] != 2) & ((src < dst) | ((src == dst) & (head <= back))))
    tips = (degree[src[whole]] == 1).astype(np.int32) + (degree[dst[whole]] == 1)
    on = np.flatnonzero(next_ >= 0)
    ring, at = np.unique(low[on], return_inverse=True)
    a, b = np.append(src[whole], ring), np.append(dst[whole], ring)
    rings = np.bincount(at, own[on], len(ring)) / 2, np.bincount(at, minlength=len(ring)) // 2
    made = {"src": values[a], "dst": values[b], "length": np.append(length[whole], rings[0]), "hops": np.append(hops[whole], rings[1]).astype(np.int64)}
    return keys[a], made | {"tips": np.append(tips, np.full(len(ring), 3)).astype(np.int32)}


def routes(g: np.ndarray, c: dict[str, np.ndarray], most: int, cells: int = 1 << 22) -> tuple[np.ndarray, dict]:
    """The longest shortest path (root, src, dst, length) of each component of at most so many nodes; edges of larger ones come back as left.

    All nodes of a component are sources at a time, and many components of about one size go together.
    """
    keys, values, u, v, length = _shortest_pairs(g, c)
    comp = least_of_component(len(keys), u, v)
    size = np.bincount(comp, minlength=len(keys))
    order = np.argsort(comp, kind="stable")  # nodes of each component one after the other
    rank = np.empty(len(keys), np.int64)
    starts = np.cumsum(size) - size
    rank[order] = np.arange(len(keys)) - starts[comp[order]]
    width = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    a, b, l = np.append(u, v), np.append(v, u), np.append(length, length)
    found = []
    roots = np.flatnonzero((size > 1) & (size <= most))
    for w in np.unique(width[roots]):
        these = roots[width[roots] == w]
        arcs_of = np.bincount(comp[a], minlength=len(keys))[these]
        slab = np.cumsum(np.maximum(arcs_of, size[these]) * w) // cells
        for part in np.split(these, np.flatnonzero(np.diff(slab)) + 1):
            in_ = np.zeros(len(keys), bool)
            in_[part] = True
            nodes = order[in_[comp[order]]]
            place = np.empty(len(keys), np.int64)
            place[nodes] = np.arange(len(nodes))
            arc = np.flatnonzero(in_[comp[a]])
            arc = arc[np.argsort(place[b[arc]], kind="stable")]
            come, go, step = place[a[arc]], place[b[arc]], l[arc][:, None]
            cut = np.flatnonzero(np.append(True, np.diff(go) != 0))
            d = np.full((len(nodes), w), np.inf)
            d[np.arange(len(nodes)), rank[nodes]] = 0.0
            while True:
                new = np.minimum.reduceat(d[come] + step, cut, axis=0)
                if not (new < d).any():
                    break
                d = np.fmin(d, new)
            d[np.arange(w) >= rank[nodes][:, None]] = -1.0  # pairs once, the lesser node as the source
            first = np.flatnonzero(np.append(True, np.diff(comp[nodes]) != 0))
            top = np.maximum.reduceat(d.max(1), first)
            many = np.diff(np.append(first, len(nodes)))
            n, s = np.nonzero(d == np.repeat(top, many)[:, None])
            which = np.repeat(np.arange(len(first)), many)[n]
            by = np.lexsort((n, s, which))
            by = by[np.append(True, np.diff(which[by]) != 0)]
            found.append((nodes[first], nodes[first[which[by]] + s[by]], nodes[n[by]], top))
    left = np.flatnonzero(size[comp[u]] > most)
    root, src, dst, far = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, float if k == 3 else np.int64) for k in range(4))
    root, src, dst = np.append(root, comp[u[left]]), np.append(src, u[left]), np.append(dst, v[left])
    made = {"root": values[root], "src": values[src], "dst": values[dst], "length": np.append(far, length[left])}
    return keys[root], made | {"left": np.arange(len(root)) >= len(root) - len(left)}


def overlapping_circles(g: np.ndarray, c: dict[str, np.ndarray], candidates: int = 1 << 20):
    """Pairs a < b of circles (id, y, x, r) that overlap, about so many candidates at a time; circles come by y.

    The wider one of a pair finds the other one, since its centre lies within the wider one's diameter on each axis.
    """
    ids, y, x, r = c["id"], c["y"], c["x"], c["r"]
    n, reach = len(g), 2 * np.maximum(r, 0) * (1 + 1e-9)

    def before(v: np.ndarray, right: int) -> np.ndarray:
        """How many circles come before each circle's own key and place v."""
        order = np.lexsort((np.repeat([0, 2 * right - 1], n), np.append(y, v), np.append(g, g)))
        own = order < n
        out = np.empty(n, np.int64)
        out[order[~own] - n] = np.cumsum(own)[~own]
        return out

    first, end = before(y - reach, 0), before(y + reach, 1)
    slab = np.cumsum(end - first) // candidates
    for part in np.split(np.arange(n), np.flatnonzero(np.diff(slab)) + 1):
        i, j = spread(first[part], end[part])
        i = part[i]
        ok = (r[j] < r[i]) | ((r[j] == r[i]) & (j < i))
        i, j = i[ok], j[ok]
        ok = (np.hypot(y[i] - y[j], x[i] - x[j]) < r[i] + r[j]) & (ids[i] != ids[j])
        i, j = i[ok], j[ok]
        less = ids[i] < ids[j]
        yield g[i], {"a": ids[np.where(less, i, j)], "b": ids[np.where(less, j, i)]}


def chosen_circles(g: np.ndarray, c: dict[str, np.ndarray]) -> tuple[np.ndarray, dict]:
    """What a greedy choice takes of circles (id, y, x, r), which come by falling radius."""
    y, x, r = (c[k].astype(float) for k in ("y", "x", "r"))
    taken = np.ones(len(g), bool)
    starts = np.flatnonzero(np.append(True, np.diff(g) != 0))
    for a, b in zip(starts, np.append(starts[1:], len(g)), strict=True):
        free, cy, cx, cr = taken[a:b], y[a:b], x[a:b], r[a:b]
        for k in range(b - a):
            if free[k]:
                free[k + 1 :] &= ~(np.hypot(cy[k + 1 :] - cy[k], cx[k + 1 :] - cx[k]) < cr[k + 1 :] + cr[k])
    return g[taken], {k: v[taken] for k, v in c.items()}


def lower_envelopes(g: np.ndarray, c: dict[str, np.ndarray], width: int) -> tuple[np.ndarray, dict]:
    """Stretches _a to _b of 0 … width - 1 on which the parabola f + (x - at)^2 of a place at is the lowest one, for rows of places (x, f) in order.

    All rows of the chunk take their next place at a time; a row's stack stands where its places did.
    """
    x, f = c["x"].astype(float), c["f"].astype(float)
    start = np.flatnonzero(np.append(True, np.diff(g) != 0))
    size = np.diff(np.append(start, len(g)))
    by_size = np.argsort(-size, kind="stable")
    start, size = start[by_size], size[by_size]
    sx, sf, sz, top = np.empty(len(x)), np.empty(len(x)), np.empty(len(x)), np.zeros(len(start), np.int64)
    many = np.searchsorted(-size, -np.arange(size[0]), "left")  # rows with more than so many places

    def meet(qx, qf, at):
        return ((qf + qx * qx) - (sf[at] + sx[at] * sx[at])) / (2 * (qx - sx[at]))

    for k in range(size[0]):
        n = many[k]
        qx, qf, here = x[start[:n] + k], f[start[:n] + k], start[:n]
        z = np.full(n, -np.inf)
        i = np.arange(n) if k else np.arange(0)
        while len(i):
            at = here[i] + top[i] - 1
            m = meet(qx[i], qf[i], at)
            z[i] = m
            i = i[sz[at] >= m]
            top[i] -= 1
        at = here + top[:n]
        sx[at], sf[at], sz[at] = qx, qf, z
        top[:n] += 1
    row, at = spread(start, start + top)
    after = np.full(len(at), np.inf)
    same = row[1:] == row[:-1]
    after[:-1][same] = sz[at[1:]][same]
    a = np.ceil(np.maximum(sz[at], 0.0))
    b = np.where(np.isinf(after), width - 1, np.ceil(np.clip(after, 0.0, width)) - 1)
    kept = np.flatnonzero(a <= b)
    kept = kept[np.argsort(g[at[kept]], kind="stable")]
    return g[at[kept]], {"at": sx[at[kept]], "f": sf[at[kept]], "_a": a[kept].astype(np.int64), "_b": b[kept].astype(np.int64)}


def _squared_distances(g: np.ndarray, y: np.ndarray, x: np.ndarray, many: int, height: int, width: int) -> np.ndarray:
    """Squared distance of each place of rasters 0 … many - 1, (many, height, width), to the nearest of their pixels; each has one."""
    order = np.lexsort((y, x, g))
    g, y, x = g[order], y[order], x[order]
    beside = (np.diff(g) == 0) & (np.diff(x) == 0)
    half = (y[:-1] + y[1:]) // 2
    since, until = np.zeros(len(g), np.int64), np.full(len(g), height)
    since[1:][beside], until[:-1][beside] = half[beside] + 1, half[beside] + 1
    i, row = spread(np.clip(since, 0, height), np.clip(until, 0, height))  # a column's places go to its pixels
    line = g[i] * height + row
    by = np.argsort(line, kind="stable")
    line, i = line[by], i[by]
    gap = (row[by] - y[i]).astype(float)
    _, c = lower_envelopes(line, {"x": x[i], "f": gap * gap}, width)
    j, at = spread(c["_a"], c["_b"] + 1)
    step = at - c["at"][j]
    return (step * step + c["f"][j]).reshape(many, height, width)


def _greatest_within(v: np.ndarray, apart: int, axis: int) -> np.ndarray:
    """The largest value within so many places on an axis."""
    v, out = np.moveaxis(v, axis, 0), np.moveaxis(v.copy(), axis, 0)
    for k in range(1, min(apart, len(v) - 1) + 1):
        np.maximum(out[k:], v[:-k], out=out[k:])
        np.maximum(out[:-k], v[k:], out=out[:-k])
    return np.moveaxis(out, 0, axis)


def gap_circles(height: int, width: int, least: float, apart: int, rounds: int | None, places: int = 1 << 19):
    """Circles (y, x, r, round) in the gaps between pixels (y, x), as pixels.gap_circles() says; about so many places of rasters at a time."""
    together = max(1, places // (height * width))

    def fn(g, c):
        y, x = c["y"].astype(np.int64), c["x"].astype(np.int64)
        for first in range(0, int(g[-1]) + 1, together):
            a, b = np.searchsorted(g, [first, first + together])
            mg, my, mx, k = g[a:b], y[a:b], x[a:b], 0
            while len(mg) and (rounds is None or k < rounds):
                k += 1
                open_, at = np.unique(mg, return_inverse=True)
                d = _squared_distances(at, my, mx, len(open_), height, width)
                i, py, px = np.nonzero((d == _greatest_within(_greatest_within(d, apart, 2), apart, 1)) & (d > least * least))
                r = np.sqrt(d[i, py, px])
                by = np.lexsort((px, py, -r, i))
                i, taken = chosen_circles(i[by], {"y": py[by], "x": px[by], "r": r[by]})
                tg, ty, tx, r = open_[i], taken["y"], taken["x"], taken["r"]
                yield tg, {"y": ty.astype(float), "x": tx.astype(float), "r": r, "round": np.full(len(tg), k, np.int32)}
                whole = np.floor(r).astype(np.int64)
                n, dy = spread(-whole, whole + 1)
                wide = np.floor(np.sqrt(whole[n] * whole[n] - dy * dy)).astype(np.int64)
                m, dx = spread(tx[n] - wide, tx[n] + wide + 1)
                dg, dy = tg[n[m]], (ty[n] + dy)[m]
                ok = (dy >= 0) & (dy < height) & (dx >= 0) & (dx < width)
                old = np.isin(mg, tg)
                mg, my, mx = np.append(mg[old], dg[ok]), np.append(my[old], dy[ok]), np.append(mx[old], dx[ok])

    return fn


def nearest(g: np.ndarray, c: dict[str, np.ndarray]) -> tuple[np.ndarray, dict]:
    """For each point (_t 0) the id of the nearest target (_t 1) of its key, of equal ones the first, and the distance; NaN where there is none."""
    y, x, ask = c["y"].astype(float), c["x"].astype(float), c["_t"] == 0
    near, far = np.zeros(len(g), c["id"].dtype), np.full(len(g), np.nan)
    starts = np.flatnonzero(np.append(True, np.diff(g) != 0))
    for a, b in zip(starts, np.append(starts[1:], len(g)), strict=True):
        m = a + int(ask[a:b].sum())
        t = np.arange(m, b)[~np.isnan(y[m:b] + x[m:b])]
        if not len(t) or m == a:
            continue
        d = np.square(y[t] - y[a:m, None]) + np.square(x[t] - x[a:m, None])
        best = d.argmin(axis=1)
        near[a:m], far[a:m] = c["id"][t[best]], np.sqrt(d[np.arange(m - a), best])
    return g[ask], {"id": c["id"][ask], "_near": near[ask], "distance": far[ask]}
