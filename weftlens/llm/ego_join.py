"""Near-duplicate vectors by an epsilon grid order join.

Vectors are made unit length and projected on a few leading principal directions; a cosine of at least the threshold bounds the
distance by epsilon there too. Vectors are sorted by label and by the cells, epsilon wide, of their projections and cut into
blocks of consecutive ones. Consecutive blocks of a label make a tile; tiles whose bounding boxes are at most epsilon apart are
joined, so a block is sent once to each near tile, not once to each near block. There its intervals of the order are halved
again and again, pairs of halves that are provably farther apart are skipped, and short ones are compared. A pair of blocks
gives each vector's number of links and a spanning forest of the links, never the links. Equal vectors are one class from the
start, made by an aggregation that combines before the shuffle and named by its hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow
from .stars import components


@dataclass(frozen=True)
class GridParams:
    cosine: float = 0.93
    #: Leading principal directions of the grid and of the bounding boxes, and the vectors (by hash, about so many) that they are
    #: fitted on.
    directions: int = 4
    bounds: int = 12
    fit_vectors: int = 4096
    #: Vectors of a block, and of an interval that isn't halved any more.
    block: int = 1024
    least: int = 128
    #: Blocks of a tile.
    tile: int = 8

    @property
    def epsilon(self) -> float:
        return float(np.sqrt(2 - 2 * self.cosine) + 1e-9)


#: A class of equal vectors: its smallest vec_id, those without one last, and its hash.
NODE = "struct<none: boolean, id: long, a: long, b: long>"
NODE_TYPE = pa.struct([("none", pa.bool_()), ("id", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _vectors(column: pa.Array) -> list[np.ndarray]:
    """Each row's numbers, as they are stored."""
    return [v.values.to_numpy(zero_copy_only=False) for v in column]


def unit_rows(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal(vectors: DataFrame, params: GridParams) -> dict[int, np.ndarray]:
    """Leading directions (columns) of the unit vectors of each dimension, from a bounded sample of (rep, embedding)."""
    n = vectors.count()
    if n > params.fit_vectors:
        vectors = vectors.where(F.pmod(F.xxhash64("rep", F.lit("fit")), F.lit(1 << 30)) < int((1 << 30) * params.fit_vectors / n))
    by: dict[int, list[np.ndarray]] = {}
    for x in _vectors(vectors.select("embedding").toArrow()["embedding"].combine_chunks()) if n else []:
        by.setdefault(len(x), []).append(x)
    out = {}
    for size, some in by.items():
        m = unit_rows(np.stack(some))
        m = m - m.mean(0)
        out[size] = np.linalg.eigh(m.T @ m)[1][:, ::-1][:, : params.bounds].copy()
    return out


def halves(low: int, high: int) -> list[tuple[int, int]]:
    mid = (low + high) // 2
    return [(low, mid), (mid, high)]


def interval_join(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, same: bool, params: GridParams) -> np.ndarray:
    """Which vectors of a and b (unit rows, in grid order, with their projections) are linked; if same, not with themselves."""
    link = np.zeros((len(a), len(b)), bool)
    todo = [(0, len(a), 0, len(b))]
    eps2 = params.epsilon**2
    while todo:
        i, j, k, m = todo.pop()
        if i >= j or k >= m or same and m <= i:
            continue
        apart = np.maximum(0, np.maximum(pa_[i:j].min(0) - pb[k:m].max(0), pb[k:m].min(0) - pa_[i:j].max(0)))
        if (apart**2).sum() > eps2:
            continue
        if j - i <= params.least and m - k <= params.least:
            link[i:j, k:m] = a[i:j] @ b[k:m].T >= params.cosine
            continue
        left = halves(i, j) if j - i > params.least else [(i, j)]
        right = halves(k, m) if m - k > params.least else [(k, m)]
        todo += [(*x, *y) for x in left for y in right]
    if same:
        link |= link.T
        np.fill_diagonal(link, False)
    return link


def _forest(link: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Edges (row, column) that connect what the links connect."""
    rows, columns = link.shape
    edges = []
    seen_row, seen_column = np.zeros(rows, bool), np.zeros(columns, bool)
    for root in np.flatnonzero(link.any(1)):
        if seen_row[root]:
            continue
        todo = [int(root)]
        seen_row[root] = True
        if same:
            seen_column[root] = True
        while todo:
            u = todo.pop()
            for v in np.flatnonzero(link[u] & ~seen_column).tolist():
                seen_column[v] = True
                edges.append((u, v))
                if same:
                    seen_row[v] = True
                    todo.append(v)
                else:
                    new = np.flatnonzero(link[:, v] & ~seen_row)
                    seen_row[new] = True
                    edges += [(int(w), v) for w in new]
                    todo += new.tolist()
    return edges


def boxes_apart(a: str, b: str) -> Column:
    """Squared distance of two boxes (columns a_low, a_high, b_low, b_high)."""
    gaps = F.zip_with(F.arrays_zip(f"{a}_low", f"{a}_high"), F.arrays_zip(f"{b}_low", f"{b}_high"), lambda x, y: F.greatest(F.lit(0.0), x[f"{a}_low"] - y[f"{b}_high"], y[f"{b}_low"] - x[f"{a}_high"]))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)


def near_tiles(blocks: DataFrame, params: GridParams) -> DataFrame:
    """Pairs (i, j), i <= j, of tiles of one label whose boxes are at most epsilon apart, from rows (label, size, tile, low, high)."""
    eps = params.epsilon
    least, most = (F.array(*[pick(F.col(c)[k]) for k in range(params.bounds)]) for pick, c in ((F.min, "low"), (F.max, "high")))
    boxes = blocks.groupBy("label", "size", "tile").agg(least.alias("low"), most.alias("high"))
    boxes = boxes.withColumns({"c0": F.floor(F.col("low")[0] / eps), "c1": F.floor(F.col("high")[0] / eps)})
    left = boxes.select("label", "size", F.col("tile").alias("i"), F.col("low").alias("i_low"), F.col("high").alias("i_high"), (F.col("c0") - 1).alias("i0"), F.explode(F.sequence(F.col("c0") - 1, F.col("c1") + 1)).alias("cell"))
    right = boxes.select("label", "size", F.col("tile").alias("j"), F.col("low").alias("j_low"), F.col("high").alias("j_high"), F.col("c0").alias("j0"), F.explode(F.sequence("c0", "c1")).alias("cell"))
    met = left.join(right, ["label", "size", "cell"]).where((F.col("i") <= F.col("j")) & (F.col("cell") == F.greatest("i0", "j0")))
    return met.where(boxes_apart("i", "j") <= eps * eps).select("i", "j")


def near_vectors(vectors: DataFrame, params: GridParams = GridParams()) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding, label).

    Vectors that are null, zero or hold a null or a non-finite number, and those with a null label, have no link and are
    their own component; vectors of different lengths are never linked. Rows that are equal, or share a vec_id, count each. A
    row without a vec_id takes part in links; the component is named by the smallest vec_id that there is, null if there is none,
    and the row is kept in the latter case only. Ties at the threshold are links. Other columns are ignored; an empty table
    gives an empty one.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "grid")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & (norm > 0), F.lit(False))
    keyed = vectors.select("vec_id", "label", "embedding").withColumn("_ok", usable).withColumn("_h", F.when(F.col("_ok"), F.struct(F.xxhash64("label", "embedding").alias("a"), F.xxhash64("embedding", F.lit("vector"), "label").alias("b"))))
    classes = keyed.where("_ok").groupBy("_h").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = scratch.table(classes.withColumn("rep", F.struct(F.col("id").isNull().alias("none"), F.col("id").cast("long").alias("id"), "_h.a", "_h.b")).drop("id"), "classes")
    directions = principal(classes.select("rep", "embedding"), params)
    k = params.directions

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for x in _vectors(batch.column(3)):
                at = project(unit_rows(x[None]), directions, k)[0, :k]
                cells.append([len(x), *np.floor(at / params.epsilon).astype(int).tolist()])
            yield pa.record_batch([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=["rep", "m", "label", "embedding", "cells"])

    base = classes.select("rep", "m", "label", "embedding")
    placed = map_arrow(base, place, base.select("*", F.array(F.lit(0)).alias("cells")).schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, "label", "cells", "rep").sortWithinPartitions("label", "cells", "rep")
    block_schema = pa.schema([("label", arrow_type(classes, "label")), ("size", pa.int32()), ("tile", pa.int64()), ("block", pa.int64()), ("ids", pa.list_(NODE_TYPE)), ("m", pa.list_(pa.int64())), ("data", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
    number_type = arrow_type(classes, "embedding").value_type.to_pandas_dtype()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        # names of tiles and blocks are of this partition: its number and a running one
        part, tiles, blocks_, inside = TaskContext.get().partitionId() << 32, 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal blocks_, inside, tiles
            label, size = now
            if inside == params.tile:
                tiles, inside = tiles + 1, 0
            rows = np.stack([r[2] for r in held])
            at = project(unit_rows(rows), directions, params.bounds)
            values = [[label], [size], [part + tiles], [part + blocks_], [[r[0] for r in held]], [[r[1] for r in held]], [rows.astype(number_type).tobytes()], [at.min(0).tolist()], [at.max(0).tolist()]]
            held.clear()
            blocks_, inside = blocks_ + 1, inside + 1
            return pa.record_batch([pa.array(v, f.type) for v, f in zip(values, block_schema, strict=True)], schema=block_schema)

        for batch in batches:
            ids, times, labels = (batch.column(c).to_pylist() for c in range(3))
            for rep, m, label, x in zip(ids, times, labels, _vectors(batch.column(3)), strict=True):
                if held and ((label, len(x)) != now or len(held) == params.block):
                    yield close()
                if (label, len(x)) != now and inside:
                    tiles, inside = tiles + 1, 0
                now = (label, len(x))
                held.append((rep, m, x))
        if held:
            yield close()

    label_type = dict(vectors.dtypes)["label"]
    blocks = scratch.table(map_arrow(ordered, cut, f"label {label_type}, size int, tile long, block long, ids array<{NODE}>, m array<long>, data binary, low array<double>, high array<double>"), "blocks")
    near = scratch.table(near_tiles(blocks, params), "near")
    sides = near.select("i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("tile"))
    dealt = sides.join(blocks.select("tile", "block", "size", "ids", "m", "data"), "tile").select("i", "j", "tile", "block", "size", "ids", "m", "data")
    dealt = dealt.repartition(parts, "i", "j").sortWithinPartitions("i", "j", "tile", "block")
    schema = pa.schema([("u", NODE_TYPE), ("v", NODE_TYPE), ("links", pa.int64())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def pairs() -> Iterator[pa.RecordBatch]:
            i, j = now
            for a in held:
                for b in held:
                    if (i == j and a[1] <= b[1]) or (i != j and a[0] == i and b[0] == j):
                        yield links_between(a, b)
            held.clear()

        for batch in batches:
            for r in range(batch.num_rows):
                i, j, tile, block, size = (batch.column(c)[r].as_py() for c in range(5))
                if (i, j) != now:
                    if held:
                        yield from pairs()
                    now = (i, j)
                ids, m = batch.column(5)[r].values, batch.column(6)[r].values.to_numpy(zero_copy_only=False)
                x = unit_rows(np.frombuffer(batch.column(7)[r].as_buffer(), number_type).reshape(-1, size))
                held.append((tile, block, ids, m, x, project(x, directions, params.bounds)))
        if held:
            yield from pairs()

    def links_between(a: tuple, b: tuple) -> pa.RecordBatch:
        same = a[1] == b[1]
        link = interval_join(a[4], b[4], a[5], b[5], same, params)
        e = np.array(_forest(link, same), np.int64).reshape(-1, 2)
        own = [(a[2], link @ b[3])] if same else [(a[2], link @ b[3]), (b[2], link.T @ a[3])]
        counted = [(ids.take(pa.array(np.flatnonzero(n))), n[n > 0]) for ids, n in own]
        u = pa.concat_arrays([*[c[0] for c in counted], a[2].take(pa.array(e[:, 0]))])
        v = pa.concat_arrays([*[c[0] for c in counted], b[2].take(pa.array(e[:, 1]))])
        n = np.concatenate([*[c[1] for c in counted], np.zeros(len(e), np.int64)])
        return pa.record_batch([u, v, pa.array(n.astype(np.int64))], schema=schema)

    found = scratch.table(map_arrow(dealt, join, f"u {NODE}, v {NODE}, links long"), "found")
    roots = components(found.where("u <> v").select("u", "v"), scratch)
    links = found.where("links > 0").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("others"))
    named = classes.select("_h", "rep", "m").join(links, "rep", "left").join(roots.toDF("rep", "root"), "rep", "left")
    named = scratch.table(named.select("_h", (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "rep")["id"].alias("component"), F.lit(True).alias("_in")), "named")
    out = keyed.select("vec_id", "_h").join(named, "_h", "left")
    component = F.when(F.col("_in"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def project(unit: np.ndarray, directions: dict[int, np.ndarray], k: int) -> np.ndarray:
    """k projections of unit rows; a length that the sample lacked, or a missing direction, counts as 0 everywhere."""
    d = directions.get(unit.shape[1])
    at = unit @ d[:, :k] if d is not None else np.zeros((len(unit), 0))
    return np.pad(at, ((0, 0), (0, k - at.shape[1])))


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def op10_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op10_grid_order_join": op10_grid_order_join}
ORACLE: dict[str, str] = {
    "op10_grid_order_join": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE list_dot_product(e, e) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) >= 0.93),
r(n, c) AS (SELECT vec_id, vec_id FROM u UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.n WHERE r.c < p.b)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id) AS n_links, coalesce((SELECT min(c) FROM r WHERE r.n = e.vec_id), e.vec_id) AS component_id,
  coalesce((SELECT min(c) FROM r WHERE r.n = e.vec_id), e.vec_id) = e.vec_id AS kept FROM embeddings e
"""
}
