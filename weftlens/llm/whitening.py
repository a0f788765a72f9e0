"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Entries become integers, so counts, sums and squared deviations are exact. Each partition of the distinct vectors keeps its
number, its sums and all singular values and right vectors of its centred rows. Two such states merge by stacking their
scaled vectors and one row that corrects for the difference of their means, and decomposing again: nothing is cut off. States
merge in a tree, a few to a task and in the order of their partitions, so the driver sees one state of d x d numbers.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: States that one task merges.
FAN = 16
#: Components whose singular value is below this share of the largest have no direction to speak of and are left out.
LEAST_SHARE = 1e-9
#: Larger components, as integers, would not fit into a long.
MOST = 1e15


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def finite(rows: DataFrame, most: float = MOST) -> DataFrame:
    """Rows whose vector is not null and has no null, non-finite or larger component."""
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < most)))


def common_size(rows: DataFrame) -> int:
    """The commonest length of a vector, of equally common ones the least; 0 without rows."""
    found = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "d").first()
    return found["d"] if found else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a list column without nulls, all of d numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns of whole numbers, as Python's, which never overflow."""
    most = int(np.abs(x).max(initial=0))
    return [int(v) for v in (x if most * (len(x) + 1) < 1 << 62 else x.astype(object)).sum(0)]


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: as int64 where that holds it, else as Python's numbers."""
    most = max(int(np.abs(x).max(initial=0)) * n, *map(abs, sums))
    if most < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


#: Rows seen, their sums, and the singular values and right vectors of the centred rows (d of them at most).
State = tuple[int, list[int], np.ndarray, np.ndarray]
#: Number, mean and centred second moments of whitened rows.
Spread = tuple[int, np.ndarray, np.ndarray]


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s, v


def state_of(x: np.ndarray) -> State:
    n, sums = len(x), exact_sums(x)
    return n, sums, *_decomposed(numerators(x, n, sums).astype(float) / n)


def merged(a: State, b: State) -> State:
    """The state of both lists of rows; the mean correction is exact until it is made a float."""
    (n_a, sums_a, values_a, vectors_a), (n_b, sums_b, values_b, vectors_b) = a, b
    n = n_a + n_b
    apart = np.array([p * n_b - q * n_a for p, q in zip(sums_a, sums_b, strict=True)], object)  # n_a n_b (mean a - mean b)
    row = apart.astype(float) / np.sqrt(float(n_a) * float(n_b) * float(n))
    stacked = np.vstack([values_a[:, None] * vectors_a, values_b[:, None] * vectors_b, row[None, :]])
    return n, [p + q for p, q in zip(sums_a, sums_b, strict=True)], *_decomposed(stacked)


def spread_of(w: np.ndarray) -> Spread:
    mean = w.mean(0)
    return len(w), mean, (w - mean).T @ (w - mean)


def spread_merged(a: Spread, b: Spread) -> Spread:
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def tree(rows: DataFrame, d: int, of: Callable[[np.ndarray], object], join: Callable[[object, object], object], scratch: Scratch, name: str):
    """One state of all rows (x): each partition's, then FAN of them in a task until one is left; None without rows."""
    schema = pa.schema([("part", pa.int64()), ("state", pa.binary())])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                new = of(matrix(batch.column(0), d))
                state = new if state is None else join(state, new)
        if state is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], schema=schema)

    def further(key, frame):
        import pandas as pd

        frame = frame.sort_values("part")
        state = None
        for raw in frame["state"]:
            new = pickle.loads(raw)
            state = new if state is None else join(state, new)
        return pd.DataFrame({"part": [key[0]], "state": [pickle.dumps(state)]})

    now, level = scratch.table(map_arrow(rows.select("x"), first, "part long, state binary"), f"{name}-0"), 0
    while (top := now.agg(F.max("part")).first()[0]) is not None and top > 0:
        level += 1
        now = scratch.table(now.groupBy(F.floor(F.col("part") / FAN).alias("up")).applyInPandas(further, "part long, state binary"), f"{name}-{level}")
    found = now.first()
    return pickle.loads(found["state"]) if found else None


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each row of rows (vec_id, embedding).

    Rows whose vector is null, empty, or holds null, non-finite or larger components than MOST are dropped, as are those of another length than
    the commonest. Equal vectors are one in the fit and each have their rows in the result, null vec_ids too. Components are those of a
    singular value of at least LEAST_SHARE of the largest: equal vectors alone have none, so no rows. Of equal eigenvalues any directions
    that fit come. A deviation beyond a long is null. Other columns are ignored; an empty table gives an empty one.
    """
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = rows.sparkSession
    scratch = Scratch(spark, "whitening")
    able = finite(rows.select("vec_id", "embedding"))
    d = common_size(able)
    x = able.where(F.size("embedding") == d).select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE) + SHIFT).alias("x"))
    fit = scratch.table(x.select("x").distinct(), "fit")
    state = tree(fit, d, state_of, merged, scratch, "states")
    if state is None:
        return spark.createDataFrame([], out)
    n, sums, values, vectors = state
    kept = np.flatnonzero(values[:components] >= LEAST_SHARE * max(float(values[0]), 1e-300))
    value = values[kept] ** 2 / n
    explained = value / float((values**2).sum() / n) if len(kept) else value
    axes = vectors[kept].T / np.sqrt(value)

    def projected(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        above = numerators(x, n, sums)
        return above, (above.astype(float) / n) @ axes

    error = 0.0
    if len(kept):
        spread = tree(fit, d, lambda v: spread_of(projected(v)[1]), spread_merged, scratch, "spreads")
        error = float(np.abs(spread[2] / n - np.eye(len(kept))).max())
    scratch.drop("fit")
    numbers, k = (kept + 1).astype(np.int32), len(kept)

    def deviations(above: np.ndarray) -> pa.Array:
        if above.dtype != object and int(np.abs(above).max(initial=0)) ** 2 * d < 1 << 63:
            return pa.array((above * above).sum(1))
        exact = (above.astype(object) ** 2).sum(1)
        return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, 2048):
                part = batch.slice(at, 2048)
                m = part.num_rows
                above, w = projected(matrix(part.column(1), d))
                row = pa.array(np.repeat(np.arange(m), k))
                constant = [np.full(m * k, n), np.tile(explained, m), np.full(m * k, error)]
                columns = [part.column(0).take(row), np.tile(numbers, m), constant[0], deviations(above).take(row), w.ravel(), constant[1], constant[2]]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(x, run, out)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(embeddings(spark, sf_dir))


QUERIES = {"op12_whitening": op12_whitening}
ORACLE: dict[str, str] = {}
