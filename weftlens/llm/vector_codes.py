"""Vector codes: product quantisation in whole numbers by RDD.treeAggregate over columnar NumPy blocks of parts.

Vectors are written once as blocks of a few thousand, one component after the other. A round assigns each part of each block to
its codebook's nearest entry, with distances that accumulate component by component, adds sums and counts in place with
np.add.at, and merges the tensors of the tasks through a reduction tree. Sums, counts and distances are whole numbers, so the
codebooks don't hang on partitions or order. Only tensors of entries x components, fixed by the parameters, reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, map_arrow
from .whitening import common_size, embeddings, finite, matrix

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block, and those whose distances are held at once.
BLOCK, CHUNK = 4096, 1024
#: Components from here on count as non-finite: their multiple is beyond a double.
MOST = 1e300


def whole(values: np.ndarray) -> np.ndarray:
    """Floats that are whole numbers as int64, or as Python's where their squares would not fit."""
    if float(np.abs(values).max(initial=0)) < 1 << 26:
        return values.astype(np.int64)
    return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)


def blocks_of(rows: DataFrame, d: int, label: str) -> DataFrame:
    """ids, labels and data of each block: floor(SCALE * component) for all vectors, component after component.

    Multiples of powers of two and their floors keep the components' own precision, so the data has it too.
    """
    kind = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"
    id_type, label_type = (to_arrow_type(rows.schema[c].dataType) for c in ("vec_id", "label"))
    schema = pa.schema([("ids", pa.list_(id_type)), ("labels", pa.list_(label_type)), ("data", pa.binary())])

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, labels = (pa.concat_arrays([p.column(c) for p in parts]) for c in (0, 1))
        v = np.vstack([matrix(p.column(2), d) for p in parts]).astype(kind)
        ends = pa.array([0, len(ids)], pa.int32())
        data = np.ascontiguousarray(np.floor(v * np.dtype(kind).type(SCALE)).T).tobytes()
        return pa.record_batch([pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, labels), pa.array([data], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK - sum(p.num_rows for p in held))
                held.append(part)
                at += part.num_rows
                if sum(p.num_rows for p in held) == BLOCK:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    return map_arrow(rows.select("vec_id", "label", "embedding"), run, f"ids array<long>, labels array<{label}>, data binary")


def nearest(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For parts x (components, vectors) the nearest row of codebook, of equal ones the first, and the squared distance."""
    if x.dtype != object and codebook.dtype != object:
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(codebook).max(initial=0)))
        kind = np.int32 if 4 * most * most * len(x) < 1 << 31 else np.int64
        x, codebook = x.astype(kind), codebook.astype(kind)
    far = np.zeros((len(codebook), x.shape[1]), np.result_type(x, codebook))
    for j in range(len(x)):
        apart = x[j][None, :] - codebook[:, j][:, None]
        far += apart * apart
    best = far.argmin(0)
    return best, far[best, np.arange(x.shape[1])]


def columns_of(data: bytes, d: int, kind: str, width: int) -> np.ndarray:
    """A block's numbers (PARTS * width, vectors); zeros stand for components that d lacks."""
    v = whole(np.frombuffer(data, kind).reshape(d, -1))
    short = PARTS * width - d
    return v if not short else np.vstack([v, np.zeros((short, v.shape[1]), v.dtype)])


def next_codebooks(blocks: DataFrame, books: list[np.ndarray], d: int, kind: str) -> list[np.ndarray]:
    """The codebooks after one round: floors of the means of what is nearest to each entry; unused entries stay."""
    width = books[0].shape[1]
    shape = (len(books), len(books[0]), width)

    def seen(state, row):
        x = columns_of(row[0], d, kind, width)
        sums, counts = state or (np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64))
        if x.dtype == object:
            sums = sums.astype(object)
        for at in range(0, x.shape[1], CHUNK):
            for p, book in enumerate(books):
                part = x[p * width : (p + 1) * width, at : at + CHUNK]
                best, _ = nearest(part, book)
                np.add.at(sums[p], best, part.T)
                np.add.at(counts[p], best, 1)
        return sums, counts

    def both(a, b):
        return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])

    data = blocks.select("data").rdd
    depth = max(2, math.ceil(math.log(max(data.getNumPartitions(), 2), 32)))
    sums, counts = data.treeAggregate(None, seen, both, depth)
    return [np.where(c[:, None] > 0, s // np.maximum(c, 1)[:, None], b) for s, c, b in zip(sums, counts, books, strict=True)]


def codebooks_hash(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for book in books for v in book.ravel()).encode()).hexdigest()


def vector_codes(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for each row of rows (vec_id, embedding, label).

    Rows whose vector is null, empty, or holds null, non-finite or larger components than MOST are dropped, as are those of another length
    than the commonest; a length that isn't a multiple of PARTS is filled up with zeros. With fewer vectors than ENTRIES there are as many
    entries. Rows of one vec_id come in the order of their vectors, null ids last; equal rows have equal results. Errors beyond a long, and sums
    over such, are null. Null labels are one group. Other columns are ignored; an empty table gives an empty one.
    """
    spark = rows.sparkSession
    label = rows.schema["label"].dataType.simpleString()
    able = finite(rows.select("vec_id", "label", "embedding"), MOST)
    d = common_size(able)
    if not d:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    able = able.where(F.size("embedding") == d)
    kind, width = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8", -(-d // PARTS)
    scratch = Scratch(spark, "codes")
    blocks = scratch.table(blocks_of(able, d, label), "blocks")
    start = able.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).select("embedding").collect()  # ENTRIES rows
    first = columns_of(np.ascontiguousarray(np.floor(np.array([r[0] for r in start], kind) * np.dtype(kind).type(SCALE)).T).tobytes(), d, kind, width)
    books = [first[p * width : (p + 1) * width].T.copy() for p in range(PARTS)]
    for _ in range(ROUNDS):
        books = next_codebooks(blocks, books, d, kind)
    schema = pa.schema([("vec_id", pa.int64()), ("label", to_arrow_type(rows.schema["label"].dataType)), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels = (batch.column(c).slice(k, 1).flatten() for c in (0, 1))
                x = columns_of(batch.column(2)[k].as_buffer(), d, kind, width)
                codes, errors = np.empty((x.shape[1], PARTS), np.uint8), np.zeros(x.shape[1], x.dtype)
                for at in range(0, x.shape[1], CHUNK):
                    for p, book in enumerate(books):
                        best, far = nearest(x[p * width : (p + 1) * width, at : at + CHUNK], book)
                        codes[at : at + CHUNK, p] = best
                        errors = errors.astype(np.result_type(errors, far), copy=False)
                        errors[at : at + CHUNK] += far
                shown = codes.tobytes().hex()
                error = pa.array([int(e) if e < 1 << 63 else None for e in errors], pa.int64()) if errors.dtype == object else pa.array(errors.astype(np.int64))
                yield pa.record_batch([ids, labels, pa.array([shown[i : i + 2 * PARTS] for i in range(0, len(shown), 2 * PARTS)], pa.string()), error], schema=schema)

    found = scratch.table(map_arrow(blocks, run, f"vec_id long, label {label}, code string, error long"), "found")
    scratch.drop("blocks")
    sums = scratch.table(found.groupBy("label").agg(F.when(F.bool_and(F.col("error").isNotNull()), F.try_sum("error")).alias("label_error")), "sums").withColumnRenamed("label", "_label")
    out = found.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_hash(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(embeddings(spark, sf_dir))


_FAR = " + ".join(f"(x.v[{j}] - c.v[{j}]) * (x.v[{j}] - c.v[{j}])" for j in range(1, 5))


def _assigned(k: int) -> str:
    return f"a{k} AS (SELECT x.r, x.p, arg_min(c.e, row({_FAR}, c.e)) AS e, min({_FAR}) AS far, any_value(x.v) AS v FROM x JOIN c{k} c USING (p) GROUP BY x.r, x.p)"


def _moved(k: int) -> str:
    means = ", ".join(f"floor(sum(v[{j}]) / count(*))::BIGINT" for j in range(1, 5))
    return f"c{k + 1} AS (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT p, e, [{means}] AS v FROM a{k} GROUP BY p, e) m ON m.p = c.p AND m.e = c.e)"


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLE = {
    "op13_vector_codes": f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS (SELECT r, p, q[4 * p + 1 : 4 * p + 4] AS v FROM (SELECT r, q, unnest(range(16)) AS p FROM k)),
c0 AS (SELECT p, r - 1 AS e, v FROM x WHERE r <= 64),
{_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)},
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM c2),
f AS (SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a2 GROUP BY r)
SELECT k.vec_id, f.code, f.error, (sum(f.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, h.h AS codebooks_sha256 FROM f JOIN k USING (r), h
"""
}
