"""Shared pieces of the training-data operators: scratch tables, Arrow batches, byte-level word splitting and hashing."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch as Scratch

#: Bytes of an Arrow batch that Spark hands to Python; it bounds a worker's memory together with CHUNK.
BATCH_BYTES = 8 << 20
#: Bytes of text that a numpy kernel works on at once; one longer document is a chunk of its own.
CHUNK = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, not only in rows.

    Spark reads the bound when it runs the plan, so it is set on the session, but only where the caller has set none.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system: Spark keeps Python workers from task to task, and the C library keeps what it freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def crc32_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as -1 and so are in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(-1))


def slices(text: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes of text (a single longer row is alone)."""
    if not len(text):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(text):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield at, to
        at = to


def utf8(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and the row offsets (int64, from 0); nulls are empty."""
    if text.null_count:
        text = pc.fill_null(text, b"" if pa.types.is_binary(text.type) or pa.types.is_large_binary(text.type) else "")
    big = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, np.int64 if big else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 … base ** (n - 1) modulo 2 ** 64, kept from call to call."""
    key = str(int(base))
    have = _powers.get(key)
    if have is None or len(have) < n:
        out = np.empty(max(n, 1 << 16), np.uint64)
        out[0], k = 1, 1
        while k < len(out):
            step = np.uint64(pow(int(base), k, 1 << 64))
            out[k : 2 * k] = out[: len(out[k : 2 * k])] * step
            k *= 2
        have = out
        if n <= 4 * CHUNK:
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Spans:
    """Hashes of byte ranges of one buffer from prefix sums of a polynomial modulo 2 ** 64, for ranges that overlap.

    Long ranges can be made up that collide here; words and lines go by word_hashes().
    """

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * powers(_BASE, n), out=self.sums[1:])
        self.back = powers(_INVERSE, n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


#: Bytes of a word that are hashed block by block; longer ones have a digest each.
BLOCKWISE = 256


def _blocks(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the last byte."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), np.dtype("<u8"), padded, strides=(1,))


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range. Every block of eight bytes passes the finaliser, so no sum of powers can cancel."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    blocks = _blocks(raw)
    now = np.flatnonzero(size <= BLOCKWISE)
    now = now[size[now] > 0]
    k = 0
    while len(now):
        left = size[now] - 8 * k
        part = blocks[starts[now] + 8 * k] & _MASKS[np.minimum(left, 8)]
        out[now] = mix((out[now] ^ part) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 1))
        now = now[left > 8]
        k += 1
    for i in np.flatnonzero(size > BLOCKWISE).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def distinct_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct byte range, and which of them each range is. Hashes group; bytes decide."""
    _, first, which = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    size, like = ends - starts, first[which]
    same = size == size[like]
    blocks = _blocks(raw)
    now = np.flatnonzero(same & (size > 0) & (size <= BLOCKWISE))
    k = 0
    while len(now):
        left = size[now] - 8 * k
        mask = _MASKS[np.minimum(left, 8)]
        same[now] &= (blocks[starts[now] + 8 * k] & mask) == (blocks[starts[like[now]] + 8 * k] & mask)
        now = now[left > 8]
        k += 1
    for i in np.flatnonzero(same & (size > BLOCKWISE) & (like != np.arange(len(size)))).tolist():
        same[i] = np.array_equal(raw[starts[i] : ends[i]], raw[starts[like[i]] : ends[like[i]]])
    if same.all():
        return first, which
    seen: dict[bytes, int] = {}
    data = raw.tobytes()
    which = np.array([seen.setdefault(data[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    return np.unique(which, return_index=True)[1], which


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space bytes, never across rows, and how many precede each row (rows + 1)."""
    inside = ~SPACE[raw]
    n = len(raw)
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    cut = off[:-1][off[:-1] < n]
    first = inside.copy()
    np.logical_and(first, ~before[:n], out=first)
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    after = after[1:].copy()
    ends_at = off[1:][(off[1:] > 0)] - 1
    after[ends_at] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def batch_of(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
