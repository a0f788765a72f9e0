"""Image files as tables: a binary scan, decoders for PNG and TIFF in Python, resolution tags, masks of paths."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import base_name, sanitized

#: File names taken for images, case by case since globs tell cases apart.
PATTERN = "*.{png,PNG,tif,TIF,tiff,TIFF,jpg,JPG,jpeg,JPEG}"
SCHEMA = "image_id string, origin string, height int, width int, n_channels int, bit_depth int, res_um double, data binary, problem string"


def files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", PATTERN).load(folder)


class Unsupported(ValueError):
    pass


def unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Bytes (h, n) of PNG lines (h, 1 + n), whose first byte says how the others were guessed from those beside and above.

    A byte hangs on its left, upper and upper left ones alone, so whole anti-diagonals of pixels are worked out at once.
    """
    h, n = lines.shape[0], lines.shape[1] - 1
    kinds, given = lines[:, 0], lines[:, 1:]
    if not kinds.any():
        return given.copy()
    w = n // step
    out = np.zeros((h + 1, w + 1, step), np.int16)  # a border of zeros above and to the left
    given = given.reshape(h, w, step).astype(np.int16)
    for d in range(h + w - 1):
        ys = np.arange(max(0, d - w + 1), min(h, d + 1))
        xs = d - ys
        left, up, corner = out[ys + 1, xs], out[ys, xs + 1], out[ys, xs]
        p = left + up - corner
        to_left, to_up, to_corner = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
        paeth = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        kind = kinds[ys][:, None]
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) // 2, paeth], 0)
        out[ys + 1, xs + 1] = (given[ys, xs] + guess) & 255
    return out[1:, 1:].reshape(h, n).astype(np.uint8)


#: First row, first column, row step and column step of the passes of an interlaced PNG.
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def decode_png(raw: bytes) -> tuple[np.ndarray, int, float]:
    """Pixels (h, w, channels), bit depth (8 for less) and micrometres a pixel (1.0 if not said)."""
    at, data, palette, res = 8, [], None, 1.0
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"pHYs":
            per, _, unit = struct.unpack(">IIB", body)
            res = round(1e6 / per, 2) if unit == 1 and per else 1.0
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    whole = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    step = max(1, channels * depth // 8)
    pixels = np.zeros((h, w, channels), np.uint16 if depth == 16 else np.uint8)
    start = 0
    for y0, x0, dy, dx in PASSES if interlace else ((0, 0, 1, 1),):
        rows, columns = -(-(h - y0) // dy), -(-(w - x0) // dx)
        if rows <= 0 or columns <= 0:
            continue
        size = 1 + -(-columns * channels * depth // 8)
        lines = unfiltered(whole[start : start + rows * size].reshape(rows, size), step)
        start += rows * size
        if depth == 16:
            part = lines.view(">u2")
        elif depth == 8:
            part = lines
        else:  # several pixels a byte, the first in its highest bits
            bits = np.unpackbits(lines, axis=1)[:, : columns * depth].reshape(rows, columns, depth)
            part = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
            part = part if colour == 3 else part * np.uint8(255 // ((1 << depth) - 1))
        pixels[y0::dy, x0::dx] = part.reshape(rows, columns, channels)
    return (palette[pixels[:, :, 0]] if colour == 3 else pixels), max(depth, 8), res


def _unrun(data: bytes) -> bytes:
    """Runs (PackBits) written out."""
    out, at = [], 0
    while at < len(data):
        n = data[at]
        out.append(data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n) if n > 128 else b"")
        at += n + 2 if n < 128 else 2 if n > 128 else 1
    return b"".join(out)


def _unlzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, high bits first, that grow one code early; 256 clears the table, 257 ends."""
    table = [bytes([b]) for b in range(256)] + [b"", b""]
    out, last, bits, held, n = [], b"", 9, 0, 0
    for byte in data:
        held, n = held << 8 | byte, n + 8
        if n < bits:
            continue
        n -= bits
        code, held = held >> n, held & ((1 << n) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            last, bits = b"", 9
            continue
        if code > len(table) - (not last):
            raise Unsupported("LZW code out of order")
        entry = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + entry[:1])
            bits = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        out.append(entry)
        last = entry
    return b"".join(out)


#: How a block of a TIFF file is unpacked, by its compression number.
UNPACK = {1: bytes, 5: _unlzw, 8: zlib.decompress, 32773: _unrun, 32946: zlib.decompress}


def decode_tiff(raw: bytes) -> tuple[np.ndarray, int, float]:
    """As decode_png, for strips or tiles of 8 or 16 bits, in one plane or a plane a channel, plain or as differences along lines."""
    order = "<" if raw[:2] == b"II" else ">"
    at = struct.unpack(order + "I", raw[4:8])[0]
    tags = {}
    for k in range(struct.unpack(order + "H", raw[at : at + 2])[0]):
        tag, kind, n, value = struct.unpack(order + "HHI4s", raw[at + 2 + 12 * k : at + 14 + 12 * k])
        size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}.get(kind, 0)
        if not size:
            continue
        where = value if n * size <= 4 else raw[(o := struct.unpack(order + "I", value)[0]) : o + n * size]
        code = {1: "B", 2: "B", 3: "H", 4: "I", 5: "II"}[kind]
        tags[tag] = struct.unpack(order + code * n, where[: n * size])
    h, w, depth = tags[257][0], tags[256][0], tags.get(258, (1,))[0]
    channels, packed = tags.get(277, (1,))[0], tags.get(259, (1,))[0]
    planar, guess, palette = tags.get(284, (1,))[0], tags.get(317, (1,))[0], tags.get(320)
    if depth not in (8, 16) or packed not in UNPACK or planar not in (1, 2) or guess not in (1, 2):
        raise Unsupported(f"TIFF of {depth} bits, compression {packed}")
    tiled = 322 in tags
    bh, bw = (tags[323][0], tags[322][0]) if tiled else (min(tags.get(278, (h,))[0], h), w)
    planes, inside = (channels, 1) if planar == 2 else (1, channels)
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    if not bh or not bw or len(offsets) != planes * -(-h // bh) * -(-w // bw):
        raise Unsupported("TIFF whose blocks don't cover it")
    corners = [(p, y, x) for p in range(planes) for y in range(0, h, bh) for x in range(0, w, bw)]
    stored = np.dtype(np.uint8 if depth == 8 else order + "u2")
    kind = stored.newbyteorder("=")
    blocks = []
    for (_, y, _), o, n in zip(corners, offsets, sizes, strict=True):
        rows = bh if tiled else min(bh, h - y)
        block = np.frombuffer(UNPACK[packed](raw[o : o + n]), stored, rows * bw * inside).reshape(rows, bw, inside)
        blocks.append(np.cumsum(block, axis=1, dtype=kind) if guess == 2 else block)
    pixels = np.empty((h, w, channels), kind)
    for (p, y, x), block in zip(corners, blocks, strict=True):
        pixels[y : y + bh, x : x + bw, p : p + inside] = block[: h - y, : w - x]
    if tags.get(262, (1,))[0] == 3 and palette and depth == 8:
        pixels = (np.array(palette, np.uint16).reshape(3, -1).T >> 8).astype(np.uint8)[pixels[:, :, 0]]
    x = tags.get(282)
    res = round(x[1] / x[0], 2) if x and x[0] else 1.0
    return pixels, depth, res


def to_8bit(pixels: np.ndarray) -> np.ndarray:
    """Values between the 2nd and 98th percentile as 0 to 255."""
    low, high = np.percentile(pixels, (2, 98))
    if high == low:
        return np.zeros(pixels.shape, np.uint8)
    return ((np.clip(pixels, low, high) - low) / (high - low) * 255).astype(np.uint8)


def decoded(found: DataFrame) -> DataFrame:
    """SCHEMA's columns for files (path, content); what can't be decoded has a problem and no data. 16-bit becomes 8-bit."""
    named = found.select("path", "content", sanitized(base_name(F.col("path"))).alias("image_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content, name in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                row = {"image_id": name, "origin": path}
                try:
                    if content[:4] == b"\x89PNG":
                        pixels, depth, res = decode_png(content)
                    elif content[:4] in (b"II*\0", b"MM\0*"):
                        pixels, depth, res = decode_tiff(content)
                    else:
                        raise Unsupported("neither PNG nor TIFF")
                    pixels = to_8bit(pixels) if depth == 16 else pixels
                    h, w, c = pixels.shape
                    row |= {"height": h, "width": w, "n_channels": c, "bit_depth": depth, "res_um": res, "data": pixels.tobytes()}
                except (Unsupported, KeyError, zlib.error, struct.error, ValueError) as e:
                    row["problem"] = str(e)
                rows.append(row)
            yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))
    return named.mapInArrow(run, SCHEMA)


def jpegs(spark: SparkSession, folder: str) -> DataFrame:
    """SCHEMA's columns of a folder's JPEG files, by Spark's own image source; their resolution isn't read and counts as 1.0."""
    found = spark.read.format("image").option("pathGlobFilter", "*.{jpg,JPG,jpeg,JPEG}").option("dropInvalid", False).load(folder).select("image.*")
    found = found.withColumn("origin", F.url_decode(F.regexp_replace("origin", r"\+", "%2B")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for h, w, c, raw in zip(*[batch.column(k).to_pylist() for k in range(1, 4)], batch.column(4), strict=True):
                if h < 0:
                    data.append(None)
                    continue
                pixels = np.frombuffer(raw.as_buffer(), np.uint8).reshape(h, w, c)
                data.append((pixels[:, :, 2::-1] if c >= 3 else pixels).tobytes())  # blue comes first
            yield pa.record_batch([*batch.columns[:4], pa.array(data, pa.binary())], names=["origin", "height", "width", "nChannels", "data"])

    rgb = found.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, "origin string, height int, width int, nChannels int, data binary")
    bad = F.col("data").isNull()
    size = [F.when(~bad, F.col(c)).alias(c) for c in ("height", "width")]
    return rgb.select(sanitized(base_name(F.col("origin"))).alias("image_id"), "origin", *size, F.when(~bad, F.least("nChannels", F.lit(3))).alias("n_channels"), F.when(~bad, F.lit(8)).alias("bit_depth"), F.when(~bad, F.lit(1.0)).alias("res_um"), "data", F.when(bad, F.lit("not a JPEG that can be read")).alias("problem"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """All images of a folder, decoded: PNG and TIFF here, JPEG by Spark."""
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,PNG,tif,TIF,tiff,TIFF}").load(folder)
    return decoded(plain).unionByName(jpegs(spark, folder))


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of 8- or 16-bit pixels (h, w) or (h, w, 3): for exports and fixtures."""
    p = pixels[:, :, None] if pixels.ndim == 2 else pixels
    h, w, c = p.shape
    depth = 16 if p.dtype == np.uint16 else 8
    body = np.ascontiguousarray(p.astype(">u2" if depth == 16 else np.uint8)).tobytes()
    step = w * c * depth // 8
    lines = b"".join(b"\0" + body[y * step : (y + 1) * step] for y in range(h))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, depth, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
