"""Decoding, parameters, resumable runs, sinks and table operators on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlens.functions import scalar
from weftlens.operators import raster as R, tabular as T
from weftlens.sources import images as I, params, sinks
from weftlens.streaming import incremental


def test_png_round_trip():
    rng = np.random.default_rng(0)
    for shape, kind in (((7, 5), np.uint8), ((4, 6, 3), np.uint8), ((5, 5), np.uint16)):
        p = rng.integers(0, np.iinfo(kind).max, shape).astype(kind)
        pixels, depth, res = I.decode_png(I.encode_png(p))
        assert (pixels.reshape(shape) == p).all() and depth == np.dtype(kind).itemsize * 8 and res == 1.0


def tiff(p):
    import struct

    h, w = p.shape
    data = p.astype("<u2").tobytes()
    tags = [(256, 3, 1, w), (257, 3, 1, h), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (279, 4, 1, len(data)), (282, 5, 1, 8 + len(data))]
    body = b"".join(struct.pack("<HHII", *t) for t in tags)
    return b"II*\0" + struct.pack("<I", 16 + len(data)) + data + struct.pack("<II", 4, 1) + struct.pack("<H", len(tags)) + body + b"\0" * 4


def test_tiff():
    p = np.arange(12, dtype=np.uint16).reshape(3, 4) * 1000
    pixels, depth, res = I.decode_tiff(tiff(p))
    assert (pixels[:, :, 0] == p).all() and depth == 16 and res == 0.25
    assert I.to_8bit(p).max() == 255


def java_tiff(spark, pixels, packed, tile):
    """A TIFF that Java's own writer makes of the pixels."""
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(I.encode_png(pixels)))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("tiff").next()
    how = writer.getDefaultWriteParam()
    if packed:
        how.setCompressionMode(2)
        how.setCompressionType(packed)
    if tile:
        how.setTilingMode(2)
        how.setTiling(tile, tile, 0, 0)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    stream.flush()
    return bytes(out.toByteArray())


@pytest.mark.parametrize("packed", [None, "LZW", "PackBits", "Deflate", "ZLib"])
@pytest.mark.parametrize("tile", [0, 16])
def test_tiff_of_another_writer(spark, packed, tile):
    rng = np.random.default_rng(3)
    smooth = (np.add.outer(np.arange(70), np.arange(45)) % 256).astype(np.uint8)
    noise = rng.integers(0, 256, (90, 77, 3)).astype(np.uint8)
    deep = rng.integers(0, 65536, (33, 50)).astype(np.uint16)
    for p in (smooth, noise, deep, smooth[:5, :7]):
        got, depth, _ = I.decode_tiff(java_tiff(spark, p, packed, tile))
        assert depth == 8 * p.itemsize and (got == p.reshape(got.shape)).all()


def blocks_tiff(blocks, extra, order="<"):
    """A file of these blocks (uncompressed) with those tags, all of them lists of longs."""
    import struct

    at, offsets, body = 8, [], b"".join(blocks)
    for b in blocks:
        offsets.append(at)
        at += len(b)
    tiled = 322 in extra
    tags = extra | {324 if tiled else 273: offsets, 325 if tiled else 279: [len(b) for b in blocks]}
    lists, entries, end = b"", b"", 8 + len(body)
    for tag, values in sorted(tags.items()):
        data = struct.pack(order + f"{len(values)}I", *values)
        where = data if len(values) == 1 else struct.pack(order + "I", end + len(lists))
        lists += data if len(values) > 1 else b""
        entries += struct.pack(order + "HHI", tag, 4, len(values)) + where
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", end + len(lists))
    return head + body + lists + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4


def test_tiff_planes_differences_palette_and_broken():
    rng = np.random.default_rng(4)
    p = rng.integers(0, 65536, (5, 6, 2)).astype(np.uint16)
    for order in "<>":
        steps = np.diff(p, axis=1, prepend=np.zeros((5, 1, 2), np.uint16)).astype(order + "u2")
        size = {256: [6], 257: [5], 258: [16], 277: [2], 317: [2]}
        assert (I.decode_tiff(blocks_tiff([steps[:3].tobytes(), steps[3:].tobytes()], size | {278: [3]}, order))[0] == p).all()
        planes = [steps[:, :, k].tobytes() for k in range(2)]
        assert (I.decode_tiff(blocks_tiff(planes, size | {284: [2]}, order))[0] == p).all()
    index = np.array([[0, 2], [255, 1]], np.uint8)
    colours = rng.integers(0, 65536, (3, 256))
    got = I.decode_tiff(blocks_tiff([index.tobytes()], {256: [2], 257: [2], 258: [8], 262: [3], 320: colours.ravel().tolist()}))[0]
    assert (got == colours.T[index] >> 8).all()
    with pytest.raises(I.Unsupported):
        I.decode_tiff(blocks_tiff([b"abcd"], {256: [2], 257: [1 << 30], 258: [8], 278: [1]}))
    with pytest.raises(I.Unsupported):
        I.decode_tiff(blocks_tiff([b"\xff\xff\xff"], {256: [2], 257: [2], 258: [8], 259: [5]}))
    with pytest.raises(I.Unsupported):
        I.decode_tiff(blocks_tiff([b"abcd"], {256: [2], 257: [2], 258: [8], 259: [7]}))


@pytest.fixture
def folder(tmp_path):
    for k in range(4):
        (tmp_path / f"img {k}.png").write_bytes(I.encode_png(np.full((6, 8), 40 * k, np.uint8)))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    (tmp_path / "a.txt").write_text("no image")
    return tmp_path


def test_scan_and_stream(spark, folder, tmp_path_factory):
    rows = {r["image_id"]: r for r in I.images(spark, str(folder)).collect()}
    assert set(rows) == {"img_0", "img_1", "img_2", "img_3", "bad"} or set(rows) == {"img%200", "img%201", "img%202", "img%203", "bad"}
    assert rows["bad"]["problem"] and rows["bad"]["data"] is None
    out = tmp_path_factory.mktemp("out")
    n = incremental.process_folder(spark, str(folder), f"{out}/t", f"{out}/c", files_each=2)
    assert n == 3 and spark.read.parquet(f"{out}/t").count() == 5
    (folder / "late.png").write_bytes(I.encode_png(np.zeros((3, 3), np.uint8)))
    incremental.process_folder(spark, str(folder), f"{out}/t", f"{out}/c", files_each=2)
    assert spark.read.parquet(f"{out}/t").count() == 6


def test_event_windows_batch_and_stream_agree(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet")
    assert incremental.event_windows(e).agg(F.sum("n")).first()[0] == e.count()
    stream = spark.readStream.schema(e.schema).parquet(f"{small}/events*.parquet")
    q = incremental.event_windows(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == e.count()


def test_params_round_trip():
    p = params.parse("Detection:\n  Dark Line: false # bright\n  Max Line Width: 9\n")
    assert p["Detection"]["Dark Line"] is False and p["Detection"]["Max Line Width"] == 9
    assert p["Segmentation"]["Color Threshold"] == 0.2
    assert params.parse(params.dump(p)) == p
    assert params.windows(5, 12, 2) == [5, 7, 9, 11, 13] and params.in_pixels(20, 3) == 6


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456, 2), ("b", 2.0, 3)], "image string, m double, n int")
    sinks.write_results(df, str(tmp_path), "res")
    assert {r["m"] for r in sinks.read_results(spark, str(tmp_path), "res", df.schema).collect()} == {1.235, 2.0}
    assert {r["m"] for r in spark.read.parquet(f"{tmp_path}/res.parquet").collect()} == {1.23456, 2.0}
    assert "m: 1.235" in {r["line"] for r in sinks.report(df, "image", {"all": ["m", "n"]}).collect()}
    assert sinks.provenance(df, "1", "x").count() == 1


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_scalars(spark):
    assert one(spark, scalar.safe_divide(F.lit(1.0), F.lit(0.0))) == 0.0
    assert one(spark, scalar.safe_divide(F.lit(None).cast("double"), F.lit(2.0))) is None
    assert one(spark, scalar.resolution_of(F.lit(4.0))) == 0.25 and one(spark, scalar.resolution_of(F.lit(None).cast("double"))) == 1.0
    assert one(spark, scalar.circle_radius(scalar.circle_area(F.lit(3.0)))) == pytest.approx(3)
    assert one(spark, scalar.half_circle(F.lit(4.0))) == pytest.approx(4 - np.pi)
    assert one(spark, scalar.um_to_px(F.lit(7.0), F.lit(2.0))) == 3
    assert one(spark, scalar.joined_path(F.lit("a\\b"), F.lit("c"))) == "a/b/c"
    assert scalar.normal_cdf(0) == 0.5 and scalar.line_threshold(100, 5, 2) >= 0


def test_reflection_and_borders(spark):
    v = F.array(*[F.lit(float(k)) for k in range(9)])
    left = R.convolve(v, ((1, 0, 0),), 3, 3, "mirror")
    assert one(spark, left) == [1, 0, 1, 4, 3, 4, 7, 6, 7]
    assert one(spark, R.convolve(v, ((1, 0, 0),), 3, 3, "reflect")) == [0, 0, 1, 3, 3, 4, 6, 6, 7]
    assert one(spark, R.percentile(v, 0.25)) == 2.0


def test_tiles_cover_and_shift_both_axes(spark):
    t = T.tiles(spark.createDataFrame([(1, 2051, 2051)], "image_id int, height int, width int"), 2048).collect()
    assert {(r["y0"], r["x0"], r["tile_h"], r["tile_w"]) for r in t} == {(0, 0, 1026, 1026), (0, 1025, 1026, 1026), (1025, 0, 1026, 1026), (1025, 1025, 1026, 1026)}


def test_checks_and_lookups(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, None)], "k int, a double")
    assert T.repeated_keys(df, "k").collect()[0]["n"] == 2
    with pytest.raises(Exception, match="stands twice"):
        T.require_unique(df, "k").collect()
    assert T.looked_up(df, None, "k", ["x"]).first()["x"] == 0.0
    assert T.without_roi_columns(df.withColumn("% ROI", F.lit(1))).columns == ["k", "a"]
    assert T.numeric_columns(df) == ["k", "a"]
    s = T.group_statistics(df.withColumn("o", F.lit(1)), ["k"], ["a"], "o").orderBy("k").collect()
    assert s[0]["a_mean"] == 2.5 and s[1]["a_mean"] is None and s[1]["n_rois"] == 1


def filtered_png(pixels, kinds, interlace=0):
    """A PNG of 8-bit (h, w, c) pixels whose lines use the given filters in turn."""
    import struct
    import zlib

    h, w, c = pixels.shape

    def lines(p):
        out, above = b"", np.zeros(p.shape[1] * c + c, int)
        for y, row in enumerate(p):
            now = np.concatenate([np.zeros(c, int), row.reshape(-1).astype(int)])
            left, up, corner = now[:-c], above[c:], above[:-c]
            q = left + up - corner
            a, b, d = abs(q - left), abs(q - up), abs(q - corner)
            paeth = np.where((a <= b) & (a <= d), left, np.where(b <= d, up, corner))
            kind = kinds[y % len(kinds)]
            guess = [np.zeros_like(left), left, up, (left + up) // 2, paeth][kind]
            out += bytes([kind]) + ((now[c:] - guess) & 255).astype(np.uint8).tobytes()
            above = now
        return out

    body = b"".join(lines(pixels[y::dy, x::dx]) for y, x, dy, dx in I.PASSES if pixels[y::dy, x::dx].size) if interlace else lines(pixels)

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, interlace)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_png_filters_and_interlacing():
    rng = np.random.default_rng(2)
    for h, w, c in ((1, 1, 1), (9, 13, 3), (17, 5, 1), (33, 40, 3)):
        pixels = rng.integers(0, 256, (h, w, c)).astype(np.uint8)
        for kinds in ((0,), (1,), (2,), (3,), (4,), (4, 3, 2, 1, 0)):
            for interlace in (0, 1):
                assert (I.decode_png(filtered_png(pixels, kinds, interlace))[0] == pixels).all()


def test_jpegs_by_spark(spark, tmp_path):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(24, 16, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for x in range(24):
        for y in range(16):
            image.setRGB(x, y, (200 << 16) | (40 << 8) | 90)
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(tmp_path / "a b.jpg")))
    (tmp_path / "broken.jpeg").write_bytes(b"nothing")
    got = {r["image_id"]: r for r in I.images(spark, str(tmp_path)).collect()}
    r = got["a_b"]
    pixels = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)
    assert (r["height"], r["width"], r["problem"]) == (16, 24, None) and np.abs(pixels.astype(int) - [200, 40, 90]).max() < 6
    assert got["broken"]["problem"] and got["broken"]["data"] is None


def test_version_of_a_folder(tmp_path):
    from weftlens.sources import sinks

    assert sinks.git_version(str(tmp_path))["version"] == "unknown"
    assert sinks.elapsed(3725.4) == "1h 2m 5s"


def test_tables_bound_tasks_where_the_caller_has_not(spark, small):
    from weftlens.sources import tables

    kept = {k: spark.conf.get(k) for k in tables.BYTES if k in spark.conf.getAll}
    try:
        for key in tables.BYTES:
            spark.conf.unset(key)
        one = next(iter(tables.BYTES))
        spark.conf.set(one, "77m")
        assert tables.table(spark, small, "lineitem").count() > 0
        assert {k: spark.conf.get(k) for k in tables.BYTES} == tables.BYTES | {one: "77m"}
    finally:
        for key in tables.BYTES:
            spark.conf.unset(key)
        for key, value in kept.items():
            spark.conf.set(key, value)


def test_shuffles_begin_with_partitions_by_the_size_of_a_table(spark, small, monkeypatch):
    from weftlens.sources import tables

    monkeypatch.setattr(tables, "SHARE", 1 << 12)
    held = {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    kept = {k: spark.conf.get(k) for k in (*held, tables.FIRST, tables.OURS) if k in spark.conf.getAll}
    try:
        for key in (tables.FIRST, tables.OURS):
            spark.conf.unset(key)
        for key, value in held.items():
            spark.conf.set(key, value)
        rows = tables.table(spark, small, "lineitem").groupBy("l_orderkey", "l_linenumber").count()
        assert rows.groupBy(F.spark_partition_id()).count().count() > 2
        first = int(spark.conf.get(tables.FIRST))
        tables.table(spark, small, "region")  # a smaller one changes nothing
        assert int(spark.conf.get(tables.FIRST)) == first > 2
        spark.conf.set(tables.FIRST, "3")  # the caller's
        tables.table(spark, small, "lineitem")
        assert spark.conf.get(tables.FIRST) == "3"
    finally:
        for key in (*held, tables.FIRST, tables.OURS):
            spark.conf.unset(key)
        for key, value in kept.items():
            spark.conf.set(key, value)
