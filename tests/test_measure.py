"""Files to scores on drawn fibres."""

import numpy as np
from pyspark.sql.types import StructType

from weftlens.operators import kernels as K
from weftlens.plans import measure
from weftlens.sources import images as I, params as P


def fibres(angle, n=5, size=96):
    yy, xx = np.mgrid[:size, :size]
    across = yy * np.cos(angle) + xx * np.sin(angle)
    return np.where(np.abs((across % 19) - 9) < 2.5, 40, 230).astype(np.uint8)


def test_files_to_scores(spark, tmp_path):
    for k, angle in enumerate((0.0, 0.0, 0.6, 0.6)):
        (tmp_path / f"P{k // 2}.vsi_BF_Annotation(Tumor)_{k}_roi.png").write_bytes(I.encode_png(fibres(angle)))
    (tmp_path / "P9_black.png").write_bytes(I.encode_png(np.zeros((96, 96), np.uint8)))
    (tmp_path / "P8_small.png").write_bytes(I.encode_png(np.full((10, 10), 90, np.uint8)))
    params = P.parse("Detection:\n  Low Contrast: 20\n  High Contrast: 60\nGap Analysis:\n  Minimum Gap Diameter: 6\n")
    m = measure.measured(I.images(spark, str(tmp_path)), params)
    rows = m.collect()
    assert len(rows) == 4
    for r in rows:
        assert r["alignment"] > 0.9 and r["variance"] < 0.2
        assert r["length"] > 200 and 0 < r["width_share"] < 0.6 and r["gap_count"] > 0
        assert r["gap_p5"] <= r["gap_median"] <= r["gap_p95"]
    sink = measure.for_sink(m, [10, 20, 30])
    assert "Curvature (win_sz=20)" in sink.columns and sink.count() == 4
    s = {r["patient_id"]: r for r in measure.patient_scores(m).collect()}
    assert set(s) == {"P0", "P1"} and s["P0"]["n_rois"] == 2 and s["P0"]["tissue_type"] == "Tumor"
    assert abs(s["P0"]["rigidity"] + s["P1"]["rigidity"]) < 1e-6


def test_gap_statistics_interpolate(spark):
    rows = [("a", 10, 20, 2.0, [(1.0, 1.0, 1.0, True), (5.0, 5.0, 3.0, False), (7.0, 9.0, 2.0, True)]), ("b", 10, 10, 1.0, [])]
    numbers = [f for f in StructType.fromDDL(measure.SCHEMA).fields if f.name != "circles"]
    zero = [{"map": {}, "long": 0}.get(f.dataType.typeName(), 0.5) for f in numbers]
    df = spark.createDataFrame([(*r[:4], *zero, r[4]) for r in rows], f"image_id string, height int, width int, res_um double, {measure.SCHEMA}")
    got = {r["image"]: r for r in measure.in_units(df).collect()}
    for g, radii, ground in (("gap", [2.0, 6.0, 4.0], 800.0), ("roi_gap", [2.0, 4.0], 400.0)):
        r, area = np.array(radii), np.pi * np.array(radii) ** 2
        for w, v, unit in (("", area, ground), ("_radius", r, np.sqrt(ground))):
            want = [v.mean(), v.std(), *np.percentile(v, (5, 50, 95)), v.mean() / unit, v.std() / unit]
            assert np.allclose([got["a"][f"{g}{w}_{k}"] for k in ("mean", "std", "p5", "median", "p95", "mean_norm", "std_norm")], want)
        assert got["a"][f"{g}_count"] == len(radii) and np.isclose(got["a"][f"{g}_density"], len(radii) / ground)
        assert got["b"][f"{g}_median"] == got["b"][f"{g}_count"] == 0
    found = measure.gaps(df).orderBy("area_um2").collect()
    assert [(r["x"], r["y"], r["in_roi"]) for r in found] == [(1.0, 1.0, True), (9.0, 7.0, True), (5.0, 5.0, False)]
    assert len(measure.NAMES) == len(set(measure.NAMES.values())) and set(measure.NAMES) <= set(measure.in_units(df).columns)


def test_dense_matrix_by_hand():
    gray = np.array([[0, 10, 20], [30, 200, 250]], float)
    cut = np.minimum(gray, 230)
    full = np.floor(cut / 230 * 255)
    low, high = np.percentile(full, (5, 95))
    shown = np.floor((np.clip(full, low, high) - low) / (high - low) * 255)
    assert (measure.dense_matrix(gray, 230, 0.1, False) == (shown > 0)).all()
    assert (measure.dense_matrix(gray, 230, 0.1, True) == (255 - shown > 0)).all()
    assert measure.dense_matrix(np.zeros((3, 3)), 230, 0.1, True).all() and not measure.dense_matrix(np.zeros((3, 3)), 230, 0.1, False).any()


def test_box_counts_leave_out_full_boxes():
    m = np.zeros((64, 64), bool)
    m[:8, :8] = True  # full at 4 and 8
    m[20, 30] = True
    n = [1, 1, 2, 1]  # sizes 4, 8, 16, 32: the pixel; with the square from 16 on, in one box at 32
    assert np.isclose(measure.fractal_of(m), -np.polyfit(np.log([4, 8, 16, 32]), np.log(n), 1)[0])
    assert measure.fractal_of(np.zeros((64, 64), bool)) == 0


def test_intensities_fall_back():
    rgb = np.full((4, 4, 3), 250.0)
    some, none = np.eye(4, dtype=bool), np.zeros((4, 4), bool)
    assert measure.mean_intensities(rgb, [some, none]) == [250.0, 0.0]
    rgb[0, 0] = (200, 60, 150)
    red = measure.eosin_gray(rgb)
    assert red[0, 0] < 180 < red[1, 1]
    assert measure.mean_intensities(rgb, [some, ~some]) == [float(red[0, 0]), 250.0]


def test_tiles_and_what_is_left_out(spark, tmp_path):
    big = np.arange(51 * 40, dtype=np.uint32).reshape(51, 40).astype(np.uint8) | 1
    for name, pixels in (("big", big), ("black", np.zeros((40, 40), np.uint8)), ("small", np.full((10, 40), 9, np.uint8)), ("good", fibres(0.3, size=32))):
        (tmp_path / f"{name}.png").write_bytes(I.encode_png(pixels))
    (tmp_path / "bad.png").write_bytes(b"\x89PNG nothing")
    params = P.parse("Segmentation:\n  Max Size: 32\nDetection:\n  Max Line Width: 6\n")
    images = I.images(spark, str(tmp_path))
    parts = {r["image_id"]: np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"]) for r in measure.tiled(images, 32).collect() if r["data"]}
    assert (parts["big_blk_0_0"] == big[:26, :20]).all() and (parts["big_blk_1_1"] == big[25:, 20:]).all() and parts["good"].shape == (32, 32)
    assert sum(k.startswith("black_blk") for k in parts) == 4
    why = {r["image_id"]: r["reason"] for r in measure.ignored(images, params).collect()}
    assert why["black_blk_0_0"] == "empty" and "small" in why["small"] and "bad" in why and "big_blk_0_0" not in why and "good" not in why
    assert {r["image_id"]: r["reason"] for r in measure.ignored(images, params, True).collect()}["big"] == "too large"


def test_a_large_image_in_time():
    """2048 x 2048 with about 2000 contours: the kernels' time is in proportion to pixels."""
    import time

    rng = np.random.default_rng(1)
    image = np.full((2048, 2048), 220.0)
    for _ in range(2000):
        y, x, a = rng.integers(20, 2028), rng.integers(20, 2028), rng.random() * np.pi
        t = np.arange(-18, 19)
        image[np.rint(y + t * np.sin(a)).astype(int).clip(0, 2047), np.rint(x + t * np.cos(a)).astype(int).clip(0, 2047)] = 40
    began = time.time()
    maps = K.ridge_maps(image, (3,))
    lines = K.linked_contours(maps, 2, 8, 5)
    K.drawn(lines, image.shape, K.widths_of(image, lines, maps))
    K.skeleton_edges(K.thinned(K.drawn(lines, image.shape)))
    assert len(lines) > 1000 and time.time() - began < 60


def test_run_as_files(spark, tmp_path):
    for k, angle in enumerate((0.0, 0.3, 0.6)):
        (tmp_path / f"P{k // 2}.vsi_BF_Annotation(Tumor)_{k}_roi.png").write_bytes(I.encode_png(fibres(angle)))
    params = P.parse("Detection:\n  Low Contrast: 20\n  High Contrast: 60\nGap Analysis:\n  Minimum Gap Diameter: 6\n")
    measure.measured(I.images(spark, str(tmp_path)), params).write.parquet(f"{tmp_path}/metrics")
    m = spark.read.parquet(f"{tmp_path}/metrics")
    names = measure.write_run(m, f"{tmp_path}/out", [10, 20, 30])
    assert names == ["QuantificationResults", "ResultsROI", "ResultsHDM", "PatientStatistics", "PatientScores"]
    whole = {n: spark.read.parquet(f"{tmp_path}/out/{n}.parquet") for n in names}
    assert whole["ResultsROI"].columns == list(measure.ROI_COLUMNS.values()) and whole["ResultsHDM"].columns == ["Image", "% HDM Area"]
    rows = {r["image"]: r for r in m.collect()}
    assert {r["Image"]: (r["Area (ROI)"], r["% WIDTH Area"]) for r in whole["ResultsROI"].collect()} == {k: (r["roi_area"], r["width_share"]) for k, r in rows.items()}
    assert {r["Image"]: r["% HDM Area"] for r in whole["ResultsHDM"].collect()} == {k: r["hdm_share"] for k, r in rows.items()}
    stats = {r["Patient"]: r for r in whole["PatientStatistics"].collect()}
    of = [r["alignment"] for k, r in rows.items() if k.startswith("P0")]
    assert stats["P0"]["No. of ROIs"] == 2 and np.isclose(stats["P0"]["Orient. Alignment MEAN"], np.mean(of)) and np.isclose(stats["P0"]["Orient. Alignment SEM"], np.std(of) / np.sqrt(2))
    scores = whole["PatientScores"]
    assert scores.columns[:4] == list(measure.META_COLUMNS.values()) and scores.columns[-2:] == ["Rigidity Score", "Bundling Score"] and scores.count() == 2
    assert all(c.endswith(" MEAN") for c in scores.columns[4:-2])
    text = spark.read.option("header", True).csv(f"{tmp_path}/out/ResultsHDM.csv").collect()
    assert {r[0]: float(r[1]) for r in text} == {k: round(r["hdm_share"], 3) for k, r in rows.items()}


def test_images_exported_and_read_again(spark, tmp_path):
    from weftlens.sources import sinks

    for k in range(3):
        (tmp_path / f"a{k}.png").write_bytes(I.encode_png(fibres(k / 3)))
    out = sinks.export_images(I.images(spark, str(tmp_path)), f"{tmp_path}/out").collect()
    assert sorted(r["path"] for r in out) == [f"{tmp_path}/out/a{k}.png" for k in range(3)]
    again = {r["image_id"]: r["data"] for r in I.images(spark, f"{tmp_path}/out").collect()}
    assert again == {r["image_id"]: r["data"] for r in I.images(spark, str(tmp_path)).collect()} and len(again) == 3
