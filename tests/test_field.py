"""Extinction curves, rasters, quantiles and censuses against closed forms."""

import numpy as np
from pyspark.sql import functions as F

from lumenframe.operators import density, extinction, metrics


def test_spline_meets_its_anchors_smoothly_and_ends_straight():
    x, y = extinction.anchors()
    rows = extinction.natural_spline(x, y)
    h = np.diff(x)
    left, a, b, c, d = rows.T
    assert np.allclose(left, x[:-1]) and np.allclose(a, y[:-1])
    assert np.allclose(a + h * (b + h * (c + h * d)), y[1:])
    assert np.allclose((b + h * (2 * c + 3 * h * d))[:-1], b[1:])
    assert np.allclose((2 * c + 6 * h * d)[:-1], 2 * c[1:])
    assert abs(c[0]) < 1e-12 and abs(2 * c[-1] + 6 * h[-1] * d[-1]) < 1e-9


def test_curve_is_null_in_the_ultraviolet(spark):
    x, y = extinction.anchors()
    waves = [float(1e4 / v) for v in x[1:8]] + [2650.0, None]
    got = [r.k for r in spark.createDataFrame(list(enumerate(waves)), "i int, w double").orderBy("i").select(extinction.curve(F.col("w")).alias("k")).collect()]
    assert np.allclose(got[:7], y[1:8]) and got[7:] == [None, None]


def test_narrow_bands_have_the_curve_at_their_wavelength(spark):
    rows = [("v", 5499.0, 1.0), ("v", 5500.0, 1.0), ("v", 5501.0, 1.0), ("one", 6000.0, 1.0), ("dark", 6000.0, 0.0), ("dark", 7000.0, 0.0), ("uv", 2500.0, 1.0), ("uv", 2800.0, 1.0), ("shut", 2500.0, 0.0), ("shut", 6000.0, 1.0)]
    got = {r.band: r.coefficient for r in extinction.band_coefficients(spark.createDataFrame(rows, "band string, wave double, transmission double")).collect()}
    k = spark.range(1).select(extinction.curve(F.lit(5500.0)).alias("k")).first().k
    assert abs(got["v"] - k) < 1e-3 and got["one"] is got["dark"] is got["uv"] is None and got["shut"] > 0


def test_native_coefficient_needs_all_its_channels(spark):
    h = spark.createDataFrame([("u", "a", 1.0), ("g", "a", 0.5), ("g", "b", 2.0), ("r", "c", 1.0)], "native string, latent string, h double")
    r = spark.createDataFrame([("a", 4.0), ("b", 3.0)], "latent string, r double")
    assert {x.native: x.r for x in extinction.native_coefficients(h, r).collect()} == {"u": 4.0, "g": 8.0, "r": None}


def test_raster_is_linear_between_pixels_and_clamped(spark):
    n = 16
    grid = spark.range(2 * n * n).select(F.when(F.col("id") < n * n, 1).otherwise(-1).alias("side"), F.floor(F.col("id") % (n * n) / n).alias("y"), (F.col("id") % n).alias("x"))
    raster = grid.withColumn("value", F.col("x") * 2.0 + F.col("y") + F.col("side"))
    at = [(0, 0.0, 90.0), (1, 30.0, 40.0), (2, 200.0, -35.0), (3, 0.0, 0.0), (4, None, 10.0)]
    points = spark.createDataFrame(at, "id int, l double, b double")
    got = {r.id: r.value for r in extinction.sample_raster(points, raster, n).collect()}
    for i, l, b in at[:4]:
        s = 1 if b >= 0 else -1
        reach = n / 2 * np.sqrt(1 - s * np.sin(np.radians(b)))
        x, y = reach * np.cos(np.radians(l)) + (n - 1) / 2, (n - 1) / 2 - s * reach * np.sin(np.radians(l))
        assert abs(got[i] - (2 * np.clip(x, 0, n - 1) + np.clip(y, 0, n - 1) + s)) < 1e-9
    assert got[4] is None
    holed = {r.id: r.value for r in extinction.sample_raster(points, raster.filter("side = 1"), n).collect()}
    assert holed[2] is None and holed[1] == got[1]


def test_quantiles_are_exact_and_null_without_rows(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=2000), 2)
    at = [0.0, 0.1, 0.37, 0.5, 0.999, 1.0]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    assert np.allclose(metrics.quantiles(df, at).first().q, np.quantile(x, at))
    assert metrics.quantiles(df.filter("x = 99"), [0.5]).first().q in (None, [None])


def test_roc_at_quantiles_without_one_label(spark):
    df = spark.createDataFrame([(0.1, 1), (0.9, 1)], "score double, label int")
    assert [(r.threshold, r.tpr, r.fpr) for r in metrics.roc_at_quantiles(df, [0.0, 1.0]).orderBy("i").collect()] == [(0.1, 1.0, None), (0.9, 0.5, None)]


def test_census_of_equal_blocks_has_no_error(spark):
    df = spark.range(400).select((F.col("id") % 20).alias("block"), F.when(F.col("id") < 100, 0).otherwise(1).alias("bin"))
    rows = {r.bin: (r.density, r.error) for r in metrics.census(df, "block", "bin", 3, 2.0, 30).collect()}
    assert rows == {0: (2.5, 0.0), 1: (7.5, 0.0), 2: (0.0, 0.0)}


def test_weights_of_a_lone_cell_are_drawn_to_the_whole(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0), (16, 1), (16, 1), (16, None), (16, 7)], "pix long, component int")
    got = {r.pix: r.w for r in density.shrunk_weights(rows, 2, 4, 2.0).collect()}
    assert np.allclose(got[0], [0.875, 0.125]) and np.allclose(got[16], [0.125, 0.875])
