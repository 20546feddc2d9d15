"""Cones as pixel ranges, tables laid out by pixel, nested weights, the joint mixture: against plain versions."""

import glob
import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import sky
from lumenframe.operators import density, joint, mixture
from lumenframe.sources import layout


def positions(n=4000, seed=2):
    rng = np.random.default_rng(seed)
    lon, lat = rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    lon[:6], lat[:6] = [0, 0, 45, 359.999999, 90, 180], [90, -90, 89.9, 0, 41.8103149, -41.8103149]
    return lon, lat


CONES = [(0.0, 90.0, 7.0), (120.0, -89.0, 3.0), (0.0, 0.0, 5.0), (359.9, 41.81, 12.0), (45.0, 0.0, 0.5), (200.0, -60.0, 40.0), (10.0, 10.0, 179.0), (33.0, 5.0, 0.0)]


def separation(a, b):
    la, ba, lb, bb = (np.radians(x) for x in (*a, *b))
    return np.degrees(2 * np.arcsin(np.sqrt(np.clip(np.sin((ba - bb) / 2) ** 2 + np.cos(ba) * np.cos(bb) * np.sin((la - lb) / 2) ** 2, 0, 1))))


@pytest.fixture(scope="module")
def placed(spark):
    lon, lat = positions()
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat))], "id long, lon double, lat double")
    return df.withColumn("pix", sky.nested_pixel(F.col("lon"), F.col("lat"), 7))


def test_no_position_of_a_cone_is_missed(placed):
    rows = placed.collect()
    lon, lat, pix = (np.array([r[c] for r in rows]) for c in ("lon", "lat", "pix"))
    centre, radius = layout.pixel_frames(pix, 7)
    assert (np.degrees(layout._angle(centre, np.stack([np.cos(np.radians(lat)) * np.cos(np.radians(lon)), np.cos(np.radians(lat)) * np.sin(np.radians(lon)), np.sin(np.radians(lat))], 1))) <= np.degrees(radius)).all()
    for l, b, r in CONES:
        for most in (64, 3):
            ranges = layout.disc_ranges(l, b, r, 7, most)
            held = np.zeros(len(pix), bool)
            for lo, hi in ranges:
                held |= (pix >= lo) & (pix < hi)
            near = separation((lon, lat), (l, b)) <= r
            assert len(ranges) <= most and (held | ~near).all()
        if 1 < r < 60:
            loose = layout.disc_ranges(l, b, r, 7, 1 << 20)
            area = sum(hi - lo for lo, hi in loose) / (12 * 4**7) * 4 * math.pi
            assert area < 2.5 * 2 * math.pi * (1 - math.cos(math.radians(r)))


def test_a_cone_in_one_cell(placed):
    rows = placed.withColumn("cell", F.shiftright("pix", 6)).collect()
    cells = {r["id"]: r["cell"] for r in rows}
    centre, _ = layout.pixel_frames(np.array([rows[50]["cell"]]), 4)
    lon, lat = math.degrees(math.atan2(centre[0, 1], centre[0, 0])), math.degrees(math.asin(centre[0, 2]))
    assert layout.cone_cell(lon, lat, 0.5, 4) == rows[50]["cell"] and layout.cone_cell(lon, lat, 8.0, 4) is None
    for r in rows[6:60]:
        got = layout.cone_cell(r["lon"], r["lat"], 0.3, 4)
        assert got in (None, cells[r["id"]])


def test_ranges_reach_the_scan(spark, placed, tmp_path):
    path = str(tmp_path / "table")
    layout.write_clustered(placed, path, "pix", 6, row_group=1024)
    assert placed.count() == spark.read.parquet(path).count()
    near = layout.read_cone(spark, path, "pix", 120.0, 30.0, 6.0, 7)
    # long filters are cut short in a plan's text: the whole filter is there, and one range reads in full
    assert "PushedFilters: [Or(Or(" in near._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(pix," in layout.read_cone(spark, path, "pix", 120.0, 30.0, 6.0, 7, 1)._jdf.queryExecution().executedPlan().toString()
    ranges = layout.disc_ranges(120.0, 30.0, 6.0, 7)
    files = glob.glob(f"{path}/*.parquet")
    met = 0
    for f in files:
        m = pq.ParquetFile(f).metadata
        spans = [m.row_group(i).column(3).statistics for i in range(m.num_row_groups)]
        met += any(s.min < hi and s.max >= lo for s in spans for lo, hi in ranges)
    assert len(files) > 3 and met < len(files)
    want = {r["id"] for r in placed.collect() if separation((r["lon"], r["lat"]), (120.0, 30.0)) <= 6.0}
    assert want and want <= {r["id"] for r in near.collect()}


def test_training_rows_prune(spark, placed, tmp_path):
    path = str(tmp_path / "rows")
    rows = placed.select("id", F.when(F.col("id") % 3 == 0, "fit").otherwise("test").alias("role"), (F.col("id") / 1000.0).alias("z"))
    layout.write_clustered(rows, path, "z", 4, by=["role"])
    some = layout.training_rows(spark, path, ["fit"], (1.0, 2.0))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "GreaterThanOrEqual(z,1.0)" in plan and "LessThan(z,2.0)" in plan
    assert sorted(r["id"] for r in some.collect()) == [i for i in range(4000) if i % 3 == 0 and 1000 <= i < 2000]


def plain_weights(e, sw, w, rounds):
    for _ in range(rounds):
        q = e * w
        w = ((sw / q.sum(1))[:, None] * q).sum(0) / sw.sum()
    return w


def test_nested_weights(spark):
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getCheckpointDir())
    rng = np.random.default_rng(8)
    lp, sw = rng.normal(0, 2, (300, 3)), rng.uniform(0.5, 2, 300)
    # one cell has most of the rows
    pix = np.where(rng.random(300) < 0.6, 5, rng.integers(0, 32, 300))
    rows = [(int(p), a.tolist(), float(s)) for p, a, s in zip(pix, lp, sw)]
    odd = [(3, None, 1.0), (3, [0.0, 0.0], 1.0), (3, [0.0, 0.0, 0.0], 0.0), (None, [0.0, 0.0, 0.0], 1.0), (3, [float("-inf")] * 3, 1.0)]
    df = spark.createDataFrame(rows + odd, "pix int, lp array<double>, sw double")
    w = density.nested_weights(df, [0.2, 0.3, 0.5], 2, 10.0, 4)
    got = {(r["level"], r["cell"]): (r["n"], np.array(r["w"])) for r in w.collect()}
    e = np.exp(lp)
    whole = plain_weights(e, sw, np.array([0.2, 0.3, 0.5]), 4)
    assert np.allclose(got[0, 0][1], whole)
    for cell in range(32):
        i, up = pix == cell, pix >> 2 == cell >> 2
        if not i.any():
            assert (2, cell) not in got
            continue
        n, m = sw[i].sum(), sw[up].sum()
        parent = m / (m + 10) * plain_weights(e[up], sw[up], whole, 4) + 10 / (m + 10) * whole
        want = n / (n + 10) * plain_weights(e[i], sw[i], whole, 4) + 10 / (n + 10) * parent
        assert np.allclose(got[1, cell >> 2][1], parent) and np.allclose(got[2, cell][1], want) and np.isclose(got[2, cell][0], n)
    at = {r["pix"]: (r["level"], r["w"]) for r in density.weights_at(spark.createDataFrame([(5,), (40,), (None,)], "pix int"), w, 2).collect()}
    assert at[5][0] == 2 and at[40][0] == at[None][0] == 0 and np.allclose(at[None][1], whole)
    r = density.cone_weights(df.filter("pix = 5"), [0.2, 0.3, 0.5], 10.0, 4).first()
    i = pix == 5
    n = sw[i].sum()
    assert np.isclose(r["n"], n) and np.allclose(r["w"], n / (n + 10) * plain_weights(e[i], sw[i], np.array([0.2, 0.3, 0.5]), 4) + 10 / (n + 10) * np.array([0.2, 0.3, 0.5]))


def test_the_joint_mixture_is_its_quadrature(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(0, 1, (3, 3, 3))
    m = mixture.Mixture([0.5, 0.3, 0.2], rng.normal(0, 1, (3, 3)) + [0, 0, 1.5], a @ a.swapaxes(1, 2) + 0.3 * np.eye(3))
    x, var = rng.normal(0, 1, (5, 2)), rng.uniform(0.1, 0.5, (5, 2))
    rows = [(i, [float(p) if not (i == 1 and j == 0) else None for j, p in enumerate(x[i])], var[i].tolist(), z) for i, z in enumerate([0.4, 1.0, 2.9, 3.5, 0.1])]
    rows += [(5, [None, None], [0.1, 0.1], 1.0), (6, None, None, None)]
    df = spark.createDataFrame(rows, "id int, x array<double>, var array<double>, z double")
    got = {r["id"]: r for r in joint.redshift_columns(df, m, (0.1, 3.0), F.col("z"), (F.col("z") - 0.3, F.col("z") + 0.3)).collect()}
    grid = np.linspace(0.1, 3.0, 40_001)
    for i, xs, vs, z in rows:
        seen = np.array([v is not None for v in (xs or [None, None])])
        full = np.concatenate([np.tile([v or 0.0 for v in (xs or [0, 0])], (len(grid), 1)), grid[:, None]], 1)
        noise = np.concatenate([np.tile(vs or [0.1, 0.1], (len(grid), 1)), np.zeros((len(grid), 1))], 1)
        p = np.exp(mixture.log_prob(m, full, noise, np.tile([*seen, True], (len(grid), 1))))
        area = np.trapezoid(p, grid)
        r = got[i]
        if z is not None and 0.1 <= z <= 3.0:
            assert r["status"] == "ok" and abs(r["log_density"] - np.log(np.interp(z, grid, p) / area)) < 1e-4
        else:
            assert r["status"] == "outside_support" and r["log_density"] is None
        if z is None:
            assert r["mass"] is None
        else:
            use = (grid >= z - 0.3) & (grid <= z + 0.3)
            assert abs(r["mass"] - (np.trapezoid(p[use], grid[use]) / area if use.sum() > 1 else 0.0)) < 2e-3
