"""Latent fits, photometry rules, hold-outs and filter curves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import estimate, latent, select
from lumenframe.operators.mixture import Mixture
from lumenframe.sources import store


def data(spark, n=600):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(n)[:, None] < 0.4, rng.normal([-3, 0], 0.7, (n, 2)), rng.normal([3, 2], 0.9, (n, 2)))
    h = np.array([[1.0, 1.0], [0.0, 2.0]])
    rows = []
    for i, v in enumerate(x):
        y = v if i % 2 else h @ v + [0.5, 0.0]
        y = y + 0.1 * rng.standard_normal(2)
        rows.append((i % 2, [float(y[0]), None if i % 7 == 0 else float(y[1])], [0.01, 0.01]))
    systems = {1: (np.eye(2), np.zeros(2), np.zeros((2, 2))), 0: (h, np.array([0.5, 0.0]), np.zeros((2, 2)))}
    return spark.createDataFrame(rows, "system int, y array<double>, var array<double>"), systems


START = Mixture([0.5, 0.5], [[-1.0, 0.0], [1.0, 1.0]], np.tile(4.0 * np.eye(2), (2, 1, 1)))


def test_two_systems_one_population(spark):
    df, systems = data(spark)
    m, history, _ = latent.fit_latent(df, START, systems, iterations=25)
    assert (np.diff(history) > -1e-9).all()
    assert np.allclose(m.means, [[-3, 0], [3, 2]], atol=0.25) and m.weights[0] == pytest.approx(0.4, abs=0.06)


def test_identity_agrees_with_the_plain_fit(spark):
    df, systems = data(spark)
    one = df.filter("system = 1")
    a, _, _ = latent.fit_latent(one, START, systems, iterations=4, regularization=1e-6, strength=None, tolerance=0)
    b, _ = estimate.fit_mixture(one.withColumnRenamed("y", "x"), START, iterations=4, tolerance=0, floor=1e-6)
    assert np.allclose(a.means, b.means) and np.allclose(a.covs, b.covs) and np.allclose(a.weights, b.weights)


@pytest.mark.parametrize("blocks", [[latent.Block((0,), still=True), latent.Block((1,))], [latent.Block((0,)), latent.Block((1,))], [latent.Block((0,), still=True), latent.Block((1,), alike=("a", "a"))]])
def test_blocks_hold_and_the_objective_rises(spark, blocks):
    df, systems = data(spark)
    alike = blocks[1].alike
    start = START if alike is None else Mixture(START.weights, [[-3.0, 1.0], [3.0, 1.0]], START.covs)
    m, history, _ = latent.fit_latent(df, start, systems, iterations=6, blocks=blocks)
    assert np.allclose(m.covs[:, 0, 1], 0) and (np.diff(history) > -1e-9).all()
    assert np.allclose(m.means[:, 0], start.means[:, 0]) == blocks[0].still
    if alike:
        assert m.means[0, 1] == m.means[1, 1] and m.covs[0, 1, 1] == m.covs[1, 1, 1]
    with pytest.raises(ValueError):
        latent.fit_latent(df, Mixture([1.0], [[0.0, 0.0]], [[[1.0, 0.5], [0.5, 1.0]]]), systems, blocks=blocks[:1] + [latent.Block((1,))])
    with pytest.raises(ValueError):
        latent.fit_latent(df, START, systems, blocks=blocks[:1])


def test_refusals(spark):
    df, systems = data(spark, 10)
    with pytest.raises(RuntimeError):
        latent.fit_latent(df.limit(0), START, systems)
    with pytest.raises(Exception, match="no measurement"):
        latent.fit_latent(df.withColumn("y", F.array(F.lit(None).cast("double"), F.lit(None).cast("double"))), START, systems)


def test_photometry_kinds(spark):
    df = spark.createDataFrame([(20.0, 0.1, True), (99.0, 0.1, True), (20.0, 0.0, True), (None, 0.1, True), (20.0, 0.1, None), (-2.0, 0.5, True), (float("inf"), 0.5, True)], "v double, e double, ok boolean")

    def out(kind, **k):
        f, v = select.photometry(F.col("v"), F.col("e"), kind, F.col("ok"), **k)
        return [tuple(r) for r in df.select(f, v).collect()]

    mags = out("mag")
    assert mags[0][0] == pytest.approx(10.0) and mags[0][1] == pytest.approx((np.log(10) / 2.5) ** 2) and mags[1:5] == [(None, None)] * 4
    assert out("ivar")[5] == (-2.0, 2.0) and out("dn", scale=2.0)[5] == (-4.0, 1.0) and out("sigma")[6] == (None, None)


def test_balanced_holdout():
    counts = {i: [10, 0 if i % 2 else 5] for i in range(10)}
    held = select.balanced_holdout(counts, 0.3, 5, seed=1)
    assert len(held) == 3 and any(h % 2 == 0 for h in held) and held == select.balanced_holdout(counts, 0.3, 5, seed=1)
    with pytest.raises(ValueError):
        select.balanced_holdout({0: [1, 0], 1: [1, 1]}, 0.5, 1, seed=1, draws=50)


def test_filter_curve_and_configurations(spark, tmp_path):
    p = tmp_path / "f.xml"
    p.write_text("<VOTABLE><TABLE><DATA><TABLEDATA><TR><TD>5000</TD><TD>0.5</TD></TR><TR><TD>4000.5</TD><TD>-0.1</TD></TR></TABLEDATA></DATA></TABLE></VOTABLE>")
    assert [tuple(r) for r in store.read_filter_curve(spark, str(p)).collect()] == [(4000.5, 0.0), (5000.0, 0.5)]
    a = {"seed": 1, "file": "/a/x", "file_hash": "h"}
    assert store.same_configuration(a, {**a, "file": "/b/x"}, {"file": "file_hash"})
    assert not store.same_configuration(a, {**a, "file": "/b/x", "file_hash": "k"}, {"file": "file_hash"})
    assert not store.same_configuration(a, {**a, "seed": 2}, {"file": "file_hash"})


@pytest.mark.parametrize("kappa", [10.0, np.inf])
def test_extension_finds_the_regression_and_keeps_the_old_block(spark, kappa):
    rng = np.random.default_rng(4)
    base = Mixture([0.5, 0.5], [[-2.0, 0.0], [2.0, 1.0]], np.tile(np.diag([0.8, 0.5]), (2, 1, 1)))
    x = base.sample(1500, seed=2)
    new = x[:, 0] + 0.7 + 0.5 * x[:, 1] + 0.2 * rng.standard_normal(len(x))
    rows = [(0, [float(a), float(b), float(c) if i % 5 else None], [1e-4] * 3) for i, (a, b, c) in enumerate(zip(*x.T, new))]
    df = spark.createDataFrame(rows, "system int, y array<double>, var array<double>")
    systems = {0: (np.eye(3), np.zeros(3), np.zeros((3, 3)))}
    m, history = latent.fit_extension(df, base, systems, np.array([[0.0, 1.0]]), 0, 1, [[0, 1]], kappa=kappa, iterations=8)
    assert (m.covs[:, :2, :2] == base.covs).all() and (m.means[:, :2] == base.means).all() and history[-1] > history[0]
    assert np.allclose(m.means[:, 2], base.means[:, 0] + 0.7 + 0.5 * base.means[:, 1], atol=0.06)
    assert np.allclose(m.covs[:, 2, 1] - m.covs[:, 0, 1], 0.25, atol=0.03)
    assert np.allclose(m.covs[:, 2, 2], 0.8 + 0.25 * 0.5 + 0.04, atol=0.05)
    with pytest.raises(ValueError):
        latent.fit_extension(df, base, systems, np.array([[0.0, 1.0]]), 0, 1, [[0]])
