"""Fits that go on, groups of any size, draws of a row's own model, and passes in order: against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import estimate, match, mixture, support

TRUTH = mixture.Mixture([0.6, 0.4], [[0.0, 0.0], [4.0, 3.0]], [[[1.0, 0.3], [0.3, 1.0]], [[0.5, 0.0], [0.0, 0.8]]])
START = mixture.Mixture([0.5, 0.5], [[-1.0, 1.0], [3.0, 3.0]], np.tile(2.0 * np.eye(2), (2, 1, 1)))


def measured(spark, n, seed=1, groups=lambda i: 0):
    x = TRUTH.sample(n, seed)
    rng = np.random.default_rng(seed)
    v = rng.uniform(0.05, 0.3, x.shape)
    rows = [(i, groups(i), [float(a) if rng.random() > 0.1 else None for a in x[i]], v[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g long, x array<double>, var array<double>").repartition(5, "id")


def same(a, b, tolerance=0.0):
    return all(np.allclose(p, q, rtol=0, atol=tolerance) if tolerance else np.array_equal(p, q) for p, q in zip((a.weights, a.means, a.covs), (b.weights, b.means, b.covs)))


def test_a_resumed_fit_is_the_unbroken_one(spark, tmp_path):
    df = measured(spark, 600)
    held = F.col("id") % 5 == 0
    whole = estimate.fit_rounds(df, START, 6, 0.0, held_out=held, patience=9)
    folder = str(tmp_path / "fit")
    for upto in (2, 3, 6):
        part = estimate.fit_rounds(df, START, upto, 0.0, held_out=held, patience=9, state=folder)
    assert part.history == whole.history and part.held == whole.held and same(part.model, whole.model) and same(part.last, whole.last)
    assert estimate.fit_rounds(df, START, 6, 0.0, held_out=held, patience=9, state=folder).history == whole.history
    with pytest.raises(ValueError):
        estimate.fit_rounds(df, TRUTH, 7, 0.0, held_out=held, patience=9, state=folder)
    with pytest.raises(RuntimeError):
        estimate.fit_rounds(df.limit(100), START, 8, 0.0, held_out=held, patience=9, state=folder)


def test_early_stopping_keeps_the_best_round(spark):
    # two held-out rows far from the rest: every step away from the wide start makes them less likely
    df = measured(spark, 200).unionByName(spark.createDataFrame([(1000, 0, [9.0, -9.0], [0.1, 0.1]), (1001, 0, [-9.0, 9.0], [0.1, 0.1])], "id long, g long, x array<double>, var array<double>"))
    wide = mixture.Mixture([0.5, 0.5], [[0.0, 0.0], [1.0, 1.0]], np.tile(60.0 * np.eye(2), (2, 1, 1)))
    fit = estimate.fit_rounds(df, wide, 20, 0.0, held_out=F.col("id") >= 1000, patience=2)
    assert fit.done and fit.best == int(np.argmax(fit.held)) and len(fit.held) == fit.best + 3
    with pytest.raises(ValueError):
        estimate.fit_rounds(df, wide, 2, held_out=F.col("id") > 5000)


def test_sums_do_not_depend_on_how_many_partitions_reach_the_driver(spark):
    parts = spark.range(1000).select(F.col("id").alias("part"), F.lit(bytearray(np.arange(3.0).tobytes())).alias("s"))
    for stop in (1, 8, 64):
        got = estimate.tree_sum(parts, [], 1000, stop).collect()
        assert len(got) <= stop and np.array_equal(sum(np.frombuffer(r["s"]) for r in got), 1000 * np.arange(3.0))


def test_audit():
    a = estimate.audit([1.0, 2.0, 1.5, 1.5])
    assert a["falls"] == 1 and a["largest_fall"] == 0.5 and a["fell_at"] == 2 and a["converged"]
    assert not estimate.audit([1.0])["converged"]


def fitted(df, by, **more):
    out = {}
    for r in sorted(estimate.fit_groups(df, by, START, 30, iterations=4, tolerance=0.0, **more).collect(), key=lambda r: r["k"]):
        out.setdefault(tuple(r[b] for b in by), []).append(r)
    return {g: (rows[0]["n"], rows[0]["source"], mixture.Mixture([r["weight"] for r in rows], [r["mean"] for r in rows], [np.reshape(r["cov"], (2, 2)) for r in rows])) for g, rows in out.items()}


def test_groups_are_fitted_as_alone(spark):
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getCheckpointDir())
    # one group has nine tenths of the rows and many blocks; one is thin; null keys are left out
    df = measured(spark, 1500, groups=lambda i: 0 if i % 10 else (1 if i % 20 else (2 if i % 100 else (3 if i else None))))
    got = fitted(df, ["g"], rows=100)
    counts = {r["g"]: r["n"] for r in df.groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert {g[0]: n for g, (n, _, _) in got.items()} == {g: n for g, n in counts.items() if g is not None}
    for (g,), (n, source, m) in got.items():
        alone, _ = estimate.fit_mixture(df.filter(F.col("g") == g), START, 4, 0.0)
        assert source == ("own" if n >= 30 else "start") and same(m, alone if n >= 30 else START, 1e-9)


def test_thin_groups_take_the_parent(spark):
    df = measured(spark, 900, groups=lambda i: i % 3 if i % 7 else 50 + i % 80).withColumn("p", F.col("g") % 2)
    got = fitted(df, ["p", "g"], parents=[["p"]], rows=64)
    whole = {p: estimate.fit_mixture(df.filter(F.col("p") == p), START, 4, 0.0)[0] for p in (0, 1)}
    assert {s for _, s, _ in got.values()} == {"own", "parent"}
    for (p, g), (n, source, m) in got.items():
        want = whole[p] if source == "parent" else estimate.fit_mixture(df.filter(F.col("g") == g), whole[p], 4, 0.0)[0]
        assert (n < 30) == (source == "parent") and same(m, want, 1e-9)


def test_choose_components(spark):
    df = measured(spark, 800)
    one = mixture.Mixture([1.0], [[1.0, 1.0]], [4.0 * np.eye(2)])
    got = estimate.choose_components(df, {1: one, 2: START}, F.col("id") % 3, iterations=8)
    plain = []
    rows = sorted(df.collect(), key=lambda r: r["id"])
    for f in range(3):
        m, _ = estimate.fit_mixture(df.filter(F.col("id") % 3 != f), START, 8)
        x = np.array([[np.nan if a is None else a for a in r["x"]] for r in rows if r["id"] % 3 == f])
        v = np.array([r["var"] for r in rows if r["id"] % 3 == f])
        plain.append(mixture.log_prob(m, np.nan_to_num(x), v, np.isfinite(x)).mean())
    assert got[2] > got[1] and abs(got[2] - np.mean(plain)) < 1e-9


MODEL = mixture.Mixture([0.5, 0.3, 0.2], [[0, 0, 0], [3, 1, 0], [0, 4, 4]], np.tile(np.eye(3) + 0.4, (3, 1, 1)))


def drawn(n, seed=4):
    x, rng = MODEL.sample(n, seed), np.random.default_rng(seed)
    var = rng.uniform(0.1, 0.5, x.shape)
    return x + rng.standard_normal(x.shape) * np.sqrt(var), var


def test_members_have_uniform_ranks():
    x, var = drawn(1500)
    seen = np.ones(x.shape, bool)
    seen[::3, 2] = False
    _, p, _, tail, status = support.support([MODEL], x, var, seen, np.ones((len(x), 1)), 0, draws=99, seed=3)
    assert set(status) == {"ok"}
    for ranks in (p, tail):
        top = np.abs(np.sort(ranks) - np.arange(1, len(x) + 1) / len(x)).max()
        assert top < 1.95 / np.sqrt(len(x)) + 0.01 and ranks.min() >= 0.01 and ranks.max() <= 1


def test_draws_follow_the_row_alone(spark):
    x, var = drawn(120)
    rows = [(i, a.tolist(), v.tolist(), [0.3, 0.7]) for i, (a, v) in enumerate(zip(x, var))]
    rows += [(500, [None, 1.0, 2.0], [0.1] * 3, [0.5, 0.5]), (501, [1.0, None, float("nan")], [0.1] * 3, [0.5, 0.5]), (502, [1.0, 1.0, 2.0], [0.1] * 3, [0.0, None]), (503, None, None, None), (504, [40.0, -40.0, 40.0], [0.1] * 3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>, var array<double>, s array<double>")
    one = {r["id"]: r for r in support.support_columns(df.repartition(7), [MODEL, TWO], 0, F.col("s"), draws=50).drop("x").collect()}
    two = {r["id"]: r for r in support.support_columns(df.coalesce(1), [MODEL, TWO], 0, F.col("s"), draws=50).drop("x").collect()}
    assert one == two
    assert [one[i]["status"] for i in (500, 501, 502, 503, 504)] == ["no_reference", "no_colour_information", "outside_support", "no_reference", "ok"]
    assert one[504]["tail"] == one[504]["percentile"] == 1 / 51 and one[500]["tail"] is None
    mixed = np.log(0.3 * np.exp(dense(MODEL, x[0], var[0])) + 0.7 * np.exp(dense(TWO, x[0], var[0])))
    assert abs(one[0]["log_density"] - mixed) < 1e-9


TWO = mixture.Mixture([0.5, 0.5], [[1, 1, 1], [-2, 0, 2]], np.tile(2 * np.eye(3), (2, 1, 1)))


def dense(m, x, var):
    """Log density of the later coordinates given the noisy first."""
    all_ = mixture.log_prob(m, x[None], var[None], np.ones((1, 3), bool))
    first = mixture.log_prob(m, x[None], var[None], np.array([[True, False, False]]))
    return float((all_ - first)[0])


def test_the_closed_tail_is_what_draws_tend_to():
    one = mixture.Mixture([1.0], MODEL.means[:1], MODEL.covs[:1])
    twice = mixture.Mixture([0.5, 0.5], np.tile(MODEL.means[:1], (2, 1)), np.tile(MODEL.covs[:1], (2, 1, 1)))
    x, var = drawn(40)
    seen, shares = np.ones(x.shape, bool), np.ones((40, 1))
    closed, sampled = (support.support([m], x, var, seen, shares, 0, draws=4000) for m in (one, twice))
    assert np.abs(closed[3] - sampled[3]).max() < 0.04 and np.allclose(closed[2], sampled[2])
    for dof in (1, 2, 3, 7):
        t = np.array([0.5, 2.0, 9.0])
        z = np.random.default_rng(dof).standard_normal((200_000, dof))
        assert np.abs(support.chi_square_tail(t, dof) - ((z * z).sum(1)[:, None] > t).mean(0)).max() < 0.005


def graph(rng, n, edges, chain):
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(edges)} | {(i, i + 1) for i in range(chain)}
    return sorted(pairs), [rng.randrange(50) for _ in range(n)]


@pytest.mark.parametrize("chain,most", [(0, 200_000), (60, 200_000), (60, 3)])
def test_keep_first_is_a_pass_in_order(spark, chain, most):
    pairs, rank = graph(random.Random(chain), 150, 160, chain)
    if chain:
        rank = list(range(150))
    near = {i: set() for i in range(150)}
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    kept = set()
    for i in sorted(range(150), key=lambda i: (rank[i], i)):
        if not near[i] & kept:
            kept.add(i)
    nodes = spark.createDataFrame([(i, rank[i]) for i in range(150)], "id long, r int")
    edges = spark.createDataFrame([(b, a) if (a + b) % 2 else (a, b) for a, b in pairs] + [(3, 3)], "l_id long, r_id long")
    got = match.first_independent(nodes, edges, F.col("r"), most=most)
    assert {r["id"] for r in got.collect()} == kept
    assert match.first_independent(nodes, edges.limit(0), F.col("r")).count() == 150


def test_spaced_selection_is_a_pass_in_order(spark):
    pairs, rank = graph(random.Random(2), 120, 90, 10)
    cell = [None if i % 17 == 0 else i % 9 for i in range(120)]
    near = {i: set() for i in range(120)}
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    kept = []
    for i in sorted(range(120), key=lambda i: (rank[i], i)):
        if not near[i] & set(kept) and sum(cell[j] == cell[i] for j in kept) < 3 and sum(j % 2 == i % 2 for j in kept) < 14:
            kept.append(i)
    nodes = spark.createDataFrame([(i, rank[i], cell[i], i % 2) for i in range(120)], "id long, r int, cell int, role int")
    got = match.spaced_selection(nodes, spark.createDataFrame(pairs, "l_id long, r_id long"), F.col("r"), {"cell": 3, "role": 14})
    assert sorted(r["id"] for r in got.collect()) == sorted(kept)


@pytest.mark.parametrize("most", [200_000, 5])
def test_greedy_chains(spark, most):
    # a chain whose separations rise, so that one pair is next at a time, and random pairs
    rng = random.Random(7)
    pairs = [(i // 2, (i + 1) // 2, 1.0 + i * 0.01) for i in range(60)] + [(100 + rng.randrange(30), 100 + rng.randrange(30), rng.random()) for _ in range(80)]
    pairs = list({(l, r): (l, r, s) for l, r, s in pairs}.values())
    used, want = (set(), set()), set()
    for l, r, s in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if l not in used[0] and r not in used[1]:
            used[0].add(l), used[1].add(r), want.add((l, r, s))
    got = match.mutual_matches(spark.createDataFrame(pairs, "l_id long, r_id long, sep double"), most=most)
    assert {tuple(r) for r in got.collect()} == want
