"""Calibrations fitted on rows where they are: colour maps, clipped polynomials, logistic selections, softmax gates, splines and tabulated priors.

Passes send back sums whose size depends on the number of parameters alone.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def polynomial(x: Column, coefficients) -> Column:
    """Increasing powers, by Horner's rule."""
    out = F.lit(float(coefficients[-1]))
    for c in reversed(list(coefficients)[:-1]):
        out = out * x + F.lit(float(c))
    return out


def colour_map(bands: list[Column], coefficients: np.ndarray, bounds: tuple[float, float]) -> tuple[list[Column], list[Column]]:
    """Bands less polynomials of the colour ``first - last``, clipped to ``bounds``; and d correction / d colour, 0 outside.

    ``coefficients`` is (powers, bands). The Jacobian is the identity less the slope in the first column, plus it in the last.
    """
    raw = bands[0] - bands[-1]
    low, high = (F.lit(float(b)) for b in bounds)
    colour = F.least(F.greatest(raw, low), high)
    c = np.asarray(coefficients, float)
    slopes = (c * np.arange(len(c))[:, None])[1:]
    inside = (raw > low) & (raw < high)
    return [b - polynomial(colour, c[:, i]) for i, b in enumerate(bands)], [F.when(raw.isNull(), None).when(inside, polynomial(colour, slopes[:, i])).otherwise(0.0) for i in range(len(bands))]


def affine_map(bands: list[Column], matrix, offset) -> list[Column]:
    """``matrix`` times the bands, plus ``offset``; null where any band is."""
    return [sum((b * F.lit(float(w)) for b, w in zip(bands, row)), F.lit(float(o))) for row, o in zip(np.asarray(matrix, float), offset)]


def _normal(rows: DataFrame, design: list[Column], y: Column, keep: Column) -> np.ndarray:
    """Least squares from the sums of products, one pass."""
    d = len(design)
    sums = [F.sum(F.when(keep, design[i] * design[j])) for i in range(d) for j in range(i, d)] + [F.sum(F.when(keep, design[i] * y)) for i in range(d)]
    got = list(rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first())
    if any(g is None for g in got):
        raise ValueError("no rows to fit")
    gram = np.zeros((d, d))
    gram[np.triu_indices(d)] = got[: -d]
    return np.linalg.solve(gram + np.triu(gram, 1).T, np.array(got[-d:]))


def fit_polynomial(df: DataFrame, x: str, y: str, degree: int = 3, sigma: float = 3.0, iterations: int = 5, accuracy: int = 100_000) -> tuple[np.ndarray, int]:
    """Least squares, each time on rows within ``sigma`` of 1.4826 times the median absolute deviation; (coefficients, rows kept).

    Medians come from mergeable summaries, within 1 / ``accuracy`` of the rank. Rows with nulls or NaN have no part.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)").persist()
    design = [F.lit(1.0)]
    for _ in range(degree):
        design.append(design[-1] * F.col("x"))
    keep = F.lit(True)
    try:
        c = _normal(rows, design, F.col("y"), keep)
        for _ in range(iterations):
            residual = F.col("y") - polynomial(F.col("x"), c)
            median = rows.agg(F.percentile_approx(F.when(keep, residual), 0.5, accuracy)).first()[0]
            off = F.abs(residual - F.lit(median))
            scale = 1.4826 * rows.agg(F.percentile_approx(F.when(keep, off), 0.5, accuracy)).first()[0]
            keep = off <= F.lit(sigma * max(scale, float(np.finfo(float).eps)))
            c = _normal(rows, design, F.col("y"), keep)
        return c, rows.filter(keep).count()
    finally:
        rows.unpersist()


def fit_logistic(df: DataFrame, features: list[Column], label: Column, weight: Column | None = None, prior=None, sd=None, iterations: int = 25, tolerance: float = 1e-10) -> np.ndarray:
    """Weighted logistic regression by Newton steps on summed gradients and curvatures; Gaussian ``prior`` (means) and ``sd`` if given."""
    d = len(features)
    w = F.lit(1.0) if weight is None else weight
    rows = df.select(*[f.cast("double").alias(f"f{i}") for i, f in enumerate(features)], label.cast("double").alias("y"), w.cast("double").alias("w")).na.drop().persist()
    mean = np.zeros(d) if prior is None else np.asarray(prior, float)
    pull = np.zeros(d) if sd is None else 1.0 / np.asarray(sd, float) ** 2
    theta = mean.copy()
    f = [F.col(f"f{i}") for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    try:
        for _ in range(iterations):
            z = sum((f[i] * F.lit(float(theta[i])) for i in range(d)), F.lit(0.0))
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
            step = rows.withColumn("p", p).withColumn("g", F.col("w") * (F.col("y") - F.col("p"))).withColumn("h", F.col("w") * F.col("p") * (1 - F.col("p")))
            got = step.agg(*[F.sum(F.col("g") * x).alias(f"g{i}") for i, x in enumerate(f)], *[F.sum(F.col("h") * f[i] * f[j]).alias(f"h{i}_{j}") for i, j in pairs]).first()
            if got[0] is None:
                return theta
            curve = np.diag(pull + 1e-12)
            for (i, j), v in zip(pairs, got[d:]):
                curve[i, j] += v
                if i != j:
                    curve[j, i] += v
            move = np.linalg.solve(curve, np.array(got[:d]) - pull * (theta - mean))
            move *= min(1.0, 5.0 / max(np.abs(move).max(), 1e-300))
            theta = theta + move
            if np.abs(move).max() < tolerance:
                break
    finally:
        rows.unpersist()
    return theta


def spline_basis(x: Column, knots, degree: int = 3) -> list[Column]:
    """The B-splines over ``knots`` at ``x``, by recursion on the degree; the last interval includes its end."""
    t = [float(k) for k in knots]
    last = max(i for i in range(len(t) - 1) if t[i] < t[i + 1])
    cell = [F.when((x >= t[i]) & ((x <= t[i + 1]) if i == last else (x < t[i + 1])), 1.0).otherwise(0.0) if t[i] < t[i + 1] else F.lit(0.0) for i in range(len(t) - 1)]
    for k in range(1, degree + 1):
        rise = [(x - t[i]) / (t[i + k] - t[i]) if t[i + k] > t[i] else F.lit(0.0) for i in range(len(cell))]
        cell = [rise[i] * cell[i] + ((1 - rise[i + 1]) if t[i + 1 + k] > t[i + 1] else F.lit(0.0)) * cell[i + 1] for i in range(len(cell) - 1)]
    return cell


def gate_log_weights(features: list[Column], a, beta) -> Column:
    """Log proportions of K components, ``softmax(a + features . beta)``, as an array."""
    logits = F.array(*[sum((f * F.lit(float(b)) for f, b in zip(features, col)), F.lit(float(s))) for s, col in zip(a, np.asarray(beta, float).T)])
    # an array of one binds the logits, then their norm, so that neither is written out once per component
    norm = lambda l: F.array_max(l) + F.log(F.aggregate(l, F.lit(0.0), lambda s, v: s + F.exp(v - F.array_max(l))))  # noqa: E731, E741
    bound = F.transform(F.array(logits), lambda l: F.struct(l.alias("l"), norm(l).alias("n")))  # noqa: E741
    return F.get(F.transform(bound, lambda s: F.transform(s["l"], lambda v: v - s["n"])), F.lit(0))


def weighted_log_density(lp: Column, log_weights: Column) -> Column:
    """Log of the weighted sum over components, both arrays."""
    both = F.zip_with(lp, log_weights, lambda a, b: a + b)
    top = F.array_max(both)
    return top + F.log(F.aggregate(both, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def _gate_pass(theta: np.ndarray, k: int, nf: int):
    a, beta = theta[:k], theta[k:].reshape(nf, k)

    def run(batches):
        from pyspark import TaskContext

        loss, ga, gb, n = 0.0, np.zeros(k), np.zeros((nf, k)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lp = np.asarray(batch.column(0).flatten(), float).reshape(-1, k)
            f = np.asarray(batch.column(1).flatten(), float).reshape(-1, nf)
            logits = a + f @ beta
            top = logits.max(1, keepdims=True)
            lw = logits - top - np.log(np.exp(logits - top).sum(1, keepdims=True))
            joint = lw + lp
            top = joint.max(1, keepdims=True)
            e = np.exp(joint - top)
            total = e.sum(1, keepdims=True)
            loss -= float((np.log(total) + top).sum())
            g = np.exp(lw) - e / total
            ga, gb, n = ga + g.sum(0), gb + f.T @ g, n + len(lp)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([n], pa.int64()), "loss": pa.array([loss]), "g": pa.array([np.concatenate([ga, gb.ravel()]).tolist()], pa.list_(pa.float64()))})

    return run


def minimise(f, x: np.ndarray, steps: int = 100, memory: int = 8, tolerance: float = 1e-6) -> tuple[np.ndarray, bool]:
    """Quasi-Newton with limited memory; ``f`` gives value and gradient. Returns the place and whether the gradient vanished there."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max() <= tolerance * max(1.0, abs(value)):
            return x, True
        q, kept = g.copy(), []
        for s, y in reversed(past):
            c = (s @ q) / (y @ s)
            q -= c * y
            kept.append(c)
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1.0 / max(1.0, np.abs(g).sum())
        for (s, y), c in zip(past, reversed(kept)):
            q += (c - (y @ q) / (y @ s)) * s
        size, slope = 1.0, -(q @ g)
        if slope >= 0:
            q, slope, past = g.copy(), -(g @ g), []
        while True:
            new = x - size * q
            new_value, new_g = f(new)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
            if size < 1e-12:
                return x, False
        s, y = new - x, new_g - g
        if s @ y > 1e-12 * (y @ y):
            past = [*past, (s, y)][-memory:]
        x, value, g = new, new_value, new_g
    return x, False


def fit_gate(df: DataFrame, lp: str, features: str, start, ridge: float = 1.0, steps: int = 100) -> dict:
    """``a`` (K) and ``beta`` (features, K) of greatest likelihood for fixed component densities; ``ridge`` holds ``beta`` alone.

    ``lp`` and ``features`` are arrays without nulls, every row of one length.
    """
    rows = df.select(F.col(lp).cast("array<double>").alias("lp"), F.col(features).cast("array<double>").alias("f")).na.drop().persist()
    try:
        first = rows.first()
        if first is None:
            raise ValueError("no rows to fit")
        k, nf = len(first["lp"]), len(first["f"])

        def objective(theta):
            got = sorted(rows.mapInArrow(_gate_pass(theta, k, nf), "part int, n long, loss double, g array<double>").collect(), key=lambda r: r["part"])
            n = sum(r["n"] for r in got)
            beta = theta[k:]
            pull = np.concatenate([np.zeros(k), ridge * beta])
            return (sum(r["loss"] for r in got) + 0.5 * ridge * float(beta @ beta)) / n, (np.sum([r["g"] for r in got], 0) + pull) / n

        theta, converged = minimise(objective, np.concatenate([np.log(np.maximum(start, 1e-12)), np.zeros(nf * k)]), steps)
    finally:
        rows.unpersist()
    return {"a": theta[:k], "beta": theta[k:].reshape(nf, k), "converged": converged}


class Monotone:
    """Cubic pieces that keep the order of the data (harmonic-mean slopes inside, one-sided and limited at the ends); held at the ends outside."""

    def __init__(self, x, y):
        self.x, self.y = np.asarray(x, float), np.asarray(y, float)
        h, d = np.diff(self.x), np.diff(self.y) / np.diff(self.x)
        m = np.zeros(len(self.x))
        if len(h) == 1:
            m[:] = d[0]
        else:
            same = d[:-1] * d[1:] > 0
            w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                m[1:-1] = np.where(same, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0.0)
            for at, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))):
                end = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
                if end * d0 <= 0:
                    end = 0.0
                elif d0 * d1 < 0 and abs(end) > 3 * abs(d0):
                    end = 3 * d0
                m[at] = end
        self.m, self.h = m, h

    def __call__(self, at):
        at = np.clip(np.asarray(at, float), self.x[0], self.x[-1])
        i = np.clip(np.searchsorted(self.x, at, side="right") - 1, 0, len(self.h) - 1)
        h = self.h[i]
        t = (at - self.x[i]) / h
        r = 1 - t
        return r * r * ((1 + 2 * t) * self.y[i] + t * h * self.m[i]) + t * t * ((3 - 2 * t) * self.y[i + 1] - r * h * self.m[i + 1])


def luminosity_prior(counts: np.ndarray, count_edges, magnitudes, z_edges, at_magnitudes) -> np.ndarray:
    """A density (z cells, magnitudes) from counts per unit of z tabulated by (magnitude, z bin).

    The running total in z is interpolated monotonically and differenced, so cells keep the table's totals; the log of
    the density is linear in magnitude, also past the ends.
    """
    z_edges, at_magnitudes, magnitudes, edges = (np.asarray(v, float) for v in (z_edges, at_magnitudes, magnitudes, count_edges))
    cells = []
    for row in np.asarray(counts, float):
        total = Monotone(edges, np.concatenate([[0.0], np.cumsum(row * np.diff(edges))]))
        cells.append(np.diff(total(z_edges)) / np.diff(z_edges))
    logs = np.log10(np.maximum(np.array(cells).T, 1e-30))
    i = np.clip(np.searchsorted(magnitudes, at_magnitudes) - 1, 0, len(magnitudes) - 2)
    t = (at_magnitudes - magnitudes[i]) / (magnitudes[i + 1] - magnitudes[i])
    return 10.0 ** (logs[:, i] * (1 - t) + logs[:, i + 1] * t)


def in_other_band(density: DataFrame, by: list[str], m: str, value: str, step: float, targets: list[float], offset: float, scatter: float) -> DataFrame:
    """(by, m_new, value): a tabulated density over ``m`` (cells ``step`` wide) in another band, whose magnitude is Gaussian about ``m + offset``.

    ``targets`` are the new cells' centres, a list of parameters; each row goes to every one of them, then sums by group.
    """
    grid = F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("m_new")
    norm = step / (scatter * math.sqrt(2 * math.pi))
    rows = density.select(*by, F.col(m).alias("_m"), F.col(value).alias("_v"), grid)
    off = (F.col("m_new") - F.col("_m") - F.lit(offset)) / F.lit(scatter)
    return rows.groupBy(*by, "m_new").agg(F.sum(F.col("_v") * F.lit(norm) * F.exp(F.lit(-0.5) * off * off)).alias(value))
