"""Gaussian-mixture kernels in numpy, and their Spark wrappers.

Rows carry values, variances and a presence mask; covariances are formed inside
a kernel, for rows of one mask at a time, and never stored per row. Models are
driver-sized and travel with the function.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOG_2PI = math.log(2.0 * math.pi)


@dataclass(frozen=True)
class Mixture:
    """Weights (K), means (K, d), covariances (K, d, d)."""

    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray

    def __post_init__(self):
        w, m, c = (np.asarray(x, float) for x in (self.weights, self.means, self.covs))
        if w.ndim != 1 or m.shape[0] != len(w) or c.shape != (*m.shape, m.shape[1]):
            raise ValueError("shapes of weights, means and covariances do not agree")
        if not np.isclose(w.sum(), 1.0, atol=1e-8) or (w < 0).any():
            raise ValueError("weights must be non-negative and sum to 1")
        if not np.allclose(c, np.swapaxes(c, 1, 2)):
            raise ValueError("covariances must be symmetric")
        object.__setattr__(self, "weights", w), object.__setattr__(self, "means", m), object.__setattr__(self, "covs", c)

    def marginal(self, keep) -> Mixture:
        """Of some coordinates."""
        keep = np.asarray(keep)
        return Mixture(self.weights, self.means[:, keep], self.covs[:, keep][:, :, keep])

    def condition(self, at, y, noise=None) -> Mixture:
        """Of the other coordinates, given (noisy) values at ``at``."""
        at = np.asarray(at)
        rest = np.setdiff1d(np.arange(self.means.shape[1]), at)
        saa = self.covs[:, at][:, :, at] + (0 if noise is None else np.diag(np.atleast_1d(noise)))
        sra = self.covs[:, rest][:, :, at]
        gain = np.linalg.solve(saa, np.swapaxes(sra, 1, 2)).swapaxes(1, 2)
        delta = np.atleast_1d(y) - self.means[:, at]
        means = self.means[:, rest] + np.einsum("krd,kd->kr", gain, delta)
        covs = self.covs[:, rest][:, :, rest] - gain @ np.swapaxes(sra, 1, 2)
        lw = np.log(np.maximum(self.weights, 1e-300)) + np.array([gaussian(delta[k][None], saa[k])[0] for k in range(len(delta))])
        w = np.exp(lw - lw.max())
        return Mixture(w / w.sum(), means, (covs + covs.swapaxes(1, 2)) / 2)

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        """A10."""
        mean = self.weights @ self.means
        d = self.means - mean
        return mean, np.einsum("k,kij->ij", self.weights, self.covs + d[:, :, None] * d[:, None, :])

    def project(self, h, b, t) -> Mixture:
        """The view H x + b with noise T."""
        return Mixture(self.weights, self.means @ h.T + b, h @ self.covs @ h.T + t)

    def sample(self, n: int, seed: int = 0) -> np.ndarray:
        rng = np.random.default_rng(seed)
        k = rng.choice(len(self.weights), n, p=self.weights)
        low = np.linalg.cholesky(self.covs)
        return self.means[k] + np.einsum("nij,nj->ni", low[k], rng.standard_normal((n, self.means.shape[1])))


def gaussian(delta: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Log density of rows ``delta`` (n, d); one covariance or one per row. Raises where it is not positive definite."""
    d = delta.shape[-1]
    if d == 0:
        return np.zeros(len(delta))
    low = np.linalg.cholesky(cov)
    if low.ndim == 2:
        z = np.linalg.solve(low, delta.T).T
        logdet = 2 * np.log(np.diag(low)).sum()
    else:
        z = np.linalg.solve(low, delta[..., None])[..., 0]
        logdet = 2 * np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1)
    return -0.5 * (d * LOG_2PI + logdet + (z * z).sum(-1))


def matrix(column, width: int) -> np.ndarray:
    """Rows of an Arrow list column as (n, width); null lists, lists of another length and null elements are NaN."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    some = size == width
    out = np.full((len(column), width), np.nan)
    kept = column if some.all() else column.filter(pa.array(some))
    out[some] = kept.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    return out


def posterior_sums(m: Mixture, view: tuple, y, var, seen, weight, chunk: int = 256) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """What an EM step needs of rows that measure ``H x + b`` with covariance ``T`` and own variances; ``view`` is (H, b, T).

    (sum of log densities, sum q, sum q b, sum q (B + b b')), with q the responsibilities, b and B the mean (about the
    component's) and covariance of x given the row. With u the solved residuals, b = V H'u and B = V - V H'(inverse) H V, so
    only sums of q u and q (u u' - inverse), in the measured coordinates, are taken over rows, and then carried over once.
    A chunk holds K inverses for each of its rows.
    """
    h, b, t = view
    k, d = m.means.shape
    total, q0, q1, q2 = 0.0, np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
    with np.errstate(divide="ignore"):
        lw = np.log(m.weights)
    for cols, rows in by_mask(seen):
        p = len(cols)
        if not p:
            continue
        through = h[cols] @ m.covs
        base = through @ h[cols].T + t[np.ix_(cols, cols)]
        centre = m.means @ h[cols].T + b[cols]
        s0, s1, s2 = np.zeros(k), np.zeros((k, p)), np.zeros((k, p, p))
        diagonal = np.arange(p)
        for a in range(0, len(rows), chunk):
            r = rows[a : a + chunk]
            values, noise = y[np.ix_(r, cols)], var[np.ix_(r, cols)]
            inverse, solved, lp = np.empty((k, len(r), p, p)), np.empty((k, len(r), p)), np.empty((len(r), k))
            for j in range(k):
                cov = np.repeat(base[j][None], len(r), 0)
                cov[:, diagonal, diagonal] += noise
                size = 2 * np.log(np.linalg.cholesky(cov)[:, diagonal, diagonal]).sum(1)
                inverse[j] = np.linalg.inv(cov)
                delta = values - centre[j]
                solved[j] = (inverse[j] @ delta[:, :, None])[:, :, 0]
                lp[:, j] = lw[j] - 0.5 * (p * LOG_2PI + size + (delta * solved[j]).sum(1))
            norm = log_sum_exp(lp)
            q = np.exp(lp - norm[:, None]) * weight[r, None]
            total += float(norm @ weight[r])
            for j in range(k):
                s0[j] += q[:, j].sum()
                s1[j] += q[:, j] @ solved[j]
                s2[j] += (solved[j] * q[:, j, None]).T @ solved[j] - (q[:, j] @ inverse[j].reshape(len(r), -1)).reshape(p, p)
        back = through.swapaxes(1, 2)
        q0 += s0
        q1 += (back @ s1[:, :, None])[:, :, 0]
        q2 += s0[:, None, None] * m.covs + back @ s2 @ through
    return total, q0, q1, (q2 + q2.swapaxes(1, 2)) / 2


def by_mask(observed: np.ndarray):
    """(columns, rows) for each presence pattern."""
    packed = np.packbits(observed, axis=1)
    _, first, inverse = np.unique(packed, axis=0, return_index=True, return_inverse=True)
    inverse = inverse.ravel()
    for g, i in enumerate(first):
        yield np.flatnonzero(observed[i]), np.flatnonzero(inverse == g)


def component_log_probs(m: Mixture, x: np.ndarray, var: np.ndarray, observed: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """(n, K) log densities with noise convolved and missing coordinates marginalised exactly; nothing observed gives 0."""
    out = np.zeros((len(x), len(m.weights)))
    for cols, rows in by_mask(observed):
        if not len(cols):
            continue
        for a in range(0, len(rows), chunk):
            r = rows[a : a + chunk]
            noise = var[np.ix_(r, cols)][:, :, None] * np.eye(len(cols))
            for k in range(len(m.weights)):
                out[r, k] = gaussian(x[np.ix_(r, cols)] - m.means[k, cols], m.covs[k][np.ix_(cols, cols)] + noise)
    return out


def log_sum_exp(a: np.ndarray) -> np.ndarray:
    top = a.max(1)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(a - top[:, None]).sum(1))


def log_prob(m: Mixture, x, var, observed) -> np.ndarray:
    """M02."""
    with np.errstate(divide="ignore"):
        return log_sum_exp(component_log_probs(m, x, var, observed) + np.log(m.weights))


def responsibilities(m: Mixture, x, var, observed) -> np.ndarray:
    """Rows sum to 1."""
    with np.errstate(divide="ignore"):
        lp = component_log_probs(m, x, var, observed) + np.log(m.weights)
    return np.exp(lp - log_sum_exp(lp)[:, None])


def nearest_component(m: Mixture, x, var, observed) -> np.ndarray:
    """Smallest Mahalanobis distance; NaN where nothing is observed."""
    out = np.full(len(x), np.nan)
    for cols, rows in by_mask(observed):
        if not len(cols):
            continue
        noise = var[np.ix_(rows, cols)][:, :, None] * np.eye(len(cols))
        best = np.full(len(rows), np.inf)
        for k in range(len(m.weights)):
            low = np.linalg.cholesky(m.covs[k][np.ix_(cols, cols)] + noise)
            z = np.linalg.solve(low, (x[np.ix_(rows, cols)] - m.means[k, cols])[..., None])[..., 0]
            best = np.minimum(best, np.sqrt((z * z).sum(1)))
        out[rows] = best
    return out


def conditional_log_prob(m: Mixture, x, var, observed, anchor: int) -> np.ndarray:
    """Given the noisy anchor coordinate: joint minus the anchor's marginal."""
    only = np.zeros_like(observed)
    only[:, anchor] = observed[:, anchor]
    return log_prob(m, x, var, observed) - log_prob(m, x, var, only)


def conditional_nearest(m: Mixture, x, var, observed, anchor: int) -> np.ndarray:
    """Smallest Mahalanobis distance of the other coordinates given the anchor; 0 where only the anchor is seen, NaN without it."""
    out = np.full(len(x), np.nan)
    for cols, rows in by_mask(observed):
        if anchor not in cols:
            continue
        rest = cols[cols != anchor]
        best = np.full(len(rows), 0.0 if not len(rest) else np.inf)
        for k in range(len(m.weights) if len(rest) else 0):
            gain = m.covs[k][rest, anchor] / (m.covs[k][anchor, anchor] + var[rows, anchor])[:, None]
            off = x[np.ix_(rows, rest)] - m.means[k, rest] - gain * (x[rows, anchor] - m.means[k, anchor])[:, None]
            cov = m.covs[k][np.ix_(rest, rest)] - gain[:, :, None] * m.covs[k][anchor, rest] + var[np.ix_(rows, rest)][:, :, None] * np.eye(len(rest))
            best = np.minimum(best, np.sqrt((off * np.linalg.solve(cov, off[:, :, None])[:, :, 0]).sum(1)))
        out[rows] = best
    return out


def student_t(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, dof: float) -> np.ndarray:
    """Log density of a multivariate Student t."""
    d = x.shape[1]
    if d == 0:
        return np.zeros(len(x))
    low = np.linalg.cholesky(scale)
    z = np.linalg.solve(low, (x - mean).T).T if low.ndim == 2 else np.linalg.solve(low, (x - mean)[..., None])[..., 0]
    logdet = 2 * np.log(np.diagonal(low, axis1=-2, axis2=-1)).sum(-1)
    return math.lgamma((dof + d) / 2) - math.lgamma(dof / 2) - 0.5 * d * math.log(dof * math.pi) - 0.5 * logdet - 0.5 * (dof + d) * np.log1p((z * z).sum(-1) / dof)


def student_t_noisy(x, mean, scale, noise, dof: float, nodes: int = 400) -> np.ndarray:
    """Student t convolved with Gaussian noise: an integral over the log of the gamma mixing variable."""
    t = np.linspace(-12.0, 5.0, nodes)
    g = np.exp(t)
    lw = (dof / 2) * math.log(dof / 2) - math.lgamma(dof / 2) + (dof / 2) * t - (dof / 2) * g
    step = np.full(nodes, t[1] - t[0])
    step[[0, -1]] *= 0.5
    parts = np.stack([gaussian(x - mean, scale / gi + noise) for gi in g], 1)
    return log_sum_exp(parts + lw + np.log(step))


def mixture_columns(df: DataFrame, models: dict[str, Mixture], kind: str = "log_prob", x: str = "x", var: str = "var", **kwargs) -> DataFrame:
    """``df`` with one DOUBLE column for each model: ``kind`` is ``log_prob``, ``nearest`` or ``conditional``.

    ``x`` and ``var`` are DOUBLE arrays; a coordinate is missing where its value is null or NaN or its variance is.
    """
    functions = {"log_prob": log_prob, "nearest": nearest_component, "conditional": conditional_log_prob, "conditional_nearest": conditional_nearest}
    f = functions[kind]
    width = next(iter(models.values())).means.shape[1]
    names = list(df.columns)
    inner = df.toDF(*[f"c{i}" for i in range(len(names))])
    ix, iv = names.index(x), names.index(var)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            a, v = matrix(batch.column(ix), width), matrix(batch.column(iv), width)
            seen = np.isfinite(a) & np.isfinite(v) & (v >= 0)
            a, v = np.where(seen, a, 0.0), np.where(seen, v, 0.0)
            new = [pa.array(f(m, a, v, seen, **kwargs)) if n else pa.array([], pa.float64()) for m in models.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *[f"m{i}" for i in range(len(models))]])

    schema = ", ".join([f"{c.name} {c.dataType.simpleString()}" for c in inner.schema.fields] + [f"m{i} double" for i in range(len(models))])
    return inner.mapInArrow(run, schema).toDF(*names, *models)


def diagonal_log_prob(df: DataFrame, model: DataFrame, key: str, group: str) -> DataFrame:
    """M02 for diagonal models, in DataFrame functions: (key, group, lp) from rows (key, x ARRAY) and the model (group, m ARRAY, v ARRAY).

    The model has one row for each group and travels to the rows.
    """
    terms = F.zip_with(F.zip_with("x", "m", lambda a, b: (a - b) * (a - b)), "v", lambda d, v: d / v + F.log(v) + F.lit(LOG_2PI))
    lp = F.lit(-0.5) * F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    return df.crossJoin(F.broadcast(model)).select(key, group, lp.alias("lp"))


def class_models(df: DataFrame, group: str) -> DataFrame:
    """(group, n, m, v): mean and population variance of each coordinate, combined before the shuffle."""
    parts = df.select(group, F.posexplode("x").alias("i", "v")).groupBy(group, "i").agg(F.avg("v").alias("m"), F.var_pop("v").alias("v"), F.count("*").alias("n"))
    at = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("i", c))), lambda s: s[c])
    return parts.groupBy(group).agg(F.max("n").alias("n"), at("m").alias("m"), at("v").alias("v"))
