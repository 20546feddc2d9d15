"""Is an object inside a model? Support percentiles and calibrated tails by draws from each object's own conditional mixture.

An object measures some coordinates, one of which is its anchor. The model, given
the noisy anchor, is a mixture of the other measured coordinates with the
object's own noise. Draws from that mixture rank the object in two ways: by log
density (the support percentile) and by distance from the nearest component (the
tail). Draws follow a hash of the object's own numbers, so they are the same on
any partitioning; objects of one mask are worked on together in Arrow batches,
draws of a few objects at a time, and no object's draws leave their task.

A mixture of one component needs no draws: its tail is that of chi-square.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixture import LOG_2PI, Mixture, by_mask, log_sum_exp, matrix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
NEW = "log_density double, percentile double, distance double, tail double, status string"


def _scrambled(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_seeds(seed: int, *columns: np.ndarray) -> np.ndarray:
    """A 64-bit seed for each row from the bits of its numbers (n, any width)."""
    h = np.full(len(columns[0]), seed, np.uint64)
    for c in columns:
        for j in range(c.shape[1]):
            h = _scrambled(h + _GOLDEN + (c[:, j].astype(float) + 0.0).view(np.uint64))
    return h


def uniforms(seeds: np.ndarray, n: int, stream: int) -> np.ndarray:
    """(rows, n) numbers in (0, 1), the same for the same seed and stream."""
    at = np.arange(1, n + 1, dtype=np.uint64) * _GOLDEN + np.uint64(stream * 0xD1342543DE82EF95 % 2**64)
    return ((_scrambled(_scrambled(seeds[:, None] + at) + _GOLDEN) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def normals(seeds: np.ndarray, n: int, stream: int) -> np.ndarray:
    """(rows, n) standard normal numbers."""
    m = (n + 1) // 2
    r, t = np.sqrt(-2 * np.log(uniforms(seeds, m, stream))), 2 * math.pi * uniforms(seeds, m, stream + 1)
    return np.concatenate([r * np.cos(t), r * np.sin(t)], 1)[:, :n]


def chi_square_tail(t: np.ndarray, dof: int) -> np.ndarray:
    """Chance that a chi-square variable of ``dof`` degrees exceeds ``t``: a finite sum."""
    half = t / 2
    if dof % 2:
        total = np.array([math.erfc(math.sqrt(h)) for h in half])
        term = np.exp(-half) * np.sqrt(half) / math.gamma(1.5)
        for i in range(1, dof // 2 + 1):
            total = total + term
            term = term * half / (i + 0.5)
        return total
    total, term = np.zeros(len(t)), np.exp(-half)
    for i in range(1, dof // 2 + 1):
        total = total + term
        term = term * half / i
    return total


def conditional(models: list[Mixture], shares: np.ndarray, x: np.ndarray, var: np.ndarray, anchor: int, rest: np.ndarray):
    """Per component of all models, for rows that measure ``anchor`` and ``rest``: (log weight (n, K), mean (n, K, J), covariance (n, K, J, J)).

    Each model is normalised given the anchor and then counts with its ``shares`` (n, models).
    """
    lw, mean, cov = [], [], []
    with np.errstate(divide="ignore"):
        for i, m in enumerate(models):
            va = m.covs[:, anchor, anchor][None] + var[:, anchor, None]
            off = x[:, anchor, None] - m.means[None, :, anchor]
            raw = np.log(m.weights)[None] - 0.5 * (LOG_2PI + np.log(va) + off * off / va)
            lw.append(raw - log_sum_exp(raw)[:, None] + np.log(shares[:, i, None]))
            cross = m.covs[:, rest, anchor]
            mean.append(m.means[None, :, rest] + cross[None] * (off / va)[:, :, None])
            own = m.covs[:, rest][:, :, rest][None] - cross[None, :, :, None] * cross[None, :, None, :] / va[:, :, None, None]
            diagonal = np.arange(len(rest))
            own[:, :, diagonal, diagonal] += var[:, None, rest]
            cov.append(own)
    return np.concatenate(lw, 1), np.concatenate(mean, 1), np.concatenate(cov, 1)


def _ranked(lw, mean, cov, x, seeds, draws: int):
    """(log density, percentile, distance, tail) of rows ``x`` (n, J) under their own mixtures."""
    n, k, j = mean.shape
    low = np.linalg.cholesky((cov + cov.swapaxes(2, 3)) / 2)
    half = np.log(np.diagonal(low, axis1=2, axis2=3)).sum(2)

    def measured(y):
        """(log density, smallest squared distance) of points (n, D, J)."""
        best, lp = np.full(y.shape[:2], np.inf), np.full((n, y.shape[1], k), -np.inf)
        for c in range(k):
            z = np.linalg.solve(low[:, c], (y - mean[:, c, None]).swapaxes(1, 2))
            t = (z * z).sum(1)
            used = lw[:, c] > -np.inf
            best = np.where(used[:, None], np.minimum(best, t), best)
            lp[:, :, c] = lw[:, c, None] - 0.5 * (j * LOG_2PI + t) - half[:, c, None]
        return log_sum_exp(lp.reshape(-1, k)).reshape(n, -1), best

    logp, t = (a[:, 0] for a in measured(x[:, None]))
    if k == 1:
        p = chi_square_tail(t, j)
        return logp, p, np.sqrt(t), p
    upto = np.cumsum(np.exp(lw - lw.max(1)[:, None]), 1)
    u = uniforms(seeds, draws, 0) * upto[:, -1:]
    which = (u[:, :, None] >= upto[:, None, :]).sum(2).clip(0, k - 1)
    e = normals(seeds, draws * j, 1).reshape(n, draws, j)
    row = np.arange(n)[:, None]
    y = mean[row, which] + (low[row, which] @ e[..., None])[..., 0]
    dp, dt = measured(y)
    return logp, (1 + (dp <= logp[:, None]).sum(1)) / (draws + 1), np.sqrt(t), (1 + (dt >= t[:, None]).sum(1)) / (draws + 1)


def support(models: list[Mixture], x, var, seen, shares, anchor, draws: int = 256, seed: int = 0, numbers: int = 1 << 21):
    """(log density, percentile, distance, tail, status) of rows; ``anchor`` is one coordinate or one for each row.

    ``percentile`` is (1 + draws of no higher density) / (draws + 1), ``tail`` (1 + draws at least as far from every
    component) / (draws + 1). Rows without their anchor, with nothing else, or with no share of any model have NaN and say why.
    """
    n = len(x)
    out = [np.full(n, np.nan) for _ in range(4)]
    status = np.full(n, "ok", object)
    anchor = np.broadcast_to(anchor, n)
    status[~(shares > 0).any(1)] = "outside_support"
    status[seen.sum(1) < 2] = "no_colour_information"
    status[~seen[np.arange(n), anchor]] = "no_reference"
    good = np.flatnonzero(status == "ok")
    x, var = np.where(seen, x, 0.0), np.where(seen, var, 0.0)
    shares = np.where(shares > 0, shares, 0.0)
    seeds = row_seeds(seed, x, var, seen, shares, anchor[:, None])
    total = sum(len(m.weights) for m in models)
    for a in np.unique(anchor[good]):
        some = good[anchor[good] == a]
        for cols, rows in by_mask(seen[some]):
            rest = cols[cols != a]
            # the largest temporaries hold draws x (coordinates or components) and components x coordinates squared
            chunk = max(1, numbers // max(draws * (2 * len(rest) ** 2 + total), total * len(rest) ** 2))
            for i in range(0, len(rows), chunk):
                r = some[rows[i : i + chunk]]
                parts = conditional(models, shares[r], x[r], var[r], int(a), rest)
                for o, v in zip(out, _ranked(*parts, x[np.ix_(r, rest)], seeds[r], draws)):
                    o[r] = v
    return (*out, status)


def support_columns(df: DataFrame, models: list[Mixture], anchor: int | Column, shares: Column | None = None, draws: int = 256, seed: int = 0, x: str = "x", var: str = "var") -> DataFrame:
    """``df`` with log_density, percentile, distance, tail and status.

    ``shares`` is an array with the share of each model for the row (as interpolation between slices gives), equal if absent; ``anchor`` may
    differ from row to row. A coordinate is missing where its value or variance is null or NaN; null shares are 0.
    """
    d = models[0].means.shape[1]
    names = list(df.columns)
    inner = df.select("*", (F.lit(anchor) if isinstance(anchor, int) else anchor).cast("int"), (F.array(*[F.lit(1.0 / len(models))] * len(models)) if shares is None else shares).cast("array<double>"))
    inner = inner.toDF(*[f"c{i}" for i in range(len(names) + 2)])
    ix, iv = names.index(x), names.index(var)

    def run(batches):
        for batch in batches:
            cols = batch.columns
            a, v, s = matrix(cols[ix], d), matrix(cols[iv], d), np.nan_to_num(matrix(cols[-1], len(models)))
            at = np.nan_to_num(cols[-2].to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(int)
            seen = np.isfinite(a) & np.isfinite(v) & (v >= 0)
            known = (at >= 0) & (at < d)
            *new, status = support(models, a, v, seen & known[:, None], s, np.where(known, at, 0), draws, seed)
            arrays = [pa.array(c, pa.float64(), from_pandas=True) for c in new] + [pa.array(status.tolist(), pa.string())]
            yield pa.RecordBatch.from_arrays([*cols[:-2], *arrays], names=[*batch.schema.names[:-2], "log_density", "percentile", "distance", "tail", "status"])

    schema = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in inner.schema.fields[:-2])
    return inner.mapInArrow(run, f"{schema}, {NEW}").toDF(*names, "log_density", "percentile", "distance", "tail", "status")


def slice_shares(z: Column, centres: list[float], low: float, high: float) -> Column:
    """The shares of redshift slices at ``z`` by linear interpolation between centres; none outside the closed support, the end slice beyond the end centres."""
    n = len(centres)
    out = []
    for i, c in enumerate(centres):
        left = F.lit(1.0) if i == 0 else F.least(F.lit(1.0), (z - F.lit(centres[i - 1])) / F.lit(c - centres[i - 1]))
        right = F.lit(1.0) if i == n - 1 else F.least(F.lit(1.0), (F.lit(centres[i + 1]) - z) / F.lit(centres[i + 1] - c))
        out.append(F.greatest(F.lit(0.0), F.least(left, right)))
    inside = z.isNotNull() & ~F.isnan(z) & (z >= low) & (z <= high)
    return F.transform(F.array(*out), lambda s: F.when(inside, s).otherwise(F.lit(0.0)))


def outside_both(member: Column, background: Column, threshold: float) -> Column:
    """Outside both models: both calibrated tails are under ``threshold``; a model that cannot say does not object."""
    small = lambda p: p.isNotNull() & ~F.isnan(p) & (p < threshold)
    return small(member) & small(background)
