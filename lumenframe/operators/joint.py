"""One mixture of colours and redshift together, as the alternative to redshift slices.

A row measures some colours with noise; redshift, the last coordinate, has none.
Given the colours, redshift is a one-dimensional mixture, cut to the closed support
and normalised there by the error function at its ends, so densities, masses of
windows and the chance of the support are exact, without a grid.
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

_erf = np.vectorize(math.erf, otypes=[float])
NEW = "log_density double, mass double, log_inside double, status string"


def given_colours(m: Mixture, x, var, seen, chunk: int = 2048):
    """(log weight with the colours' density, mean, variance) of redshift for each row and component; without colours, those of the model."""
    n, k, d = len(x), len(m.weights), m.means.shape[1] - 1
    with np.errstate(divide="ignore"):
        lw = np.repeat(np.log(m.weights)[None], n, 0)
    mean, spread = np.repeat(m.means[None, :, d], n, 0), np.repeat(m.covs[None, :, d, d], n, 0)
    for cols, rows in by_mask(seen):
        p = len(cols)
        for a in range(0, len(rows) if p else 0, chunk):
            r = rows[a : a + chunk]
            for j in range(k):
                cov = np.repeat(m.covs[j][np.ix_(cols, cols)][None], len(r), 0)
                cov[:, np.arange(p), np.arange(p)] += var[np.ix_(r, cols)]
                off, cross = x[np.ix_(r, cols)] - m.means[j, cols], m.covs[j][cols, d]
                solved = np.linalg.solve(cov, np.stack([off, np.broadcast_to(cross, off.shape)], 2))
                size = 2 * np.log(np.diagonal(np.linalg.cholesky(cov), axis1=1, axis2=2)).sum(1)
                lw[r, j] += -0.5 * (p * LOG_2PI + size + (off * solved[:, :, 0]).sum(1))
                mean[r, j] += solved[:, :, 0] @ cross
                spread[r, j] -= solved[:, :, 1] @ cross
    return lw, mean, spread


def mass(lw, mean, spread, lo, hi) -> np.ndarray:
    """Share of each row's mixture between ``lo`` and ``hi`` (one for each row); 0 where they cross."""
    scale = np.sqrt(2 * spread)
    part = 0.5 * (_erf((hi[:, None] - mean) / scale) - _erf((lo[:, None] - mean) / scale))
    q = np.exp(lw - log_sum_exp(lw)[:, None])
    return np.where(hi > lo, (q * np.maximum(part, 0.0)).sum(1), 0.0)


def redshift(m: Mixture, support: tuple[float, float], x, var, seen, z, lo, hi):
    """(log density at z, mass of the window, log share of the support, status) of rows.

    The window is cut to the support. A redshift that is missing or outside has status ``outside_support`` and no density; the mass of a
    window does not need one. A row whose mixture has nothing inside the support is ``no_mass``.
    """
    n = len(x)
    lw, mean, spread = given_colours(m, np.where(seen, x, 0.0), np.where(seen, var, 0.0), seen)
    ends = [np.full(n, e) for e in support]
    inside = mass(lw, mean, spread, *ends)
    status = np.full(n, "ok", object)
    known = np.isfinite(z) & (z >= support[0]) & (z <= support[1])
    status[~known] = "outside_support"
    status[~(inside > 0)] = "no_mass"
    with np.errstate(divide="ignore", invalid="ignore"):
        at = np.where(known, z, 0.0)[:, None]
        density = log_sum_exp(lw - log_sum_exp(lw)[:, None] - 0.5 * (LOG_2PI + np.log(spread) + (at - mean) ** 2 / spread)) - np.log(inside)
        window = mass(lw, mean, spread, np.maximum(lo, ends[0]), np.minimum(hi, ends[1])) / inside
        return np.where(status == "ok", density, np.nan), np.where((inside > 0) & np.isfinite(lo) & np.isfinite(hi), window, np.nan), np.log(inside), status


def redshift_columns(df: DataFrame, m: Mixture, support: tuple[float, float], z: Column, window: tuple[Column, Column], x: str = "x", var: str = "var") -> DataFrame:
    """``df`` with log_density (at ``z``), mass (of ``window``), log_inside and status; ``x`` and ``var`` hold the colours."""
    d = m.means.shape[1] - 1
    names = list(df.columns)
    inner = df.select("*", *[c.cast("double") for c in (z, *window)]).toDF(*[f"c{i}" for i in range(len(names) + 3)])
    ix, iv = names.index(x), names.index(var)

    def run(batches):
        for batch in batches:
            a, v = matrix(batch.column(ix), d), matrix(batch.column(iv), d)
            numbers = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[-3:]]
            *new, status = redshift(m, support, a, v, np.isfinite(a) & np.isfinite(v) & (v >= 0), *numbers)
            arrays = [pa.array(c, pa.float64(), from_pandas=True) for c in new] + [pa.array(status.tolist(), pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *arrays], names=[*batch.schema.names[:-3], "log_density", "mass", "log_inside", "status"])

    schema = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in inner.schema.fields[:-3])
    return inner.mapInArrow(run, f"{schema}, {NEW}").toDF(*names, "log_density", "mass", "log_inside", "status")
