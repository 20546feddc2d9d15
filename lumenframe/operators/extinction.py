"""Extinction: a spline curve in inverse wavelength, band coefficients from filter curves, sampling of sky rasters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the published curve: anchor wavelengths in Angstrom, infrared values at R_V = 3.1, polynomials in R_V
# of the optical values, lowest power first, and the ultraviolet bump (centre, width, strength).
WAVES = (26500.0, 12200.0, 6000.0, 5470.0, 4670.0, 4110.0, 2700.0, 2600.0)
INFRARED = (0.26469, 0.82925)
OPTICAL = (
    (-4.22809e-01, 1.00270, 2.13572e-04),
    (-5.13540e-02, 1.00216, -7.35778e-05),
    (7.00127e-01, 1.00184, -3.32598e-05),
    (1.19456, 1.01707, -5.46959e-03, 7.97809e-04, -4.45636e-05),
)
BUMP = (4.596, 0.99, 3.23)
#: h c / k in Angstrom Kelvin.
HCK = 1.4387769e8
SHORTEST = 2700.0


def anchors(r_v: float = 3.1) -> tuple[np.ndarray, np.ndarray]:
    """Inverse wavelengths (1 / micron, from 0) and A / E(B-V) there."""
    x = np.r_[0.0, 1e4 / np.array(WAVES)]
    centre, width, strength = BUMP
    slope = 4.717 / r_v - 0.824
    u = x[-2:] ** 2
    ultraviolet = r_v + 2.030 - 3.007 * slope + slope * x[-2:] + strength * u / ((u - centre**2) ** 2 + u * width**2)
    optical = [np.polynomial.polynomial.polyval(r_v, c) for c in OPTICAL]
    return x, np.r_[0.0, np.array(INFRARED) * r_v / 3.1, optical, ultraviolet]


def natural_spline(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A row for each interval: its left end and the coefficients of 1, d, d^2 and d^3; the curvature is zero at both ends."""
    h, rise = np.diff(x), np.diff(y) / np.diff(x)
    system = np.diag(np.r_[1.0, 2.0 * (h[:-1] + h[1:]), 1.0]) + np.diag(np.r_[h[:-1], 0.0], -1) + np.diag(np.r_[0.0, h[1:]], 1)
    bend = np.linalg.solve(system, np.r_[0.0, 6.0 * np.diff(rise), 0.0])
    return np.c_[x[:-1], y[:-1], rise - h * (2.0 * bend[:-1] + bend[1:]) / 6.0, bend[:-1] / 2.0, np.diff(bend) / (6.0 * h)]


def curve(wave: Column, r_v: float = 3.1) -> Column:
    """P25: A / E(B-V) at a wavelength in Angstrom; null below 2700, where the spline does not hold."""
    x = F.lit(1e4) / wave
    out = None
    for lo, *c in natural_spline(*anchors(r_v)).tolist():
        d = x - F.lit(lo)
        piece = F.lit(c[0]) + d * (F.lit(c[1]) + d * (F.lit(c[2]) + d * F.lit(c[3])))
        out = piece if out is None else F.when(x >= lo, piece).otherwise(out)
    return F.when(wave >= SHORTEST, out)


def band_coefficients(curves: DataFrame, temperature: float = 7000.0, reddening: float = 0.01, r_v: float = 3.1) -> DataFrame:
    """P25: (band, wave, transmission) to (band, coefficient): the change of a black body's photon-counting magnitude by a small reddening, over that reddening.

    Nodes of a band are distinct; a band with one node, with no transmission or with nodes below 2700 Angstrom that let light through has none.
    """
    w = F.col("wave").cast("double")
    photons = F.col("transmission") * F.pow(w, F.lit(-4.0)) / (F.exp(F.lit(HCK) / (w * F.lit(temperature))) - F.lit(1.0))
    dim = F.pow(F.lit(10.0), F.lit(-0.4 * reddening) * curve(w, r_v))
    nodes = curves.select("band", w.alias("w"), photons.alias("s"), F.when(photons == 0.0, F.lit(0.0)).otherwise(photons * dim).alias("t"))
    by = Window.partitionBy("band").orderBy("w")
    width = F.col("w") - F.lag("w").over(by)
    steps = nodes.select("band", *[((F.col(c) + F.lag(c).over(by)) * width).alias(c) for c in ("s", "t")], (F.col("s").isNotNull() & F.col("t").isNull()).alias("dark"))
    sums = steps.groupBy("band").agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.count("t").alias("n"), F.count("s").alias("m"))
    whole = (F.col("n") == F.col("m")) & (F.col("s") > 0.0)
    return sums.select("band", F.when(whole, F.lit(-2.5 / reddening) * F.log10(F.col("t") / F.col("s"))).alias("coefficient"))


def native_coefficients(matrix: DataFrame, latent: DataFrame) -> DataFrame:
    """(native, latent, h) and (latent, r) to (native, r): the observation matrix applied to the latent channels' coefficients; null where one lacks its own."""
    x = matrix.join(latent, "latent", "left")
    return x.groupBy("native").agg(F.when(F.count("r") == F.count("*"), F.sum(F.col("h") * F.col("r"))).alias("r"))


def zenithal(l: Column, b: Column, size: int) -> tuple[Column, Column, Column]:
    """Side (1 north, -1 south) and the (x, y) of a galactic position on that side's equal-area raster of ``size`` squared pixels."""
    side = F.when(b >= 0, F.lit(1)).otherwise(F.lit(-1))
    reach = F.lit(size / 2.0) * F.sqrt(F.lit(1.0) - side * F.sin(F.radians(b)))
    middle = F.lit((size - 1) / 2.0)
    return side, reach * F.cos(F.radians(l)) + middle, middle - side * reach * F.sin(F.radians(l))


def sample_raster(points: DataFrame, raster: DataFrame, size: int, key: str = "id") -> DataFrame:
    """(key, value): the raster (side, y, x, value) between the four pixels around each point of galactic (l, b), clamped at its edge.

    An equi-join by pixel, so neither side is broadcast by hand; ``key`` names a row. Null where a pixel that counts is not in the raster.
    """
    side, x, y = zenithal(F.col("l"), F.col("b"), size)
    at = points.select(key, side.alias("side"), x.alias("x_"), y.alias("y_"))

    def corners(c: str):
        low = F.floor(c)
        part = F.col(c) - low
        pixel = lambda v: F.greatest(F.lit(0), F.least(F.lit(size - 1), v)).cast("long")
        return [(pixel(low), F.lit(1.0) - part), (pixel(low + 1), part)]

    four = [F.struct(i.alias("x"), j.alias("y"), (u * v).alias("w")) for i, u in corners("x_") for j, v in corners("y_")]
    cut = at.select(key, "side", F.explode(F.array(*four)).alias("p")).select(key, "side", "p.*").filter("w > 0 or w is null")
    found = cut.join(raster, ["side", "y", "x"], "left")
    return found.groupBy(key).agg(F.when(F.count("value") == F.count("*"), F.sum(F.col("w") * F.col("value"))).alias("value"))
