"""Column functions on measurements: magnitudes, asinh scales, extinction, windows, log-domain sums."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POGSON = 2.5 / math.log(10.0)
ZERO_POINT = 22.5
LIGHT_KM_S = 299792.458


def quantise(x: Column, digits: int = 6) -> Column:
    """Round half up on the scaled value, and no negative zero: equal on engines whose ``round`` differs in ties."""
    return F.floor(x * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits) + F.lit(0.0)


def flux_to_mag(flux: Column) -> Column:
    """P01. Null where the flux is not positive."""
    return F.when(flux > 0, F.lit(ZERO_POINT) - F.lit(2.5) * F.log10(flux))


def mag_to_flux(mag: Column) -> Column:
    """P02."""
    return F.pow(F.lit(10.0), (F.lit(ZERO_POINT) - mag) / F.lit(2.5))


def mag_error_to_flux(mag: Column, error: Column) -> Column:
    """P02."""
    return F.lit(1.0 / POGSON) * mag_to_flux(mag) * error


def scale_to_native(value: Column, zero_point: float) -> Column:
    """Counts under another zero point (23.9: microjansky) to native flux."""
    return value * F.lit(10.0 ** (0.4 * (ZERO_POINT - zero_point)))


def variance_of(error: Column, kind: str) -> Column:
    """From an inverse variance (``ivar``), an error (``sigma``) or itself; null where unusable."""
    if kind == "ivar":
        return F.when(error > 0, F.lit(1.0) / error)
    return F.when(error > 0, error * error if kind == "sigma" else error)


def asinh_mag(flux: Column, softening: float) -> Column:
    """P06."""
    return F.lit(ZERO_POINT) - F.lit(POGSON) * (F.asinh(flux / F.lit(2.0 * softening)) + F.lit(math.log(softening)))


def asinh_slope(flux: Column, softening: float) -> Column:
    """D magnitude / d flux."""
    return F.lit(-POGSON) / F.sqrt(flux * flux + F.lit(4.0 * softening * softening))


def inverse_asinh_mag(mag: Column, softening: float) -> Column:
    """P07."""
    return F.lit(2.0 * softening) * F.sinh((F.lit(ZERO_POINT) - mag) / F.lit(POGSON) - F.lit(math.log(softening)))


def deredden_flux(flux: Column, reddening: Column, coefficient: float) -> Column:
    """P12."""
    return flux * F.pow(F.lit(10.0), F.lit(0.4 * coefficient) * reddening)


def deredden_variance(variance: Column, reddening: Column, coefficient: float) -> Column:
    """P12."""
    return variance * F.pow(F.lit(10.0), F.lit(0.8 * coefficient) * reddening)


def by_transmission(flux: Column, ivar: Column, transmission: Column) -> tuple[Column, Column]:
    """Flux and inverse variance outside the dust; unusable where nothing is transmitted."""
    good = transmission > 0
    return F.when(good, flux / transmission), F.when(good, ivar * transmission * transmission)


def snr(flux: Column, variance: Column) -> Column:
    """P18."""
    return F.when(flux.isNotNull() & (variance > 0), flux / F.sqrt(variance))


def velocity_difference(z0: Column, z1: Column) -> Column:
    """P19, km/s."""
    return F.abs(z1 - z0) / (F.lit(1.0) + z0) * F.lit(LIGHT_KM_S)


def top_hat_weight(z: Column, centre: Column, half_width: float) -> Column:
    """P20: 1 within the window, its ends included."""
    return F.when(F.abs(z - centre) <= F.lit(half_width), F.lit(1.0)).otherwise(F.lit(0.0))


def gaussian_window(z: Column, centre: Column, half_width: float) -> Column:
    """P20: a Gaussian of the same area as the top hat."""
    sigma = 2.0 * half_width / math.sqrt(2.0 * math.pi)
    return F.exp(F.lit(-0.5) * F.pow((z - centre) / F.lit(sigma), F.lit(2.0)))


def logistic(x: Column) -> Column:
    """P26."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: Column) -> Column:
    """P26."""
    return F.log(p) - F.log(F.lit(1.0) - p)


def recalibrate(p: Column, alpha: float, beta: float) -> Column:
    """P26."""
    return logistic(F.lit(alpha) + F.lit(beta) * logit(p))


def log_sum_exp(*terms: Column) -> Column:
    """P27, with the largest term taken out."""
    top = F.greatest(*terms)
    total = F.exp(terms[0] - top)
    for t in terms[1:]:
        total = total + F.exp(t - top)
    return top + F.log(total)


def log_thinning(t: Column) -> Column:
    """-log1p(exp(-t))."""
    return -F.log1p(F.exp(-t))


def let(body, **values: Column) -> Column:
    """``body`` of a struct of ``values``, each computed once however often it is used: no growth of nested expressions."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), 0)


def trapezoid(x: Column, y: Column) -> Column:
    """P28 over two arrays of equal length."""

    def area(p):
        x, y = p["x"], p["y"]
        parts = F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda i: (F.get(y, i - 1) + F.get(y, i)) * F.lit(0.5) * (F.get(x, i) - F.get(x, i - 1)))
        return F.when(F.size(x) > 1, F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)).otherwise(F.lit(0.0))

    return let(area, x=x, y=y)


def valid_id(text: Column) -> Column:
    """Digits only, 1 to 2**63 - 1; null otherwise."""
    number = text.try_cast("long")
    return F.when(text.rlike("^[0-9]{1,19}$") & (number > 0), number)


def split_label(label: Column) -> tuple[Column, Column]:
    """Survey and band of ``survey:band``."""
    return F.get(F.split(label, ":"), 0), F.get(F.split(label, ":"), 1)


def hashed_fraction(key: Column) -> Column:
    """A deterministic number in 0..99 from the md5 of a key."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 100


def point_source_limit(c: Column) -> Column:
    """Piecewise polynomial in a colour; fixed values of the published excess-factor relation."""
    blue = F.lit(1.154360) + F.lit(0.033772) * c + F.lit(0.032277) * c * c
    mid = F.lit(1.162004) + F.lit(0.011464) * c + F.lit(0.049255) * c * c - F.lit(0.005879) * c * c * c
    red = F.lit(1.057572) + F.lit(0.140537) * c
    return F.when(c < 0.5, blue).when(c < 4.0, mid).otherwise(red)
