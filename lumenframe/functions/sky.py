"""Sphere geometry as column functions: unit vectors, separations, rotations, nested equal-area pixels."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import let

#: The J2000 rotation from equatorial to Galactic axes.
GALACTIC = (
    (-0.0548755604, -0.8734370902, -0.4838350155),
    (0.4941094279, -0.4448296300, 0.7469822445),
    (-0.8676661490, -0.1980763734, 0.4559837762),
)


def unit_vector(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    """P30."""
    a, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def chord2(a: tuple, b: tuple) -> Column:
    """Squared chord of two unit vectors: no loss at small angles."""
    return sum(((p - q) * (p - q) for p, q in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0]))


def separation_deg(c2: Column) -> Column:
    """The angle of a squared chord, in degrees."""
    return F.degrees(F.lit(2.0) * F.asin(F.sqrt(F.least(F.lit(1.0), c2 / F.lit(4.0)))))


def exact_asin_deg(x: Column) -> Column:
    """The arc sine in degrees, as the C library rounds it."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([math.asin(x) * (180.0 / math.pi) if -1.0 <= x <= 1.0 else math.nan for x in v.tolist()], dtype="float64")

    return run(x)


def exact_unit_vector(ra: Column, dec: Column) -> Column:
    """A struct x, y, z, as the C library rounds it."""

    @F.pandas_udf("x double, y double, z double")
    def run(a: pd.Series, d: pd.Series) -> pd.DataFrame:
        one = math.pi / 180.0
        a, d = ([x * one if math.isfinite(x) else math.nan for x in v.tolist()] for v in (a, d))
        c = [math.cos(x) for x in d]
        return pd.DataFrame({"x": [u * math.cos(x) for u, x in zip(c, a)], "y": [u * math.sin(x) for u, x in zip(c, a)], "z": [math.sin(x) for x in d]}, dtype="float64")

    return run(ra, dec)


def exact_separation_deg(c2: Column) -> Column:
    """``separation_deg``, as the C library rounds it."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([(2.0 * math.asin(math.sqrt(min(1.0, x / 4.0)))) * (180.0 / math.pi) for x in v.tolist()], dtype="float64")

    return run(c2)


def galactic(ra: Column, dec: Column) -> tuple[Column, Column]:
    """Longitude (0..360) and latitude in degrees."""
    v = unit_vector(ra, dec)
    g = [sum((F.lit(m) * x for m, x in zip(row[1:], v[1:])), F.lit(row[0]) * v[0]) for row in GALACTIC]
    l = F.degrees(F.atan2(g[1], g[0]))
    return F.when(l < 0, l + 360.0).otherwise(l), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), g[2]))))


def nested_pixel(lon: Column, lat: Column, order: int) -> Column:
    """Nested equal-area pixel of a position in degrees, at ``4**order`` pixels a face."""
    n = 1 << order
    top = F.lit(n - 1).cast("long")

    def place(p):
        """The sector, and the coordinates that the belt and the caps use."""
        z, t = p["z"], p["t"]
        ntt = F.least(F.lit(3).cast("long"), F.floor(t))
        u = F.lit(float(n)) * F.sqrt(F.lit(3.0) * (F.lit(1.0) - F.abs(z)))
        a, b = F.lit(float(n)) * (t + 0.5), F.lit(0.75 * n) * z
        return let(face, z=z, ntt=ntt, jp=F.floor(a - b), jm=F.floor(a + b), pp=F.least(top, F.floor((t - ntt) * u)), pm=F.least(top, F.floor((F.lit(1.0) - (t - ntt)) * u)))

    def face(p):
        up, down = F.shiftright(p["jp"], order), F.shiftright(p["jm"], order)
        belt, north = F.abs(p["z"]) <= 2.0 / 3.0, p["z"] >= 0
        middle = F.when(up == down, up.bitwiseOR(F.lit(4))).when(up < down, up).otherwise(down + 8)
        return let(
            number,
            f=F.when(belt, middle).when(north, p["ntt"]).otherwise(p["ntt"] + 8),
            x=F.when(belt, p["jm"].bitwiseAND(top)).when(north, top - p["pm"]).otherwise(p["pp"]),
            y=F.when(belt, top - p["jp"].bitwiseAND(top)).when(north, top - p["pp"]).otherwise(p["pm"]),
        )

    def number(p):
        pix = p["f"] * (n * n)
        for i in range(order):
            pix = pix + F.shiftleft(F.shiftright(p["x"], i).bitwiseAND(F.lit(1)), 2 * i) + F.shiftleft(F.shiftright(p["y"], i).bitwiseAND(F.lit(1)), 2 * i + 1)
        return pix.cast("long")

    return let(place, z=F.sin(F.radians(lat)), t=(lon / 90.0) % 4.0)


def parent_pixel(pix: Column, levels: int) -> Column:
    """P32."""
    return F.shiftright(pix, 2 * levels)


def pixel_area(order: int) -> float:
    """Square degrees."""
    return 4.0 * math.pi * (180.0 / math.pi) ** 2 / (12 * 4**order)
