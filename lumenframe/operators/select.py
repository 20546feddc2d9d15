"""Selections: ordered checks with reasons, quality rules, channel choices. Missing evidence never passes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calibrate import polynomial

#: The morphology codes.
POINT, EXTENDED = ("PSF",), ("REX", "EXP", "DEV", "SER", "DUP")


def decide(df: DataFrame, *checks: tuple[Column, str]) -> DataFrame:
    """``accepted`` and ``reason``; the first check that fails names it, nulls fail."""
    reason = reduce(lambda w, c: w.when(~F.coalesce(c[0], F.lit(False)), c[1]), checks[1:], F.when(~F.coalesce(checks[0][0], F.lit(False)), checks[0][1])).otherwise("")
    return df.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "")


def morphology(kind: Column) -> Column:
    """F02."""
    k = F.upper(F.trim(kind))
    return F.when(k.isin(*POINT), "point").when(k.isin(*EXTENDED), "extended").otherwise("unknown")


def hemisphere(dec: Column, latitude: Column, cut: float = 32.375) -> Column:
    """F03."""
    return F.when((dec >= cut) & (latitude > 0), "north").otherwise("south")


def violations(*rules: tuple[Column, str]) -> Column:
    """names of the rules that do not hold, in order; nulls violate."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for ok, name in rules]), lambda x: x.isNotNull())


def clean_bits(flags: Column, bad_bits: int) -> Column:
    """no bad bit set; a negative sentinel or a null fails."""
    return F.coalesce((flags >= 0) & (flags.cast("long").bitwiseAND(F.lit(bad_bits)) == 0), F.lit(False))


def at_least(p: Column, threshold: float) -> Column:
    """nulls and NaN fail."""
    return F.coalesce(~F.isnan(p) & (p >= threshold), F.lit(False))


def ladder(first: Column, cut: float, second: Column) -> Column:
    """decided by the first score where there is one, else by the second test, else unknown."""
    return F.when(first.isNotNull() & ~F.isnan(first), F.when(first >= cut, "point").otherwise("extended")).when(second.isNotNull(), F.when(second, "point").otherwise("extended")).otherwise("unknown")


def presence_mask(channels: list[tuple[Column, Column]]) -> Column:
    """bit i is set where channel i has a value and a positive variance."""
    bits = [F.when(v.isNotNull() & (s > 0), F.lit(1 << i)).otherwise(F.lit(0)) for i, (v, s) in enumerate(channels)]
    return reduce(lambda a, b: a + b, bits).cast("long")


def reference_channel(snr: list[tuple[str, Column]], strong: float) -> Column:
    """the first channel of strong signal, else the first that is present."""
    return F.coalesce(*[F.when(s >= strong, n) for n, s in snr], *[F.when(s.isNotNull(), n) for n, s in snr])


def passing_channel(snr: list[tuple[str, Column]], strong: float) -> Column:
    """the first present channel, if it is strong."""
    first = F.coalesce(*[F.when(s.isNotNull(), F.struct(F.lit(n).alias("n"), s.alias("s"))) for n, s in snr])
    return F.when(first["s"] >= strong, first["n"])


def funnel(df: DataFrame, by: str, *stages: tuple[str, Column]) -> DataFrame:
    """Rows of each group that survive each further stage, in one pass."""
    out, so_far = [F.count("*").alias("total")], F.lit(True)
    for name, cond in stages:
        so_far = so_far & F.coalesce(cond, F.lit(False))
        out.append(F.count_if(so_far).alias(name))
    return df.groupBy(by).agg(*out)


def contract(df: DataFrame, **rules: Column) -> DataFrame:
    """How many rows break each rule; nulls break it."""
    return df.agg(F.count("*").alias("rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])


def compare_versions(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Counts of rows equal, changed by column, only old, only new; null equals null and NaN equals NaN."""
    both = old.select(key, F.lit(True).alias("in_old"), *[F.col(c).alias(f"o_{c}") for c in columns]).join(new.select(key, F.lit(True).alias("in_new"), *[F.col(c).alias(f"n_{c}") for c in columns]), key, "full")
    here = F.col("in_old").isNotNull() & F.col("in_new").isNotNull()
    differ = {c: ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")) for c in columns}
    return both.agg(
        F.count_if(here & ~reduce(lambda a, b: a | b, differ.values())).alias("same"), *[F.count_if(here & d).alias(f"changed_{c}") for c, d in differ.items()],
        F.count_if(F.col("in_new").isNull()).alias("only_old"), F.count_if(F.col("in_old").isNull()).alias("only_new"),
    )


def projection(registry: dict[str, dict[str, str]], survey: str, present: list[str]) -> list[Column]:
    """The SELECT list of a survey: the registry gives an expression for each standard name; columns that it needs and are not there are named in the error."""
    spec = registry[survey]
    words = {w for e in spec.values() for w in re.findall(r"[A-Za-z_]\w*", e)}
    missing = sorted(w for w in words if w.startswith(tuple({c.split("_")[0] + "_" for c in present})) and w not in present)
    if missing:
        raise KeyError(f"{survey} needs {', '.join(missing)}")
    return [F.expr(e).alias(name) for name, e in spec.items()]


def chi_square(x: Column, y: Column, sx: Column, sy: Column, rho: Column) -> Column:
    """of two correlated measurements against zero; null where a scale is not positive or the correlation is 1."""
    a, b = x / sx, y / sy
    return F.when((sx > 0) & (sy > 0) & (F.abs(rho) < 1), (a * a + b * b - F.lit(2.0) * rho * a * b) / (F.lit(1.0) - rho * rho))


def photometry(value: Column, error: Column, kind: str, good: Column | None = None, scale: float = 1.0) -> tuple[Column, Column]:
    """(flux, variance) in native units of one band, null where unusable; negative fluxes stay.

    ``kind``: ``ivar`` (error is an inverse variance), ``sigma``, ``dn`` (counts, times ``scale``) or ``mag``, whose
    sentinels (outside -50 to 90, errors of 90 or more) are missing values and not limits. ``good`` is the survey's rule; null is not good.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    value, error = value.cast("double"), error.cast("double")
    ok = finite(value) & finite(error) & (error > 0)
    if kind == "mag":
        ok = ok & (value > -50) & (value < 90) & (error < 90)
        flux = F.pow(F.lit(10.0), (F.lit(22.5) - value) / F.lit(2.5))
        variance = F.pow(F.lit(0.9210340371976184) * flux * error, F.lit(2.0))
    elif kind in ("ivar", "sigma", "dn"):
        flux = value * F.lit(scale)
        variance = (F.lit(1.0) / error if kind == "ivar" else error * error) * F.lit(scale * scale)
    else:
        raise ValueError(f"unknown kind {kind}")
    if good is not None:
        ok = ok & F.coalesce(good, F.lit(False))
    return F.when(ok, flux), F.when(ok, variance)


def balanced_holdout(counts: dict, share: float, least: int, seed: int, draws: int = 10_000) -> list:
    """Fields to hold out, drawn until both sides have ``least`` measurements of every band.

    ``counts`` is {field: counts by band}, already summed over the rows; raises where no draw does.
    """
    import numpy as np

    names = sorted(counts)
    table = np.array([counts[n] for n in names])
    total, size = table.sum(0), max(1, round(len(names) * share))
    rng = np.random.default_rng(seed)
    for _ in range(draws):
        pick = np.sort(rng.permutation(len(names))[:size])
        held = table[pick].sum(0)
        if min(held.min(), (total - held).min()) >= least:
            return [names[i] for i in pick]
    raise ValueError("no draw leaves every band on both sides")


def colour_window(m: Column, sigma: Column, colour: Column, coefficients: list[float], below: float, above: float, spread: float = 5.0) -> tuple[Column, Column, Column]:
    """lower end, upper end and centre of the window in which a reference magnitude may lie, from another band's and a polynomial of a colour."""
    centre = m + polynomial(colour, coefficients)
    return centre - F.lit(below) - F.lit(spread) * sigma, centre + F.lit(above) + F.lit(spread) * sigma, centre
