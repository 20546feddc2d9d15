"""Competing-hypothesis scores: intensities, posteriors, redshift posteriors, grids over unknowns. Stateless columns, so they take streams too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.scalar import let, trapezoid
from lumenframe.operators.metrics import numbered


def posterior(same: Column, field: Column, background: Column, outlier: Column | None = None) -> dict[str, Column]:
    """X02 from log intensities: p_same, p_vs_background, p_object, p_outlier; the largest is taken out first."""
    terms = [same, field, background] + ([outlier] if outlier is not None else [])
    top = F.greatest(*terms)
    e = [F.exp(t - top) for t in terms]
    total = e[0] + e[1] + e[2] + (e[3] if outlier is not None else F.lit(0.0))
    rest = e[0] + e[2] + (e[3] if outlier is not None else F.lit(0.0))
    return {
        "p_same": e[0] / total,
        "p_vs_background": e[0] / rest,
        "p_object": (e[0] + e[1]) / total,
        "p_outlier": (e[3] if outlier is not None else F.lit(0.0)) / total,
        "log_total": top + F.log(total),
    }


def first_status(*checks: tuple[Column, str], otherwise: str = "ok") -> Column:
    """The name of the first check that holds; a null check counts as held."""
    out = None
    for cond, name in checks:
        held = F.coalesce(cond, F.lit(True))
        out = F.when(held, name) if out is None else out.when(held, name)
    return out.otherwise(otherwise)


def slice_density(log_p: Column, z: Column, first: float, step: float, n: int) -> Column:
    """Log of the density interpolated linearly between slice centres, clamped at the ends; ``log_p`` is an array over slices."""
    u = F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), (z - F.lit(first)) / F.lit(step)))
    i = F.least(F.lit(n - 2), F.floor(u)).cast("int")
    t = u - i
    a, b = F.get(log_p, i), F.get(log_p, i + 1)
    top = F.greatest(a, b)
    return top + F.log((F.lit(1.0) - t) * F.exp(a - top) + t * F.exp(b - top))


def grid_posterior(log_p: Column, grid: Column) -> Column:
    """Density over the grid (an array), normalised by the trapezoid rule."""
    scaled = let(lambda p: F.transform(p["l"], lambda v: F.exp(v - p["top"])), l=log_p, top=F.array_max(log_p))
    return let(lambda p: let(lambda a: F.transform(a["e"], lambda v: v / a["area"]), e=p["e"], area=trapezoid(p["x"], p["e"])), e=scaled, x=grid)


def window_probability(posterior_array: Column, grid: Column, lo: Column, hi: Column) -> Column:
    """Posterior mass within [lo, hi], whose ends need not be nodes: the density is linear between nodes."""

    def mass(p):
        x, y = p["x"], p["y"]

        def part(i):
            x0, x1, y0, y1 = F.get(x, i - 1), F.get(x, i), F.get(y, i - 1), F.get(y, i)
            a, b = F.greatest(p["lo"], x0), F.least(p["hi"], x1)
            middle = y0 + (y1 - y0) * ((a + b) / F.lit(2.0) - x0) / (x1 - x0)
            return F.when(b > a, middle * (b - a)).otherwise(F.lit(0.0))

        return F.aggregate(F.transform(F.sequence(F.lit(1), F.size(x) - 1), part), F.lit(0.0), lambda a, b: a + b)

    return let(mass, x=grid, y=posterior_array, lo=lo, hi=hi)


def marginalise(log_like: Column, log_prior: Column, grid: Column) -> Column:
    """Log of the integral of exp(like + prior) over an unknown on a grid."""
    terms = F.zip_with(log_like, log_prior, lambda a, b: a + b)
    over = lambda p: p["top"] + F.log(trapezoid(p["x"], F.transform(p["t"], lambda v: F.exp(v - p["top"]))))
    return let(lambda p: let(over, t=p["t"], x=p["x"], top=F.array_max(p["t"])), t=terms, x=grid)


def spread(*scores: Column) -> Column:
    """Largest minus smallest of several models' scores."""
    return F.greatest(*scores) - F.least(*scores)


def unrecognised(p_member: Column, found: Column, completeness: float) -> Column:
    """Chance that an object which was not recognised is a member all the same."""
    missed = p_member * F.lit(1.0 - completeness)
    return F.when(found, F.lit(0.0)).otherwise(missed / (missed + (F.lit(1.0) - p_member)))


def tail_p_value(df: DataFrame, distance: str, calibration: DataFrame) -> DataFrame:
    """``df`` with ``p``: (1 + number of calibration distances at least as far) / (their number + 1); no distance, no p.

    Both sides have the column ``distance``. Ranks are counted over all rows: by distinct distance, within
    ranges that are summed first.
    """
    at = F.col(distance).alias("v")
    rows = lambda of, n: of.select(at, F.lit(n).cast("long").alias("n")).filter("v is not null and not isnan(v)")
    counts = rows(calibration, 1).unionByName(rows(df, 0)).groupBy("v").agg(F.sum("n").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))  # one row
    ranked = numbered(counts, ["v"], "n").crossJoin(F.broadcast(total))
    ranked = ranked.select("v", ((F.lit(1.0) + F.col("total") - F.col("before")) / (F.col("total") + F.lit(1.0))).alias("p"))
    return df.join(ranked, F.col(distance) == F.col("v"), "left").drop("v")


def share_of(wanted: Column, other: Column) -> Column:
    """The share of ``wanted`` in the sum of both, arrays of log densities with their log priors."""

    def mass(p, name):
        return F.aggregate(p[name], F.lit(0.0), lambda s, v: s + F.exp(v - p["top"]))

    shares = lambda p: let(lambda m: m["a"] / (m["a"] + m["b"]), a=mass(p, "a"), b=mass(p, "b"))
    return let(shares, a=wanted, b=other, top=F.greatest(F.array_max(wanted), F.array_max(other)))
