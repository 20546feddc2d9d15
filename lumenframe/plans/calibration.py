"""Queries on blends, colour maps, model routing, selections, gates and tabulated priors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenframe.functions.scalar import log_thinning
from lumenframe.functions.scalar import quantise as q
from lumenframe.operators import blend, calibrate, latent, mixture, select, shapes

from .inputs import A, MEAS, SCORED, VEC, WIDE, B, Q, _frac, frac, scored, wide
from .registry import query, table
from .scoring import class_wide

#: Fixed parameters of the queries.
CUBIC = np.array([[0.01, 0.02, 0.0], [0.05, -0.01, 0.02], [-0.004, 0.002, 0.001], [0.0002, 0.0, -0.0001]])
BOUNDS = (-2.0, 3.0)
MODELS = {"pair": (1, 2), "triple": (1, 2, 3), "late": (4, 5, 6, 7)}
SOFT = 0.1
A_MAG = "1.0857362047581296e0"


def _cubic(i: int, c: str) -> str:
    k = CUBIC[:, i]
    return f"((({k[3]}e0*{c}+{k[2]}e0)*{c}+{k[1]}e0)*{c}+{k[0]}e0)"


def _slope(i: int, c: str) -> str:
    k = CUBIC[:, i]
    return f"((3e0*{k[3]}e0*{c}+2e0*{k[2]}e0)*{c}+{k[1]}e0)"


_CLIP = f"least(greatest(f1-f3,{BOUNDS[0]}e0),{BOUNDS[1]}e0)"
_IN = f"f1-f3>{BOUNDS[0]}e0 AND f1-f3<{BOUNDS[1]}e0"


@query("P21", f"WITH {WIDE}, t AS (SELECT *, {_CLIP} AS c FROM w WHERE f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL) SELECT id, " + ", ".join(f"{Q(f'f{i + 1}-{_cubic(i, chr(99))}')} AS m{i + 1}, {Q(f'CASE WHEN {_IN} THEN {_slope(i, chr(99))} ELSE 0e0 END')} AS s{i + 1}" for i in range(3)) + f", {Q('2e0*f1-0.5e0*f3+0.25e0')} AS mixed FROM t")
def colour_map(spark, sf):
    w = wide(spark, sf).filter("f1 is not null and f2 is not null and f3 is not null")
    bands = [F.col(f"f{i}") for i in (1, 2, 3)]
    mapped, slopes = calibrate.colour_map(bands, CUBIC, BOUNDS)
    mixed = calibrate.affine_map(bands, [[2.0, 0.0, -0.5]], [0.25])[0]
    return w.select("id", *[q(m).alias(f"m{i + 1}") for i, m in enumerate(mapped)], *[q(s).alias(f"s{i + 1}") for i, s in enumerate(slopes)], q(mixed).alias("mixed"))


@query("A09", f"WITH {MEAS}, s AS (SELECT channel, sum(flux/var)/sum(1e0/var) AS mean FROM m GROUP BY 1) SELECT channel, count(*) AS n, {Q('any_value(mean)')} AS mean, {Q('sum((flux-mean)*(flux-mean)/var)/sum(1e0/var)')} AS variance FROM m JOIN s USING (channel) GROUP BY 1")
def weighted_moments(spark, sf):
    """About the mean, in a second pass: nothing cancels. The means are one row for each channel, of which there are seven."""
    from .inputs import meas

    m = meas(spark, sf)
    w = F.lit(1.0) / F.col("var")
    means = m.groupBy("channel").agg((F.sum(w * F.col("flux")) / F.sum(w)).alias("mean"))
    off = F.col("flux") - F.col("mean")
    s = m.join(F.broadcast(means), "channel").groupBy("channel").agg(F.count("*").alias("n"), F.first("mean").alias("mean"), (F.sum(w * off * off) / F.sum(w)).alias("variance"))
    return s.select("channel", "n", q(F.col("mean")).alias("mean"), q(F.col("variance")).alias("variance"))


@query("M09, M06", f"WITH {WIDE} SELECT id, CASE WHEN f1 IS NULL THEN 'all' WHEN f3 IS NULL AND f4 IS NULL AND f5 IS NULL AND f6 IS NULL AND f7 IS NULL THEN 'pair' WHEN f4 IS NULL AND f5 IS NULL AND f6 IS NULL AND f7 IS NULL THEN 'triple' ELSE 'all' END AS model FROM w")
def covering_model(spark, sf):
    """The smallest model that has the anchor (channel 1) and every measured channel, by bit masks."""
    mask = sum((F.when(F.col(f"f{c}").isNotNull(), 1 << c).otherwise(0) for c in range(1, 8)), F.lit(0))
    out = F.lit("all")
    for name, channels in sorted(MODELS.items(), key=lambda m: -len(m[1])):
        if 1 in channels:
            out = F.when(F.col("f1").isNotNull() & (mask.bitwiseAND(F.lit(sum(1 << c for c in channels))) == mask), name).otherwise(out)
    return wide(spark, sf).select("id", out.alias("model"))


@query("M10, P34", f"WITH {VEC}, t AS (SELECT vec_id, g, lp-ln(1e0+exp(-(0.3e0*(g-4)+0.5e0*(vec_id%9-4)))) AS v FROM lp), x AS (SELECT *, max(v) OVER (PARTITION BY vec_id) AS top FROM t) SELECT vec_id, {Q('max(top)+ln(sum(exp(v-top)))-ln(10e0)')} AS lp FROM x GROUP BY 1")
def thinned_density(spark, sf):
    """Components thinned by a logistic of the row's magnitude, not renormalised."""
    t = lambda g: F.lit(0.3) * (g - 4) + F.lit(0.5) * (F.col("vec_id") % 9 - 4)
    thin = F.transform("lp", lambda v, g: log_thinning(t(g)) - F.log(F.lit(10.0)))
    return class_wide(spark, sf).select("vec_id", q(calibrate.weighted_log_density(F.col("lp"), thin)).alias("lp"))


_GATE = "(0.2e0*g-0.1e0*g*{u}+0.05e0*(g%3)*{v})"
_U, _V = _frac("vec_id", A), _frac("vec_id", B)


@query("M11", f"WITH {VEC}, t AS (SELECT vec_id, lp, {_GATE.format(u=_U, v=_V)} AS s FROM lp), x AS (SELECT vec_id, s, lp+s AS j, max(lp+s) OVER (PARTITION BY vec_id) AS top FROM t) SELECT vec_id, {Q('max(top)+ln(sum(exp(j-top)))-ln(sum(exp(s)))')} AS lp FROM x GROUP BY 1")
def gate_density(spark, sf):
    """Component proportions that depend on position, by a softmax gate."""
    k = np.arange(10)
    gate = calibrate.gate_log_weights([frac(F.col("vec_id"), A), frac(F.col("vec_id"), B)], 0.2 * k, np.stack([-0.1 * k, 0.05 * (k % 3)]))
    return class_wide(spark, sf).select("vec_id", q(calibrate.weighted_log_density(F.col("lp"), gate)).alias("lp"))


@query("P35", f"SELECT c_custkey AS id, {Q('180e0+degrees(2e0*3.141592653589793e0*' + _frac('c_custkey', A) + ')/360e0')} AS turn, {Q('degrees(acos(1e0-' + _frac('c_custkey', B) + '*(1e0-cos(radians(5e0)))))')} AS off FROM customer")
def cap_points(spark, sf):
    """Points spread evenly over a cap of five degrees, the same for the same key: angle off its axis and turn about it."""
    k = F.col("c_custkey")
    off = F.degrees(F.acos(F.lit(1.0) - frac(k, B) * (F.lit(1.0) - F.cos(F.radians(F.lit(5.0))))))
    turn = F.lit(180.0) + F.degrees(F.lit(2.0) * F.lit(np.pi) * frac(k, A)) / F.lit(360.0)
    return table(spark, sf, "customer").select(k.alias("id"), q(turn).alias("turn"), q(off).alias("off"))


@query("A25", f"WITH {SCORED} SELECT block, count(*) AS n, {Q('sum(ln(score))-count(*)*0.5e0')} AS log_score FROM t GROUP BY 1")
def cone_log_score(spark, sf):
    """Poisson score of a field: the sum of log intensities less the number expected."""
    s = scored(spark, sf).groupBy("block").agg(F.count("*").alias("n"), F.sum(F.log("score")).alias("s"))
    return s.select("block", "n", q(F.col("s") - F.col("n") * 0.5).alias("log_score"))


def blend_model() -> blend.BlendModel:
    flat = np.ones(2)
    same = mixture.Mixture([1.0], [[20.5, 20.8]], [[[0.8, 0.3], [0.3, 0.5]]])
    other = mixture.Mixture([1.0], [[21.5, 21.0]], [[[1.2, 0.5], [0.5, 0.9]]])
    return blend.BlendModel(same, other, blend.MagnitudePrior(np.array([17.0, 25.0]), flat), blend.MagnitudePrior(np.array([18.0, 26.0]), flat), np.full(2, SOFT))


def _mag(f: str) -> str:
    return f"(22.5e0-{A_MAG}*(asinh(({f})/{2 * SOFT}e0)+ln({SOFT}e0)))"


def _flux(m: str) -> str:
    return f"({2 * SOFT}e0*sinh((22.5e0-({m}))/{A_MAG}-ln({SOFT}e0)))"


def _wide(f: str) -> str:
    return f"sqrt(({f})*({f})+{4 * SOFT * SOFT}e0)"


_END = "greatest(least({hi}e0,lim)-{lo}e0,0e0)"
_BLEND = f"""WITH {WIDE}, r AS (SELECT id, f1, v1, f2, v2, {_mag('10e0*sqrt(v1)')} AS lim, ln((1e0-10e0*sqrt(v1)/f1)/(10e0*sqrt(v1)/f1)) AS top FROM w WHERE f1 > 20e0*sqrt(v1) AND f2 IS NOT NULL),
g AS (SELECT r.*, top*(2e0*(i+0.5e0)/64e0-1e0) AS t, 2e0*top/64e0 AS w FROM r, generate_series(0,63) s(i)),
a AS (SELECT *, 1e0/(1e0+exp(-t)) AS a FROM g),
b AS (SELECT *, (1e0-a)*f1 AS p1, a*f1 AS p2, {_mag('(1e0-a)*f1')} AS m1, {_mag('a*f1')} AS m2 FROM a),
h AS (SELECT b.*, kind, m1-17e0 AS u1, 20.8e0+0.375e0*(m1-20.5e0) AS c1, 0.5e0-0.3e0*0.3e0/0.8e0 AS k1, CASE kind WHEN 0 THEN 20.8e0+0.375e0*(m2-20.5e0) ELSE 21e0+0.5e0/1.2e0*(m2-21.5e0) END AS c2, CASE kind WHEN 0 THEN 0.5e0-0.3e0*0.3e0/0.8e0 ELSE 0.9e0-0.5e0*0.5e0/1.2e0 END AS k2,
  CASE kind WHEN 0 THEN 17e0 ELSE 18e0 END AS lo, CASE kind WHEN 0 THEN {_END.format(hi=25, lo=17)} ELSE {_END.format(hi=26, lo=18)} END AS len FROM b, range(2) k(kind)),
q AS (SELECT *, {_flux('c1')} AS q1, {_flux('c2')} AS q2 FROM h),
s AS (SELECT *, {_mag('f2')}-{_mag('q1+q2')} AS d, {A_MAG}*{A_MAG}*v2/(f2*f2+{4 * SOFT * SOFT}e0)+pow({_wide('q1')}/{_wide('q1+q2')},2e0)*k1+pow({_wide('q2')}/{_wide('q1+q2')},2e0)*k2 AS c FROM q),
l AS (SELECT id, kind, a, CASE WHEN len>0e0 AND m1>=17e0 AND m1<=25e0 AND m2>=lo AND m2<=lo+len THEN -ln(8e0)-ln(len)+ln({A_MAG}*f1*{_wide('f1')}*a*(1e0-a))-ln({_wide('p1')})-ln({_wide('p2')})+ln(w)-0.5e0*(1.8378770664093453e0+ln(c)+d*d/c) END AS lp FROM s),
z AS (SELECT id, kind, a, lp, max(lp) OVER (PARTITION BY id, kind) AS best FROM l),
e AS (SELECT id, kind, max(best)+ln(sum(exp(lp-best))) AS ll, sum(exp(lp-best)*CASE kind WHEN 0 THEN least(a,1e0-a) ELSE a END)/sum(exp(lp-best)) AS share FROM z WHERE lp IS NOT NULL GROUP BY ALL),
o AS (SELECT id, max(CASE WHEN kind=0 THEN ll END) AS x, max(CASE WHEN kind=1 THEN ll END) AS y, max(CASE WHEN kind=0 THEN share END) AS xs, max(CASE WHEN kind=1 THEN share END) AS ys FROM e GROUP BY 1)
SELECT id, {Q('x')} AS log_same, {Q('y')} AS log_other, {Q('1e0/(1e0+exp(y-x))')} AS p_same, {Q('xs')} AS share_same, {Q('ys')} AS share_other FROM o WHERE x IS NOT NULL AND y IS NOT NULL"""


@query("M22, M23, X12", _BLEND)
def blend_score(spark, sf):
    w = wide(spark, sf).filter("f1 > 20.0 * sqrt(v1) and f2 is not null").select("id", F.array("f1", "f2").alias("flux"), F.array("v1", "v2").alias("var"))
    done = blend.score_blends(w, blend_model()).filter("status = 'ok' and abs(log_same) < 1e300D and abs(log_other) < 1e300D")
    return done.select("id", *[q(F.col(c)).alias(c) for c in blend.SCORE[1:]])


@query("X21", f"WITH {WIDE}, z AS (SELECT id, f1, v1, {_frac('id', B)} AS z, {_frac('id', A)} AS o FROM w WHERE f1 IS NOT NULL), n AS (SELECT *, lead(id) OVER p AS partner, lead(f1) OVER p AS g, lead(v1) OVER p AS u FROM z WINDOW p AS (PARTITION BY floor(z/0.05e0) ORDER BY o, id)) SELECT id, partner, {Q('f1+g')} AS flux, {Q('v1+u')} AS var FROM n WHERE partner IS NOT NULL")
def synthetic_blends(spark, sf):
    w = wide(spark, sf).filter("f1 is not null").select("id", F.array("f1").alias("flux"), F.array("v1").alias("var"))
    done = blend.synthetic_blends(w, "id", frac(F.col("id"), B), 0.05, order=frac(F.col("id"), A))
    return done.select("id", "partner", q(F.get("flux", F.lit(0))).alias("flux"), q(F.get("var", F.lit(0))).alias("var"))


@query("X28", f"WITH d AS (SELECT c_nationkey AS cell, 16e0+0.5e0*floor(16e0*{_frac('c_custkey', A)}) AS m, count(*)::DOUBLE AS v FROM customer GROUP BY ALL), t AS (SELECT 16e0+0.5e0*i AS m_new FROM generate_series(0,16) s(i)) SELECT cell, m_new, {Q('sum(v*0.5e0/(0.4e0*sqrt(2e0*3.141592653589793e0))*exp(-0.5e0*pow((m_new-m-0.3e0)/0.4e0,2e0)))')} AS v FROM d, t GROUP BY ALL")
def reference_band_density(spark, sf):
    k = F.col("c_custkey")
    m = F.lit(16.0) + F.lit(0.5) * F.floor(F.lit(16.0) * frac(k, A))
    d = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("cell"), m.alias("m")).agg(F.count("*").cast("double").alias("v"))
    return calibrate.in_other_band(d, ["cell"], "m", "v", 0.5, [16.0 + 0.5 * i for i in range(17)], 0.3, 0.4).select("cell", "m_new", q(F.col("v")).alias("v"))


_X = f"(10e0*{_frac('c_custkey', A)})"


@query("E20", f"WITH k AS (SELECT c_custkey AS id, {_X} AS x FROM customer) SELECT id, " + ", ".join(Q("(" + "+".join(f"{c}e0*pow(greatest(x-({i + j - 3}e0),0e0),3e0)" for j, c in enumerate((1, -4, 6, -4, 1))) + ")/6e0") + f" AS b{i}" for i in range(2, 7)) + " FROM k")
def spline_basis(spark, sf):
    """Cubic B-splines on whole numbers against their truncated powers."""
    basis = calibrate.spline_basis(F.lit(10.0) * frac(F.col("c_custkey"), A), range(-3, 14), 3)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), *[q(basis[i]).alias(f"b{i}") for i in range(2, 7)])


@query("E22")
def clipped_polynomial(spark, sf):
    w = wide(spark, sf).filter("f1 is not null and f2 is not null")
    c, kept = calibrate.fit_polynomial(w.withColumn("y", F.col("f2") + F.lit(0.1) * F.col("f1")), "f1", "y", 2)
    return spark.createDataFrame([(i, float(v), kept) for i, v in enumerate(c)], "power int, coefficient double, kept long").select("power", q(F.col("coefficient")).alias("coefficient"), "kept")


@query("A22, E20")
def logistic_selection(spark, sf):
    s = scored(spark, sf)
    theta = calibrate.fit_logistic(s, [F.lit(1.0), F.col("score")], F.col("label"))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(theta)], "i int, theta double").select("i", q(F.col("theta")).alias("theta"))


@query("E11, A22")
def softmax_gate(spark, sf):
    """Proportions of the first three classes over position."""
    rows = class_wide(spark, sf).select(F.slice("lp", 1, 3).alias("lp"), F.array(frac(F.col("vec_id"), A)).alias("f"))
    gate = calibrate.fit_gate(rows, "lp", "f", np.full(3, 1 / 3), steps=15)
    return spark.createDataFrame([(k, float(gate["a"][k] - gate["a"][0]), float(gate["beta"][0, k])) for k in range(3)], "component int, a double, beta double")


@query("M18, E17")
def envelope_scale(spark, sf):
    """The envelope of the classes' covariances, and how far the widest of them falls short of it."""
    v = class_wide(spark, sf).select(F.slice("lp", 1, 3).alias("x"), (F.col("vec_id") % 4).alias("g"))
    e = [F.get("x", F.lit(i)) for i in range(3)]
    got = v.groupBy("g").agg(*[F.covar_pop(e[i], e[j]).alias(f"c{i}{j}") for i in range(3) for j in range(3)]).orderBy("g").collect()  # four rows of nine numbers
    covs = np.array([[float(r[f"c{i}{j}"]) for i in range(3) for j in range(3)] for r in got]).reshape(-1, 3, 3)
    covs = np.array([shapes.floored(c, 1e-6) for c in covs])
    env = shapes.envelope(np.eye(3), covs)
    return spark.createDataFrame([(i, float(env[i, i]), shapes.dominant_scale(env, covs)) for i in range(3)], "i int, variance double, scale double")


_PHOT = "CASE WHEN {v} > -50e0 AND {v} < 90e0 AND {e} > 0e0 AND {e} < 90e0 AND l_returnflag <> 'R' THEN {x} END"
_LINES = "SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_quantity >= 48 THEN 99.99e0 ELSE 15e0+l_quantity/5e0 END AS v, 0.01e0+l_tax AS e, l_returnflag FROM lineitem"
_FLUX = "pow(10e0,(22.5e0-v)/2.5e0)"


@query("P14", f"WITH t AS ({_LINES}) SELECT id, line, " + _PHOT.format(v="v", e="e", x=Q(_FLUX)) + " AS flux, " + _PHOT.format(v="v", e="e", x=Q(f"pow(0.9210340371976184e0*{_FLUX}*e,2e0)")) + " AS variance FROM t")
def magnitude_photometry(spark, sf):
    """Magnitudes with sentinels and a quality rule to fluxes and variances."""
    t = table(spark, sf, "lineitem")
    v = F.when(F.col("l_quantity") >= 48, F.lit(99.99)).otherwise(F.lit(15.0) + F.col("l_quantity") / F.lit(5.0))
    flux, var = select.photometry(v, F.lit(0.01) + F.col("l_tax"), "mag", F.col("l_returnflag") != "R")
    return t.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), q(flux).alias("flux"), q(var).alias("variance"))


@query("E03, M20, M21")
def latent_fit(spark, sf):
    """Two latent coordinates seen directly by one half of the orders, and as a rotated pair by the other half."""
    rows = wide(spark, sf).filter("f1 is not null or f2 is not null").select((F.col("id") % 2).alias("system"), F.array("f1", "f2").alias("y"), F.array("v1", "v2").alias("var"))
    systems = {0: (np.eye(2), np.zeros(2), np.zeros((2, 2))), 1: (np.array([[0.8, 0.6], [-0.6, 0.8]]), np.array([0.1, 0.0]), 0.01 * np.eye(2))}
    start = mixture.Mixture([0.5, 0.5], [[4.0, 4.0], [8.0, 8.0]], np.tile(16.0 * np.eye(2), (2, 1, 1)))
    m, history, _ = latent.fit_latent(rows, start, systems, iterations=6)
    return spark.createDataFrame([(k, float(m.weights[k]), m.means[k].tolist(), history[-1]) for k in range(2)], "k int, weight double, mean array<double>, objective double")
