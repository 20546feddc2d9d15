"""Queries on extinction, rasters, cell weights, quantile thresholds and censuses."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import scalar as S
from lumenframe.functions import sky as K
from lumenframe.functions.scalar import quantise as q
from lumenframe.operators import density as D
from lumenframe.operators import extinction as E
from lumenframe.operators import metrics, score, select

from .build import _AMP, region_roles
from .inputs import SCORED, VEC, WIDE, Q, _frac, A, frac, scored, times_sql, wide
from .measure import _lupt
from .registry import SQL, query, table
from .scoring import class_wide
from .skyjoin import GAL, PIX, SKY_C, pixels

_SIZE = 64
_N0 = 10.0
_QUANTILES = [i / 10 for i in range(11)]


def _curve_sql(wave: str) -> str:
    out = ""
    for lo, *c in E.natural_spline(*E.anchors()).tolist():
        d = f"(1e4/{wave}-'{lo!r}'::DOUBLE)"
        piece = f"('{c[0]!r}'::DOUBLE+{d}*('{c[1]!r}'::DOUBLE+{d}*('{c[2]!r}'::DOUBLE+{d}*'{c[3]!r}'::DOUBLE)))"
        out = f"CASE WHEN 1e4/{wave}>='{lo!r}'::DOUBLE THEN {piece} ELSE {out} END" if out else piece
    return f"(CASE WHEN {wave}>=2700e0 THEN {out} END)"


@query("P25", f"WITH c AS (SELECT p_brand AS band, 3000e0+100e0*p_size AS w, count(*)/8e0 AS tr FROM part GROUP BY ALL), sp AS (SELECT band, w, tr*pow(w,-4e0)/(exp({E.HCK}e0/(w*7000e0))-1e0) AS s, {_curve_sql('w')} AS k FROM c), t AS (SELECT band, w-lag(w) OVER o AS h, s+lag(s) OVER o AS s, s*pow(10e0,-0.4e0*0.01e0*k)+lag(s*pow(10e0,-0.4e0*0.01e0*k)) OVER o AS t FROM sp WINDOW o AS (PARTITION BY band ORDER BY w)) SELECT band, {Q('CASE WHEN sum(h*s)>0 THEN -2.5e0/0.01e0*log10(sum(h*t)/sum(h*s)) END')} AS coefficient FROM t GROUP BY band")
def band_extinction(spark, sf):
    """A coefficient for each brand, whose sizes are the nodes of a filter curve."""
    curves = table(spark, sf, "part").groupBy(F.col("p_brand").alias("band"), (F.lit(3000.0) + F.lit(100.0) * F.col("p_size")).alias("wave")).agg((F.count("*") / 8.0).alias("transmission"))
    return E.band_coefficients(curves).select("band", q(F.col("coefficient")).alias("coefficient"))


@query("P13", "SELECT l_suppkey AS native, sum(n*0.25e0*latent)/16e0 AS r FROM (SELECT l_suppkey, l_linenumber AS latent, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def native_extinction(spark, sf):
    matrix = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("native"), F.col("l_linenumber").cast("long").alias("latent")).agg((F.count("*") / 16.0).alias("h"))
    latent = spark.range(1, 8).select(F.col("id").alias("latent"), (F.col("id") * 0.25).alias("r"))
    return E.native_coefficients(matrix, latent)


_REACH = f"{_SIZE / 2}e0*sqrt(1e0-n*sin(radians(b)))"
_FOUR = "(SELECT unnest([0,1]) AS i) c, (SELECT unnest([0,1]) AS j) d"


@query("S23, J18", f"WITH {SKY_C}, {GAL}, a AS (SELECT id, l, b, CASE WHEN b>=0 THEN 1 ELSE -1 END AS n FROM g), p AS (SELECT id, n, {_REACH}*cos(radians(l))+{(_SIZE - 1) / 2}e0 AS x, {(_SIZE - 1) / 2}e0-n*({_REACH})*sin(radians(l)) AS y FROM a), f AS (SELECT id, n, greatest(0,least({_SIZE - 1},floor(x)::BIGINT+i)) AS px, greatest(0,least({_SIZE - 1},floor(y)::BIGINT+j)) AS py, (CASE WHEN i=1 THEN x-floor(x) ELSE 1e0-(x-floor(x)) END)*(CASE WHEN j=1 THEN y-floor(y) ELSE 1e0-(y-floor(y)) END) AS w FROM p, {_FOUR}), r AS (SELECT CASE WHEN k<{_SIZE * _SIZE} THEN 1 ELSE -1 END AS side, (k%{_SIZE * _SIZE})//{_SIZE} AS y, k%{_SIZE} AS x, {_frac('k', A)} AS value FROM (SELECT unnest(range(0,{2 * _SIZE * _SIZE})) AS k)) SELECT id, {Q('sum(w*value)')} AS value FROM f JOIN r ON side=n AND r.y=py AND r.x=px GROUP BY id")
def raster_reddening(spark, sf):
    k = F.col("id")
    side = F.when(k < _SIZE * _SIZE, 1).otherwise(-1)
    raster = spark.range(2 * _SIZE * _SIZE).select(side.alias("side"), F.floor(k % (_SIZE * _SIZE) / _SIZE).alias("y"), (k % _SIZE).alias("x"), frac(k, A).alias("value"))
    return E.sample_raster(pixels(spark, sf).select("id", "l", "b"), raster, _SIZE).select("id", q(F.col("value")).alias("value"))


@query("J28, A04", f"WITH {PIX}, m AS (SELECT pix, c_nationkey%3 AS k FROM h JOIN customer ON c_custkey=id), cc AS (SELECT pix, count(*)::DOUBLE AS n, " + ", ".join(f"count(CASE WHEN k={j} THEN 1 END) AS c{j}" for j in range(3)) + " FROM m GROUP BY 1), u AS (SELECT pix>>4 AS parent, sum(n) AS n, " + ", ".join(f"sum(c{j}) AS c{j}" for j in range(3)) + " FROM cc GROUP BY 1), a AS (SELECT sum(n) AS n, " + ", ".join(f"sum(c{j}) AS c{j}" for j in range(3)) + f" FROM cc), v AS (SELECT parent, " + ", ".join(f"u.n/(u.n+{_N0}e0)*(u.c{j}/u.n)+(1e0-u.n/(u.n+{_N0}e0))*(a.c{j}/a.n) AS w{j}" for j in range(3)) + " FROM u, a) SELECT pix, " + ", ".join(Q(f"c.n/(c.n+{_N0}e0)*(c.c{j}/c.n)+(1e0-c.n/(c.n+{_N0}e0))*w{j}") + f" AS w{j}" for j in range(3)) + " FROM cc c JOIN v ON parent=pix>>4")
def cell_weights(spark, sf):
    """Shares of three components in each fine cell, drawn to its parent's and these to the whole sky's."""
    kind = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 3).alias("component"))
    rows = pixels(spark, sf).select("id", "pix").join(kind, "id")
    w = D.shrunk_weights(rows, 3, 4, _N0)
    return w.select("pix", *[q(F.get("w", F.lit(j))).alias(f"w{j}") for j in range(3)])


@query("F10", f"WITH {WIDE}, x AS (SELECT id, {_lupt(3)} AS m, {_AMP}*sqrt(v3)/sqrt(f3*f3+0.04e0) AS s, {_lupt(1)}-{_lupt(2)} AS c, CASE WHEN f4/sqrt(v4)>=2e0 THEN 1 ELSE 0 END + CASE WHEN f5/sqrt(v5)>=2e0 THEN 1 ELSE 0 END AS good FROM w), y AS (SELECT *, m+(0.2e0+c*(0.5e0+c*-0.1e0)) AS centre FROM x) SELECT id, {Q('centre-0.75e0-5e0*s')} AS lo, {Q('centre+1.25e0+5e0*s')} AS hi, CASE WHEN good<1 THEN 'few_detections' WHEN centre IS NULL THEN 'no_colour' WHEN centre>20.5e0 THEN 'beyond_training' ELSE 'ok' END AS status FROM y")
def colour_window(spark, sf):
    """Where the reference may lie, from another band and a colour, and why an object may not be judged by it."""
    w = wide(spark, sf)
    m = S.asinh_mag(F.col("f3"), 0.1)
    sigma = F.lit(_AMP) * F.sqrt("v3") / F.sqrt(F.col("f3") * F.col("f3") + F.lit(0.04))
    colour = S.asinh_mag(F.col("f1"), 0.1) - S.asinh_mag(F.col("f2"), 0.1)
    good = sum((F.when(F.col(f"f{c}") / F.sqrt(f"v{c}") >= 2.0, 1).otherwise(0) for c in (4, 5)), F.lit(0))
    lo, hi, centre = select.colour_window(m, sigma, colour, [0.2, 0.5, -0.1], 0.75, 1.25)
    status = score.first_status((good < 1, "few_detections"), (centre.isNull(), "no_colour"), (centre > 20.5, "beyond_training"))
    return w.select("id", q(lo).alias("lo"), q(hi).alias("hi"), status.alias("status"))


@query("F27, A28", f"SELECT role, count(*) AS n FROM ({SQL['region_roles']}) GROUP BY role")
def role_counts(spark, sf):
    """Every object counted in its role; none is left out."""
    return region_roles(spark, sf).groupBy("role").agg(F.count("*").alias("n"))


@query("W07", f"WITH {SCORED}, h AS (SELECT quantile_cont(score, {_QUANTILES}) AS t FROM t), k AS (SELECT unnest(range(0,{len(_QUANTILES)})) AS i) SELECT CAST(i AS INT) AS i, {Q('h.t[i+1]')} AS threshold, count(CASE WHEN label=1 AND score>=h.t[i+1] THEN 1 END)/count(CASE WHEN label=1 THEN 1 END)::DOUBLE AS tpr, count(CASE WHEN label<>1 AND score>=h.t[i+1] THEN 1 END)/count(CASE WHEN label<>1 THEN 1 END)::DOUBLE AS fpr FROM t, h, k GROUP BY i, h.t")
def roc_at_quantiles(spark, sf):
    return metrics.roc_at_quantiles(scored(spark, sf), _QUANTILES).select("i", q(F.col("threshold")).alias("threshold"), "tpr", "fpr")


_DRAWS = 100
_AREA = K.pixel_area(2)


@query("X20, A05, W16", f"WITH {PIX}, b AS (SELECT pix>>4 AS block, " + ", ".join(f"count(CASE WHEN CAST(least(7,greatest(0,floor(mag-16e0))) AS INT)={j} THEN 1 END) AS c{j}" for j in range(8)) + f" FROM h GROUP BY 1), d AS (SELECT b.*, draw, {times_sql('block', 'draw')} AS times FROM b, (SELECT unnest(range(0,{_DRAWS})) AS draw)), e AS (SELECT draw, " + ", ".join(f"sum(times*c{j})/(sum(times)*{_AREA}e0) AS e{j}" for j in range(8)) + " FROM d GROUP BY draw), o AS (SELECT " + ", ".join(f"sum(c{j})/(count(*)*{_AREA}e0) AS o{j}" for j in range(8)) + " FROM b), x AS (SELECT " + ", ".join(f"stddev_pop(e{j}) AS s{j}" for j in range(8)) + " FROM e) " + " UNION ALL ".join(f"SELECT {j} AS bin, {Q(f'o{j}')} AS density, {Q(f's{j}')} AS error FROM o, x" for j in range(8)))
def census(spark, sf):
    """Surface density of each magnitude bin over the surveyed blocks, with its error from 100 resamplings of whole blocks."""
    p = pixels(spark, sf).select(K.parent_pixel(F.col("pix"), 2).alias("block"), D.bin_of(F.col("mag"), 16.0, 1.0, 8).alias("bin"))
    out = metrics.census(p, "block", "bin", 8, _AREA, _DRAWS)
    return out.select("bin", q(F.col("density")).alias("density"), q(F.col("error")).alias("error"))


@query("X14", f"WITH {VEC}, m AS (SELECT vec_id, max(lp) AS top FROM lp GROUP BY 1), s AS (SELECT vec_id, sum(CASE WHEN g<5 THEN 0.3e0/5e0*exp(lp-top) ELSE 0e0 END) AS a, sum(CASE WHEN g>=5 THEN 0.7e0/5e0*exp(lp-top) ELSE 0e0 END) AS b FROM lp JOIN m USING (vec_id) GROUP BY 1) SELECT vec_id, {Q('a/(a+b)')} AS p FROM s")
def redshift_free_score(spark, sf):
    """The probability of the wanted kind, summed over every slice of its redshift, against all background kinds."""
    wanted = F.transform(F.slice("lp", 1, 5), lambda v: v + F.log(F.lit(0.3 / 5)))
    other = F.transform(F.slice("lp", 6, 5), lambda v: v + F.log(F.lit(0.7 / 5)))
    return class_wide(spark, sf).select("vec_id", q(score.share_of(wanted, other)).alias("p"))
