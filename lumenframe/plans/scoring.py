"""Queries on vectors and scored events: mixtures, hypotheses, redshift grids, estimators, metrics, streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions.scalar import quantise as q
from lumenframe.operators import density, estimate, joint, metrics, mixture, score, support

from .inputs import MEAS, SCORED, VEC, WIDE, Q, scored, times_sql, vec, wide
from .registry import query, table


def class_log_probs(spark, sf):
    """(vec_id, g, lp) of every vector under each class's diagonal model; the classes are few."""
    v = vec(spark, sf)
    model = mixture.class_models(v, "label").select(F.col("label").alias("g"), "m", "v")
    return mixture.diagonal_log_prob(v, model, "vec_id", "g")


def class_wide(spark, sf):
    """One row a vector, its ten class log densities in one array (the order of the class)."""
    return class_log_probs(spark, sf).groupBy("vec_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("g", "lp"))), lambda s: s["lp"]).alias("lp"))


@query("M01, M02, M05, A10", f"WITH {VEC} SELECT vec_id, g, {Q('lp')} AS lp FROM lp")
def diag_mixture_logprob(spark, sf):
    return class_log_probs(spark, sf).select("vec_id", "g", q(F.col("lp")).alias("lp"))


@query("M03, P27", f"WITH {VEC}, t AS (SELECT vec_id, max(lp) AS top FROM lp GROUP BY 1), z AS (SELECT vec_id, sum(exp(lp-top)) AS z FROM lp JOIN t USING (vec_id) GROUP BY 1) SELECT vec_id, g, {Q('exp(lp-top)/z')} AS r FROM lp JOIN t USING (vec_id) JOIN z USING (vec_id)")
def responsibilities(spark, sf):
    w = class_wide(spark, sf)
    top = F.array_max("lp")
    e = F.transform("lp", lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return w.select("vec_id", F.posexplode(F.transform(e, lambda v: v / total)).alias("g", "r")).select("vec_id", "g", q(F.col("r")).alias("r"))


@query("M04, M27, W10", f"WITH {VEC}, d AS (SELECT vec_id, g, sum((v-m)*(v-m)/s) AS d2 FROM e JOIN k USING (i) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, g) AS n FROM d) SELECT vec_id, g AS component, {Q('sqrt(d2)')} AS sigma FROM r WHERE n=1")
def nearest_component(spark, sf):
    v = vec(spark, sf)
    model = mixture.class_models(v, "label").select(F.col("label").alias("g"), "m", "v")
    d2 = F.aggregate(F.zip_with(F.zip_with("x", "m", lambda a, b: (a - b) * (a - b)), "v", lambda a, b: a / b), F.lit(0.0), lambda a, b: a + b)
    best = v.crossJoin(F.broadcast(model)).groupBy("vec_id").agg(F.min(F.struct(d2.alias("d2"), F.col("g"))).alias("b"))
    return best.select("vec_id", F.col("b.g").alias("component"), q(F.sqrt(F.col("b.d2"))).alias("sigma"))


_BIVARIATE = "(-0.5e0*(2e0*1.8378770664093453e0+ln((0.5e0+v1)*(0.4e0+v2)-0.04e0)+((0.4e0+v2)*(f1-1e0)*(f1-1e0)-0.4e0*(f1-1e0)*(f2-2e0)+(0.5e0+v1)*(f2-2e0)*(f2-2e0))/((0.5e0+v1)*(0.4e0+v2)-0.04e0)))"
_FIRST = "(-0.5e0*(1.8378770664093453e0+ln(0.5e0+v1)+(f1-1e0)*(f1-1e0)/(0.5e0+v1)))"


@query("M02, M07, M01", f"WITH {WIDE} SELECT id, {Q(_BIVARIATE)} AS joint, {Q(f'{_BIVARIATE}-{_FIRST}')} AS given FROM w WHERE f1 IS NOT NULL AND f2 IS NOT NULL")
def conditional_logprob(spark, sf):
    """The full-covariance kernel against the closed form in two dimensions."""
    m = mixture.Mixture([1.0], [[1.0, 2.0]], [[[0.5, 0.2], [0.2, 0.4]]])
    w = wide(spark, sf).filter("f1 is not null and f2 is not null").select("id", F.array("f1", "f2").alias("x"), F.array("v1", "v2").alias("var"))
    a = mixture.mixture_columns(w, {"joint": m})
    a = mixture.mixture_columns(a, {"given": m}, "conditional", anchor=0)
    return a.select("id", q(F.col("joint")).alias("joint"), q(F.col("given")).alias("given"))


@query("M12, M29", f"WITH {VEC}, s AS (SELECT vec_id, g, lp FROM lp WHERE g<5), z AS (SELECT vec_id, 0.3e0+(vec_id%13)*0.4e0 AS z FROM embeddings), u AS (SELECT vec_id, greatest(0e0,least(4e0,z-0.5e0)) AS u FROM z), j AS (SELECT u.vec_id, u, a.lp AS a, b.lp AS b, u-a.g AS t FROM u JOIN s a ON a.vec_id=u.vec_id AND a.g=least(3,floor(u)) JOIN s b ON b.vec_id=u.vec_id AND b.g=a.g+1) SELECT vec_id, {Q('greatest(a,b)+ln((1e0-t)*exp(a-greatest(a,b))+t*exp(b-greatest(a,b)))')} AS lp FROM j")
def slice_interpolation(spark, sf):
    w = class_wide(spark, sf).select("vec_id", F.slice("lp", 1, 5).alias("lp"))
    z = F.lit(0.3) + (F.col("vec_id") % 13) * 0.4
    return w.select("vec_id", q(score.slice_density(F.col("lp"), z, 0.5, 1.0, 5)).alias("lp"))


_POST = f"""WITH {VEC}, s AS (SELECT vec_id, g, lp, max(lp) OVER (PARTITION BY vec_id) AS top FROM lp WHERE g<5),
e2 AS (SELECT vec_id, g, exp(lp-top) AS e FROM s), a AS (SELECT vec_id, sum(CASE WHEN g IN (0,4) THEN 0.5e0 ELSE 1e0 END*e) AS area FROM e2 GROUP BY 1), p AS (SELECT vec_id, g, e/area AS p FROM e2 JOIN a USING (vec_id))"""


@query("M13, W10", f"{_POST} SELECT vec_id, g AS node, {Q('p')} AS p FROM p")
def redshift_posterior(spark, sf):
    grid = F.array(*[F.lit(float(i)) for i in range(5)])
    p = score.grid_posterior(F.slice("lp", 1, 5), grid)
    return class_wide(spark, sf).select("vec_id", F.posexplode(p).alias("node", "p")).select("vec_id", "node", q(F.col("p")).alias("p"))


@query("M14, W06", f"{_POST}, seg AS (SELECT vec_id, g, p, lead(p) OVER (PARTITION BY vec_id ORDER BY g) AS n, greatest(0.7e0,g) AS a, least(3.2e0,g+1) AS b FROM p) SELECT vec_id, {Q('sum(CASE WHEN n IS NOT NULL AND b>a THEN (p+(n-p)*((a+b)/2e0-g))*(b-a) ELSE 0e0 END)')} AS p FROM seg GROUP BY 1")
def p_match(spark, sf):
    grid = F.array(*[F.lit(float(i)) for i in range(5)])
    w = class_wide(spark, sf).withColumn("p", score.grid_posterior(F.slice("lp", 1, 5), grid))
    return w.select("vec_id", q(score.window_probability(F.col("p"), grid, F.lit(0.7), F.lit(3.2))).alias("p"))


_HYP = f"""WITH {VEC}, w AS (SELECT vec_id, max(CASE WHEN g=0 THEN lp END) AS l0, {", ".join(f"max(CASE WHEN g={i} THEN lp END) AS l{i}" for i in range(1, 10))} FROM lp GROUP BY 1),
h AS (SELECT vec_id, l0-2e0 AS same, greatest(l1,l2,l3,l4)-1e0 AS field, greatest(l5,l6,l7,l8,l9) AS bkg, -0.5e0*64e0*1.8378770664093453e0-20e0 AS outl FROM w), t AS (SELECT *, greatest(same,field,bkg,outl) AS top FROM h), x AS (SELECT *, exp(same-top) AS s, exp(field-top) AS f, exp(bkg-top) AS b, exp(outl-top) AS o FROM t)"""


def hypotheses(spark, sf):
    """Log intensities of four hypotheses for each vector: the first class, the next four, the rest, and a broad density."""
    lp = F.col("lp")
    at = [F.get(lp, i) for i in range(10)]
    return class_wide(spark, sf).select(
        "vec_id", (at[0] - 2.0).alias("same"), (F.greatest(*at[1:5]) - 1.0).alias("field"), F.greatest(*at[5:]).alias("bkg"), F.lit(-0.5 * 64.0 * 1.8378770664093453 - 20.0).alias("outl")
    )


@query("X01, X02, X03, X05, M19", f"{_HYP} SELECT vec_id, {Q('s/(s+f+b+o)')} AS p_same, {Q('s/(s+b+o)')} AS p_vs_background, {Q('(s+f)/(s+f+b+o)')} AS p_object, {Q('o/(s+f+b+o)')} AS p_outlier, {Q('top+ln(s+f+b+o)')} AS log_total, CASE WHEN vec_id%17=0 THEN 'blended_not_scored' WHEN bkg < -90e0 THEN 'window_outside_model_support' ELSE 'ok' END AS status FROM x")
def four_hypothesis_score(spark, sf):
    h = hypotheses(spark, sf)
    p = score.posterior(F.col("same"), F.col("field"), F.col("bkg"), F.col("outl"))
    status = score.first_status((F.col("vec_id") % 17 == 0, "blended_not_scored"), (F.col("bkg") < -90.0, "window_outside_model_support"))
    return h.select("vec_id", *[q(c).alias(n) for n, c in p.items()], status.alias("status"))


@query("X04", f"{_HYP} SELECT vec_id, {Q('greatest(s/(s+b),s/(s+b+o),s/(s+f+b))-least(s/(s+b),s/(s+b+o),s/(s+f+b))')} AS spread FROM x WHERE s+b > 0")
def compare_backgrounds(spark, sf):
    h = hypotheses(spark, sf)
    top = F.greatest("same", "field", "bkg", "outl")
    s, f, b, o = (F.exp(F.col(c) - top) for c in ("same", "field", "bkg", "outl"))
    return h.filter((s + b) > 0).select("vec_id", q(score.spread(s / (s + b), s / (s + b + o), s / (s + f + b))).alias("spread"))


@query("X10, X11, P40", f"WITH {WIDE}, g AS (SELECT unnest(range(0,21))::INT AS i), l AS (SELECT id, i, -0.5e0*pow((f2-(f1+(i-10)*0.2e0))/0.5e0,2e0) AS a, -0.5e0*pow((i-10)*0.2e0,2e0) AS p FROM w, g WHERE f1 IS NOT NULL AND f2 IS NOT NULL), t AS (SELECT id, i, a+p AS t, max(a+p) OVER (PARTITION BY id) AS top FROM l) SELECT id, {Q('max(top)+ln(sum(CASE WHEN i IN (0,20) THEN 0.5e0 ELSE 1e0 END*0.2e0*exp(t-top)))')} AS lp FROM t GROUP BY id")
def fallback_marginalised(spark, sf):
    w = wide(spark, sf).filter("f1 is not null and f2 is not null")
    grid = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: (i - 10) * F.lit(0.2))
    like = F.transform(grid, lambda g: F.lit(-0.5) * F.pow((F.col("f2") - (F.col("f1") + g)) / 0.5, F.lit(2.0)))
    prior = F.transform(grid, lambda g: F.lit(-0.5) * F.pow(g, F.lit(2.0)))
    return w.select("id", q(score.marginalise(like, prior, grid)).alias("lp"))


@query("E23", f"WITH {SCORED} SELECT id, {Q('CASE WHEN label=1 THEN 0e0 ELSE score*0.3e0/(score*0.3e0+1e0-score) END')} AS p FROM t")
def unrecognised_members(spark, sf):
    return scored(spark, sf).select("id", q(score.unrecognised(F.col("score"), F.col("label") == 1, 0.7)).alias("p"))


@query("V01, W03", f"WITH {SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score)+(count(*) OVER (PARTITION BY score)-1)/2e0 AS r FROM t) SELECT {Q('(sum(CASE WHEN label=1 THEN r END)-count(CASE WHEN label=1 THEN 1 END)*(count(CASE WHEN label=1 THEN 1 END)+1)/2e0)/(count(CASE WHEN label=1 THEN 1 END)*count(CASE WHEN label=0 THEN 1 END)::DOUBLE)')} AS auc, count(CASE WHEN label=1 THEN 1 END) AS n1, count(CASE WHEN label=0 THEN 1 END) AS n0 FROM r")
def rank_auc(spark, sf):
    return metrics.auc(scored(spark, sf)).select(q(F.col("auc")).alias("auc"), "n1", "n0")


@query("V02, W07, V10", f"WITH {SCORED}, h AS (SELECT unnest([0.1e0,0.3e0,0.5e0,0.7e0,0.9e0]) AS threshold) SELECT threshold, {Q('count(CASE WHEN label=1 AND score>=threshold THEN 1 END)/count(CASE WHEN label=1 THEN 1 END)::DOUBLE')} AS tpr, {Q('count(CASE WHEN label=0 AND score>=threshold THEN 1 END)/count(CASE WHEN label=0 THEN 1 END)::DOUBLE')} AS fpr FROM t, h GROUP BY threshold")
def roc_points(spark, sf):
    r = metrics.roc(scored(spark, sf), [0.1, 0.3, 0.5, 0.7, 0.9])
    return r.select("threshold", q(F.col("tpr")).alias("tpr"), q(F.col("fpr")).alias("fpr"))


@query("V03", f"WITH {SCORED} SELECT CAST(least(9,floor(score*10)) AS INT) AS bin, {Q('avg(score)')} AS mean_p, {Q('avg(label::DOUBLE)')} AS rate, count(*) AS n FROM t GROUP BY 1 HAVING count(*) >= 20")
def reliability_bins(spark, sf):
    return metrics.reliability(scored(spark, sf), 10, 20).select("bin", q(F.col("mean_p")).alias("mean_p"), q(F.col("rate")).alias("rate"), "n")


@query("V04", f"WITH {SCORED} SELECT {Q('-sum((1e0+block)*CASE WHEN label=1 THEN ln(score) ELSE ln(1e0-score) END)/sum(1e0+block)')} AS log_loss FROM t")
def weighted_log_loss(spark, sf):
    return metrics.log_loss(scored(spark, sf), weight=F.lit(1.0) + F.col("block")).select(q(F.col("log_loss")).alias("log_loss"))


@query("A18, W05", f"WITH {SCORED}, s AS (SELECT score, sum(1e0+block%3) AS w FROM t GROUP BY 1), r AS (SELECT score, sum(w) OVER (ORDER BY score) AS run, sum(w) OVER () AS tot FROM s) SELECT {Q('min(score)')} AS value FROM r WHERE run >= 0.9e0*tot")
def weighted_quantile(spark, sf):
    t = scored(spark, sf).select(F.col("score").alias("x"), (F.lit(1.0) + F.col("block") % 3).alias("w"))
    return metrics.weighted_quantile(t, 0.9).select(q(F.col("value")).alias("value"))


@query("A18, V05, E12", f"WITH {SCORED} SELECT block, {Q('median(score)')} AS med, {Q('quantile_cont(score,0.9e0)')} AS q90, count(CASE WHEN score > 0.5e0 THEN 1 END) AS above, count(CASE WHEN score > 0.5e0 AND label=1 THEN 1 END) AS hits FROM t GROUP BY block")
def strata_performance(spark, sf):
    t = scored(spark, sf)
    return t.groupBy("block").agg(q(F.percentile("score", F.lit(0.5))).alias("med"), q(F.percentile("score", F.lit(0.9))).alias("q90"), F.count(F.when(F.col("score") > 0.5, 1)).alias("above"), F.count(F.when((F.col("score") > 0.5) & (F.col("label") == 1), 1)).alias("hits"))


@query("W05", f"WITH {MEAS}, s AS (SELECT channel, CAST(floor(flux) AS BIGINT) AS b, count(*) AS n FROM m GROUP BY ALL) SELECT channel, b, {Q('sum(n) OVER (PARTITION BY channel ORDER BY b)/sum(n) OVER (PARTITION BY channel)')} AS cdf FROM s")
def cumulative_distribution(spark, sf):
    from .inputs import meas

    s = meas(spark, sf).groupBy("channel", F.floor("flux").alias("b")).agg(F.count("*").alias("n"))
    return s.select("channel", "b", q(F.sum("n").over(Window.partitionBy("channel").orderBy("b")) / F.sum("n").over(Window.partitionBy("channel"))).alias("cdf"))


@query("W16, V08", f"WITH {SCORED}, b AS (SELECT block, count(CASE WHEN label=1 AND score>0.5e0 THEN 1 END) AS hit, sum(label) AS n FROM t GROUP BY 1), d AS (SELECT b.*, draw, {times_sql('block', 'draw')} AS times FROM b, (SELECT unnest(range(0,200)) AS draw)), s AS (SELECT draw, sum(times*hit) AS hit, sum(times*n) AS n FROM d GROUP BY draw) SELECT CAST(draw AS INT) AS draw, CAST(hit AS BIGINT) AS hit, CAST(n AS BIGINT) AS n, hit::DOUBLE/nullif(n,0)::DOUBLE AS recall FROM s")
def block_bootstrap(spark, sf):
    """Recall above one half in 200 resamplings of blocks."""
    b = scored(spark, sf).groupBy("block").agg(F.count_if((F.col("label") == 1) & (F.col("score") > 0.5)).alias("hit"), F.sum("label").alias("n"))
    drawn = metrics.block_bootstrap(b, "block", 200, [F.sum(F.col("times") * F.col("hit")).alias("hit"), F.sum(F.col("times") * F.col("n")).alias("n")])
    return drawn.select("draw", "hit", "n", F.try_divide("hit", "n").alias("recall"))


def _em_sql(iterations: int) -> str:
    steps = [f"WITH {VEC}, l AS (SELECT vec_id, label%3 AS grp, g, exp(lp-max(lp) OVER (PARTITION BY vec_id)) AS x FROM lp), w0 AS (SELECT DISTINCT grp, g, 0.1e0 AS w FROM l)"]
    for i in range(iterations):
        steps.append(f"z{i} AS (SELECT vec_id, sum(x*w) AS z FROM l JOIN w{i} USING (grp, g) GROUP BY 1), w{i + 1} AS (SELECT grp, g, avg(x*w/z) AS w FROM l JOIN w{i} USING (grp, g) JOIN z{i} USING (vec_id) GROUP BY ALL)")
    return ", ".join(steps) + f" SELECT grp, g, {Q('w')} AS w FROM w{iterations}"


@query("A21", _em_sql(3))
def weight_em(spark, sf):
    from .skyjoin import _checkpoints

    _checkpoints(spark)
    lp = class_log_probs(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 3).alias("grp")), "vec_id")
    w = estimate.component_weights(lp.select("grp", F.col("vec_id").alias("row"), F.col("g").alias("k"), "lp"), ["grp"], 3)
    return w.select("grp", F.col("k").alias("g"), q(F.col("w")).alias("w"))


def _nested_sql() -> str:
    """Three rounds on the sphere, then three in parents and cells, drawn to what is above by n / (n + 25)."""
    out = [f"WITH {VEC}, l AS (SELECT vec_id, vec_id%48 AS pix, 1e0+vec_id%3 AS sw, g, exp(lp-max(lp) OVER (PARTITION BY vec_id)) AS e FROM lp WHERE g < 3)", "w0 AS (SELECT 0 AS level, 0::BIGINT AS cell, g, 1e0/3e0 AS w FROM (VALUES (0), (1), (2)) t(g))", "r AS (SELECT 0 AS level, 0::BIGINT AS cell, * FROM l)", "s AS (SELECT 1 AS level, pix>>2 AS cell, * FROM l UNION ALL SELECT 2, pix, * FROM l)"]
    for rows, a, b in (("r", "w", 0), ("s", "v", 3)):
        if b:
            out.append("v0 AS (SELECT DISTINCT s.level, s.cell, w3.g, w3.w FROM s, w3)")
        for i in range(3):
            out.append(f"{a}x{i} AS (SELECT {rows}.*, e*w/sum(e*w) OVER (PARTITION BY {rows}.level, {rows}.cell, vec_id) AS q FROM {rows} JOIN {a}{i} USING (level, cell, g)), {a}{i + 1} AS (SELECT level, cell, g, sum(sw*q)/max(n) AS w, max(n) AS n FROM (SELECT *, sum(sw*q) OVER (PARTITION BY level, cell) AS n FROM {a}x{i}) GROUP BY level, cell, g)")
    out.append("p AS (SELECT v3.level, v3.cell, v3.g, v3.n, v3.n/(v3.n+25e0)*v3.w+25e0/(v3.n+25e0)*w3.w AS w FROM v3 JOIN w3 USING (g) WHERE v3.level=1), c AS (SELECT v3.level, v3.cell, v3.g, v3.n, v3.n/(v3.n+25e0)*v3.w+25e0/(v3.n+25e0)*p.w AS w FROM v3 JOIN p ON p.cell=v3.cell>>2 AND p.g=v3.g WHERE v3.level=2)")
    return ", ".join(out) + f" SELECT CAST(level AS INT) AS level, cell, CAST(g AS INT) AS g, {Q('n')} AS n, {Q('w')} AS w FROM (SELECT level, cell, g, n, w FROM w3 UNION ALL SELECT * FROM p UNION ALL SELECT * FROM c)"


@query("E09", _nested_sql())
def nested_cell_weights(spark, sf):
    from .skyjoin import _checkpoints

    _checkpoints(spark)
    lp = class_log_probs(spark, sf).filter("g < 3").groupBy("vec_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("g", "lp"))), lambda s: s["lp"]).alias("lp"))
    i = F.col("vec_id")
    w = density.nested_weights(lp.select((i % 48).alias("pix"), (F.lit(1.0) + i % 3).alias("sw"), "lp"), [1 / 3] * 3, 2, 25.0, 3)
    return w.select("level", "cell", q(F.col("n")).alias("n"), F.posexplode("w").alias("g", "w")).withColumn("w", q(F.col("w")))


@query("A20, E12")
def mixing_fraction(spark, sf):
    h = hypotheses(spark, sf)
    return spark.createDataFrame([(estimate.mixing_fraction(h, "bkg", "field"),)], "eta double")


@query("E01, E02, E13, A11")
def xd_fit(spark, sf):
    """Two components over three incomplete noisy channels."""
    w = wide(spark, sf).select("id", F.array("f1", "f2", "f3").alias("x"), F.array("v1", "v2", "v3").alias("var"))
    start = mixture.Mixture([0.5, 0.5], [[1.0] * 3, [8.0] * 3], np.tile(10.0 * np.eye(3), (2, 1, 1)))
    m, history = estimate.fit_mixture(w, start, iterations=8)
    return spark.createDataFrame([(k, float(m.weights[k]), m.means[k].tolist(), m.covs[k].ravel().tolist(), len(history), history[-1]) for k in range(2)], "k int, weight double, mean array<double>, cov array<double>, passes int, log_density double")


def _em1_sql(rows: str, keys: str, start: str, rounds: int, t: str = "t") -> str:
    """CTEs {t}f1 to {t}f{rounds} (keys, k, w, m, v): EM of one-dimensional mixtures of ``rows`` (keys, id, x, s) from ``start``."""
    out = []
    for i in range(rounds):
        old = start if i == 0 else f"{t}f{i}"
        out += [
            f"{t}g{i} AS (SELECT r.*, k, w, m, v, ln(w)-0.5e0*(ln(v+s)+1.8378770664093453e0+(x-m)*(x-m)/(v+s)) AS lp FROM {rows} r JOIN {old} USING ({keys}))",
            f"{t}h{i} AS (SELECT *, max(lp) OVER (PARTITION BY {keys}, id) AS top FROM {t}g{i})",
            f"{t}q{i} AS (SELECT *, exp(lp-top)/sum(exp(lp-top)) OVER (PARTITION BY {keys}, id) AS q, v*(x-m)/(v+s) AS b, v-v*v/(v+s) AS bb FROM {t}h{i})",
            f"{t}p{i} AS (SELECT {keys}, k, sum(q) AS q0, sum(q*b)/sum(q) AS d, sum(q*(bb+b*b))/sum(q) AS c, max(m) AS m FROM {t}q{i} GROUP BY {keys}, k)",
            f"{t}f{i + 1} AS (SELECT {keys}, k, q0/sum(q0) OVER (PARTITION BY {keys}) AS w, m+d AS m, c-d*d+1e-6 AS v FROM {t}p{i})",
        ]
    return ", ".join(out)


def _ll1_sql(model: str, i: int) -> str:
    """Mean log density of fitted and held-out rows of ``r`` under a model."""
    return f"SELECT {i} AS round, {Q('avg(CASE WHEN bin<>4 THEN ll END)')} AS fit, {Q('avg(CASE WHEN bin=4 THEN ll END)')} AS held FROM (SELECT bin, max(top)+ln(sum(exp(lp-top))) AS ll FROM (SELECT *, max(lp) OVER (PARTITION BY id) AS top FROM (SELECT id, bin, ln(w)-0.5e0*(ln(v+s)+1.8378770664093453e0+(x-m)*(x-m)/(v+s)) AS lp FROM r, {model})) GROUP BY id, bin)"


START = mixture.Mixture([0.5, 0.5], [[2.0], [9.0]], [[[9.0]], [[9.0]]])
_START = "(0, 0.5e0, 2e0, 9e0), (1, 0.5e0, 9e0, 9e0)"
#: A few crowded cells and many thin ones; the coarser key has five values.
CELL = "CASE WHEN id % 10 < 7 THEN id % 2 ELSE 10 + id % 97 END"
_ROWS = f"r AS (SELECT id, f1 AS x, v1 AS s, id % 5 AS bin, {CELL} AS cell FROM w WHERE f1 IS NOT NULL)"


def cells(spark, sf):
    return wide(spark, sf).filter("f1 is not null").select("id", (F.col("id") % 5).alias("bin"), F.expr(CELL).alias("cell"), F.array("f1").alias("x"), F.array("v1").alias("var"))


_GROUPS = f"""WITH {WIDE}, {_ROWS}, b0 AS (SELECT * FROM (SELECT DISTINCT bin FROM r), (VALUES {_START}) t(k, w, m, v)), {_em1_sql('r', 'bin', 'b0', 2)},
n AS (SELECT bin, cell, count(*) AS n FROM r GROUP BY ALL), c0 AS (SELECT bin, cell, k, w, m, v FROM n JOIN tf2 USING (bin) WHERE n >= 30), {_em1_sql('r', 'bin, cell', 'c0', 2, 'u')},
c AS (SELECT bin, cell, n, k, coalesce(u.w, t.w) AS w, coalesce(u.m, t.m) AS m, coalesce(u.v, t.v) AS v FROM n JOIN tf2 t USING (bin) LEFT JOIN uf2 u USING (bin, cell, k))"""


@query("E05, E06", f"{_GROUPS} SELECT bin, cell, CAST(k AS INT) AS k, n, CASE WHEN n >= 30 THEN 'own' ELSE 'parent' END AS source, {Q('w')} AS weight, {Q('m')} AS mean, {Q('v')} AS var FROM c")
def grouped_fits(spark, sf):
    """Two rounds for each bin, then two from there for each of its cells with 30 rows or more; the others take their bin's model."""
    from .skyjoin import _checkpoints

    _checkpoints(spark)
    f = estimate.fit_groups(cells(spark, sf), ["bin", "cell"], START, 30, iterations=2, tolerance=0.0, parents=[["bin"]])
    return f.select("bin", "cell", "k", "n", "source", q(F.col("weight")).alias("weight"), q(F.get("mean", F.lit(0))).alias("mean"), q(F.get("cov", F.lit(0))).alias("var"))


@query("X24", f"{_GROUPS}, a AS (SELECT cell, bin, n, 1e0 + cell % 3 AS area FROM n WHERE cell % 2 = 0), d AS (SELECT bin, sum(n) AS n, sum(n)/sum(area) AS density FROM a GROUP BY bin) SELECT bin, cell, CAST(k AS INT) AS k, {Q('w*c.n/d.n')} AS weight, {Q('m')} AS mean, {Q('density')} AS density FROM c JOIN d USING (bin) WHERE cell % 2 = 0")
def footprint_background(spark, sf):
    """The fields with an even number, all of one bin as one model and one density."""
    from .skyjoin import _checkpoints

    _checkpoints(spark)
    f = estimate.fit_groups(cells(spark, sf), ["bin", "cell"], START, 30, iterations=2, tolerance=0.0, parents=[["bin"]]).checkpoint()
    areas = f.filter("k = 0 and cell % 2 = 0").select("bin", "cell", (F.lit(1.0) + F.col("cell") % 3).alias("area"))
    return estimate.pooled_models(f, ["bin", "cell"], areas, ["bin"]).select("bin", "cell", "k", q(F.col("weight")).alias("weight"), q(F.get("mean", F.lit(0))).alias("mean"), q(F.col("density")).alias("density"))


_HELD = f"WITH {WIDE}, {_ROWS}, one AS (SELECT 1 AS one, id, x, s FROM r WHERE bin <> 4), b0 AS (SELECT 1 AS one, * FROM (VALUES {_START}) t(k, w, m, v)), {_em1_sql('one', 'one', 'b0', 2)} " + " UNION ALL ".join(_ll1_sql("b0" if i == 0 else f"tf{i}", i) for i in range(3))


@query("E14, E15, E16", _HELD)
def held_out_rounds(spark, sf):
    """Mean log densities before each of three rounds, of the fitted rows and of the held-out fifth."""
    fit = estimate.fit_rounds(cells(spark, sf), START, 3, 0.0, held_out=F.col("bin") == 4, patience=9)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(fit.history, fit.held))], "round int, fit double, held double").select("round", q(F.col("fit")).alias("fit"), q(F.col("held")).alias("held"))


#: Two classes over three channels; the members' model changes with redshift.
MEMBER = [mixture.Mixture([0.6, 0.4], [[2.0 + i, 3.0, 2.0], [7.0, 6.0 - i, 8.0]], np.tile(6.0 * np.eye(3) + 2.0, (2, 1, 1))) for i in range(3)]
OTHERS = mixture.Mixture([1.0], [[5.0, 5.0, 5.0]], [[[9.0, 1.0, 0.5], [1.0, 8.0, 2.0], [0.5, 2.0, 7.0]]])


def three(spark, sf):
    return wide(spark, sf).select("id", F.array("f1", "f2", "f3").alias("x"), F.array("v1", "v2", "v3").alias("var"), ((F.col("id") % 400) / 100.0).alias("z"))


JOINT = mixture.Mixture([0.7, 0.3], [[3.0, 1.5], [9.0, 2.5]], [[[6.0, 0.9], [0.9, 0.5]], [[8.0, -0.6], [-0.6, 0.4]]])


def _joint_sql() -> str:
    # erf without cancellation: a series of positive terms
    erf = "CASE WHEN abs({0}) > 6e0 THEN sign({0}) WHEN {0} = 0e0 THEN 0e0 ELSE sign({0})*1.1283791670955126e0*exp(-{0}*{0})*list_sum(list_transform(range(0, 140), lambda i: exp(2e0*i*ln(2e0)+(2e0*i+1e0)*ln(abs({0}))-lgamma(2e0*i+2e0)+lgamma(i+1e0)))) END".format
    share = lambda lo, hi: f"0.5e0*(({erf(f'(({hi}-zm)/sqrt(2e0*zv))')})-({erf(f'(({lo}-zm)/sqrt(2e0*zv))')}))"
    return f"""WITH {WIDE}, k AS (SELECT * FROM (VALUES (0.7e0, 3e0, 1.5e0, 6e0, 0.9e0, 0.5e0), (0.3e0, 9e0, 2.5e0, 8e0, -0.6e0, 0.4e0)) t(w, mc, mz, cc, cz, zz)),
r AS (SELECT id, f1, v1, (id%400)/100e0 AS z FROM w WHERE f1 IS NOT NULL),
g AS (SELECT id, z, w*exp(-0.5e0*(f1-mc)*(f1-mc)/(cc+v1))/sqrt(cc+v1) AS q, mz+cz*(f1-mc)/(cc+v1) AS zm, zz-cz*cz/(cc+v1) AS zv FROM r, k),
s AS (SELECT id, z, sum(q*({share('0.5e0', '3.5e0')}))/sum(q) AS inside, sum(q*exp(-0.5e0*(z-zm)*(z-zm)/zv)/sqrt(6.283185307179586e0*zv))/sum(q) AS p, sum(q*greatest(0e0, {share('greatest(0.5e0, z-0.2e0)', 'least(3.5e0, z+0.2e0)')}))/sum(q) AS win FROM g GROUP BY id, z)
SELECT id, CASE WHEN z >= 0.5e0 AND z <= 3.5e0 THEN {Q('ln(p/inside)')} END AS log_density, {Q('CASE WHEN least(3.5e0, z+0.2e0) > greatest(0.5e0, z-0.2e0) THEN win/inside ELSE 0e0 END')} AS mass FROM s"""


@query("M15", _joint_sql())
def joint_redshift(spark, sf):
    """Density at each object's redshift and mass of a window around it, from a joint mixture of one colour and redshift."""
    z = (F.col("id") % 400) / 100.0
    rows = wide(spark, sf).filter("f1 is not null").select("id", F.array("f1").alias("x"), F.array("v1").alias("var"))
    t = joint.redshift_columns(rows, JOINT, (0.5, 3.5), z, (z - 0.2, z + 0.2))
    return t.select("id", q(F.col("log_density")).alias("log_density"), q(F.col("mass")).alias("mass"))


@query("X09", f"WITH {WIDE}, t AS (SELECT id, 9e0+v1 AS va, f1-5e0 AS d, 5e0+(f1-5e0)/(9e0+v1) AS m2, 5e0+0.5e0*(f1-5e0)/(9e0+v1) AS m3, f2, f3, v2, v3 FROM w), c AS (SELECT id, f2-m2 AS a, f3-m3 AS b, 8e0+v2-1e0/va AS p, 2e0-0.5e0/va AS o, 7e0+v3-0.25e0/va AS r, d IS NOT NULL AS ref FROM t), s AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (r*a*a-2e0*o*a*b+p*b*b)/(p*r-o*o) END AS t2 FROM c) SELECT id, {Q('sqrt(t2)')} AS distance, {Q('exp(-t2/2e0)')} AS tail FROM s WHERE t2 IS NOT NULL")
def closed_tail(spark, sf):
    """Tail of one Gaussian class given the first channel, of objects with three: closed."""
    t = support.support_columns(three(spark, sf).filter("x[0] is not null and x[1] is not null and x[2] is not null"), [OTHERS], 0)
    return t.select("id", q(F.col("distance")).alias("distance"), q(F.col("tail")).alias("tail"))


@query("M04")
def outlier_tail(spark, sf):
    """Each object's distance from one Gaussian class, and its rank among all objects' distances."""
    from .skyjoin import _checkpoints

    m = mixture.Mixture([1.0], [[5.0, 5.0]], [[[9.0, 1.0], [1.0, 9.0]]])
    w = wide(spark, sf).filter("f1 is not null and f2 is not null").select("id", F.array("f1", "f2").alias("x"), F.array("v1", "v2").alias("var"))
    _checkpoints(spark)
    # written once: ranks are joined back on the distance, which must be the same double
    d = mixture.mixture_columns(w, {"sigma": m}, "nearest").select("id", "sigma").checkpoint()
    return score.tail_p_value(d, "sigma", d).select("id", q(F.col("sigma")).alias("sigma"), q(F.col("p")).alias("p"))


@query("X08, X09, P37, M27")
def support_percentile(spark, sf):
    """Rank of every object among draws of the members' model at its redshift, given its first measured channel; both classes' tails and the flag."""
    anchor = F.array_position(F.transform("x", lambda v: v.isNotNull()), True) - 1
    member = support.support_columns(three(spark, sf), MEMBER, anchor, support.slice_shares(F.col("z"), [0.5, 1.5, 2.5], 0.2, 3.4), draws=64, seed=5)
    member = member.withColumnsRenamed({"log_density": "member_log_density", "percentile": "support", "distance": "member_distance", "tail": "member_tail", "status": "member_status"})
    both = support.support_columns(member, [OTHERS], anchor, draws=64, seed=5)
    return both.select("id", "member_status", "support", "member_tail", F.col("tail").alias("other_tail"), support.outside_both(F.col("member_tail"), F.col("tail"), 0.05).alias("outside_both"))


@query("A18, W05", f"WITH {SCORED}, n AS (SELECT count(*) AS n FROM t), r AS (SELECT id, score, rank() OVER (ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY score) AS ties FROM t WHERE label=1) SELECT id, {Q('score')} AS score, {Q('(r+ties)::DOUBLE/((SELECT count(*) FROM t WHERE label=1)+1)')} AS p FROM r")
def empirical_tail(spark, sf):
    """The tail of each member's score among all members'."""
    t = scored(spark, sf).filter("label = 1")
    return score.tail_p_value(t, "score", t).select("id", q(F.col("score")).alias("score"), q(F.col("p")).alias("p"))


@query("", "SELECT CAST(floor(epoch(ts)/3600) AS BIGINT) AS hour, event_type, count(*) AS n, " + Q("avg(value)") + " AS mean FROM events GROUP BY ALL")
def windowed_rates(spark, sf):
    from lumenframe.streaming.score import windowed_rates as rates

    e = table(spark, sf, "events")
    r = rates(e, "ts", "event_type")
    return r.select(F.floor(F.unix_timestamp("w.start") / 3600).alias("hour"), "event_type", "n", q(F.col("mean")).alias("mean"))


@query("A19, A12", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_counts(spark, sf):
    return table(spark, sf, "lineitem").rollup(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
