"""Queries that build catalogues, edges, areas and reports: groups and their preferred members, regions, retention, coverage."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lumenframe.functions import scalar as S
from lumenframe.functions import sky as K
from lumenframe.functions.scalar import quantise as q
from lumenframe.operators import density as D
from lumenframe.operators import match as M
from lumenframe.operators import metrics, mixture, score, select

from .inputs import SCORED, SEP, SKY_C, SKY_S, WIDE, Q, _frac, A, frac, pairs_sql, scored, sky_c, sky_s, wide
from .measure import _MASK, _lupt, _mask
from .registry import query, table
from .scoring import _POST, class_wide
from .skyjoin import PIX, _checkpoints, pixels

#: Parameters of the queries.
RADIUS = 0.4
ROLES = ("fit", "select", "test")
REGISTRY = {
    "lines": {"id": "l_orderkey", "channel": "l_linenumber", "flux": "l_extendedprice / 5000D", "error": "0.05D + l_tax", "survey": "'lines'"},
    "deep": {"id": "l_orderkey", "channel": "10 + l_linenumber", "flux": "l_extendedprice * (1D - l_discount) / 5000D", "error": "0.02D + l_tax", "survey": "'deep'"},
}
_Z = lambda k: f"(0.2e0+3e0*{_frac(k, 0.3819660112501051)})"


def _z(k):
    return F.lit(0.2) + F.lit(3.0) * frac(k, 0.3819660112501051)


@query("U05", "SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_regionkey FROM nation")
def id_union(spark, sf):
    ids = [table(spark, sf, t).select(F.col(c).cast("long").alias("id")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_regionkey"))]
    return ids[0].union(ids[1]).union(ids[2]).distinct()


@query("S33", "SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem")
def identifier_links(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()


@query("S08, P46", "SELECT l_orderkey AS id, l_linenumber AS channel, l_extendedprice/5000e0 AS flux, 0.05e0+l_tax AS error, 'lines' AS survey FROM lineitem UNION ALL SELECT l_orderkey, 10+l_linenumber, l_extendedprice*(1e0-l_discount)/5000e0, 0.02e0+l_tax, 'deep' FROM lineitem")
def survey_projection(spark, sf):
    t = table(spark, sf, "lineitem")
    one, two = (t.select(*select.projection(REGISTRY, name, t.columns)) for name in ("lines", "deep"))
    return one.unionByName(two)


_COMPONENTS = f"{SKY_C}, {pairs_sql('c', 'c', RADIUS)}, t(a, b) AS (SELECT id, id FROM c UNION SELECT t.a, p.r_id FROM t JOIN p ON t.b = p.l_id), g AS (SELECT a AS id, min(b) AS component FROM t GROUP BY a)"


@query("X18, W04, A14, J24", f"WITH RECURSIVE {_COMPONENTS}, m AS (SELECT g.component, g.id, {_Z('g.id')} AS z, g.id%4<>0 AS valid, g.id%3=0 AS clean, CASE WHEN g.id%2=0 THEN 'a' ELSE 'b' END AS source FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY NOT valid, NOT clean, source, id) AS n FROM m), x AS (SELECT component, count(*) AS members, count(CASE WHEN source='a' THEN 1 END) AS members_a, min(CASE WHEN valid THEN z END) AS z0, max(CASE WHEN valid THEN z END) AS z1 FROM m GROUP BY 1), f AS (SELECT g.component, max(CASE WHEN l.id=r.id THEN 0e0 ELSE {SEP} END) AS far FROM k JOIN g USING (component) JOIN cv l ON l.id=k.id JOIN cv r ON r.id=g.id WHERE n=1 GROUP BY 1) SELECT component, k.id AS preferred, k.source, k.clean, members, members_a, {Q('(z1-z0)/(1e0+z0)')} AS span, coalesce((z1-z0)/(1e0+z0)>0.05e0,false) AS conflict, {Q('far')} AS separation FROM x JOIN k USING (component) JOIN f USING (component) WHERE n=1")
def master_catalogue(spark, sf):
    """One row of each group of neighbours: its preferred member (a valid redshift, a clean spectrum, the source, the id), counts, redshift span and extent."""
    _checkpoints(spark)
    c = sky_c(spark, sf)
    g = M.connected_within(c, RADIUS)
    i = F.col("id")
    m = c.select("id", "ra", "dec").hint("merge").join(g, "id").select("component", "id", "ra", "dec", _z(i).alias("z"), (i % 4 != 0).alias("valid"), (i % 3 == 0).alias("clean"), F.when(i % 2 == 0, "a").otherwise("b").alias("source")).checkpoint()
    best = M.best_in_group(m, "component", [~F.col("valid"), ~F.col("clean"), F.col("source"), i]).select("component", F.col("id").alias("preferred"), "source", "clean", F.col("ra").alias("ra0"), F.col("dec").alias("dec0"))
    ok = F.when(F.col("valid"), F.col("z"))
    x = m.groupBy("component").agg(F.count("*").alias("members"), F.count(F.when(F.col("source") == "a", 1)).alias("members_a"), F.min(ok).alias("z0"), F.max(ok).alias("z1"))
    sep = F.when(i == F.col("preferred"), F.lit(0.0)).otherwise(K.separation_deg(K.chord2(K.unit_vector(F.col("ra"), F.col("dec")), K.unit_vector(F.col("ra0"), F.col("dec0")))))
    far = m.select("component", "id", "ra", "dec").hint("merge").join(best, "component").groupBy("component").agg(F.max(sep).alias("far"))
    span = (F.col("z1") - F.col("z0")) / (F.lit(1.0) + F.col("z0"))
    out = best.drop("ra0", "dec0").hint("merge").join(x, "component").hint("merge").join(far, "component")
    return out.select("component", "preferred", "source", "clean", "members", "members_a", q(span).alias("span"), F.coalesce(span > 0.05, F.lit(False)).alias("conflict"), q(F.col("far")).alias("separation"))


_SAME = f"abs({_Z('l_id')}-{_Z('r_id')})/(1e0+least({_Z('l_id')},{_Z('r_id')})) < 0.8e0"


@query("J25", f"WITH RECURSIVE {SKY_C}, {pairs_sql('c', 'c', RADIUS)}, e AS (SELECT l_id AS a, r_id AS b FROM p WHERE l_id < r_id AND {_SAME}), v AS MATERIALIZED (SELECT b, list(a) AS l, row_number() OVER (ORDER BY b) AS n FROM e GROUP BY b), t(n, b, gone) AS (SELECT 0::BIGINT, 0::BIGINT, []::BIGINT[] UNION ALL SELECT v.n, v.b, CASE WHEN len(list_filter(l, lambda a: NOT list_contains(gone, a))) > 0 THEN list_append(gone, v.b) ELSE gone END FROM t JOIN v ON v.n = t.n+1) SELECT id FROM c WHERE NOT list_contains((SELECT max_by(gone, n) FROM t), id)")
def redshift_dedup(spark, sf):
    """Rows that no kept earlier row agrees with in position and redshift, its difference scaled by one plus the smaller redshift."""
    _checkpoints(spark)
    c = sky_c(spark, sf)
    l, r = _z(F.col("l_id")), _z(F.col("r_id"))
    near = M.self_pairs(c, RADIUS).filter(F.abs(l - r) / (F.lit(1.0) + F.least(l, r)) < 0.8)
    return M.first_independent(c.select("id"), near, F.col("id"))


@query("W14, W20", f"WITH RECURSIVE {SKY_C}, {pairs_sql('c', 'c', RADIUS)}, x AS (SELECT l_id AS id, list(r_id) AS l FROM p WHERE l_id <> r_id GROUP BY 1), v AS MATERIALIZED (SELECT c.id, c.id%25 AS cell, c.id%3 AS role, coalesce(l, []) AS l, row_number() OVER (ORDER BY c.id*7919%10007, c.id) AS n FROM c LEFT JOIN x USING (id)), t(n, id, kept, cells, roles) AS (SELECT 0::BIGINT, 0::BIGINT, []::BIGINT[], []::BIGINT[], []::BIGINT[] UNION ALL SELECT n, id, CASE WHEN ok THEN list_append(kept, id) ELSE kept END, CASE WHEN ok THEN list_append(cells, cell) ELSE cells END, CASE WHEN ok THEN list_append(roles, role) ELSE roles END FROM (SELECT v.n, v.id, v.cell, v.role, kept, cells, roles, NOT list_has_any(kept, v.l) AND len(list_filter(cells, lambda y: y = v.cell)) < 3 AND len(list_filter(roles, lambda y: y = v.role)) < 20 AS ok FROM t JOIN v ON v.n = t.n+1)) SELECT unnest((SELECT max_by(kept, n) FROM t)) AS id")
def spaced_fields(spark, sf):
    """Fields in a fixed random order, apart by the radius, at most three of a cell and twenty of a role."""
    _checkpoints(spark)
    c = sky_c(spark, sf)
    i = F.col("id")
    return M.spaced_selection(c.select("id", (i % 25).alias("cell"), (i % 3).alias("role")), M.self_pairs(c, RADIUS), i * 7919 % 10007, {"cell": 3, "role": 20})


@query("X17, F26, P19", f"WITH {SKY_C}, {pairs_sql('c', 'c', RADIUS)}, d AS (SELECT l_id, r_id, sep, abs({_Z('r_id')}-{_Z('l_id')})/(1e0+{_Z('l_id')})*299792.458e0 AS dv FROM p WHERE l_id < r_id) SELECT l_id, r_id, {Q('sep')} AS sep, {Q('dv')} AS dv, CASE WHEN dv < 2000e0 THEN 'pair' WHEN dv > 10000e0 THEN 'projected' ELSE 'unclear' END AS label FROM d")
def pair_labels(spark, sf):
    c = sky_c(spark, sf)
    dv = S.velocity_difference(_z(F.col("l_id")), _z(F.col("r_id")))
    p = M.self_pairs(c, RADIUS).withColumn("dv", dv)
    return p.select("l_id", "r_id", q(F.col("sep")).alias("sep"), q(F.col("dv")).alias("dv"), F.when(F.col("dv") < 2000, "pair").when(F.col("dv") > 10000, "projected").otherwise("unclear").alias("label"))


_CONE = "n AS (SELECT n_nationkey AS id, 360e0*" + _frac("n_nationkey", A) + " AS ra, n_nationkey*6e0-72e0 AS dec, n_regionkey FROM nation), nv AS (SELECT *, cos(radians(dec))*cos(radians(ra)) AS x, cos(radians(dec))*sin(radians(ra)) AS y, sin(radians(dec)) AS z FROM n)"


@query("J08", f"WITH {PIX}, {_CONE}, {pairs_sql('c', 'n', 20.0)}, l AS (SELECT l_id, max(r_id) AS r FROM p GROUP BY 1) SELECT h.id, CASE WHEN (pix>>4)%7=0 THEN 'test' WHEN r IS NOT NULL THEN ['fit','select','test'][CAST(n_regionkey%3 AS INT)+1] WHEN pix%10<2 THEN 'select' ELSE 'fit' END AS role FROM h LEFT JOIN l ON l_id=h.id LEFT JOIN n ON n.id=r")
def region_roles(spark, sf):
    """A role for each object: test cells first, then the last region that holds it, then its fine cell's."""
    nation = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    cones = nation.select(k.alias("id"), (F.lit(360.0) * frac(k, A)).alias("ra"), (k * 6.0 - 72.0).alias("dec"), "n_regionkey")
    p = pixels(spark, sf)
    last = M.match_pairs(sky_c(spark, sf), cones, 20.0).groupBy("l_id").agg(F.max("r_id").alias("r"))
    named = last.join(cones.select(F.col("id").alias("r"), F.get(F.array(*map(F.lit, ROLES)), (F.col("n_regionkey") % 3).cast("int")).alias("region_role")), "r").select(F.col("l_id").alias("id"), "region_role")
    role = F.when(K.parent_pixel(F.col("pix"), 2) % 7 == 0, "test").when(F.col("region_role").isNotNull(), F.col("region_role")).when(F.col("pix") % 10 < 2, "select").otherwise("fit")
    return p.select("id", "pix").hint("merge").join(named, "id", "left").select("id", role.alias("role"))


@query("J20", "WITH w AS (SELECT DISTINCT user_id AS id FROM events UNION SELECT c_custkey+100000000 FROM customer WHERE c_custkey%50=0), h AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) SELECT w.id, CASE WHEN n IS NULL THEN 'missing' WHEN n>1 THEN 'duplicate' ELSE 'found' END AS status FROM w LEFT JOIN h USING (id)")
def remap_check(spark, sf):
    asked = table(spark, sf, "events").select(F.col("user_id").cast("long").alias("id")).union(table(spark, sf, "customer").filter("c_custkey % 50 = 0").select(F.col("c_custkey") + 100000000)).distinct()
    held = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return asked.join(held, "id", "left").select("id", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").otherwise("found").alias("status"))


@query("P41", "WITH c AS (SELECT DISTINCT sqrt(p_size::DOUBLE) AS x FROM part), w AS (SELECT x, lag(x) OVER (ORDER BY x) AS b, lead(x) OVER (ORDER BY x) AS a FROM c) SELECT " + f"{Q('x')} AS x, {Q('CASE WHEN b IS NULL THEN x-(a-x)/2e0 ELSE (b+x)/2e0 END')} AS lo, {Q('CASE WHEN a IS NULL THEN x+(x-b)/2e0 ELSE (x+a)/2e0 END')} AS hi FROM w")
def centre_edges(spark, sf):
    centres = table(spark, sf, "part").select(F.sqrt(F.col("p_size").cast("double")).alias("x")).distinct()
    return D.edges_from_centres(centres).select(*[q(F.col(c)).alias(c) for c in ("x", "lo", "hi")])


@query("P39", "WITH z AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS part, 0.3e0+round(l_discount*100)*0.1e0+l_tax*0e0 AS z FROM lineitem) SELECT id, n, part, CASE WHEN z>=0.3e0 AND z<=1.2e0 THEN CAST(least(8,floor((z-0.3e0)/0.1e0+1e-9)) AS INT) END AS slice FROM z")
def redshift_slices(spark, sf):
    """Slices of 0.1 from 0.3 to 1.2: nine, and not ten by round-off."""
    z = F.lit(0.3) + F.round(F.col("l_discount") * 100) * F.lit(0.1) + F.col("l_tax") * F.lit(0.0)
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), D.slice_of(z, 0.3, 1.2, 0.1).alias("slice"))


@query("A06", f"WITH {SKY_C}, h AS (SELECT CAST(least(15,greatest(0,floor((mag-16e0)*2e0))) AS INT) AS bin, count(*) AS c FROM c GROUP BY 1), r AS (SELECT bin, c, c*(1e0+exp((16.25e0+bin*0.5e0-22e0)/0.6e0)) AS raw FROM h) SELECT bin, c, {Q('raw/sum(raw) OVER ()')} AS share FROM r")
def completeness_shares(spark, sf):
    h = sky_c(spark, sf).groupBy(D.bin_of(F.col("mag"), 16.0, 0.5, 16).alias("bin")).agg(F.count("*").alias("c"))
    complete = F.lit(1.0) / (F.lit(1.0) + F.exp((F.lit(16.25) + F.col("bin") * 0.5 - F.lit(22.0)) / F.lit(0.6)))
    return D.completeness_corrected(h, complete).select("bin", "c", q(F.col("share")).alias("share"))


@query("A08, W11", f"WITH {PIX}, k AS (SELECT id, mag, pix>>4 AS parent, row_number() OVER (PARTITION BY pix>>4 ORDER BY md5(CAST(id AS VARCHAR)), id) AS r, count(*) OVER (PARTITION BY pix>>4) AS n FROM h), w AS (SELECT mag, n/least(n,3)::DOUBLE AS w FROM k WHERE r <= 3), a AS (SELECT count(DISTINCT pix)*{K.pixel_area(4)}e0 AS area FROM h) SELECT CAST(least(7,greatest(0,floor(mag-16e0))) AS INT) AS bin, {Q('sum(w)/(SELECT sum(w) FROM w)*any_value(area)')} AS area FROM w, a GROUP BY 1")
def sampled_area(spark, sf):
    """The area that each magnitude bin of a stratified sample stands for."""
    p = pixels(spark, sf)
    area = p.select("pix").distinct().count() * K.pixel_area(4)
    sample = metrics.capped_sample(p.select("id", "mag", K.parent_pixel(F.col("pix"), 2).alias("parent")), ["parent"], "id", 3)
    return D.weights_to_area(sample, area).groupBy(D.bin_of(F.col("mag"), 16.0, 1.0, 8).alias("bin")).agg(q(F.sum("weight")).alias("area"))


@query("A13", f"WITH {PIX}, t AS (SELECT pix>>4 AS pix, id%3 AS tile, count(*) AS c FROM h GROUP BY ALL), m AS (SELECT pix, max(c) AS c FROM t GROUP BY 1) SELECT pix, c, c >= 0.5e0*(SELECT median(c) FROM m) AS kept FROM m")
def coverage_cut(spark, sf):
    p = pixels(spark, sf)
    counts = p.groupBy(K.parent_pixel(F.col("pix"), 2).alias("pix"), (F.col("id") % 3).alias("tile")).agg(F.count("*").alias("c"))
    return D.covered_cells(counts)


@query("F17", "SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS part, CASE WHEN l_tax > 0 THEN " + Q("(pow((l_quantity-25e0)/10e0,2e0)+pow((l_discount-0.05e0)/l_tax,2e0)-2e0*(l_linenumber/10e0)*((l_quantity-25e0)/10e0)*((l_discount-0.05e0)/l_tax))/(1e0-(l_linenumber/10e0)*(l_linenumber/10e0))") + " END AS chi2 FROM lineitem")
def astrometric_chi_square(spark, sf):
    x = select.chi_square(F.col("l_quantity") - 25.0, F.col("l_discount") - 0.05, F.lit(10.0), F.col("l_tax"), F.col("l_linenumber") / 10.0)
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), q(x).alias("chi2"))


_AMP = 2.5 / math.log(10.0)
_F2 = f"(0.2e0*sinh((22.5e0-({_lupt(1)}-c))/{_AMP}-ln(0.1e0)))"


@query("P24, P07", f"WITH {WIDE}, t AS (SELECT id, f1, {_lupt(1)}-{_lupt(2)} AS c FROM w WHERE f1 > 0.05e0 AND f2 IS NOT NULL) SELECT id, {Q(_F2 + '/f1')} AS ratio, {Q(f'sqrt({_F2}*{_F2}+0.04e0)/({_AMP}*f1)')} AS slope FROM t")
def colour_to_ratio(spark, sf):
    """Flux ratios from asinh colours, and their slope in the colour."""
    w = wide(spark, sf).filter("f1 > 0.05 and f2 is not null")
    one, two = (S.asinh_mag(F.col(c), 0.1) for c in ("f1", "f2"))
    flux = S.inverse_asinh_mag(one - (one - two), 0.1)
    return w.select("id", q(flux / F.col("f1")).alias("ratio"), q(F.sqrt(flux * flux + 0.04) / (F.lit(_AMP) * F.col("f1"))).alias("slope"))


_TWO = [(0.0, 0.0, 1.0, 0.3, 2.0), (4.0, 3.0, 2.0, -0.5, 1.0)]


@query("M08", f"WITH {WIDE} SELECT id, CASE WHEN f2 IS NULL THEN 0e0 ELSE " + Q("least(" + ",".join(f"sqrt(pow(f2-{b}e0-({r}e0)/({s}e0+v1)*(f1-{a}e0),2e0)/({t}e0+v2-({r}e0)*({r}e0)/({s}e0+v1)))" for a, b, s, r, t in _TWO) + ")") + " END AS sigma FROM w WHERE f1 IS NOT NULL")
def conditional_distance(spark, sf):
    m = mixture.Mixture([0.5, 0.5], [[a, b] for a, b, *_ in _TWO], [[[s, r], [r, t]] for *_, s, r, t in _TWO])
    w = wide(spark, sf).filter("f1 is not null").select("id", F.array("f1", "f2").alias("x"), F.array("v1", "v2").alias("var"))
    return mixture.mixture_columns(w, {"sigma": m}, "conditional_nearest", anchor=0).select("id", q(F.col("sigma")).alias("sigma"))


@query("W15", f"WITH {WIDE}, k AS (SELECT CAST({_MASK} AS BIGINT) AS mask, f1 FROM w WHERE f1 IS NOT NULL), e AS (SELECT mask, quantile_cont(f1,0.25e0) AS a, quantile_cont(f1,0.5e0) AS b, quantile_cont(f1,0.75e0) AS c FROM k GROUP BY mask HAVING count(*) >= 8) SELECT mask, CAST((f1>a)::INT+(f1>b)::INT+(f1>c)::INT AS INT) AS stratum, count(*) AS n FROM k JOIN e USING (mask) GROUP BY ALL")
def quantile_strata(spark, sf):
    """Quarters of the first channel's flux within each presence mask of eight objects or more."""
    k = wide(spark, sf).withColumn("mask", _mask()).filter("f1 is not null").select("mask", "f1")
    # one row for each presence mask, of which there are at most 128
    edges = k.groupBy("mask").agg(F.percentile("f1", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])).alias("e"), F.count("*").alias("m")).filter("m >= 8").drop("m")
    stratum = F.aggregate("e", F.lit(0), lambda n, e: n + (F.col("f1") > e).cast("int"))
    return k.join(F.broadcast(edges), "mask").groupBy("mask", stratum.alias("stratum")).agg(F.count("*").alias("n"))


@query("V07", f"WITH {SCORED}, h AS (SELECT quantile_cont(score,1e0-0.9e0) AS threshold FROM t WHERE label=1) SELECT {Q('threshold')} AS threshold, {Q('avg((score>=threshold)::INT::DOUBLE)')} AS contamination FROM t, h WHERE label=0 GROUP BY threshold")
def contamination_at_retention(spark, sf):
    return metrics.contamination(scored(spark, sf), 0.9).select(q(F.col("threshold")).alias("threshold"), q(F.col("contamination")).alias("contamination"))


@query("V06, W06", f"{_POST}, d AS (SELECT vec_id, g, coalesce(sum((p+before)/2e0) OVER (PARTITION BY vec_id ORDER BY g), 0e0) AS cdf FROM (SELECT vec_id, g, p, lag(p) OVER (PARTITION BY vec_id ORDER BY g) AS before FROM p)), x AS (SELECT label%5 AS truth, cdf FROM d JOIN embeddings USING (vec_id) WHERE g=label%5) SELECT truth, count(*) AS n, count(CASE WHEN cdf>=0.16e0 AND cdf<=0.84e0 THEN 1 END) AS inside FROM x GROUP BY 1")
def interval_coverage(spark, sf):
    """How often the truth lies in the central 68 per cent, by the cumulative trapezoid."""
    grid = F.array(*[F.lit(float(i)) for i in range(5)])
    p = class_wide(spark, sf).select("vec_id", score.grid_posterior(F.slice("lp", 1, 5), grid).alias("p"))
    truth = table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 5).alias("truth"))
    areas = F.transform("p", lambda v, i: F.when((i > 0) & (i <= F.col("truth")), (v + F.get("p", i - 1)) / 2.0).otherwise(F.lit(0.0)))
    x = p.join(truth, "vec_id").withColumn("cdf", F.aggregate(areas, F.lit(0.0), lambda a, b: a + b))
    return x.groupBy("truth").agg(F.count("*").alias("n"), F.count(F.when((F.col("cdf") >= 0.16) & (F.col("cdf") <= 0.84), 1)).alias("inside"))
