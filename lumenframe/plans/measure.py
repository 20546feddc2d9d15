"""Queries on measurements: scalars, selections, presence, pivots."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lumenframe.functions import scalar as S
from lumenframe.operators import select as L

from .inputs import CHANNELS, MEAS, Q, WIDE, meas, wide
from .registry import query, table

P = 2.5 / math.log(10.0)
q = S.quantise


@query("P01, P18", f"WITH {MEAS} SELECT id, channel, CASE WHEN flux > 0 THEN {Q('22.5e0-2.5e0*log10(flux)')} END AS mag, {Q('flux/sqrt(var)')} AS snr FROM m WHERE var > 0")
def flux_to_mag(spark, sf):
    return meas(spark, sf).filter("var > 0").select("id", "channel", q(S.flux_to_mag(F.col("flux"))).alias("mag"), q(S.snr(F.col("flux"), F.col("var"))).alias("snr"))


@query("P02, P03, P04, P05", f"SELECT c_custkey AS id, {Q('pow(10e0,(22.5e0-c_acctbal/400e0)/2.5e0)/1e9')} AS flux, {Q('c_acctbal*pow(10e0,0.4e0*(22.5e0-23.9e0))')} AS native, CASE WHEN c_acctbal > 0 THEN {Q('1e0/c_acctbal')} END AS var FROM customer")
def mag_to_flux(spark, sf):
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), q(S.mag_to_flux(b / 400.0) / 1e9).alias("flux"), q(S.scale_to_native(b, 23.9)).alias("native"), q(S.variance_of(b, "ivar")).alias("var"))


@query("P06, P07, P43", f"WITH {MEAS}, a AS (SELECT id, channel, flux, 22.5e0-{P}e0*(asinh(flux/0.2e0)+ln(0.1e0)) AS am FROM m) SELECT id, channel, {Q('am')} AS am, {Q(f'-{P}e0/sqrt(flux*flux+4e0*0.1e0*0.1e0)')} AS slope, floor(0.2e0*sinh((22.5e0-am)/{P}e0-ln(0.1e0))*1e9+0.5e0)/1e9+0e0 AS back FROM a")
def asinh_magnitude(spark, sf):
    f = F.col("flux")
    am = S.asinh_mag(f, 0.1)
    return meas(spark, sf).select("id", "channel", q(am).alias("am"), q(S.asinh_slope(f, 0.1)).alias("slope"), q(S.inverse_asinh_mag(am, 0.1), 9).alias("back"))


@query("P11, P12", f"WITH {MEAS} SELECT id, channel, {Q('flux*pow(10e0,0.4e0*2.165e0*(id%7/20e0))')} AS flux, {Q('var*pow(10e0,0.8e0*2.165e0*(id%7/20e0))')} AS var, CASE WHEN id%5 > 0 THEN {Q('flux/(id%5/5e0)')} END AS by_t FROM m")
def deredden(spark, sf):
    e, t = F.col("id") % 7 / 20.0, F.col("id") % 5 / 5.0
    return meas(spark, sf).select("id", "channel", q(S.deredden_flux(F.col("flux"), e, 2.165)).alias("flux"), q(S.deredden_variance(F.col("var"), e, 2.165)).alias("var"), q(S.by_transmission(F.col("flux"), F.lit(1.0), t)[0]).alias("by_t"))


@query("P09", f"WITH {WIDE} SELECT id, {Q('f2/f1')} AS r2, {Q('f3/f1')} AS r3, {Q('v2/(f1*f1)+f2/f1*(f2/f1)*v1/(f1*f1)')} AS c22, {Q('f2/f1*(f3/f1)*v1/(f1*f1)')} AS c23, {Q('v3/(f1*f1)+f3/f1*(f3/f1)*v1/(f1*f1)')} AS c33 FROM w WHERE f1 > 0.05e0")
def relative_flux_features(spark, sf):
    f1, f2, f3, v1, v2, v3 = (F.col(c) for c in ("f1", "f2", "f3", "v1", "v2", "v3"))
    r2, r3, s = f2 / f1, f3 / f1, v1 / (f1 * f1)
    return wide(spark, sf).filter(f1 > 0.05).select("id", q(r2).alias("r2"), q(r3).alias("r3"), q(v2 / (f1 * f1) + r2 * r2 * s).alias("c22"), q(r2 * r3 * s).alias("c23"), q(v3 / (f1 * f1) + r3 * r3 * s).alias("c33"))


def _lupt(c: int) -> str:
    return f"(22.5e0-{P}e0*(asinh(f{c}/0.2e0)+ln(0.1e0)))"


def _lvar(c: int) -> str:
    return f"(v{c}*pow({P}e0/sqrt(f{c}*f{c}+0.04e0),2e0))"


@query("P10, P08, P23", f"WITH {WIDE} SELECT id, {Q(_lupt(1) + '-' + _lupt(2))} AS c12, {Q(_lupt(2) + '-' + _lupt(3))} AS c23, {Q(_lvar(1) + '+' + _lvar(2))} AS v12, {Q('-' + _lvar(2))} AS cov, {Q(_lvar(2) + '+' + _lvar(3))} AS v23 FROM w WHERE f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL")
def asinh_colours(spark, sf):
    m = [S.asinh_mag(F.col(f"f{c}"), 0.1) for c in (1, 2, 3)]
    v = [F.col(f"v{c}") * F.pow(S.asinh_slope(F.col(f"f{c}"), 0.1), F.lit(2.0)) for c in (1, 2, 3)]
    w = wide(spark, sf).filter("f1 is not null and f2 is not null and f3 is not null")
    return w.select("id", q(m[0] - m[1]).alias("c12"), q(m[1] - m[2]).alias("c23"), q(v[0] + v[1]).alias("v12"), q(-v[1]).alias("cov"), q(v[1] + v[2]).alias("v23"))


@query("P19, P20, F26", f"SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS part, {Q('abs(l_discount-l_tax)/(1e0+l_tax)*299792.458e0')} AS dv, CASE WHEN abs(l_discount-l_tax) <= 0.025e0 THEN 1e0 ELSE 0e0 END AS hat, {Q(f'exp(-0.5e0*pow((l_discount-l_tax)/{0.05 / math.sqrt(2 * math.pi)}e0,2e0))')} AS bell FROM lineitem")
def velocity_window(spark, sf):
    d, t = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), q(S.velocity_difference(t, d)).alias("dv"), S.top_hat_weight(d, t, 0.025).alias("hat"), q(S.gaussian_window(d, t, 0.025)).alias("bell"))


@query("P26, P27, P34", f"SELECT event_id AS id, {Q('1e0/(1e0+exp(-(0.3e0+1.2e0*(value-50e0)/20e0)))')} AS p, {Q('greatest(value/9e0,value/7e0-1e0)+ln(exp(value/9e0-greatest(value/9e0,value/7e0-1e0))+exp(value/7e0-1e0-greatest(value/9e0,value/7e0-1e0)))')} AS lse, {Q('-ln(1e0+exp(-value/30e0))')} AS thin FROM events")
def logistic_recalibration(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), q(S.logistic(F.lit(0.3) + F.lit(1.2) * (v - 50.0) / 20.0)).alias("p"), q(S.log_sum_exp(v / 9.0, v / 7.0 - 1.0)).alias("lse"), q(S.log_thinning(v / 30.0)).alias("thin"))


@query("P28, P40", f"WITH {MEAS} SELECT id, {Q('sum(area)')} AS area FROM (SELECT id, CASE WHEN lag(channel) OVER w IS NULL THEN 0e0 ELSE (flux+lag(flux) OVER w)/2e0*(channel-lag(channel) OVER w) END AS area FROM m WINDOW w AS (PARTITION BY id ORDER BY channel)) GROUP BY id")
def trapezoid_area(spark, sf):
    g = meas(spark, sf).groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("channel").cast("double").alias("x"), F.col("flux").alias("y")))).alias("p"))
    return g.select("id", q(S.trapezoid(F.col("p.x"), F.col("p.y"))).alias("area"))


@query("P36, X26", "SELECT event_id AS id, CASE WHEN regexp_full_match(s, '[0-9]{1,19}') AND try_cast(s AS BIGINT) > 0 THEN try_cast(s AS BIGINT) END AS key, CAST(CAST(9007199254740993+event_id AS DOUBLE) AS BIGINT) <> 9007199254740993+event_id AS rounded FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '-' || event_id WHEN 1 THEN event_id || 'x' WHEN 2 THEN '0' || event_id ELSE '99999999999999999999' END AS s FROM events)")
def exact_ids(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"))
    k = F.col("id").cast("string")
    s = F.when(F.col("id") % 4 == 0, F.concat(F.lit("-"), k)).when(F.col("id") % 4 == 1, F.concat(k, F.lit("x"))).when(F.col("id") % 4 == 2, F.concat(F.lit("0"), k)).otherwise(F.lit("99999999999999999999"))
    big = F.col("id") + F.lit(9007199254740993)
    return e.select("id", S.valid_id(s).alias("key"), (big.cast("double").cast("long") != big).alias("rounded"))


@query("P37, W13, F19", "SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS part, ('0x'||substr(md5(CAST(l_orderkey AS VARCHAR)),1,8))::BIGINT % 100 AS h, CASE WHEN ('0x'||substr(md5(CAST(l_orderkey AS VARCHAR)),1,8))::BIGINT % 100 < 70 THEN 'fit' WHEN ('0x'||substr(md5(CAST(l_orderkey AS VARCHAR)),1,8))::BIGINT % 100 < 85 THEN 'select' ELSE 'test' END AS role FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 40")
def split_roles(spark, sf):
    h = S.hashed_fraction(F.col("l_orderkey"))
    x = table(spark, sf, "lineitem").filter("l_quantity >= 10 and l_quantity < 40").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), h.alias("h"))
    return x.withColumn("role", F.when(F.col("h") < 70, "fit").when(F.col("h") < 85, "select").otherwise("test"))


_TYPE = "CASE l_linestatus || l_returnflag WHEN 'OA' THEN 'PSF' WHEN 'FA' THEN ' psf ' WHEN 'ON' THEN 'REX' WHEN 'FN' THEN 'DEV' WHEN 'OR' THEN '' ELSE 'SER' END"


def _quality(spark, sf):
    key = F.concat("l_linestatus", "l_returnflag")
    kind = F.when(key == "OA", "PSF").when(key == "FA", " psf ").when(key == "ON", "REX").when(key == "FN", "DEV").when(key == "OR", "").otherwise("SER")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), kind.alias("kind"),
        F.when(F.col("l_linenumber") == 7, -1).otherwise((F.col("l_quantity") % 4).cast("int")).alias("bits"), F.when(F.col("l_linenumber") != 3, F.col("l_discount") + 0.0).alias("p"), (F.col("l_linenumber") - 1).alias("nobs"), "l_quantity",
    )


QUALITY = f"u AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS part, {_TYPE} AS kind, CASE WHEN l_linenumber=7 THEN -1 ELSE CAST(l_quantity % 4 AS INT) END AS bits, CASE WHEN l_linenumber<>3 THEN l_discount+0e0 END AS p, l_linenumber-1 AS nobs, l_quantity FROM lineitem)"


@query("F01, F10, F21, S03", f"WITH {QUALITY}, d AS (SELECT *, CASE WHEN NOT coalesce(upper(trim(kind)) IN ('PSF'),false) THEN 'morphology' WHEN NOT coalesce(nobs > 0,false) THEN 'no_match' WHEN NOT coalesce(bits >= 0 AND (bits & 2) = 0,false) THEN 'masked' WHEN NOT coalesce(p >= 0.02e0,false) THEN 'reference_unusable' ELSE '' END AS reason FROM u) SELECT id, n, part, reason, reason = '' AS accepted FROM d")
def selection_reason(spark, sf):
    u = _quality(spark, sf)
    return L.decide(u, (L.morphology(F.col("kind")) == "point", "morphology"), (F.col("nobs") > 0, "no_match"), (L.clean_bits(F.col("bits"), 2), "masked"), (L.at_least(F.col("p"), 0.02), "reference_unusable")).select("id", "n", "part", "reason", "accepted")


@query("F02, F11, F12, F13", f"WITH {QUALITY} SELECT id, n, part, CASE WHEN upper(trim(kind)) IN ('PSF') THEN 'point' WHEN upper(trim(kind)) IN ('REX','EXP','DEV','SER','DUP') THEN 'extended' ELSE 'unknown' END AS shape, coalesce(bits >= 0 AND (bits & 3) = 0,false) AS clean, coalesce(p >= 0.05e0,false) AS pointlike, CASE WHEN p IS NOT NULL THEN CASE WHEN p >= 0.05e0 THEN 'point' ELSE 'extended' END WHEN nobs IS NOT NULL THEN CASE WHEN l_quantity > 25 THEN 'point' ELSE 'extended' END ELSE 'unknown' END AS ladder FROM u")
def morphology_and_flags(spark, sf):
    u = _quality(spark, sf)
    return u.select("id", "n", "part", L.morphology(F.col("kind")).alias("shape"), L.clean_bits(F.col("bits"), 3).alias("clean"), L.at_least(F.col("p"), 0.05).alias("pointlike"), L.ladder(F.col("p"), 0.05, F.col("l_quantity") > 25).alias("ladder"))


@query("F04, X22", f"WITH {QUALITY} SELECT id, n, part, concat_ws(',', CASE WHEN NOT coalesce(bits=0,false) THEN 'bits' END, CASE WHEN NOT coalesce(p<0.08e0,false) THEN 'fraction' END, CASE WHEN NOT coalesce(nobs>=2,false) THEN 'nobs' END) AS flags FROM u")
def blend_policy(spark, sf):
    u = _quality(spark, sf)
    v = L.violations((F.col("bits") == 0, "bits"), (F.col("p") < 0.08, "fraction"), (F.col("nobs") >= 2, "nobs"))
    return u.select("id", "n", "part", F.array_join(v, ",").alias("flags"))


@query("P22, F16", "WITH u AS (SELECT p_partkey AS id, p_retailprice/400e0-1.5e0 AS c, p_size FROM part), d AS (SELECT id, c, p_size, CASE WHEN c < 0.5e0 THEN 1.154360e0+0.033772e0*c+0.032277e0*c*c WHEN c < 4e0 THEN 1.162004e0+0.011464e0*c+0.049255e0*c*c-0.005879e0*c*c*c ELSE 1.057572e0+0.140537e0*c END AS lim FROM u) SELECT id, " + Q("lim") + " AS lim, (id % 10 = 0 OR (c < 1e0 AND p_size > 25)) AND NOT c > 3e0 AS likely FROM d")
def point_source_limit(spark, sf):
    u = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 400.0 - 1.5).alias("c"), "p_size")
    return u.select("id", q(S.point_source_limit(F.col("c"))).alias("lim"), (((F.col("id") % 10 == 0) | ((F.col("c") < 1.0) & (F.col("p_size") > 25))) & ~(F.col("c") > 3.0)).alias("likely"))


_MASK = "+".join(f"(CASE WHEN f{c} IS NOT NULL AND v{c} > 0 THEN {1 << (c - 1)} ELSE 0 END)" for c in CHANNELS)


def _mask():
    return L.presence_mask([(F.col(f"f{c}"), F.col(f"v{c}")) for c in CHANNELS])


@query("S27, F20, F24, V12", f"WITH {WIDE} SELECT id, CAST({_MASK} AS BIGINT) AS mask, CAST(bit_count({_MASK}) AS INT) AS n, " + "concat_ws('+', " + ", ".join(f"CASE WHEN f{c} IS NOT NULL THEN 'c{c}' END" for c in CHANNELS) + f") AS cover FROM w WHERE bit_count({_MASK}) >= 2")
def presence_mask(spark, sf):
    w = wide(spark, sf).withColumn("mask", _mask()).withColumn("n", F.bit_count("mask")).filter("n >= 2")
    return w.select("id", "mask", "n", F.concat_ws("+", *[F.when(F.col(f"f{c}").isNotNull(), f"c{c}") for c in CHANNELS]).alias("cover"))


@query("F20, A12", f"WITH {WIDE}, k AS (SELECT CAST({_MASK} AS BIGINT) AS mask, f1 FROM w) SELECT mask, count(*) AS n, count(CASE WHEN f1 < 0 THEN 1 END) AS negative FROM k GROUP BY mask")
def mask_groups(spark, sf):
    return wide(spark, sf).withColumn("mask", _mask()).groupBy("mask").agg(F.count("*").alias("n"), F.count(F.when(F.col("f1") < 0, 1)).alias("negative"))


_SNR = {c: f"CASE WHEN v{c} > 0 THEN f{c}/sqrt(v{c}) END" for c in CHANNELS}


@query("F07, F08, F09", f"WITH {WIDE}, r AS (SELECT id, {_SNR[3]} AS s3, {_SNR[2]} AS s2, {_SNR[5]} AS s5 FROM w) SELECT id, coalesce(CASE WHEN s3>=5 THEN 'c3' END, CASE WHEN s2>=5 THEN 'c2' END, CASE WHEN s5>=5 THEN 'c5' END, CASE WHEN s3 IS NOT NULL THEN 'c3' END, CASE WHEN s2 IS NOT NULL THEN 'c2' END, CASE WHEN s5 IS NOT NULL THEN 'c5' END) AS reference, CASE WHEN s3 IS NOT NULL THEN CASE WHEN s3>=5 THEN 'c3' END WHEN s2 IS NOT NULL THEN CASE WHEN s2>=5 THEN 'c2' END WHEN s5>=5 THEN 'c5' END AS passing FROM r")
def reference_choice(spark, sf):
    snr = [(f"c{c}", S.snr(F.col(f"f{c}"), F.col(f"v{c}"))) for c in (3, 2, 5)]
    return wide(spark, sf).select("id", L.reference_channel(snr, 5.0).alias("reference"), L.passing_channel(snr, 5.0).alias("passing"))


@query("P15, P16, P17", f"WITH {MEAS}, s AS (SELECT id, CASE WHEN id%2=0 THEN 'north' ELSE 'south' END || ':b' || channel AS label, flux FROM m UNION ALL SELECT id, 'both:b' || channel, flux FROM m WHERE channel <= 2) SELECT id, label, split_part(label,':',1) AS survey, split_part(label,':',2) AS band, {Q('flux')} AS flux FROM s")
def channel_routing(spark, sf):
    m = meas(spark, sf)
    own = F.concat(F.when(F.col("id") % 2 == 0, "north").otherwise("south"), F.lit(":b"), F.col("channel").cast("string"))
    both = F.when(F.col("channel") <= 2, F.array(own, F.concat(F.lit("both:b"), F.col("channel").cast("string")))).otherwise(F.array(own))
    x = m.select("id", F.explode(both).alias("label"), "flux")
    survey, band = S.split_label(F.col("label"))
    return x.select("id", "label", survey.alias("survey"), band.alias("band"), q(F.col("flux")).alias("flux"))


@query("A19, F15, F22, F25", f"WITH {QUALITY} SELECT kind, count(*) AS total, count(CASE WHEN coalesce(bits>=0,false) THEN 1 END) AS matched, count(CASE WHEN coalesce(bits>=0,false) AND coalesce(p>=0.02e0,false) THEN 1 END) AS usable, count(CASE WHEN coalesce(bits>=0,false) AND coalesce(p>=0.02e0,false) AND coalesce(nobs>1,false) THEN 1 END) AS clean FROM u GROUP BY kind")
def selection_funnel(spark, sf):
    return L.funnel(_quality(spark, sf), "kind", ("matched", F.col("bits") >= 0), ("usable", F.col("p") >= 0.02), ("clean", F.col("nobs") > 1))


@query("A26, A28", f"WITH {MEAS} SELECT count(*) AS rows, count(CASE WHEN NOT coalesce(var>0,false) THEN 1 END) AS variance, count(CASE WHEN NOT coalesce(flux>-0.9e0,false) THEN 1 END) AS flux, count(CASE WHEN NOT coalesce(channel BETWEEN 1 AND 7,false) THEN 1 END) AS channel FROM m")
def data_contract(spark, sf):
    return L.contract(meas(spark, sf), variance=F.col("var") > 0, flux=F.col("flux") > -0.9, channel=F.col("channel").between(1, 7))


@query("J26", "WITH o AS (SELECT c_custkey AS k, c_acctbal AS b, c_mktsegment AS s FROM customer WHERE c_custkey % 11 <> 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS b, CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE c_mktsegment END AS s FROM customer WHERE c_custkey % 13 <> 0) SELECT count(CASE WHEN o.k IS NOT NULL AND n.k IS NOT NULL AND o.b IS NOT DISTINCT FROM n.b AND o.s IS NOT DISTINCT FROM n.s THEN 1 END) AS same, count(CASE WHEN o.k IS NOT NULL AND n.k IS NOT NULL AND o.b IS DISTINCT FROM n.b THEN 1 END) AS changed_b, count(CASE WHEN o.k IS NOT NULL AND n.k IS NOT NULL AND o.s IS DISTINCT FROM n.s THEN 1 END) AS changed_s, count(CASE WHEN n.k IS NULL THEN 1 END) AS only_old, count(CASE WHEN o.k IS NULL THEN 1 END) AS only_new FROM o FULL JOIN n ON o.k = n.k")
def compare_versions(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("b"), F.col("c_mktsegment").alias("s"))
    new = c.filter("k % 13 <> 0").select("k", F.when(F.col("k") % 7 != 0, F.col("b")).alias("b"), F.when(F.col("k") % 5 == 0, "x").otherwise(F.col("s")).alias("s"))
    return L.compare_versions(c.filter("k % 11 <> 0"), new, "k", ["b", "s"])
