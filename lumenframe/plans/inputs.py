"""Virtual inputs over the driver tables, the same in both engines: positions, measurements, vectors, scored events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.sky import exact_asin_deg
from lumenframe.operators.metrics import POISSON

from .registry import table

A, B, C = 0.6180339887498949, 0.7548776662466927, 0.5698402909980532
CHANNELS = range(1, 8)


def frac(key: Column, c: float) -> Column:
    x = key * F.lit(c)
    return x - F.floor(x)


def _frac(key: str, c: float) -> str:
    return f"({key}*{c}e0-floor({key}*{c}e0))"


def Q(x: str) -> str:
    """The SQL of ``quantise``."""
    return f"floor(({x})*1e6+0.5e0)/1e6+0e0"


def sky(df: DataFrame, key: str, every: int, shift: float) -> DataFrame:
    """Positions spread evenly by key, but every so-manieth key lies ``shift`` degrees east of the key before it."""
    k = F.col(key)
    # one small file is one task; what follows is to be dealt out
    df = df.select(key).repartition(key)
    near = k % every == 0
    at = F.when(near, k - 1).otherwise(k)
    ra = F.lit(360.0) * frac(at, A) + F.when(near, F.lit(shift)).otherwise(F.lit(0.0))
    return df.select(k.alias("id"), (ra - F.lit(360.0) * F.floor(ra / F.lit(360.0))).alias("ra"), exact_asin_deg(F.lit(2.0) * frac(at, B) - F.lit(1.0)).alias("dec"), (F.lit(16.0) + F.lit(8.0) * frac(k, C)).alias("mag"))


def _sky(name: str, t: str, key: str, every: int, shift: float) -> str:
    at = f"(CASE WHEN {key} % {every} = 0 THEN {key} - 1 ELSE {key} END)"
    return f"{name} AS (SELECT id, ra - 360e0*floor(ra/360e0) AS ra, dec, mag FROM (SELECT {key} AS id, 360e0*{_frac(at, A)} + CASE WHEN {key} % {every} = 0 THEN {shift}e0 ELSE 0e0 END AS ra, degrees(asin(2e0*{_frac(at, B)}-1e0)) AS dec, 16e0+8e0*{_frac(key, C)} AS mag FROM {t}))"


def _vec(name: str) -> str:
    return f"{name}v AS (SELECT *, cos(radians(dec))*cos(radians(ra)) AS x, cos(radians(dec))*sin(radians(ra)) AS y, sin(radians(dec)) AS z FROM {name})"


SKY_C = _sky("c", "customer", "c_custkey", 10, 0.25) + ", " + _vec("c")
SKY_S = _sky("s", "supplier", "s_suppkey", 3, 0.5) + ", " + _vec("s")
CHORD = "((l.x-r.x)*(l.x-r.x)+(l.y-r.y)*(l.y-r.y)+(l.z-r.z)*(l.z-r.z))"
SEP = f"degrees(2e0*asin(sqrt(least(1e0,{CHORD}/4e0))))"


def pairs_sql(left: str, right: str, radius: float) -> str:
    return f"p AS (SELECT l.id AS l_id, r.id AS r_id, {SEP} AS sep FROM {left}v l JOIN {right}v r ON {CHORD} <= 4e0*sin(radians({radius}e0)/2e0)*sin(radians({radius}e0)/2e0))"


def sky_c(spark, sf):
    return sky(table(spark, sf, "customer"), "c_custkey", 10, 0.25)


def sky_s(spark, sf):
    return sky(table(spark, sf, "supplier"), "s_suppkey", 3, 0.5)


_ORDER = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _measured(x: Column) -> tuple[Column, Column]:
    """Flux and variance of a line (a struct)."""
    return x["l_extendedprice"] * (F.lit(1.0) - x["l_discount"]) / F.lit(5000.0) - F.lit(1.0), F.pow(F.lit(0.05) + x["l_tax"], F.lit(2.0))


def meas(spark, sf) -> DataFrame:
    """(id, channel, flux, var): one row of each channel of an order, its first line; absent lines are missing measurements. A minimum, combined before the shuffle."""
    line = F.struct(*_ORDER, "l_discount", "l_tax")
    one = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("channel")).agg(F.min_by(line, F.struct(*_ORDER)).alias("x"))
    flux, var = _measured(F.col("x"))
    return one.select("id", "channel", flux.alias("flux"), var.alias("var"))


MEAS = """m AS (SELECT l_orderkey AS id, l_linenumber AS channel, l_extendedprice*(1e0-l_discount)/5000e0-1e0 AS flux, pow(0.05e0+l_tax,2e0) AS var FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem) WHERE n = 1)"""


def wide(spark, sf) -> DataFrame:
    """One row an object: f1..f7, v1..v7, null where missing. One aggregation by order, no pivot discovery job."""
    line, order = F.struct(*_ORDER, "l_discount", "l_tax"), F.struct(*_ORDER)
    at = lambda c: F.min_by(F.when(F.col("l_linenumber") == c, line), F.when(F.col("l_linenumber") == c, order)).alias(f"x{c}")
    one = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(*[at(c) for c in CHANNELS])
    cols = [(c, *_measured(F.col(f"x{c}"))) for c in CHANNELS]
    return one.select("id", *[x.alias(f"{n}{c}") for c, f, v in cols for n, x in (("f", f), ("v", v))])


WIDE = MEAS + ", w AS (SELECT id, " + ", ".join(f"max(CASE WHEN channel={c} THEN {x} END) AS {x[0]}{c}" for c in CHANNELS for x in ("flux", "var")) + " FROM m GROUP BY id)"


def times_sql(block: str, draw: str) -> str:
    """How often a block is in a draw: the SQL of ``metrics.times_drawn``."""
    u = f"(('0x'||substr(md5({block}||':'||{draw}),1,7))::BIGINT/268435456e0)"
    return "(" + "+".join(f"CAST({u}>={edge}e0 AS INT)" for edge in POISSON) + ")"


def vec(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


#: Exploded vectors, class means and variances, and the log density of every row under every class.
VEC = """e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
k AS (SELECT label AS g, i, avg(v) AS m, var_pop(v) AS s FROM e GROUP BY ALL),
lp AS (SELECT vec_id, e.label, g, -0.5e0*sum((v-m)*(v-m)/s+ln(s)+1.8378770664093453e0) AS lp FROM e JOIN k USING (i) GROUP BY ALL)"""


def scored(spark, sf) -> DataFrame:
    """(id, block, score, label): events as scored candidates."""
    e = table(spark, sf, "events")
    s = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("value") - F.lit(50.0)) / F.lit(20.0)))
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("block"), s.alias("score"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"))


SCORED = "t AS (SELECT event_id AS id, user_id % 20 AS block, 1e0/(1e0+exp(-(value-50e0)/20e0)) AS score, CASE WHEN event_type='purchase' THEN 1 ELSE 0 END AS label FROM events)"
