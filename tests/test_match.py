"""Positional joins that do not list all pairs, or leave them to the driver."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from same import duck_rows, spark_rows

from lumenframe import catalogue
from lumenframe.operators import match

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def placed(spark):
    rng = np.random.default_rng(4)
    ra, dec = rng.uniform(0, 360, 900), np.degrees(np.arcsin(rng.uniform(-1, 1, 900)))
    ra[:300], dec[:300] = rng.normal(0, 1, 300) % 360, 89 - np.abs(rng.normal(0, 1, 300))
    return spark.createDataFrame([(int(i) * 7 % 900, float(a), float(d)) for i, (a, d) in enumerate(zip(ra, dec))], "id long, ra double, dec double").cache()


def plain(df):
    return sorted(tuple(r) for r in df.collect())


def test_pairs_are_dealt_by_cube_and_never_broadcast(placed):
    pairs = match.match_pairs(placed, placed, 1.5)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    rows = placed.collect()
    a, d = (np.radians([r[c] for r in rows]) for c in ("ra", "dec"))
    v = np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], 1)
    near = ((v[:, None] - v[None]) ** 2).sum(2) <= 4 * np.sin(np.radians(1.5) / 2) ** 2
    assert sorted((r["l_id"], r["r_id"]) for r in pairs.collect()) == sorted((rows[i]["id"], rows[j]["id"]) for i, j in zip(*np.nonzero(near)))


@pytest.mark.parametrize("radius", [3.0])
def test_components_without_pairs(placed, radius):
    assert plain(match.connected_within(placed, radius)) == plain(match.connected_objects(placed.select("id"), match.self_pairs(placed, radius)))


def test_greedy_matches_by_growing_radii(placed):
    l, r = placed.filter("id % 3 = 0"), placed.filter("id % 3 > 0")
    pairs = match.match_pairs(l, r, 6.0, exact=True)
    assert plain(match.greedy_within(l, r, 6.0)) == plain(match.mutual_matches(pairs))
    claims = plain(match.one_claim(pairs).select("r_id", "l_id", "sep"))
    assert plain(match.nearest_within(r, l, 6.0)) == claims


def test_tile_owner_of_a_row_halfway_between_two(spark, tmp_path):
    spark.createDataFrame([(5700,)], "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(5699,), (5700,)], "s_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    tables = {"customer": spark.read.parquet(f"{tmp_path}/customer.parquet").toPandas(), "supplier": spark.read.parquet(f"{tmp_path}/supplier.parquet").toPandas()}
    assert spark_rows(catalogue.queries()["tile_owner"](spark, str(tmp_path))) == duck_rows(catalogue.oracle_sql()["tile_owner"], tables=tables)


def test_first_in_order_of_ids_where_a_chain_outlasts_the_rounds(spark):
    nodes = spark.range(9)
    chain = spark.createDataFrame([(i, i + 1) for i in range(8)], "l_id long, r_id long")
    for most in (100, 2):
        assert plain(match.first_independent(nodes, chain, F.col("id"), rounds=1, most=most)) == [(0,), (2,), (4,), (6,), (8,)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["isolation", "master_catalogue", "one_claim", "pair_labels", "pairs_within", "redshift_dedup"])
def test_no_table_is_broadcast_whatever_size_it_seems_to_have(spark, name):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    catalogue.queries()[name](spark, SF).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = store.executionsList()
    plans = [ran.apply(i).physicalPlanDescription() for i in range(before, ran.size())]
    assert plans and not any("BroadcastExchange" in p for p in plans)
