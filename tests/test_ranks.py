"""Ranks over whole tables, cut into ranges that follow the table's size."""

import random

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import metrics


def plain(rows, weights=None):
    """Rows before each, one after another; nulls first."""
    key = lambda i: tuple((v is not None, v if v is not None else 0) for v in rows[i])
    out, total = {}, 0
    for i in sorted(range(len(rows)), key=key):
        out[rows[i]] = total
        total += 1 if weights is None else weights[i]
    return out


@pytest.mark.parametrize("rows", [7, 40, 10**6])
@pytest.mark.parametrize("heavy", [0.0, 0.5, 0.9])
def test_numbered_equals_counting(spark, rows, heavy):
    rng = random.Random(int(heavy * 10) + rows)
    ids = rng.sample(range(-5000, 5000), 900)
    data = [(rng.choice([3, 3, 3, 2**53, 2**53 + 1]) if rng.random() < heavy else rng.choice([None, *range(-40, 60), 2**53 + 2]), i) for i in ids]
    df = spark.createDataFrame(data, "x long, id long").repartition(5)
    got = {(r.x, r.id): r.before for r in metrics.numbered(df, ["x", "id"], rows=rows).collect()}
    assert got == plain(data)
    weights = [i % 5 for i in ids]
    df = spark.createDataFrame([(*d, w) for d, w in zip(data, weights)], "x long, id long, w long")
    got = {(r.x, r.id): r.before for r in metrics.numbered(df, ["x", "id"], "w", rows=rows).collect()}
    assert got == plain(data, weights)


def test_a_heavy_value_is_cut_on(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, 5.0).otherwise(F.col("id") / 7.0).alias("x"), "id")
    made = metrics.numbered(df, ["x", "id"], rows=500)
    assert sorted(r.before for r in made.collect()) == list(range(20_000))
    ends = metrics._ends(df, "x", 500, metrics.RANGES)
    assert len(set(ends)) < len(ends)  # the value 5 fills several ranges
    assert len(set(metrics._ends(df.filter("x = 5"), "id", 500, metrics.SUBRANGES))) >= 16


def test_many_ends_are_searched_in_two_steps(spark):
    ends = [i * 3.0 for i in range(300)]
    rows = spark.range(-5, 1000).select("id", metrics.range_of(F.col("id").cast("double"), ends).alias("r")).collect()
    assert all(r.r == sum(e <= r.id for e in ends) for r in rows)
    assert spark.sql("select cast(null as double) x").select(metrics.range_of(F.col("x"), ends).alias("r")).first().r == 0


def test_empty_and_null_tables(spark):
    assert metrics.numbered(spark.createDataFrame([], "x double, id long"), ["x", "id"]).collect() == []
    df = spark.createDataFrame([(None, 2), (None, 1)], "x double, id long")
    assert sorted((r.id, r.before) for r in metrics.numbered(df, ["x", "id"], rows=1).collect()) == [(1, 0), (2, 1)]


def test_capped_sample_limits_before_the_shuffle(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("s"))
    made = metrics.capped_sample(df, ["s"], "id", 4)
    assert "WindowGroupLimit" in made._jdf.queryExecution().executedPlan().toString()
    rows = made.collect()
    assert {s: sum(r.weight for r in rows if r.s == s) for s in (None, 1, 2)} == {None: 334, 1: 333, 2: 333}
    assert len(rows) == 12
