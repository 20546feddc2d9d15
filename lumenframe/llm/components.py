"""Connected components by alternating large-star and small-star steps, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, materialise


def _min_of(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component, for every node in ``links`` (columns ``u``, ``v``, any orderable type).

    Rounds grow with the logarithm of the longest chain; each is two aggregations, which combine before the shuffle, and
    two joins on a node, of which those with many edges are not dealt out. Each round is written, so lost executors cost
    one round at most. No edges give no rows.
    """
    edges = materialise(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = join_unique(both.filter("v > u"), _min_of(both), "u", "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.filter("u <> v")
        small_in = large  # u > v already: every neighbour is smaller
        small = small_in.join(_min_of(small_in), "u")
        edges = materialise(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
