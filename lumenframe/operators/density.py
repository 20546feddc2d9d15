"""Surface densities on hierarchical cells, with shrinkage, and lookups that fall back from cell to parent to all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(x: Column, lo: float, width: float, n: int) -> Column:
    """Left-closed bins, clipped to the end bins."""
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((x - F.lit(lo)) / F.lit(width)))).cast("int")


def cell_counts(df: DataFrame) -> DataFrame:
    """Count of each (pix, bin)."""
    return df.groupBy("pix", "bin").agg(F.count("*").alias("c"))


def density_levels(counts: DataFrame, cells: DataFrame, area: float, width: float, shift: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Density by cell, by parent and overall; the area of a level is that of all its surveyed cells, counted or not."""
    by_cell = counts.select("pix", "bin", (F.col("c") / F.lit(area * width)).alias("cell"))
    parents = cells.withColumn("parent", F.shiftright("pix", shift)).groupBy("parent").agg((F.count("*") * F.lit(area)).alias("a"))
    by_parent = counts.groupBy(F.shiftright("pix", shift).alias("parent"), "bin").agg(F.sum("c").alias("c")).join(parents, "parent").select("parent", "bin", (F.col("c") / (F.col("a") * F.lit(width))).alias("up"))
    total = cells.agg((F.count("*") * F.lit(area)).alias("a"))
    overall = counts.groupBy("bin").agg(F.sum("c").alias("c")).crossJoin(F.broadcast(total)).select("bin", (F.col("c") / (F.col("a") * F.lit(width))).alias("all"))
    return by_cell, by_parent, overall


def shrunk_density(cells: DataFrame, bins: int, counts: DataFrame, area: float, width: float, shift: int, n0: float) -> DataFrame:
    """Each cell's density drawn to its parent's, w = E / (E + n0) with E the count the parent predicts; an observed empty cell is a measured zero."""
    by_cell, by_parent, overall = density_levels(counts, cells, area, width, shift)
    grid = cells.select("pix", F.shiftright("pix", shift).alias("parent"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    # the bins' totals: one row for each bin
    x = grid.join(by_cell, ["pix", "bin"], "left").join(by_parent, ["parent", "bin"], "left").join(F.broadcast(overall), "bin", "left")
    up = F.coalesce("up", "all", F.lit(0.0))
    expected = F.lit(area * width) * up
    w = expected / (expected + F.lit(n0))
    level = F.when(F.col("cell").isNotNull(), 0).when(F.col("up").isNotNull(), 1).otherwise(2)
    return x.select("pix", "bin", (w * F.coalesce("cell", F.lit(0.0)) + (F.lit(1.0) - w) * up).alias("density"), level.alias("level"))


def merge_empty_bins(hist: DataFrame) -> DataFrame:
    """(region, bin, c), every bin given, to (region, lo, hi, c): a bin that is empty in all regions joins the one below, the first ones the first that is not.

    Windows run over bins, which are few.
    """
    pooled = hist.groupBy("bin").agg(F.sum("c").alias("all"))
    full = F.sum(F.when(F.col("all") > 0, 1).otherwise(0)).over(Window.orderBy("bin"))
    groups = pooled.select("bin", F.greatest(F.lit(1).cast("long"), full).alias("g"))
    return hist.join(groups, "bin").groupBy("region", "g").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.sum("c").alias("c")).drop("g")


def edges_from_centres(centres: DataFrame, x: str = "x") -> DataFrame:
    """(x, lo, hi): midpoints between centres, and half a bin beyond the first and the last. Centres are few: one window."""
    w = Window.orderBy(x)
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    v = F.col(x)
    half = F.when(before.isNull(), after - v).otherwise(v - before) / 2.0
    return centres.select(x, F.coalesce((before + v) / 2.0, v - half).alias("lo"), F.coalesce((v + after) / 2.0, v + half).alias("hi"))


def slice_of(z: Column, first: float, last: float, step: float) -> Column:
    """The slice of a value between ``first`` and ``last``: whole steps, so that round-off makes no extra slice at the end; null outside."""
    n = round((last - first) / step)
    at = F.floor((z - F.lit(first)) / F.lit(step) + F.lit(1e-9)).cast("int")
    return F.when((z >= first) & (z <= last), F.least(F.lit(n - 1), at))


def completeness_corrected(hist: DataFrame, completeness: Column, value: str = "c") -> DataFrame:
    """Counts over completeness, as shares of one total. One number is joined back."""
    raw = hist.withColumn("raw_", F.col(value) / completeness)
    total = raw.agg(F.sum("raw_").alias("all_"))  # one row
    return raw.crossJoin(F.broadcast(total)).withColumn("share", F.col("raw_") / F.col("all_")).drop("raw_", "all_")


def weights_to_area(sample: DataFrame, area: float, weight: str = "weight") -> DataFrame:
    """Sampling weights rescaled so that they add up to the area actually covered."""
    total = sample.agg(F.sum(weight).alias("all_"))  # one row
    return sample.crossJoin(F.broadcast(total)).withColumn(weight, F.col(weight) * F.lit(area) / F.col("all_")).drop("all_")


def covered_cells(counts: DataFrame, share: float = 0.5) -> DataFrame:
    """(pix, tile, c) to (pix, c, kept): the deepest of overlapping tiles, kept where it has at least ``share`` of the median cell."""
    best = counts.groupBy("pix").agg(F.max("c").alias("c"))
    middle = best.agg(F.percentile("c", F.lit(0.5)).alias("m_"))  # one row
    return best.crossJoin(F.broadcast(middle)).select("pix", "c", (F.col("c") >= F.lit(share) * F.col("m_")).alias("kept"))


def interpolate(points: DataFrame, grid: DataFrame, x: str = "x") -> DataFrame:
    """Linear interpolation in a small table (x, y), clamped at its ends. The table is one array, not a range join."""
    table = grid.agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("t"))
    t = F.col("t")
    v = F.greatest(F.get(t, 0)["x"], F.least(F.col(x), F.get(t, F.size(t) - 1)["x"]))
    i = F.least(F.size(t) - 2, F.greatest(F.lit(0), F.size(F.filter(t, lambda p: p["x"] <= v)) - 1))
    a, b = F.get(t, i), F.get(t, i + 1)
    return points.crossJoin(F.broadcast(table)).withColumn("y", a["y"] + (b["y"] - a["y"]) * (v - a["x"]) / (b["x"] - a["x"])).drop("t")


def shrunk_weights(rows: DataFrame, k: int, shift: int, n0: float) -> DataFrame:
    """(pix, component from 0 to k - 1) to (pix, w): each cell's shares of the components, drawn to its parent's and these to all, by n / (n + n0).

    Rows of no such component do not count.
    """
    cells = rows.filter((F.col("component") >= 0) & (F.col("component") < k)).groupBy("pix").agg(F.array(*[F.count_if(F.col("component") == j) for j in range(k)]).alias("c"), F.count("*").alias("n"))
    sums = [F.array(*[F.sum(F.get("c", F.lit(j))) for j in range(k)]).alias("c"), F.sum("n").alias("n")]
    parents = cells.groupBy(F.shiftright("pix", shift).alias("parent")).agg(*sums)
    whole = parents.agg(*sums).select(F.transform("c", lambda v: v / F.col("n")).alias("up"))  # one row

    def drawn(up: str) -> Column:
        a = F.col("n") / (F.col("n") + F.lit(n0))
        return F.transform("c", lambda v, i: a * (v / F.col("n")) + (F.lit(1.0) - a) * F.get(up, i)).alias("w")

    above = parents.crossJoin(F.broadcast(whole)).select("parent", drawn("up").alias("up"))
    return cells.withColumn("parent", F.shiftright("pix", shift)).join(above, "parent").select("pix", drawn("up"))


def _weight_round(rows: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """(level, cell, w, n) after one EM step: rows (level, cell, e, sw) under their cell's weights; combined before the shuffle."""
    ew = F.zip_with("e", "w", lambda a, b: a * b)
    parts = rows.join(weights.select("level", "cell", "w"), ["level", "cell"]).withColumn("ew", ew)
    parts = parts.withColumn("z", F.aggregate("ew", F.lit(0.0), lambda a, b: a + b)).filter("z > 0")
    sums = parts.groupBy("level", "cell").agg(F.sum("sw").alias("n"), *[F.sum(F.col("sw") * F.get("ew", F.lit(j)) / F.col("z")).alias(f"s{j}") for j in range(k)])
    return sums.select("level", "cell", F.array(*[F.col(f"s{j}") / F.col("n") for j in range(k)]).alias("w"), "n").checkpoint()


def nested_weights(rows: DataFrame, start: list[float], shift: int, n0: float, rounds: int) -> DataFrame:
    """(level, cell, n, w) of fixed component densities on the sphere (level 0), in parent cells (1) and in cells (2).

    ``rows`` have pix, lp (log densities of the components) and sw (their sampling weight). Proportions of the whole sphere are fitted by EM
    from ``start``, then those of all parents and cells together from there. Each level is then drawn to the one above by n / (n + n0), with n the
    level's sum of weights. Cells without rows are absent: they take what is above them (``weights_at``). Rows without a finite
    density or a positive weight do not count.
    """
    k = len(start)
    top = F.array_max("lp")
    each = rows.filter("pix is not null and sw > 0").filter(top.isNotNull() & (top > float("-inf")) & (F.size("lp") == k)).select("pix", "sw", F.transform("lp", lambda v: F.coalesce(F.exp(v - top), F.lit(0.0))).alias("e")).checkpoint()
    whole = each.select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("cell"), "e", "sw")
    w = whole.select("level", "cell").limit(1).withColumn("w", F.array(*map(F.lit, start)))
    for _ in range(rounds):
        w = _weight_round(whole, w, k)
    keys = F.array(F.struct(F.lit(1).alias("level"), F.shiftright("pix", shift).cast("long").alias("cell")), F.struct(F.lit(2).alias("level"), F.col("pix").cast("long").alias("cell")))
    local = each.select(F.explode(keys).alias("key"), "e", "sw").select("key.level", "key.cell", "e", "sw")
    up = w.select("w")  # one row
    v = local.select("level", "cell").distinct().crossJoin(F.broadcast(up))
    for _ in range(rounds):
        v = _weight_round(local, v, k)

    def drawn(rows_: DataFrame, above: str) -> DataFrame:
        a = F.col("n") / (F.col("n") + F.lit(float(n0)))
        return rows_.select("level", "cell", "n", F.zip_with("w", above, lambda x, y: a * x + (F.lit(1.0) - a) * y).alias("w"))

    parents = drawn(v.filter("level = 1").crossJoin(F.broadcast(up.select(F.col("w").alias("up")))), "up").checkpoint()
    held = parents.select(F.col("cell").alias("parent"), F.col("w").alias("up"))
    cells = drawn(v.filter("level = 2").withColumn("parent", F.shiftright("cell", shift)).join(held, "parent"), "up")
    return w.select("level", "cell", "n", "w").unionByName(parents).unionByName(cells).checkpoint()


def weights_at(points: DataFrame, weights: DataFrame, shift: int) -> DataFrame:
    """``points`` (with pix) with ``w`` of their cell, else of its parent, else of the sphere, and the ``level`` that gave it."""
    at = lambda level, name: weights.filter(F.col("level") == level).select(F.col("cell").alias(f"c{level}_"), F.col("w").alias(name))
    x = points.withColumn("c2_", F.col("pix").cast("long")).withColumn("c1_", F.shiftright("pix", shift).cast("long"))
    x = x.join(at(2, "w2_"), "c2_", "left").join(at(1, "w1_"), "c1_", "left").crossJoin(F.broadcast(at(0, "w0_").drop("c0_")))  # one row
    level = F.when(F.col("w2_").isNotNull(), 2).when(F.col("w1_").isNotNull(), 1).otherwise(0)
    return x.withColumn("w", F.coalesce("w2_", "w1_", "w0_")).withColumn("level", level).drop("c1_", "c2_", "w0_", "w1_", "w2_")


def cone_weights(rows: DataFrame, initial: list[float], n0: float, rounds: int) -> DataFrame:
    """One row (n, w): the proportions of the rows of a cone by EM from ``initial``, drawn back to it by n / (n + n0)."""
    fit = nested_weights(rows.withColumn("pix", F.lit(0).cast("long")), initial, 0, 0.0, rounds).filter("level = 0")
    a = F.col("n") / (F.col("n") + F.lit(float(n0)))
    return fit.select("n", F.zip_with("w", F.array(*map(F.lit, initial)), lambda x, y: a * x + (F.lit(1.0) - a) * y).alias("w"))
