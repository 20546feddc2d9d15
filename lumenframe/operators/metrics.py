"""Ranking, reliability and resampling metrics over (score, label[, weight]) rows."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


#: Cumulative probabilities of a Poisson(1) count of 0 to 7.
POISSON = [round(sum(1 / math.factorial(i) for i in range(k + 1)) / math.e, 12) for k in range(8)]


#: Rows of a range, the most ranges, and the most parts of one heavy value in ``numbered``.
RANGE, RANGES, SUBRANGES = 250_000, 4096, 512


def _array(values) -> Column:
    """The numbers as one array of their own type (large integers stay exact), in one call to the JVM."""

    def one(v) -> str:
        if isinstance(v, float):
            return f"{v!r}D" if math.isfinite(v) else f"double('{v}')"
        return f"{v}BD" if isinstance(v, Decimal) else f"{v}L"

    return F.expr(f"array({', '.join(map(one, values))})")


def range_of(x: Column, ends: list) -> Column:
    """How many of the sorted ``ends`` are at most ``x``; many ends are searched in two steps, by their first ones and within a chunk."""
    upto = lambda values: F.size(F.filter(values, lambda e: e <= x))
    if len(ends) <= 64:
        return upto(_array(ends)) if ends else F.lit(0)
    size = math.isqrt(len(ends) - 1) + 1
    chunks = [ends[i : i + size] for i in range(0, len(ends), size)]
    chunk = upto(_array(c[0] for c in chunks))
    return F.when(chunk == 0, F.lit(0)).otherwise((chunk - 1) * size + upto(F.get(F.array(*map(_array, chunks)), chunk - 1)))


def _ends(df: DataFrame, x: str, rows: int, most: int) -> list:
    """Approximate quantiles of ``x`` that cut ``df`` into ranges of about ``rows`` rows, at most ``most`` of them; a heavy value comes several times."""
    at = ", ".join(f"{i / most}D" for i in range(1, most))
    row = df.agg(F.expr(f"percentile_approx(`{x}`, array({at}), 10000)").alias("ends"), F.count(x).alias("n")).first()
    step = max(1, most // max(1, -(-row["n"] // rows)))
    return (row["ends"] or [])[step - 1 :: step]


def numbered(df: DataFrame, order: list[str], weight: str | None = None, rows: int = RANGE) -> DataFrame:
    """``df`` with ``before``: how many rows (or how much ``weight``) come before each in ``order``, whose first column is a number.

    Rows are cut into ranges of the first column by approximate quantiles, as many as the table's size asks for;
    ranges are summed, and windows run within a range only. A first value that fills several ranges is cut on by
    the second column, where that is a number: no task sees the whole table, unless all of ``order`` ties.
    """
    ends = _ends(df, order[0], rows, RANGES)
    heavy = sorted({a for a, b in zip(ends, ends[1:]) if a == b})
    ranged = df.withColumn("r_", range_of(F.col(order[0]), list(dict.fromkeys(ends)))).withColumn("s_", F.lit(0))
    if heavy and len(order) > 1 and isinstance(df.schema[order[1]].dataType, NumericType):
        is_heavy = range_of(F.col(order[0]), heavy)
        is_heavy = (is_heavy > 0) & (F.get(_array(heavy), is_heavy - 1) == F.col(order[0]))
        inner = list(dict.fromkeys(_ends(df.filter(is_heavy), order[1], rows, SUBRANGES)))
        # a heavy value is the least of its range: the others there come after all of its parts
        ranged = ranged.withColumn("s_", F.when(is_heavy, range_of(F.col(order[1]), inner)).otherwise(F.lit(len(inner) + 1)))
    w = F.lit(1) if weight is None else F.col(weight)
    below = Window.orderBy("r_", "s_").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range and part
    bases = ranged.groupBy("r_", "s_").agg(F.sum(w).alias("w_")).select("r_", "s_", F.coalesce(F.sum("w_").over(below), F.lit(0)).alias("base_"))
    within = Window.partitionBy("r_", "s_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(bases), ["r_", "s_"]).withColumn("before", F.col("base_") + F.coalesce(F.sum(w).over(within), F.lit(0))).drop("r_", "s_", "base_")


def tiles(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """``df`` with ``tile``: 1 to n, of sizes that differ by one at most, the larger ones first."""
    total = df.count()
    size, more = divmod(total, n)
    at = F.col("before")
    late = F.floor((at - more * (size + 1)) / max(size, 1)) + more
    return numbered(df, order).withColumn("tile", (F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(late) + 1).cast("int")).drop("before")


def auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row (auc, n1, n0); ties count half; non-finite scores are dropped. Rows are first counted by score."""
    s = df.filter(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("q"))
    n1, n0 = F.sum("p"), F.sum("q")
    return numbered(s, ["s"], "q").agg((F.sum(F.col("p") * (F.col("before") + F.col("q") * 0.5)) / (n1 * n0)).alias("auc"), n1.alias("n1"), n0.alias("n0"))


def roc(df: DataFrame, thresholds: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, tpr, fpr) in one pass; thresholds are columns of one aggregate, not copies of the rows."""
    yes, no = F.col(label) == 1, F.col(label) != 1
    aggs = [F.struct(F.lit(t).alias("threshold"), (F.count_if(yes & (F.col(score) >= t)) / F.count_if(yes)).alias("tpr"), (F.count_if(no & (F.col(score) >= t)) / F.count_if(no)).alias("fpr")).alias(f"t{i}") for i, t in enumerate(thresholds)]
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.col(f"t{i}") for i in range(len(thresholds))])).alias("x")).select("x.*")


def reliability(df: DataFrame, bins: int, least: int = 1, score: str = "score", label: str = "label") -> DataFrame:
    """(bin, mean_p, rate, n) of left-closed bins, the last closed at 1."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.avg(score).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("rate"), F.count("*").alias("n")).filter(F.col("n") >= least)


def log_loss(df: DataFrame, score: str = "score", label: str = "label", weight: Column | None = None) -> DataFrame:
    """V04."""
    w = F.lit(1.0) if weight is None else weight
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(score)))
    return df.agg((-F.sum(w * F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(F.lit(1.0) - p))) / F.sum(w)).alias("log_loss"))


def weighted_quantile(df: DataFrame, q: float, x: str = "x", weight: str = "w") -> DataFrame:
    """The smallest value at which the running weight reaches ``q`` of the whole."""
    s = df.groupBy(x).agg(F.sum(weight).alias("w"))
    total = s.agg(F.sum("w").alias("all"))  # one row
    return numbered(s, [x], "w").crossJoin(F.broadcast(total)).filter(F.col("before") + F.col("w") >= F.lit(q) * F.col("all")).agg(F.min(x).alias("value"))


def quantiles(df: DataFrame, at: list[float], x: str = "x") -> DataFrame:
    """One row (q): the exact quantiles of the numbers in ``x``, interpolated linearly; null where there are none.

    Values are counted, then ranked within ranges; only the rows that hold a wanted rank, at most two a quantile, come together.
    """
    s = df.filter(F.col(x).isNotNull() & ~F.isnan(x)).groupBy(F.col(x).alias("s")).agg(F.count("*").alias("n"))
    total = s.agg(F.sum("n").alias("all"))  # one row
    places = F.array(*[(F.col("all") - 1) * F.lit(float(p)) for p in at])
    holds = lambda r, k: (r["before"] <= k) & (k < r["before"] + r["n"])
    row = F.struct("s", "before", "n")
    wanted = F.exists("places", lambda k: holds(row, F.floor(k)) | holds(row, F.ceil(k)))
    held = numbered(s, ["s"], "n").crossJoin(F.broadcast(total.select(places.alias("places")))).filter(wanted)
    few = held.agg(F.collect_list(row).alias("rows"), F.first("places").alias("places"))
    value = lambda k: F.get(F.filter("rows", lambda r: holds(r, k)), F.lit(0))["s"]
    return few.select(F.transform("places", lambda k: value(F.floor(k)) + (value(F.ceil(k)) - value(F.floor(k))) * (k - F.floor(k))).alias("q"))


def roc_at_quantiles(df: DataFrame, at: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """(i, threshold, tpr, fpr) at quantiles of all scores, in one more pass; rates are null without rows of their label."""
    rows = df.filter(F.col(score).isNotNull() & ~F.isnan(score))
    x = rows.crossJoin(F.broadcast(quantiles(rows, at, score)))  # one row
    yes = F.col(label) == 1
    rate = lambda of, t: F.try_divide(F.count_if(of & (F.col(score) >= t)), F.count_if(of))
    aggs = [F.struct(F.lit(i).alias("i"), F.first(t).alias("threshold"), rate(yes, t).alias("tpr"), rate(~yes, t).alias("fpr")).alias(f"t{i}") for i, t in ((i, F.get("q", F.lit(i))) for i in range(len(at)))]
    return x.agg(*aggs).select(F.explode(F.array(*[F.col(f"t{i}") for i in range(len(at))])).alias("x")).select("x.*")


def contamination(df: DataFrame, retention: float, score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, contamination): the score that keeps ``retention`` of label 1, and the share of label 0 at or above it."""
    cut = quantiles(df.filter(F.col(label) == 1), [1.0 - retention], score).select(F.get("q", F.lit(0)).alias("threshold"))  # one row
    return df.filter(F.col(label) == 0).crossJoin(F.broadcast(cut)).groupBy("threshold").agg(F.avg((F.col(score) >= F.col("threshold")).cast("double")).alias("contamination"))


def capped_sample(df: DataFrame, stratum: list[str], key: str, most: int) -> DataFrame:
    """At most ``most`` rows of each stratum, by md5 of the key, with the weight N / n that restores the stratum."""
    order = F.md5(F.col(key).cast("string").cast("binary"))
    # a rank alone is limited before the shuffle; sizes are counted beside it
    few = df.withColumn("rank", F.row_number().over(Window.partitionBy(*stratum).orderBy(order, F.col(key)))).filter(F.col("rank") <= most).drop("rank")
    sizes = df.groupBy(*[F.col(c).alias(f"{c}_s") for c in stratum]).agg(F.count("*").alias("size_s"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_s")) for c in stratum]
    return few.join(sizes, same).withColumn("weight", F.col("size_s") / F.least("size_s", F.lit(most))).drop("size_s", *[f"{c}_s" for c in stratum])


def times_drawn(block: Column, draw: Column) -> Column:
    """A Poisson(1) count, at most 8, from the first 28 bits of the md5 of ``block:draw``."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", block, draw).cast("binary")), 1, 7), 16, 10).cast("long") / F.lit(float(1 << 28))
    return F.size(F.filter(F.array(*map(F.lit, POISSON)), lambda edge: edge <= u))


def block_bootstrap(df: DataFrame, block: str, draws: int, statistic) -> DataFrame:
    """``statistic`` (a list of aggregate columns using the count column ``times``) of each draw.

    A block's Poisson(1) count of a draw comes from a hash of both, so draws need no copy of the data in
    memory and reruns agree. Blocks are reduced by the caller first; each meets a fixed number of draws.
    """
    drawn = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("times", times_drawn(F.col(block), F.col("draw")))
    return drawn.groupBy("draw").agg(*statistic)


def census(df: DataFrame, block: str, bin: str, bins: int, area: float, draws: int) -> DataFrame:
    """(bin, density, error): counts of each bin over the area of the blocks, one of ``area`` each, and their spread over resamplings of whole blocks.

    Rows are first counted by block; rows outside the bins count in none.
    """
    blocks = df.groupBy(block).agg(*[F.count_if(F.col(bin) == j).alias(f"c{j}") for j in range(bins)])
    rates = lambda w: [F.try_divide(F.sum(w * F.col(f"c{j}")), F.sum(w) * F.lit(area)).alias(f"e{j}") for j in range(bins)]
    errors = block_bootstrap(blocks, block, draws, rates(F.col("times"))).agg(*[F.stddev_pop(f"e{j}").alias(f"s{j}") for j in range(bins)])
    both = blocks.agg(*rates(F.lit(1))).crossJoin(F.broadcast(errors))  # one row each
    each = [F.struct(F.lit(j).alias("bin"), F.col(f"e{j}").alias("density"), F.col(f"s{j}").alias("error")) for j in range(bins)]
    return both.select(F.explode(F.array(*each)).alias("x")).select("x.*")
