"""Mixing sources to target weights by pivotal dependent rounding.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and
share the whole corpus; a target stops at ``max_repeats`` times its source, the
excess is reshared by weight until none is above. That fixed point is
``min(cap, level * weight)``, found from one sorted pass over the sources.

Copies: each document of a source should be taken target / source_size times.
The whole part is taken outright; the fractions are rounded by the pivotal
method: two fractions meet, one of them becomes 0 or 1 at random, the other
carries the mass on. Documents meet in order of size, so that mass moves
between documents of like size and a source's words stay near their target.

The tree: documents are cut into chunks of one source and size band, salted by
id and text so that no chunk holds more than about ``chunk`` documents however
large its source is; rows are dealt out by all three. Rows that share id and
text, if they are more than a chunk, are salted by their running number too.
A chunk leaves at most one fractional document; these residuals meet in the
next level, ``chunk`` to a group, until one is left for each source, which is
rounded at random. Uniform numbers are hashes of ids and texts, so reruns agree.

Targets need one row for each source in one task (two windows over sources, not
over documents).

Defined cases: null text has size 0; documents of size 0 take 0 words; rows
that share an id and a text get the same random number but are rounded one by
one; null is a source of its own, and null ids are ids; a source without words
has target 0; an empty table gives no rows. ``repeat_rows`` keeps rows without
words once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_REGEX, materialise, order_key, ship

ship(__name__)
P = "__lf_"


def source_targets(sizes: DataFrame, max_repeats: float = 3.0) -> DataFrame:
    """(source, source_size, n, target) of a table of (source, size). The windows run over one row per source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    s = s.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    s = s.withColumn("cap", F.col("source_size") * float(max_repeats))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy()
    s = s.select(
        "*",
        F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("capped"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
        F.sum("source_size").over(every).alias("total"),
    )
    level = (F.col("total") - F.col("capped")) / F.col("open")
    first_open = F.max(F.when(level * F.col("weight") <= F.col("cap"), level)).over(every)
    s = s.withColumn("level", first_open)
    return s.select("source", "source_size", "n", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def pivot(p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Round the fractions in order: 0/1 for each, and the place of the one that stays fractional (-1: none; its mass is then in p[that])."""
    out = np.zeros(len(p), np.int64)
    at, mass = -1, 0.0
    for i in range(len(p)):
        q = p[i]
        if q <= 0.0:
            continue
        if q >= 1.0:
            out[i] = 1
            continue
        if at < 0:
            at, mass = i, q
            continue
        total = mass + q
        if abs(total - 1.0) < 1e-9:
            out[i if u[i] * total < q else at] = 1
            at, mass = -1, 0.0
        elif total < 1.0:
            if u[i] * total < q:
                at = i
            mass = total
        else:
            # one of them becomes 1; the other keeps total - 1
            if u[i] * (2.0 - total) < 1.0 - mass:
                out[i] = 1
            else:
                out[at] = 1
                at = i
            mass = total - 1.0
    if at >= 0:
        p[at] = mass
    return out, at


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "ord", "th", "rid"], kind="stable").reset_index(drop=True)
    p = pdf["p"].to_numpy(np.float64).copy()
    take, at = pivot(p, pdf["u"].to_numpy(np.float64))
    pdf["take"] = take
    pdf["left"] = False
    if at >= 0:
        pdf.loc[at, "left"] = True
        pdf.loc[at, "p"] = p[at]
    return pdf[["sid", "ord", "th", "rid", "size", "p", "take", "left"]]


ROUNDED = "sid long, ord long, th long, rid long, size long, p double, take long, left boolean"


def _uniform(seed: int):
    """A number in [0, 1) for each (ord, th)."""
    return F.pmod(F.xxhash64(F.lit(seed), "ord", "th"), F.lit(1 << 52)) / float(1 << 52)


def _rated(sized: DataFrame, max_repeats: float) -> DataFrame:
    """``sized`` with source_size, target, sid and the copies that each document should have (whole and p)."""
    sources = materialise(source_targets(sized, max_repeats).withColumn("sid", F.xxhash64(F.col("source").isNull(), "source")), "mix-sources")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    both = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    return both.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.floor("rate"))


def _with_in_band(live: DataFrame, chunk: int, most: int = 10_000) -> DataFrame:
    """``live`` with in_band, the rows of its source and size band (1 where they fit one chunk); no band of many rows is shuffled by its key.

    A band above both ``chunk`` and a ``most``-th of all rows is looked up in a broadcast table: fewer
    than ``most`` bands can be that large. Bands between the two meet their count in a shuffled join.
    """
    full = materialise(live.groupBy("sid", "band").agg(F.count("*").alias("in_band")).filter(F.col("in_band") > chunk), "mix-bands")
    crowd = full.agg(F.sum("in_band")).first()[0] or 0
    large = max(chunk, math.ceil(crowd / most))
    out = live.join(F.broadcast(full.filter(F.col("in_band") > large)), ["sid", "band"], "left")
    if large > chunk:
        rest = out.filter("in_band is null").drop("in_band").join(full.filter(F.col("in_band") <= large), ["sid", "band"], "left")
        out = out.filter("in_band is not null").unionByName(rest)
    return out.withColumn("in_band", F.coalesce("in_band", F.lit(1)))


def _extra(rated: DataFrame, chunk: int, seed: int) -> DataFrame:
    """(rid) of the documents whose fraction is rounded up."""
    live = rated.filter("size > 0 and p > 0").select("sid", "ord", "th", "rid", "size", "p", F.floor(F.log2(F.col("size")) * 4).alias("band"))
    same = live.groupBy("ord", "th").agg(F.count("*").alias("same")).filter(F.col("same") > chunk)
    chunks = _with_in_band(live, chunk)
    if same.take(1):  # repeated rows: a running number parts them
        again = chunks.join(same, ["ord", "th"])
        number = F.row_number().over(Window.partitionBy("ord", "th").orderBy("rid"))
        chunks = chunks.join(same, ["ord", "th"], "left_anti").withColumn("part", F.lit(0)).unionByName(again.drop("same").withColumn("part", number))
    else:
        chunks = chunks.withColumn("part", F.lit(0))
    chunks = chunks.withColumn("salt", F.pmod(F.xxhash64("ord", "th", "part"), F.ceil(F.col("in_band") / chunk))).withColumn("u", _uniform(seed))
    dealt = chunks.select("sid", "ord", "th", "rid", "size", "u", "p", "band", "salt").repartition("sid", "band", "salt")
    done = [materialise(dealt.groupBy("sid", "band", "salt").applyInPandas(_round, ROUNDED), "mix-0")]
    residual, before = done[0].filter("left"), None
    while True:
        per = residual.groupBy("sid").count().agg(F.max("count")).first()[0] or 0
        if per <= 1:
            break
        if before is not None and per >= before:
            raise RuntimeError(f"a level of the tree left {per} residuals of {before}")
        before = per
        # ``parts`` ranges of about 16 groups each are numbered apart
        parts = F.pmod(F.xxhash64("ord", "th", F.lit(len(done))), F.lit(max(1, math.ceil(per / (16 * chunk)))))
        rank = F.row_number().over(Window.partitionBy("sid", "part").orderBy("size", "ord", "th", "rid")) - 1
        groups = residual.withColumn("u", _uniform(seed + len(done))).withColumn("part", parts).withColumn("g", F.floor(rank / chunk))
        done.append(materialise(groups.repartition("sid", "part", "g").groupBy("sid", "part", "g").applyInPandas(_round, ROUNDED), f"mix-{len(done)}"))
        residual = done[-1].filter("left")
    won = residual.filter(_uniform(seed + 99) < F.col("p")).select("rid")
    for d in done:
        won = won.unionByName(d.filter("not left and take > 0").select("rid"))
    return won


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list:
    text = F.col(f"`{text_col}`")
    return [
        F.col(f"`{id_col}`").alias("id"),
        order_key(F.col(f"`{id_col}`")).alias("ord"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD_REGEX))).cast("long").alias("size"),
        F.xxhash64(text).alias("th"),
        F.monotonically_increasing_id().alias("rid"),
    ]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: float = 3.0, chunk: int = 1024, seed: int = 5) -> DataFrame:
    """(id, size, source_size, target, taken, copies), one row for each row of ``docs``."""
    rated = _rated(materialise(docs.select(*_sized(docs, id_col, text_col, source_col)), "mix-sizes"), max_repeats)
    out = rated.join(_extra(rated, chunk, seed).withColumn("extra", F.lit(1)), "rid", "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("extra", F.lit(0))).otherwise(0).cast("long")
    return out.select("id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: float = 3.0, chunk: int = 1024, seed: int = 5) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, those without words once; all columns pass through.

    Rows are written with a number each, so that repeated and null ids are told apart.
    """
    held = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    base = materialise(docs.select(*held, *_sized(docs, id_col, text_col, source_col)), "mix-rows")
    rated = _rated(base.select("id", "ord", "source", "size", "th", "rid"), max_repeats)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("extra", F.lit(0))).otherwise(1).cast("int")
    counted = rated.join(_extra(rated, chunk, seed).withColumn("extra", F.lit(1)), "rid", "left").select("rid", copies.alias("copies")).filter("copies > 0")
    taken = base.join(counted, "rid").withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
