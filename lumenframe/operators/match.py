"""Positional joins without a cross product.

Positions become unit vectors in a grid of cubes whose side is the chord of the
radius, so two positions within the radius lie in the same or adjacent cubes.
The left side is repeated for those of the 27 cubes around it that the radius and
the sphere reach, and an equi-join on the cube, always dealt by cube and never
broadcast, finds candidates, which the exact chord then decides: no special cases
at the poles or at RA 0, and crowded cubes are ordinary skewed join keys.

Sides that follow the tables are never broadcast (``hint("merge")``): Spark takes their sizes from
compressed columns, and ids in order take few bytes there and many in the driver.

What needs only the nearest (or pairs by increasing distance) does not list all pairs
within the radius: it starts at a radius that holds a few and goes on from there.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.sky import chord2, exact_separation_deg, exact_unit_vector, separation_deg

AXES = ("x", "y", "z")
WIDER = 1 + 1e-9


def _placed(df: DataFrame, key: str, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    at = df.select(F.col(key).alias(f"{prefix}id"), exact_unit_vector(F.col("ra"), F.col("dec")).alias("at"), *[F.col(c).alias(prefix + c) for c in keep])
    return at.select(f"{prefix}id", *[F.col(f"at.{a}").alias(prefix + a) for a in AXES], *[prefix + c for c in keep])


def _cube(prefix: str, side: float) -> list[Column]:
    return [F.floor(F.col(prefix + a) / side).alias("g" + a) for a in AXES]


def _chord(radius_deg: float) -> float:
    return 2.0 * math.sin(math.radians(radius_deg) / 2.0)


def _around(side: float):
    """Rows repeated for the cubes around them that the radius and the sphere reach; others hold nothing."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        step = np.array([(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
        for batch in batches:
            at = np.stack([batch.column(batch.schema.get_field_index("l_" + a)).to_numpy(zero_copy_only=False).astype(np.float64) for a in AXES], 1)
            row = np.flatnonzero(np.isfinite(at).all(1))
            own, kept, cubes = np.floor(at[row] / side).astype(np.int64), [], []
            for d in step:
                g = own + d
                low, high = g * side, (g + 1) * side
                apart = (np.maximum(0, np.maximum(low - at[row], at[row] - high)) ** 2).sum(1)
                inner, outer = (np.maximum(0, np.maximum(low, -high)) ** 2).sum(1), (np.maximum(np.abs(low), np.abs(high)) ** 2).sum(1)
                ok = (apart <= side * side * WIDER) & (inner <= WIDER) & (outer >= 2 - WIDER)
                kept.append(row[ok]), cubes.append(g[ok])
            kept, cubes = np.concatenate(kept), np.concatenate(cubes)
            for i in range(0, len(kept), 50_000):
                some = batch.take(pa.array(kept[i : i + 50_000]))
                yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array(np.ascontiguousarray(cubes[i : i + 50_000, j])) for j in range(3))], names=[*some.schema.names, "gx", "gy", "gz"])

    return run


def _meet(l: DataFrame, r: DataFrame, radius_deg: float, also: Column | None = None) -> DataFrame:
    """Placed rows of both sides within the radius, with all their columns and the squared chord ``c2``; ``also`` holds for what is kept."""
    side = _chord(radius_deg) * WIDER
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in l.schema.fields)
    l = l.mapInArrow(_around(side), f"{kinds}, gx long, gy long, gz long")
    c2 = chord2(tuple(F.col("l_" + a) for a in AXES), tuple(F.col("r_" + a) for a in AXES))
    half = math.sin(math.radians(radius_deg) / 2.0)
    met = l.hint("merge").join(r.select("*", *_cube("r_", side)), ["gx", "gy", "gz"]).withColumn("c2", c2).filter(F.col("c2") <= 4.0 * half * half)
    return met if also is None else met.filter(also)


def match_pairs(left: DataFrame, right: DataFrame, radius_deg: float, left_key: str = "id", right_key: str = "id", keep: tuple[str, ...] = (), exact: bool = False) -> DataFrame:
    """(l_id, r_id, sep) of all pairs within the radius; both sides have ra and dec in degrees.

    Columns in ``keep`` follow as l_ and r_ columns. Separations agree to the last bit with the C library's where ``exact``.
    """
    met = _meet(_placed(left, left_key, "l_", keep), _placed(right, right_key, "r_", keep), radius_deg)
    sep = exact_separation_deg if exact else separation_deg
    return met.select("l_id", "r_id", sep(F.col("c2")).alias("sep"), *[p + c for c in keep for p in ("l_", "r_")])


def nearest_within(left: DataFrame, right: DataFrame, radius_deg: float, left_key: str = "id", right_key: str = "id") -> DataFrame:
    """(id, r_id, sep) of the nearest right row for the left rows that have one within the radius; ties to the smaller id.

    The first radius is a cell's width if right rows were spread evenly; rows without a match go on at twice the radius. Each round is a checkpoint.
    """
    n = right.count()
    todo = left.select(F.col(left_key).alias("id"), "ra", "dec").filter("id is not null")
    kinds = f"id {todo.schema['id'].dataType.simpleString()}, r_id {right.schema[right_key].dataType.simpleString()}, sep double"
    found = left.sparkSession.createDataFrame([], kinds)
    if not n:
        return found
    radius = min(radius_deg, math.degrees(math.sqrt(4 * math.pi / n)))
    while True:
        pairs = match_pairs(todo, right, radius, "id", right_key, exact=True)
        met = pairs.groupBy(F.col("l_id").alias("id")).agg(F.min(F.struct("sep", "r_id")).alias("b")).select("id", F.col("b.r_id").alias("r_id"), F.col("b.sep").alias("sep")).checkpoint()
        found = found.unionByName(met)
        if radius >= radius_deg:
            return found
        todo = todo.hint("merge").join(met.select("id"), "id", "left_anti").checkpoint()
        if not todo.take(1):
            return found
        radius = min(radius_deg, 2 * radius)


def nearest_match(left: DataFrame, right: DataFrame, radius_deg: float, left_key: str = "id", right_key: str = "id") -> DataFrame:
    """(id, r_id, sep, n_match) for every left row; no match: nulls and 0. Ties go to the smaller right id."""
    best = nearest_within(left, right, radius_deg, left_key, right_key).withColumnRenamed("id", "l_id")
    return match_counts(left, right, radius_deg, left_key, right_key).hint("merge").join(best, F.col("id") == F.col("l_id"), "left").select("id", "r_id", "sep", F.col("n").alias("n_match"))


def nearest_any(left: DataFrame, right: DataFrame, left_key: str = "id", right_key: str = "id") -> DataFrame:
    """(id, r_id, sep) of the nearest right row at any distance; ties to the smaller id, nulls if there is none."""
    best = nearest_within(left, right, 180.0, left_key, right_key).withColumnRenamed("id", "l_id")
    return left.select(F.col(left_key).alias("id")).hint("merge").join(best, F.col("id") == F.col("l_id"), "left").select("id", "r_id", "sep")


def best_in_group(members: DataFrame, group: str, order: list) -> DataFrame:
    """One row of each group, the first in a lexicographic order; a minimum, combined before the shuffle."""
    rest = [c for c in members.columns if c != group]
    best = members.groupBy(group).agg(F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("b"))
    return best.select(group, "b.*")


def match_counts(left: DataFrame, right: DataFrame, radius_deg: float, left_key: str = "id", right_key: str = "id") -> DataFrame:
    """(id, n), zeros included."""
    n = match_pairs(left, right, radius_deg, left_key, right_key).groupBy("l_id").count()
    return left.select(F.col(left_key).alias("id")).hint("merge").join(n, F.col("id") == F.col("l_id"), "left").select("id", F.coalesce("count", F.lit(0)).alias("n"))


def self_pairs(df: DataFrame, radius_deg: float, key: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each pair once, smaller id first."""
    return match_pairs(df, df, radius_deg, key, key, keep).filter("l_id < r_id")


def anti_match(left: DataFrame, right: DataFrame, radius_deg: float, left_key: str = "id", right_key: str = "id") -> DataFrame:
    """Left rows with nothing within the radius."""
    return left.hint("merge").join(match_pairs(left, right, radius_deg, left_key, right_key).select(F.col("l_id").alias(left_key)).distinct(), left_key, "left_anti")


def semi_match(left: DataFrame, right: DataFrame, radius_deg: float, left_key: str = "id", right_key: str = "id") -> DataFrame:
    """J11 by position: left rows with something within the radius."""
    return left.hint("merge").join(match_pairs(left, right, radius_deg, left_key, right_key).select(F.col("l_id").alias(left_key)).distinct(), left_key, "left_semi")


def one_claim(pairs: DataFrame) -> DataFrame:
    """Of all left rows that claim a right row, the nearest keeps it."""
    rank = F.row_number().over(Window.partitionBy("r_id").orderBy("sep", "l_id"))
    return pairs.withColumn("rank", rank).filter("rank = 1").drop("rank")


def _settled(edges: DataFrame, columns: list[str], ends: tuple[str, str], solve, schema: str, most: int) -> tuple[DataFrame, DataFrame]:
    """What ``solve`` says of each connected component with at most ``most`` edges, and the edges of larger ones.

    Each component is one group; ``ends`` name its nodes. Both results are checkpoints.
    """
    l, r = (F.concat(F.lit(f"{i}:"), F.col(c).cast("string")) if ends[0] != ends[1] else F.col(c) for i, c in enumerate(columns[:2]))
    named = edges.withColumn("u_", l).withColumn("v_", r)
    nodes = named.select(F.col("u_").alias("id")).union(named.select("v_")).distinct()
    part = connected_objects(nodes, named.select(F.col("u_").alias("l_id"), F.col("v_").alias("r_id")))
    met = named.hint("merge").join(part.select(F.col("id").alias("u_"), "component"), "u_").select(*columns, "component")
    met = met.checkpoint()
    # one row for ``most`` edges at most, so it may be broadcast; a component of any size is not dealt out by its name
    large = F.broadcast(met.groupBy("component").agg(F.count("*").alias("edges_")).filter(F.col("edges_") > most).select("component"))
    solved = met.join(large, "component", "left_anti").groupBy("component").applyInPandas(solve, schema).checkpoint()
    return solved, met.join(large, "component", "left_semi").select(*columns).checkpoint()


def mutual_matches(pairs: DataFrame, rounds: int = 3, most: int = 200_000) -> DataFrame:
    """Greedy one-to-one matching by increasing distance.

    Pairs that are nearest for both their ends are exactly those a greedy pass would take next; they are
    taken, their ends leave, and so on for ``rounds`` rounds, after which few pairs are left, mostly in chains. Then each connected
    component of at most ``most`` pairs is passed through in one group; larger ones go on by rounds. Each round is a checkpoint.
    """
    order = F.struct("sep", "l_id", "r_id")
    columns = ["l_id", "r_id", "sep"]
    left, taken = pairs.filter("l_id is not null and r_id is not null and sep is not null").select(*columns).checkpoint(), []

    def greedy(pdf):
        used, rows = (set(), set()), []
        for i, (l, r) in enumerate(pdf.sort_values(["sep", "l_id", "r_id"])[["l_id", "r_id"]].itertuples(index=False)):
            if l not in used[0] and r not in used[1]:
                used[0].add(l), used[1].add(r), rows.append(i)
        return pdf.sort_values(["sep", "l_id", "r_id"]).iloc[rows][columns]

    while left.take(1):
        if len(taken) == rounds:
            kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.schema.fields)
            solved, left = _settled(left, columns, ("l", "r"), greedy, kinds, most)
            taken.append(solved)
            continue
        first = left.withColumn("bl", F.min(order).over(Window.partitionBy("l_id"))).withColumn("br", F.min(order).over(Window.partitionBy("r_id")))
        now = first.filter((F.col("bl") == order) & (F.col("br") == order)).select(*columns).distinct().checkpoint()
        taken.append(now)
        left = left.hint("merge").join(now.select("l_id"), "l_id", "left_anti").hint("merge").join(now.select("r_id"), "r_id", "left_anti").select(*columns).checkpoint()
    return reduce(DataFrame.unionByName, taken) if taken else left


def greedy_within(left: DataFrame, right: DataFrame, radius_deg: float, left_key: str = "id", right_key: str = "id") -> DataFrame:
    """The ``mutual_matches`` of all pairs within the radius, without listing them.

    A greedy pass by distance decides the pairs within a smaller radius first, so radii that double, each over the rows that are
    still free, take the same pairs. The first holds about one row of the larger side.
    """
    l, r = (d.select(F.col(k).alias("id"), "ra", "dec").filter("id is not null") for d, k in ((left, left_key), (right, right_key)))
    n = max(l.count(), r.count(), 1)
    radius, taken = min(radius_deg, math.degrees(math.sqrt(4 / n))), []
    while True:
        now = mutual_matches(match_pairs(l, r, radius, exact=True)).checkpoint()
        taken.append(now)
        if radius >= radius_deg:
            break
        l = l.hint("merge").join(now.select(F.col("l_id").alias("id")), "id", "left_anti").checkpoint()
        r = r.hint("merge").join(now.select(F.col("r_id").alias("id")), "id", "left_anti").checkpoint()
        if not l.take(1) or not r.take(1):
            break
        radius = min(radius_deg, 2 * radius)
    return reduce(DataFrame.unionByName, taken)


def associated_within(left: DataFrame, right: DataFrame, radius_deg: float, left_key: str = "id", right_key: str = "id") -> DataFrame:
    """``associated`` of all pairs within the radius."""
    return _with_rest(left, right, greedy_within(left, right, radius_deg, left_key, right_key), left_key, right_key)


def associated(left: DataFrame, right: DataFrame, pairs: DataFrame, left_key: str = "id", right_key: str = "id") -> DataFrame:
    """(l_id, r_id, sep): the greedy matches, then the rows of both sides that have none, with nulls."""
    return _with_rest(left, right, mutual_matches(pairs), left_key, right_key)


def _with_rest(left: DataFrame, right: DataFrame, taken: DataFrame, left_key: str, right_key: str) -> DataFrame:
    l = left.select(F.col(left_key).alias("l_id")).hint("merge").join(taken.select("l_id"), "l_id", "left_anti")
    r = right.select(F.col(right_key).alias("r_id")).hint("merge").join(taken.select("r_id"), "r_id", "left_anti")
    return taken.unionByName(l, allowMissingColumns=True).unionByName(r, allowMissingColumns=True)


def first_independent(nodes: DataFrame, pairs: DataFrame, rank: Column, rounds: int = 4, most: int = 200_000) -> DataFrame:
    """(id) of the nodes that a pass in order of ``rank`` (of nodes; ties by id) keeps, where a kept node drops its later neighbours.

    Of a chain A-B-C, A and C stay. A node is kept when all its earlier neighbours are dropped, and dropped when one is kept:
    each round decides all nodes without an undecided earlier neighbour. After ``rounds`` rounds what is left lies in chains: each connected
    component of at most ``most`` pairs is passed through in one group; larger ones go on by rounds.
    """
    ranked = nodes.select("id", F.struct(rank.alias("rank"), "id").alias("k"))
    met = pairs.filter("l_id <> r_id").select("l_id", "r_id").hint("merge").join(ranked.select(F.col("id").alias("l_id"), F.col("k").alias("lk")), "l_id").hint("merge").join(ranked.select(F.col("id").alias("r_id"), F.col("k").alias("rk")), "r_id")
    first = F.col("lk") < F.col("rk")
    edges = met.select(F.when(first, F.col("l_id")).otherwise(F.col("r_id")).alias("a"), F.when(first, F.col("r_id")).otherwise(F.col("l_id")).alias("b"), F.greatest("lk", "rk").alias("k")).distinct().checkpoint()
    gone: list[DataFrame] = []

    def in_order(pdf):
        out = set()
        earlier = pdf.groupby("b")["a"].agg(list)
        for b in pdf[["b", "n"]].drop_duplicates().sort_values("n")["b"]:
            if any(a not in out for a in earlier[b]):
                out.add(b)
        return pdf[pdf["b"].isin(out)][["b"]].drop_duplicates()

    while edges.take(1):
        if len(gone) == rounds:
            solved, edges = _settled(edges, ["a", "b", "k"], ("a", "a"), _by_number(in_order), f"b {edges.schema['b'].dataType.simpleString()}", most)
            gone.append(solved)
            continue
        free = edges.hint("merge").join(edges.select(F.col("b").alias("a")), "a", "left_anti").select("a").distinct()
        now = edges.hint("merge").join(free, "a", "left_semi").select("b").distinct().checkpoint()
        gone.append(now)
        edges = edges.hint("merge").join(now, "b", "left_anti").hint("merge").join(now.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b", "k").checkpoint()
    dropped = reduce(DataFrame.unionByName, gone).select(F.col("b").alias("id")) if gone else edges.select(F.col("b").alias("id"))
    return nodes.select("id").hint("merge").join(dropped, "id", "left_anti")


def _by_number(f):
    """``f`` of a group with its ``k`` (structs) as numbers ``n`` in their order."""

    def run(pdf):
        keys = [tuple(k.values()) if isinstance(k, dict) else tuple(k) for k in pdf["k"]]
        place = {k: i for i, k in enumerate(sorted(set(keys)))}
        return f(pdf.assign(n=[place[k] for k in keys]))

    return run


def spaced_selection(nodes: DataFrame, pairs: DataFrame, rank: Column, caps: dict[str, int]) -> DataFrame:
    """(id) that a pass in order of ``rank`` (ties by id) keeps: no kept pair, and at most ``caps[c]`` of each value of column c.

    A node is kept when no earlier neighbour is undecided or kept and its place among the undecided of each of its groups, with
    those already kept there, is within the cap; full groups are closed. Every round keeps at least the first node that is open. Null
    groups are groups.
    """
    by = list(caps)
    open_ = nodes.select("id", F.struct(rank.alias("rank"), "id").alias("k"), *by).checkpoint()
    both = pairs.filter("l_id <> r_id").select(F.col("l_id").alias("id"), F.col("r_id").alias("other"))
    both = both.unionByName(both.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct().checkpoint()
    kept: list[DataFrame] = []
    while open_.take(1):
        told = both.hint("merge").join(open_.select("id", "k"), "id").hint("merge").join(open_.select(F.col("id").alias("other"), F.col("k").alias("ok")), "other")
        waiting = told.filter("ok < k").select("id").distinct()
        now = open_
        for c in by:
            # the first of each group, limited before the shuffle
            place = F.row_number().over(Window.partitionBy(c).orderBy("k"))
            near = open_.withColumn("place_", place).filter(F.col("place_") <= caps[c]).select("id", "place_", F.col(c).alias("c_"))
            if kept:
                full = reduce(DataFrame.unionByName, kept).groupBy(F.col(c).alias("d_")).agg(F.count("*").alias("kept_"))
                near = near.hint("merge").join(full, F.col("c_").eqNullSafe(F.col("d_")), "left").filter(F.col("place_") + F.coalesce("kept_", F.lit(0)) <= caps[c])
            now = now.hint("merge").join(near.select("id"), "id", "left_semi")
        now = now.hint("merge").join(waiting, "id", "left_anti").checkpoint()
        kept.append(now)
        every = reduce(DataFrame.unionByName, kept)
        open_ = open_.hint("merge").join(now, "id", "left_anti").hint("merge").join(both.hint("merge").join(now.select("id"), "id").select(F.col("other").alias("id")), "id", "left_anti")
        for c in by:
            full = every.groupBy(F.col(c).alias("d_")).count().filter(F.col("count") >= caps[c])
            open_ = open_.hint("merge").join(full, F.col(c).eqNullSafe(F.col("d_")), "left_anti")
        open_ = open_.checkpoint()
    return (reduce(DataFrame.unionByName, kept) if kept else open_).select("id")


def connected_objects(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable by pairs of nodes.

    Large-star and small-star steps until every edge leads from a node to the root of its star; rounds grow
    with the logarithm of the longest chain, and each is a checkpoint.
    """
    edges = pairs.filter("l_id <> r_id").select(F.greatest("l_id", "r_id").alias("u"), F.least("l_id", "r_id").alias("v")).distinct()
    for end in ("u", "v"):
        edges = edges.hint("merge").join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    edges = edges.select("u", "v").checkpoint()
    while True:
        roots = edges.hint("merge").join(edges.select(F.col("u").alias("v")), "v", "left_anti")
        if not edges.groupBy("u").count().filter("count > 1").take(1) and roots.count() == edges.count():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.hint("merge").join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.hint("merge").join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        edges = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct().checkpoint()
    return nodes.select("id").hint("merge").join(edges, F.col("id") == F.col("u"), "left").select("id", F.coalesce("v", "id").alias("component"))


def connected_within(df: DataFrame, radius_deg: float, key: str = "id") -> DataFrame:
    """The ``connected_objects`` of all pairs within the radius, without listing them.

    Rows of a cube whose diagonal is the radius are connected: cubes are joined by one row of each. Then only rows near a
    row of another component are compared, so crowded places cost what their cubes do.
    """
    chord = _chord(radius_deg)
    rows = _placed(df, key, "l_").filter("l_id is not null")
    cell = ["gx", "gy", "gz"]
    rows = rows.select("*", *_cube("l_", chord / math.sqrt(3) / WIDER)).checkpoint()
    centre = sum((F.pow(F.col("l_" + a) / F.lit(chord / math.sqrt(3) / WIDER) - F.col("g" + a) - 0.5, F.lit(2.0)) for a in AXES), F.lit(0.0))
    cells = rows.groupBy(*cell).agg(F.min("l_id").alias("cell"), F.min_by(F.struct(*["l_" + a for a in AXES]), F.struct(centre, "l_id")).alias("at"))
    cells = cells.select(*cell, "cell", *[F.col(f"at.l_{a}").alias("l_" + a) for a in AXES]).checkpoint()
    as_right = lambda d: d.select(*[F.col(c).alias("r_" + c[2:]) for c in d.columns])
    middle = cells.select(F.col("cell").alias("l_id"), *["l_" + a for a in AXES])
    parts = connected_objects(cells.select(F.col("cell").alias("id")), _meet(middle, as_right(middle), radius_deg, F.col("l_id") < F.col("r_id")).select("l_id", "r_id"))
    cells = cells.select(*cell, "cell").hint("merge").join(parts.select(F.col("id").alias("cell"), F.col("component").alias("l_part")), "cell").drop("cell")
    rows = rows.hint("merge").join(cells, cell).drop(*cell).checkpoint()
    # cubes of the radius around which there are several components
    side = chord * WIDER
    wide = rows.select(*_cube("l_", side), "l_part").distinct()
    around = F.explode(F.array(*[F.struct(*[F.lit(v).cast("long").alias(a) for a, v in zip(AXES, (i, j, k))]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    mixed = wide.withColumn("d", around).groupBy(*[(F.col("g" + a) + F.col(f"d.{a}")).alias("g" + a) for a in AXES]).agg(F.min("l_part").alias("a"), F.max("l_part").alias("b")).filter("a <> b").select(*cell)
    some = rows.select("*", *_cube("l_", side)).hint("merge").join(mixed, cell, "left_semi").drop(*cell)
    # both rows of a link between components lie in such cubes
    links = _meet(some, as_right(some), radius_deg, F.col("l_part") < F.col("r_part")).select(F.col("l_part").alias("l_id"), F.col("r_part").alias("r_id")).distinct()
    whole = connected_objects(rows.select(F.col("l_part").alias("id")).distinct(), links)
    return rows.select(F.col("l_id").alias("id"), "l_part").hint("merge").join(whole.select(F.col("id").alias("l_part"), "component"), "l_part").select("id", "component")


def sky_blocks(df: DataFrame, parent: Column, order: Column, rows: int) -> DataFrame:
    """Rows of one parent cell in pixel order, at most ``rows`` to a block; each row once."""
    rank = F.row_number().over(Window.partitionBy("parent").orderBy("pix", "id")) - 1
    return df.withColumn("pix", order).withColumn("parent", parent).withColumn("block", F.floor(rank / rows))
