"""Iterative estimators: extreme deconvolution, mixing fractions, component weights.

The E step runs where the rows are. Its sums, K * d**2 numbers for each partition,
or for each block of a group's rows, are added in a tree in a fixed order, so passes
repeat bit by bit and the driver gets a bounded number of them; the M step is driver-sized
for one model, and runs in tasks for the models of many groups.
"""

from __future__ import annotations

import hashlib
import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.scalar import let

from .mixture import Mixture, log_prob, matrix, posterior_sums

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sufficient_statistics(m: Mixture, x, var, observed, weight) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """``posterior_sums`` of rows that measure the coordinates themselves."""
    d = m.means.shape[1]
    return posterior_sums(m, (np.eye(d), np.zeros(d), np.zeros((d, d))), x, var, observed, weight)


#: Rows of sums that one task adds up.
FAN = 64


def _add(names: list[str]):
    """The sums of one group and node, added in the order of their parts."""

    def run(t: pa.Table) -> pa.Table:
        part, data = t["part"].to_numpy(), t["s"].to_pylist()
        total = 0.0
        for i in np.lexsort((data, part)) if len(set(part.tolist())) < len(part) else np.argsort(part):
            total = total + np.frombuffer(data[i])
        return pa.table({**{n: t[n].slice(0, 1) for n in names}, "part": pa.array([int(t["node"][0].as_py())], pa.int64()), "s": pa.array([total.tobytes()], pa.binary())})

    return run


def tree_sum(sums: DataFrame, by: list[str], most: int, stop: int = 1) -> DataFrame:
    """Vectors (by, part LONG, s: doubles as BINARY) added up to ``stop`` rows a group, about ``FAN`` to a task at each level.

    ``most`` is the number of rows of the largest group. Additions follow ``part``, so they repeat bit by bit; no task and no
    driver sees more than its share of the rows.
    """
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in sums.schema.fields if f.name in by)
    while most > stop:
        most = -(-most // FAN)
        sums = sums.withColumn("node", F.pmod("part", F.lit(most))).groupBy(*by, "node").applyInArrow(_add(by), types + "part long, s binary")
    return sums


def _batch(part: int, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([s.tobytes()], pa.binary())], names=["part", "s"])


def _statistics(m: Mixture):
    """One vector a partition: rows, weight and log density of the fitted rows, the same of the held-out ones, then the sums."""
    k, d = m.means.shape

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros(6 + k * (1 + d + d * d))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, v = (matrix(batch.column(i), d) for i in (0, 1))
            weight = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            held = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            seen = np.isfinite(x) & np.isfinite(v) & (v >= 0)
            x, v = np.where(seen, x, 0), np.where(seen, v, 0)
            f = ~held
            ll, *sums = sufficient_statistics(m, x[f], v[f], seen[f], weight[f])
            other = float(log_prob(m, x[held], v[held], seen[held]) @ weight[held]) if held.any() else 0.0
            total += np.concatenate([[f.sum(), weight[f].sum(), ll, held.sum(), weight[held].sum(), other], *[a.ravel() for a in sums]])
        yield _batch(TaskContext.get().partitionId(), total)

    return run


def maximised(m: Mixture, s: np.ndarray, floor: float) -> Mixture:
    """The M step: weights, means and covariances from the sums (q, q b, q (B + b b')) laid end to end; components without mass keep their mean."""
    k, d = m.means.shape
    q0, q1, q2 = s[:k], s[k : k + k * d].reshape(k, d), s[k + k * d :].reshape(k, d, d)
    safe = np.maximum(q0, 1e-12)
    shift = q1 / safe[:, None]
    covs = q2 / safe[:, None, None] - shift[:, :, None] * shift[:, None, :] + floor * np.eye(d)
    alive = q0 > 1e-9
    return Mixture(q0 / q0.sum(), np.where(alive[:, None], m.means + shift, m.means), np.where(alive[:, None, None], (covs + covs.swapaxes(1, 2)) / 2, m.covs))


@dataclass
class Fit:
    """A fit as far as it came. ``history`` and ``held`` are mean log densities before each step; ``best`` is the round whose model is ``model``."""

    model: Mixture
    history: list[float] = field(default_factory=list)
    held: list[float] = field(default_factory=list)
    best: int = 0
    rows: int = -1
    done: bool = False
    #: the model of the last step, from which a fit goes on
    last: Mixture | None = None


STATE = "identity string, history array<double>, held array<double>, best int, rows long, done boolean, model array<double>, last array<double>"


def _flat(m: Mixture) -> list[float]:
    return np.concatenate([m.weights, m.means.ravel(), m.covs.ravel()]).tolist()


def _shaped(s, k: int, d: int) -> Mixture:
    s = np.asarray(s, float)
    return Mixture(s[:k], s[k : k + k * d].reshape(k, d), s[k + k * d :].reshape(k, d, d))


def _load(spark, folder: str, identity: str, start: Mixture) -> Fit | None:
    """The last whole round in ``folder``; refused if it belongs to another fit."""
    from lumenframe.sources.store import exists

    n = 0
    while exists(spark, f"{folder}/round-{n + 1:05d}/_SUCCESS"):
        n += 1
    if not n:
        return None
    r = spark.read.schema(STATE).parquet(f"{folder}/round-{n:05d}").first()
    if r["identity"] != identity:
        raise ValueError(f"{folder} holds the state of another fit")
    k, d = start.means.shape
    return Fit(_shaped(r["model"], k, d), list(r["history"]), list(r["held"]), r["best"], r["rows"], r["done"], _shaped(r["last"], k, d))


def _save(spark, folder: str, identity: str, fit: Fit) -> None:
    row = (identity, fit.history, fit.held, fit.best, fit.rows, fit.done, _flat(fit.model), _flat(fit.last))
    spark.createDataFrame([row], STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/round-{len(fit.history):05d}")


def fit_rounds(
    df: DataFrame, start: Mixture, iterations: int = 30, tolerance: float = 1e-5, floor: float = 1e-6, x: str = "x", var: str = "var", weight: Column | None = None,
    held_out: Column | None = None, patience: int = 3, state: str | None = None, largest_fall: float | None = None,
) -> Fit:
    """Extreme deconvolution by EM.

    Sums of a pass are added in a tree, so that the driver gets at most ``FAN`` vectors however many partitions there are.
    Rows where ``held_out`` holds are only scored: the fit stops when their mean log density has not risen by ``tolerance`` for
    ``patience`` rounds, and its model is the best round's. ``state`` is a folder of the shared store: each round is written there, and a
    call that finds rounds of the same fit goes on from the last, after counting that the rows are as many. Over the same
    partitioning it ends bit by bit where an unbroken fit does. A fall of the mean log density by more than ``largest_fall`` is an error.
    """
    spark = df.sparkSession
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = df.select(F.col(x).alias("x"), F.col(var).alias("v"), (F.lit(1.0) if weight is None else weight).alias("w"), held.alias("held")).persist()
    identity = hashlib.sha256(repr((_flat(start), tolerance, floor, patience, held_out is None)).encode()).hexdigest()
    k, d = start.means.shape
    fit = (_load(spark, state, identity, start) if state else None) or Fit(start, last=start)
    try:
        parts = rows.rdd.getNumPartitions()
        while not fit.done and len(fit.history) < iterations:
            m = fit.last
            got = tree_sum(rows.mapInArrow(_statistics(m), "part long, s binary"), [], parts, FAN).collect()
            s = sum((np.frombuffer(r["s"]) for r in sorted(got, key=lambda r: r["part"])), np.zeros(6 + k * (1 + d + d * d)))
            n = int(s[0] + s[3])
            if fit.rows >= 0 and n != fit.rows:
                raise RuntimeError(f"a pass saw {n} rows, not {fit.rows}")
            if s[1] <= 0 or (held_out is not None and s[4] <= 0):
                raise ValueError("no row has weight")
            fit.rows = n
            fit.history.append(float(s[2] / s[1]))
            change = fit.history[-1] - fit.history[-2] if len(fit.history) > 1 else np.inf
            if largest_fall is not None and -change > largest_fall:
                raise RuntimeError(f"the log density fell by {-change}")
            fit.last = maximised(m, s[6:], floor)
            fit.done = len(fit.history) > 1 and abs(change) < tolerance * max(1.0, abs(fit.history[-2]))
            if held_out is None:
                fit.model, fit.best = fit.last, len(fit.history)
            else:
                fit.held.append(float(s[5] / s[4]))
                at = len(fit.held) - 1
                if at == 0 or fit.held[at] > fit.held[fit.best] + tolerance * max(1.0, abs(fit.held[fit.best])):
                    fit.model, fit.best = m, at
                fit.done = at - fit.best >= patience
            if state:
                _save(spark, state, identity, fit)
    finally:
        rows.unpersist()
    return fit


def fit_mixture(df: DataFrame, start: Mixture, iterations: int = 30, tolerance: float = 1e-5, floor: float = 1e-6, x: str = "x", var: str = "var", weight: Column | None = None) -> tuple[Mixture, list[float]]:
    """The model and the mean log density of each pass; every pass must see the same number of rows."""
    fit = fit_rounds(df, start, iterations, tolerance, floor, x, var, weight)
    return fit.model, fit.history


def audit(history: list[float], tolerance: float = 1e-5) -> dict:
    """How a fit went: rounds, the largest fall and where, the last relative change, and whether that is within ``tolerance``."""
    steps = np.diff(history)
    last = abs(steps[-1]) / max(1.0, abs(history[-2])) if len(steps) else np.inf
    fall = float(-steps.min()) if len(steps) and steps.min() < 0 else 0.0
    return {"rounds": len(history), "falls": int((steps < 0).sum()), "largest_fall": fall, "fell_at": int(steps.argmin()) + 1 if fall else None, "last_change": float(last), "converged": bool(last < tolerance)}


def mixing_fraction(df: DataFrame, log_a: str, log_b: str, iterations: int = 25, start: float = 0.1) -> float:
    """The share of the second density, by EM; one number per pass reaches the driver."""
    eta = start
    ratio = df.select((F.col(log_b) - F.col(log_a)).alias("d")).persist()
    try:
        for _ in range(iterations):
            p = F.lit(1.0) / (F.lit(1.0) + F.lit((1 - eta) / eta) * F.exp(-F.col("d")))
            got = ratio.agg(F.avg(p)).first()[0]
            if got is None:
                return start
            eta = min(max(got, 1e-9), 1 - 1e-9)
    finally:
        ratio.unpersist()
    return eta


def component_weights(lp: DataFrame, by: list[str], iterations: int = 5) -> DataFrame:
    """Weights of fixed component densities (``by``, row, k, lp), all groups at once; each round's weights are a checkpoint, so the plan does not grow."""
    keep = [*by, "row", "k", "lp"]
    comps = lp.select(*by, "k").distinct()
    sizes = comps.groupBy(*by).agg(F.count("*").alias("nk")) if by else comps.agg(F.count("*").alias("nk"))
    w = (comps.join(sizes, by) if by else comps.crossJoin(F.broadcast(sizes))).withColumn("w", F.lit(1.0) / F.col("nk")).drop("nk")
    base = lp.select(*keep)
    top = base.groupBy(*by, "row").agg(F.max("lp").alias("top"))
    each = F.collect_list(F.struct("k", F.exp(F.col("lp") - F.col("top")).alias("e")))
    # one row for each row of the data, dealt out once
    rows = base.join(top, [*by, "row"]).groupBy(*by, "row").agg(each.alias("each")).checkpoint()
    for _ in range(iterations):
        model = w.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("w")) if by else w.agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("w"))
        joined = rows.join(model, by) if by else rows.crossJoin(F.broadcast(model))  # without groups: one row
        ew = F.transform("each", lambda s: F.struct(s["k"].alias("k"), (s["e"] * F.element_at("w", s["k"])).alias("v")))
        q = joined.select(*by, let(lambda p: F.transform(p["ew"], lambda s: F.struct(s["k"].alias("k"), (s["v"] / p["z"]).alias("q"))), ew=ew, z=F.aggregate(ew, F.lit(0.0), lambda a, s: a + s["v"])).alias("q"))
        w = q.select(*by, F.inline("q")).groupBy(*by, "k").agg(F.avg("q").alias("w")).checkpoint()
    return w


def choose_components(df: DataFrame, starts: dict[int, Mixture], fold: Column, folds: int = 3, **kwargs) -> dict[int, float]:
    """Mean held-out log density of each number of components over the folds."""
    from .mixture import mixture_columns

    out = {}
    tagged = df.withColumn("fold", fold)
    for k, start in starts.items():
        scores = []
        for f in range(folds):
            m, _ = fit_mixture(tagged.filter(F.col("fold") != f), start, **kwargs)
            scores.append(mixture_columns(tagged.filter(F.col("fold") == f), {"lp": m}).agg(F.avg("lp")).first()[0])
        out[k] = float(np.mean([s for s in scores if s is not None]))
    return out


#: Bytes of models that may travel to every task; beyond, they are joined.
MODELS_BYTES = 32 << 20
BLOCK = "part long, n long, x array<array<double>>, v array<array<double>>, w array<double>"


def group_blocks(df: DataFrame, by: list[str], x: str = "x", var: str = "var", weight: Column | None = None, rows: int = 4096) -> DataFrame:
    """The rows of each group in blocks of about ``rows``, so that a group may be any size: ``by``, part (a hash), n, x, v, w; a checkpoint.

    Rows with a null in ``by`` are left out.
    """
    some = df.select(*by, F.col(x).alias("x"), F.col(var).alias("v"), (F.lit(1.0) if weight is None else weight).cast("double").alias("w")).dropna(subset=by)
    sizes = some.groupBy(*by).agg(F.ceil(F.count("*") / rows).alias("blocks"))
    spread = some.join(sizes, by).withColumn("at", F.floor(F.rand(7) * F.col("blocks")))
    packed = spread.groupBy(*by, "at").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("x", "v", "w"))).alias("r"))
    return packed.select(*by, F.xxhash64(*by, "at").alias("part"), "n", F.col("r.x").alias("x"), F.col("r.v").alias("v"), F.col("r.w").alias("w")).checkpoint()


def _group_sums(keys: int, k: int, d: int, names: list[str]):
    """The sums of a block under its group's model: by, part, s (rows, weight, log density, then as ``maximised`` takes them)."""

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                m = _shaped(np.frombuffer(batch.column(keys + 5)[i].as_py()), k, d)
                x, v = (matrix(batch.column(keys + c)[i].values, d) for c in (2, 3))
                w = batch.column(keys + 4)[i].values.to_numpy(zero_copy_only=False)
                seen = np.isfinite(x) & np.isfinite(v) & (v >= 0)
                ll, *sums = sufficient_statistics(m, np.where(seen, x, 0), np.where(seen, v, 0), seen, w)
                out.append(np.concatenate([[len(x), w.sum(), ll], *[a.ravel() for a in sums]]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:keys], batch.column(keys), pa.array(out, pa.binary())], names=[*names, "part", "s"])

    return run


def _group_step(keys: int, k: int, d: int, floor: float, tolerance: float, names: list[str]):
    """The next model of a group from its present one and its sums."""

    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(5)]
            for i in range(batch.num_rows):
                n, rounds, before, _, model, s = (batch.column(keys + c)[i].as_py() for c in range(6))
                s = np.frombuffer(s)
                now = s[2] / s[1] if s[1] > 0 else np.nan
                m = _shaped(np.frombuffer(model), k, d)
                m = maximised(m, s[3:], floor) if s[1] > 0 else m
                done = not s[1] > 0 or (before is not None and abs(now - before) < tolerance * max(1.0, abs(before)))
                for c, value in zip(cols, (n, rounds + 1, now, done, np.asarray(_flat(m)).tobytes())):
                    c.append(value)
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keys], *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=[*names, "n", "rounds", "ll", "done", "model"])

    return run


def _with_models(rows: DataFrame, models: DataFrame, by: list[str], groups: int, size: int) -> DataFrame:
    """Rows with their group's model: sent to all tasks where all models are small together, else joined (skewed groups are split by the session)."""
    return rows.join(F.broadcast(models) if groups * size <= MODELS_BYTES else models, by)


def _fit_level(blocks: DataFrame, by: list[str], first: DataFrame, start: Mixture, least: int, iterations: int, tolerance: float, floor: float) -> DataFrame:
    """(by, n, rounds, ll, done, model) of the groups of one level from ``first`` (by, n, model), all groups in one job a round."""
    k, d = start.means.shape
    size = 8 * k * (1 + d + d * d)
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in first.schema.fields if f.name in by)
    models = first.select(*by, "n", F.lit(0).alias("rounds"), F.lit(None).cast("double").alias("ll"), (F.col("n") < least).alias("done"), "model").checkpoint()
    at = models.agg(F.count("*").alias("groups"), F.max("n").alias("n")).first()
    # blocks of the largest group: a group of this level may consist of many groups of the blocks
    most = blocks.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    for _ in range(iterations):
        todo = models.filter(~F.col("done"))
        met = _with_models(blocks, todo.select(*by, "model"), by, at["groups"], size).select(*by, "part", "n", "x", "v", "w", "model")
        sums = tree_sum(met.mapInArrow(_group_sums(len(by), k, d, by), types + "part long, s binary"), by, most)
        new = todo.join(sums.select(*by, "s"), by).mapInArrow(_group_step(len(by), k, d, floor, tolerance, by), types + "n long, rounds int, ll double, done boolean, model binary")
        models = models.filter("done").unionByName(new).checkpoint()
        if not models.filter(~F.col("done")).take(1):
            break
    return models


def fit_groups(
    df: DataFrame, by: list[str], start: Mixture, least: int, iterations: int = 20, tolerance: float = 1e-6, floor: float = 1e-6, parents: list[list[str]] | None = None, x: str = "x", var: str = "var",
    weight: Column | None = None, rows: int = 4096,
) -> DataFrame:
    """A mixture for each group: by, n, source (own, parent or start), rounds, log_density, k, weight, mean, cov (row-major).

    A group starts from its parent's model (``parents`` lists coarser and coarser subsets of ``by``, the coarsest first;
    the coarsest starts from ``start``), and keeps it if it has fewer than ``least`` rows. Sums are keyed by group and taken over blocks of
    rows, so a group may be larger than a task, and all groups of a level take their step in one job. Groups that have converged rest.
    Rows with a null in ``by`` are left out.
    """
    k, d = start.means.shape
    blocks = group_blocks(df, by, x, var, weight, rows)
    above, model = None, None
    for level in [*(parents or []), by]:
        sizes = blocks.groupBy(*level).agg(F.sum("n").alias("n"))
        if model is None:
            first = sizes.withColumn("model", F.lit(bytearray(np.asarray(_flat(start)).tobytes())))
        else:
            first = sizes.join(model.select(*above, "model"), above)
        model = _fit_level(blocks, level, first, start, least, iterations, tolerance, floor)
        above = level
    source = F.when(F.col("n") >= least, "own").when(F.lit(bool(parents)), "parent").otherwise("start")
    told = model.select(*by, "n", source.alias("source"), "rounds", F.col("ll").alias("log_density"), "model")
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in told.schema.fields if f.name in by)
    return told.mapInArrow(_opened(len(by), k, d, by), types + "n long, source string, rounds int, log_density double, k int, weight double, mean array<double>, cov array<double>")


def _opened(keys: int, k: int, d: int, names: list[str]):
    """A row for each component of each model."""

    def run(batches):
        for batch in batches:
            i = pa.array(np.repeat(np.arange(batch.num_rows), k))
            models = [_shaped(np.frombuffer(b), k, d) for b in batch.column(keys + 4).to_pylist()]
            each = [(j, m.weights[j], m.means[j].tolist(), m.covs[j].ravel().tolist()) for m in models for j in range(k)]
            kinds = [pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            new = [pa.array([e[c] for e in each], t) for c, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[c.take(i) for c in batch.columns[: keys + 4]], *new], names=[*names, "n", "source", "rounds", "log_density", "k", "weight", "mean", "cov"])

    return run


def pooled_models(models: DataFrame, by: list[str], areas: DataFrame, into: list[str] | None = None) -> DataFrame:
    """The models of many fields (rows of ``fit_groups``) as one for each value of ``into`` (all, if none): (into, by, k, weight, mean, cov, density).

    A component's weight is its own times its field's share of all rows; the density is rows over ``areas`` (by, area).
    """
    into = into or []
    fields = models.filter("k = 0").select(*by, "n").join(areas, by)
    total = fields.groupBy(*into).agg(F.sum("n").alias("all_"), F.sum("area").alias("area_"))  # one row for each value of ``into``
    joined = models.join(areas.select(*by), by, "left_semi")
    joined = joined.join(total, into) if into else joined.crossJoin(F.broadcast(total))  # one row
    return joined.select(*dict.fromkeys([*into, *by]), "k", (F.col("weight") * F.col("n") / F.col("all_")).alias("weight"), "mean", "cov", (F.col("all_") / F.col("area_")).alias("density"))
