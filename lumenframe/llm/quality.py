"""Quality classifier: Bradley-Terry pairwise ranking.

Every text gets features of its form (shares of byte classes, of shouting,
marks and separators, repetition, lengths). A document's strength is linear in
them; the chance that one document is preferred to another is the logistic
function of the difference of their strengths, so weights are learned by
logistic loss on feature differences of preference pairs (a document labelled 1
over one labelled 0).

The threshold is a quantile of the training strengths: the share of documents
labelled 0 among them. Strengths are mapped to 0..1 by a logistic curve that
sends this quantile to ``at`` (0.7), so ``score >= 0.7`` keeps what ranks above it.

Fitting uses at most ``sample`` labelled rows (those with the smallest hash of
their id) and ``pairs`` preference pairs; both are parameters. Scoring reads
every whole text once, in Arrow batches.

Defined cases: null and empty texts have the features of an empty text and get
its score; null labels and null ids are not used to fit, though every row is
scored; several labels of an id, and several texts, are all used, within
``sample``; with labels of one kind only, all scores are 1 or 0 alike, and
without labels 1; ties are scored alike; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, narrow, released, ship

ship(__name__)

MARKS = b"*$&%#!|?.,;:-_/\\@()[]{}<>=+~^`\"'"


def packed_size(text: bytes, step: int = 1 << 16) -> int:
    """Bytes of the whole text under zlib, fed in pieces whose output is only counted."""
    z, view = zlib.compressobj(1), memoryview(text)
    return sum(len(z.compress(view[i : i + step])) for i in range(0, len(text), step)) + len(z.flush())


def features(text: bytes) -> np.ndarray:
    """Features of a whole text, each within a small range."""
    n = len(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if n else np.zeros(256)
    words = text.split()
    w = max(1, len(words))
    lines = text.split(b"\n")
    size = max(1, n)
    upper, lower, digit = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    high = count[128:].sum()
    letters = max(1, upper + lower + high)
    distinct = len(set(words))
    packed = packed_size(text) / size
    longest = sum(map(len, words)) / w
    ends = sum(1 for x in words if x[-1:] in b".,")
    odd = sum(1 for x in words if not x[-1:].isalpha() and x[-1:] not in b".,;:!?\"')" and x[-1] < 128)
    share = [count[m] / w for m in MARKS]
    plain = [upper / letters, digit / size, high / letters, count[10] / size, letters / size, ends / w, odd / w, min(packed, 1.5), distinct / w, len(set(lines)) / len(lines), longest / 20.0]
    x = [*np.minimum(plain, 2.0), *np.sqrt(np.minimum(share, 4.0)), np.log1p(n) / 10, np.log1p(w) / 10]
    flags = [upper / letters > 0.3, odd / w > 0.15, count[ord("!")] / w > 0.2, count[ord("|")] / w > 0.2, w < 12, w < 5, distinct / w < 0.3, packed < 0.25, n == 0, len(lines) > 1]
    return np.array([*x, *map(float, flags)])


def _features(batches):
    for batch in narrow(batches):
        x = [features((t or "").encode("utf-8", "replace")).tolist() for t in batch.column(batch.num_columns - 1).to_pylist()]
        names = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))], names=[*names, "x"])


class Ranker:
    """Strength ``w . (x - mean) / scale``; score ``1 / (1 + exp(-(strength - cut) * slope) * (1 - at) / at)``."""

    def __init__(self, mean, scale, w, cut, at):
        self.mean, self.scale, self.w, self.cut, self.at = mean, scale, w, cut, at

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.strength(x) - self.cut, -60, 60) + np.log(self.at / (1 - self.at))
        return 1.0 / (1.0 + np.exp(-z))


def fit(x: np.ndarray, label: np.ndarray, at: float = 0.7, pairs: int = 60_000, l2: float = 1e-3, rounds: int = 25, seed: int = 2) -> Ranker:
    """Newton steps on the logistic loss of feature differences of random preference pairs."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranker(mean, scale, np.zeros(x.shape[1]), -60.0 if len(good) else 60.0, at)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(np.clip(d @ w, -40, 40)))
        grad = d.T @ p / pairs - l2 * w
        h = (d * (p * (1 - p))[:, None]).T @ d / pairs + (l2 + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(h, grad)
        w = w + step * min(1.0, 3.0 / (np.linalg.norm(step) + 1e-9))
        if np.linalg.norm(step) < 1e-6:
            break
    strength = z @ w
    # the quantile of the documents labelled 0, in the middle of the gap there
    order = np.sort(strength)
    k = len(bad)
    cut = (order[k - 1] + order[min(k, len(order) - 1)]) / 2
    return Ranker(mean, scale, w, float(cut), at)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 12_000, at: float = 0.7) -> Ranker:
    """Fit on the labelled rows whose crc32(id) mod 4 is not 2, at most ``sample`` of them."""
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("y"))
        .filter("id is not null and y in (0, 1)")
        .filter(crc_mod(F.col("id"), 4) != 2)
        .distinct()
        .orderBy(F.xxhash64("id", F.lit(11)), "id", "y")
        .limit(sample)
    )
    # at most ``sample`` rows of 12 bytes
    got = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id").select("id", "y", "text")
    # repeated ids bring more than one text each: still at most ``sample`` rows
    rows = got.mapInArrow(released(_features), "id long, y int, x array<double>").orderBy(F.xxhash64("id", F.lit(11)), "id", "y", "x").limit(sample).toArrow()
    order = np.lexsort((rows.column("y").to_numpy(), rows.column("id").to_numpy()))
    x = np.array(rows.column("x").to_pylist()) if rows.num_rows else np.zeros((0, len(features(b""))))
    if not rows.num_rows:
        x = features(b"")[None]
        return fit(x, np.array([1]), at)
    return fit(x[order], rows.column("y").to_numpy()[order], at)


def _scores(ranker: Ranker):
    def run(batches):
        for batch in narrow(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            x = np.array([features((t or "").encode("utf-8", "replace")) for t in texts]).reshape(len(texts), -1)
            s = ranker.score(x) if len(texts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(released(_scores(ranker)), "id long, score double")


def _keep(ranker: Ranker, at: int, floor: float):
    def run(batches):
        for batch in narrow(batches):
            texts = batch.column(at).to_pylist()
            if not texts:
                yield batch
                continue
            x = np.array([features((t or "").encode("utf-8", "replace")) for t in texts])
            yield batch.filter(pa.array(ranker.score(x) >= floor))

    return run


def keep_good(docs: DataFrame, ranker: Ranker, text_col: str = "text", floor: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score at least ``floor``, with all their columns."""
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return inner.mapInArrow(released(_keep(ranker, docs.columns.index(text_col), floor)), inner.schema).toDF(*docs.columns)
