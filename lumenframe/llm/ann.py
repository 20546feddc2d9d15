"""Approximate nearest neighbours (largest inner product) by additive quantisation.

Training (driver, on a bounded sample of ``train_rows`` vectors, chosen by hash
of the id): ``books`` codebooks of ``words`` full-dimensional code vectors, each
fitted by k-means to the residuals that the books before it leave. Directions
(vectors of length one) are trained and encoded, so that long vectors take no
more words than short ones; a wider vector has more books.

Encoding: a direction is a sum of one word from each book. Beam search keeps the
``beam`` best partial sums after every book, by the length of what they leave.
Each code (a byte for each book) is stored with the norm of its sum and that of
its vector.

Search: codes are packed in blocks of about ``block`` rows, queries in blocks of
``query_block``; every block of queries meets every block of codes, never of
vectors. Lookup tables (inner products of a query with all words) score each
code; the norm of the sum widens its score by the part of the vector that the
code misses, along the mean direction of that error, so that short sums are not
favoured. A task keeps the ``shortlist`` best of the blocks that it has seen, a
window those of all tasks, so that the shortlist is the same however blocks are
cut. Then the shortlist meets its vectors by a join on ids and is reranked
exactly, in double precision.

How long a shortlist must be depends on the rows. It is measured: for a bounded
sample of queries the truly nearest are found by comparison with every row, and
their places among all scored codes counted; the length that holds ``recall`` of
them, and a quarter more, is used where it is above ``shortlist``. The lookups
grow with queries times rows.

Ties go to the smaller id, in shortlists too: equal vectors have equal codes.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, as queries or candidates, nor do rows with a null id;
neither do vectors whose length is not the commonest (the longer one of equally
common lengths); rows that agree in id and vector are one; rows that share an id
only are separate candidates and queries, but no query finds its own id; with
fewer than ``top`` candidates, all are returned; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship

ship(__name__)

FAN = 16


class Codebooks:
    def __init__(self, words: np.ndarray):
        """``words``: (books, words, dimensions)."""
        self.books, self.count, self.dim = words.shape
        self.flat = np.ascontiguousarray(words.reshape(-1, self.dim), np.float32)

    def encode(self, x: np.ndarray, beam: int = 4, step: int = 2048) -> np.ndarray:
        """Codes (n, books), numbers of words in ``flat``, by beam search."""
        k = self.count
        norm = (self.flat**2).sum(1)
        out = np.empty((len(x), self.books), np.int32)
        for a in range(0, len(x), step):
            rest = np.asarray(x[a : a + step], np.float32)[:, None, :]
            m = len(rest)
            cost, codes = np.zeros((m, 1), np.float32), np.zeros((m, 1, 0), np.int32)
            for b in range(self.books):
                words = self.flat[b * k : (b + 1) * k]
                new = (cost[:, :, None] + norm[b * k : (b + 1) * k] - 2 * (rest.reshape(-1, self.dim) @ words.T).reshape(m, -1, k)).reshape(m, -1)
                keep = min(beam, new.shape[1])
                best = np.argpartition(new, keep - 1, 1)[:, :keep] if keep < new.shape[1] else np.tile(np.arange(keep), (m, 1))
                cost = np.take_along_axis(new, best, 1)
                rest = np.take_along_axis(rest, (best // k)[:, :, None], 1) - words[best % k]
                codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], 1), (best % k + b * k)[:, :, None].astype(np.int32)], 2)
            out[a : a + step] = np.take_along_axis(codes, cost.argmin(1)[:, None, None], 1)[:, 0]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.flat[codes].sum(1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    if len(centres) < k:
        centres = np.concatenate([centres, np.zeros((k - len(centres), x.shape[1]), x.dtype)])
    for _ in range(rounds):
        at = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        n = np.bincount(at, minlength=k)
        for d in range(x.shape[1]):
            centres[:, d] = np.where(n > 0, np.bincount(at, x[:, d], k) / np.maximum(n, 1), centres[:, d])
    return centres


def train(x: np.ndarray, books: int = 40, words: int = 64, seed: int = 7) -> Codebooks:
    """Each book by k-means on what the books before it leave. (Least-squares refits of all books on beam-search codes left more error on unseen rows.)"""
    rng = np.random.default_rng(seed)
    rest, found = np.asarray(x, np.float32), []
    for _ in range(books):
        c = _kmeans(rest, words, rng)
        found.append(c)
        rest = rest - c[((c**2).sum(1) - 2 * rest @ c.T).argmin(1)]
    return Codebooks(np.stack(found))


def _valid(col):
    sane = F.forall(col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return col.isNotNull() & F.coalesce(sane & F.exists(col, lambda v: v != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and the lengths; no square overflows."""
    x = np.asarray(x, np.float64)
    most = np.abs(x).max(1, keepdims=True)
    x = x / most
    own = np.sqrt((x * x).sum(1))
    return x / own[:, None], own * most[:, 0]


def _first(score: np.ndarray, n: int) -> np.ndarray:
    """The places of the n largest, ties to the earlier place, in no order."""
    if len(score) <= n:
        return np.arange(len(score))
    edge = np.partition(score, len(score) - n)[len(score) - n]
    above = np.flatnonzero(score > edge)
    return np.concatenate([above, np.flatnonzero(score == edge)[: n - len(above)]])


def _codes(book: Codebooks, beam: int):
    """One row of packed arrays, ordered by id, of a partition: ids, their vectors' hashes, codes, factors of the scores."""
    kind = np.uint8 if book.count <= 256 else np.uint16

    def run(batches):
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        ids, hashes = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        x = np.concatenate([_matrix(b.column(2)) for b in held]).astype(np.float64)
        order = np.lexsort((hashes, ids))
        x, own = _directions(x[order])
        code = book.encode(x, beam)
        gain = (own * np.minimum(1 / np.maximum(np.sqrt((book.decode(code).astype(np.float64) ** 2).sum(1)), 1e-9), 2.0)).astype(np.float32)
        local = (code - np.arange(book.books) * book.count).astype(kind)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), *(pa.array([v[order].tobytes()], pa.binary()) for v in (ids, hashes)), pa.array([local.tobytes()], pa.binary()), pa.array([gain.tobytes()], pa.binary())], names=["blk", "ids", "hashes", "data", "gain"])

    return run


def _packed(batches):
    """One row of packed arrays of a partition of queries: ids, their vectors' hashes, vectors."""
    from pyspark import TaskContext

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    ids, hashes = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
    x = np.concatenate([_matrix(b.column(2)) for b in held]).astype(np.float32)
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in (ids, hashes, x))], names=["blk", "ids", "hashes", "data"])


class _Block:
    """A block of queries and the best candidates it has met."""

    def __init__(self, book: Codebooks, ids: bytes, hashes: bytes, data: bytes):
        self.book, self.ids, self.hashes = book, np.frombuffer(ids, np.int64), np.frombuffer(hashes, np.int64)
        self.tables = (np.frombuffer(data, np.float32).reshape(len(self.ids), -1) @ book.flat.T).reshape(len(self.ids), book.books, book.count)
        if book.books % 2:
            self.tables = np.concatenate([self.tables, np.zeros_like(self.tables[:, :1])], 1)
        self.best: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))] * len(self.ids)

    def scores(self, ids: np.ndarray, codes: bytes, gain: bytes):
        """For each query, the scores of a block of codes; its own id has none."""
        gain = np.frombuffer(gain, np.float32)
        k = self.book.count
        local = np.frombuffer(codes, np.uint8 if k <= 256 else np.uint16).reshape(len(ids), -1).astype(np.intp)
        if self.book.books % 2:
            local = np.concatenate([local, np.zeros((len(ids), 1), np.intp)], 1)
        one, two = np.ascontiguousarray(local[:, 0::2].T), np.ascontiguousarray(local[:, 1::2].T)
        # two books share a table where that costs less than it saves; the sums are the same
        pairs = one * k + two if len(ids) > k * k else None
        for i in range(len(self.ids)):
            t = self.tables[i]
            score = np.zeros(len(ids), np.float32)
            for j in range(len(one)):
                score += t[2 * j].take(one[j]) + t[2 * j + 1].take(two[j]) if pairs is None else (t[2 * j, :, None] + t[2 * j + 1]).ravel().take(pairs[j])
            score *= gain
            score[ids == self.ids[i]] = -np.inf
            yield i, score

    def meet(self, ids: bytes, hashes: bytes, codes: bytes, gain: bytes, shortlist: int) -> None:
        ids, hashes = np.frombuffer(ids, np.int64), np.frombuffer(hashes, np.int64)
        for i, score in self.scores(ids, codes, gain):
            near = _first(score, shortlist)
            near = near[score[near] > -np.inf]
            a, b, c = (np.concatenate(x) for x in zip(self.best[i], (ids[near], hashes[near], score[near])))
            if len(a) > shortlist:
                order = np.lexsort((b, a, -c))[:shortlist]
                a, b, c = a[order], b[order], c[order]
            self.best[i] = a, b, c

    def rows(self):
        names = ["query_id", "query_hash", "vec_id", "vec_hash", "near"]
        for s in range(0, len(self.ids), 256):
            best = self.best[s : s + 256]
            n = [len(b[0]) for b in best]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(v[s : s + 256], n)) for v in (self.ids, self.hashes)] + [pa.array(np.concatenate(x)) for x in zip(*best)], names=names)


SHORT = "query_id long, query_hash long, vec_id long, vec_hash long, near float"


def _search(book: Codebooks, shortlist: int):
    """Rows in order of (block of queries, lane): the block of queries, then the blocks of codes that it meets."""

    def run(batches):
        block = None
        for batch in batches:
            for i in range(batch.num_rows):
                ids, hashes, data, gain = (batch.column(c)[i].as_py() for c in range(4))
                if gain is None:
                    if block is not None:
                        yield from block.rows()
                    block = _Block(book, ids, hashes, data)
                elif block is not None:
                    block.meet(ids, hashes, data, gain, shortlist)
        if block is not None:
            yield from block.rows()

    return run


def _exact(queries: np.ndarray, ids: np.ndarray, top: int):
    """The ``top`` nearest of a partition for each of a few queries, by comparison with every row: query, id, hash, score, vector."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, x = batch.column(0).to_numpy(), _matrix(batch.column(2)).astype(np.float64)
            score = np.where(own[None] == ids[:, None], -np.inf, queries @ x.T)
            at = [(i, j) for i in range(len(ids)) for j in _first(score[i], top) if score[i, j] > -np.inf]
            q, r = (np.array(v, np.int64) for v in zip(*at)) if at else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(own[r]), pa.array(batch.column(1).to_numpy()[r]), pa.array(score[q, r]), pa.array(list(x[r]), pa.list_(pa.float64()))], names=["q", "id", "h", "score", "v"])

    return run


def _places(book: Codebooks, queries: bytes, ids: np.ndarray, edges: list[np.ndarray]):
    """How many codes of a partition have a larger score than each in ``edges``, query by query: one packed row of a partition."""

    def run(batches):
        block = _Block(book, ids.tobytes(), ids.tobytes(), queries)
        above = [np.zeros(len(e), np.int64) for e in edges]
        for batch in batches:
            for i in range(batch.num_rows):
                own, codes, gain = (batch.column(c)[i].as_py() for c in range(3))
                for q, score in block.scores(np.frombuffer(own, np.int64), codes, gain):
                    above[q] += len(score) - np.searchsorted(np.sort(score), edges[q], "right")
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(above).tobytes()], pa.binary())], names=["above"])

    return run


def _added(batches):
    """One row of a partition: the sum of its packed counts."""
    total = None
    for batch in batches:
        for x in batch.column(0).to_pylist():
            x = np.frombuffer(x, np.int64)
            total = x if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["above"])


def _long_enough(book: Codebooks, rows: DataFrame, coded: DataFrame, asked: DataFrame, top: int, recall: float, sample: int, beam: int) -> int:
    """The length of shortlist that holds ``recall`` of the truly nearest rows of at most ``sample`` queries, and a quarter more."""
    some = asked.orderBy(F.xxhash64("h", "id"), "id").limit(sample).toArrow()
    if not some.num_rows:
        return 0
    ids, x = some.column("id").to_numpy(), _matrix(some.column("v")).astype(np.float64)
    near = rows.select("id", "h", "v").mapInArrow(_exact(x, ids, top), "q long, id long, h long, score double, v array<double>")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id", "h"))
    # at most ``top`` rows for each of the sample
    truth = near.withColumn("place", place).filter(F.col("place") <= top).select("q", "v").toArrow()
    if not truth.num_rows:
        return 0
    q, (v, own) = truth.column("q").to_numpy(), _directions(_matrix(truth.column("v")))
    sums = book.decode(book.encode(v, beam)).astype(np.float64)
    score = (sums * x[q]).sum(1) * own * np.minimum(1 / np.maximum(np.sqrt((sums**2).sum(1)), 1e-9), 2.0)
    edges = [score[q == i] for i in range(len(ids))]
    counted = coded.select("ids", "data", "gain").mapInArrow(_places(book, x.astype(np.float32).tobytes(), ids, edges), "above binary")
    # one small row of each task, added in at most ``FAN`` tasks before the driver gets them
    above = sum(np.frombuffer(r["above"], np.int64) for r in counted.repartition(FAN).mapInArrow(_added, "above binary").collect())
    return math.ceil(1.25 * (float(np.quantile(above, recall, method="higher")) + 1))


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 20, shortlist: int = 192, block: int = 16384, query_block: int = 2048, lane: int = 16, train_rows: int = 4096, books: int | None = None, words: int = 64, beam: int = 4, recall: float = 0.98, sample: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): ``is_query`` is a condition on the column ``id``.

    ``books``: five for eight dimensions unless given, at least 40. ``shortlist`` is the least length; ``sample`` 0 leaves it as it is.
    """
    spark = vectors.sparkSession
    vector = F.col(f"`{vector_col}`")
    if vectors.schema[vector_col].dataType.simpleString() != "array<float>":
        vector = vector.cast("array<double>")
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("v")).filter("id is not null").filter(_valid(F.col("v")))
    rows = materialise(v.withColumn("h", F.xxhash64("v")).select("id", "h", "v").dropDuplicates(["id", "h"]), "vectors")
    lengths = rows.groupBy(F.size("v").alias("d")).count()
    common = lengths.agg(F.max(F.struct("count", "d")).alias("m")).first()["m"]
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == common["d"])
    cores = spark.sparkContext.defaultParallelism
    parts = lambda n, size, least: max(1, math.ceil(n / size), min(cores, math.ceil(n / least)))
    # train on a sample whose size is a parameter
    known = _directions(_matrix(rows.orderBy(F.xxhash64("id", "h"), "id").limit(train_rows).toArrow().column("v")))[0]
    book = train(known, books or max(40, math.ceil(common["d"] * 5 / 8)), words)
    # a partition is a block, and its number the block's
    cut = parts(common["count"], block, 1024)
    coded = rows.repartition(cut, "id", "h").mapInArrow(_codes(book, beam), "blk long, ids binary, hashes binary, data binary, gain binary")
    coded = materialise(coded, "codes")
    asked = rows.filter(is_query)
    if sample:
        shortlist = max(shortlist, _long_enough(book, rows, coded, asked, top, recall, sample, beam))
        query_block = max(64, min(query_block, query_block * 768 // shortlist))
    asked_cut = parts(asked.count(), query_block, query_block)
    asked_blocks = materialise(asked.repartition(asked_cut, "id", "h").mapInArrow(_packed, "blk long, ids binary, hashes binary, data binary"), "queries")
    query_blocks = (asked_blocks.agg(F.max("blk")).first()[0] or 0) + 1
    # a query keeps a shortlist in each lane: lanes follow the rows, however finely the blocks are cut
    lanes = min(cut, max(math.ceil(cut / lane), math.ceil(2 * cores / asked_cut)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    ask = asked_blocks.select(F.col("blk").alias("q"), every(lanes).alias("lane"), F.lit(-1).cast("long").alias("blk"), "ids", "hashes", "data", F.lit(None).cast("binary").alias("gain"))
    met = coded.select(every(query_blocks).alias("q"), (F.col("blk") % lanes).alias("lane"), "blk", "ids", "hashes", "data", "gain")
    dealt = ask.unionByName(met).repartition(query_blocks * lanes, "q", "lane").sortWithinPartitions("q", "lane", "blk").select("ids", "hashes", "data", "gain")
    found = materialise(dealt.mapInArrow(_search(book, shortlist), SHORT), "near")
    by_query = Window.partitionBy("query_id", "query_hash")
    short = found.withColumn("place", F.row_number().over(by_query.orderBy(F.desc("near"), "vec_id", "vec_hash"))).filter(F.col("place") <= shortlist).drop("place", "near")
    pairs = short.join(rows.select(F.col("id").alias("vec_id"), F.col("h").alias("vec_hash"), F.col("v").alias("c")), ["vec_id", "vec_hash"])
    pairs = pairs.join(asked.select(F.col("id").alias("query_id"), F.col("h").alias("query_hash"), F.col("v").alias("q")), ["query_id", "query_hash"])
    score = F.aggregate(F.zip_with("c", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
    ranked = pairs.select("query_id", "query_hash", "vec_id", "vec_hash", score.alias("score")).withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id", "vec_hash")))
    return ranked.filter(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
