"""Phrase collocations: merged count-min sketches, exact counts of survivors, scores, subsumption.

First pass: each task counts the n-grams of its texts in a count-min sketch;
sketches are cut into stripes and merged by key. A cell stops counting at
``least``, so it is one byte in the merged sketch. A sketch never says less than
the truth: an n-gram that occurs ``least`` times survives for certain. Second
pass: every task looks its n-grams up, counts the survivors of some megabytes of
text and sends them, packed, to the share of their hash, where packs are summed as they arrive;
false survivors fall at the exact count. The total of words of a language comes
with it. A phrase is in at most one pack of a few megabytes of a task, so none is hot.

Scores are integers, computed as decimals of 38 digits. A candidate's parts are
counted phrases themselves (a part occurs at least as often), so one join with
the counts gives both sides of every cut; parts that many candidates share are
not dealt out. The first ``top`` of a language are found within salted shares of
its candidates, then among the firsts of the shares.

The sketch has one cell for each 32 bytes of text in each of its two rows, up to
``cells`` in all (64 MB): beyond that more n-grams survive the first pass, none
is lost, and results are the same. Texts are taken whole, a few megabytes at a time.

Defined cases: null text is empty; null lang is ``und``, and one with a language
so named; repeated rows count as often as they stand; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_unique, materialise, released, ship
from .shingles import mix

ship(__name__)

ROWS = 2
STRIPE = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 a byte of a word, 1 a blank, 2 a byte between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[[ord(c) for c in ".,;:!?"]] = 2
_KIND[10:14] = 2


def blocks(batch, most: int = 4 << 20):
    """(bytes, offsets, lang) of whole texts, about ``most`` bytes at a time; lang is an Arrow array of strings."""
    text = batch.column(0).cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], batch.column(1).slice(a, b - a)
        a = b


class Words:
    """The words of some texts: ``code`` of each (one per language and word), ``piece`` each stands in, and the distinct ones."""

    def __init__(self, data, offsets, langs):
        data = _LOWER[data]
        kind = _KIND[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        inside = kind == 0
        edge = inside[1:] & (~inside[:-1] | first[1:-1])
        starts = np.concatenate([np.flatnonzero(inside[:1]), np.flatnonzero(edge) + 1])
        breaks = np.flatnonzero((kind == 2) | first[:-1])
        self.piece = np.searchsorted(breaks, starts, "right")
        upto = np.zeros(len(inside) + 1, np.int32 if len(inside) < 1 << 31 else np.int64)
        np.cumsum(inside, out=upto[1:])
        bounds = np.append(upto[starts], upto[-1]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[inside]))).dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        named = langs.dictionary_encode()
        doc = np.searchsorted(offsets, starts, "right") - 1
        lang = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
        self.texts, self.langs = words.dictionary, named.dictionary
        self.many = max(1, len(self.texts))
        self.code = lang * self.many + code
        seed = [xxhash.xxh64_intdigest(x.encode()) for x in self.langs.to_pylist()]
        hashes = np.array([xxhash.xxh64_intdigest(x) for x in self.texts.cast(pa.large_binary()).to_pylist()], np.uint64)
        self.hash = mix(hashes[code] + np.array(seed, np.uint64)[lang]) if len(starts) else np.zeros(0, np.uint64)

    def runs(self, most: int):
        """(n, positions where a run of n words of one piece starts, hash of each run), for n from 1 to ``most``."""
        at, h = np.arange(len(self.code)), self.hash
        yield 1, at, h
        for n in range(2, most + 1):
            ok = at + n - 1 < len(self.code)
            at, h = at[ok], h[ok]
            ok = self.piece[at] == self.piece[at + n - 1]
            at, h = at[ok], h[ok]
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + self.hash[at + n - 1] + np.uint64(n))
            yield n, at, h

    def texts_of(self, at, n: int):
        parts = [self.texts.take(pa.array(self.code[at + j] % self.many)) for j in range(n)]
        return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))

    def langs_of(self, at):
        return self.langs.take(pa.array(self.code[at] // self.many))


def cell(h: np.ndarray, row: int, width: int) -> np.ndarray:
    """Where a hash counts; ``width`` is a power of two."""
    return ((h if row == 0 else mix(h + np.uint64(row))) & np.uint64(width - 1)).astype(np.int64)


def packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def halved(cells: np.ndarray, least: int) -> bytes:
    """Counts up to ``least`` in as few bytes as they take: two to a byte where they are under 16."""
    return packed((cells[::2] | (cells[1::2] << 4) if least < 16 else cells).tobytes())


def restored(data: bytes, least: int) -> np.ndarray:
    cells = np.frombuffer(unpacked(data), np.uint8)
    return np.stack([cells & 15, cells >> 4], 1).ravel() if least < 16 else cells


def _sketch(width: int, least: int, most: int):
    """Stripes of the task's sketch: (stripe, its compressed bytes), no cell over ``least``."""

    def run(batches):
        cells = np.zeros((ROWS, width), np.uint8)
        for batch in batches:
            for block in blocks(batch):
                for _, _, h in Words(*block).runs(most):
                    for row in range(ROWS):
                        at = cell(h, row, width)
                        for a in range(0, len(at), 60_000):
                            some = at[a : a + 60_000]
                            some, more = np.unique(some[cells[row, some] < least], return_counts=True)
                            cells[row, some] = np.minimum(cells[row, some] + more, least)
        flat = cells.reshape(-1)
        for i in range(0, len(flat), STRIPE):
            part = flat[i : i + STRIPE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // STRIPE], pa.int32()), pa.array([halved(part, least)], pa.binary())], names=["stripe", "data"])

    return run


def _merged(least: int):
    """Stripes in order, those of one number merged into one."""

    def row(stripe, cells):
        return pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([halved(cells, least)], pa.binary())], names=["stripe", "data"])

    def run(batches):
        here, cells = None, None
        for batch in batches:
            for stripe, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = restored(data.as_py(), least)
                if stripe == here:
                    cells = np.minimum(cells.astype(np.uint16) + more, least).astype(np.uint8)
                    continue
                if here is not None:
                    yield row(here, cells)
                here, cells = stripe, more
        if here is not None:
            yield row(here, cells)

    return run


STRIPES = "stripe int, data binary"


def sketch(docs: DataFrame, width: int, least: int, most: int) -> np.ndarray:
    """The merged sketch of the n-grams of ``docs`` (text, lang): ROWS x width bytes, each at most ``least``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stripes = docs.mapInArrow(released(_sketch(width, least, most)), STRIPES)
    dealt = stripes.repartition(min(parts, ROWS * width // STRIPE + 1), "stripe").sortWithinPartitions("stripe")
    out = np.zeros(ROWS * width, np.uint8)
    # at most one packed stripe for each STRIPE cells of the sketch, whose size is a parameter
    for i, data in dealt.mapInArrow(released(_merged(least)), STRIPES).collect():
        out[i * STRIPE : (i + 1) * STRIPE] = restored(bytes(data), least)
    return out.reshape(ROWS, width)


PACKS = "share int, lang string, total long, data binary"


def _packs(found: list, shares: int):
    """Rows of PACKS: the (lang, phrase, hash, count) tables ``found``, which is emptied, cut by share and language."""
    got = pa.concat_tables(found)
    found.clear()
    got = got.combine_chunks()
    share = (got["h"].to_numpy() >> np.uint64(40)) % np.uint64(shares)
    named = got["lang"].combine_chunks().dictionary_encode()
    named = named.chunk(0) if isinstance(named, pa.ChunkedArray) else named
    to = share.astype(np.int64) * len(named.dictionary) + named.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(to, kind="stable")
    to, got = to[order], got.select(["phrase", "c"]).take(pa.array(order))
    cuts = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1).tolist(), len(to)]
    phrase = pa.concat_arrays(got["phrase"].chunks)
    offsets = np.frombuffer(phrase.buffers()[1], np.int64)[phrase.offset : phrase.offset + len(phrase) + 1]
    text, count = memoryview(phrase.buffers()[2] or b""), got["c"].to_numpy()
    rows = [], [], []
    for a, b in zip(cuts, cuts[1:]):
        rows[0].append(to[a] // len(named.dictionary)), rows[1].append(named.dictionary[to[a] % len(named.dictionary)].as_py())
        rows[2].append(packed(np.int64(b - a).tobytes() + np.diff(offsets[a : b + 1]).astype(np.int32).tobytes() + count[a:b].tobytes() + bytes(text[offsets[a] : offsets[b]])))
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.string()), pa.nulls(len(rows[0]), pa.int64()), pa.array(rows[2], pa.binary())], names=["share", "lang", "total", "data"])


def _opened(data: bytes) -> pa.Table:
    """(phrase, c) of a pack."""
    data = unpacked(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.int32, n, 8), dtype=np.int64)])
    count = np.frombuffer(data[8 + 4 * n : 8 + 12 * n], np.int64)
    return pa.table({"phrase": pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(data[8 + 12 * n :])), "c": pa.array(count)})


def _survivors(shared, least: int, most: int, shares: int, keep: int = 1 << 19):
    """Packs of the n-grams that the sketch lets pass, counted in a block, about ``keep`` at a time, and the words of each language in all."""

    def counted(block, cells, totals, found):
        """Rows added to ``found``; the block's own arrays go on return."""
        words, rows = Words(*block), 0
        if not len(words.code):
            return 0
        for lang, n in zip(words.langs.to_pylist(), np.bincount(words.code // words.many, minlength=len(words.langs)).tolist()):
            totals[lang] = totals.get(lang, 0) + n
        for n, at, h in words.runs(most):
            for row in range(ROWS):
                ok = cells[row, cell(h, row, cells.shape[1])] >= least
                at, h = at[ok], h[ok]
            key = words.code[at]
            for j in range(1, n):
                key = np.unique(key, return_inverse=True)[1] * (words.many * len(words.langs)) + words.code[at + j]
            _, first, count = np.unique(key, return_index=True, return_counts=True)
            found.append(pa.table({"lang": words.langs_of(at[first]), "phrase": words.texts_of(at[first], n), "h": pa.array(h[first]), "c": pa.array(count, pa.int64())}))
            rows += len(first)
        return rows

    def run(batches):
        cells = np.frombuffer(shared.value, np.uint8).reshape(ROWS, -1)
        found, rows, totals = [], 0, {}
        for batch in batches:
            for block in blocks(batch):
                rows += counted(block, cells, totals, found)
                if rows > keep:
                    yield _packs(found, shares)
                    found, rows = [], 0
        if rows:
            yield _packs(found, shares)
        if totals:
            n = len(totals)
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64()), pa.nulls(n, pa.binary())], names=["share", "lang", "total", "data"])

    return run


def _sums(least: int, keep: int = 1 << 20):
    """(lang, phrase, count) from packs in the order of shares and languages, summed as they come; what is under ``least`` goes."""

    def out(lang, parts):
        got = parts[0] if len(parts) == 1 else pa.concat_tables(parts).group_by("phrase").aggregate([("c", "sum")]).rename_columns(["phrase", "c"])
        return got, pa.table({"lang": pa.repeat(pa.scalar(lang, pa.string()), len(got)), "phrase": got["phrase"].cast(pa.string()), "c": got["c"]})

    def run(batches):
        here, parts, rows = None, [], 0
        for batch in batches:
            for share, lang, total, data in zip(*(c.to_pylist() for c in batch.columns)):
                if data is None:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.nulls(1, pa.string()), pa.array([total], pa.int64())], names=["lang", "phrase", "c"])
                    continue
                if (share, lang) != here:
                    if parts:
                        yield from out(here[1], parts)[1].filter(pc.field("c") >= least).to_batches()
                    here, parts, rows = (share, lang), [], 0
                parts.append(_opened(data))
                rows += len(parts[-1])
                if rows > keep:
                    parts = [out(lang, parts)[0]]
                    rows = 0
        if parts:
            yield from out(here[1], parts)[1].filter(pc.field("c") >= least).to_batches()

    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, most: int = 3, cells: int = 1 << 26) -> DataFrame:
    """(lang, phrase, c), written: exact counts of all runs of 1 to ``most`` words that occur ``least`` times or more; rows of null phrase sum to all words."""
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"))
    size = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    width = min(1 << max(14, (size // 32).bit_length()), cells // ROWS)
    cut = min(least, 255)
    shared = spark.sparkContext.broadcast(sketch(base, width, cut, most).tobytes())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packs = base.mapInArrow(released(_survivors(shared, cut, most, 2 * parts)), PACKS)
    dealt = packs.repartition(parts, "share").sortWithinPartitions("share", "lang")
    counts = materialise(dealt.mapInArrow(released(_sums(least)), "lang string, phrase string, c long"), "phrases")
    shared.unpersist()
    return counts


def key(lang: str, phrase: str):
    return F.concat(F.length(lang), F.lit(":"), F.col(lang), F.col(phrase))


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of ``candidates`` (lang, phrase, c) of two words or more: the lowest-scoring cut of each."""
    candidates = candidates.select("lang", "phrase", F.col("c").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    sides = F.array(F.array_join(F.slice("w", F.lit(1), F.col("k")), " "), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " "))
    asked = cuts.select("lang", "phrase", "a", "k", F.posexplode(sides).alias("side", "part")).withColumn("key", key("lang", "part")).drop("part")
    known = counts.filter("phrase IS NOT NULL").select(key("lang", "phrase").alias("key"), "c")
    met = join_unique(asked, known, "key", "inner")
    both = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("c"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("c"))).alias("r"))
    whole = "CAST({} AS DECIMAL(19, 0))".format
    score = F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * {whole('a')} * {whole('a')}) DIV ({whole('l')} * {whole('r')})")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return both.groupBy("lang", "phrase", "a").agg(lowest.alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def covered(counts: DataFrame, share: int = 50) -> DataFrame:
    """(lang, phrase) of the counted phrases that a longer one contains, at least ``share`` percent as frequent."""
    w = F.col("w")
    longer = counts.filter(F.instr("phrase", " ") > 0).select("lang", F.split("phrase", " ").alias("w"), F.col("c").alias("f")).filter(F.size("w") > 2)
    sized = longer.select("lang", "w", "f", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("n"))
    inner = sized.select("lang", "f", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice(w, i, F.col("n")), " "))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return most.join(counts, ["lang", "phrase"]).filter(F.lit(100) * wide("f") >= F.lit(share) * wide("c")).select("lang", "phrase")


def first_of_each(rows: DataFrame, by: str, order: list, top: int, salt: str) -> DataFrame:
    """The first ``top`` rows of each value of ``by`` with their ``rank``: first those of shares by ``salt``, then of what these leave."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64(salt), F.lit(parts))
    shares = rows.withColumn("share_", share).withColumn("rank", F.row_number().over(Window.partitionBy(by, "share_").orderBy(*order))).filter(F.col("rank") <= top)
    return shares.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= top).drop("share_")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, most: int = 3, share: int = 50, top: int = 2000, cells: int = 1 << 26) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases."""
    counts = phrase_counts(docs, text_col, lang_col, least, most, cells)
    free = counts.filter(F.instr("phrase", " ") > 0).join(covered(counts, share), ["lang", "phrase"], "left_anti")
    ranked = first_of_each(scored(free, counts), "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "phrase")
    totals = counts.filter("phrase IS NULL").groupBy("lang").agg(F.sum("c").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM d),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3]) AS m) WHERE i + m - 1 <= len(w)),
n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, m, p, count(*) AS c, string_split(p, ' ') AS w FROM g GROUP BY lang, m, p HAVING count(*) >= 10),
q AS MATERIALIZED (
  SELECT lang, p, a, k, array_to_string(w[1:k], ' ') AS pl, array_to_string(w[k + 1:], ' ') AS pr
  FROM (SELECT lang, p, c AS a, w, unnest(range(1, m)) AS k FROM c WHERE m > 1)),
k AS (
  SELECT q.lang, q.p, a, k, x.c AS l, y.c AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.c AS HUGEINT) * y.c) AS BIGINT) AS score
  FROM q JOIN c x ON x.lang = q.lang AND x.p = pl JOIN c y ON y.lang = q.lang AND y.p = pr),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS o FROM k) WHERE o = 1),
s AS (SELECT lang, p, max(f) AS f FROM (SELECT lang, array_to_string(w[j:j + 1], ' ') AS p, f FROM (SELECT lang, w, c AS f, unnest([1, 2]) AS j FROM c WHERE m = 3)) GROUP BY lang, p),
o AS (SELECT b.* FROM b LEFT JOIN s ON s.lang = b.lang AND s.p = b.p WHERE s.f IS NULL OR 100 * s.f < 50 * b.a)
SELECT lang, rank, p AS phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM o) JOIN n USING (lang) WHERE rank <= 2000
"""
