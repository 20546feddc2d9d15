"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes ends a chunk wherever it is the block
size's remainder; each chunk becomes one of 64 characters of its own hash. The
block size is a power of two times three: the largest of which ``LEAST`` go into
the text's bytes. A chunk of more than ``LONG`` block sizes, as periodic passages make
them, is parted at the boundaries of half the size, and so on down, so what a
passage gives depends on the passage alone. A fingerprint is the size and the chunks at
that size, at twice and at four times it, parted by colons. A chunk that ends
a run of seven that came before in the text is left out: a periodic text has
the chunks of its first period and of what differs; none is cut off or joined.
A text and an edit that leaves its length stand at one size. A passage without a
boundary at any size (a single character for thousands of bytes, or a very short period) is one chunk.

Fingerprints are compared at the block sizes that both have (so up to a factor
of four apart; the best counts), by edit distance in which a change costs a deletion and an insertion:
``1 - distance / (both lengths)``, and 0 unless the two share a run of up to
seven characters (fewer for short fingerprints).

``fingerprint_edits`` also fingerprints an edited text: the last half of the
code points replaced by as many from the start of the next document in
descending id order (the first follows the last). The rows are range-partitioned
by id and streamed in order, so a task holds two texts at a time; only the first
and last row of each partition travel again, to meet their neighbours.

Defined cases: null text is empty; the empty text has fingerprint ``3:::``; two
empty fingerprints have likeness 1, one empty and one not 0; rows that share an
id follow one another in order of their text's hash; null ids come last; a
single row follows itself; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship
from .shingles import mix, powers

ship(__name__)

ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
LEAST_BLOCK, LEAST, LONG, RUN = 3, 32, 8, 7
_M = np.uint32(0x01000193)
_TABLE = (mix(np.arange(1000, 1256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the last seven bytes at every place (fewer at the start)."""
    x = _TABLE[data]
    out = x.copy()
    weight = np.uint32(1)
    for k in range(1, 7):
        weight = np.uint32((int(weight) * int(_M)) & 0xFFFFFFFF)
        out[k:] += x[:-k] * weight if len(x) > k else 0
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return out ^ (out >> np.uint32(13))


def _first_runs(h: np.ndarray) -> np.ndarray:
    """Which of the chunks (hashes) do not end a run of ``RUN`` that came before."""
    if len(h) <= RUN:
        return np.ones(len(h), bool)
    n = len(h) - RUN + 1
    runs = np.zeros(n, np.uint64)
    for k in range(RUN):
        runs = mix(runs + h[k : k + n])
    first = np.zeros(len(h), bool)
    first[: RUN - 1] = True
    first[np.unique(runs, return_index=True)[1] + RUN - 1] = True
    return first


def _cuts(found: list[np.ndarray], level: int, n: int) -> np.ndarray:
    """Where chunks end at a level, with 0 and ``n``; long ones parted at the levels below."""
    cuts = np.r_[0, found[level][found[level] < n], n]
    parts, long = [cuts], _long(cuts, level)
    for lower in range(level - 1, -1, -1):
        at, inner = found[lower], []
        for a, b in long:
            more = at[np.searchsorted(at, a, "right") : np.searchsorted(at, b)]
            parts.append(more)
            inner += _long(np.r_[a, more, b], lower)
        long = inner
    return np.sort(np.concatenate(parts)) if len(parts) > 1 else cuts


def _long(cuts: np.ndarray, level: int) -> list[tuple[int, int]]:
    """The chunks that are longer than the level allows."""
    i = np.flatnonzero(np.diff(cuts) > LONG * LEAST_BLOCK << level)
    return list(zip(cuts[i].tolist(), cuts[i + 1].tolist()))


def _chars(total: np.ndarray, down: np.ndarray, cuts: np.ndarray) -> str:
    """One character for each chunk that is not a repetition."""
    a, b = cuts[:-1], cuts[1:]
    h = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
    return ALPHABET[(h[_first_runs(h)] >> np.uint64(58)).astype(np.intp)].tobytes().decode()


def fingerprint(text: str) -> str:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = len(data)
    if not n:
        return "3:::"
    up, down = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    h = rolling(data)
    # block sizes nest: a boundary at twice the size is one at the size
    third = h % np.uint32(LEAST_BLOCK)
    at = np.flatnonzero(third == LEAST_BLOCK - 1)
    rank = h[at] // np.uint32(LEAST_BLOCK)
    # trailing ones of the quotient: how often the size doubles with the boundary kept
    levels = max(0, (n // (LEAST * LEAST_BLOCK)).bit_length() - 1)
    found = [at + 1]
    for _ in range(levels + 2):
        more = (rank & np.uint32(1)) == 1
        at, rank = at[more], rank[more] >> np.uint32(1)
        found.append(at + 1)
    return ":".join([str(LEAST_BLOCK << levels), *(_chars(total, down, _cuts(found, x, n)) for x in range(levels, levels + 3))])


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence, a row of bits at a time."""
    if not a or not b:
        return 0
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = place.get(c, 0)
        u = row & m
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _like(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    run = min(7, max(1, min(len(a), len(b)) // 4))
    grams = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in grams for i in range(len(b) - run + 1)):
        return 0.0
    distance = len(a) + len(b) - 2 * common_subsequence(a, b)
    return 1.0 - distance / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1; 0 where no block sizes agree."""
    if a == b:
        return 1.0
    one, two = ({int(x[0]) << i: c for i, c in enumerate(x[1:])} for x in (a.split(":"), b.split(":")))
    return max((_like(one[k], two[k]) for k in one.keys() & two.keys()), default=0.0)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc, text, own, following, after):
    new = edited(text, following)
    new_print = fingerprint(new)
    return doc, len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), own, new_print, likeness(own, new_print), likeness(own, after)


def _batch(rows, fields):
    cols = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields)], schema=pa.schema(fields))


FIELDS = [pa.field("doc_id", pa.int64()), pa.field("n_chars", pa.int64()), *(pa.field(n, pa.string()) for n in NAMES[2:5]), pa.field("near_edited", pa.float64()), pa.field("near_next", pa.float64())]
EXTRA = [pa.field("part", pa.int32()), pa.field("kind", pa.int32()), pa.field("text", pa.string())]


def _stream(batches):
    """Rows in order: each but the last is finished here; the first (kind 1) and the last (kind 2) also go out with their texts."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, rows = None, []
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            own = fingerprint(text)
            if last is None:
                rows.append((doc, None, None, own, None, None, None, part, 1, text))
            else:
                rows.append((*_row(*last, text, own), part, 0, None))
            last = (doc, text, own)
            if len(rows) >= 2000:
                yield _batch(rows, FIELDS + EXTRA)
                rows = []
    if last is not None:
        rows.append((last[0], None, None, last[2], None, None, None, part, 2, last[1]))
    yield _batch(rows, FIELDS + EXTRA)


def _meet(batches):
    for batch in batches:
        yield _batch([_row(*x) for x in zip(*(batch.column(i).to_pylist() for i in range(5)))], FIELDS)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 128 << 20) -> DataFrame:
    """See the contract's columns in ``NAMES``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    key = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / part_bytes))
    ordered = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    done = materialise(ordered.mapInArrow(_stream, SCHEMA + ", part int, kind int, text string"), "fingerprints")
    # one number for each partition that has rows
    found = sorted(r["part"] for r in done.filter("kind = 1").select("part").collect())
    if not found:
        return done.select(*NAMES)
    after = spark.createDataFrame(list(zip(found, found[1:] + found[:1])), "part int, next int")
    tails = done.filter("kind = 2").select("part", "doc_id", "text", "fingerprint").join(F.broadcast(after), "part")
    heads = done.filter("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    ends = tails.join(heads, "next").select("doc_id", "text", "fingerprint", "next_text", "next_print").mapInArrow(_meet, SCHEMA)
    return done.filter("kind = 0").select(*NAMES).unionByName(ends)
