"""Packing token sequences with non-negative least squares.

Documents become token ids plus an end id. Whole windows of ``window`` tokens
are cut off first and fill a sequence each; what is left of a document is one
tail shorter than the window. Tails are packed in groups of about
``group_tokens`` tokens:

1. enumerate the shallow combinations of tail lengths that fill the window
   exactly: all pairs and triples of lengths present;
2. solve ``min |A x - h|`` for repeat counts ``x >= 0`` against the group's
   length histogram ``h`` by projected gradient steps with momentum; beyond 2,000
   combinations, over a set of them that grows by those of positive multiplier
   and sheds those without a count (column generation);
3. round to the nearest whole counts, and stop where a length runs out;
4. pack the tails that are left greedily, longest first into the fullest open
   sequence that holds them; gaps that remain are filled by cutting the
   shortest tails, so only a group's last sequence is not full; that one is cut
   at powers of two, which need no padding.

A group lies within one task: no shuffle, memory bounded by the group, and a
task that is run again gives the same pieces. A sequence's id holds the
partition's number and a running number.

Ids come from the tokenizers file; where its twin file of ranks is given, texts
without a special token's string go through that, which is faster and gives the
same ids.

Defined cases: null text is empty; an empty document is its end id alone;
repeated rows are packed one by one; null ids are ids; a sequence belongs to one
task, so ids of sequences repeat only with the partitioning; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, ship

ship(__name__)

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids, as little-endian unsigned 32-bit bytes, of the vocabulary in a tokenizers file and its twin of ranks."""

    def __init__(self, vocabulary: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.ranks = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def bytes_of(self, ids) -> bytes:
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.ranks is None or any(s in text for s in self.special):
            return self.bytes_of(self.whole.encode(text, add_special_tokens=False).ids)
        return self.bytes_of(self.ranks.encode_ordinary(text))


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0: none), not falling, that fill the window: every pair and triple of lengths present."""
    lengths = np.unique(lengths)
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    rows = []
    for x in [0, *lengths[lengths <= window // 3].tolist()]:
        y = lengths[(lengths >= x) & (2 * lengths <= window - x)]
        y = y[there[window - x - y]]
        rows.append(np.stack([np.full_like(y, x), y, window - x - y], 1))
    return np.concatenate(rows)


def nnls_counts(rows: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts >= 0 of the combinations that come nearest to the histogram (bin 0 is ignored)."""
    if not len(rows):
        return np.zeros(0)
    h = histogram.astype(float).copy()
    h[0] = 0.0
    flat = rows.ravel()
    size = len(h)

    def apply(x):
        out = np.bincount(flat, np.repeat(x, rows.shape[1]), size)
        out[0] = 0.0
        return out

    back = lambda r: r[rows].sum(1)  # noqa: E731  bin 0 holds 0
    v = np.ones(len(rows))
    for _ in range(8):
        v = back(apply(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1.0 / (norm * 1.05)
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - step * back(apply(y) - h))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def generated_counts(rows: np.ndarray, histogram: np.ndarray, width: int = 2000, rounds: int = 8) -> np.ndarray:
    """``nnls_counts`` of all rows by column generation: the rows whose multiplier says that they would help come in, those without a count go."""
    if len(rows) <= width:
        return nnls_counts(rows, histogram)
    h = histogram.astype(float)
    h[0] = 0.0
    active = np.unique(np.linspace(0, len(rows) - 1, width).astype(int))
    for _ in range(rounds):
        x = nnls_counts(rows[active], histogram, 120)
        left = h - np.bincount(rows[active].ravel(), np.repeat(x, 3), len(h))
        left[0] = 0.0
        gain = left[rows].sum(1)
        gain[active] = -np.inf
        best = np.argpartition(-gain, width // 2)[: width // 2]
        best = best[gain[best] > 0.5]
        if not len(best):
            break
        active = np.concatenate([active[x > 1e-3], best])
    out = np.zeros(len(rows))
    out[active] = nnls_counts(rows[active], histogram)
    return out


def plan_tails(lengths: np.ndarray, window: int) -> tuple[list[list[int]], list[int]]:
    """Sequences (lists of tail numbers) by the solved counts, and the tails left over."""
    histogram = np.bincount(lengths, minlength=window + 1)
    rows = combinations(np.flatnonzero(histogram), window)
    counts = np.rint(generated_counts(rows, histogram)).astype(int)
    stock: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        stock[int(lengths[i])].append(i)
    full = []
    for j in np.argsort(-counts, kind="stable"):
        need = [int(v) for v in rows[j] if v]
        for _ in range(int(counts[j])):
            if any(len(stock[v]) < need.count(v) for v in need):
                break
            full.append([stock[v].pop() for v in need])
    rest = [i for v in sorted(stock, reverse=True) for i in stock[v]]
    return full, rest


def fill(rest: list[int], lengths: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (tail, from, length): longest first into the fullest that holds it; gaps are filled by cutting the shortest."""
    open_by_room: dict[int, list[list]] = defaultdict(list)
    rooms: list[int] = []
    from bisect import bisect_left, insort

    made = []
    for i in sorted(rest, key=lambda i: -lengths[i]):
        n = int(lengths[i])
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms.pop(at)
            seq = open_by_room[room].pop()
        else:
            room, seq = window, []
            made.append(seq)
        seq.append((i, 0, n))
        if room > n:
            insort(rooms, room - n)
            open_by_room[room - n].append(seq)
    # Cut the least filled sequences into the gaps of the others.
    size = lambda s: sum(x[2] for x in s)
    made.sort(key=size)
    short, out = 0, made
    fills = [size(s) for s in out]
    j = len(out) - 1
    while short < j:
        room = window - fills[j]
        if room == 0:
            j -= 1
            continue
        while room and out[short]:
            i, a, n = out[short].pop()
            k = min(n, room)
            out[j].append((i, a, k))
            if n > k:
                out[short].append((i, a + k, n - k))
            room -= k
            fills[j] += k
            fills[short] -= k
        if not out[short]:
            short += 1
        if room == 0:
            j -= 1
    return [s for s in out if s]


def at_powers_of_two(seq: list[tuple[int, int, int]], window: int) -> list[list[tuple[int, int, int]]]:
    """A sequence that is not full, cut into sequences whose lengths are powers of two."""
    total = sum(n for _, _, n in seq)
    if total == window or total & (total - 1) == 0:
        return [seq]
    out, todo = [], list(reversed(seq))
    for bit in reversed(range(total.bit_length())):
        room = total & (1 << bit)
        piece = []
        while room:
            i, a, n = todo.pop()
            k = min(n, room)
            piece.append((i, a, k))
            if n > k:
                todo.append((i, a + k, n - k))
            room -= k
        if piece:
            out.append(piece)
    return out


def pack_group(tails: list[bytes], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (tail, from, length) of tails of 4-byte ids; every id once."""
    lengths = np.array([len(t) // 4 for t in tails], np.int64)
    full, rest = plan_tails(lengths, window)
    out = [[(i, 0, int(lengths[i])) for i in seq] for seq in full]
    for seq in fill(rest, lengths, window):
        out.extend(at_powers_of_two(seq, window))
    return out


def _pack(encoder_args: tuple, window: int, end_id: int, group_tokens: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([(n, pa.int64()) for n in names])
    made: list[Encoder] = []

    def pack(batches):
        from pyspark import TaskContext

        if not made:
            made.append(Encoder(*encoder_args))
        encode = made[0].encode
        end = np.asarray([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        state = {"next": 0}
        cols: list[list[int]] = [[] for _ in names]
        tails: list[bytes] = []
        owners: list[tuple] = []
        held = 0

        def put(doc, start, data, total, seq, offset):
            for c, v in zip(cols, (doc, start, len(data) // 4, zlib.crc32(data), total, seq, offset)):
                c.append(v)

        def batch():
            got = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)
            for c in cols:
                c.clear()
            return got

        def flush():
            for seq in pack_group(tails, window):
                sid, offset = base + state["next"], 0
                state["next"] += 1
                for i, a, n in seq:
                    doc, start, total = owners[i]
                    put(doc, start + a, tails[i][4 * a : 4 * (a + n)], total, sid, offset)
                    offset += n
            tails.clear()
            owners.clear()

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                data = encode(text.as_py() or "") + end
                total = len(data) // 4
                at = 0
                while total - at >= window:
                    put(doc, at, data[4 * at : 4 * (at + window)], total, base + state["next"], 0)
                    state["next"] += 1
                    at += window
                if at < total:
                    tails.append(data[4 * at :])
                    owners.append((doc, at, total))
                    held += total - at
                if held >= group_tokens:
                    flush()
                    held = 0
                if len(cols[0]) >= 50_000:
                    yield batch()
        if tails:
            flush()
        if cols[0]:
            yield batch()

    return pack


def pack_documents(docs: DataFrame, vocabulary: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0, group_tokens: int = 6_000_000) -> DataFrame:
    """One row per piece; see the module's docstring. ``window`` is a power of two."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(released(_pack((vocabulary, ranks), window, end_id, group_tokens)), PIECES)
