"""Substring dedup over sliding runs of sentences.

A text is cut into sentences (after a word that ends in ``.``, ``!`` or ``?``, and
at line ends; words are runs of bytes other than 0x20 and 0x09-0x0D); a sentence
of more than ``max_words`` words counts as several of at most three quarters as
many, cut where the content says: after each word whose hash with the word before
is the smallest of any ``3 * max_words // 4`` in a row. A cut rests on the words
around it only, so pieces fall alike in every copy of a passage, wherever it
starts, and one endless sentence cannot hide a repeated passage.
From every sentence starts one run: the shortest with at least ``min_units``
sentences and ``min_words`` words. Runs are hashed (128 bits over their words)
and joined globally; a run that occurs earlier, in document order and then
position, is not the first, and the sentences that it covers go.

At the defaults, any passage of over ``3 * max_words`` words that starts at a
sentence, or that has no sentence end within and stands inside sentences of more
than ``max_words`` words, holds at least one whole run. One that starts within a
sentence and has sentence ends may lose up to ``max_words`` words at either side:
over ``5 * max_words`` suffice.

Numpy parses the texts, a slice of about a million bytes (or one longer text) at
a time, into offsets, and hashes runs by differences of running sums; the global
work is one exchange of (hash, document, position) rows, in which the rows of a
hash meet in a stream. Hashes that many rows have are left out of it: their first
occurrence is found before any shuffle. Sentences are addressed by offsets, so
the text meets its own ranges in one join.

Defined cases: null text stays null, an empty one empty; white space at the ends
of a text goes with removed sentences, other texts stay as they are; rows that
share id and text are one document; null ids sort last; an empty table gives no
rows; extra columns pass through, whatever their names, but those named like the
three counts, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import later_occurrences, materialise, order_key, ship
from .shingles import mix, powers, slices

ship(__name__)
P = "__lf_"
_U = np.uint64
_ENDS = np.zeros(256, bool)
_ENDS[[33, 46, 63]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Two values for each byte: two sums over a text, so two hashes of any part of it.
_BYTES = [mix(np.arange(i, i + 256, dtype=_U)) | _U(1) for i in (5001, 9001)]
_PLACE = (1 << 24) - 1


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row."""
    m, k, n = v, 1, len(v) - width + 1
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return np.minimum(m[:n], m[width - k : width - k + n])


class Units:
    """Sentence pieces of several texts (bytes): ``doc``, byte offsets ``start`` and ``end`` in it, ``words``; in order."""

    def __init__(self, texts: list[bytes], max_words: int = 16):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        size = np.array([len(t) + 1 for t in texts])
        space = _SPACE[raw]
        before = np.r_[True, space[:-1]]
        start, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        n = len(start)
        doc = np.searchsorted(np.cumsum(size), start, side="right")
        lines = np.r_[0, np.cumsum(raw == 10)]
        close = _ENDS[raw[end - 1]] | (lines[np.r_[start[1:], len(raw)][:n]] > lines[end])
        # the texts with one byte between words: offsets shift by the bytes dropped
        keep = ~(space & before)
        low = np.where(space[keep], np.uint8(32), raw[keep])
        shift = np.cumsum(~keep)
        self.first, self.last = start - shift[start], end - shift[end]
        up, self.down = powers(len(low) + 1)
        self.sums = [np.r_[_U(0), np.cumsum(b[low] * up[: len(low)])] for b in _BYTES]
        width = max(1, max_words * 3 // 4)
        sentence = np.cumsum(close) - close
        long = (np.bincount(sentence, minlength=1) > max_words)[sentence]
        if long.any():
            word = self._hash(0, self.first, self.last)
            prior = np.r_[_U(0), word[:-1]][:n] * np.r_[False, sentence[1:] == sentence[:-1]]
            at = np.arange(n, dtype=_U)
            # the low bits hold the place: of equal hashes the last is the smallest
            v = (mix(word ^ prior * _U(0x9E3779B97F4A7C15)) & ~_U(_PLACE)) | (_U(_PLACE) - (at & _U(_PLACE)))
            low_at = np.flatnonzero(long[: n - width + 1] & (sentence[width - 1 :] == sentence[: n - width + 1]))
            chosen = _PLACE - (_least(v, width)[low_at] & _U(_PLACE)).astype(np.int64)
            close[low_at + ((chosen - low_at) & _PLACE)] = True
        to = np.flatnonzero(close)
        of = np.r_[0, to[:-1] + 1][: len(to)]
        self.doc, self.words = doc[of], to - of + 1
        begin = (np.cumsum(size) - size)[self.doc]
        self.start, self.end = start[of] - begin, end[to] - begin
        self.first, self.last = self.first[of], self.last[to]
        self.count = np.bincount(self.doc, minlength=len(texts))

    def _hash(self, i: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[i][b] - self.sums[i][a]) * self.down[a] + (b - a).astype(_U) * _U(0x94D049BB133111EB))

    def runs(self, min_units: int = 3, min_words: int = 12) -> tuple[np.ndarray, ...]:
        """(doc, place in it, pieces, two hashes) of the run that starts at each piece, where there is one."""
        n = len(self.doc)
        ends = np.cumsum(self.count)
        total = np.r_[0, np.cumsum(self.words)]
        to = np.maximum(np.arange(n) + min_units, np.searchsorted(total, total[:-1] + min_words))
        i = np.flatnonzero(to <= ends[self.doc])
        to = to[i]
        a, b, doc = self.first[i], self.last[to - 1], self.doc[i]
        return doc, i - (ends - self.count)[doc], to - i, self._hash(0, a, b).view(np.int64), self._hash(1, a, b).view(np.int64)


def units(text: str, max_words: int = 16) -> list[tuple[int, int, int]]:
    """(start, end, words) of each sentence piece of a text, in bytes; pieces without words are left out."""
    u = Units([text.encode("utf-8", "replace")], max_words)
    return list(zip(u.start.tolist(), u.end.tolist(), u.words.tolist()))


def _texts(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _emit(max_words: int, min_units: int, min_words: int):
    schema = pa.schema([("ord", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("len", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64())])

    def emit(batches):
        for batch in batches:
            o, th, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _texts(batch.column(2))
            for a, b in slices(texts):
                doc, pos, n, k1, k2 = Units(texts[a:b], max_words).runs(min_units, min_words)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((o[a + doc], th[a + doc], pos, n, k1, k2), schema)], schema=schema)

    return emit


def _cut(max_words: int):
    def cut(batches):
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            column, spans = batch.column(at[P + "text"]), batch.column(at[P + "spans"])
            texts, touched = _texts(column), np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            total, gone, words = (np.zeros(len(texts), np.int64) for _ in range(3))
            out = {}
            for a, b in slices(texts):
                u = Units(texts[a:b], max_words)
                total[a:b] = u.count
                first = np.cumsum(u.count) - u.count
                for i in touched[(touched >= a) & (touched < b)]:
                    mine = slice(first[i - a], first[i - a] + u.count[i - a])
                    covered = np.zeros(total[i] + 1, np.int64)
                    for x in spans[i].as_py():
                        covered[x["pos"]] += 1
                        covered[x["pos"] + x["len"]] -= 1
                    covered = np.cumsum(covered[:-1]) > 0
                    ends, starts = u.end[mine][covered], u.start[mine][covered]
                    t = texts[i]
                    out[i] = b"".join(t[p:q] for p, q in zip([0, *ends.tolist()], [*starts.tolist(), len(t)])).strip()
                    gone[i], words[i] = covered.sum(), u.words[mine][covered].sum()
            if out:
                column = pa.array([out.get(i, t) if ok else None for i, (t, ok) in enumerate(zip(texts, column.is_valid().to_pylist()))], pa.binary()).cast(pa.string())
            rest = [n for n in batch.schema.names if n not in (P + "text", P + "spans")]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[n]) for n in rest), column, *map(pa.array, (total, gone, words))], names=[*rest, P + "out", P + "n", P + "gone", P + "words"])

    return cut


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = 16, min_units: int = 3, min_words: int = 12) -> DataFrame:
    """``docs`` with ``text_col`` cleaned, and ``n_sentences``, ``n_removed``, ``removed_words`` added."""
    new = ("n_sentences", "n_removed", "removed_words")
    kept = [c for c in docs.columns if c not in new]
    base = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], order_key(F.col(f"`{id_col}`")).alias(P + "ord"), F.xxhash64(F.col(f"`{text_col}`")).alias(P + "th"))
    text = f"c{kept.index(text_col)}"
    found = base.select(P + "ord", P + "th", text).mapInArrow(_emit(max_words, min_units, min_words), "ord long, th long, pos int, len int, k1 long, k2 long")
    found = materialise(found, "sentence-runs")
    later = later_occurrences(found, ("k1", "k2"), ["ord", "th", "pos", "len"])
    spans = later.groupBy(F.col("ord").alias(P + "ord"), F.col("th").alias(P + "th")).agg(F.collect_set(F.struct("pos", "len")).alias(P + "spans"))
    joined = base.join(spans, [P + "ord", P + "th"], "left").select(*[f"c{i}" for i in range(len(kept)) if f"c{i}" != text], F.col(text).alias(P + "text"), P + "spans")
    fields = [f for f in joined.schema.fields if f.name not in (P + "text", P + "spans")]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in fields] + [f"{P}out string", f"{P}n long", f"{P}gone long", f"{P}words long"])
    out = joined.mapInArrow(_cut(max_words), schema)
    return out.select(*[F.col(P + "out" if f"c{i}" == text else f"c{i}").alias(c) for i, c in enumerate(kept)], *[F.col(P + a).alias(b) for a, b in zip(("n", "gone", "words"), new)])
