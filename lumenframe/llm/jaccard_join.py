"""Exact similarity join of word-shingle sets (Jaccard >= 0.8) by universe-partition pigeonhole.

Two sets r, s with ``100 |r & s| >= 80 |r | s|`` differ in at most
``H = (|r| + |s|) / 9`` elements, and the larger has at most 1.25 times the
smaller's. So:

* Sizes fall into bands. A set is indexed in its own band and in those below
  that may hold a partner; band ``k`` (sizes up to ``hi``) allows ``H = hi // 4``.
* The universe of hashes is cut into ``m`` segments. If the allowances ``v`` of
  the segments satisfy ``sum(v + 1) > H``, two similar sets agree in some
  segment up to ``v`` elements (v = 0: equal; v = 1: equal but for one element;
  v = -1: not looked at).
* Allocation by cost. In small bands (hi < 32) segments are few and long, all
  with v = 1: their keys are the segment and its one-deletion neighbourhood. In
  larger bands there are ``SLACK`` more segments than needed, all with v = 0; that
  slack lets each set leave out its dearest segments: empty ones, and those
  whose key most other sets have. All sets rank keys alike (by the number of sets that
  have it, then by key), so the cheapest key two similar sets share is kept by
  both.
* Only keys that several sets have reach the allocation. Keys that at most
  ``hot`` sets still have after it give all their pairs. Of larger groups, all
  members are compared with four pivots; where that does not join a group into
  one component, the members outside its largest component are compared with
  all others, in blocks that are dealt out by key and both blocks. So a group of
  near copies costs its size, one with few outsiders their number times its size,
  and no link between components is lost. A group whose members are all apart
  (pages of one template that stay just under the threshold) costs the square of
  its size in comparisons of sketches.
* Candidates are pruned by parity sketches, whose distance never exceeds the
  sets' difference, and verified by the sets themselves.

Equal sets are one class, represented by 88 bits of a commutative hash.
A task makes keys of a class once. Keys travel packed in byte blocks, one block
for each bucket and task, so the shuffle has no row overhead; a bucket holds about
``bucket_bytes``. Keys that more than a bucket's share of classes have, as a
64th of the classes shows, are dealt out by class as well; their counts, at most
256 of them, are added up afterwards.

Defined cases: null and empty texts have no words, n_shingles 0 and a component
of their own; null ids sort last, and component_id is null where all ids are
null; rows are judged one by one, so repeated rows are copies of each other;
extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import LAST_ID, give_back, hot_hashes, hot_keys, join_unique, materialise, narrow, order_key, released, ship
from .components import components
from .shingles import mix, shingle_sets, slices

ship(__name__)

SKETCH_BITS = 2048
#: Segments beyond those needed, as a share of them.
SLACK = 0.6
#: Members of a large group that are compared at once.
BLOCK = 256
_U = np.uint64


def band_bounds(ratio: float = 1.3, most: int = 1 << 40) -> list[int]:
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * ratio)))
    return out


BOUNDS = band_bounds()


def band_of(n: int) -> int:
    return bisect_right(BOUNDS, n) - 1


def class_of(h: np.ndarray) -> bytes:
    """88 bits that stand for a set."""
    with np.errstate(over="ignore"):
        a = int(mix(np.array([mix(h).sum(dtype=_U)], _U))[0])
        b = int(mix(np.array([mix(h ^ _U(0xD6E8FEB86659FD93)).sum(dtype=_U) + _U(len(h))], _U))[0])
    return a.to_bytes(8, "big") + (b & 0xFFFFFF).to_bytes(3, "big")


def sketch_of(h: np.ndarray) -> bytes:
    """Parity bits: equal bits wherever two sets agree."""
    odd = np.bincount((h >> _U(17) & _U(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def plan(n: int, band: int) -> tuple[int, int, bool]:
    """(segments, of which a set of ``n`` may leave out, with one-deletions) in a band; no segments: only equal sets are similar."""
    lo, hi = BOUNDS[band], BOUNDS[band + 1] - 1
    most = hi // 4
    if most == 0:
        return 0, 0, False
    if hi < 32:
        return (most + 2) // 2, 0, True
    m = most + 1 + math.ceil(SLACK * (most + 1))
    own = n // 4 if lo <= n <= hi else (n + hi) // 9
    return m, m - own - 1, False


def keys_of(h: np.ndarray, band: int, step: int) -> tuple[np.ndarray, int]:
    """(keys of a set in a band, how many of them it may leave out)."""
    m, spare, deletions = plan(len(h), band)
    if not m:
        return np.zeros(0, _U), 0
    seg = ((h >> _U(20)) % _U(m)).astype(np.int64)
    order = np.argsort(seg, kind="stable")
    seg, part = seg[order], mix(h[order] ^ _U(0xA24BAED4963EE407))
    first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    with np.errstate(over="ignore"):
        total = np.add.reduceat(part, first)
        salt = mix(np.arange(m, dtype=_U) + _U(band << 32) + _U(1))
        there = seg[first]
        keys = mix(total + salt[there])
        if deletions:
            rest = mix(np.repeat(total, np.diff(np.r_[first, len(seg)])) - part + salt[seg])
            gone = np.setdiff1d(np.arange(m), there)
            return np.concatenate([keys, rest, mix(salt[gone])]), 0
    empty = m - len(there)
    if empty > spare:
        gone = np.setdiff1d(np.arange(m), there)[: empty - spare]
        return np.concatenate([keys, mix(salt[gone])]), 0
    return keys, spare - empty


def _all_keys(h: np.ndarray):
    """(keys, flags) of a set in each of its bands, its own first."""
    n = len(h)
    for step, band in enumerate(range(band_of(n), band_of(-(-4 * n // 5)) - 1, -1)):
        keys, spare = keys_of(h, band, step)
        yield keys, min(spare, 16383) << 2 | min(step, 3)


def _texts(batch) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in batch.column(batch.num_columns - 1).to_pylist()]


def _classes(k: int):
    schema = pa.schema([("id", pa.int64()), ("ord", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for batch in narrow(batches):
            texts, n, cls, sketch, keys = _texts(batch), [], [], [], []
            for a, b in slices(texts):
                for h in shingle_sets(texts[a:b], k):
                    n.append(len(h))
                    cls.append(class_of(h) if len(h) else None)
                    sketch.append(sketch_of(h) if len(h) else None)
                    # keys of a 64th of the classes, whatever their number: they show which are common
                    keys.append(np.concatenate([x for x, _ in _all_keys(h)]).view(np.int64) if len(h) >= 4 and cls[-1][3] & 63 == 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return run


def _keys(k: int, buckets: int, hot: list[int], flush_rows: int = 1_500_000):
    """Packed (key, class, flags) rows of each bucket. A row: 40 bits of key and 24 of the class; 64 of the class; 14 bits of what it may leave out and 2 of the step.

    Buckets from ``buckets`` on hold the keys in ``hot``, by their place there, dealt out by class.
    """
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
    common = np.sort(np.array(hot, np.int64).view(_U))

    def run(batches):
        held: list[tuple] = []
        count, done = 0, set()

        def flush():
            key = np.concatenate([x[0] for x in held])
            reps = np.array([len(x[0]) for x in held])
            hi = np.repeat(np.array([x[1] for x in held], _U), reps)
            lo = np.repeat(np.array([x[2] for x in held], _U), reps)
            flag = np.repeat(np.array([x[3] for x in held], np.uint16), reps)
            bucket, k40 = (key >> _U(40)) % _U(buckets), key & _U((1 << 40) - 1)
            if len(common):
                at = np.minimum(np.searchsorted(common, key), len(common) - 1)
                is_hot = common[at] == key
                k40 = np.where(is_hot, at.astype(_U), k40)
                bucket = np.where(is_hot, _U(buckets) + mix(lo ^ at.astype(_U)) % _U(buckets), bucket)
            order = np.argsort(bucket.astype(np.int32), kind="stable")
            a = ((k40 << _U(24)) | hi)[order]
            lo, flag = lo[order], flag[order]
            cuts = np.searchsorted(bucket[order], np.arange(2 * buckets + 1))
            rows = [(i, int(t - s), a[s:t].tobytes() + lo[s:t].tobytes() + flag[s:t].tobytes()) for i, (s, t) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if t > s]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in narrow(batches):
            texts = _texts(batch)
            for a, b in slices(texts):
                for h in shingle_sets(texts[a:b], k):
                    if len(h) < 4:
                        continue
                    c = class_of(h)
                    if c in done:
                        continue
                    done.add(c)
                    lo, hi = int.from_bytes(c[:8], "big"), int.from_bytes(c[8:], "big")
                    for keys, flags in _all_keys(h):
                        if len(keys):
                            held.append((keys, hi, lo, flags))
                            count += len(keys)
                if count >= flush_rows:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    return run


FOUND = "key long, cls binary, cnt long, step int, spare int"


def _meet(buckets: int):
    """Of a bucket: a row for each class of every key that several classes have, or of every hot key (``cnt`` is then of this bucket alone)."""

    def run(key, table):
        made = _meet_bucket(key[0].as_py(), buckets, table)
        give_back()
        return made

    return run


def _meet_bucket(bucket: int, buckets: int, table):
    a, lo, flag = [], [], []
    for n, data in zip(table.column("n").to_pylist(), table.column("data")):
        data = data.as_buffer()
        a.append(np.frombuffer(data, _U, n))
        lo.append(np.frombuffer(data, _U, n, 8 * n))
        flag.append(np.frombuffer(data, np.uint16, n, 16 * n))
    a, lo, flag = np.concatenate(a), np.concatenate(lo), np.concatenate(flag)
    k = a >> _U(24)
    order = np.argsort(k, kind="stable")
    k = k[order]
    same = k[1:] == k[:-1]
    if bucket < buckets:
        order = order[np.r_[same, False] | np.r_[False, same]]
    a, lo, flag = a[order], lo[order], flag[order]
    order = np.lexsort((lo, a))
    a, lo, flag = a[order], lo[order], flag[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (lo[1:] != lo[:-1])][: len(a)]
    a, lo, flag = a[new], lo[new], flag[new]
    k = a >> _U(24)
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][: len(k)])
    count = np.diff(np.r_[start, len(k)])
    size = np.repeat(count, count)
    some = (size > 1) | (bucket >= buckets)
    a, lo, flag, k, size = a[some], lo[some], flag[some], k[some], size[some]
    ids = np.empty((len(a), 11), np.uint8)
    ids[:, :8] = lo.astype(">u8").view(np.uint8).reshape(-1, 8)
    ids[:, 8:] = (a & _U(0xFFFFFF)).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:]
    whole = (_U(min(bucket, buckets)) << _U(40)) | k
    return pa.table(
        {
            "key": pa.array(whole.astype(np.int64)),
            "cls": pa.FixedSizeBinaryArray.from_buffers(pa.binary(11), len(ids), [None, pa.py_buffer(ids)]).cast(pa.binary()),
            "cnt": pa.array(size.astype(np.int64)),
            "step": pa.array((flag & 3).astype(np.int32)),
            "spare": pa.array((flag >> 2).astype(np.int32)),
        }
    )


def _sets(k: int):
    def run(batches):
        for batch in narrow(batches):
            texts, out = _texts(batch), []
            for a, b in slices(texts):
                out.extend(h.tobytes() for h in shingle_sets(texts[a:b], k))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["cls", "items"])

    return run


def _near_sketch(batches):
    """Pairs whose sketches do not rule them out."""
    for batch in narrow(batches):
        a, b, na, nb, sa, sb = (batch.column(i) for i in range(6))
        if not batch.num_rows:
            continue
        x = np.frombuffer(b"".join(sa.to_pylist()), _U).reshape(-1, SKETCH_BITS // 64)
        y = np.frombuffer(b"".join(sb.to_pylist()), _U).reshape(-1, SKETCH_BITS // 64)
        na, nb = na.to_numpy(), nb.to_numpy()
        good = (np.bitwise_count(x ^ y).sum(1) * 9 <= na + nb) & (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb))
        good = pa.array(good)
        yield pa.RecordBatch.from_arrays([a.filter(good), b.filter(good)], names=["a", "b"])


def _meet_blocks(batches):
    """Pairs of two blocks' members that are in different components and that their sketches do not rule out."""

    def unpack(g):
        sketch = np.frombuffer(b"".join(x["sketch"] for x in g), _U).reshape(len(g), -1)
        return [x["cls"] for x in g], np.array([x["root"] for x in g], object), np.array([x["step"] for x in g]), np.array([x["n"] for x in g]), sketch

    for batch in batches:
        a, b = [], []
        for i in range(batch.num_rows):
            ca, ra, ta, na, sa = unpack(batch.column(0)[i].as_py())
            cb, rb, tb, nb, sb = unpack(batch.column(1)[i].as_py())
            for j in range(len(ca)):
                good = (np.bitwise_count(sb ^ sa[j]).sum(1) * 9 <= na[j] + nb) & (5 * np.minimum(na[j], nb) >= 4 * np.maximum(na[j], nb)) & ((tb == 0) | (ta[j] == 0))
                for k in np.flatnonzero(good):
                    if rb[k] != ra[j]:
                        a.append(min(ca[j], cb[k])), b.append(max(ca[j], cb[k]))
        pairs = sorted(set(zip(a, b)))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.binary()), pa.array([x for _, x in pairs], pa.binary())], names=["a", "b"])


def _verify(batches):
    for batch in narrow(batches):
        u, v = [], []
        for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
            x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
            both = len(x) + len(y) - len(np.union1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                u.append(a), v.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, hot: int = 8, bucket_bytes: int = 32 << 20, broadcast_ids: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(rows, links): ``rows`` (id, ord, n, cls) for each row of ``docs``, ``links`` (u, v) between classes, enough to connect every component.

    Every pair of similar classes is either in ``links`` or joined by a path of them.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), order_key(F.col(f"`{id_col}`")).alias("ord"), F.xxhash64(text).alias("th"), text.alias("text"))
    rows = materialise(base.mapInArrow(released(_classes(k)), "id long, ord long, th long, n long, cls binary, sketch binary, keys array<long>"), "classes")
    classes = rows.filter("cls is not null").groupBy("cls").agg(F.min(F.struct("ord", "th")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    words = rows.agg(F.sum("n")).first()[0] or 0
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(width, math.ceil(0.65 * words * 18 / bucket_bytes))
    hot_at = hot_keys(rows.filter("keys is not null").dropDuplicates(["cls"]).select(F.explode("keys").alias("key")), "key", buckets)
    found = materialise(base.select("ord", "text").mapInArrow(released(_keys(k, buckets, hot_at)), "bucket int, n int, data binary").groupBy("bucket").applyInArrow(_meet(buckets), FOUND), "found")
    if hot_at:
        # one row for each hot key, at most 256
        is_hot = F.col("key") >= F.lit(buckets << 40)
        total = found.filter(is_hot).groupBy("key").agg(F.count("*").alias("cnt")).filter("cnt > 1")
        found = found.filter(~is_hot).unionByName(found.filter(is_hot).drop("cnt").join(F.broadcast(total), "key"))

    def near(pairs: DataFrame) -> DataFrame:
        facts = classes.select("cls", "n", "sketch")
        x = pairs.join(facts.toDF("a", "na", "sa"), "a").join(facts.toDF("b", "nb", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb")
        return materialise(x.mapInArrow(released(_near_sketch), "a binary, b binary"), "near")

    def verified(pairs: DataFrame) -> DataFrame:
        need = materialise(
            pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(classes.select("cls", "rep"), "cls").select("cls", F.col("rep.ord").alias("ord"), F.col("rep.th").alias("th")), "need"
        )
        small = need.count() <= broadcast_ids
        texts = base.join(F.broadcast(need) if small else need, ["ord", "th"]).select("cls", "text")
        sets = materialise(texts.mapInArrow(released(_sets(k)), "cls binary, items binary").dropDuplicates(["cls"]), "sets")
        x = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return materialise(x.mapInArrow(released(_verify), "u binary, v binary"), "links")

    ordered = lambda d, x, y: d.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a <> b")
    dear = Window.partitionBy("cls", "step").orderBy(F.desc("cnt"), F.desc("key"))
    left = materialise(found.withColumn("rank", F.row_number().over(dear)).filter("rank > spare").select("key", "cls", "step"), "left")
    sizes = left.groupBy("key").agg(F.count("*").alias("c"), F.min("step").alias("s")).filter("c > 1 and s = 0")
    hot_left = hot_hashes(left, "key")
    groups = materialise(join_unique(left, sizes, "key", "inner", hot_left).select("key", "cls", "step", "c"), "groups")
    # at most ``hot`` members a key
    few = groups.filter(F.col("c") <= hot).groupBy("key").agg(F.collect_list(F.struct("step", "cls")).alias("g"))
    cold = ordered(few.select(F.explode("g").alias("x"), "g").select("x", F.explode("g").alias("y")).filter("x.cls < y.cls and (x.step = 0 or y.step = 0)").select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")), "a", "b")
    groups = groups.filter(F.col("c") > hot)
    # pivots: of each of four parts of a group, the member that is in most groups
    degree = groups.groupBy("cls").agg(F.count("*").alias("d"))
    part = F.pmod(F.xxhash64("cls"), F.lit(4))
    pivots = groups.join(degree, "cls").groupBy("key", part.alias("part")).agg(F.max(F.struct("d", "cls")).alias("p")).groupBy("key").agg(F.collect_list("p.cls").alias("pivots"))
    star = ordered(join_unique(groups, pivots, "key", "inner", hot_left).withColumn("pivot", F.explode("pivots")), "cls", "pivot")
    links = verified(near(cold.unionByName(star).distinct()))
    if not groups.take(1):
        return rows, links
    # of groups that are still several components, members outside the largest meet all others, in blocks, by their sketches
    roots = components(links)
    member = materialise(join_unique(groups, roots.toDF("cls", "root"), "cls", "left").select("key", "cls", "step", F.coalesce("root", "cls").alias("root")), "members")
    largest = member.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "root")).alias("big"), F.sum("m").alias("c"), F.count("*").alias("parts")).filter("parts > 1")
    apart = join_unique(member, largest.select("key", "c", F.col("big.root").alias("big"), (F.col("c") - F.col("big.m")).alias("out")), "key", "inner", hot_left)
    side = (F.col("root") == F.col("big")).cast("int")
    held = F.when(side == 1, F.col("c") - F.col("out")).otherwise(F.col("out"))
    packed = (
        apart.join(classes.select("cls", "n", "sketch"), "cls")
        .groupBy("key", side.alias("side"), F.pmod(F.xxhash64("cls"), F.ceil(held / BLOCK)).alias("block"))
        .agg(F.collect_list(F.struct("cls", "root", "step", "n", "sketch")).alias("g"))
    )
    packed = materialise(packed, "blocks")
    names = packed.select("key", "side", "block")
    pairs = names.filter("side = 0").toDF("key", "s", "x").join(names.toDF("key", "t", "y"), "key").filter("t = 1 or x <= y")
    # blocks join by key and block, so no key's pairs lie in one task
    met = pairs.join(packed.toDF("key", "s", "x", "gx"), ["key", "s", "x"]).join(packed.toDF("key", "t", "y", "gy"), ["key", "t", "y"]).select("gx", "gy")
    more = materialise(met.mapInArrow(released(_meet_blocks), "a binary, b binary").distinct(), "rest")
    if more.take(1):
        links = links.unionByName(verified(more))
    return rows, links


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """(id, n_shingles, component_id) of every row: the smallest id that links reach from it."""
    rows, links = jaccard_classes(docs, id_col, text_col, **kwargs)
    roots = materialise(components(links).toDF("cls", "root"), "roots")
    size = rows.filter("cls is not null").groupBy("cls").agg(F.min("ord").alias("own"), F.count("*").alias("copies"))
    linked = materialise(size.join(roots, "cls", "left").filter("copies > 1 or root is not null").select("cls", "root", "own"), "linked")
    least = linked.filter("root is not null").groupBy("root").agg(F.min("own").alias("least"))
    known = join_unique(linked, least, "root", "left").select("cls", F.coalesce("least", "own").alias("lowest"))
    out = join_unique(rows.select("id", "ord", "n", "cls"), materialise(known, "lowest"), "cls", "left")
    lowest = F.coalesce("lowest", "ord")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(lowest == LAST_ID, F.col("id")).otherwise(lowest).alias("component_id"))
